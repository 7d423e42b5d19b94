"""Similarity join of documents by the Jaccard index of their word shingles: a grouped prefix join.

Two sets with a similarity of t or more share a shingle among the first n - ceil(t n) + 1 of each, in any order that
all sets use (rare shingles first works best). Documents whose sets have the same size and the same prefix are
collapsed into one group, and groups are indexed and filtered in place of documents:

1. prefix shingles that no other group has are left out by an exchange of hashes; the others are listed by shingle, and
   equal lists are collapsed to one with a count, which is the number of prefix shingles that its groups share;
2. pairs of groups pass by size and by the shared prefix, which with all that may follow it must reach the threshold;
3. groups expand to their members, the distinct sets in them, and members are verified on whole sets. One member stands
   for its group: it is verified against the group's other members and against the most promising other group, then
   members of long lists against some others in a few rounds, and linked sets become components;
4. pairs of members, of one group or of two, that are still in different components are counted exactly over all lists,
   left out where they can't reach the threshold, and the rest are verified.

So a group of thousands of near copies costs about as many verifications as members, and no link that would change a
component is lost. Order: shingles found frequent in a sample of documents come last; that changes the cost, never the
result. Shingles, sets and groups are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outbreak_spark.llm.common import KEY, SENT, U64, Exchange, WordHashes, Workspace, buckets_for, flushes, fresh, keyed, keys_blob, keys_of, mix, release, spread_join, text_bytes, window_hashes
from outbreak_spark.llm.components import components

#: One document in SAMPLE is looked at for frequent shingles, which occur in OFTEN of them; the list has a fixed bound.
SAMPLE, OFTEN, MOST_FREQUENT = 32, 3, 1_000_000
#: Lists of at most so many groups give all their pairs at once.
SMALL = 12
#: Rounds in which members of longer lists try so many partners each, as long as there are FEW pairs to try.
TRIES, FEW = (4, 24), 200
#: Text bytes of a flush: what the JVM holds of it, a row and its Arrow copies, is as large as its prefixes.
FLUSH = 8 << 20
#: Members of a list that one row holds when it is compared with itself: longer lists are several rows.
CHUNK = 4096


def shingle_set(text: bytes, k: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it is shorter; none without words."""
    words = text.lower().split()  # bytes: only A-Z are lowered
    if not words:
        return np.empty(0, U64)
    h = cache.of(words)
    if len(words) >= k:
        h = window_hashes(h, k)
    else:
        h = mix(window_hashes(h, len(words)), np.full(1, len(words), U64))
    return np.unique(h)


def needed(percent: int, n):
    """Least overlap that a set of n shingles needs with any partner."""
    return -(-percent * n // 100)


def prefix(s: np.ndarray, percent: int, late: np.ndarray) -> np.ndarray:
    """The first n - needed + 1 shingles of a set in the common order: by hash, those of `late` (sorted) at the end."""
    p = len(s) - needed(percent, len(s)) + 1
    if len(late):
        last = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s
        s = np.r_[s[~last], s[last]] if last.any() else s
    return s[:p]


def _frequent(rows: DataFrame, k: int, work: Workspace) -> np.ndarray:
    def count(batches):
        cache = WordHashes()
        for _, (texts,) in flushes(batches, ["text"]):
            h, n = np.unique(np.concatenate([shingle_set(t, k, cache) for t in texts]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    sample = rows.where(F.pmod(F.xxhash64(KEY), F.lit(SAMPLE)) == 0).select("text")
    found = sample.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    found, least = work.write(found, "frequent"), OFTEN
    while found.where(F.col("n") >= least).count() > MOST_FREQUENT:
        least *= 2
    got = found.where(F.col("n") >= least).select("h").toArrow().column("h").to_numpy()
    return np.sort(got.view(U64))


#: A document (its group, and the hash of its whole set), or an entry of the index: a prefix shingle h of a group of sets of n.
ENTRY = f"doc_id long, {KEY} binary, n long, class long, group long, h long, entry boolean"
LISTS = "sig long, m int, cnt long, groups array<long>, sizes array<long>"


def indexed(rows: DataFrame, total: int, k: int, percent: int, work: Workspace, most_buckets: int) -> DataFrame:
    """A row of ENTRY per document, and one for each prefix shingle of a group that another group may have too."""
    exchange = Exchange(total, most=most_buckets)
    hot = rows.sparkSession.sparkContext.broadcast(_frequent(rows, k, work))

    def prefixes(batches):
        cache, late = WordHashes(), hot.value
        for flush, (names, keys, texts) in flushes(batches, ["doc_id", KEY, "text"], FLUSH):
            table, tokens, owner, seen = np.zeros((3, len(texts)), "<u8"), [], [], set()
            for i, text in enumerate(texts):
                s = shingle_set(text, k, cache)
                if not len(s):
                    continue
                first = prefix(s, percent, late)
                group = xxhash.xxh3_64_intdigest(first.tobytes(), len(s))
                table[:, i] = len(s), xxhash.xxh3_64_intdigest(s.tobytes()), group
                if group not in seen:
                    seen.add(group)
                    tokens.append(first)
                    owner.append(np.full(len(first), i, "<u4"))
            h, who = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((tokens, U64), (owner, "<u4")))
            missing = np.array([x is None for x in names])
            name = np.array([0 if x is None else x for x in names], "<i8")
            own = (name.tobytes() + missing.tobytes(), keys_blob(keys), table.tobytes() + h.tobytes() + who.tobytes())
            yield exchange.send(flush, h, np.arange(len(h)), own, short=True)

    def entries(own, at):
        keys = keys_of(own[1])
        d = len(keys)
        missing = np.frombuffer(own[0], bool, offset=8 * d)
        n, cls, group = np.frombuffer(own[2], "<i8", 3 * d).reshape(3, d)
        tokens = (len(own[2]) - 24 * d) // 12
        h, who = np.frombuffer(own[2], "<i8", tokens, 24 * d)[at], np.frombuffer(own[2], "<u4", tokens, 24 * d + 8 * tokens)[at]
        none = pa.nulls(len(at), pa.int64())
        cols = [
            pa.concat_arrays([pa.array(np.frombuffer(own[0], "<i8", d), pa.int64(), mask=missing), none]),
            pa.concat_arrays([pa.array(keys.tolist(), pa.binary()), pa.nulls(len(at), pa.binary())]),
            pa.array(np.r_[n, n[who]]), pa.concat_arrays([pa.array(cls), none]), pa.array(np.r_[group, group[who]]),
            pa.concat_arrays([pa.nulls(d, pa.int64()), pa.array(h)]), pa.array(np.arange(d + len(at)) >= d),
        ]
        return pa.Table.from_arrays(cols, ["doc_id", KEY, "n", "class", "group", "h", "entry"])

    return work.write(exchange.repeats(rows.mapInArrow(prefixes, SENT), entries, ENTRY), "index")


def lists_of(entries: DataFrame, buckets: int) -> DataFrame:
    """The groups that have a prefix shingle in common, as long as there are two; equal lists once, with their count."""

    def gather(key, table):
        res, grp, size = (table.column(x).to_numpy() for x in ("h", "group", "n"))
        order = np.lexsort((grp, res))
        res, grp, size = res[order], grp[order], size[order]
        new = np.r_[True, (res[1:] != res[:-1]) | (grp[1:] != grp[:-1])]
        res, grp, size = res[new], grp[new], size[new]
        first = np.flatnonzero(np.r_[True, res[1:] != res[:-1]])
        m = np.diff(np.r_[first, len(res)])
        sig = np.add.reduceat(mix(grp.view(U64), grp.view(U64)), first)
        many = m > 1
        first, m, sig = first[many], m[many], sig[many]
        sig, one, cnt = np.unique(mix(sig, m.astype(U64)), return_index=True, return_counts=True)
        first, m = first[one], m[one]
        at = np.repeat(first - (np.cumsum(m) - m), m) + np.arange(m.sum())
        offsets = pa.array(np.r_[0, np.cumsum(m)].astype(np.int32))
        if len(order) > 1 << 19:
            del order, new
            release()
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[at].astype(np.int64))) for x in (grp, size)]
        return pa.Table.from_arrays([pa.array(sig.view(np.int64)), pa.array(m.astype(np.int32)), pa.array(cnt.astype(np.int64)), *lists], ["sig", "m", "cnt", "groups", "sizes"])

    dealt = entries.select(F.pmod("h", F.lit(buckets)).alias("bucket"), "h", "group", "n")
    found = dealt.groupBy("bucket").applyInArrow(gather, LISTS)
    return found.groupBy("sig", "m").agg(F.sum("cnt").alias("cnt"), F.first("groups").alias("groups"), F.first("sizes").alias("sizes"))


def similar_sets(docs: DataFrame, k: int, percent: int, work: Workspace, most_buckets: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row key, n, v) of each document and (v, c) of each set that has a link: v stands for a distinct set, by
    the group's number for the set that represents its group, c for a component."""
    rows = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"))
    total = text_bytes(docs)
    found = indexed(rows, total, k, percent, work, most_buckets)
    table = found.where("not entry").select("doc_id", KEY, "n", "class", "group")
    several = table.where("n > 0").groupBy("group").agg(F.min("class").alias("one"), F.max("class").alias("other")).where("one <> other")
    several = work.write(several.select("group", "one"), "several")
    table = work.attach(table, "several", several, "group", "left")
    v = F.when(F.col("one").isNull() | (F.col("class") == F.col("one")), F.col("group")).otherwise(F.col("class"))
    table = work.write(table.select("doc_id", KEY, "n", "group", v.alias("v")), "members")
    # The sets besides the first of groups that have several.
    extra = work.write(table.where("v <> group").select("group", "v", "n").distinct(), "extra")
    lists = work.write(lists_of(found.where("entry"), buckets_for(total, 24 << 20)), "lists")

    up = lambda c: F.ceil(F.lit(percent) * c / 100)
    alike = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    # Of the overlap, at most the shared prefix and what follows the prefix of one set (2 for hashes cut to 32 bits).
    least_shared = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / (100 + percent)) - F.greatest(up(F.col("na")), up(F.col("nb"))) - 1

    def pairs_of(batches):
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(5)]
            for classes, sizes, cnt in zip(batch.column("groups").to_pylist(), batch.column("sizes").to_pylist(), batch.column("cnt").to_pylist(), strict=True):
                cls, size = np.array(classes), np.array(sizes)
                order = np.argsort(cls)
                i, j = (order[x] for x in np.triu_indices(len(cls), 1))
                ok = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
                for col, x in zip(cols, (cls[i], cls[j], size[i], size[j], np.full(len(i), cnt)), strict=True):
                    col.append(x[ok])
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols], ["a", "b", "na", "nb", "c"])

    few = lists.where(F.col("m") <= SMALL)
    pairs = few.select("groups", "sizes", "cnt").mapInArrow(pairs_of, "a long, b long, na long, nb long, c long")
    pairs = work.write(pairs.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c")), "pairs")
    big = lists.where(F.col("m") > SMALL)
    each = big.select("sig", "m", "cnt", "groups", "sizes", F.explode(F.arrays_zip("groups", "sizes")).alias("e"))
    each = each.select("sig", "m", "cnt", F.col("e.groups").alias("a"), F.col("e.sizes").alias("na"), "groups", "sizes")

    hopeful = pairs.where(F.col("c") >= least_shared)
    ends = hopeful.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"), "c")
    best = ends.groupBy("e.x").agg(F.max_by("e.y", F.struct("c", -F.col("e.y"))).alias("y"))
    best = best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    within = extra.select(F.least("group", "v").alias("a"), F.greatest("group", "v").alias("b"))
    tried = work.write(best.unionByName(within).distinct(), "tried")
    links = verify(tried, rows, table, k, percent, work, "first")
    comp = work.write(components(links, work, "one-"), "one")

    def named(df: DataFrame, x: str) -> DataFrame:
        return df.join(comp.select(F.col("v").alias(x), F.col("c").alias(f"c{x}")), x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))

    for step, tries in enumerate(TRIES):
        # Members of longer lists that share enough with them try some others of their lists, drawn by hash.
        draws = each.select("a", "na", "cnt", F.explode(F.array(*(F.xxhash64("a", "sig", F.lit(2 * step + x)) for x in (0, 1)))).alias("h"), "m", "groups", "sizes")
        at = (F.pmod("h", "m") + 1).cast("int")
        draws = draws.select("a", "na", "cnt", "h", F.element_at("groups", at).alias("b"), F.element_at("sizes", at).alias("nb")).where(alike & (F.col("a") != F.col("b")))
        draws = draws.groupBy("a", "na").agg(F.sum("cnt").alias("c"), F.collect_set(F.struct("h", "b")).alias("d"))  # at most two per prefix shingle
        draws = draws.where(F.col("c") / 2 >= F.ceil(F.lit(2 * percent) * F.col("na") / (100 + percent)) - up(F.col("na")) - 1)
        draws = named(named(draws.select("a", F.explode(F.slice(F.array_sort("d"), 1, tries)).alias("e")).select("a", F.col("e.b").alias("b")), "a"), "b").where("ca <> cb")
        more = draws.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        more = work.write(more, f"tried{step}")
        if more.count() < FEW:
            break
        tried = tried.unionByName(more)
        links = links.unionByName(verify(more, rows, table, k, percent, work, f"round{step}"))
        comp = work.write(components(links, work, f"step{step}-"), f"step{step}")

    # Groups expand: a group's other sets are in the lists that it is in, and all its sets are a list by themselves.
    own = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1  # the prefix that they share
    other = extra.select(F.col("group").alias("a"), F.col("v").alias("x"))
    sets = extra.select("group", "v", "n").unionByName(extra.select("group", F.col("group").alias("v"), "n").distinct())
    each = each.select("sig", "cnt", "a", "na")
    each = each.unionByName(each.join(other, "a").select("sig", "cnt", F.col("x").alias("a"), "na"))
    each = each.unionByName(sets.select(F.col("group").alias("sig"), own.cast("long").alias("cnt"), F.col("v").alias("a"), F.col("n").alias("na")))
    swapped = lambda df: df.join(other.withColumnRenamed("a", "b"), "b").drop("b").withColumnRenamed("x", "b")
    half = pairs.unionByName(pairs.join(other, "a").drop("a").withColumnRenamed("x", "a"))
    pairs = half.unionByName(swapped(half))
    # A set's shared prefix, with anyone: no pair shares more.
    shared = lists.select("cnt", F.explode("groups").alias("v")).unionByName(sets.select(own.cast("long").alias("cnt"), "v"))
    more = lists.select("cnt", F.explode("groups").alias("a")).join(other, "a").select("cnt", F.col("x").alias("v"))
    shared = work.write(shared.unionByName(more).groupBy("v").agg(F.sum("cnt").alias("t")), "shared")

    # Every pair across components is counted with its member of the smaller component.
    size = comp.groupBy("c").count()

    def ranked(df: DataFrame, x: str) -> DataFrame:
        df = named(df, x).join(size.select(F.col("c").alias(f"c{x}"), F.col("count").alias(f"z{x}")), f"c{x}", "left")
        df = df.join(shared.select(F.col("v").alias(x), F.col("t").alias(f"t{x}")), x)
        return df.withColumn(f"z{x}", F.coalesce(f"z{x}", F.lit(1)))

    each = work.write(ranked(each, "a"), "each")
    last = each.groupBy("sig").agg(F.max(F.struct("za", "ca")).alias("last"), F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    each = each.join(last, "sig")
    whole = each.withColumn("chunk", F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int")).groupBy("sig", "chunk").agg(F.collect_list(F.struct("a", "na", "za", "ca", "ta")).alias("w"))
    rest = each.where(F.struct("za", "ca") < F.col("last")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("last", "chunks").join(whole, ["sig", "chunk"])

    def shared_at_least(na, nb):
        return F.ceil(F.lit(percent) * (na + nb) / (100 + percent)) - F.greatest(up(na), up(nb)) - 1

    def may_link(x):
        n = F.col("na")
        alike = 100 * F.least(n, x["na"]) >= percent * F.greatest(n, x["na"])
        return (F.struct(x["za"], x["ca"]) > F.struct("za", "ca")) & alike & (F.least(F.col("ta"), x["ta"]) >= shared_at_least(n, x["na"]))

    rest = rest.select("a", "na", "cnt", F.filter("w", may_link).alias("w")).where(F.size("w") > 0).select("a", "na", "cnt", F.col("w.a").alias("b"), F.col("w.na").alias("nb"))
    across = ranked(ranked(pairs, "a"), "b").where((F.col("ca") != F.col("cb")) & (F.least("ta", "tb") >= least_shared))
    swap = F.struct("za", "ca") > F.struct("zb", "cb")
    one = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    across = across.select(one("a", "b").alias("a"), one("na", "nb").alias("na"), F.col("c").alias("cnt"), F.array(one("b", "a")).alias("b"), F.array(one("nb", "na")).alias("nb"))

    def counted(key, table):
        na = table.column("na")[0].as_py()
        b, nb = (table.column(x).combine_chunks().flatten().to_numpy() for x in ("b", "nb"))
        cnt = np.repeat(table.column("cnt").to_numpy(), pc.list_value_length(table.column("b")).to_numpy())
        who, first, at = np.unique(b, return_index=True, return_inverse=True)
        least = -(-percent * (na + nb) // (100 + percent)) - np.maximum(needed(percent, na), needed(percent, nb)) - 1
        who = who[np.bincount(at, cnt, len(who)) >= least[first]]
        a = np.full(len(who), key[0].as_py())
        return pa.table({"a": pa.array(np.minimum(a, who), pa.int64()), "b": pa.array(np.maximum(a, who), pa.int64())})

    left = rest.unionByName(across).groupBy("a").applyInArrow(counted, "a long, b long")
    left = work.write(left.join(tried, ["a", "b"], "left_anti"), "left")
    more = verify(left, rows, table, k, percent, work, "second")
    comp = work.write(components(links.unionByName(more), work, "two-"), "two")
    return table, comp


def verify(pairs: DataFrame, rows: DataFrame, table: DataFrame, k: int, percent: int, work: Workspace, name: str) -> DataFrame:
    """The pairs (a, b) of sets that are similar enough as a whole."""
    wanted = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct()
    # One document stands for its set; a key may belong to repeated rows.
    one = table.groupBy("v").agg(F.min(KEY).alias(KEY)).join(wanted, "v")
    one = work.write(one, f"{name}-one")

    def sets(batches):
        fresh()
        cache = WordHashes()
        for batch in batches:
            out = [shingle_set(t, k, cache).astype("<u8").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(out, pa.binary())], ["v", "s"])
        out = cache = None
        release()

    found = work.attach(rows, f"{name}-one", one, KEY, "inner").select("v", "text").mapInArrow(sets, "v long, s binary")
    found = work.write(found, f"{name}-sets").groupBy("v").agg(F.max("s").alias("s"))

    def values(s: bytes) -> np.ndarray:
        return np.frombuffer(s, "<u8")

    def link(batches):
        for batch in batches:
            keep = []
            for s, t in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist(), strict=True):
                both = np.concatenate([values(s), values(t)])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(both) - same))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])
        release()

    joined = pairs.join(found.withColumnRenamed("v", "a"), "a").join(found.select(F.col("v").alias("b"), F.col("s").alias("t")), "b")
    links = work.write(joined.select("a", "b", "s", "t").mapInArrow(link, "a long, b long"), f"{name}-links")
    work.drop(f"{name}-sets", f"{name}-one")
    return links


def similarity_components(docs: DataFrame, k: int = 5, percent: int = 75, most_buckets: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links), group (a number for the component, null
    without shingles) and row_key (a hash of doc_id and text) of each document.

    docs needs doc_id and text; other columns are ignored. Documents link when 100 * intersection >= percent * union of
    their sets of distinct k-word shingles (A-Z lowered; fewer words: the whole sequence). Without words (null, empty,
    blank) a document has 0 shingles and is its own component. Repeated rows and equal texts share a component. A null
    doc_id is kept and never a component's id unless all its members' are null. An empty table gives an empty result.
    most_buckets: see Exchange.
    """
    work = Workspace(docs.sparkSession, "jaccard")
    table, comp = similar_sets(docs, k, percent, work, most_buckets)
    full = table.where("n > 0")
    # By set, then by component: neither a set nor a component with many rows is one task's work.
    sets = full.groupBy("v").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least")).join(comp, "v", "left")
    sets = work.write(sets.withColumn("c", F.coalesce("c", "v")), "sets")
    least = work.write(sets.groupBy("c").agg(F.count("*").alias("sets"), F.min("least").alias("component_id")), "least")
    sets = work.write(spread_join(sets.select("v", "c", "rows"), least, "c", "sets").select("v", "c", "rows", "component_id"), "joined")
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("c").alias("group"), F.col(KEY).alias("row_key")]
    empty = table.where("n = 0").withColumn("component_id", F.col("doc_id")).withColumn("c", F.lit(None).cast("long"))
    return spread_join(full, sets, "v", "rows").select(columns).unionByName(empty.select(columns))


def op2_grouped_prefix_join(spark, sf_dir: str) -> DataFrame:
    out = similarity_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id")
