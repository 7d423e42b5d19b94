"""Finding and redacting personal identifiers, schema checks and dataset hashes, all with JVM expressions."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name, pattern and what replaces it, in the order in which texts are redacted. Case is ignored.
PATTERNS = [
    ("name", r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", "[REDACTED_NAME]"),
    ("address", r"\b\d{1,5}\s+(?:[A-Za-z]+\s+){1,3}(?:St|Street|Ave|Avenue|Blvd|Boulevard|Dr|Drive|Rd|Road|Ln|Lane|Way|Ct|Court)\b", "[REDACTED_ADDRESS]"),
    ("zip_code", r"\b\d{5}(?:-\d{4})?\b", "[REDACTED_ZIP]"),
    ("date_mmddyyyy", r"\b(?:0[1-9]|1[0-2])[/\-](?:0[1-9]|[12]\d|3[01])[/\-](?:19|20)\d{2}\b", "[REDACTED_DATE]"),
    ("date_text", r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b", "[REDACTED_DATE]"),
    ("phone", r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b", "[REDACTED_PHONE]"),
    ("fax", r"(?:fax|facsimile)[:\s]*(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}", "[REDACTED_FAX]"),
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]"),
    ("ssn", r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", "[REDACTED_SSN]"),
    ("mrn", r"\b(?:MRN|Medical\s*Record\s*(?:Number|No|#))[:\s]*[A-Z0-9\-]{5,15}\b", "[REDACTED_MRN]"),
    ("health_plan_id", r"\b(?:Health\s*Plan|Beneficiary|Member)\s*(?:ID|Number|No|#)[:\s]*[A-Z0-9\-]{5,20}\b", "[REDACTED_HEALTH_PLAN_ID]"),
    ("account_number", r"\b(?:Account|Acct)\s*(?:Number|No|#)[:\s]*\d{6,20}\b", "[REDACTED_ACCOUNT]"),
    ("license", r"\b(?:License|Certificate|Cert)\s*(?:Number|No|#)[:\s]*[A-Z0-9\-]{5,20}\b", "[REDACTED_LICENSE]"),
    ("vin", r"\b[A-HJ-NPR-Z0-9]{17}\b", "[REDACTED_VIN]"),
    ("device_serial", r"\b(?:Serial|Device)\s*(?:Number|No|#|ID)[:\s]*[A-Z0-9\-]{5,25}\b", "[REDACTED_DEVICE_ID]"),
    ("url", r"https?://[^\s\"'<>]+", "[REDACTED_URL]"),
    ("ip_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[REDACTED_IP]"),
    ("biometric", r"\b(?:fingerprint|retinal?\s*scan|voice\s*print|facial\s*recognition|dna\s*sample)\b", "[REDACTED_BIOMETRIC]"),
    ("photo_file", r"\b\w+(?:_photo|_face|_headshot|_portrait)\.\w{3,4}\b", "[REDACTED_PHOTO]"),
    ("unique_id", r"\b(?:Patient|Subject|Participant)\s*(?:ID|Number|No|#)[:\s]*[A-Z0-9\-]{3,20}\b", "[REDACTED_ID]"),
]


#: What a text must hold if any pattern of a group is to match: few texts pass, and one look serves the group.
TRIGGERS = {
    "digit": "[0-9]",
    "word": r"\b(?:MRN|Medical|Health|Beneficiary|Member|License|Cert|Serial|Device|fingerprint|retina|voice|facial|dna|Patient|Subject|Participant)",
    "title": r"\b(?:Mr|Mrs|Ms|Dr|Prof)\b",
    "at": "@",
    "scheme": "://",
    "underscore": "_",
}
GROUPS = {
    "digit": {"address", "zip_code", "date_mmddyyyy", "date_text", "phone", "fax", "ssn", "account_number", "ip_address"},
    "word": {"mrn", "health_plan_id", "license", "device_serial", "biometric", "unique_id"},
    "title": {"name"},
    "at": {"email"},
    "scheme": {"url"},
    "underscore": {"photo_file"},
}


WORD = "0-9A-Za-z_"
#: What the JVM takes otherwise than RE2, in which the patterns' results are defined: there words are of ASCII letters, also
#: beside letters with accents; a vertical tab is no space; and s and k have a third case each, the long s and the kelvin.
SPACES, THIRD = r"\t\n\f\r ", {"s": "\\u017f", "k": "\\u212a"}
EDGE = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def in_jvm(pattern: str) -> str:
    """The pattern, in any case, as the JVM finds with it what RE2 finds."""
    out, rest, listed = [], pattern, None  # listed: what the open list of characters holds
    while rest:
        size = 2 if rest[0] == "\\" else 3 if listed is not None and re.match(r"\w-\w", rest) else 1
        one, rest = rest[:size], rest[size:]
        if listed is not None:
            if one == "]":
                out.append("".join(third for c, third in THIRD.items() if re.search(f"[{listed}]", c, re.I)) + one)
                listed = None
                continue
            listed += one
            out.append(SPACES if one == r"\s" else one)
        elif one == "[":
            listed = ""
            if rest[0] == "^":
                one, rest = "[^", rest[1:]
            out.append(one)
        else:
            special = {r"\b": EDGE, r"\s": f"[{SPACES}]", r"\w": f"[{WORD}{''.join(THIRD.values())}]"}
            out.append(special.get(one) or (f"[{one}{THIRD[one.lower()]}]" if one.lower() in THIRD else one))
    return "(?i)" + "".join(out)


def _any_case(pattern: str) -> Column:
    return F.lit(in_jvm(pattern))


def _seen(text: Column) -> list[Column]:
    """Fields m and o for quick looks: the text with what isn't ASCII, and vertical tabs, as a sign that is in no word, in
    which the JVM's own edges of words are RE2's; and whether it holds a long s or a kelvin, which only in_jvm() knows."""
    return [F.regexp_replace(text, F.lit(r"[^\x00-\x0a\x0c-\x7f]+"), F.lit("\u00a4")).alias("m"), F.rlike(text, F.lit(r"[\u017f\u212a]")).alias("o")]


def _found(s: Column, pattern: str) -> Column:
    return F.when(s["o"], F.rlike(s["t"], _any_case(pattern))).otherwise(F.rlike(s["m"], F.lit(f"(?i){pattern}")))


def _triggers(s: Column) -> Column:
    """A struct of booleans: which groups' patterns may match."""
    plain = {"at", "scheme", "underscore"}
    return F.struct(*((F.contains(s["t"], F.lit(t)) if g in plain else _found(s, t)).alias(g) for g, t in TRIGGERS.items()))


def _state(text: Column, *more: Column) -> Column:
    """Struct t, m, o, g (triggers) and more."""
    of = lambda s: F.struct(s["t"].alias("t"), s["m"].alias("m"), s["o"].alias("o"), _triggers(s).alias("g"), *more)
    return F.transform(F.array(F.struct(text.alias("t"), *_seen(text))), of)[0]


def _may_match(name: str, triggers: Column) -> Column:
    """Whether the pattern may match a text of such triggers. A group without a trigger always may."""
    group = next((g for g, names in GROUPS.items() if name in names), None)
    return triggers[group] if group else F.lit(True)


def pii_counts(text: Column) -> Column:
    """map<name, matches in the original text>, of the patterns that match."""

    def counted(s: Column) -> Column:
        each = F.array(*(F.struct(F.lit(n).alias("name"), F.when(_may_match(n, s["g"]), F.when(s["o"], F.regexp_count(s["t"], _any_case(p))).otherwise(F.regexp_count(s["m"], F.lit(f"(?i){p}")))).otherwise(0).alias("n")) for n, p, _ in PATTERNS))
        return F.map_from_entries(F.filter(each, lambda e: e["n"] > 0))

    return F.transform(F.array(_state(text)), counted)[0]


def pii_matches(text: Column) -> Column:
    """array<struct<name, match>>, by pattern, then by place; matches of different patterns may overlap."""

    def named(name: str):
        return lambda m: F.struct(F.lit(name).alias("name"), m.alias("match"))

    every = lambda p: F.coalesce(F.regexp_extract_all(text, _any_case(p), F.lit(0)), F.array().cast("array<string>"))
    return F.flatten(F.array(*(F.transform(every(p), named(n)) for n, p, _ in PATTERNS)))


def pii_spans(text: Column) -> Column:
    """array<struct<name, match, start, end>>, by pattern, then by place: characters from 0, the end not included. Matches
    are marked with two control characters, which a text's own count as spaces for."""
    plain = F.translate(text, "\x01\x02", "  ")

    def of(name: str, pattern: str) -> Column:
        pieces = F.split(F.regexp_replace(plain, _any_case(f"({pattern})"), F.lit("\x01$1\x02")), "\x01")
        rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
        start = F.struct(F.length(F.element_at(pieces, 1)).alias("at"), F.array().cast("array<struct<name:string,match:string,start:int,end:int>>").alias("found"))

        def step(s, piece):
            match = F.substring_index(piece, "\x02", 1)
            one = F.struct(F.lit(name).alias("name"), match.alias("match"), s["at"].alias("start"), (s["at"] + F.length(match)).alias("end"))
            return F.struct((s["at"] + F.length(piece) - 1).alias("at"), F.array_append(s["found"], one).alias("found"))

        return F.aggregate(rest, start, step, lambda s: s["found"])

    return F.when(text.isNull(), F.array().cast("array<struct<name:string,match:string,start:int,end:int>>")).otherwise(F.flatten(F.array(*(of(n, p) for n, p, _ in PATTERNS))))


def _fold(text: Column) -> Column:
    """Struct t, n: the text after all patterns in turn, and the names of those that matched. Each step binds the state
    once, so that expressions don't double. Triggers of the original text g hold until something is replaced; from then on
    every pattern is tried on what has become of it."""

    def step(name: str, pattern: str, put: str):
        def run(s: Column) -> Column:
            hit = ((F.size(s["n"]) > 0) | _may_match(name, s["g"])) & _found(s, pattern)
            left = lambda t: F.struct(t.alias("t"), *_seen(t), s["g"].alias("g"), F.array_append(s["n"], F.lit(name)).alias("n"))
            return F.when(hit, F.transform(F.array(F.regexp_replace(s["t"], _any_case(pattern), F.lit(put))), left)[0]).otherwise(s)

        return run

    state = _state(text, F.array().cast("array<string>").alias("n"))
    for one in PATTERNS:
        state = F.transform(F.array(state), step(*one))[0]
    return state


def strip_pii(df: DataFrame, column: str, clean: str, types: str) -> DataFrame:
    """Adds the redacted text and the sorted names of the patterns that matched when their turn came: later patterns see
    what earlier ones left."""
    df = df.withColumn("__s", _fold(F.col(column)))
    return df.withColumn(clean, F.col("__s.t")).withColumn(types, F.array_sort("__s.n")).drop("__s")


def strip_records(df: DataFrame, redact_map: bool = True) -> DataFrame:
    """Redacts all text columns, and the values of a metadata map; adds items_redacted (patterns per field, summed) and
    pii_types (sorted)."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    names = df.columns
    for c in texts:
        df = strip_pii(df, c, c, f"__t_{c}")
    kinds = [F.col(f"__t_{c}") for c in texts]
    if redact_map and "metadata" in names:
        values = F.transform(F.map_entries("metadata"), lambda e: F.struct(e["key"].alias("k"), _fold(e["value"]).alias("s")))
        df = df.withColumn("__m", values)
        df = df.withColumn("metadata", F.map_from_arrays(F.transform("__m", lambda e: e["k"]), F.transform("__m", lambda e: e["s"]["t"])))
        kinds.append(F.coalesce(F.flatten(F.transform("__m", lambda e: e["s"]["n"])), F.array().cast("array<string>")))
    every = F.concat(*kinds) if kinds else F.array().cast("array<string>")
    return df.select(*names, F.size(every).alias("items_redacted"), F.array_sort(F.array_distinct(every)).alias("pii_types"))


def canonical(columns: list[str]) -> Column:
    """A record as text that only records of equal fields share: of each field its bytes' number, a colon and its text;
    of a null a minus sign."""
    text = lambda c: F.col(c).cast("string")
    return F.concat(*(F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns))


def dataset_hash(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One row: data_hash and records. Each record is hashed where it lies, and so is its place, the columns of `order`.
    Digests are folded in a tree by the place's hash: by its first 8 characters, its first 4, and all. One exchange by the
    4 serves both folds; a row holds 65,536 digests at most (a few more records than that only beyond 10^14 records)."""
    text = lambda c, *by: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, c))), lambda x: F.concat(x["k"], x[c]) if "k" in by else x[c]), ""), 256)
    at = df.select(F.sha2(canonical(columns), 256).alias("h"), F.sha2(canonical(order), 256).alias("k"))
    at = at.withColumn("p", F.substring("k", 1, 4)).repartition("p").withColumn("q", F.substring("k", 1, 8))
    fold = at.groupBy("p", "q").agg(text("h", "k").alias("h"), F.count("*").alias("n"))
    fold = fold.groupBy("p").agg(text("h", "q").alias("h"), F.sum("n").alias("n"))
    return fold.agg(text("h", "p").alias("data_hash"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("records"))


def python_hash(rows: list[dict]) -> str:
    """The hash of records as sorted JSON with ASCII escapes: for small lists, on the driver."""
    import hashlib

    return hashlib.sha256(json.dumps(rows, sort_keys=True, default=str).encode()).hexdigest()


def multiset_hash(columns: list[str]) -> list[Column]:
    """Aggregates n, s0 .. s3 of which hash_text() makes a hash of records in any order, with repeats: sums of quarters of
    each record's digest. For provenance, not against forgers."""
    digest = F.sha2(canonical(columns), 256)
    quarter = lambda k: F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")
    return [F.count("*").alias("n"), *(F.coalesce(F.sum(quarter(k)), F.lit(0)).cast("string").alias(f"s{k}") for k in range(4))]


def redact_to(df: DataFrame, path: str, columns: list[str] | None = None) -> DataFrame:
    """Writes the table with its text columns redacted, and returns one row about it: records, pii_detected, pii_types_found
    (sorted), items_redacted (patterns per field, summed), data_hash (of the originals, by `columns`; default: all). All of
    it is observed while the rows are written: one scan, nothing is read twice. An empty table is written as such."""
    import hashlib

    from pyspark.sql import Observation

    seen = Observation("redaction")
    names = [n for n, _, _ in PATTERNS]
    hashed = df.withColumn("__digest", F.struct(*(F.col(c) for c in columns or df.columns)))
    clean = strip_records(hashed.select(*df.columns, "__digest"))
    cells = multiset_hash([f"__digest.{c}" for c in columns or df.columns])
    found = [F.coalesce(F.sum(F.array_contains("pii_types", n).cast("int")), F.lit(0)).alias(f"has_{n}") for n in names]
    clean.observe(seen, *cells, F.coalesce(F.sum("items_redacted"), F.lit(0)).alias("items"), *found).select(*df.columns).write.mode("overwrite").parquet(path)
    got = seen.get
    digest = hashlib.sha256(":".join(str(got.get(k, 0)) for k in ("n", "s0", "s1", "s2", "s3")).encode()).hexdigest()
    types = sorted(n for n in names if got.get(f"has_{n}", 0))
    row = (got.get("n", 0), bool(types), types, got.get("items", 0), digest)
    return df.sparkSession.createDataFrame([row], "records long, pii_detected boolean, pii_types_found array<string>, items_redacted long, data_hash string")


REQUIRED = {"date": "string", "region": "string", "pathogen": "string", "new_cases": "number", "population": "number"}
OPTIONAL = {"cumulative_cases": "number", "new_deaths": "number", "cumulative_deaths": "number", "source": "string", "metadata": "object"}


def schema_errors(raw: Column, index: Column, strict: bool = False) -> Column:
    """array<string>: code, record and field for each field of a JSON record that is missing or of another type. A boolean
    passes as a number unless strict, which also checks optional fields if present."""
    v = F.try_parse_json(raw)
    checks = []
    for name, want in {**REQUIRED, **(OPTIONAL if strict else {})}.items():
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        kinds = {"string": r"^STRING$", "number": r"^(BIGINT|DOUBLE|DECIMAL.*" + ("" if strict else "|BOOLEAN") + ")$", "object": r"^OBJECT.*$"}[want]
        missing = F.format_string(f"absent: {name} (record %d)", index) if name in REQUIRED else F.lit(None).cast("string")
        wrong = F.format_string(f"type: {name} isn't a {want} (record %d)", index)
        checks.append(F.when(kind.isNull(), missing).when(~F.rlike(kind, F.lit(kinds)), wrong))
    bad = F.array(F.format_string("shape: not an object (record %d)", index))
    return F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), bad).otherwise(F.array_compact(F.array(*checks)))


def audit(df: DataFrame) -> DataFrame:
    """One row: pii_detected, pii_types_found (sorted), matches, of all text columns and metadata values."""
    texts = [F.col(f.name) for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if "metadata" in df.columns:
        texts.append(F.concat_ws("\n", F.map_values("metadata")))
    rows = df.select(F.explode(F.array(*texts)).alias("t")).where("t is not null").select(F.explode(pii_counts(F.col("t"))).alias("type", "n"))
    return rows.agg(F.array_sort(F.collect_set("type")).alias("pii_types_found"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("matches")).select((F.size("pii_types_found") > 0).alias("pii_detected"), "pii_types_found", "matches")
