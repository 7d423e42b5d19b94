"""Main text of web pages by tag-path ratios.

Each piece of text lies at the end of a path of tags from the root. Over a page, text length and punctuation are summed
by path: article paths have long pieces with much punctuation, menus short ones without. The two ratios of each piece's
path are smoothed over the pieces in page order, fused to one score, averaged by path, and paths at or above a threshold
are selected. The selected text decides which element holds the article; of that element everything stays, short
paragraphs and headings included, but for regions that aren't article text by tag, role or class (menus, forms, adverts,
comments ...) and unselected lists of links.

A page is one row and needs no other, so the plan is one narrow map without an exchange; its time is linear in the html.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outbreak_spark.llm.common import Workspace, release

TOKEN = re.compile(r"<!--(?:.*?-->|.*$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/\"']+)")
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Contents aren't markup, up to the end tag.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Tags inside a line of text; all others begin a block. Those of FORMAT aren't part of a path.
FORMAT = frozenset("b i em strong u s small big font mark code kbd samp var sub sup span abbr acronym cite q time tt ins del bdi bdo dfn data br wbr img ruby rb rt".split())
INLINE = FORMAT | frozenset("a label input button td th object svg math".split())
NEVER = frozenset("head script style noscript template svg nav footer aside form button select option textarea iframe noembed noframes object embed video audio canvas map dialog menu title xmp".split())
CONTAINERS = frozenset("html body div section article main header table tbody tr td center ul ol dl".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert".split())
#: Words in class or id of an element that isn't article text.
HINTS = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion sidebar comment comments disqus respond reply replies cookie cookies consent gdpr notice notices disclaimer newsletter subscribe subscription signup login share sharing social "
    "related recommended breadcrumb breadcrumbs menu menus nav navbar navigation footer popup modal overlay widget widgets pagination pager toolbar masthead banner skip copyright".split()
)
NOT_A_HINT = frozenset("no not without with has main".split())
#: A start tag of the first kind ends an open element of the second, up to a tag that holds such lists.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")
#: Weights by distance, in pieces, of smoothing; share of the deviation of path scores at which a path is selected.
KERNEL, THRESHOLD = np.array([0.06, 0.24, 0.4, 0.24, 0.06]), 1.0


class Page:
    """Elements (parent, name, tag, path, whether left out) and pieces of text (element, block, text, in a link) of one page."""

    def __init__(self, source: str):
        self.parent, self.name, self.tag, self.path, self.out, self.hinted, self.article, self.paths = [-1], [""], [""], [0], [False], [False], [False], {}
        self.pieces: list[tuple[int, int, str, bool]] = []
        stack, at, block, links, self.open = [0], 0, 0, 0, Counter()
        for m in TOKEN.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at:
                self._text(stack[-1], block, source[at : m.start()], links > 0)
            at, name = m.end(), (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                if self.open[name]:
                    while (top := self._pop(stack)) != name:
                        links -= top == "a"
                    links -= top == "a"
            else:
                if name in ENDS:
                    links -= self._close(stack, *ENDS[name])
                elif name not in INLINE:
                    links -= self._close(stack, {"p"}, CONTAINERS | {"blockquote", "li", "dd"})
                if name not in VOID:
                    stack.append(self._element(stack[-1], name, m[3]))
                    self.open[name] += 1
                    links += name == "a"
                if name in RAW:
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])|\Z", re.I).search(source, at)
                    at = end.start()
            if name in ("br", "hr", "td", "th", "img"):
                self.pieces.append((stack[-1], block, " ", False))
            if name not in INLINE:
                block += 1
        if at < len(source):
            self._text(stack[-1], block, source[at:], links > 0)

    def _pop(self, stack: list[int]) -> str:
        name = self.name[stack.pop()]
        self.open[name] -= 1
        return name

    def _close(self, stack: list[int], names: set[str], until: set[str]) -> int:
        """Ends the innermost open element of such a name, and what is open in it but formatting; the number of links ended."""
        if any(self.open[x] for x in names):
            for k in range(len(stack) - 1, 0, -1):
                name = self.name[stack[k]]
                if name in names:
                    return sum(self._pop(stack) == "a" for _ in range(len(stack) - k))
                if name in until:
                    break
        return 0

    def _element(self, parent: int, name: str, text: str) -> int:
        attributes: dict[str, str] = {}
        if text and ("=" in text or "hidden" in text):
            for m in ATTRIBUTE.finditer(text):
                attributes.setdefault((m[1] or m[5]).lower(), m[2] or m[3] or m[4] or "")
        role, classes = attributes.get("role", "").lower(), attributes.get("class", "")
        article = self.article[parent]
        out = name in NEVER or role in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")) is not None
        out = out or (name == "header" and not article)
        hinted = name not in ("html", "body", "article", "main") and self._hint(f"{classes} {attributes.get('id', '')}", article)
        self.parent.append(parent)
        self.name.append(name)
        self.tag.append("main" if role == "main" else name)
        self.article.append(article or self.tag[-1] in ("article", "main"))
        label = f"{name}.{classes}" if classes and name in CONTAINERS else name
        self.path.append(self.path[parent] if name in FORMAT else self.paths.setdefault((self.path[parent], label), len(self.paths) + 1))
        self.out.append(self.out[parent] or out)
        self.hinted.append(hinted)
        return len(self.parent) - 1

    @staticmethod
    def _hint(names: str, article: bool) -> bool:
        words = [w.lower() for w in PIECES.findall(names)] if len(names) > 1 else []
        hints = HINTS if article else HINTS | {"header"}
        return any(w in hints and (not k or words[k - 1] not in NOT_A_HINT) for k, w in enumerate(words))

    def _text(self, element: int, block: int, text: str, link: bool) -> None:
        if not self.out[element]:
            self.pieces.append((element, block, entities.unescape(text), link))

    def main_text(self) -> str:
        """Its article's blocks, with an empty line between them."""
        n = len(self.parent)
        parent, tags = self.parent, self.tag
        # A hint doesn't count around an article, nor inside what doesn't.
        holds = [t in ("article", "main") for t in tags]
        for k in range(n - 1, 0, -1):
            holds[parent[k]] |= holds[k]
        out = self.out
        for k in range(1, n):
            out[k] = out[k] or out[parent[k]] or (self.hinted[k] and not holds[k])
        kept = [(e, b, t, link) for e, b, t, link in self.pieces if not out[e]]
        full = [(e, len(s), len(PUNCTUATION.findall(s)), link) for e, _, t, link in kept if (s := t.strip())]
        if not full:
            return ""
        element = np.array([x[0] for x in full])
        length, marks, linked = (np.array([x[k] for x in full], float) for k in (1, 2, 3))
        chosen = select_paths(np.array(self.path)[element], length, marks)
        mass, text, links = np.zeros(n), np.zeros(n), np.zeros(n)
        np.add.at(mass, element, length * chosen)
        np.add.at(text, element, length)
        np.add.at(links, element, length * linked)
        for k in range(n - 1, 0, -1):
            for x in (mass, text, links):
                x[parent[k]] += x[k]
        top = self._article(mass, out)
        inside = [False] * n
        for k in range(n):
            inside[k] = k == top or (k > 0 and inside[parent[k]] and not (tags[k] in ("ul", "ol", "div", "section", "table") and text[k] and links[k] >= 0.8 * text[k] and not mass[k]))
        heading = next((k for k in range(1, n) if tags[k] == "h1" and not out[k]), 0)
        if heading and not inside[heading] and heading < top and not any(tags[k] == "h1" and inside[k] for k in range(n)):
            for k in range(heading, n):
                inside[k] = inside[k] or k == heading or (parent[k] >= heading and inside[parent[k]] and k < top)
        blocks: dict[int, list[str]] = {}
        for e, b, t, _ in kept:
            if inside[e]:
                blocks.setdefault(b, []).append(t)
        return "\n\n".join(s for x in blocks.values() if (s := " ".join("".join(x).split())))

    def _article(self, mass: np.ndarray, out: list[bool]) -> int:
        """The element that holds the article: an article or main element with most of the selected text, or else the
        innermost container with nearly all of it."""
        for name in ("article", "main"):
            own = [k for k in range(1, len(out)) if self.tag[k] == name and not out[k]]
            best = max(own, key=lambda k: (mass[k], -k), default=0)
            if best and mass[best] >= 0.5 * mass[0]:
                return best
        at, child = 0, -1
        children: dict[int, list[int]] = {}
        for k in range(1, len(out)):
            children.setdefault(self.parent[k], []).append(k)
        while child:
            child = next((k for k in children.get(at, ()) if mass[k] >= 0.7 * mass[0] and self.tag[k] in CONTAINERS), 0)
            at = child or at
        return at


def select_paths(path: np.ndarray, length: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Of pieces in page order, given their paths, lengths and punctuation marks: which lie on a selected path."""
    _, at = np.unique(path, return_inverse=True)
    pieces = np.bincount(at)
    score = np.ones(len(at))
    for total in (length, 1.0 + marks):
        ratio = (np.bincount(at, total) / pieces)[at]
        ends = np.pad(ratio, len(KERNEL) // 2, mode="edge")
        score *= np.convolve(ends, KERNEL, "valid")
    fused = np.bincount(at, score) / pieces
    return (fused >= min(THRESHOLD * fused.std(), fused.max()))[at]


def main_text(source: str) -> str:
    return Page(source).main_text() if source else ""


def extract(pages: DataFrame, *columns: str) -> DataFrame:
    """page_id, url, text (the article; empty if there is none), n_chars (its code points), and the named columns.

    pages needs page_id, url and html. Null and empty html give an empty text. Null and repeated page_ids are kept, each
    row a page of its own; an empty table gives an empty result. Whole pages of any length count; markup that isn't
    closed or is cut off is read to its end. Other columns are returned only if named; those named like a column of the
    result are an error. Character references are decoded; white space (Unicode's) inside a block becomes one space.
    """
    if clash := set(columns) & {"page_id", "url", "text", "n_chars", "html"}:
        raise ValueError(f"columns have names of the result: {sorted(clash)}")
    rows = pages.select("page_id", "url", *columns, F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    schema = rows.drop("html").schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-2]), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)
        release()

    # Written, as only then are the batches short: rows hold whole pages.
    return Workspace(pages.sparkSession, "pages").write(rows.mapInArrow(run, schema), "texts")


def op12_tag_path_ratios(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
