"""Main text of web pages by removal of site templates.

A page is read into elements once. Subtrees whose tag, role or class says what they
are (navigation, header and footer of the page, forms, adverts, notices, comments
and so on) are left out. Of the rest, every block-level subtree is hashed; Spark
counts in how many different page texts of a host each hash occurs, and subtrees
that recur in many of them are deleted as its template. A subtree that holds more
than half of the text left of a page is kept there with all that is in it. An article
element, where a page has one, holds the main text. Template removal acts inside it
too, on the containers there (a bar of links, a box, a card, a list); a paragraph, a
heading, a quote or another element of PROSE that pages of a host share is content
there, and goes only with a container that recurs.

The rules on tags and classes come first; template removal acts on all that they leave.

Defined cases: null and empty pages, and pages without text, give an empty text; a
null url is a host of its own; pages of equal text count as one page of the host;
rows of equal id are read one by one; pages cut short end where they end; a ``<`` no
``>`` answers is text; tag names count to 64 characters; columns named as the result's
``text`` and ``n_chars`` are replaced, other columns stay, maps too; an empty table
gives an empty table. Reading takes time in proportion to a page's length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardgraph.llm.common import written

# A subtree is template if at least MIN_PAGES different page texts of the host have
# it and they are at least MIN_SHARE of the host's, or MANY_PAGES on a large host.
MIN_PAGES, MIN_SHARE, MANY_PAGES = 3, 0.3, 50

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]{0,63})")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
RAW = {"script", "style", "textarea", "xmp", "noscript", "template", "iframe", "svg", "title"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Elements that hold no text of the article.
OUT = set("head nav aside footer form button select option dialog menu noscript template iframe svg object audio video canvas map script style textarea title xmp label fieldset".split())
OUT_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
# Words of a class or id that name a part of the page which is not the article.
OUT_NAMES = set(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar header footer masthead banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup "
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus respond reply replies related recommended share sharing social widget "
    "login search toolbar pagination pager tags copyright skip".split()
)
CONTENT_NAMES = {"article", "main"}
# Elements that hold a piece of the text itself: inside an article they are no template on their own.
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd caption figcaption legend summary address tr td th thead tbody tfoot".split())
IMPLIED_END = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SPACE = re.compile(r"\s+")


def _left_out(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in OUT or (tag == "header" and not in_article):
        return True
    if not attributes.strip():
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = unescape(next((v for v in values if v), "")).lower(), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if name == "role" and value in OUT_ROLES:
            return True
        if name in ("class", "id") and tag not in ("body", "html", "article", "main") and OUT_NAMES & set(re.split(r"[^a-z0-9]+", value)):
            return True
    return False


class _Markup:
    """Tags and comments of a page in order, in time that grows with its length.

    A tag ends at the first ``>`` outside quoted values. Where none comes, ``<`` is
    text; quotes from which no end was reached are remembered, so that none is
    followed twice.
    """

    def __init__(self, html: str) -> None:
        self.html = html
        self.marks = [m.start() for m in re.finditer("[>\"']", html)]
        self.last = html.rfind(">")
        self.dead: set[int] = set()
        self.mark = 0

    def _end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag whose attributes begin at ``at``, or -1."""
        marks, html = self.marks, self.html
        while self.mark < len(marks) and marks[self.mark] < at:
            self.mark += 1
        seen, k = [], self.mark
        while k < len(marks):
            place = marks[k]
            if html[place] == ">":
                return place
            if place in self.dead:
                break
            seen.append(place)
            close = html.find(html[place], place + 1)
            if close < 0:
                break
            k = bisect_right(marks, close, k)
        self.dead.update(seen)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next tag; comments have no name."""
        html = self.html
        while (at := html.find("<", at)) >= 0:
            if html.startswith("<!--", at):
                stop = html.find("-->", at + 4)
                return at, len(html) if stop < 0 else stop + 3, "", "", ""
            if at > self.last:
                # Only a comment can still come.
                at = html.find("<!--", at)
                if at < 0:
                    return None
                continue
            if html[at + 1] in "!?":
                return at, html.index(">", at) + 1, "", "", ""
            if m := NAME.match(html, at + 1):
                stop = self._end(m.end())
                if stop >= 0:
                    return at, stop + 1, m[1], m[2].lower(), html[m.end() : stop]
            at += 1
        return None


def read(html: str) -> tuple[list[str], list[tuple[int, int, int]], bool]:
    """Blocks of a page in order, its subtrees as (hash, first block, block after the last), and whether there is an article.

    Only block-level subtrees are hashed, by their tags, text and the hashes of
    the subtrees within. Where there is an article, subtrees outside and those of
    PROSE hold no block: they count for the host, but are not deleted. Time and
    space grow with the page's length.
    """
    stack: list[tuple] = []  # tag, left out, in content, digest, blocks before
    opened: Counter = Counter()
    outs = inside = 0
    blocks: list[tuple[str, bool]] = []  # text, in content
    subtrees: list[tuple[int, int, int, bool]] = []  # hash, first block, block after the last, container in content
    words: list[str] = []
    content = False

    def flush() -> None:
        text = SPACE.sub(" ", unescape("".join(words))).strip()
        words.clear()
        if text:
            if stack:
                stack[-1][3].update(b">" + text.encode("utf-8", "replace"))
            if not outs:
                blocks.append((text, inside > 0))

    def close() -> None:
        nonlocal outs, inside
        tag, out, opens, digest, start = stack.pop()
        opened[tag] -= 1
        outs, inside = outs - out, inside - opens
        value = digest.digest()
        if stack:
            stack[-1][3].update(b"<" + value)
        subtrees.append((int.from_bytes(value, "little", signed=True), start, len(blocks), inside > 0 and tag not in PROSE))

    markup = _Markup(html)
    at, end = 0, len(html)
    while at < end:
        found = markup.next(at)
        words.append(html[at : found[0] if found else end])
        if not found:
            break
        _, at, slash, tag, attributes = found
        if not tag or tag in INLINE:
            continue
        if tag in ("br", "hr"):
            words.append(" ")
            continue
        if tag in VOID:
            continue
        flush()
        if slash:
            while opened[tag] and stack:
                last = stack[-1][0] == tag
                close()
                if last:
                    break
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        if stack and stack[-1][0] in IMPLIED_END.get(tag, ()):
            close()
        opens = tag in CONTENT_NAMES or re.search(r"role\s*=\s*[\"']?(?:main|article)\b", attributes) is not None
        out = _left_out(tag, attributes, inside > 0)
        content = content or (opens and not out and not outs)
        stack.append((tag, out, opens, blake2b(tag.encode("utf-8", "replace"), digest_size=8), len(blocks)))
        opened[tag] += 1
        outs, inside = outs + out, inside + opens
    flush()
    while stack:
        close()
    if not content:
        return [text for text, _ in blocks], [t[:3] for t in subtrees], False
    place = [0, *accumulate(int(own) for _, own in blocks)]
    return [text for text, own in blocks if own], [(value, place[a], place[b]) if part else (value, 0, 0) for value, a, b, part in subtrees], True


def _kept(blocks: list[str], subtrees: list[dict], cut: set[int]) -> list[str]:
    """Blocks left when the cut subtrees are deleted, but for those that hold more than half of the text."""
    ends = [0, *accumulate(len(text) for text in blocks)]
    gone, kept = [0] * (len(blocks) + 1), [0] * (len(blocks) + 1)
    for t in subtrees:
        if t["hash"] in cut:
            held = kept if 2 * (ends[t["stop"]] - ends[t["start"]]) > ends[-1] else gone
            held[t["start"]] += 1
            held[t["stop"]] -= 1
    return [text for text, g, k in zip(blocks, accumulate(gone), accumulate(kept)) if not g or k]


SUBTREE = pa.struct([("hash", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])


def _reader(names: list[str]):
    """Adds blocks and subtrees to the columns of a page but its html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column("_page_html")
            for start in range(0, len(pages), 500):
                texts, trees = [], []
                for html in pages.slice(start, 500):
                    blocks, subtrees, _ = read(html.as_py() or "")
                    texts.append(blocks)
                    trees.append([dict(zip(("hash", "start", "stop"), t)) for t in subtrees])
                made = [pa.array(texts, pa.list_(pa.string())), pa.array(trees, pa.list_(SUBTREE))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(start, 500) for c in names], *made], names=[*names, *(f.name for f in READ)])

    return run


def _writer(names: list[str]):
    """Puts the text in place of blocks, subtrees and what is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for blocks, trees, cut in zip(batch.column("_page_blocks"), batch.column("_page_subtrees"), batch.column("_page_cut")):
                left = blocks.as_py()
                if cut.is_valid:
                    left = _kept(left, trees.as_py(), set(cut.as_py()))
                texts.append(" ".join(left))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string())], names=[*names, "text"])

    return run


READ = [
    T.StructField("_page_blocks", T.ArrayType(T.StringType())),
    T.StructField("_page_subtrees", T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))),
]


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def templates(read_pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, subtree): subtrees that recur in many different page texts of a host."""
    host, text = F.col("_page_host").alias("host"), F.xxhash64("_page_blocks").alias("page")
    pages = read_pages.select(host, text, F.explode(F.array_distinct("_page_subtrees.hash")).alias("subtree")).distinct()
    counts = pages.groupBy("host", "subtree").agg(F.count("*").alias("k")).filter(F.col("k") >= min_pages)
    sizes = read_pages.select(host, text).distinct().groupBy("host").agg(F.count("*").alias("pages"))
    return counts.join(sizes, "host").filter(F.col("k") >= F.least(min_share * F.col("pages"), F.lit(MANY_PAGES))).select("host", "subtree")


def main_text(pages: DataFrame, html: str = "html", url: str = "url", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """All pages, without the html, with ``text`` and ``n_chars``."""
    rest = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    row = F.xxhash64(*[F.to_json(F.struct(c)) if _maps(pages.schema[c].dataType) else F.col(c) for c in pages.columns])
    keyed = pages.select(*rest, row.alias("_page_row"), host_of(F.col(url)).alias("_page_host"), F.col(html).alias("_page_html"))
    names = keyed.columns[:-1]
    parsed = written(keyed.mapInArrow(_reader(names), T.StructType([*keyed.schema.fields[:-1], *READ])), "pages-read")
    found = templates(parsed, min_pages, min_share)
    # Only subtrees that hold blocks can be deleted.
    holding = F.filter("_page_subtrees", lambda t: t["start"] < t["stop"])
    touched = parsed.select("_page_row", F.col("_page_host").alias("host"), F.explode(F.array_distinct(F.transform(holding, lambda t: t["hash"]))).alias("subtree"))
    cut = written(touched.join(found, ["host", "subtree"]).groupBy("_page_row").agg(F.collect_set("subtree").alias("_page_cut")), "template-cuts")
    kinds = T.StructType([*[parsed.schema[c] for c in rest], T.StructField("text", T.StringType())])
    texts = parsed.join(cut, "_page_row", "left").select(*rest, "_page_blocks", "_page_subtrees", "_page_cut").mapInArrow(_writer(rest), kinds)
    return texts.select(*rest, "text", F.length("text").cast("long").alias("n_chars"))


def _maps(kind: T.DataType) -> bool:
    """Whether a type holds a map, which has no hash, or a variant."""
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()
