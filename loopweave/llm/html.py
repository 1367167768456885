"""Main text of pages: block structure and repeated runs of each host.

A page becomes a stream of blocks in page order, each with its place: inside the article element
(or the main element where there is no article), inside a part that is never main text (menus,
headers, footers, sidebars, forms, scripts, styles, adverts, notices, comments), or neither. Text
inside the article is kept whole, repeated or not. Pages without an article keep the blocks in
neither place, except what the host repeats.

An article inside parts that are never main text (``has-sidebar``, a form around the page, a menu never
closed) is told from teasers there. It counts, and only marks inside it leave text out, when all that
wraps it are forms and names of a state or layout; or when it is the page's longest article, and no
shorter than the text in neither place (unless a wrapper is never closed). What wraps it then counts for
no other article either. An article in a comment list, in another article or in an element not shown never does so.

The words of the open blocks of all of one host's pages, those beside an article included, form its token stream. Its suffixes are sorted by
their first ``run`` words, the depth to which a repeated run has to be told: suffixes that agree
there stand next to each other in the suffix array, and they are boilerplate when they come from
two distinct pages or more. A page's words that such suffixes cover are removed, and the unique
runs stay. Suffix order is kept as hashes of the first ``run`` words, grouped across the cluster
with partial minima and maxima of the page's text digest, so that a host with a third of all pages
is spread by suffix and no task holds a host. Copies of one page (equal open words) are one page
here; else a mirrored page would erase itself.

Defined cases: null or empty html has empty text; a page cut off in the middle of a tag or character
reference keeps what came before, the unfinished reference as it stands; a null url is a host of
its own name (empty); repeated rows are extracted one by one.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from loopweave.llm.common import mix64, set_aside, slices, stored
from loopweave.llm.urls import host_of

RUN = 8
OPEN, MAIN, OUT = 0, 1, 2

#: Elements whose text is not shown or not main text, and elements that break a line.
UNSHOWN = frozenset("script style noscript template svg math iframe object head title select textarea canvas audio video".split())
ASIDE = frozenset("nav header footer aside form button menu dialog".split())
MAIN_ELEMENTS = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words in class, id or role that mark a part as no main text.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|adverts|banner|breadcrumb|breadcrumbs|comment|comments|consent|cookie|cookies|disqus|footer|gdpr|"
    r"header|menu|modal|nav|navbar|navigation|newsletter|notice|popup|promo|promoted|related|share|sharing|sidebar|social|sponsor|sponsored|"
    r"subscribe|widget|complementary|contentinfo|search)(?:$|[\s_-])"
)
#: Parts of a class, id or role by which it names a state or layout of the page, not a part of it.
STATES = frozenset("no not has have with without is show hide open opened close closed enabled disabled on off none hidden layout page body site".split())
COMMENTS = frozenset(("comment", "comments", "disqus"))
TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z))", re.S)
RAW_END = {t: re.compile(rf"</{t}\s*(?:>|\Z)", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe")}
MARKED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
IMPLIED_END = {"p": BLOCK - {"br"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    place: int
    text: str
    part: int = -1  # the outermost article it is text of


@dataclass
class Element:
    name: str
    gone: bool
    before: tuple[int, int, int]  # parts left out, main depth and article around it
    marks: str
    closed: bool = False

    @property
    def loose(self) -> bool:
        """Whether it is marked as a state or layout only, or as a form."""
        named = all(STATES.intersection(re.split("[_-]", x)) for x in self.marks.split() if MARKS.search(x))
        return (self.name == "form" or self.name not in ASIDE) and named

    @property
    def hides(self) -> bool:
        """Whether no article below it can be the page's: not shown, or comments."""
        parts = [frozenset(re.split("[_-]", x)) for x in self.marks.split()]
        return self.name in UNSHOWN - {"head"} or any(x & COMMENTS and not x & STATES for x in parts)


def _settle(out: list[Block], wrapped: dict[int, list[Element]]) -> list[Block]:
    """Texts of articles inside left-out parts become main where the article is the page's, see above."""
    if not wrapped:
        return out
    sizes: dict[int, int] = {}
    for b in out:
        if b.part >= 0:
            sizes[b.part] = sizes.get(b.part, 0) + len(b.text)
    good = {k for k, around in wrapped.items() if all(e.loose for e in around)}
    longest = max(sizes, key=lambda k: (sizes[k], -k), default=-1)
    if longest in wrapped and longest not in good:
        around = wrapped[longest]
        beside = sum(len(b.text) for b in out if b.place == OPEN)
        if sizes[longest] >= beside or not all(e.closed for e in around):
            freed = {id(e) for e in around}
            good |= {k for k, others in wrapped.items() if all(e.loose or id(e) in freed for e in others)}
    for b in out:
        if b.part in good:
            b.place = MAIN
    return out


def blocks_of(page: str | None) -> list[Block]:
    """The blocks with text in page order, white space inside one block made single."""
    out: list[Block] = []
    texts: list[str] = []
    stack: list[Element] = []
    left_out = main = 0
    part, parts = -1, 0  # the article around the text, and how many there were
    wrapped: dict[int, list[Element]] = {}  # articles inside left-out parts, and those parts
    at, page = 0, page or ""

    def flush() -> None:
        text = SPACE.sub(" ", references.unescape("".join(texts))).strip()
        texts.clear()
        if text:
            place = OUT if left_out or part in wrapped else MAIN if main else OPEN
            out.append(Block(place, text, -1 if left_out else part))

    def close(depth: int) -> None:
        nonlocal left_out, main, part
        while len(stack) > depth:
            left_out, main, part = stack.pop().before

    while at < len(page):
        found = TAG.search(page, at)
        if found is None:
            texts.append(page[at:])
            break
        texts.append(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            flush()
        if found[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth].name == name:
                    flush()
                    stack[depth].closed = True
                    close(depth)
                    break
            continue
        if name in VOID or found[3].endswith("/"):
            continue
        while stack and name in IMPLIED_END.get(stack[-1].name, ()):
            flush()
            close(len(stack) - 1)
        marks = " ".join(a or b or c for a, b, c in MARKED.findall(found[3])).lower()
        gone = name in UNSHOWN or (name in ASIDE) or bool(marks and name not in ("html", "body", "article", "main") and MARKS.search(marks))
        if gone and not (name in BLOCK):
            flush()
        stack.append(Element(name, gone, (left_out, main, part), marks))
        left_out += gone
        if name in MAIN_ELEMENTS:
            if not left_out:
                main += 1
                if part < 0:
                    part, parts = parts, parts + 1
            elif not any(e.hides for e in stack) and not any(e.name == "article" or e.name == name for e in stack[:-1]):
                part, parts, left_out, main = parts, parts + 1, 0, main + 1
                wrapped[part] = [e for e in stack if e.gone]
        if name in RAW_END:
            end = RAW_END[name].search(page, at)
            if end is None:
                break
            at = end.end()
            flush()
            close(len(stack) - 1)
    flush()
    return _settle(out, wrapped)


def _open_words(blocks: list[Block]) -> list[str]:
    return [w for b in blocks if b.place == OPEN for w in b.text.split(" ")]


def _suffix_keys(words: list[str], host: int, run: int) -> np.ndarray:
    """A hash of host and the first ``run`` words of every suffix that has as many."""
    if len(words) < run:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    mixed = np.full(len(words) - run + 1, host, dtype=np.uint64)
    for k in range(run):
        mixed = mix64(mixed * np.uint64(31) + codes[k : len(words) - run + 1 + k])
    return mixed


def _spans_removed(words: list[str], starts: list[int], run: int) -> str:
    keep = np.ones(len(words), dtype=bool)
    for at in starts:
        keep[at : at + run] = False
    return " ".join(w for w, k in zip(words, keep) if k)


#: Names of columns that are needed on the way.
OWN = ("_host", "_uid", "_main", "_open", "_starts")


def _parsed(pages: DataFrame) -> DataFrame:
    """``pages`` with uid, host, main (text, null without a main part) and open (words in neither place, also beside a main part)."""
    columns = pages.columns
    marked = pages.withColumn("_host", host_of(F.col("url"))).withColumn("_uid", F.monotonically_increasing_id())
    schema = marked.drop("html").select("*").schema.add("_main", "string").add("_open", ArrayType(StringType()))
    at_html = columns.index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            mains, opens = [], []
            for page in part.column(at_html).to_pylist():
                blocks = blocks_of(page)
                inside = [b.text for b in blocks if b.place == MAIN]
                mains.append(" ".join(inside) if inside else None)
                opens.append(_open_words(blocks))
            rest = [part.column(k) for k in range(part.num_columns) if k != at_html]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(mains, pa.string()), pa.array(opens, pa.list_(pa.string()))], names=schema.names
            )

    return marked.mapInArrow(run, schema)


def _covered(parsed: DataFrame, run: int) -> DataFrame:
    """_uid, starts: where a page's repeated suffix heads begin."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, host, words in zip(*(c.to_pylist() for c in batch.columns)):
                keys = _suffix_keys(words, xxhash.xxh64_intdigest(host), run)
                page = np.array([xxhash.xxh64_intdigest(" ".join(words))], dtype=np.uint64).view(np.int64)[0]
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, uid)), pa.array(np.arange(n)), pa.array(keys.view(np.int64)), pa.array(np.full(n, page))],
                    names=["_uid", "at", "suffix", "page"],
                )

    suffixes = parsed.filter(F.size("_open") >= run).select("_uid", "_host", "_open").mapInArrow(
        heads, "_uid long, at long, suffix long, page long"
    )
    shared = suffixes.groupBy("suffix").agg(F.min("page").alias("low"), F.max("page").alias("high")).filter("low < high")
    return (
        suffixes.join(shared.select("suffix"), "suffix", "left_semi")
        .groupBy("_uid")
        .agg(F.sort_array(F.collect_list("at")).alias("_starts"))
    )


def main_text(pages: DataFrame, run: int = RUN) -> DataFrame:
    """``pages(page_id, url, html, ...)`` without html, with text and n_chars; columns of these names give way.

    All other columns come out as they were, whatever their names.
    """
    pages = pages.drop("text", "n_chars")
    rest_of = set_aside(pages.drop("html"), *OWN)[1]
    pages, _ = set_aside(pages, *OWN)
    columns = pages.columns
    parsed = stored(_parsed(pages), "parsed-pages")
    kept = [c for c in columns if c != "html"]
    whole = parsed.filter("_main is not null").select(*kept, F.col("_main").alias("text"))
    rest = parsed.filter("_main is null")
    cut = rest.join(_covered(parsed, run), "_uid", "left")
    schema = cut.select(*kept).schema.add("text", "string")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, starts = batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist()
            texts = [_spans_removed(w, s or [], run) for w, s in zip(words, starts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, "text"])

    unique = cut.select(*kept, "_open", "_starts").mapInArrow(remove, schema)
    texts = whole.union(unique).withColumn("text", F.coalesce("text", F.lit("")))
    return rest_of(texts, "text", F.length("text").cast("long").alias("n_chars"))
