"""Main text of web pages by nearest-URL page differencing.

A page is cut into block lines; every line knows whether it stands in a region that is never main text (navigation,
footers, forms, adverts, comments ...), inside the page's article, or neither. Pages are put in the order of host and
URL path; a page's nearest pages are its neighbours of the same host in that order. Lines of the two are aligned by
longest common subsequence, and shared lines outside the article are deleted: what neighbouring pages share is the
site's, what they don't is the page's. Lines inside an article element are the page's own by its own word, also where
a copy of the article stands next to it, so differencing leaves them. Copies are no neighbours: the nearest page that
shares less than COPY of the text is.

Neighbours are found without a window over a host: the URLs alone are sorted, every so many of them a run begins, and
the pages are dealt to runs by bisection; the pages at a run's ends also go to the run beside it. So a host of any
size is spread over tasks, a page is shuffled once, and a task holds three pages at a time, and of a group of copies
the pages that wait for one that differs (those of equal html share their lines). Copies up to a run's end have no
neighbour on that side.

Defined results: a null or empty html has the empty text; a null url is of the empty host and path; pages with equal
URLs stand in the order of page_id; repeated rows are pages of their own and copies of each other; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, small_batches

#: Pages of a run, at least, and runs, at most (the driver holds the ends of each); runs of a task, about.
RUN_PAGES, MOST_RUNS, TASK_RUNS = 512, 200_000, 2
#: Pages that share this part of either's text are copies of each other.
COPY = 0.9

# Element names by what they do to text.
SKIP = frozenset("script style noscript template iframe svg math canvas object select textarea button form nav footer aside menu dialog audio video head".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea title".split())
#: Parts of class names, ids and roles of regions that aren't main text: words that say so wherever they stand, words that
#: say so beside words of layout only (a site-header, but not a post-header), and those words of layout.
SURE = frozenset(
    "advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer footnav gdpr masthead "
    "menubar nav navbar navigation newsletter popup promo promoted recommended sidebar signup sponsor sponsored subscribe subscription toolbar topbar contentinfo".split())
UNSURE = frozenset("ad ads banner header menu modal notice notices related share sharing social widget complementary".split())
LAYOUT = frozenset(
    "area articles bar block body bottom box button buttons center column container content fixed global group head icons inner item items left line link links "
    "list main mobile outer page pages panel posts primary right row secondary section site slot sticky stories sub top unit wide wrap wrapper".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_NAMED = re.compile(r"(?:^|\s)(class|id|role|aria-label|hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
#: Elements that end when one like them begins, up to the container named.
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header main nav ol section table td th ul".split())

Line = tuple[str, bool, bool]


def boiler_name(name: str, whole: bool) -> bool:
    """Whether a class, id or role names a region that isn't main text; if whole, only a word alone does."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if whole or len(words) == 1:
        return name.lower() in SURE or name.lower() in UNSURE
    return any(w in SURE for w in words) or (any(w in UNSURE for w in words) and all(w in UNSURE or w in LAYOUT for w in words))


def boiler_attributes(attributes: str, whole: bool = False) -> bool:
    for name, a, b, c in _NAMED.findall(attributes):
        if name.lower() == "hidden":
            return True
        if name.lower() != "aria-label" and any(boiler_name(w, whole) for w in (a or b or c).split()):
            return True
    return False


class Open:
    """The elements that are open, with the places of each name's and of containers at hand."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool]] = []  # element, article, skipped
        self.places: dict[str, list[int]] = {}
        self.containers: list[int] = []

    def push(self, tag: str, article: bool, skipped: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in CONTAINERS:
            self.containers.append(len(self.stack))
        self.stack.append((tag, article, skipped))

    def cut(self, i: int) -> None:
        """Closes the elements from place i on."""
        for tag, *_ in reversed(self.stack[i:]):
            self.places[tag].pop()
            if tag in CONTAINERS:
                self.containers.pop()
        del self.stack[i:]

    def last(self, tags: tuple[str, ...]) -> int:
        """The place of the last open element of these, -1 if there is none inside the last container."""
        i = max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)
        return i if not self.containers or i >= self.containers[-1] else -1


def lines(page: str) -> list[Line]:
    """The page's block lines in order: (text, inside an article or main element, in a region that isn't main text)."""
    out: list[Line] = []
    opened = Open()
    stack = opened.stack
    buffer: list[str] = []
    at = 0

    def state() -> tuple[bool, bool]:
        return (stack[-1][1], stack[-1][2]) if stack else (False, False)

    def flush() -> None:
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            out.append((text, *state()))

    def leave(i: int) -> None:
        if any(e[0] in BLOCK or e[2] for e in stack[i:]):
            flush()
        opened.cut(i)

    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            buffer.append(page[at:])
            break
        buffer.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            own = opened.places.get(tag)
            if own and (tag in CONTAINERS or not opened.containers or opened.containers[-1] < own[-1]):
                leave(own[-1])
            continue
        if tag == "br":
            buffer.append(" ")
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            end = _END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BLOCK or tag in SKIP:
            flush()
            if tag in CLOSES or tag in CONTAINERS:
                if (k := opened.last(CLOSES.get(tag, ("p",)))) >= 0:
                    opened.cut(k)
        article, skipped = state()
        boiler = tag in SKIP or (tag == "header" and not article) or (tag in BLOCK and tag not in ("body", "html", "main") and boiler_attributes(m[3], tag == "article"))
        if not (m[3].endswith("/") and tag not in BLOCK):
            opened.push(tag, article or tag in ("article", "main"), skipped or boiler)
    flush()
    return out


def shared_lines(mine: list[str], other: list[str]) -> set[int]:
    """Indices in mine of a longest common subsequence with other."""
    start = 0
    while start < min(len(mine), len(other)) and mine[start] == other[start]:
        start += 1
    end = 0
    while end < min(len(mine), len(other)) - start and mine[-1 - end] == other[-1 - end]:
        end += 1
    found = {*range(start), *range(len(mine) - end, len(mine))}
    a, b = mine[start : len(mine) - end], other[start : len(other) - end]
    common = set(a) & set(b)
    rows = [i for i, x in enumerate(a) if x in common]
    b = [x for x in b if x in common]
    return found | {start + rows[i] for i, _ in common_subsequence([a[i] for i in rows], b)}


def common_subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The pairs (i, j) of a longest common subsequence, the last first.

    Row by row as bits (0 where a row's length grows); every so many rows are kept and the rest made again, so that
    memory follows the root of the number of rows.
    """
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full, step, out = (1 << len(b)) - 1, math.isqrt(len(a)) + 1, []

    def rows(first: int, last: int, row: int) -> Iterator[int]:
        for x in a[first:last]:
            if shared := row & places.get(x, 0):
                row = ((row + shared) | (row - shared)) & full
            yield row

    kept = [full]
    for i, row in enumerate(rows(0, len(a), full), 1):
        if i % step == 0:
            kept.append(row)
    i, j, base, block = len(a), len(b), len(a) + 1, [full]
    while i and j:
        if i <= base or i - base >= len(block):
            base = (i - 1) // step * step
            block = [kept[base // step], *rows(base, min(base + step, len(a)), kept[base // step])]
        if block[i - base] >> (j - 1) & 1:
            j -= 1
        elif block[i - 1 - base] >> (j - 1) & 1:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        else:
            i -= 1
    return out


def copies(page: list[Line], other: list[Line]) -> bool:
    """Whether the two have nearly all of their text in common, so that what they share isn't the site's."""
    a, b = ([x[0] for x in lines if not x[2]] for lines in (page, other))
    if a == b:
        return True
    size = [sum(map(len, x)) for x in (a, b)]
    return 0 < COPY * max(size) <= min(size) and sum(len(a[i]) for i in shared_lines(a, b)) >= COPY * max(size)


def main_text(page: list[Line], neighbours: list[list[Line]]) -> str:
    """What is left of the page's lines: those of its articles, and of the others those that no neighbour shares."""
    candidates = [x for x in page if not x[2]]
    gone: set[int] = set()
    for other in neighbours:
        gone |= shared_lines([x[0] for x in candidates], [x[0] for x in other if not x[2]])
    return "\n".join(x[0] for i, x in enumerate(candidates) if x[1] or i not in gone)


def host_and_path(url):
    """The host without its scheme and port, and the path without query, fragment and ending; as sortable columns."""
    rest = F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), r"(?:/|\.html?)$", "")
    return host, path


def _key(host: str, path: str, url: str | None, page_id: int | None) -> tuple:
    """As Spark sorts: nulls first, strings by code points."""
    return (host, path, url is not None, url or "", page_id is not None, page_id or 0)


def run_ends(keys: DataFrame, size: int) -> list[tuple[tuple, tuple]]:
    """(first key, last key) of every run of ``size`` pages or fewer, in order; keys: host, path, url, page_id."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, first, last, out = TaskContext.get().partitionId(), 0, None, None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if n % size == 0:
                    if first:
                        out.append((part, *first, *last))
                    first = row
                last, n = row, n + 1
        if first:
            out.append((part, *first, *last))
        if out:
            kinds = (pa.int64(), *(pa.string(), pa.string(), pa.string(), pa.int64()) * 2)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = ["part", *(f"{c}{k}" for k in (0, 1) for c in ("host", "path", "url", "page_id"))]
    order = ["host", "path", "url", "page_id"]
    found = keys.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(ends, "part long, " + ", ".join(f"host{k} string, path{k} string, url{k} string, page_id{k} long" for k in (0, 1))).collect()  # a row a run
    out = [(_key(*r[1:5]), _key(*r[5:9])) for r in found]
    return sorted(out)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    small_batches(spark)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"), path.alias("path"))
    ends = run_ends(rows, max(RUN_PAGES, -(-pages.count() // MOST_RUNS)))
    shared = spark.sparkContext.broadcast(ends)  # MOST_RUNS rows and one a partition, about
    tasks = max(1, len(ends) // TASK_RUNS)

    def deal(b: pa.RecordBatch) -> pa.RecordBatch:
        firsts, lasts = [x[0] for x in shared.value], [x[1] for x in shared.value]
        take, to, own = [], [], []
        for i, row in enumerate(zip(*(b.column(c).to_pylist() for c in ("host", "path", "url", "page_id")), strict=True)):
            key = _key(*row)
            p = max(0, bisect_right(firsts, key) - 1)
            beside = [p - 1] * (p > 0 and key == firsts[p]) + [p + 1] * (p + 1 < len(firsts) and key == lasts[p])
            take += [i] * (1 + len(beside))
            to += [p, *beside]
            own += [True] + [False] * len(beside)
        b = b.take(pa.array(take, pa.int64()))
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(to, pa.int64()), pa.array(own, pa.bool_())], [*b.schema.names, "run", "own"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come run by run in order; the pages that no later page has differed from wait."""
        before, waiting = None, []

        def settled(after: tuple | None) -> Iterator[tuple]:
            near = [x[5] for x in (before, after) if x and x[0] == waiting[0][0] and x[4] == waiting[0][4]]
            texts: dict[int, str] = {}
            for page in waiting:
                if page[1]:
                    if id(page[5]) not in texts:
                        texts[id(page[5])] = main_text(page[5], [x for x in near if len(waiting) == 1 or not copies(page[5], x)])
                    yield page[2], page[3], texts[id(page[5])]

        for b in batches:
            out = []
            for run, own, page_id, url, host, html in zip(*(b.column(c).to_pylist() for c in ("run", "own", "page_id", "url", "host", "html")), strict=True):
                last = waiting[-1] if waiting else None
                same = last and last[6] == html
                page = (run, own, page_id, url, host, last[5] if same else lines(html) if html else [], html)
                if last and not (last[0] == run and last[4] == host and (same or copies(waiting[0][5], page[5]))):
                    out += settled(page)
                    before, waiting = waiting[0], []
                waiting.append(page)
            if out:
                yield _texts(out)
        if waiting and (out := list(settled(None))):
            yield _texts(out)

    dealt = by_batch(rows, deal, "page_id long, url string, html string, host string, path string, run long, own boolean")
    dealt = dealt.repartition(tasks, "run").sortWithinPartitions("run", "host", "path", "url", "page_id", "html")
    return dealt.select("run", "own", "page_id", "url", "host", "html").mapInArrow(compare, "page_id long, url string, text string, n_chars long")


def _texts(out: list[tuple]) -> pa.RecordBatch:
    ids, urls, found = zip(*out, strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])
