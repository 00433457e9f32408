"""Main text of web pages: markup rules first, then differencing against the page with the nearest URL.

A page is read into lines (its text blocks in order).  Pages of a host are ordered by URL path.  Runs of
neighbours that are copies or versions of one text are passed over: each page is paired with the nearest
page before or after its run whose path agrees longest, and lines that the two share in a longest common
subsequence are what the site repeats.  They are deleted inside marked content (article, main) as well.

Scale: pages are paired as slim rows dealt by range of (host, path), so a host with a third of all pages
is spread over many tasks and only two rows per partition meet in one place, however long a run of copies
is.  Alignment moves line hashes; page sources are shuffled once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelore.runtime import checkpointed

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary "
    "table tbody tfoot thead tr ul".split()
)
CONTENT = frozenset(["article", "main"])
SKIPPED = frozenset(
    "aside audio button canvas datalist dialog embed footer form head iframe menu nav noscript object script select "
    "style svg template textarea title video".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that another block ends although they are not closed.
OPEN_ENDED = frozenset(["p", "li", "dt", "dd", "option"])
PART_NAMES = frozenset(
    "ad adbox ads adsense advert advertisement advertising alert banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices "
    "notification pagination popup promo promotion recommended related respond responses share sharing sidebar "
    "social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
_BLANK = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")
INSIDE, OUTSIDE, SKIP = 0, 1, 2
#: Two pages are copies when one shares so much of its text, or when both mark their content and share `VERSION`.
COPY, VERSION = 0.9, 0.5


class Reader(HTMLParser):
    """Lines of a page as (text, place): inside marked content, outside of it, or in a part to skip."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int]] = []
        self.buffer: list[str] = []
        self.skip: str | None = None
        self.depth = 0
        self.content = 0

    def flush(self) -> None:
        if self.buffer:
            text = _BLANK.sub(" ", "".join(self.buffer)).strip()
            self.buffer = []
            if text:
                place = SKIP if self.skip else INSIDE if self.content else OUTSIDE
                self.lines.append((text, place))

    def _is_part(self, tag: str, attrs: dict[str, str | None]) -> bool:
        if tag in SKIPPED or (tag == "header" and not self.content):
            return True
        if tag in ("html", "body", *CONTENT):
            return False
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role") in ROLES:
            return True
        if re.search(r"display\s*:\s*none", attrs.get("style") or ""):
            return True
        names = _NAME.findall(f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower())
        return not PART_NAMES.isdisjoint(names)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS or tag in SKIPPED:
            self.flush()
        if tag in ("br", "td", "th"):
            self.buffer.append(" ")
        if self.skip and (tag in CONTENT or (self.skip in OPEN_ENDED and tag in BLOCKS)):
            self.skip = None  # a part that was never closed
        if tag in CONTENT:
            self.content += 1
        elif self.skip:
            self.depth += tag == self.skip
        elif tag not in VOID and self._is_part(tag, dict(attrs)):
            self.skip, self.depth = tag, 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag not in SKIPPED:
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in SKIPPED:
            self.flush()
        if tag in CONTENT:
            self.content = max(0, self.content - 1)
            self.skip = None
        elif self.skip == tag:
            self.depth -= 1
            if self.depth <= 0:
                self.skip = None

    def handle_data(self, data: str) -> None:
        self.buffer.append(data)


def lines_of(html: str | None) -> list[tuple[str, int]]:
    """All lines of a page with their places; a tag that the page's end cuts off is dropped."""
    html = html or ""
    last = html.rfind("<")
    if last >= 0 and ">" not in html[last:] and html[last + 1 : last + 2].isalpha() | (html[last + 1 : last + 2] in "/!"):
        html = html[:last]
    reader = Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.lines


def line_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in `a` of a longest common subsequence of both; lines of one page only are left out first.

    Rows of the table are the bits of one integer each.
    """
    other = set(b)
    left = [i for i, x in enumerate(a) if x in other]
    own = {a[i] for i in left}
    right = [x for x in b if x in own]
    places: dict[int, int] = {}
    for j, x in enumerate(right):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(right)) - 1
    row, rows = full, []
    for i in left:
        hit = row & places[a[i]]
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    found, i, j = [], len(left) - 1, len(right) - 1
    while i >= 0 and j >= 0:
        if a[left[i]] == right[j]:
            found.append(left[i])
            i, j = i - 1, j - 1
        elif rows[i] >> j & 1:
            j -= 1
        else:
            i -= 1
    return found[::-1]


class Lines:
    """Hashes of a page's lines, with place and size of each in one number (size * 4 + place)."""

    def __init__(self, hashes: list[int], marks: list[int]) -> None:
        self.hashes, self.marks = list(hashes), list(marks)
        self.marked = any(m % 4 == INSIDE for m in self.marks)

    def shared(self, other: Lines) -> list[int]:
        """Positions of the lines shared with `other`; marked content never meets the other's menus and lists."""
        mine = [i for i, m in enumerate(self.marks) if not self.marked or m % 4 == INSIDE]
        theirs = [x for x, m in zip(other.hashes, other.marks, strict=True) if not self.marked or m % 4 != SKIP]
        return [mine[i] for i in common_lines([self.hashes[i] for i in mine], theirs)]

    def share(self, shared: list[int]) -> float:
        """Part of the page's text that lies in `shared`, by characters."""
        body = INSIDE if self.marked else OUTSIDE
        size = [m // 4 if m % 4 == body else 0 for m in self.marks]
        return sum(size[i] for i in shared) / max(sum(size), 1)


def copies(a: Lines, b: Lines) -> bool:
    """Whether both hold one text: deleting what they share would erase it."""
    low, high = sorted((a.share(a.shared(b)), b.share(b.shared(a))))
    return high >= COPY or (a.marked and b.marked and low >= VERSION)


def main_text(lines: list[tuple[str, int]], shared: set[int]) -> str:
    """The lines of marked content where there is some, else those outside the parts of the frame; shared ones go."""
    body = INSIDE if any(place == INSIDE for _, place in lines) else OUTSIDE
    return "\n".join(text for k, (text, place) in enumerate(lines) if place == body and k not in shared)


def _neighbours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each row with the one before and after it in its partition; the first and last row are marked."""
    parts = list(frames)
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True).astype({"k": "Int64"})  # shifted keys stay whole numbers
    for name in ("host", "path", "k"):
        rows[f"prev_{name}"] = rows[name].shift(1)
        rows[f"next_{name}"] = rows[name].shift(-1)
    rows["edge"] = False
    rows.loc[[0, len(rows) - 1], "edge"] = True
    yield rows


def _beyond_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the row before and after its run of copies; runs that the partition's ends cut are open."""
    parts = list(batches)
    rows = pa.Table.from_batches(parts) if parts else None
    if rows is None or not rows.num_rows:
        return
    n, at = rows.num_rows, np.arange(rows.num_rows)
    first = np.maximum.accumulate(np.where(rows["joins_prev"].to_numpy(), -1, at))
    last = np.minimum.accumulate(np.where(rows["joins_next"].to_numpy(), n, at)[::-1])[::-1]
    begins, ends = (pa.array(x, pa.int64(), mask=(x < 0) | (x == n)) for x in (first, last))
    columns = {name: rows[name] for name in ("path", "k")}
    columns |= {name: rows[name].take(begins) for name in ("prev_path", "prev_k")}
    columns |= {name: rows[name].take(ends) for name in ("next_path", "next_k")}
    columns |= {"part": pa.array(np.full(n, TaskContext.get().partitionId()), pa.int32())}
    columns |= {"open_prev": pa.array(first < 0), "open_next": pa.array(last == n)}
    columns |= {"lowest": pa.array(at == 0), "highest": pa.array(at == n - 1)}
    yield from pa.table(columns).combine_chunks().to_batches()


def _past_copies(near: DataFrame, alike: DataFrame) -> DataFrame:
    """`near` with the neighbours before and after each run of copies; `alike` has the neighbours (k, partner before) that are."""
    joins = (
        alike.select("k", F.lit(True).alias("p"), F.lit(False).alias("n"))
        .unionByName(alike.select(F.col("partner").alias("k"), F.lit(False).alias("p"), F.lit(True).alias("n")))
        .groupBy("k")
        .agg(F.max("p").alias("joins_prev"), F.max("n").alias("joins_next"))
    )
    flags = near.join(joins, "k", "left")
    flags = flags.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("joins_prev", "joins_next")})
    ranged = flags.repartitionByRange("host", "path", "k").sortWithinPartitions("host", "path", "k")
    schema = (
        "path string, k long, prev_path string, prev_k long, next_path string, next_k long, part int,"
        " open_prev boolean, open_next boolean, lowest boolean, highest boolean"
    )
    found = checkpointed(ranged.mapInArrow(_beyond_runs, schema))
    # one row a partition meets here: what holds at the ends of the others
    order = W.orderBy("part")
    before = F.last(F.when(~F.col("open_prev"), F.struct("prev_path", "prev_k")), True)
    after = F.first(F.when(~F.col("open_next"), F.struct("next_path", "next_k")), True)
    ends = (
        found.where("highest").select("part", before.over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_b"))
        .join(found.where("lowest").select("part", after.over(order.rowsBetween(1, W.unboundedFollowing)).alias("_a")), "part")
    )
    carried = found.join(F.broadcast(ends), "part", "left")
    side = lambda c, end, at: F.when(F.col(end), F.col(f"{at}.{c}")).otherwise(F.col(c)).alias(c)
    return carried.select(
        "path", "k",
        *[side(c, "open_prev", "_b") for c in ("prev_path", "prev_k")],
        *[side(c, "open_next", "_a") for c in ("next_path", "next_k")],
    )


def nearest_pairs(pages: DataFrame, alike: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(k, partner) for pages (k, url): the neighbour by path on the same host whose path agrees longest.

    Pages alone on their host and rows without a URL have no partner.  Ties go to the page before.
    `alike` takes neighbours (k, partner) and returns those that are copies; they are passed over.
    """
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    slim = pages.where(F.col("url").isNotNull()).select(host.alias("host"), path.alias("path"), "k")
    schema = (
        "host string, path string, k long, prev_host string, next_host string, prev_path string, next_path string,"
        " prev_k long, next_k long, edge boolean"
    )
    ranged = slim.repartitionByRange("host", "path", "k").sortWithinPartitions("host", "path", "k")
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    near = checkpointed(ranged.mapInPandas(lambda it: (f[names] for f in _neighbours(it)), schema))
    # two rows a partition meet here: the neighbours across the borders
    order = W.orderBy("host", "path", "k")
    edges = near.where("edge").select(
        *[c for c in ("host", "path", "k")],
        *[F.coalesce(F.col(f"prev_{c}"), F.lag(c).over(order)).alias(f"prev_{c}") for c in ("host", "path", "k")],
        *[F.coalesce(F.col(f"next_{c}"), F.lead(c).over(order)).alias(f"next_{c}") for c in ("host", "path", "k")],
    )
    both = near.where(~F.col("edge")).drop("edge").unionByName(edges)

    same = lambda side: F.col(f"{side}_host") == F.col("host")
    both = both.select(
        "host", "path", "k",
        *[F.when(same(side), F.col(f"{side}_{c}")).alias(f"{side}_{c}") for side in ("prev", "next") for c in ("path", "k")],
    )
    if alike is not None:
        both = checkpointed(both)
        both = _past_copies(both, alike(both.where("prev_k IS NOT NULL").select("k", F.col("prev_k").alias("partner"))))

    def agreement(a: str, b: str) -> F.Column:
        x, y = F.split(F.col(a), ""), F.split(F.col(b), "")
        equal = F.transform(x, lambda c, i: c == F.get(y, i))
        upto = F.array_position(equal, False)
        return F.when(upto > 0, upto - 1).otherwise(F.least(F.size(x), F.size(y)))

    before = F.when(F.col("prev_k").isNotNull(), agreement("path", "prev_path"))
    after = F.when(F.col("next_k").isNotNull(), agreement("path", "next_path"))
    partner = (
        F.when(F.coalesce(before, F.lit(-1)) >= F.coalesce(after, F.lit(-1)), F.col("prev_k")).otherwise(F.col("next_k"))
    )
    return both.select("k", partner.alias("partner")).where(F.col("partner").isNotNull())


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add text (the main text, empty if none) and n_chars to pages with url and html.

    All input columns and repeated rows stay; columns text and n_chars are replaced.  NULL and empty
    sources give an empty text; pages without a URL are read without a partner.
    """
    # equal rows share a key; a page is found again by it
    keyed = pages.drop("text", "n_chars").withColumn("_k", F.xxhash64("page_id", "url", html))

    def hashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            read = [lines_of(v) for v in frame["html"]]
            found = [[line_hash(t) for t, _ in lines] for lines in read]
            marks = [[len(t) * 4 + place for t, place in lines] for lines in read]
            yield pd.DataFrame({"k": frame["_k"], "url": frame["url"], "lines": found, "marks": marks})

    slim = keyed.select("_k", "url", F.col(html).alias("html")).mapInPandas(
        hashes, "k long, url string, lines array<long>, marks array<int>"
    )
    known = checkpointed(slim).groupBy("k").agg(*[F.first(c).alias(c) for c in ("url", "lines", "marks")])

    def facing(pairs: DataFrame) -> DataFrame:
        others = known.select(F.col("k").alias("partner"), F.col("lines").alias("others"), F.col("marks").alias("o_marks"))
        return pairs.join(known.select("k", "lines", "marks"), "k").join(others, "partner")

    def both_of(frame: pd.DataFrame) -> list[tuple[Lines, Lines]]:
        columns = [frame[c] for c in ("lines", "marks", "others", "o_marks")]
        return [(Lines(a, m), Lines(b, o)) for a, m, b, o in zip(*columns, strict=True)]

    def equal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.loc[np.array([copies(a, b) for a, b in both_of(frame)], dtype=bool), ["k", "partner"]]

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # at the ends of a run that changes step by step the pages beyond can still hold the same text
            shared = [[] if copies(a, b) else a.shared(b) for a, b in both_of(frame)]
            yield pd.DataFrame({"_s": frame["k"], "shared": shared})

    pairs = nearest_pairs(known.select("k", "url"), lambda near: checkpointed(facing(near).mapInPandas(equal, "k long, partner long")))
    shared = facing(pairs).mapInPandas(align, "_s long, shared array<int>").where(F.size("shared") > 0)
    joined = keyed.join(shared, keyed["_k"] == shared["_s"], "left").drop("_s", "_k")
    kept = [f for f in joined.schema.fields if f.name != "shared"]
    names = [f.name for f in kept]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [
                main_text(lines_of(v), set() if s is None else set(np.asarray(s).tolist()))
                for v, s in zip(frame[html], frame["shared"], strict=True)
            ]
            yield frame[names].assign(text=texts, n_chars=np.array([len(t) for t in texts], dtype=np.int64))

    return joined.mapInPandas(
        read, T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    )
