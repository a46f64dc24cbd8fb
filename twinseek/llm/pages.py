"""Main text of HTML pages by differencing pages of near URLs.

Pages are parsed into text lines. What pairing needs of them, places and numbers of lines but no texts, is dealt out by
ranges of host and path and sorted, so that a page's nearest neighbours by path stand next to it. Each page is paired with
the one beside it, of the same host, whose path shares the longer beginning (of equal ones, that before it); pages with the
same lines are no partners. The lines of a pair are aligned by longest common subsequence and shared lines go.

Lines within an article or main element are spared, whoever shares them: copies of an article on one host would delete each
other. Where a page has such an element, lines outside it go too, and lines within navigation, headers, footers, asides,
forms, adverts, notices or comments, told by element, role or class, always go.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.llm.columns import chunks, give_back, xxh64
from twinseek.llm.shared import cut, new_path, table

# Elements of HTML, and words of classes and roles by which what is no main text is told.
RAW = "script style noscript template textarea title iframe svg object math".split()
BLOCKS = "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BOUNDARY = "nav header footer aside form dialog menu button select".split()
HINTS = "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr banner notice notices popup modal overlay newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments reply replies disqus share sharing social related recommended widget copyright login signup search toolbar pagination pager skip".split()
ROLES = "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split()
CONTENT = "article main".split()

TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>|</[^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
SPACE = re.compile(r"\s+")
RAW_, BLOCKS_, VOID_, BOUNDARY_, HINTS_, ROLES_, CONTENT_ = map(frozenset, (RAW, BLOCKS, VOID, BOUNDARY, HINTS, ROLES, CONTENT))


def unwanted(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is told as something else than main text. Headers and footers within an article are its own."""
    if name in BOUNDARY_ and not (inside and name in ("header",)):
        return True
    if "=" not in attributes or name in ("html", "body"):
        return False
    told = {k.lower(): html.unescape(v.strip("\"'")).lower() for k, v in ATTRIBUTE.findall(attributes)}
    if told.get("role") in ROLES_ or told.get("aria-hidden") == "true":
        return True
    words = set(re.split(r"[^a-z0-9]+", f"{told.get('class', '')} {told.get('id', '')}"))
    return not HINTS_.isdisjoint(words - ({"header"} if inside else set()))


def lines(page: str) -> list[tuple[str, bool, bool]]:
    """The text lines of a page: (text, within an article or main element, told as something else than main text)."""
    out: list[tuple[str, bool, bool]] = []
    open_: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    inside = bad = False

    def end() -> None:
        if parts:
            text = "".join(parts)
            text = SPACE.sub(" ", html.unescape(text) if "&" in text else text).strip()
            parts.clear()
            if text:
                out.append((text, inside, bad))

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name in RAW_ and not closing:
            if attributes.rstrip().endswith("/") and name in ("svg", "math"):
                continue
            found = re.compile(rf"</{name}\s*[^>]*>", re.I).search(page, at)
            at = found.end() if found else n
            if name == "title":
                end()
            continue
        if name in BLOCKS_:
            end()
        elif name == "br":
            parts.append(" ")
        if name in VOID_:
            continue
        if closing:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    end()
                    del open_[i:]
                    inside, bad = (open_[-1][1], open_[-1][2]) if open_ else (False, False)
                    break
            continue
        if name in BLOCKS_:
            while open_ and open_[-1][0] in ("p", "span", "a", "b", "i", "em", "strong", "small"):
                open_.pop()
            inside, bad = (open_[-1][1], open_[-1][2]) if open_ else (False, False)
        now = unwanted(name, attributes, inside)
        content = name in CONTENT_ or 'role="main"' in attributes or "role='main'" in attributes
        if content and not now and bad and open_ and all(not o[2] or o[0] in ("nav", "header") for o in open_):
            bad = False
        if now or content or name in BLOCKS_ and name not in ("p", "li", "td", "th", "tr", "dd", "dt", "option"):
            if now and name not in BLOCKS_:
                end()
            inside, bad = inside or (content and not now), bad or now
            open_.append((name, inside, bad))
    end()
    return out


def shared(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence of the two."""
    common = set(a) & set(b)
    if not common:
        return set()
    codes = {x: i for i, x in enumerate(common)}
    x, y = [i for i, t in enumerate(a) if t in codes], [i for i, t in enumerate(b) if t in codes]
    p, q = np.array([codes[a[i]] for i in x]), np.array([codes[b[i]] for i in y])
    return {x[i] for i in subsequence(p, q)}


def lengths(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of the longest common subsequences of p with all beginnings of q."""
    row = np.zeros(len(q) + 1, np.int32)
    for c in p:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (q == c)))
    return row


def subsequence(p: np.ndarray, q: np.ndarray) -> list[int]:
    """Places in p of a longest common subsequence, in space that grows with p and q, not with their product."""
    head = 0
    while head < min(len(p), len(q)) and p[head] == q[head]:
        head += 1
    tail = 0
    while tail < min(len(p), len(q)) - head and p[-1 - tail] == q[-1 - tail]:
        tail += 1
    found = list(range(head)) + list(range(len(p) - tail, len(p)))
    p, q = p[head : len(p) - tail], q[head : len(q) - tail]
    if not len(p) or not len(q):
        return found
    if len(p) == 1:
        return found + [head] * bool((q == p[0]).any())
    half = len(p) // 2
    cut = int(np.argmax(lengths(p[:half], q) + lengths(p[half:][::-1], q[::-1])[::-1]))
    return found + [head + i for i in subsequence(p[:half], q[:cut])] + [head + half + i for i in subsequence(p[half:], q[cut:])]


def line_hashes(pages: list[list[tuple[str, bool, bool]]]) -> list[np.ndarray]:
    """A number for each text line of each page."""
    texts = [t.encode() for page in pages for t, _, _ in page]
    at = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))
    found = xxh64(np.frombuffer(b"".join(texts), np.uint8), at[:-1], np.diff(at)).view(np.int64)
    return np.split(found, np.cumsum([len(page) for page in pages])[:-1])


def beginning(a: str, b: str) -> int:
    """Characters that two paths have in common at their beginning."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


class Page(NamedTuple):
    """What pairing needs of a page: its place, its lines as numbers, and which of them are told as something else."""

    host: str
    path: str
    digest: bytes
    hashes: np.ndarray
    bad: np.ndarray
    asks: bool


def gone(page: Page, before: Page | None, after: Page | None) -> list[int] | None:
    """Of a page's lines that are not told as something else, the numbers of those that it shares with its partner: of the
    two beside it, of its host, the one whose path shares the longer beginning, of equal ones that before it. None: no partner."""
    near = [(beginning(x.path, page.path), -k, x) for k, x in enumerate((before, after)) if x is not None and x.host == page.host]
    if not near:
        return None
    lost = shared(page.hashes.tolist(), max(near, key=lambda x: x[:2])[2].hashes.tolist())
    return [i for i, at in enumerate(np.flatnonzero(~page.bad)) if at in lost]


def paired(rows: Iterator[Page], before: list[Page], after: list[Page]) -> Iterator[tuple[Page, Page | None, Page | None]]:
    """Each distinct page that asks, with the nearest pages before and after it whose lines are not its own. Rows are in
    order; `before` and `after` are up to two pages with different lines around them, the nearest first."""
    recent, run = list(before), []

    def told(upto: list[Page]) -> Iterator[tuple[Page, Page | None, Page | None]]:
        last = None
        for page in run:
            if page.asks and (page.host, page.path) != last:
                last = page.host, page.path
                yield page, next((x for x in recent if x.digest != page.digest), None), next((x for x in upto if x.digest != page.digest), None)

    for page in rows:
        if run and page.digest != run[0].digest:
            yield from told([page])
            recent, run = [run[-1]] + [x for x in recent if x.digest != run[-1].digest][:1], []
        # Copies are told apart by their places only, so a long run of them holds its lines once.
        run.append(page._replace(hashes=run[0].hashes, bad=run[0].bad) if run else page)
    yield from told(after)


def ends(rows: Iterator[Page]) -> tuple[list[Page], list[Page]]:
    """(the first page and the next with other lines, the last page and the one before it with other lines)."""
    first, last = [], []
    for page in rows:
        if not first or len(first) == 1 and page.digest != first[0].digest:
            first.append(page)
        last = [page] + ([x for x in last if x.digest != page.digest][:1])
    return first, last


def around(found: dict[int, tuple[list[Page], list[Page]]]) -> dict[int, tuple[list[Page], list[Page]]]:
    """For each partition that has pages the two nearest pages with different lines before and after it."""
    out: dict[int, tuple[list[Page], list[Page]]] = {k: ([], []) for k in found}
    for way, side in ((sorted(found), 1), (sorted(found, reverse=True), 0)):
        near: list[Page] = []
        for k in way:
            out[k][1 - side].extend(near)
            for page in reversed(found[k][side]):
                near = [page] + [x for x in near if x.digest != page.digest][:1]
    return out


PLACE = "host string, path string, digest binary, hashes array<long>, bad array<boolean>, asks boolean"


def pages_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Page]:
    for batch in batches:
        host, path, digest, asks = (batch.column(k).to_pylist() for k in ("host", "path", "digest", "asks"))
        hashes, bad = batch.column("hashes"), batch.column("bad")
        for i in range(batch.num_rows):
            yield Page(host[i], path[i], digest[i], hashes[i].values.to_numpy(), bad[i].values.to_numpy(zero_copy_only=False).astype(bool), asks[i])


def record(pages: list[Page], **more) -> pa.RecordBatch:
    columns = {"host": pa.array([x.host for x in pages], pa.string()), "path": pa.array([x.path for x in pages], pa.string()), "digest": pa.array([x.digest for x in pages], pa.binary())}
    return pa.record_batch(columns | more)


def difference(places: DataFrame) -> DataFrame:
    """(host, path, digest, gone) of the pages of `places` (PLACE) that ask and have a partner.

    Pages are sorted by host and path in ranges, so a host may be as large as it likes. Four pages at each range's ends go to
    the driver and from there to the next ranges: a page's partner does not depend on where ranges end.
    """
    spark = places.sparkSession
    rows = cut(places.repartitionByRange("host", "path", "digest").sortWithinPartitions("host", "path", "digest"), spark)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, last = ends(pages_of(batches))
        both = [(0, k, x) for k, x in enumerate(first)] + [(1, k, x) for k, x in enumerate(last)]
        if both:
            numbers = {"task": pa.array(np.full(len(both), TaskContext.get().partitionId())), "side": pa.array([s for s, _, _ in both]), "rank": pa.array([k for _, k, _ in both])}
            lists = {"hashes": pa.array([x.hashes for _, _, x in both], pa.list_(pa.int64())), "bad": pa.array([x.bad for _, _, x in both], pa.list_(pa.bool_())), "asks": pa.array([x.asks for _, _, x in both])}
            yield record([x for _, _, x in both], **lists, **numbers)

    found: dict[int, tuple[list[Page], list[Page]]] = {}
    told = rows.mapInArrow(edges, PLACE + ", task long, side long, rank long").toArrow().sort_by([("task", "ascending"), ("side", "ascending"), ("rank", "ascending")])
    for task, side, page in zip(told.column("task").to_pylist(), told.column("side").to_pylist(), pages_of(told.to_batches())):
        found.setdefault(task, ([], []))[side].append(page)
    beside = spark.sparkContext.broadcast({k: tuple([tuple(x) for x in side] for side in both) for k, both in around(found).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        some: list[tuple[Page, list[int]]] = []
        before, after = ([Page(*x) for x in side] for side in beside.value.get(TaskContext.get().partitionId(), ([], [])))
        for page, x, y in paired(pages_of(batches), before, after):
            lost = gone(page, x, y)
            if lost is not None:
                some.append((page, lost))
            if len(some) >= 1000:
                yield record([x for x, _ in some], gone=pa.array([x for _, x in some], pa.list_(pa.int32())))
                some = []
        if some:
            yield record([x for x, _ in some], gone=pa.array([x for _, x in some], pa.list_(pa.int32())))
        give_back()

    return rows.mapInArrow(run, "host string, path string, digest binary, gone array<int>")


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, PLACE) of every row: the lines that may stay, joined by an empty line. A page asks for a partner
    if it has no article or main element."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    kind = "string" if dict(pages.dtypes)["page_id"] == "string" else "bigint"
    rows = pages.select(
        F.col("page_id").cast(kind).alias("page_id"), F.col("url").cast("string").alias("url"), F.lower(F.regexp_extract(url, "^[^:/?#]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, "^[^:/?#]*://[^/?#]*([^?#]*)", 1).alias("path"), F.col("html").cast("string").alias("html"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "html", 1 << 20):
            found = [lines(page.decode("utf-8", "replace")) for page in part.column("html").to_pylist()]
            article = [any(inside and not off for _, inside, off in page) for page in found]
            texts = ["\n\n".join([t for t, inside, off in page if not off and (inside or not has)]) for page, has in zip(found, article)]
            hashes = line_hashes(found)
            digests = [hashlib.blake2b(own.tobytes(), digest_size=16).digest() for own in hashes]
            bad = [[off for _, _, off in page] for page in found]
            asks = [not has and bool(text) for has, text in zip(article, texts)]
            lists = {"hashes": pa.array(hashes, pa.list_(pa.int64())), "bad": pa.array(bad, pa.list_(pa.bool_()))}
            yield pa.record_batch({k: part.column(k) for k in ("page_id", "url", "host", "path")} | {"text": pa.array(texts, pa.string()), "digest": pa.array(digests, pa.binary())} | lists | {"asks": pa.array(asks)})

    return rows.mapInArrow(run, f"page_id {kind}, url string, host string, path string, text string, digest binary, hashes array<long>, bad array<boolean>, asks boolean")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Null pages count as empty and have an empty text. Null URLs, and those without a host, form a host of their own. A page
    whose host has no other page with other lines has no partner and keeps its lines. Repeated rows, and pages with the same
    lines, are no partners of each other. Other columns are ignored; an empty table gives none.
    """
    spark, path = pages.sparkSession, new_path(pages.sparkSession, "pages")
    parsed(pages).write.parquet(path)
    rows = spark.read.parquet(path)
    lost = difference(rows.select("host", "path", "digest", "hashes", "bad", "asks"))
    asking = rows.filter("asks").select("page_id", "url", "text", "host", "path", "digest").join(lost, ["host", "path", "digest"], "left")
    kept = F.filter(F.split("text", "\n\n"), lambda _, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i))
    texts = rows.filter("not asks").select("page_id", "url", "text").unionByName(asking.select("page_id", "url", F.array_join(kept, "\n\n").alias("text")))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
