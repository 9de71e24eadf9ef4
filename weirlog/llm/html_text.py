"""Main text of web pages: markup, then nearest-URL page differencing.

A page becomes lines of text, one a block element, in page order, with character references decoded and
white space inside a line as one space; a line also ends at br. Scripts, styles, menus, headers, footers, sidebars,
notices, adverts, forms and reader comments go by their elements, roles and class names. An element ends at its own
closing tag or at that of an element around it; what it holds goes with it, articles of comments and teasers
included. Of an element that is never closed an article or main element still counts. A class name counts if all its
words are known for such parts, so `cookie-notice` does and `has-sidebar` does not. Scripts, styles and text areas
without a closing tag run to the end of the page, as in HTML; other elements without text of the page are empty if
they are not closed.

The lines of article and main elements are the page's article; the other lines are open. Every page is compared with
the page of the nearest URL on the same host (the longest common path, then the smaller path) that has other content:
lines are aligned by longest common subsequence and the shared open lines are deleted, since a site repeats its
furniture and not its articles. If the article then holds at least as much as the open lines that are left, it is the
text; otherwise both are, in page order (small articles beside a body, or no article at all). Lines of an article are
not deleted, for passages repeat in articles; nor is anything by a neighbour that shares at least `copy` of the page,
which is a copy of it: then the neighbour on the other side counts, if that is none.

Pages are sorted by host and path over ranges that a sample of the URLs gives, so pages are parsed once and a host of
any size spreads over many tasks. Each task compares runs of pages of equal content as they stream by. The first
and last run of each range wait for content that may lie ranges away: its place is found from one hash a run, and
fetched by a join. A sequence of tasks never meets in one task.

Null and empty pages have empty text. Pages without a URL share the empty host. Repeated rows are pages of
their own. An empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Elements whose content is no markup, elements without text of the page, elements around it, elements that end a line.
RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|iframe)\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))", re.S | re.I)
EMPTY = {"noscript", "template", "svg", "title", "select", "button"}
AROUND = {"nav", "footer", "aside", "form", "dialog", "menu", "head"}
BLOCKS = set("address article aside blockquote body br center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: Words of class names and ids that tell such parts of a page, words that may stand beside them, and whole names.
TELLING = set("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts sidebar sidebars menu menus nav navs navbar navigation navmenu breadcrumb breadcrumbs footer footers masthead topbar comment comments commentlist disqus replies respond share sharing social newsletter subscribe signup login popup modal overlay toolbar pagination pager widget widgets".split())
BESIDE = set("site page main global top bottom left right primary secondary mobile list box bar area block section container wrapper inner outer content header link links button buttons form text item items group column panel post posts article entry user reader".split())
WHOLE = set("site-header skip-link skip-links related-posts related-articles related-links related-stories recommended-posts".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"}
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>")
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
SPACE = re.compile(r"\s+")
#: A longest common subsequence of at most so many cells is told from its rows, a larger one in linear space.
CELLS = 1 << 20


@lru_cache(maxsize=4096)
def hinted(attributes: str) -> bool:
    """Whether an element's role, class names or id tell a part of the page that is not its text."""
    for kind, value in NAMED.findall(attributes):
        for name in value.strip("\"'").split():
            if kind.lower() == "role" and name.lower() in ROLES:
                return True
            name = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower().replace("_", "-")
            words = {w for w in re.split(r"[-\d:]+", name) if w}
            if name in WHOLE or words & TELLING and words <= TELLING | BESIDE:
                return True
    return False


@dataclass
class Tag:
    """A tag at (at, after) of the page; ends: the number of the tag that ends its element; closed: by its own closing tag."""

    at: int
    after: int
    name: str
    closing: bool
    attributes: str
    ends: int = 0
    closed: bool = False


def tags_of(page: str) -> list[Tag]:
    """The page's tags, elements matched with what ends them."""
    tags = [Tag(m.start(), m.end(), (m[2] or "").lower(), m[1] == "/", m[3] or "") for m in TAG.finditer(page)]
    around: list[int] = []  # open elements
    n_open: dict[str, int] = {}

    def end(k: int) -> Tag:
        one = tags[around.pop()]
        one.ends, n_open[one.name] = k, n_open[one.name] - 1
        return one

    for k, tag in enumerate(tags):
        tag.ends = k
        if not tag.name or tag.name in VOID:
            continue
        if tag.closing:
            if n_open.get(tag.name):
                while (one := end(k)).name != tag.name:
                    pass
                one.closed = True
            continue
        if around and (tags[around[-1]].name == "p" and tag.name in BLOCKS or tags[around[-1]].name == tag.name == "li"):
            end(k)
        if not tag.attributes.endswith("/"):
            around.append(k)
            n_open[tag.name] = n_open.get(tag.name, 0) + 1
    while around:
        end(len(tags))
    return tags


def blocks_of(page: str | None) -> list[tuple[str, bool]]:
    """The page's lines in order, and of each whether it stands in an article."""
    if not page:
        return []
    page = RAW.sub(" ", page)
    tags = tags_of(page)
    articles = [k for k, t in enumerate(tags) if t.name in ("article", "main") and not t.closing and not hinted(t.attributes)]
    marked = set(articles)
    found: list[tuple[str, bool]] = []
    said: list[str] = []
    k = at = inside = 0  # inside: the number of the tag that ends the article

    def end_line(within: bool) -> None:
        if text := SPACE.sub(" ", html.unescape("".join(said))).strip():
            found.append((text, within))
        said.clear()

    while k < len(tags):
        tag = tags[k]
        said.append(page[at : tag.at])
        at = tag.after
        if tag.name in BLOCKS:
            end_line(k <= inside and inside > 0)
        elif tag.name in ("td", "th"):
            said.append(" ")
        left_out = False
        if tag.name and not tag.closing and tag.ends > k:
            within = k < inside
            later = bisect_left(articles, k + 1)
            holds = later < len(articles) and articles[later] < tag.ends
            if tag.name in EMPTY:
                left_out = tag.closed
            elif k not in marked:
                left_out = tag.name in AROUND and not (tag.name == "form" and holds) or tag.name == "header" and not within or tag.name not in ("html", "body") and hinted(tag.attributes)
        if left_out:
            end_line(k <= inside and inside > 0)
            if tag.closed:
                k, at = tag.ends + 1, tags[tag.ends].after
            else:  # never closed: an article in it still counts
                k = articles[later] if holds else tag.ends
                at = tags[k].at if k < len(tags) else len(page)
            continue
        if k in marked:
            inside = max(inside, tag.ends)
        k += 1
    rest = page[at:]
    cut = rest.rfind("<")
    said.append(rest[:cut] if cut >= 0 and re.match(r"<[/a-zA-Z!?][^>]*\Z", rest[cut:]) else rest)
    end_line(inside >= len(tags) > 0)
    return found


def lines_of(page: str | None) -> tuple[list[str], bool]:
    """The lines of the page's article, and True; all lines, and False, if it has none."""
    found = blocks_of(page)
    inside = [x for x, within in found if within]
    return (inside, True) if inside else ([x for x, _ in found], False)


def address(url: str | None) -> tuple[str, str]:
    """Host and path, without what does not tell pages apart."""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://|^//", "", url or "")
    host, _, path = re.split(r"[?#]", rest)[0].partition("/")
    return host.lower(), re.sub(r"\.html?$", "", path.rstrip("/"))


def squeezed(blocks: list[tuple[str, bool]]) -> bytes:
    """Lines (which hold no line break) as they travel, a mark before each."""
    return zstandard.ZstdCompressor(level=3).compress("\n".join("01"[within] + x for x, within in blocks).encode("utf-8", "replace"))


def spread(raw: bytes) -> list[tuple[str, bool]]:
    text = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 31).decode()
    return [(x[1:], x[0] == "1") for x in text.split("\n")] if text else []


def rows_of_bits(a: list[int], b: list[int]) -> Iterator[int]:
    """For each prefix of a (the empty one first): bit j is 0 where the longest common subsequence with b grows at b[j]."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    yield v
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length of the longest common subsequence of a with each prefix of b."""
    for v in rows_of_bits(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def walked(a: list[int], b: list[int]) -> list[int]:
    """Which places of a are in a longest common subsequence with b: all rows, then a walk back."""
    rows = list(rows_of_bits(a, b))

    def length(i: int, j: int) -> int:
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    found, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            found.append(i)
        elif length(i - 1, j) >= length(i, j - 1):
            i -= 1
        else:
            j -= 1
    return found


def shared(a: list[str], b: list[str], cells: int = CELLS) -> set[int]:
    """Which lines of a are in a longest common subsequence with b, in linear space (halves of a, met where both sides are longest)."""
    number = {x: i for i, x in enumerate(set(a) & set(b))}
    at = [i for i, x in enumerate(a) if x in number]
    left, right = [number[a[i]] for i in at], [number[x] for x in b if x in number]
    found, parts = set(), [(0, len(left), 0, len(right))]
    while parts:
        i, j, k, m = parts.pop()
        while i < j and k < m and left[i] == right[k]:
            found.add(at[i])
            i, k = i + 1, k + 1
        while i < j and k < m and left[j - 1] == right[m - 1]:
            j, m = j - 1, m - 1
            found.add(at[j])
        if i == j or k == m:
            continue
        if (j - i) * (m - k) <= cells or j - i == 1:
            found.update(at[i + x] for x in walked(left[i:j], right[k:m]))
            continue
        half = (i + j) // 2
        both = lengths(left[i:half], right[k:m]) + lengths(left[half:j][::-1], right[k:m][::-1])[::-1]
        cut = k + int(both.argmax())
        parts += [(i, half, k, cut), (half, j, cut, m)]
    return found


@dataclass
class Run:
    """Pages of one host and content that follow each other, and what is known of the content around them."""

    host: str
    raw: bytes
    before: dict | None = None
    members: list[tuple] = field(default_factory=list)  # page_id, url, path


def text_of(blocks: list[tuple[str, bool]], gone: set[int]) -> str:
    """The text of a page without the open lines that are gone."""
    kept = [x for i, x in enumerate(blocks) if x[1] or i not in gone]
    inside = [x for x, within in kept if within]
    rest = sum(len(x) for x, within in kept if not within)
    return "\n\n".join(inside if sum(map(len, inside)) >= rest else (x for x, _ in kept))


def texts_of(run: Run, after: dict | None, copy: float) -> Iterator[str]:
    """The text of each member, given the content before and after it (host, path, lines)."""
    blocks = spread(run.raw)
    lines, total = [x for x, _ in blocks], sum(len(x) for x, _ in blocks)
    around = [x for x in (run.before, after) if x and x["host"] == run.host]
    gone: dict[int, set[int]] = {}
    texts: dict[int, str] = {}

    def shared_with(i: int) -> set[int]:
        if i not in gone:
            gone[i] = shared(lines, [x for x, _ in spread(around[i]["lines"])])
        return gone[i]

    for _, _, path in run.members:

        def nearness(i: int, path: str = path) -> tuple[int, str]:
            other = around[i]["path"]
            return -next((n for n, (p, q) in enumerate(zip(path, other)) if p != q), min(len(path), len(other))), other

        best = -1
        if not all(within for _, within in blocks):  # else there is nothing that may go
            for i in sorted(range(len(around)), key=nearness):
                if sum(len(lines[k]) for k in shared_with(i)) < copy * total:
                    best = i
                    break
        if best not in texts:
            texts[best] = text_of(blocks, gone[best] if best >= 0 else set())
        yield texts[best]


NEAR = "struct<host: string, path: string, lines: binary>"
TEXTS = "page_id long, url string, text string"


def ranges(pages: DataFrame, parts: int, each: int = 40) -> list[tuple]:
    """Bounds of about equally many pages, from a sample of about `each` pages a range; only URLs and ids are read."""
    n = pages.count()
    share = min(1.0, 1.3 * each * parts / max(n, 1))
    drawn = pages.select("page_id", "url").where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    keys = sorted(place(r.url, r.page_id) for r in drawn.limit(4 * each * parts).toLocalIterator())
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []


def place(url: str | None, page_id: int | None) -> tuple:
    """Where a page stands in the order of pages."""
    return (*address(url), page_id is not None, page_id or 0)


def extracted(pages: DataFrame, copy: float = 0.8) -> DataFrame:
    """page_id, url, text, n_chars. A neighbour with at least the share `copy` of a page's text is a copy of it."""
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    bounds = ranges(pages, parts)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in common.rows(batch, "html", 8_000_000):
                places = [place(u, i) for u, i in zip(few.column("url").to_pylist(), few.column("page_id").to_pylist(), strict=True)]
                arrays = [pa.array([bisect_right(bounds, x) for x in places], pa.int32()), *(pa.array([x[i] for x in places], pa.string()) for i in (0, 1))]
                lines = pa.array([squeezed(blocks_of(x)) for x in few.column("html").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([few.column("page_id"), few.column("url"), *arrays, lines], ["page_id", "url", "part", "host", "path", "lines"])

    near = pa.struct([("host", pa.string()), ("path", pa.string()), ("lines", pa.binary())])
    member = pa.list_(pa.struct([("page_id", pa.int64()), ("url", pa.string()), ("path", pa.string())]))
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("part", pa.int32()), ("side", pa.string()), ("chunk", pa.int32()), ("mark", pa.string()), ("own", near), ("before", near), ("after", near), ("members", member)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, size, part = None, [], 0, 0

        def content(one: Run) -> dict:
            return {"host": one.host, "path": one.members[-1][2], "lines": one.raw}

        def finished(one: Run, first: bool, after: dict | None, last: bool) -> Iterator[dict]:
            if first or last:  # waits for what lies outside; a long run goes in several rows
                side = "only" if first and last else "first" if first else "last"
                mark = xxhash.xxh3_128_hexdigest(one.host.encode("utf-8", "replace") + b"\n" + one.raw)
                for i in range(0, len(one.members), 10_000):
                    some = [dict(zip(("page_id", "url", "path"), x, strict=True)) for x in one.members[i : i + 10_000]]
                    yield {"part": part, "side": side, "chunk": i, "mark": mark, "own": content(one), "before": one.before, "after": after, "members": some}
            else:
                for (page_id, url, _), text in zip(one.members, texts_of(one, after, copy), strict=True):
                    yield {"page_id": page_id, "url": url, "text": text}

        def rows() -> Iterator[dict]:
            nonlocal run, part
            first = True
            for batch in batches:
                for row in batch.to_pylist() if batch.num_rows else ():
                    if run is None or (run.host, run.raw) != (row["host"], row["lines"]):
                        if run:
                            yield from finished(run, first, {x: row[x] for x in ("host", "path", "lines")}, False)
                            first = False
                        run, part = Run(row["host"], row["lines"], content(run) if run else None), row["part"]
                    run.members.append((row["page_id"], row["url"], row["path"]))
            if run:
                yield from finished(run, first, None, True)

        for one in rows():
            held.append(one)
            size += len(one["text"] if "text" in one else one["own"]["lines"]) + 100
            if size > 8_000_000:
                yield pa.RecordBatch.from_pylist(held, out)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, out)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                run = Run(row["own"]["host"], row["own"]["lines"], row["before"], [tuple(x.values()) for x in row["members"]])
                texts = [{"page_id": x[0], "url": x[1], "text": t} for x, t in zip(run.members, texts_of(run, row["after"], copy), strict=True)]
                yield pa.RecordBatch.from_pylist(texts, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())]))

    parsed = pages.mapInArrow(parse, "page_id long, url string, part int, host string, path string, lines binary")
    dealt = parsed.repartitionById(parts, "part").sortWithinPartitions("part", "host", "path", "page_id")
    schema = f"{TEXTS}, part int, side string, chunk int, mark string, own {NEAR}, before {NEAR}, after {NEAR}, members array<struct<page_id: bigint, url: string, path: string>>"
    met = common.materialise(dealt.mapInArrow(compare, schema), "pages")
    runs = met.where("side IS NOT NULL")
    wanted = spark.createDataFrame(outside(runs.where("chunk = 0").select("part", "side", "mark").collect()), "part int, side string, way string, there int, there_side string, what string")  # at most two rows a range
    found = runs.where("chunk = 0").select(F.col("part").alias("there"), F.col("side").alias("there_side"), "own", "before", "after")
    found = wanted.join(found, ["there", "there_side"]).select("part", "side", "way", F.expr("CASE what WHEN 'own' THEN own WHEN 'before' THEN before ELSE after END").alias("found"))
    found = found.groupBy("part", "side").agg(*(F.first(F.when(F.col("way") == x, F.col("found")), ignorenulls=True).alias(f"found_{x}") for x in ("before", "after")))
    edges = runs.join(found, ["part", "side"], "left").select("own", F.coalesce("before", "found_before").alias("before"), F.coalesce("after", "found_after").alias("after"), "members")
    texts = met.where("side IS NULL").select("page_id", "url", "text").union(edges.mapInArrow(finish, TEXTS))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


def outside(runs: list) -> list[tuple]:
    """For the runs at the edges of ranges (part, side, mark) where the content before or after them is: (part, side, way, part there, side there, own, before or after)."""
    by = {(r.part, r.side): r.mark for r in runs}
    ranges = sorted({part for part, _ in by})
    wanted = []
    for way, near, far, order in (("before", "first", "last", ranges), ("after", "last", "first", ranges[::-1])):
        told = None  # the content that stands next to this range: (part, side, what, mark), and what stands beyond it
        beyond = None
        for part in order:
            edge, other = ("only", "only") if (part, "only") in by else (near, far)
            mine = by[part, edge]
            source = told if told and told[3] != mine else beyond
            if source:
                wanted.append((part, edge, way, *source[:3]))
            if edge == "only":
                if not told or told[3] != mine:
                    told, beyond = (part, "only", "own", mine), source
            else:
                told, beyond = (part, other, "own", by[part, other]), (part, other, way, "")
    return wanted
