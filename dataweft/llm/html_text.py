"""Main text of web pages: structure as evidence, and what a host repeats decides.

A page is read once, tag by tag. Text inside navigation, headers and footers of the page, sidebars, forms, scripts, styles and elements that
call themselves adverts, notices, comments and the like is left out. A name counts if its first part and all others say so, or if its last
part, the noun of a compound, does: ``cookie-notice`` and ``post-comments`` do, ``with-sidebar`` not. If the page marks its article
(``article``, ``main`` or a like role), that is the main text; an article inside a form or a wrapper that only its name makes chrome counts
if none lies outside, or if the wrapper itself lies in one. An article inside another, or beside one twice as long, is a comment or a
teaser unless it is the longest. A page that marks none is undecided: all of its other text may be main text.

The blocks so found of all pages, articles included, go on. Their tokens, hashed with the host, form a stream, and a suffix array over the
streams (``substrings.repeats``, spread over shards) finds the strings of ``TOKENS`` tokens that distinct pages share. Those that lie on
``SHARE`` of the host's distinct pages, and on at least ``PAGES``, are boilerplate, and so are whole blocks shorter than that; inside a marked
article the bounds are ``SURE_SHARE`` and ``SURE_PAGES``. Tokens covered are removed, the runs between stay. Pages of equal
streams are one page here, and so are near copies: pages with the same sketch (``SKETCH`` least hashes of shingles). A marked
article of which nothing would be left stays whole.

Character references are decoded, white space becomes one space, blocks are joined in page order by one space.

Defined results: a NULL or empty page has an empty text; tags left open end with their parent or the page; broken tags are read as
far as they go; a NULL url is a host of its own; repeated rows give repeated results; an empty table an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataweft.llm.common import lengths, slices
from dataweft.llm.substrings import repeats
from dataweft.session import cut, work_path

#: Tokens of a string that pages of a host must share to count as boilerplate; least share of the host's distinct pages and least number, outside and inside of articles.
TOKENS, SHARE, PAGES, SURE_SHARE, SURE_PAGES = 12, 0.3, 3, 0.6, 4
#: Rows of a few hundred bytes at most that a join sends to all tasks.
SENT = 100_000
#: Bytes of a token's hash, tokens of a shingle, least hashes of a near copy's sketch, tokens of an anchor.
WIDTH, SHINGLE, SKETCH, GRAM = 4, 4, 3, 6
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never the article, and those that end a word where they begin or end.
CHROME = frozenset("nav footer aside form button select dialog menu head option datalist object audio video canvas".split())
BLOCK = frozenset("address article aside blockquote body br dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
                  "header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_ITSELF = frozenset("p li dt dd td th tr option".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar form".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar cookie cookies consent gdpr notice "
                  "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended breadcrumb breadcrumbs comment comments "
                  "disqus footer masthead pagination pager toolbar widget copyright disclaimer skip hidden".split())
#: Parts that may follow those in a name, names of what often holds articles of others, and the kinds of chrome: an article in a LIKELY one is read.
AROUND = frozenset("area bar block body box button buttons container form icons inner item items link links list section slot text unit wrap wrapper".split())
OTHERS = frozenset("author responses more ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion related recommended comment comments disqus hidden".split())
#: Last parts of a compound that make the whole chrome, what they may stand with, and parts that only tell a state.
HEADS = frozenset("ad ads advert adverts advertisement sponsored comments comment responses share sharing related recommended newsletter nav navigation navbar menu sidebar footer breadcrumb "
                  "breadcrumbs pagination".split())
THINGS = frozenset("articles content news posts reading replies stories thread threads topics".split())
ABOUT = frozenset("bio box card info".split())
STATES = frozenset("with no has is not without hide show enabled disabled open closed below above after before".split())
CERTAIN, LIKELY = 1, 2
#: Hashes keep seven bits of each byte: the suffix sort needs bytes below 254.
SEVEN_BITS = bytes(i & 127 for i in range(256))
SPLIT = re.compile(r"[^a-z]+")


def attributes(text: str) -> dict[str, str]:
    return {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in ATTRIBUTE.findall(text)}


def named(a: dict[str, str]) -> frozenset[str]:
    """The parts that make class names or the id stand for chrome as a whole."""
    found = set()
    for name in (*a.get("class", "").lower().split(), a.get("id", "").lower()):
        parts = [x for x in SPLIT.split(name) if len(x) > 1]
        if not parts or not STATES.isdisjoint(parts):
            continue
        first, last = parts[0], parts[-1]
        if first in NAMES and all(x in NAMES or x in AROUND or x in THINGS for x in parts):
            found.add(first)
        elif last in HEADS:
            found.add(last)
        elif len(parts) > 1 and (first == "more" and THINGS.issuperset(parts[1:]) or first == "author" and ABOUT.issuperset(parts[1:])):
            found.add(first)
        elif last == "header" and first in ("site", "global"):
            found.add("banner")
    return frozenset(found)


def is_chrome(name: str, attrs: str, in_main: bool) -> int:
    """0, CERTAIN or LIKELY."""
    if name in CHROME or name == "header" and not in_main:
        certain = name != "form"
    else:
        certain = None
    if not attrs or attrs.isspace():
        return 0 if certain is None else CERTAIN if certain else LIKELY
    a = attributes(attrs)
    if certain or "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none", a.get("style", "")):
        return CERTAIN
    own = frozenset() if name in ("body", "html", "article", "main") else named(a)
    if not own and certain is None:
        return 0
    return LIKELY if OTHERS.isdisjoint(own) else CERTAIN


def is_main(name: str, attrs: str) -> bool:
    return name in ("article", "main") or bool(attrs) and attributes(attrs).get("role", "").lower() in ("main", "article")


def read(page: str | None) -> tuple[bool, list[str]]:
    """(decided, blocks): the article's blocks if the page marks one, else all that may be main text."""
    page = page or ""
    main: list[tuple[int, str]] = []  # blocks with the article they are in, 0 outside of any
    wrapped: list[tuple[int, str]] = []  # articles inside likely chrome
    rest: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int, list[tuple[int, str]], int]] = []  # open elements: name, whether they changed what text is, what it was before
    open_: Counter[str] = Counter()  # names in the stack
    inside = [0]  # the article around each article
    chrome, into, at, marked, unit = 0, rest, 0, False, 0

    def close_block() -> None:
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                into.append((unit, text))
            parts.clear()

    def enter(name: str, changes: bool) -> None:
        stack.append((name, changes, chrome, into, unit))
        open_[name] += 1

    def article(name: str, attrs: str) -> int:
        """The number of an article that begins; other marks of main text are none."""
        if name == "main" or name != "article" and attributes(attrs).get("role", "").lower() != "article":
            return unit
        inside.append(unit)
        return len(inside) - 1

    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            if not chrome:
                parts.append(page[at:])
            break
        if m.start() > at and not chrome:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA[") and not chrome:
                parts.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;").replace("<", "&lt;"))
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in BLOCK:
            if name == "br":
                if not chrome:
                    parts.append(" ")
            elif not chrome:
                close_block()
        if not closing and name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or not closing and m[3].endswith("/") and name not in BLOCK:
            continue
        if closing:
            while open_[name]:
                last, _, before, there, around = stack.pop()
                open_[last] -= 1
                if before != chrome or there is not into or around != unit:
                    close_block()
                chrome, into, unit = before, there, around
                if last == name:
                    break
            continue
        if chrome and stack[-1][1] and stack[-1][0] == name and name in ENDS_ITSELF:
            _, _, chrome, into, unit = stack.pop()  # a new paragraph or item ends the one before
            open_[name] -= 1
        if chrome:
            if chrome == LIKELY and is_main(name, m[3]) and not named(attributes(m[3])):
                enter(name, True)
                chrome, into, marked = 0, main if into is main else wrapped, True
                unit = article(name, m[3])
            elif open_[name] and name not in ENDS_ITSELF:
                enter(name, False)  # its end tag is not another's
            continue
        if kind := is_chrome(name, m[3], into is not rest):
            close_block()
            enter(name, True)
            chrome = kind
        elif is_main(name, m[3]):
            close_block()
            enter(name, True)
            into, marked = main if into is rest else into, True
            unit = article(name, m[3])
        elif open_[name] and name not in ENDS_ITSELF:
            enter(name, False)
    close_block()
    return (True, _without_others(main or wrapped, inside)) if marked else (False, [text for _, text in rest])


def _without_others(blocks: list[tuple[int, str]], inside: list[int]) -> list[str]:
    """The blocks without those of comments and teasers: articles in others, or less than half as long as the longest."""
    size: Counter[int] = Counter()
    for unit, text in blocks:
        size[unit] += len(text)
    articles = [u for u in size if u]
    if len(articles) > 1:
        longest = max(articles, key=lambda u: (size[u], -u))
        gone = {u for u in articles if u != longest and (inside[u] and inside[longest] != u or not inside[u] and 2 * size[u] < size[longest] and inside[longest] != u)}
        blocks = [x for x in blocks if x[0] not in gone]
    return [text for _, text in blocks]


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def stream(blocks: list[str], seed: int) -> bytes:
    """The hashed tokens of a page, each ``WIDTH`` bytes."""
    return b"".join([xxhash.xxh32_digest(w, seed) for block in blocks for w in block.split()]).translate(SEVEN_BITS)


def sketch(data: bytes, size: int) -> int:
    """A number that near copies mostly share: ``size`` least hashes of the stream's shingles."""
    tokens = np.frombuffer(data, "<u4").astype(np.uint64)
    n = len(tokens) - SHINGLE + 1
    if n < 4 * SHINGLE:
        return int(np.uint64(xxhash.xxh3_64_intdigest(data)).astype(np.int64))
    mixed = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        mixed = (mixed ^ tokens[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    least = [int((mixed * np.uint64(2 * k + 0xBF58476D1CE4E5B9)).min()) for k in range(size)]
    return int(np.uint64(xxhash.xxh3_64_intdigest(np.array(least, np.uint64).tobytes())).astype(np.int64))


READ = "blocks array<string>, decided boolean, host long, key long, bytes long, fold long, anchors array<long>"


def _read(keep: int, size: int, length: int):
    """(kept columns, blocks, decided, host, and key, bytes, sketch and anchors of the stream) of every page; the url stands before the page."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, urls = batch.column(batch.num_columns - 1), batch.column(batch.num_columns - 2)
            for a, b in slices(lengths(pages)):
                found = [read(p) for p in pages.slice(a, b - a).to_pylist()]
                seeds = [xxhash.xxh32_intdigest(host(u)) for u in urls.slice(a, b - a).to_pylist()]
                data = [stream(blocks, seed) for (_, blocks), seed in zip(found, seeds, strict=True)]
                keys = [np.uint64(xxhash.xxh3_64_intdigest(d, seed)).astype(np.int64) for d, seed in zip(data, seeds, strict=True)]
                columns = [pa.array([x[1] for x in found], pa.list_(pa.string())), pa.array([x[0] for x in found]), pa.array(seeds, pa.int64()), pa.array(keys, pa.int64()),
                           pa.array(map(len, data), pa.int64()), pa.array([sketch(d, size) for d in data], pa.int64()), pa.array([anchors(d, length) for d in data], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in range(keep)), *columns], names=[f"c{i}" for i in range(keep + len(columns))])
    return work


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, bytes, data) from (key, bytes, host, blocks)."""
    for batch in batches:
        blocks, seeds = batch.column("blocks").to_pylist(), batch.column("host").to_pylist()
        data = pa.array([stream(b, seed) for b, seed in zip(blocks, seeds, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("bytes"), data], names=["key", "bytes", "data"])


def anchors(data: bytes, length: int) -> np.ndarray:
    """Numbers of 32 bits such that two streams with a string of ``length`` tokens in common share one: the least gram of every such string."""
    tokens = np.frombuffer(data, "<u4").astype(np.uint64)
    width = min(GRAM, length)
    n = len(tokens) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    grams = np.zeros(len(tokens) - width + 1, np.uint64)
    for i in range(width):
        grams = (grams ^ tokens[i : i + len(grams)]) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
    return np.unique(np.lib.stride_tricks.sliding_window_view(grams, length - width + 1).min(1) >> np.uint64(32)).astype(np.int64)


def _starts(found: list[dict], n: int, length: int) -> np.ndarray:
    """Places of tokens at which a shared string starts; strings start at whole tokens."""
    at = [np.arange(-(-run["first"] // WIDTH), (run["first"] + run["number"] - 1) // WIDTH + 1) for run in found]
    at = np.unique(np.concatenate(at)) if at else np.arange(0)
    return at[at + length <= n]


def _grams(length: int):
    """(host, fold, decided, key, place, gram) of every start of a shared string."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("host", "fold", "decided", "key", "blocks", "found")), strict=True)
            for seed, fold, decided, key, blocks, found in rows:
                data = stream(blocks, seed)
                at = _starts(found, len(data) // WIDTH, length)
                if len(at):
                    gram = [np.uint64(xxhash.xxh3_64_intdigest(data[i * WIDTH : (i + length) * WIDTH])).astype(np.int64) for i in at.tolist()]
                    same = [pa.array(np.full(len(at), x), pa.int64()) for x in (seed, fold)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(np.full(len(at), decided)), pa.array(np.full(len(at), key), pa.int64()), pa.array(at, pa.int64()), pa.array(gram, pa.int64())],
                                                     names=["host", "fold", "decided", "key", "place", "gram"])
    return work


def uncovered(blocks: list[str], decided: bool, places: list[int] | None, short: list[int] | None, length: int) -> str:
    """The tokens that neither a shared string nor a shared short block covers; a marked article stays whole if nothing is left."""
    gone_blocks = set(short or ())
    flat = [(w, i in gone_blocks) for i, block in enumerate(blocks) for w in block.split()]
    edge = np.zeros(len(flat) + 1, np.int64)
    for first in places or ():
        edge[first] += 1
        edge[min(first + length, len(flat))] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    left = " ".join(w for (w, s), g in zip(flat, gone.tolist(), strict=True) if not g and not s)
    return left if left or not decided else " ".join(blocks)


def _unique_runs(keep: int, length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("blocks", "decided", "places", "short")), strict=True)
            text = [uncovered(*row, length) if row[2] or row[3] else " ".join(row[0]) for row in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(keep)), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=[f"c{i}" for i in range(keep + 2)])
    return work


def _written(rows: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: unlike a checkpoint it has a size that the planner knows."""
    path = work_path(rows.sparkSession, "pages")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _beside(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join by key; a right side of at most ``SENT`` rows goes to the pages, so that their blocks stay where they are."""
    return left.join(F.broadcast(right) if right.count() <= SENT else right, "key", how)


def _often(seen: DataFrame, what: str, sizes: DataFrame) -> DataFrame:
    """(host, what, decided): what enough of the host's distinct pages hold, by the bounds for pages with and without a marked article."""
    counts = seen.select("host", what, "fold").distinct().groupBy("host", what).agg(F.count("*").alias("n"))
    met = counts.where(F.col("n") >= min(PAGES, SURE_PAGES)).join(sizes, "host")
    bounds = F.explode(F.array(*[F.struct(F.lit(d).alias("decided"), F.lit(n).alias("least"), F.lit(share).alias("share"))
                                 for d, n, share in ((False, PAGES, SHARE), (True, SURE_PAGES, SURE_SHARE))])).alias("b")
    rows = met.select("host", what, "n", "pages", bounds)
    return rows.where((F.col("n") >= F.col("b.least")) & (F.col("n") >= F.col("b.share") * F.col("pages"))).select("host", what, F.col("b.decided").alias("decided"))


def main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), url: str = "url", page: str = "html", length: int = TOKENS, size: int = SKETCH) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` of every page; ``length`` tokens make a shared string, ``size`` hashes a near copy's sketch."""
    n = len(keep)
    own = [F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]
    schema = "".join(f"c{i} {pages.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    rows = pages.select(*own, F.col(url).alias("url_"), F.col(page).alias("page_"))
    names = [f"c{i}" for i in range(n)]
    made = [x.split()[0] for x in READ.split(", ")]
    path = work_path(pages.sparkSession, "blocks")
    rows.mapInArrow(_read(n, size, length), schema + ", ".join(f"c{n + i} {x.split()[1]}" for i, x in enumerate(READ.split(", ")))).toDF(*names, *made).write.option("compression", "zstd").parquet(path)
    found = pages.sparkSession.read.parquet(path)
    # One row for pages of equal streams. Hosts with too few distinct pages have no boilerplate.
    sizes = _written(found.select("host", "fold").distinct().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= PAGES))
    asked = found.where("bytes > 0").join(sizes.select("host"), "host", "left_semi")
    # A string on enough of a host's pages has its anchor on as many; only pages with such an anchor go to the suffix array.
    each = asked.select("key", "host", F.explode("anchors").alias("anchor"))
    counts = each.groupBy("host", "anchor").agg(F.count("*").alias("n")).where(F.col("n") >= min(PAGES, SURE_PAGES)).join(sizes, "host")
    hot = _written(counts.where(F.col("n") >= min(SHARE, SURE_SHARE) * F.col("pages")).select("host", "anchor"))
    near = _written(each.join(hot, ["host", "anchor"], "left_semi").select("key").distinct())
    units = _beside(asked, near, "left_semi").select("key", "bytes", "host", "blocks").mapInArrow(_streams, "key long, bytes long, data binary")
    shared = cut(repeats(units, WIDTH * length, across=True))
    first = asked.join(shared, ["key", "bytes"]).dropDuplicates(["key"])
    grams = cut(first.select("host", "fold", "decided", "key", "blocks", "found").mapInArrow(_grams(length), "host long, fold long, decided boolean, key long, place long, gram long"))
    places = grams.join(_often(grams, "gram", sizes), ["host", "gram", "decided"], "left_semi").groupBy("key").agg(F.collect_list("place").alias("places"))
    each = asked.select("host", "fold", "decided", "key", F.posexplode("blocks").alias("place", "block"))
    each = each.where(F.size(F.split("block", " ")) < length).select("host", "fold", "decided", "key", "place", F.xxhash64("block").alias("block"))
    short = each.join(_often(each, "block", sizes), ["host", "block", "decided"], "left_semi").groupBy("key").agg(F.collect_set("place").alias("short"))
    marks = _written(places.join(short, "key", "full_outer"))
    beside = _beside(found, marks, "left").select(*names, "blocks", "decided", "places", "short")
    return beside.mapInArrow(_unique_runs(n, length), f"{schema}c{n} string, c{n + 1} long").toDF(*keep, "text", "n_chars")
