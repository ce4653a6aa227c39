"""Main text of web pages: boilerplate found with suffix arrays over the token streams of a host.

A page is read into blocks of text. Blocks inside an article (or main) element are its main zone;
elements made for navigation, adverts, notices, forms, side matter and reader comments are side
zones; everything else is open. The whole page is its token stream: first the words outside the main
zone, each with its host and the path of elements around it, then the blocks of main and open zones,
each with its host between breaks. The streams of a host are searched for substrings of ``RUN`` tokens and
more that stand in several distinct pages. Outside the main zone what these cover is boilerplate and
is removed, unique runs stay. Inside it a repeat is boilerplate if nearly all distinct pages of the host
have it, and a block of nothing else goes (share bars, subscription lines, the fixed lines of a template);
passages that only some articles share are main text and stay. Then the elements decide about the rest:
what is left in a side zone goes, and a page with a main zone keeps nothing outside it. An open page of which
nothing unique is left is a copy of others, not boilerplate: it keeps its open blocks.

The search is cut so that no task holds a host. A window of ``RUN`` tokens belongs to its smallest
gram, so equal windows of one host meet in one shard, whichever pages they come from; runs of windows
with the same gram are one string, and equal strings are counted once. Grams in one page only leave
first. A gram with very many different strings is dealt by single windows over the shards. Each shard sorts
the suffixes of its strings; neighbours that agree on ``RUN`` tokens are a repeated substring, and
longer ones are the union of these, so the result is that of one suffix array for the whole host.

The blocks of main and open zones are most of a page, and only what nearly all pages have matters there. So
the pages are counted first in which each smallest gram stands: every page gives the cells (``CELLS`` hash
values for each host) of its grams, each batch of pages adds them up, and shards of cells add up the
batches. A count is never below the true one (equal pages of several batches and grams of one cell are
added), so a gram below the share cannot belong to such a repeat. The strings of the others are made by a second reading of
the hosts that have any, and go through the same suffix arrays; then the distinct pages of each repeated
window are counted exactly.

Defined results: a null html is an empty page; a null url or one without ``://`` has the empty host;
equal pages of a host count as one page and get the same text; repeated rows each get a row; broken
markup is read as far as it goes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import html
import json
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsemart.llm import common

RUN, GRAM = 8, 3  # tokens of the shortest repeated substring; of the grams that route windows
CELLS, MARKS = 1 << 16, 1 << 26  # hash values of a host's grams, whose pages are counted before the search; bits that mark what is left
SHARD_TOKENS = 1 << 20  # tokens a shard sorts
HOT_STRINGS = 2000  # different strings of one gram above which its windows are dealt singly
WIDE_PAGES, WIDE_SHARE = 12, 0.75  # distinct pages of a host, and the share of them, that make a repeat boilerplate in the main zone
PATH = 6  # innermost elements that make the path of a block
MAIN, OPEN, SIDE = 0, 1, 2

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
RAW = set("script style textarea title xmp noembed noframes plaintext".split())
UNSEEN = set("script style noscript template iframe object svg math canvas audio video select button datalist textarea title".split())
SIDE_TAGS = set("nav footer aside menu form dialog fieldset".split())
SIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
SIDE_WORDS = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer sidebar aside ad ads advert adverts advertisement "
    "adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice newsletter subscribe subscription signup "
    "popup modal overlay comment comments disqus reply replies respond share sharing social related recommended login search "
    "pagination pager copyright toolbar widget".split()
)
MAIN_NAMES = set("article-body article-content entry-content post-content post-body story-body main-content".split())
NOT_OWN = set("has with no without is js".split())  # a class like with-sidebar speaks of another element

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]{0,8192}+\"|'[^']{0,8192}+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HOST = re.compile(r"://([^/?#]*)")
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

_STRINGS = pa.schema([
    ("key", pa.binary()), ("host", pa.int64()),
    ("strings", pa.list_(pa.struct([("gram", pa.int64()), ("start", pa.int32()), ("tokens", pa.binary())]))),
])
# One row per page, and per batch and shard one row without key: the cells of each host in rising order with their pages.
_STREAMS = pa.schema([
    *_STRINGS, ("shard", pa.int32()), ("shards", pa.int32()), ("hosts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
    ("cells", pa.binary()), ("counts", pa.binary()),
])
_CELLS = pa.schema([("host", pa.int64()), ("cell", pa.int64()), ("n", pa.int64())])
_RUNS = pa.schema([("key", pa.binary()), ("host", pa.int64()), ("at", pa.int32()), ("window", pa.binary())])
_PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("key", pa.binary()), ("host", pa.int64()), ("packed", pa.binary())])
_WINDOWS = pa.schema([("whole", pa.binary()), ("at", pa.int32()), ("tokens", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
_COVERED = pa.schema([("tokens", pa.binary()), ("first", pa.int32()), ("last", pa.int32())])
_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_repeated", pa.int64())])


def host_of(url: str | None) -> str:
    found = HOST.search(url or "")
    return found.group(1).translate(UPPER) if found else ""


def _names(value: str) -> list[str]:
    return [name.strip("-_").lower().replace("_", "-") for name in value.split()]


@functools.lru_cache(maxsize=1 << 13)
def _zone(tag: str, attributes: str, zone: int) -> int | None:
    """The zone below an element in ``zone``; None where its text is never seen."""
    if tag in UNSEEN:
        return None
    given = {m.group(1).lower(): m.group(2) or m.group(3) or m.group(4) or "" for m in ATTRIBUTE.finditer(attributes)} if attributes.strip(" /") else {}
    if "hidden" in given:
        return None
    role = given.get("role", "").lower()
    names = _names(given.get("class", "") + " " + given.get("id", ""))
    if zone == SIDE or tag in SIDE_TAGS or role in SIDE_ROLES:
        return SIDE
    if tag not in ("html", "body", "main"):
        for name in names:
            words = name.split("-")
            if words[0] not in NOT_OWN and (words[0] in SIDE_WORDS or words[-1] in SIDE_WORDS or (words[0] == "header" and zone == OPEN)):
                return SIDE
    if tag == "header" and zone == OPEN:
        return SIDE
    if tag in ("article", "main") or role in ("main", "article") or given.get("itemprop") == "articleBody" or MAIN_NAMES & set(names):
        return MAIN
    return zone


def blocks_of(page: str | None) -> list[tuple[int, str, str]]:
    """(zone, path of elements, text) of every block with text, in page order.

    A block ends where a block element begins or ends. An article inside main is the main zone
    alone, so that what stands beside it does not count.
    """
    out, text, at, page = [], [], 0, page or ""
    # Open elements: name, zone of what is in it, zone and path of a block there, whether an article of the main zone is around.
    stack, nothing = [], ("", OPEN, OPEN, (), False)

    def flush():
        words = " ".join("".join(text).split())
        text.clear()
        if words:
            _, _, zone, path, deep = stack[-1] if stack else nothing
            out.append((zone, "/".join(path), words, deep))

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            start = len(page)
        if start > at and (not stack or stack[-1][1] is not None):
            text.append(html.unescape(page[at:start]))
        if start == len(page):
            break
        m = TAG.match(page, start)
        if m is None:  # a bare <
            if not stack or stack[-1][1] is not None:
                text.append("<")
            at = start + 1
            continue
        at = m.end()
        closing, name, attributes, closing_open, name_open, attributes_open = m.groups()
        if name is None and name_open is None:
            continue
        name, closing, attributes = (name or name_open).lower(), closing or closing_open, attributes or attributes_open or ""
        if name == "br":
            text.append("\n")
            continue
        if text and name not in INLINE:
            flush()
        if name in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name == "body":  # an open head ends here
            del stack[1:]
        if name == "p":  # an open paragraph ends here
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        zone = stack[-1][1] if stack else OPEN
        below = None if zone is None else _zone(name, attributes, zone)
        if name in INLINE and below != zone:  # part of a block: seen with it, or not at all
            below = None if below in (None, SIDE) else zone
        if name in RAW:
            end = re.compile(f"</{name}", re.I).search(page, at)
            at = end.start() if end else len(page)
            if below is None:
                closed = page.find(">", at)
                at = closed + 1 if closed >= 0 else len(page)
            continue
        if attributes.rstrip().endswith("/") and below is not None and name in INLINE:
            continue
        _, _, block, path, deep = stack[-1] if stack else nothing
        if name not in INLINE:
            block, path = below, (*path, name)[-PATH:]
        stack.append((name, below, block, path, deep or (name == "article" and below == MAIN)))
    flush()
    nested = any(deep and zone == MAIN for zone, _, _, deep in out)
    return [(OPEN if nested and zone == MAIN and not deep else zone, path, words) for zone, path, words, deep in out]


_MARK, _FILL = xxhash.xxh32_intdigest("", 1), xxhash.xxh32_intdigest("", 2)


def layout(blocks: list) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]], int]:
    """Where the blocks stand in the token stream.

    (number, place of the first word) of those outside the main zone; (number, first place, places)
    of those that may be main text, each as a string of ``RUN`` tokens at least; the place between.
    """
    outside, inside, at, broken = [], [], 0, False
    for number, (zone, _, words) in enumerate(blocks):
        if zone == MAIN:
            broken = True
            continue
        at += 2 if broken and at else 1
        broken = False
        outside.append((number, at))
        at += words.count(" ") + 1
    edge = at
    for number, (zone, _, words) in enumerate(blocks):
        if zone != SIDE:
            size = max(RUN, words.count(" ") + 2)
            inside.append((number, at + 1, size))
            at += 1 + size
    return outside, inside, edge


def stream(blocks: list, host: int, key: bytes) -> tuple[np.ndarray, tuple]:
    """(32-bit tokens of the whole page, ``layout`` of its blocks).

    A break, different in every page, stands where the main zone was left out of the first part and
    before each block of the second.
    """
    tokens, seeds = [], {}
    outside, inside, edge = layout(blocks)
    for number, first in outside:
        _, path, words = blocks[number]
        if first - 1 > len(tokens):
            tokens.append(xxhash.xxh32_intdigest(key + bytes(str(number), "ascii")))
        if path not in seeds:
            seeds[path] = xxhash.xxh32_intdigest(path, host & 0xFFFFFFFF)
        seed = seeds[path]
        tokens.append(xxhash.xxh32_intdigest("", seed))
        tokens.extend(xxhash.xxh32_intdigest(word, seed) for word in words.split(" "))
    own = np.full(inside[-1][1] + inside[-1][2] - edge if inside else 0, _FILL, np.uint32)
    words = " ".join([blocks[number][2] for number, _, _ in inside]).split(" ") if inside else []
    hashes, at = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words)), 0
    for number, first, _ in inside:
        here, n = first - edge, blocks[number][2].count(" ") + 1
        own[here - 1] = xxhash.xxh32_intdigest(key + bytes(f"/{number}", "ascii"))
        own[here] = _MARK
        own[here + 1:here + 1 + n] = hashes[at:at + n]
        at += n
    own = (own ^ np.uint32(host & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
    return np.concatenate([np.array(tokens, np.uint32), own]), (outside, inside, edge)


def grams_of(tokens: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """The hash of the gram at every place."""
    wide, mixed = tokens.astype(np.uint64), np.zeros(len(tokens) - gram + 1, np.uint64)
    for i in range(gram):
        mixed = (mixed ^ wide[i:len(mixed) + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def strings_of(tokens: np.ndarray, run: int = RUN, gram: int = GRAM) -> list[dict]:
    """The windows of ``run`` tokens, those next to each other with the same smallest gram as one string."""
    if len(tokens) < run:
        return []
    mixed = grams_of(tokens, gram)
    least = np.lib.stride_tricks.sliding_window_view(mixed, run - gram + 1).argmin(axis=1) + np.arange(len(tokens) - run + 1)
    firsts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    ends = np.r_[firsts[1:], len(least)] + run - 1
    named = mixed[least[firsts]].view(np.int64).tolist()
    return [{"gram": g, "start": a, "tokens": tokens[a:b].tobytes()} for g, a, b in zip(named, firsts.tolist(), ends.tolist())]


def cell_of(grams: np.ndarray) -> np.ndarray:
    return (grams.view(np.uint64) >> np.uint64(48)).astype(np.int64)


def cells_of(tokens: np.ndarray, places: tuple) -> np.ndarray:
    """The cells of the smallest grams of all windows in the blocks that may be main text; some several times."""
    _, inside, edge = places
    if not inside:
        return np.zeros(0, np.int64)
    mixed = grams_of(tokens[edge:])
    least = mixed[:len(tokens) - edge - RUN + 1]
    for i in range(1, RUN - GRAM + 1):
        least = np.minimum(least, mixed[i:len(least) + i])
    cells = np.concatenate([least[first - edge:first - edge + size - RUN + 1] for _, first, size in inside])
    return cell_of(cells[np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])])


def page_key(url: str | None, page: str | None) -> tuple[bytes, int]:
    """(digest of host and page, number of the host)."""
    name = host_of(url)
    return hashlib.md5(f"{name}\n{page or ''}".encode("utf-8", "surrogatepass")).digest(), xxhash.xxh64_intdigest(name) - (1 << 63)


def summed(hosts: np.ndarray, cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each host and cell once, in order, with the sum of its counts."""
    order = np.lexsort((cells, hosts))
    hosts, cells = hosts[order], cells[order]
    firsts = np.flatnonzero(np.r_[len(cells) > 0, (hosts[1:] != hosts[:-1]) | (cells[1:] != cells[:-1])])
    return hosts[firsts], cells[firsts], np.add.reduceat(counts[order], firsts) if len(firsts) else counts[:0]


def _streaming(part: dict[str, list], shards: int) -> dict[str, list]:
    out, seen = {name: [] for name in _STREAMS.names}, {}
    for url, page in zip(part["url"], part["html"]):
        key, host = page_key(url, page)
        if key in seen:
            continue
        blocks = blocks_of(page)
        tokens, places = stream(blocks, host, key)
        seen[key] = host, cells_of(tokens, places)
        out["key"].append(key), out["host"].append(host), out["strings"].append(strings_of(tokens[:places[2]]))
    pages = len(out["key"])
    if pages:
        sizes = [len(c) for _, c in seen.values()]
        numbered = np.unique(np.repeat(np.arange(pages) * CELLS, sizes) + np.concatenate([c for _, c in seen.values()]))
        hosts, cells = np.array([h for h, _ in seen.values()], np.int64)[numbered // CELLS], numbered % CELLS
        hosts, cells, counts = summed(hosts, cells, np.ones(len(cells), np.int64))
        pack, dealt = zstandard.ZstdCompressor(level=3), cells % shards
        for shard in np.unique(dealt).tolist():
            own = dealt == shard
            names, sizes = np.unique(hosts[own], return_counts=True)
            steps = np.diff((cells[own] // shards).astype(np.uint32), prepend=np.uint32(0))
            out["shard"].append(shard), out["shards"].append(shards), out["hosts"].append(names.tolist()), out["sizes"].append(sizes.tolist())
            out["cells"].append(pack.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes()))
            out["counts"].append(pack.compress(counts[own].astype(np.uint32).tobytes()))
    rows = len(out["shard"])
    for name in ("key", "host", "strings"):
        out[name] += [None] * rows
    for name in ("shard", "shards", "hosts", "sizes", "cells", "counts"):
        out[name] = [None] * pages + out[name]
    return out


def _counting(table: pa.Table) -> pa.Table:
    unpack, parts, shards = zstandard.ZstdDecompressor(), [], table["shards"][0].as_py()
    for hosts, sizes, cells, counts in zip(*(table[name].to_pylist() for name in ("hosts", "sizes", "cells", "counts"))):
        steps = np.frombuffer(unpack.decompress(cells), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
        parts.append((
            np.repeat(np.array(hosts, np.int64), sizes), np.cumsum(steps, dtype=np.uint32), np.frombuffer(unpack.decompress(counts), np.uint32),
        ))
    hosts, cells, counts = summed(*(np.concatenate(column) for column in zip(*parts)))
    cells, several = cells.astype(np.int64) * shards + table["shard"][0].as_py(), counts >= WIDE_PAGES
    return pa.table({"host": hosts[several], "cell": cells[several], "n": counts[several].astype(np.int64)}, schema=_CELLS)


def _has(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    return (bits[values >> 6] >> (values & 63).astype(np.uint64)) & np.uint64(1) > 0


def _reading(part: dict[str, list], hosts: np.ndarray, cells: np.ndarray) -> dict[str, list]:
    """The strings of the blocks that may be main text whose cells are marked, for pages of marked hosts."""
    out, seen = {name: [] for name in _STRINGS.names}, set()
    for url, page in zip(part["url"], part["html"]):
        key, host = page_key(url, page)
        if key in seen or not _has(hosts, np.array([host % MARKS]))[0]:
            continue
        seen.add(key)
        blocks = blocks_of(page)
        tokens, (_, _, edge) = stream(blocks, host, key)
        found = strings_of(tokens[edge:])
        kept = _has(cells, host % MARKS ^ cell_of(np.array([s["gram"] for s in found], np.int64)) << 10).tolist()
        found = [{**s, "start": s["start"] + edge} for s, k in zip(found, kept) if k]
        if found:
            out["key"].append(key), out["host"].append(host), out["strings"].append(found)
    return out


def _cutting(part: dict[str, list]) -> dict[str, list]:
    """Every window of the repeated spans of strings."""
    out = {name: [] for name in _RUNS.names}
    for key, host, start, tokens, first, last in zip(*(part[n] for n in ("key", "host", "start", "tokens", "first", "last"))):
        for at in range(first, last - RUN + 1):
            out["key"].append(key), out["host"].append(host), out["at"].append(start + at)
            out["window"].append(tokens[4 * at:4 * (at + RUN)])
    return out


def _packing(part: dict[str, list]) -> dict[str, list]:
    out = {"page_id": part["page_id"], "url": part["url"], "key": [], "host": [], "packed": []}
    pack = zstandard.ZstdCompressor(level=3)
    for url, page in zip(part["url"], part["html"]):
        key, host = page_key(url, page)
        out["key"].append(key), out["host"].append(host)
        # Side blocks are never written: of their words the number is enough.
        blocks = [(zone, "", " " * words.count(" ") if zone == SIDE else words) for zone, _, words in blocks_of(page)]
        out["packed"].append(pack.compress(json.dumps(blocks, ensure_ascii=False).encode("utf-8", "surrogatepass")))
    return out


def block_name(host: int, words: str) -> int:
    return xxhash.xxh64_intdigest(words, host & 0xFFFFFFFF) - (1 << 63)


def _windows(part: dict[str, list]) -> dict[str, list]:
    out = {name: [] for name in _WINDOWS.names}
    for tokens, low, high in zip(part["tokens"], part["low"], part["high"]):
        for at in range(len(tokens) // 4 - RUN + 1):
            out["whole"].append(tokens), out["at"].append(at), out["tokens"].append(tokens[4 * at:4 * (at + RUN)])
            out["low"].append(low), out["high"].append(high)
    return out


def suffix_ranks(tokens: np.ndarray, ends: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, name of the first ``run`` tokens of each suffix) of strings put end to end.

    ``ends`` is the end of the string of every place; a suffix ends with its string. Suffixes are
    sorted by doubling; -1 names those shorter than ``run``.
    """
    n = len(tokens)
    place = np.arange(n)
    rank, length, name = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1, 1, None
    order = np.argsort(rank, kind="stable")
    while True:
        if length * 2 > run and name is None:
            over = run - length
            tail = np.where(place + over < ends, rank[np.minimum(place + over, n - 1)], 0)
            name = np.unique(rank * (n + 2) + tail, return_inverse=True)[1]
            name = np.where(ends - place >= run, name, -1)
        if length >= (ends - place).max(initial=0):
            return order, name
        tail = np.where(place + length < ends, rank[np.minimum(place + length, n - 1)], 0)
        rank = np.unique(rank * (n + 2) + tail, return_inverse=True)[1].astype(np.int64) + 1
        order, length = np.argsort(rank, kind="stable"), length * 2


def covered(strings: list[bytes], low: list[bytes], high: list[bytes], run: int = RUN) -> list[tuple[int, int, int]]:
    """(string, first, last): the spans of each string that stand in several pages.

    ``low`` and ``high`` are the smallest and largest of the pages a string stands in.
    """
    sizes = np.array([len(s) // 4 for s in strings], np.int64)
    tokens = np.frombuffer(b"".join(strings), np.uint32)
    if not len(tokens):
        return []
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(strings)), sizes)
    order, name = suffix_ranks(tokens, ends, run)
    codes = np.unique(np.array([x.hex() for x in (*low, *high)]), return_inverse=True)[1]
    low_code, high_code = codes[:len(low)], codes[len(low):]
    order = order[name[order] >= 0]  # neighbours in the array with one name agree on their first tokens
    names = name[order]
    first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else np.zeros(0, np.int64)
    if not len(first):
        return []
    smallest = np.minimum.reduceat(low_code[owner[order]], first)
    largest = np.maximum.reduceat(high_code[owner[order]], first)
    several = np.repeat(smallest != largest, np.diff(np.r_[first, len(names)]))
    starts = np.sort(order[several])
    out, bases = [], np.cumsum(sizes) - sizes
    for at in starts.tolist():
        s = int(owner[at])
        a = at - int(bases[s])
        if out and out[-1][0] == s and out[-1][2] >= a:
            out[-1] = (s, out[-1][1], a + run)
        else:
            out.append((s, a, a + run))
    return out


def _searching(table: pa.Table) -> pa.Table:
    strings = table["tokens"].to_pylist()
    found = covered(strings, table["low"].to_pylist(), table["high"].to_pylist())
    return pa.table({"tokens": [strings[s] for s, _, _ in found], "first": [a for _, a, _ in found], "last": [b for _, _, b in found]}, schema=_COVERED)


def repeated_strings(rows: DataFrame) -> DataFrame:
    """tokens, first, last: the spans of the strings of ``rows`` (key, gram, tokens) that stand in several pages."""
    ends = [F.min("low").alias("low"), F.max("high").alias("high")]
    strings = common.stored(rows.groupBy("gram", "tokens").agg(F.min("key").alias("low"), F.max("key").alias("high")), "strings")
    grams = strings.groupBy("gram").agg(*ends, F.count("*").alias("n")).where("low <> high")
    grams = common.stored(grams.select("gram", (F.col("n") > HOT_STRINGS).alias("hot")), "grams")
    shared = strings.join(grams, "gram")
    windows = common.map_arrow(shared.where("hot").select("tokens", "low", "high"), common.per_batch(_windows, _WINDOWS), _WINDOWS)
    windows = common.stored(windows, "windows")
    searched = shared.where("not hot").select(F.col("gram").alias("route"), "tokens", "low", "high").unionByName(
        windows.groupBy("tokens").agg(*ends).withColumn("route", F.xxhash64("tokens"))
    )
    size = searched.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    shards = 1 + size // (4 * SHARD_TOKENS)
    dealt = searched.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)))
    found = common.stored(dealt.groupBy("shard").applyInArrow(_searching, common.ddl(_COVERED)), "covered")
    # What single windows cover, in the strings they come from.
    parts = windows.select("whole", "at", "tokens").join(found, "tokens").select(
        F.col("whole").alias("tokens"), (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last")
    )
    return found.unionByName(parts)


def marked(values: DataFrame) -> np.ndarray:
    """A bit for each of ``MARKS`` numbers: those in the only column of ``values``. Bounded, however many rows there are."""
    value = F.col("value")
    bits = values.toDF("value").select(value.bitwiseAND(63).cast("int").alias("bit"), F.shiftright(value, 6).alias("word"))
    found = bits.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    out = np.zeros(MARKS // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def often(counted: DataFrame, hosts: DataFrame) -> DataFrame:
    """The rows of ``counted`` (host, n) with the share of the host's pages that makes a repeat boilerplate in the main zone."""
    return counted.join(hosts, "host").where((F.col("n") >= WIDE_PAGES) & (F.col("n") >= F.lit(WIDE_SHARE) * F.col("pages"))).drop("pages")


def inside_strings(rows: DataFrame, streams: DataFrame, hosts: DataFrame) -> DataFrame | None:
    """key, host, strings of the blocks that may be main text, as far as their grams may stand in nearly all pages of the host."""
    counted = streams.where("shard is not null").groupBy("shard").applyInArrow(_counting, common.ddl(_CELLS))
    cells = common.stored(often(counted, hosts), "cells")
    if not cells.limit(1).collect():
        return None
    host = F.col("host").bitwiseAND(MARKS - 1)
    of_hosts, of_cells = marked(cells.select(host)), marked(cells.select(host.bitwiseXOR(F.shiftleft("cell", 10))))
    reading = common.per_batch(functools.partial(_reading, hosts=of_hosts, cells=of_cells), _STRINGS)
    return common.stored(common.map_arrow(rows.select("url", "html"), reading, _STRINGS), "inside")


def wide_runs(strings: DataFrame, repeats: DataFrame, hosts: DataFrame) -> DataFrame:
    """key, wide (places of the windows that nearly all distinct pages of the host have) for ``strings`` (key, host, start, tokens)."""
    found = strings.join(repeats, "tokens").select("key", "host", "start", "tokens", "first", "last")
    windows = common.stored(common.map_arrow(found, common.per_batch(_cutting, _RUNS), _RUNS), "runs")
    wide = often(windows.groupBy("host", "window").agg(F.count_distinct("key").alias("n")), hosts).select("host", "window")
    return windows.join(wide, ["host", "window"]).groupBy("key").agg(F.collect_set("at").alias("wide"))


def verdicts(rows: DataFrame) -> DataFrame:
    """key, spans, wide: what the search of the whole token streams of ``rows`` found, by the key of the page."""
    # As many shards of cells as there are tasks, so that a shard adds up about what one task gives.
    streaming = functools.partial(_streaming, shards=max(1, rows.rdd.getNumPartitions()))
    streams = common.stored(common.map_arrow(rows.select("url", "html"), common.per_batch(streaming, _STREAMS), _STREAMS), "streams")
    pages = streams.where("key is not null").select("key", "host", "strings")
    hosts = common.stored(pages.groupBy("host").agg(F.count_distinct("key").alias("pages")).where(F.col("pages") >= WIDE_PAGES), "hosts")
    inside = inside_strings(rows, streams, hosts)
    outside = pages.select("key", F.inline("strings"))
    if inside is not None:
        inside = inside.select("key", "host", F.inline("strings"))
    repeats = repeated_strings(outside if inside is None else outside.unionByName(inside.drop("host")))
    spans = outside.join(repeats, "tokens").select("key", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))
    spans = spans.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    if inside is None:
        return spans.withColumn("wide", F.lit(None).cast("array<int>"))
    return spans.join(wide_runs(inside, repeats, hosts), "key", "full")


def wide_blocks(blocks: list, host: int, places: list[int]) -> set[int]:
    """The names of the blocks that consist of windows at ``places`` alone."""
    if not places:
        return set()
    _, inside, edge = layout(blocks)
    last = max([edge, *(first + size for _, first, size in inside)])
    cover = np.zeros(last + 1, np.int64)
    np.add.at(cover, places, 1)
    np.add.at(cover, np.array(places) + RUN, -1)
    cover = np.cumsum(cover) > 0
    # A block that fills one window is that window; of longer ones the mark may be left over.
    return {block_name(host, blocks[number][2]) for number, first, size in inside if cover[first + (size > RUN):first + size].all()}


def main_text(blocks: list, host: int, key: bytes, spans: list[tuple[int, int]], wide: set[int]) -> tuple[str, int]:
    """(text, words in repeated runs) of one page."""
    places, _, edge = layout(blocks)
    gone = np.zeros(edge + 1, np.int64)
    for first, last in spans:
        if last <= edge:
            gone[first] += 1
            gone[last] -= 1
    gone = np.cumsum(gone)[:edge] > 0
    has_main, whole, unique, repeated = False, [], [], 0
    for zone, _, words in blocks:
        has_main |= zone == MAIN
    for number, first in places:
        zone, _, words = blocks[number]
        words = words.split(" ")
        out = gone[first:first + len(words)]
        repeated += int(out.sum())
        if zone == OPEN:
            left = [w for w, g in zip(words, out.tolist()) if not g]
            if left:
                unique.append((number, " ".join(left)))
            if block_name(host, blocks[number][2]) not in wide:
                whole.append((number, blocks[number][2]))
    if has_main:
        kept = [words for zone, _, words in blocks if zone == MAIN and block_name(host, words) not in wide]
    else:
        kept = [words for _, words in unique or whole]
    return "\n\n".join(kept), repeated


def _writing(part: dict[str, list]) -> dict[str, list]:
    out, unpack = {name: [] for name in _TEXTS.names}, zstandard.ZstdDecompressor()
    for page_id, url, key, host, packed, spans, wide in zip(*(part[n] for n in ("page_id", "url", "key", "host", "packed", "spans", "wide"))):
        blocks = json.loads(unpack.decompress(packed))
        text, repeated = main_text(blocks, host, key, [(s["first"], s["last"]) for s in spans or []], wide_blocks(blocks, host, wide or []))
        out["page_id"].append(page_id), out["url"].append(url), out["text"].append(text)
        out["n_chars"].append(len(text)), out["n_repeated"].append(repeated)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated (words outside the main zone in repeated runs) of every row of ``pages``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = common.stored(verdicts(rows), "verdicts")
    # Pages are read again: that costs less than keeping their blocks beside the exchange to the verdicts.
    judged = common.map_arrow(rows, common.per_batch(_packing, _PAGES), _PAGES).join(found, "key", "left")
    return common.map_arrow(judged, common.per_batch(_writing, _TEXTS), _TEXTS)


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))


SQL: dict[str, str] = {}
QUERIES = {"op12_main_text": op12_main_text}
