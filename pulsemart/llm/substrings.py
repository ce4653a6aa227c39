"""Repeated passages by FM-index: words covered by a window that occurs anywhere else.

Windows are routed to shards by content, so equal windows meet without comparing every document
with every shard. A window belongs to its smallest gram of ``GRAM`` words (by hash, the leftmost of
equals); consecutive windows with the same gram form a segment. Only segments whose gram occurs at
least twice go on. Equal segments are counted first: all of their windows repeat. The others are
indexed, with one copy of each repeated segment, in one compressed FM-index per shard: suffix array,
Burrows-Wheeler transform and a wavelet matrix of packed bits with rank directories. Each segment
streams through backward search, which gives for each of its ends the longest match that occurs
elsewhere too (its matching statistics); matches of a window's length or more are reported.

A gram whose distinct segments exceed ``HOT_SEGMENTS`` (a common phrase in ever new surroundings) is
split by whole windows, so it is never gathered in one task.

Defined results: words are runs of anything but ASCII blanks, unchanged; a null text has none; a
text shorter than a window keeps all words; the sha256 of no words is that of the empty string;
rows are told apart by id and text, so repeated rows count as occurrences and each gets a row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsemart.llm import common

WINDOW, GRAM = 35, 8
SHARD_WORDS = 400_000  # words of an index, about
HOT_SEGMENTS = 5_000

_SEGMENTS = pa.schema([("key", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("gram", pa.int64()), ("seg", pa.int64())])
_FETCHED = pa.schema([("key", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("mult", pa.int64()), ("gram", pa.int64()), ("body", pa.binary())])
_WINDOWS = pa.schema([("key", pa.int64()), ("start", pa.int32()), ("mult", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])
_SPANS = pa.schema([("key", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
_PACKED = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("blob", pa.binary())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _ends(words: list[bytes]) -> np.ndarray:
    """Where each word ends in the words joined by one blank."""
    return np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1


def segments(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, gram hash) of the runs of windows with the same smallest gram."""
    n = len(words)
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    grams = np.zeros(n - gram + 1, np.uint64)
    for i in range(gram):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashed[i:i + len(grams)]
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    grams ^= grams >> np.uint64(29)
    width, place = window - gram + 1, []
    for at in range(0, n - window + 1, 1 << 16):  # a long text in steps, to bound memory
        part = np.lib.stride_tricks.sliding_window_view(grams[at:at + (1 << 16) + width - 1], width)
        place.append(part.argmin(axis=1) + np.arange(at, at + len(part)))
    smallest = np.concatenate(place)
    first = np.flatnonzero(np.r_[True, smallest[1:] != smallest[:-1]])
    last = np.r_[first[1:], len(smallest)] - 1
    return first, last - first + window, grams[smallest[first]]


def _segment_rows(window: int):
    def run(parts):
        for part in parts:
            out = {f.name: [] for f in _SEGMENTS}
            for key, text in zip(part["key"], part["text"]):
                words = (text or "").encode().split()
                first, size, gram = segments(words, window)
                if not len(first):
                    continue
                line, ends = b" ".join(words), _ends(words)
                starts = np.r_[0, ends[:-1] + 1]
                cuts = zip(starts[first].tolist(), ends[first + size - 1].tolist())
                out["key"].append(np.full(len(first), key)), out["start"].append(first), out["n"].append(size)
                out["gram"].append(gram.view(np.int64))
                out["seg"].append(np.fromiter((xxhash.xxh3_64_intdigest(line[a:b]) for a, b in cuts), np.uint64, len(first)).view(np.int64))
            if out["key"]:
                yield {name: np.concatenate(values) for name, values in out.items()}

    return run


def _pack(part: dict[str, list]) -> dict[str, list]:
    squeeze = zstandard.ZstdCompressor(level=1)
    return {"key": part["key"], "doc_id": part["doc_id"], "blob": [squeeze.compress((t or "").encode()) for t in part["text"]]}


def _words(blob: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(blob).split()


def _fetch(part: dict[str, list]) -> dict[str, list]:
    out = {f.name: [] for f in _FETCHED}
    for key, blob, wanted in zip(part["key"], part["blob"], part["wanted"]):
        words = _words(blob)
        for w in wanted:
            out["key"].append(key), out["start"].append(w["start"]), out["n"].append(w["n"]), out["mult"].append(w["mult"])
            out["gram"].append(w["gram"]), out["body"].append(b" ".join(words[w["start"]:w["start"] + w["n"]]))
    return out


def _single_windows(window: int):
    def run(parts):
        for part in parts:
            out = {f.name: [] for f in _WINDOWS}
            for key, start, mult, body in zip(part["key"], part["start"], part["mult"], part["body"]):
                words = body.split()
                for i in range(len(words) - window + 1):
                    both = xxhash.xxh3_128_intdigest(b" ".join(words[i:i + window]))
                    out["key"].append(key), out["start"].append(start + i), out["mult"].append(mult)
                    out["high"].append((both >> 64) - (1 << 63)), out["low"].append((both & (1 << 64) - 1) - (1 << 63))
            yield out

    return run


class FmIndex:
    """A compressed full-text index over integers; ``text`` ends in a value that is smallest and unique."""

    def __init__(self, text: np.ndarray):
        order = suffix_array(text)
        bwt = text[order - 1]
        self.below = np.r_[0, np.cumsum(np.bincount(text))]  # symbols smaller than each symbol
        self.n, self.levels = len(text), []
        for bit in range(max(1, int(text.max()).bit_length()) - 1, -1, -1):
            ones = (bwt >> bit & 1).astype(bool)
            packed = np.packbits(np.r_[ones, np.zeros(-len(ones) % 64 + 64, bool)], bitorder="little").view("<u8")
            before = np.r_[0, np.cumsum(np.bitwise_count(packed))].astype(np.int64)
            self.levels.append((bit, packed, before, int((~ones).sum())))
            bwt = np.concatenate([bwt[~ones], bwt[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the first ``at`` places of the transform (wavelet walk)."""
        low, high = np.zeros_like(at), at
        for bit, packed, before, zeros in self.levels:
            ones_low, ones_high = _ones(packed, before, low), _ones(packed, before, high)
            up = (symbol >> bit & 1).astype(bool)
            low, high = np.where(up, zeros + ones_low, low - ones_low), np.where(up, zeros + ones_high, high - ones_high)
        return high - low

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the rows that continue with ``symbol`` on the left."""
        base, n = self.below[symbol], len(low)
        both = self.rank(np.r_[symbol, symbol], np.r_[low, high])
        return base + both[:n], base + both[n:]


def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    word, rest = at >> 6, (at & 63).astype(np.uint64)
    return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << rest) - np.uint64(1)))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling."""
    n, step = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[:n - step] = rank[step:] + 1
        pair = rank * (n + 1) + after
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        rank[order] = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


def matches(bodies: list[list[bytes]], stream: list[int], window: int) -> list[tuple[int, int, int]]:
    """(which, first word, words) of the longest matches of a window or more for each end of the streamed rows.

    A match is a run of words that occurs at least twice in the index, which holds all ``bodies``.
    """
    ids: dict[bytes, int] = {}
    m = len(bodies)
    coded = [np.fromiter((ids.setdefault(w, len(ids)) for w in body), np.int64, len(body)) + m + 1 for body in bodies]
    text = np.concatenate([part for i, body in enumerate(coded) for part in (body, [i + 1])] + [np.array([0])]).astype(np.int64)
    index = FmIndex(text)
    starts = np.cumsum([0] + [len(body) + 1 for body in coded])
    which = np.concatenate([np.full(len(coded[i]) - window + 1, i) for i in stream])
    end = np.concatenate([np.arange(window - 1, len(coded[i])) for i in stream])
    low, high = np.zeros(len(end), np.int64), np.full(len(end), index.n, np.int64)
    length, live = np.zeros(len(end), np.int64), np.arange(len(end))
    while len(live):
        symbol = text[starts[which[live]] + end[live] - length[live]]
        new_low, new_high = index.extend(low[live], high[live], symbol)
        good = new_high - new_low >= 2
        live = live[good]
        low[live], high[live] = new_low[good], new_high[good]
        length[live] += 1
        live = live[length[live] <= end[live]]
    found = np.flatnonzero(length >= window)
    return list(zip(which[found].tolist(), (end[found] - length[found] + 1).tolist(), length[found].tolist()))


def _search(window: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pydict()
        bodies = [body.split() for body in rows["body"]]
        stream = [i for i, mult in enumerate(rows["mult"]) if mult == 1]
        found = matches(bodies, stream, window) if stream else []
        return pa.table({
            "key": [rows["key"][i] for i, _, _ in found], "start": [rows["start"][i] + at for i, at, _ in found],
            "n": [n for _, _, n in found],
        }, schema=_SPANS)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.withColumn("key", F.xxhash64("doc_id", "text"))


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, start, n: runs of words, each covered by windows that occur elsewhere too.

    ``key`` tells rows apart: the hash of id and text.
    """
    rows = _keyed(docs)
    found = common.stored(common.map_arrow(rows.select("key", "text"), common.batches(_segment_rows(window), _SEGMENTS), _SEGMENTS), "segments")
    # Both sides of the joins on a gram are plain exchanges, so adaptive execution can split a common gram.
    twice = common.stored(found.groupBy("gram").agg(F.count("*").alias("uses")).where("uses > 1").select("gram"), "twice")
    shared = common.stored(found.join(twice, "gram", "left_semi"), "shared")
    counted = shared.groupBy("gram", "seg").agg(F.count("*").alias("mult"), F.min(F.struct("key", "start", "n")).alias("one"))
    counted = common.stored(counted.select("gram", "seg", "mult", "one.*"), "counted")
    sure = shared.join(counted.where("mult > 1").select("gram", "seg"), ["gram", "seg"], "left_semi").select("key", "start", "n")

    # Segments to index: those of a gram with several, of which at least one is met once only.
    grams = counted.groupBy("gram").agg(F.count("*").alias("kinds"), F.count_if(F.col("mult") == 1).alias("singles"))
    grams = common.stored(grams.where("kinds > 1 AND singles > 0").drop("singles"), "grams")
    wanted = common.stored(counted.join(grams, "gram").drop("seg"), "wanted")
    per_text = wanted.groupBy("key").agg(F.collect_list(F.struct("start", "n", "mult", "gram")).alias("wanted"))
    fetched = _packed(docs).join(per_text, "key").dropDuplicates(["key"]).select("key", "blob", "wanted")
    bodies = common.stored(common.map_arrow(fetched, common.per_batch(_fetch, _FETCHED), _FETCHED), "bodies")
    n_words = wanted.agg(F.sum("n")).first()[0] or 0
    hot = wanted.where(F.col("kinds") > HOT_SEGMENTS).select("gram").distinct()
    cool = bodies.join(hot, "gram", "left_anti").withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(1 + n_words // SHARD_WORDS)))
    searched = cool.groupBy("shard").applyInArrow(_search(window), common.ddl(_SPANS))

    single = common.map_arrow(bodies.join(hot, "gram", "left_semi").select("key", "start", "mult", "body"), common.batches(_single_windows(window), _WINDOWS), _WINDOWS)
    again = single.groupBy("high", "low").agg(F.sum("mult").alias("uses")).where("uses > 1")
    split = single.where("mult = 1").join(again, ["high", "low"], "left_semi").select("key", "start", F.lit(window).alias("n"))
    return sure.unionByName(searched).unionByName(split)


def _packed(docs: DataFrame) -> DataFrame:
    """Texts as compressed bytes: about half of what a shuffle would write otherwise."""
    return common.map_arrow(_keyed(docs), common.per_batch(_pack, _PACKED), _PACKED)


def _strip(with_text: bool):
    def run(part: dict[str, list]) -> dict[str, list]:
        out = {f.name: [] for f in _KEPT}
        for doc_id, blob, spans in zip(part["doc_id"], part["blob"], part["spans"]):
            words = _words(blob)
            gone = np.zeros(len(words) + 1, np.int64)
            if spans:
                start = np.array([s["start"] for s in spans])
                np.add.at(gone, start, 1)
                np.add.at(gone, start + np.array([s["n"] for s in spans]), -1)
            kept = np.cumsum(gone)[:-1] == 0
            text = b" ".join(words[i] for i in np.flatnonzero(kept)) if spans else b" ".join(words)
            out["doc_id"].append(doc_id), out["n_words"].append(len(words)), out["n_removed"].append(int((~kept).sum()))
            out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
            out["kept_text"].append(text.decode() if with_text else None)
        return out

    return run


def strip_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row; ``with_text`` adds the words that stay."""
    spans = repeated_spans(docs, window).groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    joined = _packed(docs).join(spans, "key", "left").select("doc_id", "blob", "spans")
    kept = common.map_arrow(joined, common.per_batch(_strip(with_text), _KEPT), _KEPT)
    return kept if with_text else kept.drop("kept_text")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_repeats(common.table(spark, sf_dir, "documents"))


SQL = {
    "op4_substrings": r"""
        WITH texts AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), windows AS (
            SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS h
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM texts WHERE len(words) >= 35)
        ), again AS (
            SELECT h FROM windows GROUP BY h HAVING count(*) > 1
        ), gone AS (
            SELECT DISTINCT doc_id, i + unnest(range(0, 35)) AS i FROM windows SEMI JOIN again USING (h)
        ), each AS (
            SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM texts
        ), kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
        ), removed AS (
            SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(removed.n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
        FROM texts LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
}
QUERIES = {"op4_substrings": op4_substrings}
