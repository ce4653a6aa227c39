"""Packing by minimum bin slack over the lengths that remain.

Every text is tokenised in full and cut into whole windows and one remainder. How many remainders
there are of each length is a table of at most ``window`` rows, whatever the corpus; on it, a bitset
subset-sum over the remaining counts picks the multiset of lengths that fills a window closest to
its capacity, the largest remaining length included, and the multiset is used as often as the
counts allow. Pieces then find their place by their rank among the pieces of the same length. The
ranks come from per-partition counts, so a length that a third of all pieces have is never sorted
in one task.

A window that is not full is padded, unless its fill is a power of two.

Defined results: a null text is an empty one and yields its end token alone; a null id is kept as
null; repeated rows are packed like any other; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from pulsemart.llm import common

WINDOW, END = 2048, 1
PART_ROWS = 1_000_000  # pieces of one length that are numbered together, at most about
CACHED_WORDS = 800_000  # distinct words whose ids a worker keeps; beyond them it starts anew
MARKS = b".,;:!?*#$%&|"

_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()),
])
_WITH_IDS = _PIECES.append(pa.field("ids", pa.binary()))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def _tokenizer(path: str):
    """The tokenizer, which ids end a word, and the ids of the words met so far."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    return tokenizer, ends, {}


def token_ids(texts: list[str | None], path: str) -> list[bytes]:
    """The ids of each text as little-endian 32-bit integers.

    The vocabulary lower-cases and never joins text across blanks, so each run without ASCII blanks
    is looked up, in lower case, among those already tokenised; only new ones go through the tokenizer.
    """
    tokenizer, ends, known = _tokenizer(path)
    words = [_runs((text or "").encode()) for text in texts]
    new = {w for row in words for w in row if w not in known}
    if len(known) + len(new) > CACHED_WORDS:
        known.clear()
        new = set().union(*words)
    _learn(new, tokenizer, ends, known)
    return [b"".join(map(known.__getitem__, row)) for row in words]


def _runs(raw: bytes) -> list[bytes]:
    return raw.split() if b"<|" in raw else raw.lower().split()  # special tokens are matched before lower-casing


def _letters(word: bytes) -> bool:
    text = word.decode()
    return text.isalpha() and text.lower().isalpha()


def _learn(new: set[bytes], tokenizer, ends: np.ndarray, known: dict[bytes, bytes]) -> None:
    """Adds the ids of new runs. Letters followed by marks are two tokens to the vocabulary and are learned apart.

    Runs of letters are tokenised many at a time; each is one word there, so its ids end with the
    first id that ends a word.
    """
    cut, need = {}, set()
    for run in new:
        head = run.rstrip(MARKS)
        if head and len(head) < len(run) and _letters(head):
            cut[run] = head, run[len(head):]
            need.update(cut[run])
        else:
            need.add(run)
    need = need.difference(known)
    single = []
    words = [run for run in need if _letters(run)]
    for some in common.chunked(words, 1000):
        ids = np.array(tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False).ids, "<u4")
        last = np.flatnonzero(ends[ids]) + 1
        if len(last) != len(some):
            single += some
            continue
        packed = ids.tobytes()
        known.update(zip(some, (packed[4 * a:4 * b] for a, b in zip([0, *last[:-1].tolist()], last.tolist()))))
    single += need.difference(words)
    for some in common.chunked(single, 10_000):
        for run, found in zip(some, tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
            known[run] = np.array(found.ids, "<u4").tobytes()
    for run, (head, tail) in cut.items():
        known[run] = known[head] + known[tail]


def _cut(path: str, window: int, end: int, with_ids: bool):
    tail = int(end).to_bytes(4, "little")

    def run(parts):
        for part in parts:
            for at in range(0, len(part["text"]), 256):
                yield cut(part["doc_id"][at:at + 256], part["text"][at:at + 256])

    def cut(ids, texts):
        out = {f.name: [] for f in _WITH_IDS}
        for doc_id, tokens in zip(ids, token_ids(texts, path)):
            tokens += tail
            n = len(tokens) // 4
            for start in range(0, n, window):
                piece = tokens[4 * start:4 * (start + window)]
                out["doc_id"].append(doc_id), out["start"].append(start), out["length"].append(len(piece) // 4)
                out["ids_crc32"].append(zlib.crc32(piece)), out["doc_tokens"].append(n)
                out["ids"].append(piece if with_ids else None)
        return out

    return run


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """Whole windows and one remainder of every text."""
    schema = _WITH_IDS if with_ids else _PIECES
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.map_arrow(rows, common.batches(_cut(vocabulary, window, end, with_ids), schema), schema)


def fullest(left: dict[int, int], window: int) -> Counter:
    """The multiset of remaining lengths, the largest included, that fills a window closest to capacity.

    Bit s of a state is set if some choice from the lengths seen so far adds up to s. Counts enter
    as powers of two and a rest, so a length with many pieces takes few steps; the choice is read
    back through the kept states.
    """
    largest = max(left)
    room = window - largest
    states, steps, full = [1], [], (1 << room + 1) - 1
    for length in sorted(left, reverse=True):
        free = min(left[length] - (length == largest), room // length)
        take = 1
        while free > 0 and not states[-1] >> room & 1:
            copies = min(take, free)
            states.append((states[-1] | states[-1] << length * copies) & full)
            steps.append((length, copies))
            free, take = free - copies, take * 2
        if states[-1] >> room & 1:
            break
    fill = states[-1].bit_length() - 1
    chosen = Counter({largest: 1})
    for i in range(len(steps), 0, -1):
        if not states[i - 1] >> fill & 1:
            length, copies = steps[i - 1]
            chosen[length] += copies
            fill -= length * copies
    return chosen


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, Counter]]:
    """(how often, multiset of lengths) until every piece has its place."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        chosen = fullest(left, window)
        times = min(left[k] // c for k, c in chosen.items())
        out.append((times, chosen))
        for k, c in chosen.items():
            left[k] -= times * c
            if not left[k]:
                del left[k]
    return out


def slots(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies in a window, first window, offset in it).

    Ranks first .. end - 1 of the length fill consecutive windows, ``copies`` in each.
    """
    out, used, first = [], Counter(), 0
    for times, chosen in plan(counts, window):
        offset = 0
        for length, copies in sorted(chosen.items(), reverse=True):
            out.append((length, used[length], used[length] + times * copies, copies, first, offset))
            used[length] += times * copies
            offset += length * copies
        first += times
    return out


def _ranked(rows: DataFrame, n_rows: int) -> DataFrame:
    """Adds the rank (from 0) among the rows of the same length, in no stated order; no task sees a whole length.

    Rows are numbered within (length, part), a part being one of many by id hash; the rows before
    a part come from a table with one row per length and part.
    """
    n_parts = F.lit(64 + n_rows // PART_ROWS)
    parts = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), n_parts))
    sizes = parts.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sizes.select(
        "length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")
    )
    local = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    return parts.withColumn("local", local).join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("local"))


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and its offset there; ``with_ids`` adds the ids themselves."""
    spark = docs.sparkSession
    cut = common.stored(pieces(docs, vocabulary or default_vocabulary(), window, end, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``window`` rows
    places = spark.createDataFrame(
        slots(counts, window),
        "length int, first_rank long, end_rank long, copies int, first_window long, first_offset int",
    )
    # Ranges of ranks of one length do not overlap; they are found by the position of the rank in
    # the sorted list of first ranks, one row per length.
    ranges = places.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first_rank", "copies", "first_window", "first_offset"))).alias("ranges"))
    placed = _ranked(cut, sum(counts.values())).join(F.broadcast(ranges), "length")  # at most ``window`` rows
    hit = F.element_at(F.filter("ranges", lambda r: r["first_rank"] <= F.col("rank")), -1)
    return (
        placed.withColumn("hit", hit).withColumn("within", F.col("rank") - F.col("hit.first_rank"))
        .select(
            "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
            (F.col("hit.first_window") + F.floor(F.col("within") / F.col("hit.copies"))).alias("sequence_id"),
            (F.col("hit.first_offset") + F.col("length") * F.pmod("within", F.col("hit.copies"))).cast("long").alias("offset"),
            *(["ids"] if with_ids else []),
        )
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op5_packing": op5_packing}
