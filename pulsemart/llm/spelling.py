"""Spelling variants: words one edit apart, found with asymmetric q-chunks.

Of two words one edit apart the shorter (of equal ones: either) is cut into two disjoint chunks, and
one edit leaves at least one of them whole in the other word, moved by one place at most. So the one
side contributes its two chunks, the other the positional grams that can be such a chunk, that is of
its length and within one place of its start, and a join on (length of the chunked word, chunk
number, gram) finds every pair; the edit distance decides.

A chunk that very many words share ("inter", "ungen") would pair all of them. Such a key is
lengthened: with the chunk fixed, the rest of the chunked word and of the other differ by the one
edit, so the words meet on the rest with one place left open (replaced) or taken out (inserted),
and a lengthened key is shared by one word for each letter at most. No key is capped and no pair is
lost.

The words are counted per task first, so a frequent word crosses the network once per task. A
variant's form is its near word of largest count, if that is large enough; counts grow along a chain
of forms by that factor, so the roots are found in a few rounds of following forms twice as far.

Defined results: a null text has no words; a null id counts as no characters in front of the colon;
repeated rows count again; words of any length are handled; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsemart.llm import common

UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
HELD = 200_000  # words a task counts before it hands them on
COMMON_PAIRS = 256  # pairs of one key above which the key is lengthened
OUT_ROWS = 20_000  # of one Arrow batch handed back to Spark
REPLACED, WHOLE, TAKEN = 0, 1, 2  # kinds of a lengthened key: a place left open; the shorter word; a place taken out

_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_KEYS = pa.schema([
    ("word", pa.string()), ("n", pa.int64()), ("key", pa.int64()), ("chunk", pa.bool_()), ("longer", pa.bool_()),
    ("first", pa.int32()), ("last", pa.int32()),
])
_OPEN = pa.schema([("word", pa.string()), ("n", pa.int64()), ("name", pa.int64()), ("kind", pa.int32())])


def spelled(before: int, run: str, typos: int) -> str:
    """The run, without one letter where ``typos`` divides its checksum; ``before``: the checksum of the id and a colon."""
    h = zlib.crc32(run.encode(), before)
    if h % typos:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _counting(typos: int, shortest: int):
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{shortest},}}")  # a letter can only be lost, so shorter runs never count

    def run(parts):
        held: Counter[str] = Counter()
        for part in parts:
            for doc_id, text in zip(part["doc_id"], part["text"]):
                before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(runs.findall((text or "").translate(UPPER))).items():
                    word = spelled(before, word, typos)
                    if len(word) >= shortest:
                        held[word] += n
                if len(held) >= HELD:
                    yield {"word": list(held), "n": list(held.values())}
                    held.clear()
        yield {"word": list(held), "n": list(held.values())}

    return run


def word_counts(docs: DataFrame, typos: int = 199, shortest: int = 6, least: int = 5) -> DataFrame:
    """word, n of every word of at least ``shortest`` letters that occurs ``least`` times or more."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = common.map_arrow(rows, common.batches(_counting(typos, shortest), _COUNTS), _COUNTS)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def cut(length: int) -> int:
    """Where a word of this length is cut into its two chunks."""
    return (length + 1) // 2


def _name(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text, seed) - (1 << 63)


def chunk_keys(word: str) -> list[tuple[int, int, int]]:
    """(key, first, last) of the two disjoint chunks; a key holds the length of the word, the number and the chunk."""
    h, n = cut(len(word)), len(word)
    return [(_name(f"{n}.0.{word[:h]}"), 0, h), (_name(f"{n}.1.{word[h:]}"), h, n)]


def gram_keys(word: str) -> list[tuple[int, bool, int, int]]:
    """(key, longer, first, last) of the positional grams that can be a chunk, within one place of it, of a word as long
    or, where ``longer``, one shorter."""
    keys = []
    for length in (len(word), len(word) - 1):
        h = cut(length)
        for number, (start, end) in enumerate(((0, h), (h, length))):
            for at in range(max(0, start - 1), min(start + 1, len(word) - (end - start)) + 1):
                keys.append((_name(f"{length}.{number}.{word[at:at + end - start]}"), length < len(word), at, at + end - start))
    return keys


def _keyed(parts):
    rows = []
    for part in parts:
        for word, n in zip(part["word"], part["n"]):
            rows += [(word, n, key, True, False, a, b) for key, a, b in chunk_keys(word)]
            rows += [(word, n, key, False, longer, a, b) for key, longer, a, b in gram_keys(word)]
            if len(rows) >= OUT_ROWS:
                yield _columns(_KEYS, rows)
                rows = []
    yield _columns(_KEYS, rows)


def _columns(schema: pa.Schema, rows: list[tuple]) -> dict[str, list]:
    return dict(zip(schema.names, map(list, zip(*rows)))) if rows else {name: [] for name in schema.names}


def _ends(word: str) -> tuple[list[int], list[int]]:
    """Digests of every beginning and of every end of the word, shortest beginning and longest end first; linear."""
    out = []
    for letters in (word, reversed(word)):
        digest = xxhash.xxh64()
        found = [digest.intdigest()]
        for c in letters:
            digest.update(c)
            found.append(digest.intdigest())
        out.append(found)
    return out[0], out[1][::-1]


def lengthened(word: str, kind: int, places) -> list[int]:
    """Names of the word with each of ``places`` left open or taken out, or of the word cut there (``WHOLE``)."""
    heads, tails = _ends(word)
    if kind == REPLACED:
        return [_name(f"{heads[i]},{i},{tails[i + 1]}") for i in places]
    if kind == TAKEN:
        return [_name(f"{heads[i]},{tails[i + 1]}", 1) for i in places]
    return [_name(f"{heads[i]},{tails[i]}", 1) for i in places]


def _lengthening(parts):
    rows = []
    for part in parts:
        for word, n, spans in zip(part["word"], part["n"], part["spans"]):
            places = {REPLACED: set(), WHOLE: set(), TAKEN: set()}
            for span in spans:
                outside = {*range(span["first"]), *range(span["last"], len(word))}
                if not span["longer"]:
                    places[REPLACED] |= outside
                if span["chunk"]:
                    places[WHOLE] |= {*range(span["first"] + 1), *range(span["last"], len(word) + 1)}
                if span["longer"]:
                    places[TAKEN] |= outside
            for kind, some in places.items():
                rows += [(word, n, name, kind) for name in lengthened(word, kind, sorted(some))]
            if len(rows) >= OUT_ROWS:
                yield _columns(_OPEN, rows)
                rows = []
    yield _columns(_OPEN, rows)


def near_pairs(words: DataFrame, common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """word, n, other, other_n: every ordered pair of words of ``words`` (word, n) exactly one edit apart."""
    keyed = common.stored(common.map_arrow(words.select("word", "n"), common.batches(_keyed, _KEYS), _KEYS), "keys")
    sizes = keyed.groupBy("key").agg(F.count_if("chunk").alias("x"), F.count_if(~F.col("chunk")).alias("y"))
    # A word alone has its chunk and its gram at a key.
    sizes = sizes.where("x > 0 and x + y > 2").select("key", (F.col("x") * F.col("y") > common_pairs).alias("common"))
    shared = keyed.join(common.stored(sizes, "key-sizes"), "key")

    def sides(x: str, y: str):
        """The members of a group on either side; a group is bounded in size."""
        member = F.struct("word", "n", *(["kind"] if "kind" in x else []))
        return F.collect_list(F.when(F.expr(x), member)).alias("xs"), F.collect_list(F.when(F.expr(y), member)).alias("ys")

    def paired(groups: DataFrame, meets) -> DataFrame:
        both = groups.select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y"))
        both = both.where(meets & (F.levenshtein("x.word", "y.word", 1) == 1))
        return both.select(F.col("x.word").alias("word"), F.col("x.n").alias("n"), F.col("y.word").alias("other"), F.col("y.n").alias("other_n"))

    short = F.char_length("x.word") < F.char_length("y.word")
    rare = shared.where("not common").groupBy("key").agg(*sides("chunk", "not chunk"))
    pairs = paired(rare, short | (F.col("x.word") < F.col("y.word")))

    spans = shared.where("common").groupBy("word", "n").agg(F.collect_list(F.struct("chunk", "longer", "first", "last")).alias("spans"))
    names = common.map_arrow(spans, common.batches(_lengthening, _OPEN), _OPEN).groupBy("name")
    names = names.agg(*sides(f"kind <> {TAKEN}", f"kind <> {WHOLE}")).where("size(xs) > 0 and size(ys) > 0 and (size(xs) > 1 or xs[0].kind <> ys[0].kind)")
    once = f"(x.kind = {REPLACED} and y.kind = {REPLACED} and x.word < y.word) or (x.kind = {WHOLE} and y.kind = {TAKEN})"
    pairs = pairs.unionByName(paired(names, F.expr(once))).distinct()
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def variants(words: DataFrame, factor: int = 5, common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``words`` (word, n)."""
    best = near_pairs(words, common_pairs)
    best = best.groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"),
    ).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    joined = words.join(best, "word", "left")
    holds = F.coalesce(F.col("form_n") >= factor * F.col("n"), F.lit(False))
    named = common.stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(holds, F.col("form")).alias("form"), F.when(holds, F.col("form_n")).alias("form_n"),
    ), "forms")
    roots = common.stored(followed(named.where("form is not null").select("word", F.col("form").alias("root"))), "roots")
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def followed(steps: DataFrame) -> DataFrame:
    """word, root: where the chain of ``steps`` (word, root) ends; each round follows all chains twice as far."""
    steps = common.stored(steps, "chain")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not steps.join(onward, "root", "left_semi").limit(1).collect():
            return steps
        steps = common.stored(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "chain")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = common.stored(word_counts(common.table(spark, sf_dir, "documents")), "words")
    return variants(words)


SQL: dict[str, str] = {}
QUERIES = {"op13_spelling_variants": op13_spelling_variants}
