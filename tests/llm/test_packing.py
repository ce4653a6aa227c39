import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pulsemart.llm import packing as p


def expected_ids(text):
    tokenizer = Tokenizer.from_file(p.default_vocabulary())
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def check(docs, window):
    rows = p.pack(docs, window=window, with_ids=True).collect()
    texts = Counter((r.doc_id, tuple(expected_ids(r.text))) for r in docs.collect())
    by_window = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= window and zlib.crc32(r.ids) == r.ids_crc32
        by_window[r.sequence_id].append((r.offset, r.length))
    for parts in by_window.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    found = Counter()
    repeats = Counter((r.doc_id, r.start, r.ids) for r in rows)
    for (doc_id, ids), n in texts.items():
        for start in range(0, len(ids), window):
            found[doc_id, start, np.array(ids[start:start + window], "<u4").tobytes()] += n
    assert repeats == found
    return rows, by_window


def test_round_trip(odd):
    rows, by_window = check(odd, 64)
    padding = sum(64 - sum(n for _, n in parts) for parts in by_window.values())
    assert padding < 64 * 3


def test_odd_text_is_tokenised_as_a_whole():
    texts = ["Ａ ﬁ é e\u0301 don't\u00a0stop\x1cnow\u2003x <|endoftext|> ǅ İ Σς", "a\u0301 \u0301b", "word" * 500, "日本語 テキスト 123"]
    for text, ids in zip(texts, p.token_ids(texts, p.default_vocabulary())):
        assert np.frombuffer(ids, "<u4").tolist() + [1] == expected_ids(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAzé\u0301İßΣ'’.,!?*#%&|<>-1²_ \n\u00a0\x1c日", max_size=25), max_size=4))
def test_runs_are_tokenised_like_the_whole(texts):
    for text, ids in zip(texts, p.token_ids(texts, p.default_vocabulary())):
        assert np.frombuffer(ids, "<u4").tolist() + [1] == expected_ids(text), text


def test_special_tokens_keep_their_case():
    texts = ["<|ENDOFTEXT|> A", "b<|endoftext|>c D.", "<| Endoftext|>"]
    for text, ids in zip(texts, p.token_ids(texts, p.default_vocabulary())):
        assert np.frombuffer(ids, "<u4").tolist() + [1] == expected_ids(text)


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(p, "CACHED_WORDS", 3)
    texts = ["a b c d", "e f g h i", "a b"]
    for _ in range(2):
        for text, ids in zip(texts, p.token_ids(texts, p.default_vocabulary())):
            assert np.frombuffer(ids, "<u4").tolist() + [1] == expected_ids(text)


def test_empty(empty):
    assert p.pack(empty).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=5))
def test_fullest_is_the_best_with_the_largest(left):
    window = 12
    chosen = p.fullest(left, window)
    assert chosen[max(left)] >= 1 and all(c <= left[k] for k, c in chosen.items())
    rest = Counter(left) - Counter({max(left): 1})
    choices = itertools.product(*(range(n + 1) for n in rest.values()))
    best = max(t for t in (max(left) + sum(k * n for k, n in zip(rest, c)) for c in choices) if t <= window)
    assert sum(k * c for k, c in chosen.items()) == best


def test_slots_give_every_rank_one_place():
    rng = random.Random(2)
    counts = {k: rng.randint(1, 300) for k in range(1, 65)}
    places = defaultdict(list)
    for length, first, end, copies, window, offset in p.slots(counts, 64):
        for i in range(end - first):
            places[window + i // copies].append((offset + length * (i % copies), length))
    assert Counter(n for parts in places.values() for _, n in parts) == counts
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(k * n for k, n in counts.items()) > 0.93 * 64 * len(places)
