import hashlib
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from pulsemart.llm import substrings as s
from tests.llm.conftest import DOCS, WORDS, rows


def words_of(text):
    return (text or "").encode().split()


def brute(texts, window):
    seen = {}
    for d, text in enumerate(texts):
        w = words_of(text)
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i:i + window]), []).append((d, i))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + window))
    out = []
    for d, text in enumerate(texts):
        w = words_of(text)
        kept = b" ".join(w[i] for i in range(len(w)) if i not in gone[d])
        out.append((len(w), len(gone[d]), hashlib.sha256(kept).hexdigest()))
    return out


def texts_with_passages(seed, n=60):
    rng = random.Random(seed)
    passages = [[rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(rng.choice([30, 35, 36, 50, 90]))] for _ in range(6)]
    out = [None, "", "a " * 34, "a " * 36, "b " * 200, "A b " * 40]
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += [f"w{i}x{rng.randrange(10**6)}" for _ in range(rng.randint(0, 40))]
            p = rng.choice(passages)
            a = rng.randrange(3)
            parts += p[a:len(p) - rng.randrange(3)]
        out.append(" ".join(parts))
        if rng.random() < 0.2:
            out.append(out[-1])
    return out


def run(spark, texts, window=35):
    df = spark.createDataFrame(rows(texts), DOCS)
    return [tuple(r)[1:] for r in sorted(s.strip_repeats(df, window).collect())]


def test_equals_brute_force(spark):
    texts = texts_with_passages(1)
    assert run(spark, texts) == brute(texts, 35)


def test_hot_phrases_are_split_and_agree(spark, monkeypatch):
    monkeypatch.setattr(s, "HOT_SEGMENTS", 2)
    texts = texts_with_passages(2)
    assert run(spark, texts) == brute(texts, 35)


def test_odd_rows(odd):
    got = s.strip_repeats(odd, with_text=True).collect()
    assert len(got) == odd.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].n_words == 0 and by_id[0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_empty(empty):
    assert s.strip_repeats(empty).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=80))
def test_backward_search_counts_occurrences(values):
    text = np.array([v + 1 for v in values] + [0])
    index = s.FmIndex(text)
    assert (s.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:].tolist())).all()
    for n in (1, 2, 3):
        for i in range(len(values) - n + 1):
            low, high = np.array([0]), np.array([len(text)])
            for v in reversed(text[i:i + n]):
                low, high = index.extend(low, high, np.array([v]))
            assert high[0] - low[0] == sum((text[j:j + n] == text[i:i + n]).all() for j in range(len(values) - n + 1))


def test_segments_cover_each_window_once():
    rng = random.Random(4)
    for vocabulary in (2, 5, 500):
        words = [str(rng.randrange(vocabulary)).encode() for _ in range(400)]
        first, size, _ = s.segments(words)
        starts = [i for a, n in zip(first, size) for i in range(a, a + n - 34)]
        assert starts == list(range(400 - 34))
