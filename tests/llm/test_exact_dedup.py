import hashlib
import random
from collections import defaultdict

from hypothesis import given, settings, strategies as st

from pulsemart.llm import exact_dedup as d


def brute(rows, pick):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = [i for i in groups[text or ""] if i is not None]
        owner = pick(ids) if ids else None
        out.append((doc_id, owner, len(groups[text or ""]), doc_id == owner, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for keep, pick in (("largest", max), ("smallest", min)):
        assert sorted(map(tuple, d.exact_groups(odd, keep).collect()), key=str) == brute(rows, pick)


def test_small_budget_spills_and_agrees(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, d.exact_groups(odd, trie_bytes=200).collect()), key=str) == brute(rows, max)


def test_empty(empty):
    assert d.exact_groups(empty).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=60), st.integers(1, 40))
def test_trie_holds_every_string(keys, budget):
    trie = d.Trie(lambda a, b: (a[0] + b[0],), budget)
    expected = defaultdict(int)
    for key in keys:
        trie.insert(key, (1,))
        expected[key] += 1
    items = list(trie.items())
    assert len(items) == len(expected) and {k: v[0] for k, v in items} == expected


def test_long_shared_prefixes_on_disk():
    rng = random.Random(1)
    keys = [b"x" * 5000 + bytes([rng.randrange(4) for _ in range(6)]) for _ in range(300)]
    trie = d.Trie(lambda a, b: (a[0] + b[0],), 100)
    for key in keys:
        trie.insert(key, (1,))
    assert sum(v[0] for _, v in trie.items()) == 300
