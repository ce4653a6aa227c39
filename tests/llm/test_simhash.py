import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pulsemart.llm import common, simhash
from tests.llm.conftest import DOCS, rows


def brute_print(text, n=3):
    words = [w for w in "".join(c if c not in " \t\n\r\x0b\x0c" else " " for c in text or "").split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=2):
    parent = list(range(len(prints)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(len(prints))]


def test_equals_brute_force(odd):
    rows = sorted(((r.doc_id, r.text) for r in odd.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()))
    prints = [brute_print(t) for _, t in rows]
    expected = {rows[i][0]: (f"{prints[i]:016x}", rows[c][0]) for i, c in enumerate(brute_components(prints))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(odd.where("doc_id is not null")).collect()}
    assert got == expected
    assert len(set(c for _, c in got.values())) < len(got)


def test_null_ids_take_part(odd):
    assert simhash.simhash_groups(odd).count() == odd.count()


def test_empty(empty):
    assert simhash.simhash_groups(empty).collect() == []


def test_every_link_is_found(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1}
    for p in list(prints):
        for bits in (1, 2, 2, 3):
            q = p
            for b in rng.sample(range(64), bits):
                q ^= 1 << b
            prints.add(q)
    values = sorted(prints)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    for limit in (0, 1, 2, 3):
        expected = {
            tuple(sorted((signed[i], signed[j])))
            for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= limit
        }
        found = simhash.linked_prints(spark.createDataFrame([(v,) for v in signed], "fp long"), limit).collect()
        assert len(found) == len(expected) and {tuple(sorted(p)) for p in found} == expected


def test_replicas_are_never_broadcast(spark):
    prints = common.stored(spark.createDataFrame([(v,) for v in range(0, 4000, 7)], "fp long"), "prints")  # a file, so its size is known
    links = simhash.linked_prints(prints)
    assert links.count() > 0
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_code_covers_with_radius_three():
    words = np.random.default_rng(1).integers(0, 1 << 63, 3000, dtype=np.int64)
    rows, found = simhash.anchors(words, 0)
    assert rows.tolist() == list(range(3000))  # exactly one home
    for word, anchor in zip(words.tolist(), found.tolist()):
        for shift, part in ((0, anchor >> 23), (23, anchor & ((1 << 23) - 1))):
            assert ((word >> shift & ((1 << 23) - 1)) ^ part).bit_count() <= 3


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, j) for j in range(200, 260)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 5 for i in range(200, 260))
    assert got[301] == got[300] == 300 and 7 not in got


def test_one_of_each_group_stays(spark, odd):
    table = odd.unionByName(odd.where("doc_id < 3")).unionByName(odd.where("doc_id is null").withColumn("text", F.lit("no other")))
    data = [(r.doc_id, r.text) for r in table.collect()]
    top = brute_components([brute_print(t) for _, t in data])
    groups = {}
    for (doc_id, text), t in zip(data, top):
        groups.setdefault(t, set()).add((doc_id is None, doc_id, text))
    out = simhash.one_of_each(table)
    got = [(r.doc_id is None, r.doc_id, r.text) for r in out.collect()]
    assert out.columns == table.columns and len(got) == len(groups)
    for members in groups.values():
        least = min((a, b or 0) for a, b, _ in members)
        assert sum(g in members and (g[0], g[1] or 0) == least for g in got) == 1


def test_one_of_each_of_an_empty_table(empty):
    assert simhash.one_of_each(empty).collect() == []
