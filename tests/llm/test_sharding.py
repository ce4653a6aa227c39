import zlib
from collections import Counter

import numpy as np
import pytest

from pulsemart.llm import sharding as s


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 3)])
def test_curve_visits_every_cell_by_single_steps(n, bits):
    axes = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
    index = s.hilbert_index(axes, bits)
    assert sorted(index) == list(range(len(axes)))
    assert (np.abs(np.diff(axes[np.argsort(index)], axis=0)).sum(1) == 1).all()


def check(docs, result, shards):
    rows = result.collect()
    assert len(rows) == docs.count()
    wanted = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == wanted
    for shard in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in rows)
    return rows


def test_near_equal_bytes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = check(docs, s.hilbert_shards(docs, shards=4), 4)
    sizes, largest = Counter(), max(r.size for r in rows)
    for r in rows:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest + 2 * s.SNAP * sum(sizes.values()) / 4


def test_odd_rows(odd):
    check(odd, s.hilbert_shards(odd), 24)


def test_empty(empty):
    assert s.hilbert_shards(empty).collect() == []


def test_written_shards_keep_every_row(odd, tmp_path, spark):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    s.write_shards(docs, s.hilbert_shards(docs, shards=3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_written_shards_keep_null_and_repeated_ids(odd, tmp_path, spark):
    docs = odd.unionByName(odd.where("doc_id % 7 = 0")).unionByName(odd.where("doc_id is null"))
    s.write_shards(docs, s.hilbert_shards(docs, shards=3), str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(str, written.select(*docs.columns).collect())) == Counter(map(str, docs.collect()))
    slots = Counter((r.shard, r.slot) for r in written.select("shard", "slot").collect())
    assert max(slots.values()) == 1
