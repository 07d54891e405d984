import zlib

import numpy as np
import pytest

from fleetlens.llm import numbering, queries, sharding

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation_is_one_and_has_an_inverse(n):
    p = sharding.permute(np.arange(n), n, seed=9)
    assert sorted(p.tolist()) == list(range(n))
    assert (sharding.permute(p, n, seed=9, back=True) == np.arange(n)).all()
    if n > 60:
        assert (p != sharding.permute(np.arange(n), n, seed=10)).any()
        assert abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.3


def test_numbers_are_gapless_and_do_not_depend_on_storage(spark, monkeypatch):
    monkeypatch.setattr(numbering, "BUCKET_ROWS", 7)
    rows = [(i % 50 if i % 9 else None, f"g{i % 3}" if i % 7 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "a long, g string")
    one = sorted(map(tuple, numbering.numbered(df.repartition(5), "n", ["a"]).collect()), key=repr)
    two = sorted(map(tuple, numbering.numbered(df.orderBy("a").coalesce(1), "n", ["a"]).collect()), key=repr)
    assert one == two and sorted(r[2] for r in one) == list(range(400))
    groups = {}
    for a, g, n in numbering.numbered(df, "n", ["a"], within=["g"]).collect():
        groups.setdefault(g, []).append(n)
    assert len(groups) == 4 and all(sorted(v) == list(range(len(v))) for v in groups.values())
    assert numbering.numbered(df.limit(0), "n", ["a"]).count() == 0


def check(docs, out, shards):
    want = {(d.doc_id, d.text) for d in docs}
    assert len(out) == len(docs)
    crc = {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in want}
    assert {(r.doc_id, r.size, r.text_crc32) for r in out} == crc
    for s in range(shards):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(docs) / shards) < 1


def test_named_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    out = queries.op2_sharding(spark, SF)
    rows = out.collect()
    check(docs, rows, 8)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op2_sharding(spark, SF).collect()))
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_nulls_copies_and_clashing_names(spark):
    rows = [(1, "a", 1)] * 30 + [(None, "é", 2), (None, None, 3), (2, None, 4), (3, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    check(docs.collect(), sharding.shard_rows(docs, 4).collect(), 4)
    assert sharding.shard_rows(docs.limit(0)).count() == 0


MASK = (1 << 64) - 1


def place_of(number, n, seed=0):
    """The Feistel place of one number, in plain integers."""
    half = 1
    while 1 << (2 * half) < n:
        half += 1
    low = (1 << half) - 1
    while True:
        left, right = number >> half, number & low
        for r in range(6):
            x = (right + seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xC2B2AE3D27D4EB4F) & MASK
            for _ in range(2):
                x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & MASK
            left, right = right, left ^ (x ^ (x >> 32)) & low
        number = left << half | right
        if number < n:
            return number


@pytest.mark.parametrize("seed", [0, 2024])
def test_shards_and_slots_follow_from_row_numbers_alone(spark, seed):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sharding.shard_rows(docs, 8, seed).collect()
    n = len(rows)
    assert sorted(r.row_number for r in rows) == list(range(n))
    for r in rows:
        place = place_of(r.row_number, n, seed)
        assert (r.place, r.shard, r.slot) == (place, place % 8, place // 8)
    if seed == 2024:
        named = {(r.doc_id, r.shard, r.slot) for r in queries.op2_sharding(spark, SF).collect()}
        assert named == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_very_long_texts(spark):
    rows = [(i, "é" * (1_000_000 * (i % 2) + i)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs.collect(), sharding.shard_rows(docs, 4).collect(), 4)
