import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import mixing, queries

SF = "/root/testdata/sf0.01"


def brute_frame(shares):
    """Earliest deadline first, slot by slot."""
    total, done, out = sum(shares), [0] * len(shares), []
    for t in range(total):
        ready = [(-((-(d + 1) * total) // a), i) for i, (d, a) in enumerate(zip(done, shares, strict=True)) if d * total // a <= t]
        _, i = min(ready)
        done[i] += 1
        out.append(i)
    return out


@pytest.mark.parametrize("shares", [[1], [1, 1], [3, 2], [90, 9, 1], [7, 5, 3, 2, 2, 1], [13, 13, 13, 1]])
def test_frames_follow_the_rule_and_stay_within_one_block(spark, shares):
    weights = {f"s{i}": a for i, a in enumerate(shares)}
    shares = list(mixing.whole_weights(weights).values())
    got = [r.source_no for r in mixing.schedule(spark, weights).orderBy("slot").collect()]
    assert got == brute_frame(shares)
    done, total = [0] * len(shares), sum(shares)
    for t, i in enumerate(got, 1):
        done[i] += 1
        assert all(abs(d - Fraction(a * t, total)) < 1 for d, a in zip(done, shares, strict=True))
    assert done == shares


@pytest.mark.parametrize("shares", [[3, 2], [7, 5, 3, 2, 2, 1], [50, 3, 3, 1, 1, 1, 1]])
def test_halving_gives_the_same_frame(spark, monkeypatch, shares):
    monkeypatch.setattr(mixing, "FOLD_CELLS", 0)
    weights = {f"s{i:03d}": a for i, a in enumerate(shares)}
    shares = list(mixing.whole_weights(weights).values())
    got = mixing.schedule(spark, weights).orderBy("slot").collect()
    assert [r.source_no for r in got] == brute_frame(shares)
    for i, a in enumerate(shares):
        assert [r.nth for r in got if r.source_no == i] == list(range(a))


def test_five_thousand_sources_of_very_unequal_size(spark):
    rng = random.Random(5)
    sizes = {f"s{i:04d}": int(1.0009 ** (i * 1.3)) + rng.randrange(3) for i in range(5000)}
    table = spark.createDataFrame(list(sizes.items()), "source string, n int")
    docs = table.select("source", F.explode(F.sequence(F.lit(1), "n")).alias("i")).select(F.xxhash64("source", "i").alias("doc_id"), "source", F.lit("t").alias("text"))
    docs = docs.repartition(8)
    weights = mixing.tempered_weights(docs)
    shares = mixing.whole_weights(weights)
    total, root = sum(shares.values()), sum(n**0.5 for n in sizes.values())
    assert all(abs(shares[s] / total - n**0.5 / root) <= 0.06 / 5000 for s, n in sizes.items())
    frame = [r.source_no for r in mixing.schedule(spark, weights).orderBy("slot").collect()]
    done, names = [0] * len(shares), list(shares)
    assert len(frame) == total and sorted(frame) == [i for i, a in enumerate(shares.values()) for _ in range(a)]
    nth = [0] * len(shares)
    for t, i in enumerate(frame):
        a = shares[names[i]]
        assert nth[i] * total // a <= t < -(-(nth[i] + 1) * total // a)
        nth[i] += 1
    out = mixing.mix(docs, weights, block=2)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("\n") < 400
    stats = out.agg(F.count("*").alias("n"), F.count_distinct("position").alias("d"), F.max("position").alias("m")).first()
    assert stats.n == stats.d == stats.m + 1 == sum(sizes.values())


def brute(rows, weights, block):
    """(key, source, position) of rows in schedule order, given the places of rows in their sources."""
    shares = mixing.whole_weights(weights)
    frame, names = brute_frame(list(shares.values())), list(shares)
    left = {s: sorted((r.row_in_source, r.doc_id) for r in rows if r.source == s) for s in names}
    out, t = [], 0
    while any(left.values()):
        s = names[frame[t % len(frame)]]
        out += [(k, s, n) for n, (_, k) in enumerate(left[s][:block], len(out))]
        left[s] = left[s][block:]
        t += 1
    return sorted(out, key=repr)


def test_positions_equal_a_simulation(spark):
    rows = [(i, "abc"[(i * i) % 3 if i < 70 else 0], f"t{i}") for i in range(120)] + [(200, None, "x")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = {"a": 4, "b": 3, "c": 2, None: 2, "unused": 1}
    got = mixing.mix(docs, weights, block=3).collect()
    assert sorted(((r.doc_id, r.source, r.position) for r in got), key=repr) == brute(got, weights, 3)
    assert sorted(r.position for r in got) == list(range(125))
    for r in got:
        assert r.release <= r.slot < r.deadline
    order = sorted(got, key=lambda r: r.position)
    on = [r.on_target for r in order]
    assert on[0] and on == sorted(on, reverse=True)
    out = mixing.mixed(docs, weights, block=3)
    assert out.columns == docs.columns
    seen = [(r.doc_id, r.source) for r in out.collect() if r.source]
    assert seen == [(r.doc_id, r.source) for r in order if r.source] and out.count() == 125
    assert mixing.mix(docs.limit(0), weights).count() == 0 and mixing.mixed(docs.limit(0), weights).count() == 0


def test_unknown_sources_and_bad_weights_are_refused(spark):
    docs = spark.createDataFrame([(1, "z", "t")], "doc_id long, source string, text string")
    with pytest.raises(Exception, match="no weight for source z"):
        mixing.mix(docs, {"a": 1})
    for bad in ({}, {"a": 0}, {"a": 1 << 24, "b": 1}):
        with pytest.raises(ValueError):
            mixing.whole_weights(bad)


def test_named_query_keeps_every_row_within_one_block(spark):
    rows = queries.op3_pfair_mixing(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    assert sorted(r.position for r in rows) == list(range(len(rows)))
    weights = mixing.tempered_weights(docs)
    got = sorted((r.doc_id, r.source, r.position) for r in rows)
    assert got == sorted(brute(rows, weights, mixing.BLOCK))
