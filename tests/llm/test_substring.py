import hashlib
import re

import numpy as np
import pytest

from fleetlens.llm import queries, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def brute(rows, length):
    """(id, n_words, n_removed, kept words) of each row."""
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - length + 1) if i is not None else ():
            key = tuple(w[k : k + length])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - length + 1) if i is not None else ():
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = True
        out.append((i, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def cut(docs, length):
    got = substring.remove_repeats(docs, length=length, joined=True)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()), key=repr)


def test_automaton_finds_windows_of_smaller_owners():
    rng = np.random.Generator(np.random.PCG64(1))
    texts = [rng.integers(0, 3, int(rng.integers(1, 40))).tolist() for _ in range(25)]
    auto = substring.SuffixAutomaton()
    for i, t in enumerate(texts):
        auto.add(t, i)
    for length in (1, 3, 6):
        for i, t in enumerate(texts):
            seen = {tuple(x[k : k + length]) for x in texts[:i] for k in range(len(x) - length + 1)}
            want = [tuple(t[k : k + length]) in seen for k in range(len(t) - length + 1)]
            assert auto.matches(t, length, i).tolist() == want


def test_equal_windows_name_equal_anchors(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(2))
    words = rng.integers(0, 9, 900).astype(np.uint64)
    whole = substring.winnow(words, 10)
    assert whole[1][0] == 0 and whole[2][-1] == 890 and (whole[1][1:] == whole[2][:-1] + 1).all()
    names = np.repeat(whole[0], whole[2] - whole[1] + 1)
    for k in range(891):
        assert substring.winnow(words[k : k + 10], 10)[0].tolist() == [names[k]]
    monkeypatch.setattr(substring, "SPAN", 64)
    short = substring.winnow(words, 10)
    assert (np.repeat(short[0], short[2] - short[1] + 1) == names).all()


def test_named_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op5_substring_dedup(spark, SF).collect()))
    want = [(i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, n, gone, t in brute(rows, 50)]
    assert got == sorted(want) and any(r[2] for r in got)


@pytest.mark.parametrize("share", [1, 10, 10**9])
def test_frequent_anchors_do_not_change_the_result(spark, monkeypatch, share):
    monkeypatch.setattr(substring, "HOT_SHARE", share)
    passage = " ".join(f"p{j}" for j in range(25))
    rows = [(i, f"a{i} b{i} {passage} c{i}" if i % 3 else f"d{i} {passage} e{i} {passage}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert cut(docs, 10) == brute(rows, 10)


def test_distinct_windows_of_a_repetitive_text():
    words = np.tile(np.arange(7, dtype=np.uint64), 40)
    assert substring._distinct(words, [(0, 100), (150, 270)], 10) == [(0, 6)]
    words[170] = 99
    got = substring._distinct(words, [(0, 100), (150, 270)], 10)
    assert got == [(0, 6), (161, 170)]


@pytest.mark.parametrize("period", [10**9, 37])
def test_a_long_leader_is_cut_into_pieces(spark, monkeypatch, period):
    monkeypatch.setattr(substring, "SHARD_WORDS", 2000)
    monkeypatch.setattr(substring, "STREAM_WORDS", 3000)
    dealt, made = {}, substring._segments

    def seen(*args):
        table = made(*args).cache()
        for r in table.where("role = 0").collect():
            dealt[r.shard, r.part] = dealt.get((r.shard, r.part), 0) + len(r.words) // 8
        return table

    monkeypatch.setattr(substring, "_segments", seen)
    long = [f"w{j % period}" for j in range(20_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long)), (3, " ".join(["x"] + long[5_000:9_000] + ["y"] + long[8_990:9_020])), (4, " ".join(long[100:149]))]
    assert cut(spark.createDataFrame(rows, "doc_id long, text string"), 50) == brute(rows, 50)
    assert max(dealt.values()) <= 3 * 2000 and (len(dealt) > 5 or period == 37)


def test_shared_passages_small_shards_nulls_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_WORDS", 200)
    monkeypatch.setattr(substring, "STREAM_WORDS", 300)
    rng = np.random.Generator(np.random.PCG64(5))
    passages = [[f"p{k}w{j}" for j in range(30)] for k in range(4)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(rng.integers(0, 4)):
            words += [f"d{i}r{rng.integers(10**6)}" for _ in range(rng.integers(0, 15))]
            p = passages[rng.integers(4)]
            a, b = sorted(rng.integers(0, 31, 2).tolist())
            words += p[a:b]
        rows.append((int(i * 7 % 80), "  ".join(words)))
    rows += [(100, None), (101, ""), (102, " \n"), (103, rows[3][1]), (103, rows[3][1]), (103, rows[5][1]), (None, rows[4][1]), (104, "é " * 40)]
    docs = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, body int, spans string")
    assert cut(docs, 10) == brute(rows, 10)
    assert cut(docs.limit(0), 10) == []
    got = substring.substring_stage(docs, length=10)
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, " ".join(WORD.findall(r.text or ""))) for r in got.collect()), key=repr)
    assert kept == sorted(((i, t) for i, _, _, t in brute(rows, 10)), key=repr)
    assert {r.text for r in got.where("doc_id in (100, 101)").collect()} == {None, ""}
