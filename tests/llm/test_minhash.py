import re

import numpy as np
import pyarrow as pa

from fleetlens.llm import minhash, queries, text
from fleetlens.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def shingles(t, size):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + min(size, len(w))]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, share):
    sets = {i: shingles(t, size) for i, t in rows}
    ids = sorted(sets)
    linked = [
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]
        if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= share * max(len(sets[a]), len(sets[b]))
        and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])
    ]
    comp = brute_components(ids, linked)
    return sorted((i, len(sets[i]), comp[i], comp[i] == i) for i in ids)


def test_words_follow_the_pattern_whatever_the_piece_size(monkeypatch):
    texts = ["a b", None, "", "  x\ty\n", "long" * 40 + " tail", "é ü\x0b\x0c\rz", "q", "   b"]
    for piece in (1, 3, 7, 1 << 20):
        monkeypatch.setattr(text, "PIECE_BYTES", piece)
        column = pa.array(["skipped words", *texts])[1:]
        hashes, at = text.word_hashes(*text.text_buffer(column))
        counts = [len(WORD.findall(t or "")) for t in texts]
        assert list(np.diff(at)) == counts and at[0] == 0
        seen = dict(zip([w for t in texts for w in WORD.findall(t or "")], hashes.tolist(), strict=True))
        assert len(set(seen.values())) == len(seen)


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 299), (299, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute_components({x for e in links for x in e}, links)
    assert got == {k: v for k, v in want.items() if k != v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_named_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op4_minhash_dedup(spark, SF).collect()))
    assert got == brute(rows, 3, 85)


def test_chained_copies_nulls_ties_and_repeated_rows(spark):
    base = [f"w{i}" for i in range(300)]
    rows = []
    for step in range(12):  # each a few words further from the first than the one before
        rows.append((50 - step, " ".join(f"x{i}" if i < 9 * step else w for i, w in enumerate(base))))
    rows += [(60, None), (61, ""), (62, " \n "), (63, "one two"), (64, "One  TWO"), (65, "one"), (66, "É a b c"), (67, "é a b c")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    got = sorted(map(tuple, minhash.near_duplicates(docs, size=3, share=85).collect()))
    assert got == brute(rows, 3, 85)
    twice = docs.unionAll(docs).unionAll(spark.createDataFrame([(None, "one two", None)], docs.schema))
    found = minhash.near_duplicates(twice, size=3, share=85)
    assert found.count() == 2 * len(rows) + 1
    assert found.where("id is null").collect()[0].asDict() == {"id": None, "n_shingles": 1, "component_id": None, "kept": True}
    stays = minhash.dedup_stage(docs, size=3, share=85)
    assert stays.columns == docs.columns
    assert sorted(r.doc_id for r in stays.collect()) == [r[0] for r in got if r[3]]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert minhash.dedup_stage(docs.limit(0)).count() == 0


def test_large_group_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "TASK_SHINGLES", 500)
    rng = np.random.Generator(np.random.PCG64(3))
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for p in rng.choice(120, int(rng.integers(0, 6)), replace=False):
            words[p] = f"e{rng.integers(1000)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(docs, size=3, share=85).collect())) == brute(rows, 3, 85)
