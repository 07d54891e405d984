import math
import re
from collections import Counter

import numpy as np

from fleetlens.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, b.total()) for i, b in bags if b]
    n_docs, n_words = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        found = []
        for doc, bag, n in bags:
            m = 100 - 50 + 50 * n * n_docs // n_words
            weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(weight(t) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in own if t in bag)
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def ranked(spark, docs, items, top):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, terms string, cls int").repartition(3)
    q = spark.createDataFrame([(i, t, 2.0) for i, t in items], "item_id long, text string, score double")
    return sorted(map(tuple, lexical.search(d, q, top).select("item", "rank", "doc", "score").collect()), key=repr)


def corpus():
    rng = np.random.Generator(np.random.PCG64(8))
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "é", "日本", "A", "a"]
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=None))
    docs = [(int(i), text(int(rng.integers(1, 30)))) for i in rng.permutation(120)]
    # Copies, permuted copies, repeated keys, and texts that differ in words no item asks for.
    docs += [(500 - i, docs[3][1]) for i in range(70)] + [(600 + i, " ".join(sorted(docs[4][1].split()))) for i in range(9)]
    docs += [docs[5], docs[5], (None, docs[3][1]), (None, "w1 w2"), (700, None), (701, ""), (702, " .,; "), (703, "w1" + "-w2" * 5000)]
    items = [(i, text(6)) for i in range(12)] + [(3, "w1, W2!"), (50, None), (51, "unknown words"), (None, "w3 É"), (52, "w1 " * 9)]
    return docs, items


def test_ranking_equals_brute_force_with_copies_ties_and_nulls(spark):
    docs, items = corpus()
    for top in (1, 7, 50):
        assert ranked(spark, docs, items, top) == brute(docs, items, top)
    assert ranked(spark, [], items, 5) == [] and ranked(spark, docs, [], 5) == []
    assert ranked(spark, [(1, None)], items, 5) == []


def test_blocks_of_items_give_the_same_ranking(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 25)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 4)
    assert ranked(spark, docs, items, 9) == brute(docs, items, 9)


def test_words_of_long_texts_are_not_split(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(1))
    text = "".join(rng.choice(list("aB9é _-.\n"), 3000)) + "z" * 90 + " end"
    want = [t.encode() for t in terms(text)]
    for size in (1, 5, 64, 1 << 20):
        monkeypatch.setattr(lexical, "PIECE_BYTES", size)
        assert [w for part in lexical.words(text.encode()) for w in part] == want


def test_scores_stay_whole_beyond_doubles():
    block = lexical.Postings([0], {b"%d" % i: i for i in range(3000)}, [(i, 0) for i in range(3000)])
    block.weights[:] = 2**22 + np.arange(3000)
    tfs = np.arange(1, 3001) * 10**5
    got = block.scores(np.array([51]), np.array([0, 3000]), np.arange(3000), tfs)
    want = sum((2**22 + i) * (10**9 * t // (1000 * t + 20 * 51)) for i, t in enumerate(tfs.tolist()))
    assert int(got[0, 0]) == want > 2**53
