import corpus_pipeline
import pytest
import sentencepiece
from test_minhash import brute as brute_minhash
from test_mixing import brute as brute_mix
from test_quality import by_sql
from test_substring import brute as brute_substring

from fleetlens.llm import minhash, mixing, queries

SF = "/root/testdata/sf0.001"
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model_path())


def brute(rows):
    """(doc_id, words, ids) of what stays."""
    kept = {r["doc_id"] for r in by_sql(rows) if r["kept"]}
    rows = [r for r in rows if r[0] in kept]
    single = {r[0] for r in brute_minhash(rows, 5, 80) if r[3]}
    rows = [r for r in rows if r[0] in single]
    return {i: (n - gone, text) for i, n, gone, text in brute_substring(rows, 50)}


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    out = corpus_pipeline.run(spark, SF)
    assert set(docs.columns) < set(out.columns)
    got = out.collect()
    assert sorted(r.doc_id for r in got) == sorted(want) and len(got) < docs.count()
    for r in got:
        assert b" ".join(r.text.encode().split()).decode() == want[r.doc_id][1]
        assert list(r.ids) == LIBRARY.encode(r.text, add_eos=True) and r.n_tokens == len(r.ids) and r.round_trip
        assert r.n_chars == len(r.text)


@pytest.mark.parametrize("empty", [True, False])
def test_stages_keep_the_columns_and_take_odd_rows(spark, empty):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    prose = " ".join(f"Word{i} of the day" for i in range(20))
    rows = [(1, prose, "en", "a", 9), (1, prose, "en", "a", 9), (None, None, None, None, None), (2, "", None, None, 0), (None, prose + " x", None, None, None)]
    docs = spark.createDataFrame([] if empty else rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "sentencepiece" or out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    # Of the two equal rows one stays, and the row without key.
    assert docs.count() == (0 if empty else 2)


def test_rows_that_share_a_key_stay_or_go_by_their_own_texts(spark):
    words = [f"word{i}" for i in range(400)]
    first, near, clean = " ".join(words[:200]), " ".join(words[:199]) + " other", " ".join(words[200:])
    last = " ".join(f"last{i}" for i in range(50))
    rows = [(1, first, "a"), (2, near, "b"), (2, clean, "c"), (3, last, "d"), (3, last, "d"), (4, last + " x", "e"), (5, clean, "f"), (None, first, "g"), (6, "", "h"), (6, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = minhash.dedup_stage(docs)
    assert got.columns == docs.columns
    want = [(1, first, "a"), (2, clean, "c"), (3, last, "d"), (None, first, "g"), (6, "", "h"), (6, "", "h")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_parts_are_ordered_by_number():
    names = [f"part-{n:05d}-x.snappy.parquet" for n in (99999, 100000, 5, 1000000)]
    assert [n.split("-")[1] for n in sorted(names, key=mixing._part_number)] == ["00005", "99999", "100000", "1000000"]


def test_the_result_has_the_places_of_the_mix(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    rows = [(i, f"text {i}" + " more" * (i % 50), "big" if i % 8 else "mid" if i % 16 else "small") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    weights = mixing.tempered_weights(docs)
    numbers = mixing.mix(docs, weights).select("doc_id", "source", "row_in_source").collect()
    assert sorted((r.doc_id, r.source, r.mix_position) for r in got) == sorted(brute_mix(numbers, weights, mixing.BLOCK))
    assert sorted(r.mix_position for r in got) == list(range(3000))
