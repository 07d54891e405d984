import re

import duckdb
import pytest

from fleetlens.llm import quality, queries, sql

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule_bits"]


def by_sql(rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    cursor = con.execute(sql.OP9)
    names = [d[0] for d in cursor.description]
    return [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]


def brute_repeats(words):
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered.update(p + k for p in places for k in range(8))
    return len(covered)


TEXTS = [
    None, "", "\n \n", "one two", "a b c d e f g h " * 5, " ".join(f"w{i}" for i in range(30)), "x " * 21, "A B " * 30 + "q",
    "- one\n- two\n- two\n\n- two \n" * 4, "wait...\nso…\nno. ..\n" * 9, "# $ % & | < > *" * 9, "12 345 6 " * 30, "é ü\x0bß\x0cÅ\x85  z " * 12,
    "SHOUT " * 25, " ".join(f"r{i % 13}" for i in range(60)), "long" * 300 + " word " * 25, "•\tone\n" * 22, "\tlead and trail \n" * 6,
]


def test_odd_texts_equal_sql_and_brute_force(spark):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in quality.apply_policy(quality.ledger(docs)).collect()}
    for want in by_sql(rows):
        mine = got[want["doc_id"]]
        assert {m: mine[m] for m in MEASURES} == {m: want[m] for m in MEASURES}, TEXTS[want["doc_id"]]
    for i, t in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        assert (got[i].n_words, got[i].n_repeat_words) == (len(words), brute_repeats(words))
    twice = quality.ledger(docs.unionAll(docs))
    assert twice.count() == 2 * len(TEXTS) and quality.ledger(docs.limit(0)).count() == 0


@pytest.mark.parametrize("policy", list(quality.POLICIES))
def test_policies_and_ablations_follow_from_the_bits(spark, policy):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = quality.ledger(docs)
    bits = [r.rule_bits for r in rows.collect()]
    mask = quality.mask(quality.POLICIES[policy])
    for r in quality.ablations(rows).where(f"policy = '{policy}'").collect():
        one = quality.mask([r.rule])
        assert (r.n_docs, r.n_failed) == (len(bits), sum(1 for b in bits if b & one))
        assert (r.n_kept, r.n_only) == (sum(1 for b in bits if not b & mask), sum(1 for b in bits if b & mask == one))
    kept = quality.quality_stage(docs, policy)
    assert kept.columns == docs.columns and kept.count() == sum(1 for b in bits if not b & mask)
    clash = docs.withColumn("_row", docs.doc_id).withColumn("_body", docs.text)
    assert quality.quality_stage(clash, policy).count() == kept.count()


def test_ledger_plan_stays_in_the_jvm_without_a_shuffle(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    plan = quality.quality_stage(docs)._jdf.queryExecution().executedPlan().toString()
    plan += quality.apply_policy(quality.ledger(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_the_stage_stores_its_ledger(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, -1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words long, rule_bits string")
    tables, write = [], quality.staged
    monkeypatch.setattr(quality, "staged", lambda rows, label: tables.append((label, write(rows, label))) or tables[-1][1])
    kept = quality.quality_stage(docs)
    (label, stored), = tables
    assert label == "quality-ledger" and stored.count() == len(TEXTS) and set(quality.MEASUREMENTS) < set(stored.columns)
    assert kept.columns == docs.columns and kept.count() == stored.where("rule_bits = 0").count()
    assert sorted(map(tuple, quality.ablations(stored).collect())) == sorted(map(tuple, quality.ablations(quality.ledger(docs)).collect()))
    plain = quality.ledger(docs, keep=["n_words", "rule_bits", "doc_id"])
    assert plain.columns == ["doc_id", *quality.MEASUREMENTS, "rule_bits"] and plain.where("n_words = -1").count() == 0


def test_a_very_long_text(spark):
    words = [f"w{i % 90_001}" for i in range(300_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "word " * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.ledger(docs).collect()}
    assert (got[1].n_words, got[1].n_repeat_words) == (300_000, brute_repeats(words)) and got[2].n_repeat_words == 300_000


def test_the_report_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    for name, report in queries.REPORTS.items():
        cursor = con.execute(sql.REPORTS[name])
        got = report(spark, folder)
        assert got.columns == [d[0] for d in cursor.description]
        assert sorted(map(tuple, got.collect())) == sorted(cursor.fetchall())
