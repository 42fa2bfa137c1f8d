import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from surveylens.llm import packing, pii, queries, resampling  # noqa: E402

from .helpers import SF, frame, near_brute, prose  # noqa: E402
from .test_packing import check  # noqa: E402


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "near dedup", "personal data", "best-fit packing"]


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in resampling.resample(docs, labels).collect() if r.kept}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    winner = {t: max(i for i in texts if texts[i] == t) for t in set(texts.values())}
    texts = {i: t for i, t in texts.items() if winner[t] == i}
    texts = {i: texts[i] for i, (_, low) in near_brute(list(texts.items()), 80).items() if low == i}
    left = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    masked = {r.doc_id: r.masked if r.masked is not None else texts[r.doc_id]
              for r in pii.find_personal_data(left, with_masked=True).collect()}
    for i, t in masked.items():
        assert not pii.base_spans(t) or t == texts[i], t
    used, least = check(corpus_pipeline.run(spark, SF).collect(), list(masked.items()), packing.CAPACITY)
    assert used <= least + 3


def test_against_brute_force_at_80_percent(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in resampling.resample(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.kept}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    last = {t: i for i, t in sorted(texts.items())}
    texts = {i: t for i, t in texts.items() if last[t] == i}
    stay = {i for i, (_, low) in near_brute(list(texts.items()), 80).items() if low == i}
    assert {p.doc_id for p in corpus_pipeline.run(spark, SF).collect()} == stay


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.simpleString() == docs.schema.simpleString()
        docs = docs.sparkSession.createDataFrame(out.collect(), docs.schema)


def test_empty_and_clashing_tables(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, prose(1, 30)), (3, prose(1, 30))])
    for source in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, source, SF)
            assert out.columns == docs.columns
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, source, SF).count() in (0, 4)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got = entry.queries()[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


COLUMNS = {
    1: "doc_id piece start length ids_crc32 sequence_id offset", 2: "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    3: "doc_id n_ids", 4: "doc_id n_shingles component_id kept", 5: "page_id url text n_chars",
    6: "doc_id keep_id group_size kept text_sha256", 7: "doc_id n_assign n_access n_hex base_sha256 spans",
    8: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", 9: "doc_id kept",
    10: "doc_id held_out lang_pred score", 11: "word form root n n_near form_n",
    12: "doc_id n_bytes n_removed n_spans kept_sha256", 13: "doc_id leaf subroot root proof_sha256 folded_root verified",
}


def test_one_query_for_each_operator(spark):
    named = {int(n[2:].split("_")[0]): n for n in queries.QUERIES}
    assert sorted(named) == list(range(1, 14)) and "pipeline" in entry.queries()
    for number, name in named.items():
        assert set(COLUMNS[number].split()) <= set(entry.queries()[name](spark, SF).columns)


def test_span_columns(spark):
    import hashlib
    out = {r.doc_id: r for r in queries.op2_pii_skip_chain(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        base = pii.base_spans(r.text)
        said = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert out[r.doc_id].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [out[r.doc_id][f"n_{k}"] for k in pii.KINDS] == [sum(x[2] == k for x in base) for k in pii.KINDS]
        assert set(said.split(",")) - {""} <= set(out[r.doc_id].spans.split(","))
