"""The pipeline against the stages' own rules, and the SQL of queries that have any."""

import duckdb
import pytest

import corpus_pipeline
from quarrymap.llm import queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, small, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{small}/documents.parquet')")
    got, want = queries.queries()[name](spark, small).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda x: sorted(map(repr, x[columns].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, small).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = (before.toPandas(), docs.toPandas())
        if name != "bpe":
            assert docs.columns == COLUMNS
    before, after = seen["line_dedup"]
    first = {}
    for i, text in sorted(zip(before.doc_id, before.text)):
        for line in text.split("\n"):
            first.setdefault(line, i)
    for i, text in zip(after.doc_id, after.text):
        lines = [x for x in text.split("\n") if x.strip()]
        assert len(lines) == len(set(lines)) and all(first[x] == i for x in lines)
    assert (after.n_chars == after.text.str.len()).all()
    before, after = seen["near_dedup"]
    assert after.doc_id.is_unique and set(after.doc_id) <= set(before.doc_id)
    before, after = seen["mixing"]
    assert set(after.doc_id) == set(before.doc_id) and len(after) >= len(before)
    before, after = seen["bpe"]
    assert sorted(after.doc_id) == sorted(before.doc_id) and after.round_trip.all()


def test_run(spark, small):
    rows = corpus_pipeline.run(spark, small)
    assert rows.columns == ["doc_id", "tokens", "n_tokens", "round_trip"] and rows.count() > 100
