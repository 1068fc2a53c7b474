"""The registered corpus queries and the pipeline over the driver's smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from latentspark.llm import queries as q
from latentspark.llm.pii import base_spans
from tests.helpers import same_rows


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_as_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert same_rows(q.queries()[name](spark, sf_dir).toPandas(), con.execute(q.oracle_sql()[name]).df())


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        assert docs.columns == names
        seen.append(docs.count())
    assert seen[0] > seen[1] >= seen[2] > seen[3] == seen[4] > 0
    rows = docs.collect()
    assert not any(base_spans(r["text"]) for r in rows) and all(r["n_chars"] == len(r["text"]) for r in rows)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert docs.join(labels.where("quality = 0"), "doc_id", "left_semi").isEmpty()
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.select("doc_id").distinct().count() == seen[-1]
