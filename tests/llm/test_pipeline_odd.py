"""The pipeline over tables with everything that may be wrong with them."""

import uuid

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from latentspark.llm import packing, pii, quality_classifier, quality_rules, simhash
from tests.llm.cases import no_documents, odd_documents, prose


def _run(spark, docs, labels, at):
    docs.write.parquet(f"file://{at}/documents.parquet")
    labels.write.parquet(f"file://{at}/labels.parquet")
    return corpus_pipeline.run(spark, f"file://{at}")


def test_odd_documents(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, None), (None, 0, 0), (6, None, 1)], "doc_id long, quality int, toxic int")
    mail = prose(50, 90) + " write to jo@mail.example.com"
    docs = odd_documents(spark, [(40, mail, "en", "s0", 1), (41, None, "en", "s0", None), (None, prose(60, 90), "en", "s0", 1)])
    got = _run(spark, docs, labels, tmp_path / "odd").toPandas()
    # Kept: one of the copies 1 and 2, one of the rows with id 7, the long text, the mail, and both rows without an id that have words.
    ids = got.loc[got["piece"] == 0, "doc_id"].tolist()
    assert sorted(int(x) for x in ids if x == x) == [1, 6, 7, 40] and sum(x != x for x in ids) == 2
    assert (got.groupby("sequence_id")["length"].sum() <= 1024).all()
    assert _run(spark, no_documents(spark), labels.where("false"), tmp_path / "none").count() == 0


LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_texts_go_to_python_in_small_batches(spark, tmp_path, monkeypatch):
    """Of every stage; 20 MB of texts of 5 KB in one task were one batch."""
    text = F.concat(F.repeat(F.concat(F.lit("word"), (F.col("id") % 10 + 1000).cast("string"), F.lit(" ")), 550), F.lit("x@y.example"))
    spark.range(0, 4_000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source")).write.parquet(f"file://{tmp_path}/d")
    docs = spark.read.parquet(f"file://{tmp_path}/d").coalesce(1)
    seen = tmp_path / "seen"
    seen.mkdir()
    plain = type(docs).mapInArrow

    def noting(self, func, schema, *more, at=str(seen)):
        def noted(batches):
            for b in batches:
                with open(f"{at}/{uuid.uuid4().hex}", "w") as f:
                    f.write(str(b.nbytes))
                yield b

        return plain(self, lambda it: func(noted(it)), schema, *more)

    monkeypatch.setattr(type(docs), "mapInArrow", noting)
    stages = [
        lambda: quality_rules.with_stats(docs), lambda: quality_classifier.with_features(docs, "text", ["doc_id"]), lambda: simhash.fingerprints(docs), lambda: simhash.near_copies(docs),
        lambda: pii.redact(docs), lambda: packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")),
    ]
    for k, stage in enumerate(stages):
        for old in seen.iterdir():
            old.unlink()
        spark.conf.unset(LIMIT)  # another operator sets it, too
        stage().write.format("noop").mode("overwrite").save()
        sizes = [int(p.read_text()) for p in seen.iterdir()]
        assert sum(sizes) > 19e6 and max(sizes) < 5e6, (k, max(sizes))
    spark.conf.set(LIMIT, "8m")
    assert quality_rules.with_stats(docs).count() == 4_000 and spark.conf.get(LIMIT) == "8m"
    spark.conf.unset(LIMIT)
