"""Words of notes for the vectors: found once, without a count of each note's words."""

from __future__ import annotations

from pyspark.sql import functions as F

from perfsieve.functions import text
from perfsieve.operators import embed
from perfsieve.plans import model_queries


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_words_alone_are_not_counted(spark):
    notes = spark.createDataFrame([(1, "a b  a"), (1, "c"), (2, None), (None, " b ")], "doc_id long, notes string")
    rows = embed.token_counts(notes, "doc_id", "notes", counted=False)
    assert "Aggregate" not in plan(rows)
    counted = embed.token_counts(notes, "doc_id", "notes")
    assert sorted(rows.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n")).collect(), key=str) == sorted(counted.collect(), key=str)


def test_digests_are_taken_of_distinct_words(spark, tmp_path):
    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    words = spark.createDataFrame([("a",), ("b",), ("a",)], "word string")
    found = model_queries.word_vectors(spark, str(tmp_path), words)
    assert sorted(r["word"] for r in found.collect()) == ["a", "b"]
    # The digest is not pushed below the distinct: that is behind a written table.
    assert "Aggregate" not in plan(found)


def test_words_of_odd_spaces(spark):
    rows = spark.createDataFrame([("",), (" ",), ("\t a b  \n",), (None,), ("x",)], "t string")
    assert [r[0] for r in rows.select(text.words(F.col("t"))).collect()] == [[], [], ["a", "b"], None, ["x"]]
