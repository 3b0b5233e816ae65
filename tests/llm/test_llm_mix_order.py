"""The place that the pipeline returns is the one at which the mix wrote the row, for rows that share an id or have none too."""

import pytest
from pyspark.sql import functions as F

from densigrid.llm import pfair


def test_places_are_those_of_the_mix(spark, tmp_path):
    import corpus_pipeline

    pytest.importorskip("public_tokenizers")
    kind = "doc_id long, text string, lang string, source string, n_chars int"
    rows = [(None if i % 3 == 0 else i % 7, f"text number {i}", "en", "ab"[i % 2], i) for i in range(60)]
    docs = spark.createDataFrame(rows, kind)
    order = [r["text"] for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]  # collected in the order of its partitions
    out = corpus_pipeline.encode_tokens(spark, docs.orderBy("text"), "").toPandas().sort_values("place")
    assert list(out.place) == list(range(60)) and "text" not in out
    assert [f"text number {n}" for n in out.n_chars] == order


def test_ties_do_not_change_places_of_ids_apart(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}") for i in range(50)], "doc_id long, source string")
    tied = pfair.schedule(docs.withColumn("x", F.lit(0)), ties="x")
    assert {(r["doc_id"], r["_place"]) for r in tied.collect()} == {(r["doc_id"], r["_place"]) for r in pfair.schedule(docs).collect()}
