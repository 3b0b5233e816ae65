"""No side of op7's joins is broadcast: Spark sizes them by compressed files, before keys are exploded, and would build them in the driver."""

from densigrid.llm import graph, order_minhash


def test_sides_are_dealt_by_key(spark, tmp_path, monkeypatch):
    plans = []

    def recorded(made):
        def written(df, label):
            plans.append(df._jdf.queryExecution().sparkPlan().toString())
            return made(df, label)

        return written

    for module in (order_minhash, graph):
        monkeypatch.setattr(module, "written", recorded(module.written))
    words = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join(words[i % 5 * 60 : i % 5 * 60 + 100 + i % 3])) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    out = order_minhash.classes(docs)
    kept = order_minhash.one_of_each(docs)
    plans += [x._jdf.queryExecution().sparkPlan().toString() for x in (out, kept)]
    assert {r["doc_id"]: r["class_id"] for r in out.collect()} == {i: i % 5 for i in range(30)} and kept.count() == 5
    assert sum("SortMergeJoin" in p for p in plans) > 8 and not any("BroadcastHashJoin" in p for p in plans)
