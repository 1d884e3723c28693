import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


def test_stages_take_effect(spark):
    import corpus_pipeline
    from tracewright.llm import secrets
    from tracewright.llm.common import materialize

    start = docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, SF), name)
        assert docs.columns == start.columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    first, second, third, fourth = seen.values()
    assert set(third) <= set(second) == set(first) and set(fourth) == set(third) and 0 < len(first) < start.count()
    assert not any(secrets.brute_spans(t or "") for t in fourth.values())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in out} == set(fourth) and all(r["offset"] + r["length"] <= 1024 for r in out)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [k for k in labels if labels[k] == 1]
    assert sum(k in first for k in good) >= 0.95 * len(good)


def test_near_duplicates_shuffle_no_text_that_stays(spark, monkeypatch):
    import corpus_pipeline
    from pyspark.sql import functions as F

    ids = spark.range(400).withColumn("doc_id", F.when(F.col("id") != 7, F.col("id")))
    rows = ids.select("doc_id", F.concat(F.lit("text "), F.col("doc_id").cast("string")).alias("text"))
    rows = rows.unionByName(rows.where("doc_id = 5")).unionByName(spark.createDataFrame([(6, "other text")], "doc_id long, text string"))

    def verdicts(docs, keyed):
        gone = (F.col("doc_id") % 100 == 3) | (F.col("text") == "other text")
        own = docs.withColumn("text_key", corpus_pipeline.jaccard_join.text_key(F.coalesce("text", F.lit(""))))
        first = own.where("doc_id = 5").limit(1).withColumn("kept", F.lit(False))  # one of two equal rows
        return own.select("doc_id", "text_key", (~F.coalesce(gone, F.lit(False))).alias("kept")).unionByName(first.select("doc_id", "text_key", "kept"))

    monkeypatch.setattr(corpus_pipeline.jaccard_join, "jaccard_join", verdicts)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = corpus_pipeline.near_duplicates(spark, rows, SF)
        got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in out.collect())
        want = [(True, k, f"text {k}") for k in range(400) if k % 100 != 3 and k != 7]
        assert got == [(False, 0, None), *want]
        moved, plans = 0, [out._jdf.queryExecution().executedPlan()]
        while plans:
            plan = plans.pop()
            if plan.nodeName() == "Exchange" and "text#" in plan.output().toString():
                moved += plan.metrics().apply("shuffleRecordsWritten").value()
            plans += [plan.children().apply(k) for k in range(plan.children().size())]
        assert 0 < moved < 50
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
