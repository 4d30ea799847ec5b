"""What is shuffled, by Spark's own counters."""

from pyspark.sql import functions as F


def shuffled_rows(df):
    """Rows of each shuffle of df, which was collected once; without adaptive execution, under which stages hide their plans."""
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_texts_without_a_label_are_not_shuffled(spark, monkeypatch):
    from faintdip.llm import quality

    seen = []
    counts = quality.ngram_counts
    monkeypatch.setattr(quality, "ngram_counts", lambda docs, buckets: seen.append(docs) or counts(docs, buckets))
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("words of "), F.col("id").cast("string")).alias("text")).unionByName(spark.createDataFrame([(7, "again"), (None, "none")], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1), (9, 1), (11, 0), (-5, 1), (None, 1)], "doc_id long, quality int")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for more labels than are broadcast
    try:
        quality.quality_rules(docs, labels, buckets=64)
        assert sorted(r["text"] for r in seen[1].collect()) == ["again", "words of 7", "words of 9"]
        assert max(shuffled_rows(seen[1])) < 20
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
