"""Annotations in the order of their matches."""

from pyspark.sql import functions as F

from regolith.operators import annotate


def test_broader_terms_follow_any_number_of_matches(spark):
    ranked = spark.range(1, 1201).select(F.lit("q").alias("query"), F.lit("text").alias("text"), F.col("id").cast("string").alias("item"), F.lit(0.9).alias("score"), F.lit("skos:closeMatch").alias("relation"), F.col("id").cast("int").alias("position"))
    terms = ranked.select(F.col("item").alias("uri"), F.lit("l").alias("label"), F.lit("d").alias("definition")).union(spark.sql("select 'up', 'world', null"))
    ancestors = spark.createDataFrame([("1", "up", 1)], "node string, ancestor string, depth int")
    (got,) = annotate.assigned(ranked, terms, ancestors).collect()
    assert [a.term_uri for a in got.annotations] == [str(i) for i in range(1, 1201)] + ["up"]
    assert len(got.evidence) == 1200
