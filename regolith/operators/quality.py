"""Validation, extraction checks, and what changed between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Data types that an element may have.
DATA_TYPES = ("string", "integer", "float", "boolean", "array", "object")


def violations(rows: DataFrame, rules: dict[str, Column], key: str = "id") -> DataFrame:
    """(key, rule) of each rule whose condition does not hold; a null counts as not held. One pass for all rules."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), n) for n, c in rules.items())), lambda r: r.isNotNull())
    return rows.select(key, F.explode(broken).alias("rule"))


def entity_rules(recomputed: str = "recomputed") -> dict[str, Column]:
    """Rules over committed elements: a valid type, and the hash of the content."""
    return {"valid_type": F.col("data_type").isin(*DATA_TYPES), "hash_integrity": F.col("sha256") == F.col(recomputed)}


def count_checks(rows: DataFrame, spec: DataFrame) -> DataFrame:
    """(category, n, state) against spec (category, least, most): ok, few, many."""
    n = rows.groupBy("category").agg(F.count("*").alias("n"))
    both = spec.join(n, "category", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.select("category", "n", F.when(F.col("n") < F.col("least"), "few").when(F.col("n") > F.col("most"), "many").otherwise("ok").alias("state"))  # no upper bound is null


def type_checks(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """(class, name, expected, found, state) of entities (class, name, category) against expected (class, name, category): right, wrong_type or missing."""
    own = rows.groupBy("class", "name").agg(F.array_sort(F.collect_set("category")).alias("found"))
    both = expected.withColumnRenamed("category", "expected").join(own, ["class", "name"], "left")
    state = F.when(F.col("found").isNull(), "missing").when(F.array_contains("found", F.col("expected")), "right").otherwise("wrong_type")
    return both.select("class", "name", "expected", "found", state.alias("state"))


def required_fields(rows: DataFrame, fields: dict[str, list[str]], key: str = "id") -> DataFrame:
    """(key, field) of fields that a row's category requires and that are null or empty."""
    lacks = [F.when((F.col("category") == c) & (F.coalesce(F.col(f).cast("string"), F.lit("")) == ""), f) for c, fs in fields.items() for f in fs]
    return rows.select(key, F.explode(F.filter(F.array(*lacks), lambda f: f.isNotNull())).alias("field"))


ISSUE = "issue string, entity_type string, class string, name string, expected string, found string"
#: Which column says what a spec calls a field.
FIELDS = {"label": "name"}


def extraction_issues(rows: DataFrame, spec: dict) -> DataFrame:
    """ISSUE rows of extracted entities (entity_type, class, name, and the fields that the spec requires) against a spec; none if all is as expected.

    spec: expected_types {type: {"min", "max"}}, category_rules {class: type}, known_entities [{"name", "class", "type"}], required_fields {type: [field]}; any may be absent.
    Issues: missing (too few of a type, or a known entity), unexpected (too many), classification (of another type than its category or
    name asks for), field (a required one is empty).
    """
    spark, out = rows.sparkSession, []
    named = rows.withColumn("class", F.coalesce("class", F.lit("")))

    def told(df, issue, **columns):
        names = ("entity_type", "class", "name", "expected", "found")
        return df.select(F.lit(issue).alias("issue"), *(columns.get(n, F.lit(None)).cast("string").alias(n) for n in names))

    if types := spec.get("expected_types"):
        bounds = spark.createDataFrame([(k, v.get("min", 0), v.get("max")) for k, v in types.items()], "category string, least long, most long")
        counted = count_checks(named.withColumnRenamed("entity_type", "category"), bounds).join(bounds, "category")
        out.append(told(counted.filter("state = 'few'"), "missing", entity_type=F.col("category"), expected=F.col("least"), found=F.col("n")))
        out.append(told(counted.filter("state = 'many'"), "unexpected", entity_type=F.col("category"), expected=F.col("most"), found=F.col("n")))
    if rules := spec.get("category_rules"):
        wanted = F.try_element_at(F.create_map(*(F.lit(x) for kv in rules.items() for x in kv)), F.col("class"))
        out.append(told(named.withColumn("wanted", wanted).filter("wanted <> entity_type"), "classification", entity_type=F.col("entity_type"), **{"class": F.col("class")}, name=F.col("name"), expected=F.col("wanted"), found=F.col("entity_type")))
    if known := spec.get("known_entities"):
        asked = F.broadcast(spark.createDataFrame([(k.get("class", ""), k["name"], k.get("type")) for k in known], "class string, name string, wanted string"))  # a spec is a short list
        there = named.join(asked, ["class", "name"])
        out.append(told(asked.join(there.select("class", "name").distinct(), ["class", "name"], "left_anti"), "missing", entity_type=F.col("wanted"), **{"class": F.col("class")}, name=F.col("name"), expected=F.coalesce("wanted", F.lit("any"))))
        out.append(told(there.filter("wanted <> entity_type"), "classification", entity_type=F.col("entity_type"), **{"class": F.col("class")}, name=F.col("name"), expected=F.col("wanted"), found=F.col("entity_type")))
    if fields := spec.get("required_fields"):
        lacks = [F.when((F.col("entity_type") == t) & (F.coalesce(F.col(FIELDS.get(f, f)).cast("string"), F.lit("")) == ""), f) for t, fs in fields.items() for f in fs]
        each = named.withColumn("field", F.explode(F.filter(F.array(*lacks), lambda f: f.isNotNull())))
        out.append(told(each, "field", entity_type=F.col("entity_type"), **{"class": F.col("class")}, name=F.col("name"), expected=F.col("field")))
    found = spark.createDataFrame([], ISSUE)
    for part in out:
        found = found.unionByName(part)
    return found


def batch_counts(items: DataFrame) -> DataFrame:
    """(status, n) of a batch of items (rows, error, known): skipped if known before, failed with an error or without rows, else ok."""
    status = F.when(F.col("known"), "skipped").when(F.col("error").isNotNull() | (F.coalesce("rows", F.lit(0)) == 0), "failed").otherwise("ok")
    return items.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def delta(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """(key, state) of rows added, removed or modified between two maps of key to content; the unchanged are left out."""
    a, b = before.select(key, F.col(content).alias("_a"), F.lit(1).alias("_in_a")), after.select(key, F.col(content).alias("_b"), F.lit(1).alias("_in_b"))
    state = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return a.join(b, key, "full_outer").select(key, state.alias("state")).filter("state is not null")


def count_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, added, removed) of counts (key, n): one of the two is 0."""
    a, b = before.select(key, F.col("n").alias("_a")), after.select(key, F.col("n").alias("_b"))
    both = a.join(b, key, "full_outer").withColumn("d", F.coalesce("_b", F.lit(0)) - F.coalesce("_a", F.lit(0)))
    return both.select(key, F.greatest(F.col("d"), F.lit(0)).alias("added"), F.greatest(-F.col("d"), F.lit(0)).alias("removed"))


def manifest_check(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(entity_type, expected, found) where an export's counts differ from its manifest."""
    e, f = expected.select("entity_type", F.col("n").alias("expected")), found.select("entity_type", F.col("n").alias("found"))
    both = e.join(f, "entity_type", "full_outer").na.fill(0, ["expected", "found"])
    return both.filter("expected <> found")


def latest(runs: DataFrame, by: str, at: str) -> DataFrame:
    """The newest run of each source, all columns."""
    return runs.groupBy(by).agg(F.max_by(F.struct(*(c for c in runs.columns if c != by)), at).alias("r")).select(by, "r.*")
