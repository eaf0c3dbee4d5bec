"""Curation: flags, proposals, versions, audit. Tables in, tables out; the clock is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge import keep_first

# Scores between which a match without a verdict is unsure, and the gap of the two best that is too close.
UNSURE, CLOSE_GAP = (0.7, 0.95), 0.05
# What a proposal or job may become from each state.
STEPS = {"pending": ("approved", "rejected"), "queued": ("approved", "rejected"), "approved": ("running",), "running": ("done", "failed")}


def annotation_flags(entities: DataFrame) -> DataFrame:
    """Flags (entity_ref, flag_type, reason) of annotations: an unsure best score, or two best too close.

    entities: (id, scores), the scores in falling order.
    """
    top, gap = F.get("scores", F.lit(0)), F.get("scores", F.lit(0)) - F.get("scores", F.lit(1))
    reasons = F.filter(
        F.array(F.when((top >= UNSURE[0]) & (top < UNSURE[1]), "unsure_score"), F.when(gap < CLOSE_GAP, "close_candidates")),
        lambda r: r.isNotNull(),
    )
    return entities.select(F.col("id").alias("entity_ref"), F.lit("needs_review").alias("flag_type"), F.explode(reasons).alias("reason"))


def add_flags(stored: DataFrame, fresh: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """stored and those of fresh whose (entity_ref, flag_type) is not flagged yet; of several the first in the order of some columns, then of the contents."""
    new = keep_first(fresh, ["entity_ref", "flag_type"], list(order)).join(stored.select("entity_ref", "flag_type"), ["entity_ref", "flag_type"], "left_anti")
    return stored.unionByName(new, allowMissingColumns=True)


def resolve_flags(stored: DataFrame, decisions: DataFrame, at: Column, order: tuple[str, ...] = ()) -> DataFrame:
    """stored with (flag_id, status, resolved_by) decisions applied to flags that are still pending; what was resolved before stays as it is.

    Of several decisions on a flag the first counts, in the order of some of their columns, then by status and name.
    """
    d = keep_first(decisions, ["flag_id"], [*order, "status", "resolved_by"]).select("flag_id", F.col("status").alias("_status"), F.col("resolved_by").alias("_by"))
    both = stored.join(d, "flag_id", "left")
    before = {c: F.col(c) if c in stored.columns else F.lit(None) for c in ("resolved_by", "resolved_at")}
    open_ = F.col("_status").isNotNull() & (F.col("status") == "pending")
    return both.select(
        *(c for c in stored.columns if c not in ("status", "resolved_by", "resolved_at")),
        F.when(open_, F.col("_status")).otherwise(F.col("status")).alias("status"),
        F.when(open_, F.col("_by")).otherwise(before["resolved_by"]).alias("resolved_by"),
        F.when(open_, at).otherwise(before["resolved_at"]).alias("resolved_at"),
    )


def step(rows: DataFrame, decisions: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """rows (id, state) with decisions (id, to) applied where the state allows them; `moved` tells.

    Of several decisions on a row the first counts, in the order of some of their columns, then by where they lead to.
    """
    allowed = F.lit(False)
    for a, bs in STEPS.items():
        allowed = allowed | ((F.col("state") == a) & F.col("to").isin(*bs))
    first = keep_first(decisions, ["id"], [*order, "to"]).select("id", "to")
    both = rows.join(first, "id", "left").withColumn("moved", F.coalesce(allowed, F.lit(False)))
    return both.withColumn("state", F.when(F.col("moved"), F.col("to")).otherwise(F.col("state"))).drop("to")


def new_versions(rows: DataFrame, changes: DataFrame, known: DataFrame) -> DataFrame:
    """(old, new, outcome) of changes (sha256, new_sha256): superseded, or refused as no change, absent or existing."""
    both = changes.join(rows.select("sha256", F.lit(True).alias("_has")), "sha256", "left").join(known.select(F.col("sha256").alias("new_sha256"), F.lit(True).alias("_taken")), "new_sha256", "left")
    outcome = F.when(F.col("_has").isNull(), "absent").when(F.col("sha256") == F.col("new_sha256"), "no_change").when(F.col("_taken"), "exists").otherwise("superseded")
    return both.select(F.col("sha256").alias("old"), F.col("new_sha256").alias("new"), outcome.alias("outcome"))


def applied_versions(rows: DataFrame, changes: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """rows after changes, and the transforms that record them: an allowed change adds its row and marks the old one as superseded.

    rows: (sha256, status, superseded_by, provenance, content ...); changes: (sha256, new_sha256, by, and any content columns
    to replace). A new row keeps the old one's provenance and gets an entry of source "curation". Of several changes of
    one row the one of the smallest new hash counts; refused changes leave no trace here (new_versions tells why).
    """
    one = changes.groupBy("sha256").agg(F.min_by(F.struct(*(c for c in changes.columns if c != "sha256")), "new_sha256").alias("c"))
    fine = new_versions(rows.select("sha256"), one.select("sha256", "c.new_sha256"), rows.select("sha256")).filter("outcome = 'superseded'").select(F.col("old").alias("sha256"))
    told = one.join(fine, "sha256")
    both = rows.join(told, "sha256", "left")
    moved = F.col("c").isNotNull()
    old = both.withColumn("status", F.when(moved, "superseded").otherwise(F.col("status"))).withColumn("superseded_by", F.when(moved, F.col("c.new_sha256")).otherwise(F.col("superseded_by"))).drop("c")
    entry = F.struct(F.lit("curation").alias("source"), F.col("c.by").alias("name"))
    fresh = rows.join(told, "sha256")
    content = [c for c in changes.columns if c not in ("sha256", "new_sha256", "by")]
    for c in content:
        fresh = fresh.withColumn(c, F.coalesce(F.col(f"c.{c}"), F.col(c)))
    fresh = fresh.withColumn("provenance", F.concat("provenance", F.array(entry))).withColumn("status", F.lit("current")).withColumn("superseded_by", F.lit(None).cast("string"))
    fresh = fresh.withColumn("sha256", F.col("c.new_sha256")).drop("c")
    made = told.select(F.col("sha256").alias("source_element"), F.col("c.new_sha256").alias("target_element"), F.lit("curation_update").alias("function_type"), at.alias("created_at"))
    return old.unionByName(fresh.select(*old.columns)), made


def audit(actions: DataFrame, at: Column) -> DataFrame:
    """Rows for the audit log of actions (actor, action, entity_type, entity_ref, details as a map), with the time and a key of their content."""
    told = F.to_json(F.struct("actor", "action", "entity_type", "entity_ref", F.map_from_entries(F.array_sort(F.map_entries("details"))).alias("details")))
    return actions.select("actor", "action", "entity_type", "entity_ref", told.alias("entry"), at.alias("created_at"), F.sha2(told, 256).alias("audit_id"))


def queued_datasets(found: DataFrame, jobs: DataFrame, approved: dict[str, str]) -> DataFrame:
    """New ingestion jobs for datasets (url, source, adapter) that no job (repository_url) has yet; sources on the list are approved at once. A url that several sources found is that of the first by name."""
    table = F.create_map(*(F.lit(x) for kv in approved.items() for x in kv)) if approved else F.create_map().cast("map<string,string>")
    known = F.element_at(table, F.col("source"))
    new = keep_first(found, ["url"], ["source", "adapter"]).join(jobs.select(F.col("repository_url").alias("url")).distinct(), "url", "left_anti")
    return new.select(F.col("url").alias("repository_url"), F.coalesce(known, "adapter", F.lit("unknown")).alias("adapter_type"), F.when(known.isNotNull(), "approved").otherwise("pending").alias("status"), known.isNotNull().alias("auto_approved"))


def approve(annotations: Column, uri: str) -> Column:
    """The annotation of that term becomes the primary one, first and an exact match."""
    hit = F.transform(F.filter(annotations, lambda a: a["term_uri"] == uri), lambda a: a.withField("primary", F.lit(True)).withField("mapping_relation", F.lit("skos:exactMatch")))
    rest = F.transform(F.filter(annotations, lambda a: a["term_uri"] != uri), lambda a: a.withField("primary", F.lit(False)))
    return F.when(F.size(hit) > 0, F.concat(hit, rest)).otherwise(annotations)


def reject(annotations: Column, uri: str) -> Column:
    return F.filter(annotations, lambda a: a["term_uri"] != uri)


def queue(flags: DataFrame, status: str | None = None, flag_type: str | None = None, entity_type: str | None = None, limit: int = 50) -> DataFrame:
    """Newest flags first."""
    for column, wanted in (("status", status), ("flag_type", flag_type), ("entity_type", entity_type)):
        if wanted is not None:
            flags = flags.filter(F.col(column) == wanted)
    return flags.orderBy(F.desc("created_at"), "flag_id").limit(limit)


def bloated(merges: DataFrame, most: int = 3) -> DataFrame:
    """(sha256, n_novel) of merges (sha256, before, after) that add `most` sources or more at once."""
    novel = F.size(F.array_except("after", "before"))
    return merges.select("sha256", novel.alias("n_novel")).filter(F.col("n_novel") >= most)


def unknown_sources(rows: DataFrame, known: list[str]) -> DataFrame:
    """(id, unknown) of entities with a source that is not on the list."""
    sources = F.array_distinct(F.transform("provenance", lambda p: p["source"]))
    return rows.select("id", F.array_except(sources, F.array(*(F.lit(k) for k in known))).alias("unknown")).filter("size(unknown) > 0")
