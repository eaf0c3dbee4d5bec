"""Nearest vectors and the cutoffs that turn them into annotations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regolith.functions.similarity import score_relation

from .vector_index import nearest

# Candidates looked at, accepted at most, and the largest fall of score within a series.
TOP, ACCEPTED, GAP = 20, 10, 0.15


def top_k(queries: DataFrame, index: DataFrame, k: int = TOP) -> DataFrame:
    """(query, item, score, rank): the k nearest items by cosine, ties by item.

    queries: (query, vector) and index: (item, vector), of any size; all queries go along the index in one pass.
    """
    return nearest(queries, index, k)


def gap_cutoff(ranked: DataFrame, threshold: float, gap: float = GAP, most: int = ACCEPTED, deprecated: Column | None = None) -> DataFrame:
    """Of ranked candidates (query, item, score, rank) those before the first that is under the threshold or falls by more than gap.

    Deprecated items are skipped first and do not count as predecessors; at most `most` stay.
    """
    rows = ranked if deprecated is None else ranked.filter(~deprecated)
    line = Window.partitionBy("query").orderBy("rank")
    before = F.lag("score").over(line)
    stop = (F.col("score") < threshold) | F.coalesce(before - F.col("score") > gap, F.lit(False))
    stopped = F.sum(stop.cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("_stopped", stopped).filter("_stopped = 0").withColumn("position", F.row_number().over(line))
    return kept.filter(F.col("position") <= most).drop("_stopped").withColumn("relation", score_relation(F.col("score"))).withColumn("primary", F.col("position") == 1)


def species_over_genus(annotations: Column) -> Column:
    """Taxon annotations whose label begins a longer taxon's label are dropped; array of structs with term_uri and term_label."""

    def label(a):
        return F.lower(F.trim(F.coalesce(a["term_label"], F.lit(""))))

    def taxon(a):
        return F.lower(F.coalesce(a["term_uri"], F.lit(""))).contains("ncbitaxon")

    def genus(a):
        return taxon(a) & (label(a) != "") & F.exists(annotations, lambda b: taxon(b) & F.startswith(label(b), F.concat(label(a), F.lit(" "))))

    return F.filter(annotations, lambda a: ~genus(a))


#: The name under which indexes keep the encoder below.
HASHED = "hashed-trigrams-384"


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hashed_vector(text: pd.Series) -> pd.Series:
    """A deterministic encoder for use without a model: character trigrams hashed into 384 signed places."""
    import zlib

    def one(t):
        v = np.zeros(384, np.float32)
        padded = f"  {(t or '').lower()} "
        for i in range(len(padded) - 2):
            h = zlib.crc32(padded[i : i + 3].encode())
            v[h % 384] += 1.0 if h & 0x80000000 else -1.0
        n = float(np.linalg.norm(v))
        return v / n if n else v

    return text.map(one)
