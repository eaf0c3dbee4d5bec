r"""Exact top-k by inner product with MaxScore.

Vectors are documents and dimensions are terms: the posting list of a dimension holds the component of every vector of a
shard, and its bounds are the largest and the smallest one. A query's weights are its own components. Contributions may be
negative, so each term counts from its least contribution in the shard: the surplus over that is never negative, and a
term's score bound is its largest surplus.

For each query and block of a shard, terms are ordered by falling bound. Non-essential are the longest tail whose bounds
together do not reach what a vector needs to enter the query's best k; a vector that scores nothing above the least
outside that tail cannot enter. The postings of the essential terms are traversed; then the others are probed, a few
at a time and for the vectors only that are still competitive: those whose score so far and the bounds of what is left reach
the k-th best. The needed score rises from block to block. Competitive includes equal scores, so ties are complete, and
survivors have their whole exact integer score. Shards give their best k a query, which are merged by a window.

Layout: candidates are dealt to shards of at most about SHARD rows (by the row, so no vector, id or label is a hot key), and
each query goes to every shard, as any exact search has to compare it with all rows. A task reads its shard, in blocks of
BLOCK vectors, and then streams queries along it; it holds one shard and one batch of queries. Nothing is collected or broadcast.

Cases: null vectors and those with null or non-finite components take no part; vectors of other lengths are scored over
the dimensions they share, empty ones with 0; a row that repeats is a row of its own: a query row never meets itself but
does meet its copies, and copies of a query give their rows each; a null vec_id is no query, comes last among ties, and is
returned as null; fewer candidates than k give fewer rows; an empty table gives an empty result; further columns are
dropped, whatever their names; scores that would not fit in a long raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vector_ints import exact_type, sound, whole

K, EVERY = 5, 50
#: Rows of a shard at most, about; rows of a block; terms probed at a time.
SHARD, BLOCK, PROBED = 1 << 18, 4096, 8
#: Small tables are dealt to shards of so many rows, if there are cores for them.
SMALL = 2048
#: The id that stands for null inside a task: after all others among ties.
NO_ID = np.iinfo(np.int64).max


def search(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose vec_id `every` divides, its k best other rows."""
    kept = embeddings.select("vec_id", "embedding").filter(sound(F.col("embedding")))
    # written down, so that a row's number stays the same whoever reads it
    rows = written(kept.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding")).alias("x")), "vectors")
    n = rows.count()
    cores = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-n // SHARD), min(-(-n // SMALL), cores))
    candidates = rows.select(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), F.lit(False).alias("asks"), "row", "vec_id", "x")
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    queries = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(True).alias("asks"), "row", "vec_id", "x")
    dealt = candidates.unionByName(queries).repartition(shards, "shard").sortWithinPartitions("shard", "asks", "row")
    found = dealt.mapInArrow(lambda batches: _searched(batches, k), "query_row long, query_id long, row long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


class Shard:
    """The candidates of a shard, in blocks of vectors of one length."""

    def __init__(self):
        self.blocks: list[Block] = []
        self._held: dict[int, list[tuple[int, int, np.ndarray]]] = {}

    def add(self, row: int, vec_id: int, x: np.ndarray) -> None:
        held = self._held.setdefault(len(x), [])
        held.append((row, vec_id, x))
        if len(held) == BLOCK:
            self.blocks.append(Block(self._held.pop(len(x))))

    def close(self) -> None:
        self.blocks += [Block(rows) for rows in self._held.values()]
        self._held = {}

    def best(self, row: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, ids, scores) of the k best of all blocks for a query, other than its own row."""
        top = tuple(np.zeros(0, np.int64) for _ in range(3))
        for block in self.blocks:
            need = int(top[2][-1]) if len(top[2]) == k else None
            at, scores = block.competitive(q, row, k, need)
            if not len(at):
                continue
            rows, ids, scores = (np.concatenate(p) for p in zip(top, (block.rows[at], block.ids[at], scores)))
            order = np.lexsort((rows, ids, -scores))[:k]
            top = rows[order], ids[order], scores[order]
        return top


class Block:
    """Posting lists of some vectors: one row of `postings` a dimension."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]]):
        self.rows = np.array([r[0] for r in rows], np.int64)
        self.ids = np.array([r[1] for r in rows], np.int64)
        self.postings = np.ascontiguousarray(np.array([r[2] for r in rows], np.int64).reshape(len(rows), -1).T)
        self.high, self.low = self.postings.max(axis=1), self.postings.min(axis=1)
        self.most = int(max(np.abs(self.high).max(initial=0), np.abs(self.low).max(initial=0)))
        self._as: dict[type, np.ndarray] = {}

    def typed(self, kind: type) -> np.ndarray:
        if kind not in self._as:
            self._as[kind] = self.postings.astype(kind)
        return self._as[kind]

    def competitive(self, q: np.ndarray, own: int, k: int, need: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all vectors that can be among the k best, given that `need` is reached by k others."""
        width = min(len(q), len(self.postings))
        q = q[:width]
        postings = self.typed(exact_type(width, self.most, int(np.abs(q).max(initial=0))))
        q = q.astype(postings.dtype)
        ends = np.stack([q * self.low[:width].astype(postings.dtype), q * self.high[:width].astype(postings.dtype)]).astype(np.int64)
        least, bound = ends.min(axis=0), np.abs(ends[1] - ends[0])
        terms = np.argsort(-bound, kind="stable")
        left = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)  # bounds from each place in the order on
        floor = int(least.sum())
        if need is None:
            need = self._reached(postings, q, own, k)
        # essential terms: those before the longest tail whose bounds stay under what is needed above the least
        done = width if need is None else min(width, int(np.searchsorted(-left, floor - need, side="right")))
        essential = terms[:done]
        at = np.flatnonzero(self.rows != own)
        score = (q[essential] @ postings[essential])[at] if len(essential) else np.zeros(len(at), postings.dtype)
        while True:
            # what terms that are left can add at most: their bounds above their least
            more = int(left[done] + least[terms[done:]].sum())
            if need is not None:
                stay = score >= need - more
                at, score = at[stay], score[stay]
            if done >= width or not len(at):
                return at, score.astype(np.int64)
            probed = terms[done : done + PROBED]
            score = score + q[probed] @ postings[np.ix_(probed, at)]
            done += len(probed)

    def _reached(self, postings: np.ndarray, q: np.ndarray, own: int, k: int) -> int | None:
        """A score that k vectors of the block reach: that of the best by the heaviest terms, scored in full."""
        others = np.flatnonzero(self.rows != own)
        if len(others) < k or not len(q):
            return None
        heavy = np.argsort(-np.abs(q), kind="stable")[:PROBED]
        rough = (q[heavy] @ postings[heavy])[others]
        some = others[np.argpartition(-rough, min(4 * k, len(others)) - 1)[: 4 * k]]
        return int(np.sort(q @ postings[: len(q), some])[-k])


def _searched(batches, k: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c, pa.int64()) for c in ("query_row", "query_id", "row", "vec_id", "score")])
    held, shard = None, Shard()
    for batch in batches:
        out = []
        column = dict(zip(batch.schema.names, batch.columns))
        starts = column["x"].offsets.to_numpy()
        values = column["x"].values.to_numpy(zero_copy_only=False)
        rest = (column[c].to_pylist() for c in ("shard", "asks", "row", "vec_id"))
        for i, (number, asks, row, vec_id) in enumerate(zip(*rest)):
            if number != held:
                held, shard = number, Shard()
            x = values[starts[i] : starts[i + 1]].astype(np.int64)
            if not asks:
                shard.add(row, NO_ID if vec_id is None else vec_id, x)
                continue
            shard.close()
            rows, ids, scores = shard.best(row, x, k)
            out.append((np.full(len(rows), row), np.full(len(rows), vec_id), rows, ids, scores))
        if out:
            query_row, query_id, rows, ids, scores = (np.concatenate(c) for c in zip(*out))
            ids = pa.array(ids, mask=ids == NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(query_row), pa.array(query_id), pa.array(rows), ids, pa.array(scores)], schema=schema)
