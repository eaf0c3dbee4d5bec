"""A stored full-text index: postings by token bucket, upserts and deletions, searches that read the buckets of their tokens only.

`postings` holds (token, id, commit) partitioned by a bucket of the token, `versions` one row (id, version, commit) for each time an id was
put or taken away. An upsert writes the postings of a commit of its own and then names the commit in `versions`; the latest
version of an id tells which of its postings count; a version is of one commit. So nothing is rewritten, a writer that dies between the two leaves
postings that no version names, and may be run again. Upserts take one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.functions import english

from .graph import materialised

BUCKETS = 64
#: Tokens that are broadcast to the postings at most; beyond, Spark joins by token.
BROADCAST_ROWS = 100_000
#: Tokens of queries that are broadcast to the rows at once.
BLOCK = 1 << 21
#: Texts to arrays of tokens, by the name that an index keeps.
ANALYZERS: dict[str, Callable[[Column], Column]] = {"english": english.tokens, "words": lambda text: F.coalesce(english.words(text), F.array().cast("array<string>"))}


class LexicalIndex:
    """An index that lies at `path`; `analyzer` names how texts and phrases become tokens."""

    def __init__(self, spark: SparkSession, path: str, analyzer: str, id_type: str):
        self.spark, self.path, self.analyzer, self.id_type = spark, path, analyzer, id_type

    @classmethod
    def build(cls, rows: DataFrame, path: str, analyzer: str = "english") -> LexicalIndex:
        """Writes rows (id, text) as an index; a folder that is there already is an error."""
        if analyzer not in ANALYZERS:
            raise ValueError(f"no analyzer {analyzer!r}; there are {', '.join(ANALYZERS)}")
        kind = rows.schema["id"].dataType.simpleString()
        spark = rows.sparkSession
        spark.createDataFrame([(analyzer, BUCKETS, kind)], "analyzer string, buckets int, id_type string").coalesce(1).write.parquet(f"{path}/meta")
        spark.createDataFrame([], f"id {kind}, version long, commit string").write.parquet(f"{path}/versions")
        index = cls(spark, path, analyzer, kind)
        index.upsert(rows)
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str, analyzer: str = "english") -> LexicalIndex:
        """The index at path; ValueError if it was built with another analyzer."""
        meta = spark.read.parquet(f"{path}/meta").first()
        if meta.analyzer != analyzer:
            raise ValueError(f"the index holds tokens of {meta.analyzer!r}, not of {analyzer!r}")
        return cls(spark, path, analyzer, meta.id_type)

    def upsert(self, rows: DataFrame) -> None:
        """Rows (id, text) take the place of what was indexed under their ids; of several rows of one id all tokens count."""
        commit, version = uuid.uuid4().hex, self._next()
        tokens = rows.filter("id is not null").select("id", F.explode(F.array_distinct(ANALYZERS[self.analyzer](F.col("text")))).alias("token"))
        # a token that is everywhere is dealt to several files of its bucket; an id of several rows may have a posting twice
        placed = tokens.repartition(_bucket("token"), F.pmod(F.xxhash64("id"), F.lit(4))).select("token", "id", _bucket("token").alias("bucket")).sortWithinPartitions("bucket")
        placed.withColumn("commit", F.lit(commit)).write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        self._name(rows, version, F.lit(commit))

    def delete(self, ids: DataFrame) -> None:
        """What was indexed under the ids (id) is found no more."""
        self._name(ids, self._next(), F.lit(None).cast("string"))

    def search(self, asked: DataFrame) -> DataFrame:
        """(query, id): rows that have every token of a phrase; asked: (query, phrase). A phrase without tokens finds nothing.

        Postings of the asked tokens are shuffled once, however many queries ask, to what each row has of them. A query then meets only the rows that
        have its rarest token, where they lie, and is looked up there: pairs are neither aggregated nor shuffled.
        """
        told = asked.select("query", F.sort_array(F.array_distinct(ANALYZERS[self.analyzer](F.col("phrase")))).alias("tokens"))
        told = materialised(told.filter("size(tokens) > 0").distinct(), "asked")
        tokens = told.select(F.explode("tokens").alias("token")).distinct()
        buckets = [r.bucket for r in tokens.select(_bucket("token").alias("bucket")).distinct().collect()]  # BUCKETS at most
        postings = self._postings().filter(F.col("bucket").isin(buckets)).select("token", "id", "commit")
        few = F.broadcast if tokens.count() <= BROADCAST_ROWS else lambda rows: rows
        often = materialised(postings.join(few(tokens), "token").groupBy("token").agg(F.count("*").alias("n")).select("token", "n", F.monotonically_increasing_id().alias("no")), "often")
        ranked = told.select("*", F.explode("tokens").alias("token")).join(often, "token").groupBy("query", "tokens").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "no"))), lambda r: r["no"]).alias("ranked"))
        keyed = materialised(ranked.filter("size(ranked) = size(tokens)").select("query", F.col("ranked")[0].alias("key"), F.slice("ranked", F.lit(2), F.size("ranked")).alias("others")), "keyed")
        parts = keyed.select(F.col("key").alias("no"), F.lit(True).alias("first")).distinct().unionByName(keyed.select(F.explode("others").alias("no"), F.lit(False).alias("first")).distinct())
        roles = parts.groupBy("no").agg(F.bool_or("first").alias("first"), (~F.bool_and("first")).alias("other")).join(often.select("token", "no"), "no")
        named = F.broadcast(self._versions().filter("commit is not null").select("commit", "version").distinct())  # a row for each upsert
        had = postings.join(few(roles), "token").join(named, "commit").groupBy("id", "version").agg(F.collect_set(F.when(F.col("first"), F.col("no"))).alias("keys"), F.collect_set(F.when(F.col("other"), F.col("no"))).alias("held"))
        rows = had.filter("size(keys) > 0").join(self.current(), ["id", "version"]).select("id", "keys", "held")
        blocks = max(1, -(-(keyed.agg(F.sum(F.size("others") + 2)).first()[0] or 0) // BLOCK))
        if blocks > 1:
            rows = materialised(rows, "rows")
        each, found = rows.select("id", "held", F.explode("keys").alias("key")), None
        for b in range(blocks):
            some = each.join(F.broadcast(keyed.filter(F.pmod(F.xxhash64("query", "others"), F.lit(blocks)) == b)), "key").filter(_holds("held", "others")).select("query", "id")
            found = some if found is None else found.unionByName(some)
        return found

    def current(self) -> DataFrame:
        """(id, version) of the postings that count."""
        latest = self._versions().groupBy("id").agg(F.max("version").alias("version"), F.max_by("commit", "version").alias("commit"))
        return latest.filter("commit is not null").select("id", "version")

    def _postings(self) -> DataFrame:
        return self.spark.read.schema(f"token string, id {self.id_type}, commit string, bucket int").parquet(f"{self.path}/postings")

    def _versions(self) -> DataFrame:
        return self.spark.read.schema(f"id {self.id_type}, version long, commit string").parquet(f"{self.path}/versions")

    def _next(self) -> int:
        return (self._versions().agg(F.max("version")).first()[0] or 0) + 1

    def _name(self, rows: DataFrame, version: int, commit: Column) -> None:
        named = rows.filter("id is not null").select("id").distinct().select("id", F.lit(version).cast("long").alias("version"), commit.alias("commit"))
        named.write.mode("append").parquet(f"{self.path}/versions")


def _holds(held: str, others: str) -> Column:
    """All of `others` are in `held`. Most queries end at their second token."""
    n = F.size(others)
    return (n == 0) | (F.array_contains(held, F.get(others, F.lit(0))) & ((n == 1) | (F.size(F.array_intersect(held, others)) == n)))


def _bucket(token: str) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")
