r"""Near duplicates: b-bit MinHash signatures joined by multi-index Hamming search, then confirmed on full shingle sets.

A document's signature has CHUNKS * SLOTS values of eight bits, one minimum each. It is split into CHUNKS chunks of SLOTS
values. By pigeonhole two signatures that differ in fewer than 2 * CHUNKS values have a chunk with at most one
difference. The allowed errors of a chunk are enumerated: for each place one key leaves that value out, so equal keys
meet exactly the pairs with at most one error in the chunk. All pairs under that distance are found; and a pair of
similarity 0.8 has two or more differences in each of the 12 chunks of 6 with probability 3e-6, so pairs are also met far beyond
that distance.

Documents with equal shingle sets are one class from the start. Buckets of keys never emit all their pairs:

1. Each bucket links its members to one hub; pairs too far in signature or size are put aside, the rest is confirmed on
   full sets, and connected classes become one component. Buckets within one component are done; most are.
2. In light buckets that touch several components (at most HEAVY rows) all pairs of different components are compared by
   signature inside a join, each pair in the first bucket that it shares, and confirmed on full sets: at most HEAVY rows
   for each bucket row.
3. Heavy buckets that touch several components are joined to families; their classes meet in blocks, where full sets are
   compared by matrix products and only links between components come out.

Steps 2 and 3 are exhaustive over what shares a key, so no link between components is lost. Components are found by
alternating stars on confirmed links, cut by written tables. Nothing grows on the driver: it sees counts.

Cases: null and empty texts, or texts without words, have no shingles and are linked with nothing; with fewer words than
a shingle the whole sequence is the one shingle; repeated rows are in one class and give equal rows; a null doc_id is never
the smallest; ids may be of any type that orders; the shingles of a very long text are one set in one row; an empty table
gives an empty result; further columns are ignored, whatever their names, and keep_one returns them as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, byte_words, if_small, in_batches, written

CHUNKS, SLOTS = 12, 6
PLACES = CHUNKS * SLOTS
SIMILAR = 80
#: Larger buckets are compared in blocks of so many classes, smaller ones by a join.
HEAVY, BLOCK = 64, 192
#: Most shingles of a block's sets, but for a single larger set.
BLOCK_SHINGLES = 1 << 21
#: Tables counted to be small are worked on in so few tasks; of rows with signatures so many are broadcast at most.
FEW, BROADCAST_SIGNATURES = 8, 200_000

_RNG = np.random.Generator(np.random.PCG64(20))
_MUL = _RNG.integers(1, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, PLACES, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    words = byte_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, np.uint64(min(size, len(h))))
    for i in range(min(size, len(h))):
        out = _mixed(out * _MIX + h[i : i + n])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """PLACES minima, each cut to eight bits."""
    low = np.empty(PLACES, np.uint64)
    step = max(1, (1 << 17) // len(shingles))
    for a in range(0, PLACES, step):
        low[a : a + step] = (shingles[None, :] * _MUL[a : a + step, None] + _ADD[a : a + step, None]).min(1)
    return (_mixed(low) >> np.uint64(56)).astype(np.uint8)


def _key_weights() -> np.ndarray:
    """Multipliers that leave one place of each chunk out: CHUNKS x SLOTS keys x SLOTS places."""
    w = _RNG.integers(1, 1 << 63, (CHUNKS, SLOTS, SLOTS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    w[:, np.arange(SLOTS), np.arange(SLOTS)] = 0
    return w


_WEIGHTS = _key_weights()
_SALTS = _mixed(np.arange(CHUNKS * SLOTS, dtype=np.uint64) + np.uint64(7)).reshape(CHUNKS, SLOTS)


def keys(sig: np.ndarray) -> np.ndarray:
    """CHUNKS * SLOTS 64-bit keys: a chunk with one place left out."""
    parts = _mixed(sig.astype(np.uint64) + np.uint64(1)).reshape(CHUNKS, 1, SLOTS)
    return _mixed((parts * _WEIGHTS).sum(2) + _SALTS).ravel()


def features(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, set_id (16 bytes, equal for equal shingle sets), sig (longs) and keys of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def row(doc_id, text):
        s = shingle_hashes(text, size)
        if not len(s):
            return doc_id, 0, None, None, None
        sig = signature(s)
        return doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()), packed(sig), keys(sig).view(np.int64)

    def run(batches):
        for b in batches:
            schema = pa.schema([("doc_id", b.column(0).type), ("n", pa.int64()), ("set_id", pa.binary()), ("sig", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])
            yield from in_batches((row(i.as_py(), t.as_py()) for i, t in zip(*b.columns)), schema, lambda r: 1024)

    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(run, f"doc_id {kind}, n bigint, set_id binary, sig array<bigint>, keys array<bigint>")


def _shingled(docs: DataFrame, size: int) -> DataFrame:
    """set_id and the full shingle set of each text."""

    def run(batches):
        schema = pa.schema([("set_id", pa.binary()), ("shingles", pa.list_(pa.int64()))])

        def rows():
            for b in batches:
                for t in b.column(0):
                    s = shingle_hashes(t.as_py(), size)
                    yield xxhash.xxh3_128_digest(s.tobytes()), s.view(np.int64)

        yield from in_batches(rows(), schema, lambda r: 64 + r[1].nbytes)

    return docs.mapInArrow(run, "set_id binary, shingles array<bigint>")


def packed(sig: np.ndarray) -> np.ndarray:
    """A signature as CHUNKS longs, a chunk's values in the low bytes of one."""
    full = np.zeros((CHUNKS, 8), np.uint8)
    full[:, :SLOTS] = sig.reshape(CHUNKS, SLOTS)
    return full.view("<i8").ravel()


_LOW, _HIGH = 0x7F7F7F7F7F7F, 0x808080808080


def _differences(a: str, b: str) -> Column:
    """Of two packed signatures, the number of places that differ, for each chunk."""

    def places(x, y):
        z = x.bitwiseXOR(y)
        return F.bit_count((z.bitwiseAND(F.lit(_LOW)) + F.lit(_LOW)).bitwiseOR(z).bitwiseAND(F.lit(_HIGH)))

    return F.zip_with(f"{a}.sig", f"{b}.sig", places)


def _first_met(a: str, b: str, at: Column) -> Column:
    """Whether key number `at` is the first that two signatures share.

    A chunk with one difference shares the key that leaves it out, one without shares all of its keys, the first of
    which counts.
    """
    d = _differences(a, b)
    chunk = F.array_position(F.transform(d, lambda v: v <= 1), F.lit(True)) - 1
    return (chunk == F.floor(at / SLOTS)) & ((at % SLOTS == 0) | (F.get(d, chunk.cast("int")) == 1))


def most_distance(similar: int) -> int:
    """Places beyond which a pair of the least similarity differs with probability under 1e-7."""
    p = 1 - similar / 100
    tail, d = 1.0, -1
    while tail > 1e-7 and d < PLACES:
        d += 1
        tail -= math.comb(PLACES, d) * p**d * (1 - p) ** (PLACES - d)
    return d


def _close(a: str, b: str, similar: int) -> Column:
    """Whether sizes and signatures allow the similarity. Two sizes do if the smaller has that share of the larger."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (100 * small >= similar * large) & (F.aggregate(_differences(a, b), F.lit(0), lambda t, v: t + v) <= most_distance(similar))


def _near(pairs: DataFrame, info: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow the similarity. info: (set_id, n, sig)."""
    x = info.select(F.col("set_id").alias("a"), F.struct("n", "sig").alias("x"))
    y = info.select(F.col("set_id").alias("b"), F.struct("n", "sig").alias("y"))
    return pairs.join(x, "a").join(y, "b").filter(_close("x", "y", similar)).select("a", "b")


def full_sets(docs: DataFrame, picked: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(set_id, shingles) of wanted classes, from their whole texts. picked: (set_id, doc_id), a document of each class."""
    ids = written(picked.join(if_small(wanted), "set_id").select(F.col("doc_id").alias("id")).distinct(), "wanted")
    texts = docs.join(if_small(ids), docs["doc_id"].eqNullSafe(ids["id"]), "left_semi").select("text")
    found = _shingled(texts, size).join(if_small(wanted), "set_id", "left_semi")
    return written(found.dropDuplicates(["set_id"]), "sets")  # rows may share a doc_id


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) of set_ids whose full sets are similar enough."""
    one = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = one.join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * shared >= similar * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def components(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(set_id, comp): the smallest set_id reachable, for each end of (a, b) links. before: components known already.

    Alternates large and small stars: each round links every node to the smallest of its neighbours, first for the larger
    neighbours, then for the smaller ones; the number of rounds grows with the logarithm of the longest path.
    """
    edges = links.select("a", "b")
    if before is not None:
        edges = edges.unionByName(before.filter("set_id <> comp").select(F.col("set_id").alias("a"), F.col("comp").alias("b")))
    edges = written(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u <> v").distinct(), "edges")
    size = edges.count()
    while True:
        # tables counted to be small are joined by broadcast and worked on in FEW tasks
        small_now = size <= BROADCAST_ROWS
        light = (lambda df: F.broadcast(df.coalesce(FEW))) if small_now else (lambda df: df)
        few = (lambda df: df.coalesce(FEW)) if small_now else (lambda df: df)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(light(low), "u").filter("v > u").select(F.col("v").alias("v"), F.col("m").alias("u")).filter("u <> v")
        large = written(few(large), "edges")  # v > u in each row; repeated rows do no harm
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(light(low), "v").select(F.explode(F.array("u", "v")).alias("v"), F.col("m").alias("u")).filter("u <> v").distinct()
        small = written(few(small), "edges")
        before_size, size = size, small.count()
        if size == before_size and small.join(light(edges), ["u", "v"], "left_anti").isEmpty():
            break
        edges = small
    found = small.groupBy("v").agg(F.min("u").alias("comp")).select(F.col("v").alias("set_id"), "comp")
    roots = small.select(F.col("u").alias("set_id")).distinct().select("set_id", F.col("set_id").alias("comp"))
    return written(few(found.unionByName(roots).groupBy("set_id").agg(F.min("comp").alias("comp"))), "comps")


def _labelled(buckets: DataFrame, comps: DataFrame | None) -> DataFrame:
    """(key, set_id, comp) of buckets that touch several components."""
    if comps is None:
        return buckets.withColumn("comp", F.col("set_id"))
    own = buckets.join(if_small(comps), "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id"))
    each = Window.partitionBy("key")
    several = own.withColumn("lo", F.min("comp").over(each)).withColumn("hi", F.max("comp").over(each)).filter("lo <> hi")
    return several.select("key", "at", "set_id", "comp")


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _star(open_rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of each bucket's members with its hub, of different components."""
    me = F.struct(F.xxhash64("set_id").alias("order"), "set_id", "comp")
    with_hub = open_rows.select("set_id", "comp", F.min(me).over(Window.partitionBy("key")).alias("hub"))
    return _ordered(with_hub.filter("comp <> hub.comp"), "set_id", "hub.set_id")


def _all_across(open_rows: DataFrame, info: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and are near, compared inside the join.

    A pair comes out of the first bucket that it shares and of no other, so nothing is emitted twice.
    """
    full = open_rows.join(if_small(info, BROADCAST_SIGNATURES), "set_id").select("key", "at", F.struct("set_id", "comp", "n", "sig").alias("x"))
    other = full.select("key", F.col("at").alias("at_y"), F.col("x").alias("y"))
    met = full.join(other, "key").filter((F.col("at") == F.col("at_y")) & (F.col("x.set_id") < F.col("y.set_id")) & (F.col("x.comp") != F.col("y.comp")) & _close("x", "y", similar) & _first_met("x", "y", F.col("at")))
    return met.select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b"))


def bucket_rows(classes: DataFrame) -> DataFrame:
    """(key, at, set_id) of keys that several classes have; at is the key's number. Keys travel with eight bytes of the set_id, all of it comes back by a join."""
    short = F.xxhash64("set_id")
    rows = classes.select(F.posexplode("keys").alias("at", "key"), short.alias("c")).select(F.col("at").cast("tinyint").alias("at"), "key", "c")
    shared = rows.withColumn("of", F.count("*").over(Window.partitionBy("key"))).filter("of > 1").select("key", "at", "c")
    return shared.join(classes.select(short.alias("c"), "set_id"), "c").select("key", "at", "set_id")


def _heavy(open_rows: DataFrame) -> DataFrame:
    """open_rows with `heavy`: whether their bucket has more than HEAVY rows."""
    return open_rows.withColumn("heavy", F.count("*").over(Window.partitionBy("key")) > HEAVY)


def _within(group: pa.Table, similar: int) -> pa.Table:
    """Of the classes (set_id, comp, shingles) of two blocks, links that join what is joined by any similar pair between components."""
    ids, comps = group.column("set_id").to_pylist(), group.column("comp").to_pylist()
    lists = group.column("shingles").combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    rows = np.repeat(np.arange(len(n)), n)
    _, columns, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = times[columns] > 1  # what one class has alone is in no intersection
    rows, columns = rows[shared], np.unique(columns[shared], return_inverse=True)[1]
    both = np.zeros((len(n), len(n)), np.float32)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for at in range(0, int(columns[-1]) + 1 if len(columns) else 0, 4096):
        lo, hi = np.searchsorted(columns, [at, at + 4096])
        part = np.zeros((len(n), 4096), np.float32)
        part[rows[lo:hi], columns[lo:hi] - at] = 1
        both += part @ part.T
    near = 100 * both >= similar * (n[:, None] + n[None, :] - both)
    root = {c: c for c in comps}

    def top(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    links = []
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        x, y = top(comps[i]), top(comps[j])
        if x != y:
            root[x] = y
            links.append((ids[i], ids[j]))
    return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})


def _in_blocks(heavy_rows: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Links (a, b) that join all components which similar pairs in heavy buckets join.

    Buckets that share a class are one family; a family's classes are dealt to blocks of about BLOCK classes and at most
    about BLOCK_SHINGLES shingles, and every two blocks meet in a task of their own, where intersections of the full sets
    are a matrix product. So memory is bounded by a block, work is dealt out whatever a family's size, and no pair is a row: only links between components come out.
    """
    star = heavy_rows.select(F.col("set_id").alias("a"), F.min("set_id").over(Window.partitionBy("key")).alias("b")).filter("a <> b").distinct()
    families = components(star).withColumnRenamed("comp", "family")
    members = heavy_rows.select("set_id", "comp").distinct().join(families, "set_id")
    shingles = members.join(sets.select("set_id", F.size("shingles").alias("n")), "set_id")
    sizes = shingles.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = members.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    full = placed.join(sets, "set_id")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = full.withColumn("other", other).select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "set_id", "comp", "shingles")
    return dealt.groupBy("family", "i", "j").applyInArrow(lambda t: _within(t, similar), "a binary, b binary")


def link_classes(classes: DataFrame, docs: DataFrame, picked: DataFrame, size: int, similar: int) -> DataFrame | None:
    """(set_id, comp) of the classes with a link, or None. classes: (set_id, n, sig, keys)."""
    buckets = written(bucket_rows(classes), "buckets")
    if buckets.isEmpty():
        return None
    wanted = written(buckets.select("set_id").distinct(), "members")
    sets = full_sets(docs, picked, wanted, size)
    info = written(classes.select("set_id", "n", "sig").join(if_small(wanted), "set_id", "left_semi"), "info")
    near = written(_near(_star(_labelled(buckets, None)), info, similar), "pairs")
    links = written(_confirmed(near, sets, similar), "links")
    comps = None if links.isEmpty() else components(links)
    open_rows = written(_heavy(_labelled(buckets, comps)), "open")
    heavy_rows = open_rows.filter("heavy")
    near = written(_all_across(open_rows.filter("not heavy"), info, similar), "pairs")
    more = _confirmed(near, sets, similar)
    if not heavy_rows.isEmpty():
        more = more.unionByName(_in_blocks(heavy_rows, sets, similar))
    more = written(more, "links")
    return comps if more.isEmpty() else components(more, comps)


def near_duplicates(docs: DataFrame, size: int = 5, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text).

    size: words in a shingle. similar: least intersection over union, in percent.
    """
    docs = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    found = written(features(docs, size), "features")
    shingled = found.filter("set_id is not null")
    classes = shingled.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("n", "sig", "keys")).alias("f"))
    classes = written(classes.select("set_id", "doc_id", "f.n", "f.sig", "f.keys"), "classes")
    picked = classes.select("set_id", "doc_id")
    comps = link_classes(classes.drop("doc_id"), docs, picked, size, similar)
    if comps is None:
        labels = picked.select("set_id", F.col("doc_id").alias("component_id"))
    else:
        labels = picked.join(comps, "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id"))
        labels = labels.join(labels.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "comp").select("set_id", "component_id")
    own = found.select("doc_id", F.col("n").alias("n_shingles"), "set_id")
    out = own.join(labels.withColumnRenamed("set_id", "of"), F.col("set_id") == F.col("of"), "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, similar: int = SIMILAR) -> DataFrame:
    """The rows of docs, all columns as they are, of one document of each component.

    Of rows that repeat an id one stays; rows without an id all stay, as they cannot be told apart.
    """
    judged = near_duplicates(docs, size, similar).groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("rows"), F.bool_or("kept").alias("kept"))
    judged = written(judged.filter("id is not null and (rows > 1 or not kept)"), "judged")
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    same = F.col("row.doc_id") == F.col("id")
    # ids that go, or repeat, are fewer than those that stay, so texts are seldom shuffled
    once = rows.join(if_small(judged.select("id")), same, "left_anti")
    again = judged.filter("kept").select("id")
    if not again.isEmpty():
        doubled = rows.join(if_small(again), same, "left_semi").withColumn("no", F.row_number().over(Window.partitionBy("row.doc_id").orderBy("row.text")))
        once = once.unionByName(doubled.filter("no = 1").drop("no"))
    return once.select("row.*")
