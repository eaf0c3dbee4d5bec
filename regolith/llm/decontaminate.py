"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

The index has a posting (doc, position) for every document word that a benchmark item contains, and one row without a word
for each document, whose position is its number of words; it is written as Parquet in the shared folder. Segments keep the
order in which documents were read, so it takes a map and no shuffle, and texts are cut into words once. For each
window of WINDOW item words (or fewer, as the caller says), posting lists are intersected from the rarest term on: postings of the rarest give
alignments (document position less item position), those of the next rarest, moved by its offset, thin them out. On
the alignments that are left all terms of the item are intersected; runs of consecutive matches as long as a window are
phrases, and their words are hit.

Proximity: an item is near in a document if its two rarest words (of those that any document has; ties by word) stand at
most NEAR places apart somewhere, in any order. Postings of the two are met in the order of their places, so the work is
in proportion to the postings.

Sizes: the index is narrow and is scanned, not shuffled. What is joined are postings of rare terms. The documents with
alignments are broadcast only when counted to be few; beyond, the join is by shuffle. The
vocabulary joins by broadcast if Spark finds its file small enough, else by shuffle.

Cases: null and empty texts have no words and no hits; an item of fewer words than a window is one window, without words
none; items with a null id are left out, repeated items count once; repeated documents get equal rows, and rows that
share a doc_id but not the text are told apart by the text's hash; a null doc_id is an id like others; very long texts are
cut into words whole; an item with one such word is near nowhere; empty tables give no hits; further columns are ignored, whatever
their names, and keep_clean returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, if_small, written

WINDOW = 13
#: contaminated: hits, and SHARE * hits >= words.
SHARE = 20
NEAR = 13
#: Fixed value: a word, once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_DOC = ("doc_id", "text_key")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _same(a: DataFrame, b: DataFrame, columns) -> Column:
    """Null-safe equality of doc_id, plain equality of the rest."""
    out = F.lit(True)
    for c in columns:
        out = out & (a[c].eqNullSafe(b[c]) if c == "doc_id" else a[c] == b[c])
    return out


def item_terms(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, item_id, at, word, n): positions of each item's words; n is the length of its windows."""
    own = bench.select(bench["item_id"].alias("item_id"), bench["text"].alias("text")).filter("item_id is not null").distinct()
    own = own.select(F.xxhash64("item_id", "text").alias("item"), "item_id", words(F.col("text")).alias("words"))
    return own.select("item", "item_id", F.least(F.size("words"), F.lit(window)).alias("n"), F.size("words").alias("of"), F.posexplode("words").alias("at", "word"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, text_key, pos, word): postings of the documents' words that are in terms (word); and a row of each document without a word, at the end."""
    own = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("text_key"), F.posexplode(F.array_append(words(docs["text"]), F.lit(None).cast("string"))).alias("pos", "word"))
    found = own.join(terms.select(F.col("word").alias("term")), F.col("word") == F.col("term"), "left").filter("term is not null or word is null")
    return written(found.select(*_DOC, "pos", "word"), "postings")


def posting_counts(index: DataFrame) -> DataFrame:
    """(word, postings), as a table: at most the benchmark's words."""
    return written(index.filter("word is not null").groupBy("word").agg(F.count("*").alias("postings")), "counts")


def anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, at, word, at2, word2): the rarest and the next rarest term of each window that can occur; at2 is null in windows of one word."""
    known = items.join(counts, "word", "left").withColumn("term", F.struct(F.coalesce("postings", F.lit(0)).alias("postings"), "at", "word"))
    each = Window.partitionBy("item").orderBy("at")
    # the window that starts at each position, as an array of at most `window` terms
    framed = known.select("item", "at", "n", "of", F.array_sort(F.collect_list("term").over(each.rowsBetween(0, window - 1))).alias("terms"))
    whole = framed.filter(F.col("at") <= F.col("of") - F.col("n")).filter(F.col("terms")[0]["postings"] > 0)
    second = F.get("terms", 1)
    return whole.select("item", F.col("terms")[0]["at"].alias("at"), F.col("terms")[0]["word"].alias("word"), second["at"].alias("at2"), second["word"].alias("word2")).distinct()


def near_items(items: DataFrame, index: DataFrame, counts: DataFrame, near: int = NEAR) -> DataFrame:
    """(doc_id, text_key, n_near): of each document with proximity matches, how many items are near in it."""
    known = items.select("item", "item_id", "word").distinct().join(counts, "word")
    rarest = known.withColumn("no", F.row_number().over(Window.partitionBy("item").orderBy("postings", "word"))).filter("no <= 2")
    asked = written(rarest.select("item", "item_id", "word"), "rarest")
    met = index.join(if_small(asked), "word")
    line = Window.partitionBy(*_DOC, "item").orderBy("pos")
    # with two words, the nearest places of different ones stand next to each other
    pair = (F.lag("word").over(line) != F.col("word")) & (F.col("pos") - F.lag("pos").over(line) <= near)
    return met.withColumn("pair", pair).filter("pair").groupBy(*_DOC).agg(F.countDistinct("item_id").alias("n_near"))


def alignments(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """Distinct (doc_id, text_key, item, shift) on which the two rarest terms of some window agree."""
    first = index.join(chosen, "word").select(*_DOC, "item", (F.col("pos") - F.col("at")).alias("shift"), "at2", "word2")
    one = first.filter("word2 is null").select(*_DOC, "item", "shift")
    two = first.filter("word2 is not null").select(*_DOC, "item", "shift", F.col("word2").alias("word"), (F.col("shift") + F.col("at2")).alias("pos")).distinct()
    seconds = index.join(chosen.filter("word2 is not null").select(F.col("word2").alias("word")).distinct(), "word", "left_semi")
    two = two.join(seconds, _same(two, seconds, (*_DOC, "pos", "word")), "left_semi").select(*_DOC, "item", "shift")
    return one.unionByName(two).distinct()


def _indexed(docs: DataFrame, bench: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """items, index and counts of documents against a benchmark."""
    items = written(item_terms(bench, window), "items")
    index = build_index(docs, written(items.select("word").distinct().coalesce(1), "terms"))
    return items, index, posting_counts(index)


def hits(items: DataFrame, index: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, item_id, pos): each document word inside an occurrence of an item's window."""
    chosen = written(anchors(items, counts, window), "anchors")
    aligned = written(alignments(index, chosen), "alignments")
    where = if_small(aligned.select(*_DOC).distinct())
    near = index.join(where, _same(index, where, _DOC), "left_semi")
    expected = aligned.join(items, "item").select(*_DOC, "item", "item_id", "n", "shift", "at", (F.col("shift") + F.col("at")).alias("pos"), "word")
    met = expected.join(near, _same(expected, near, (*_DOC, "pos", "word")), "left_semi")
    line = Window.partitionBy(*_DOC, "item", "shift")
    runs = met.withColumn("run", F.col("at") - F.row_number().over(line.orderBy("at")))
    long = runs.withColumn("length", F.count("*").over(Window.partitionBy(*_DOC, "item", "shift", "run")))
    return long.filter(F.col("length") >= F.col("n")).select(*_DOC, "item_id", "pos")


def judge(docs: DataFrame, bench: DataFrame, window: int = WINDOW, share: int = SHARE, near: int = NEAR) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near of each document."""
    items, index, counts = _indexed(docs, bench, window)
    phrases = _per_document(hits(items, index, counts, window)).select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "n_hit", "items", F.lit(0).cast("bigint").alias("n_near"))
    close = near_items(items, index, counts, near)
    close = close.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.lit(0).alias("n_hit"), F.array().cast("array<string>").alias("items"), "n_near")
    found = phrases.unionByName(close).groupBy("d", "k").agg(F.max("n_hit").alias("n_hit"), F.flatten(F.collect_list("items")).alias("items"), F.max("n_near").alias("n_near"))
    found = written(found, "found")
    own = index.filter("word is null").select(*_DOC, F.col("pos").cast("bigint").alias("n_words"))
    both = own.join(if_small(found), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    n_hit, named = F.coalesce("n_hit", F.lit(0)).cast("bigint"), F.coalesce("items", F.array().cast("array<string>"))
    return both.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(named).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(named, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
    )


def _per_document(found: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_hit, items): hit words and the sorted ids of the items; both bounded by one document's words."""
    return found.groupBy(*_DOC).agg(F.size(F.collect_set("pos")).alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))


def keep_clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The rows of docs, all columns as they are, that are not contaminated."""
    found = written(_per_document(hits(*_indexed(docs, bench, window), window)), "hits").select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "n_hit")
    bad = found.filter("n_hit > 0")
    own = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    over = F.col("row.doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("row.text") == F.col("k")) & (share * F.col("n_hit") >= F.size(words(F.col("row.text"))))
    return own.join(if_small(bad), over, "left_anti").select("row.*")
