r"""Token counts of whole texts, map-side, through two tiers of pre-token lengths.

A text is cut into pre-tokens by the tokenizer's own pattern; the token count is the sum of the pre-tokens' lengths in
tokens. Tier one is a compact hash table of frequent pre-tokens, broadcast: at most FREQUENT entries whatever the input
(two NumPy columns: 64-bit hash, length). Tier two are worker caches of at most CACHE entries: a pre-token that the
first tier lacks is encoded once by the tokenizer and kept. No pre-token of the table is shuffled; counting is a scan and a map.

The frequent pre-tokens come from about SAMPLE whole texts, drawn from all partitions by a scan before and counted where they lie; a task
hands on its MOST most frequent ones, and only these short lists of the sample are summed up by pre-token, in one small
shuffle. They decide how fast a count is found and never its value, so these bounds change no result. The tables compare 64-bit hashes of pre-tokens that were built on the
driver; a pre-token that meets another's hash there is left out of the table.

Cases: a null text counts as empty, with 0 tokens; special strings inside a text count as the tokenizer's default has
it (one token each); rows are independent, so repeated rows repeat their counts; texts with white space outside the
classes that both regular-expression libraries share are counted by the tokenizer itself, as are all texts of a tokenizer
file with another pre-token pattern; very long texts are counted whole; an empty table gives an empty result; of further
columns only those in `keep` come back.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FREQUENT, CACHE, SAMPLE, MOST = 32_768, 200_000, 2_000, 8_192
#: Longer pre-tokens are encoded each time, so that caches stay small.
LONG = 64
#: The pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class may differ between Unicode versions or libraries: texts with others than these are left to
#: the tokenizer. Latin, Greek, Cyrillic, general punctuation and currency are the same in all.
SHARED = regex.compile(r"[\t\n\v\f\r\x20-\x7e\xa0-ȳΑ-ΡΣ-ϿЀ-џ -‧‰-⁞₠-€]*")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as itself, the rest from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cuts_as_expected(tokenizer) -> bool:
    """Whether a tokenizer cuts by PATTERN into bytes, with no normaliser and no blank put before a text."""
    told = json.loads(tokenizer.to_str())
    cut = told.get("pre_tokenizer") or {}
    return not told.get("normalizer") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)


class Lengths(dict):
    """Pre-token to tokens: the frequent tier's hits and the misses encoded so far, at most CACHE of them."""

    def __init__(self, path: str, hashes: np.ndarray, lengths: np.ndarray):
        super().__init__()
        self.tokenizer, self.hashes, self.lengths = _tokenizer(path), hashes, lengths
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.cut = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.find = regex.compile(PATTERN).findall
        self.known = cuts_as_expected(self.tokenizer)
        self.encoded = 0

    def __missing__(self, piece: str) -> int:
        h = np.uint64(xxhash.xxh3_64_intdigest(piece))
        at = int(np.searchsorted(self.hashes, h))
        if at < self.hashes.size and self.hashes[at] == h:
            n = int(self.lengths[at])
        else:
            self.encoded += 1
            n = len(self.model.tokenize(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(BYTE_LETTERS)))
        if len(piece) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.known or not SHARED.fullmatch(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts = [text]
        n = 0
        if self.cut and any(s in text for s in self.specials):
            parts = self.cut.split(text)
            n = len(parts) - 1
        return n + sum(sum(map(self.__getitem__, self.find(p))) for p in parts)


def frequent_pieces(texts, most: int = MOST) -> list[tuple[str, int]]:
    """The most frequent pre-tokens of some texts, with their counts."""
    seen: Counter = Counter()
    find = regex.compile(PATTERN).findall
    for t in texts:
        if t and SHARED.fullmatch(t):
            seen.update(find(t))
    return [(p, n) for p, n in seen.most_common(most) if len(p) <= LONG]


def frequent_lengths(pieces: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of pre-tokens, and their lengths in tokens."""
    tokenizer = _tokenizer(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    pieces = [p for p in pieces if p not in special]
    lengths = [len(e.ids) for e in tokenizer.encode_batch(pieces, add_special_tokens=False)]
    table: dict[int, int | None] = {}
    for p, n in zip(pieces, lengths):
        h = xxhash.xxh3_64_intdigest(p)
        table[h] = n if h not in table else None
    kept = sorted((h, n) for h, n in table.items() if n is not None)
    return np.array([h for h, _ in kept], np.uint64), np.array([n for _, n in kept], np.uint8)


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None, keep: tuple[str, ...] = ("doc_id",), sample: int = SAMPLE) -> DataFrame:
    """The columns `keep`, n_bytes and n_tokens of each row's whole text."""
    path = path or vocabulary_path()

    def pieces(batches):
        found = frequent_pieces(t for b in batches for t in b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["piece", "n"])

    some: list[str] = []
    rows = df.count() if sample else 0  # from the files' footers
    if rows:
        drawn = df.select(df[text]).sample(fraction=min(1.0, sample / rows), seed=3)
        counted = drawn.mapInArrow(pieces, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
        some = [r[0] for r in counted.orderBy(F.desc("n"), "piece").limit(FREQUENT).collect()]
    shared = df.sparkSession.sparkContext.broadcast(frequent_lengths(some, path))
    made: dict[str, Lengths] = {}

    def run(batches):
        if not made:  # one for each worker
            made["x"] = Lengths(path, *shared.value)
        count: Callable[[str], int] = made["x"].count
        for b in batches:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            arrays = [*b.columns[:-1], pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(map(count, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "n_bytes", "n_tokens"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(*(df[k] for k in keep), df[text]).mapInArrow(run, f"{kinds}, n_bytes bigint, n_tokens bigint")
