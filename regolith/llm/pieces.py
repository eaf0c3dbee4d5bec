"""SentencePiece encoding with seeded merge-dropout, and decoding without loss.

Encoding merges adjacent symbols from an agenda ordered by piece score, leftmost first. A candidate taken from the
agenda is skipped if a keyed hash of seed, document id, number of the chunk in its text, place in the chunk and piece falls
under the dropout rate; a skipped candidate comes back only with a new neighbour. So each occurrence of a word is dealt
its own dropout, within a text as between texts. With rate 0 the result is the library's. With the same seed it is the same on any
executor and at any retry, and another seed gives another segmentation.

Texts are encoded in chunks between which no piece can reach: a run of blanks with what follows up to the next blank, and
characters such as line feeds that are in no piece. The agenda of a chunk that repeats in a group of texts is run once
without dropout; an occurrence whose own hashes skip none of its candidates has that result, which is the one it would
get by itself, and every other occurrence runs its own agenda. The agendas of a group run side by side in NumPy.

Decoding: pieces are concatenated as bytes and the blank put before the text is taken off. The blank mark itself
(U+2581) is written as bytes, so that it does not come back as a blank; so every text decodes to itself.

Cases: a null text has no pieces and decodes to the empty text; an empty text likewise; rows are independent; a null id
has variant 0, as has a text encoded without one; characters outside the vocabulary become byte pieces; very long texts are
encoded whole, in a group of their own; an empty table gives an empty result; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import in_batches

RATE, SEED = 0.1, 1
#: Chunks of more letters are encoded one by one; of others STEP at a time. Texts are encoded in groups of GROUP characters.
LONG, STEP, GROUP = 40, 1 << 14, 1 << 19
#: Occurrences that are held against their chunks' candidates at a time.
CHECKED = 1 << 16
NEVER = np.float32(np.inf)
BLANK = "▁"
_M = (1 << 64) - 1
_PLACE, _PIECE, _MUL, _LAST = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Scores, ids and bytes of a model's pieces."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.bytes: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(p.vocab_size()):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
                self.bytes.append(b"")
            else:
                self.ids[piece], self.rank[piece] = i, -p.get_score(i)
                self.bytes.append(piece.replace(BLANK, " ").encode())
        if any(BLANK in x.lstrip(BLANK) for x in self.ids):
            raise ValueError("pieces reach over blanks")
        letters = set("".join(self.ids))
        hard = "".join(c for c in "\n\r\t" if c not in letters)
        self.size = len(self.bytes)
        self.ranks = np.full(self.size + 1, NEVER, np.float32)  # the last is for no piece, whose id is -1
        for piece, r in self.rank.items():
            self.ranks[self.ids[piece]] = r
        self.letter_ids = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for c in letters - {BLANK}:
            if c in self.ids:
                self.letter_ids[ord(c)] = self.ids[c]
        self.letter_ids[ord(" ")] = self.ids[BLANK]
        found = sorted((self.ids[x[:i]] << 20 | self.ids[x[i:]], self.ids[x]) for x in self.ids for i in range(1, len(x)) if x[:i] in self.ids and x[i:] in self.ids)
        keys = np.array([k for k, _ in found], np.int64)
        merged = np.array([m for _, m in found], np.int32)
        bits = int(np.ceil(np.log2(max(2 * len(keys), 2))))
        self.shift = np.uint64(64 - bits)
        # an open-addressed table: a place holds the key and its piece, or is free
        self.slot_keys, self.slot_pieces, self.probes = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32), 0
        slots, open_ = self._slots(keys), np.arange(len(keys))
        while len(open_):
            self.probes += 1
            free = open_[self.slot_keys[slots[open_]] < 0]
            self.slot_keys[slots[free]], self.slot_pieces[slots[free]] = keys[free], merged[free]
            open_ = open_[self.slot_keys[slots[open_]] != keys[open_]]
            slots[open_] = (slots[open_] + 1) % len(self.slot_keys)
        self.chunks = regex.compile(rf" *[^ {hard}]+| +|[{hard}]" if hard else r" *[^ ]+| +").findall


    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _PLACE) >> self.shift).astype(np.int64)

    def letters(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points: a piece's id, or size + code point."""
        return self.letter_ids[points]

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the pieces that two symbols make, -1 where they make none."""
        known = (a >= 0) & (b >= 0) & (a < self.size) & (b < self.size)
        keys = np.where(known, a.astype(np.int64) << 20 | b, -2)
        at = self._slots(keys)
        out = np.where(self.slot_keys[at] == keys, self.slot_pieces[at], -1)
        unsure = np.flatnonzero((self.slot_keys[at] != keys) & (self.slot_keys[at] >= 0) & known)
        flat_out, flat_keys, flat_at = out.ravel(), keys.ravel(), at.ravel()
        for _ in range(self.probes):
            if not len(unsure):
                break
            flat_at[unsure] = (flat_at[unsure] + 1) % len(self.slot_keys)
            held = self.slot_keys[flat_at[unsure]]
            hit = held == flat_keys[unsure]
            flat_out[unsure[hit]] = self.slot_pieces[flat_at[unsure[hit]]]
            unsure = unsure[~hit & (held >= 0)]
        return flat_out.reshape(np.shape(out))


class Encoder:
    """Encodes and decodes with one vocabulary, rate and seed."""

    def __init__(self, path: str, rate: float = RATE, seed: int = SEED):
        self.vocabulary, self.seed = Vocabulary(path), seed
        self.bar = int(rate * (1 << 32))

    def merged(self, chunk: str, key: int) -> list[str]:
        """The pieces of a chunk. key: hash of seed and occurrence."""
        rank, ids, bar = self.vocabulary.rank, self.vocabulary.ids, self.bar
        # the blank mark itself gets two letters, which no piece has
        symbols = [BLANK if c == " " else c if c != BLANK else "\0" + BLANK for c in chunk]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            piece = symbols[i] + symbols[i + 1]
            if piece in rank:
                agenda.append((rank[piece], i, i + 1, piece))
        heapify(agenda)
        while agenda:
            r, i, j, piece = heappop(agenda)
            a, b = symbols[i], symbols[j]
            if not a or not b or after[i] != j or a + b != piece:
                continue  # a neighbour has changed meanwhile
            if bar:
                h = (key ^ (i * int(_PLACE) + ids[piece] * int(_PIECE))) & _M
                h = (h ^ h >> 29) * int(_MUL) & _M
                if h >> 32 < bar:
                    continue
            symbols[i], symbols[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                piece = symbols[i] + symbols[k]
                if piece in rank:
                    heappush(agenda, (rank[piece], i, k, piece))
            k = before[i]
            if k >= 0:
                piece = symbols[k] + symbols[i]
                if piece in rank:
                    heappush(agenda, (rank[piece], k, i, piece))
        return [s for s in symbols if s]

    def _keys(self, variants: np.ndarray) -> np.ndarray:
        """Keys of occurrences: seed and variant, mixed."""
        x = variants + np.uint64(xxhash.xxh3_64_intdigest(b"", self.seed))
        x = (x ^ (x >> np.uint64(30))) * _MUL
        x = (x ^ (x >> np.uint64(27))) * _LAST
        return x ^ (x >> np.uint64(31))

    def chunk_ids(self, chunk: str, variant: int) -> bytes:
        """Ids (bytes of int32) of one occurrence of a chunk."""
        return self._alone(chunk, int(self._keys(np.array([variant], np.uint64))[0]))

    def _alone(self, chunk: str, key: int) -> bytes:
        ids, out = self.vocabulary.ids, []
        for s in self.merged(chunk, key):
            if s in ids:
                out.append(ids[s])
            else:
                out.extend(self.vocabulary.byte_ids[b] for b in (BLANK if s[0] == "\0" and len(s) == 2 else s).encode("utf-8", "surrogatepass"))
        return np.array(out, "<i4").tobytes()

    def many_ids(self, chunks: list[str], variant) -> list[bytes]:
        """chunk_ids of each chunk; variant is one number, or an array with one for each."""
        keys = self._keys(np.broadcast_to(np.asarray(variant, np.uint64), len(chunks)))
        table = dict.fromkeys(chunks)
        distinct = list(table)
        table.update(zip(distinct, range(len(distinct))))
        which = np.fromiter(map(table.__getitem__, chunks), np.int64, len(chunks))
        lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))
        # what occurs once, or is long, is encoded by itself
        shared = (lengths <= LONG) & (np.bincount(which, minlength=len(distinct)) > 1) if self.bar else lengths > 0
        at = np.flatnonzero(shared)
        plain: list[bytes] = [b""] * len(distinct)
        trail: list[tuple[np.ndarray, np.ndarray]] = []
        for i, ids in zip(at.tolist(), self._in_steps([distinct[i] for i in at.tolist()], None, trail)):
            plain[i] = ids
        own = ~shared[which]
        if trail and self.bar:
            own |= self._skipping(keys, np.where(own, -1, (np.cumsum(shared) - 1)[which]), len(at), trail)
        out = list(map(plain.__getitem__, which.tolist()))
        some = np.flatnonzero(own)
        for i, ids in zip(some.tolist(), self._in_steps([chunks[i] for i in some.tolist()], keys[some])):
            out[i] = ids
        return out

    def _skipping(self, keys: np.ndarray, which: np.ndarray, n: int, trail: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of occurrences of the chunks `which` (-1 for none): does a key skip any candidate of the chunk's trail?"""
        rows = np.concatenate([r for r, _ in trail])
        marks = np.concatenate([m for _, m in trail])[np.argsort(rows, kind="stable")]
        counts = np.bincount(rows, minlength=n)
        starts = np.cumsum(counts) - counts
        out = np.zeros(len(keys), bool)
        known = np.flatnonzero(which >= 0)
        for k in range(0, len(known), CHECKED):
            some = known[k : k + CHECKED]
            chunk = which[some]
            many = counts[chunk]
            each = np.repeat(np.arange(len(some)), many)
            at = np.arange(len(each)) + np.repeat(starts[chunk] - (np.cumsum(many) - many), many)
            out[some[each[self._skips(keys[some][each], marks[at])]]] = True
        return out

    def _skips(self, keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Whether keys skip candidates, a mark being made of a candidate's place and piece."""
        h = keys ^ marks
        return ((h ^ (h >> np.uint64(29))) * _MUL) >> np.uint64(32) < np.uint64(self.bar)

    def _in_steps(self, chunks: list[str], keys: np.ndarray | None, trail: list | None = None) -> list[bytes]:
        """Ids of each chunk by its key, or without dropout. Short ones go through the agenda together, a step of each at a time."""
        out: list[bytes] = [b""] * len(chunks)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        for low, high in ((0, 6), (6, 10), (10, 16), (16, LONG)):
            at = np.flatnonzero((lengths > low) & (lengths <= high))
            for k in range(0, len(at), STEP):
                some = at[k : k + STEP]
                steps: list[tuple[np.ndarray, np.ndarray]] = []
                found = self._together([chunks[i] for i in some.tolist()], lengths[some], None if keys is None else keys[some], steps if trail is not None else None)
                for i, ids in zip(some.tolist(), found):
                    out[i] = ids
                if trail is not None:
                    trail.extend((some[row], marks) for row, marks in steps)
        for i in np.flatnonzero(lengths > LONG).tolist():
            out[i] = self._alone(chunks[i], 0 if keys is None else int(keys[i]))
        return out

    def _together(self, chunks: list[str], lengths: np.ndarray, keys: np.ndarray | None, steps: list | None) -> list[bytes]:
        """Ids of short chunks. steps, if any, gets the rows and marks of the candidates taken."""
        v = self.vocabulary
        n, width = len(chunks), int(lengths.max())
        drops = keys is not None and self.bar > 0
        keys = keys if drops else np.zeros(n, np.uint64)
        inside = np.arange(width) < lengths[:, None]
        symbols = np.full((n, width), -1, np.int32)
        symbols[inside] = v.letters(np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4"))
        done, row = symbols.copy(), np.arange(n)
        place = np.broadcast_to(np.arange(width, dtype=np.int32), (n, width)).copy()
        pieces = np.full((n, width), -1, np.int32)
        pieces[:, :-1] = v.pairs(symbols[:, :-1], symbols[:, 1:])
        ranks = v.ranks[pieces]
        columns = np.arange(width - 1)
        while len(row):
            best = ranks.argmin(1)
            every = np.arange(len(row))
            more = ranks[every, best] < NEVER
            if not more.all():
                done[row[~more]] = symbols[~more]
                symbols, place, pieces, ranks, row, keys, best = (x[more] for x in (symbols, place, pieces, ranks, row, keys, best))
                every = every[: len(row)]
                if not len(row):
                    break
            piece = pieces[every, best]
            skip = np.zeros(len(row), bool)
            if drops or steps is not None:
                marks = place[every, best].astype(np.uint64) * _PLACE + piece.astype(np.uint64) * _PIECE
                if steps is not None:
                    steps.append((row, marks))
                if drops:
                    skip = self._skips(keys, marks)
                    ranks[every[skip], best[skip]] = NEVER
            go = every[~skip]
            if not len(go):
                continue
            j = best[go]
            symbols[go, j] = piece[go]
            moved = columns > j[:, None]  # what stands right of the merged pair moves left by one
            for x, end in ((symbols, -1), (place, 0), (pieces, -1), (ranks, NEVER)):
                part = x[go]
                part[:, :-1] = np.where(moved, part[:, 1:], part[:, :-1])
                part[:, -1] = end
                x[go] = part
            right = symbols[go, np.minimum(j + 1, width - 1)]
            found = v.pairs(symbols[go, j], np.where(j + 1 < width, right, -1))
            pieces[go, j], ranks[go, j] = found, v.ranks[found]
            left = j > 0
            found = v.pairs(symbols[go[left], j[left] - 1], symbols[go[left], j[left]])
            pieces[go[left], j[left] - 1], ranks[go[left], j[left] - 1] = found, v.ranks[found]
        used = done >= 0
        flat, ends = done[used].astype("<i4"), used.sum(1).cumsum().tolist()
        raw, starts = flat.tobytes(), [0, *ends[:-1]]
        out = [raw[4 * a : 4 * b] for a, b in zip(starts, ends)]
        for i in np.flatnonzero((done >= v.size).any(1)).tolist():  # letters that are in no piece
            ids: list[int] = []
            for x in flat[starts[i] : ends[i]].tolist():
                ids.extend([x] if x < v.size else (v.byte_ids[b] for b in chr(x - v.size).encode("utf-8", "surrogatepass")))
            out[i] = np.array(ids, "<i4").tobytes()
        return out

    def encode(self, text: str | None, variant: int = 0) -> np.ndarray:
        return next(self.encode_many([(text, variant)]))

    def encode_many(self, texts: list[tuple[str | None, int]]) -> Iterator[np.ndarray]:
        """Ids of each (text, variant); the chunks of a text have the variants from the text's on."""
        cut = [self.vocabulary.chunks(" " + t) if t else [] for t, _ in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        ends = np.cumsum(sizes)
        first = np.array([v & _M for _, v in texts], np.uint64)
        number = np.arange(sizes.sum()) - np.repeat(ends - sizes, sizes)
        ids = self.many_ids([c for chunks in cut for c in chunks], np.repeat(first, sizes) + number.astype(np.uint64))
        for a, b in zip((ends - sizes).tolist(), ends.tolist()):
            yield np.frombuffer(b"".join(ids[a:b]), "<i4")

    def decode(self, ids) -> str:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]

    def variant(self, doc_id) -> int:
        return xxhash.xxh3_64_intdigest(str(doc_id), self.seed) if doc_id is not None else 0


def _groups(rows) -> Iterator[list]:
    """Lists of (id, text) rows of about GROUP characters."""
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += len(r[1] or "")
        if weight >= GROUP:
            yield held
            held, weight = [], 0
    if held:
        yield held


def _workers_own(path: str, rate: float, seed: int):
    made: dict[str, Encoder] = {}

    def get() -> Encoder:
        if not made:
            made["x"] = Encoder(path, rate, seed)
        return made["x"]

    return get


def _encoded(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[tuple]:
    """(id, text, ids) of the rows (id, text) of a batch."""
    for group in _groups((i.as_py(), t.as_py()) for i, t in zip(*batch.columns)):
        for (i, text), ids in zip(group, encoder.encode_many([(t, encoder.variant(i)) for i, t in group])):
            yield i, text, ids


def encode_documents(docs: DataFrame, rate: float = RATE, seed: int = SEED, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids (array of int) of each whole text."""
    kind, own = docs.schema["doc_id"].dataType.simpleString(), _workers_own(path or model_path(), rate, seed)

    def run(batches):
        encoder = own()
        for b in batches:
            schema = pa.schema([("doc_id", b.column(0).type), ("n_pieces", pa.int64()), ("ids", pa.list_(pa.int32()))])
            rows = ((i, len(ids), ids) for i, _, ids in _encoded(encoder, b))
            yield from in_batches(rows, schema, lambda r: 32 + 4 * r[1])
        pa.default_memory_pool().release_unused()  # the worker waits for its next task with what it needs only

    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(run, f"doc_id {kind}, n_pieces bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of each row of (doc_id, ids)."""
    kind, own = encoded.schema["doc_id"].dataType.simpleString(), _workers_own(path or model_path(), 0.0, 0)

    def run(batches):
        decode = own().decode
        for b in batches:
            schema = pa.schema([("doc_id", b.column(0).type), ("text", pa.string())])
            rows = ((i.as_py(), decode(ids.values.to_pylist()) if ids.is_valid else "") for i, ids in zip(*b.columns))
            yield from in_batches(rows, schema, lambda r: 32 + len(r[1]))

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trips(docs: DataFrame, rate: float = RATE, seed: int = SEED, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_sha256, text_sha256 (of the decoded text), lossless of each document."""
    kind, own = docs.schema["doc_id"].dataType.simpleString(), _workers_own(path or model_path(), rate, seed)

    def row(encoder, i, text, ids):
        back = encoder.decode(ids.tolist())
        return i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == (text or "")

    def run(batches):
        encoder = own()
        for b in batches:
            schema = pa.schema([("doc_id", b.column(0).type), ("n_pieces", pa.int64()), ("ids_sha256", pa.string()), ("text_sha256", pa.string()), ("lossless", pa.bool_())])
            yield from in_batches((row(encoder, *x) for x in _encoded(encoder, b)), schema)

    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(run, f"doc_id {kind}, n_pieces bigint, ids_sha256 string, text_sha256 string, lossless boolean")
