"""Language-model scores: a log-bilinear neural model trained in NumPy with noise-contrastive estimation.

Outcomes. p(word | context) = p(unit | context) * p(word | class, context). A unit is a frequent word (at least 1/SHARE of
the training tokens, so there are at most SHARE) or one of CLASSES classes, by a hash of a word's last bytes. Inside its class
every other training word is an outcome with a vector of its own, so parameters grow with the vocabulary; words
never seen share one more outcome of each class. Both factors are normalised, so a text has a probability over an open vocabulary.

Context. q = sum of C[i] * R[u[i]] over the ORDER units before (log-bilinear, diagonal). Units score q . Q[u] + b[u]. For the
words of classes, q is rounded to the nearest of STATES centres; a word scores v . centre + bias, so that a class has STATES
sums to be normalised by, whatever its number of words.

Training, all by noise-contrastive estimation:
1. Start values of R, C, Q, b and the centres, by Adagrad in one task, from the texts of smallest hash, up to WARM_TOKENS tokens. All of
   them are trained on from there over all training texts, by the next step; nothing else comes from this sample.
2. R, C, Q and b over all training texts, ROUNDS Newton steps, each over the texts dealt to it by their hash. The noise is the exact unigram
   distribution of all training texts, and is not drawn but expected: each unit is the noise of the tokens of its group, weighted by the
   number of groups. Centres become the means of the contexts near them, of all rounds so far. A last pass counts in which states classes stood.
3. Word vectors over all training texts. Given the centres, the expected loss of a word needs only how often it stood in
   each state; those counts are summed at the word's owner, a task for a slice of the hash range, which fits its words by Newton
   steps on the logistic loss. Vectors are rounded to bytes before classes are summed, so probabilities add up to one.

Sums over texts are of whole numbers, so that scores do not depend on how the table is partitioned.

Corpus. Texts are encoded once into blocks of about BLOCK_TOKENS tokens with a dictionary each, a written table. A block sends
each owner one message with its part of the dictionary and gets one back; neither tokens nor frequent words travel by word.
Nothing that grows is broadcast or collected: the driver sees N, V, the frequent words, and sums by unit, class and state.

Cases: null and empty texts are one end token; ids of any type may be null or repeat (rows are scored one by one); a null id is in
no fold and trains; very long texts are a block of their own; without training texts every count is 0 and the model
stays at its start; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_kind, byte_words, in_batches, written

SHARE, CLASSES, SUFFIX = 2048, 128, 3
ORDER, WIDTH, STATES, DEPTH = 4, 24, 16, 6
BLOCK_TOKENS = 1 << 19
#: Bytes of texts that are cut into words at a time.
TEXT_BYTES = 1 << 21
#: Contexts in one matrix product.
AT_A_TIME = 2048
#: Numbers that a cache holds, of those that are worked on together.
CACHED = 1 << 17
#: Products below this are not trusted.
TINY = 1e-20
#: Tokens whose pushes are held at a time.
SPAN = 1 << 15
#: An owner gets about so many dictionary entries.
OWNED = 1 << 20
WARM_TEXTS, WARM_TOKENS, EPOCHS = 4_000, 1 << 20, 2
NOISE, BATCH, RATE = 32, 1024, 0.05
#: Biases start at the unigram distribution and move by a share of the rate.
BIAS_RATE = 0.2
ROUNDS, GROUPS, LONGEST = 4, 16, 0.25
#: Word vectors are bytes times STEP, pulled to 0 by PULL; words seen once have none.
STEP, PULL, NEWTON = 1 / 16, 4.0, 5
FOLDS, HELD_OUT = 5, 1
END = b"\n"
#: Fixed-point scale of sums. Contexts and centres are whole multiples of 1 / FINE, Q of 1 / FINER, and gradients sum up whole
#: numbers of 1 / PULLED, so that matrix products and sums are exact in whatever order they run.
FIXED, FINE, FINER, PULLED = float(1 << 20), 64, 256, 4096
_NUMBERED = 1 << 56


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def class_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word[-SUFFIX:]) % CLASSES


# blocks


class _Index(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, as byte_words gives them, and each text's number of words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy())
    full = pc.not_equal(pc.binary_length(flat), 0)  # texts that begin or end with a space have empty words there
    if len(flat):
        before = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))]
        return flat.filter(full).cast(pa.large_binary()), np.diff(before[ends], prepend=0)
    return flat.cast(pa.large_binary()), np.zeros(len(texts), np.int64)


def _classes(words: pa.Array) -> np.ndarray:
    """class_of each word of a binary array."""
    ends = pc.binary_slice(words, -SUFFIX, None).dictionary_encode()
    return np.fromiter(map(class_of, ends.dictionary.to_pylist()), np.int8, len(ends.dictionary))[ends.indices.to_numpy()]


def _block(no: int, parts: list[tuple]) -> tuple:
    """Of (doc_ids, held, deals, words, numbers of words) of some texts each: ids, folds, deals, lengths, compressed token numbers, and the dictionary, by hash, with its training counts."""
    lengths = np.concatenate([r[4] for r in parts]) + 1
    held = np.concatenate([r[1] for r in parts])
    found = pa.concat_arrays([r[3] for r in parts]).dictionary_encode()
    index = pa.concat_arrays([found.dictionary, pa.array([END], pa.large_binary())])
    tokens = np.full(lengths.sum(), len(index) - 1, np.uint32)
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(lengths) - 1] = False
    tokens[inner] = found.indices.to_numpy()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, index.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(index))
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    tokens = place[tokens]
    counts = np.bincount(tokens[np.repeat(~held, lengths)], minlength=len(order)).astype(np.int32)
    return no, [i for r in parts for i in r[0]], held.tolist(), [d for r in parts for d in r[2]], lengths.astype(np.int32), packed_tokens(tokens), hashes[order].view(np.int64), counts, _classes(index)[order]


def packed_tokens(tokens: np.ndarray) -> bytes:
    """Token numbers, compressed: first the lowest byte of each, then the next."""
    planes = np.empty((4, len(tokens)), np.uint8)
    for k in range(4):
        planes[k] = tokens >> 8 * k & 255
    return pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpacked_tokens(packed: bytes, many: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * many, "zstd"), np.uint8).reshape(4, -1)
    tokens = planes[0].astype(np.uint32)
    for k in range(1, 4):
        tokens |= planes[k].astype(np.uint32) << 8 * k
    return tokens


def encode(docs: DataFrame) -> DataFrame:
    """The blocks of all texts, written and opened again."""
    kind, own = docs.schema["doc_id"].dataType.simpleString(), arrow_kind(docs, "doc_id")

    def rows(batches):
        no, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            weight = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < b.num_rows:
                # texts that are cut into words together: few bytes, or one text
                many = max(1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + TEXT_BYTES, "right")) - at)
                ids, texts, held = (c.slice(at, many) for c in b.columns)
                at += many
                ids, held = ids.to_pylist(), held.to_numpy(zero_copy_only=False)
                deals = [xxhash.xxh3_64_intdigest(t or b"") & 0x7FFFFFFF for t in texts.cast(pa.large_binary()).to_pylist()]
                words, many = words_of(texts)
                ends = np.r_[0, np.cumsum(many)]
                a = 0
                while a < len(ids):
                    # as many texts as fill the block, the one that fills it whole
                    z = a + 1 + int(np.searchsorted(np.cumsum(many[a:] + 1), BLOCK_TOKENS - size))
                    z = min(z, len(ids))
                    parts.append((ids[a:z], held[a:z], deals[a:z], words.slice(ends[a], ends[z] - ends[a]), many[a:z]))
                    size += int(many[a:z].sum()) + z - a
                    a = z
                    if size >= BLOCK_TOKENS:
                        yield _block(no, parts)
                        no, parts, size = no + 1, [], 0
                        pa.default_memory_pool().release_unused()
        if parts:
            yield _block(no, parts)

    def run(batches):
        schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(own)), ("held", pa.list_(pa.bool_())), ("deals", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("tokens", pa.binary()), ("words", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("classes", pa.list_(pa.int8()))])
        yield from in_batches(rows(batches), schema, lambda r: 64 + len(r[5]) + 13 * len(r[6]))
        pa.default_memory_pool().release_unused()  # the worker waits for its next task with what it needs only

    out = f"block bigint, doc_ids array<{kind}>, held array<boolean>, deals array<int>, lengths array<int>, tokens binary, words array<bigint>, counts array<int>, classes array<tinyint>"
    return written(docs.select(docs["doc_id"], docs["text"], held_out(docs["doc_id"]).alias("held")).mapInArrow(run, out), "blocks")


def frequent_words(blocks: DataFrame, share: int = SHARE) -> list[tuple[int, int]]:
    """(word, training count) of all words with at least 1/share of the training tokens, exactly, by falling count.

    A word that reaches the share has half of it in blocks where its own share is at least half as large. So the sums
    over such blocks name at most 2 * share candidates, and only those are counted everywhere.
    """
    own = blocks.select("words", "counts", F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, c: s + c).alias("of"))
    total = own.agg(F.sum("of")).first()[0] or 0
    entries = own.select("of", F.explode(F.arrays_zip("words", "counts")).alias("e")).filter("e.counts > 0")
    often = entries.filter(F.col("e.counts") * (2 * share) >= F.col("of")).groupBy(F.col("e.words").alias("word")).agg(F.sum("e.counts").alias("n"))
    candidates = [r[0] for r in often.filter(F.col("n") * (2 * share) >= total).select("word").collect()]
    if not candidates:
        return []
    exact = entries.filter(F.col("e.words").isin(candidates)).groupBy(F.col("e.words").alias("word")).agg(F.sum("e.counts").alias("n"))
    return sorted(((r[0], r[1]) for r in exact.filter(F.col("n") * share >= total).collect()), key=lambda r: (-r[1], r[0]))


# units and contexts


class Units:
    """The frequent words, then the classes."""

    def __init__(self, frequent: list[tuple[int, int]]):
        self.frequent = len(frequent)
        order = sorted((w, i) for i, (w, _) in enumerate(frequent))
        self.words, self.numbers = np.array([w for w, _ in order], np.int64), np.array([i for _, i in order], np.int64)

    @property
    def size(self) -> int:
        return self.frequent + CLASSES

    def of(self, words: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Units of dictionary words."""
        units = self.frequent + classes.astype(np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            units = np.where(self.words[at] == words, self.numbers[at], units)
        return units


def places_of(lengths: np.ndarray) -> np.ndarray:
    """The number of each token in its text."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def contexts(units: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """ORDER x tokens: the units before each token, nearest first, `start` before a text's begin."""
    first = np.cumsum(lengths) - lengths
    out = np.full((ORDER, len(units)), start, np.int64)
    for i in range(ORDER):
        out[i, i + 1 :] = units[: max(0, len(units) - i - 1)]
        for k in range(i + 1):
            out[i, first[lengths > k] + k] = start
    return out


@dataclass
class Parameters:
    """R and C make contexts; Q and b score units; centres are the states, and `coordinates` their places in DEPTH dimensions."""

    R: np.ndarray
    C: np.ndarray
    Q: np.ndarray
    b: np.ndarray
    log_noise: np.ndarray
    centres: np.ndarray
    coordinates: np.ndarray

    def moved(self) -> np.ndarray:
        """ORDER x (units + 1) x WIDTH: what each unit adds to a context from each place."""
        return np.rint(self.C[:, None] * self.R * FINE) / np.float32(FINE)

    def predicted(self, before: np.ndarray) -> np.ndarray:
        moved = self.moved()
        q = np.empty((before.shape[1], WIDTH), np.float32)
        for at in range(0, len(q), AT_A_TIME):
            part = moved[0].take(before[0, at : at + AT_A_TIME], 0)
            for i in range(1, ORDER):
                part += moved[i].take(before[i, at : at + AT_A_TIME], 0)
            q[at : at + AT_A_TIME] = part
        return q

    def states(self, q: np.ndarray) -> np.ndarray:
        """The nearest centre of each context, the first of those as near."""
        half, number, out = (self.centres**2).sum(1)[:, None] / 2, np.arange(STATES, dtype=np.uint8)[:, None], np.empty(len(q), np.int8)
        for at in range(0, len(q), AT_A_TIME):
            near = self.centres @ q[at : at + AT_A_TIME].T
            near -= half
            away = np.negative((near != near.max(0)).view(np.uint8))  # 0 or 255
            away |= number
            out[at : at + AT_A_TIME] = away.min(0)
        return out

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        """ORDER x (units + 1) x units: what a unit in each place multiplies the weight of each next unit by, at most 1; and the logs of what they are scaled by."""
        z = self.moved() @ self.Q.T
        z[0] += self.b
        most = z.max(2)
        z -= most[:, :, None]
        return np.exp(z, out=z), most.astype(np.float64)

    def log_units(self, q: np.ndarray, target: np.ndarray, before: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Natural log of the softmax over units at each target.

        A context is a sum over places, so that the weight of a unit is a product over places of factors(), and no exponential is taken
        for a token. Where products come near to what a float can hold, weights are summed from their logs.
        """
        parts, most = factors
        n = len(self.b)
        rows = max(16, CACHED // n)
        total, held = np.empty(len(target), np.float32), np.empty((3, rows, n), np.float32)
        for at in range(0, len(target), rows):
            some = before[:, at : at + rows]
            left, right, more = held[:, : some.shape[1]]
            for half, i in ((left, 0), (right, 2)):
                parts[i].take(some[i], 0, out=half, mode="clip")
                half *= parts[i + 1].take(some[i + 1], 0, out=more, mode="clip")
            np.einsum("tu,tu->t", left, right, out=total[at : at + rows])
        logs = np.log(np.maximum(total, TINY).astype(np.float64))
        for i in range(ORDER):
            logs += most[i].take(before[i])
        tiny = np.flatnonzero(total < TINY)
        for at in range(0, len(tiny), rows):
            some = tiny[at : at + rows]
            z = (q[some] @ self.Q.T + self.b).astype(np.float64)
            logs[some] = z.max(1) + np.log(np.exp(z - z.max(1, keepdims=True)).sum(1))
        own = np.einsum("tk,tk->t", q, self.Q.take(target, 0)) + self.b.take(target)
        return own - logs


def warm(texts: list[list[bytes]], units: Units) -> Parameters:
    """Start values of all parameters from a bounded list of texts, by noise-contrastive Adagrad in random order."""
    rng = np.random.Generator(np.random.PCG64(4))
    index = _Index()
    tokens = np.fromiter((index[w] for ws in texts for w in ws), np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index)).view(np.int64)
    of = units.of(hashes, np.fromiter(map(class_of, index), np.int64, len(index)))
    target = of[tokens] if len(tokens) else np.zeros(0, np.int64)
    n = units.size
    before = contexts(target, np.array([len(ws) for ws in texts], np.int64), n)
    mass = np.bincount(target, minlength=n) + 0.5
    log_noise = np.log(mass / mass.sum())
    p = {"R": rng.normal(0, 0.3, (n + 1, WIDTH)), "C": np.ones((ORDER, WIDTH)), "Q": rng.normal(0, 0.03, (n, WIDTH)), "b": log_noise}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    squares = {k: np.ones_like(v) for k, v in p.items()}
    offset, cells = (np.log(NOISE) + log_noise).astype(np.float32), np.arange(WIDTH)

    def step(name, grad):
        squares[name] += grad * grad
        p[name] += (RATE * BIAS_RATE if name == "b" else RATE) * grad / np.sqrt(squares[name])

    def gathered(rows, values, size):
        return np.bincount((rows[:, None] * WIDTH + cells).ravel(), values.ravel(), size * WIDTH).reshape(size, WIDTH).astype(np.float32)

    for _ in range(EPOCHS):
        order = rng.permutation(len(target))
        noise_all = rng.choice(n, (len(order) // BATCH + 1, NOISE), p=np.exp(log_noise) / np.exp(log_noise).sum())
        for k, at in enumerate(range(0, len(order), BATCH)):
            some = order[at : at + BATCH]
            ctx, w, noise = before[:, some], target[some], noise_all[k]
            r = p["R"][ctx]
            q = (p["C"][:, None] * r).sum(0)
            good = 1 / (1 + np.exp((q * p["Q"][w]).sum(1) + p["b"][w] - offset[w]))  # 1 - sigmoid
            bad = -1 / (1 + np.exp(-(q @ p["Q"][noise].T + p["b"][noise] - offset[noise])))
            dq = good[:, None] * p["Q"][w] + bad @ p["Q"][noise]
            rows = np.concatenate([w, noise])
            step("Q", gathered(rows, np.concatenate([good[:, None] * q, bad.T @ q]), n))
            step("b", np.bincount(rows, np.concatenate([good, bad.sum(0)]), n).astype(np.float32))
            step("R", gathered(ctx.ravel(), (p["C"][:, None] * dq).reshape(-1, WIDTH), n + 1))
            step("C", (dq * r).sum(1))
    done = Parameters(p["R"], p["C"], _finer(p["Q"]), p["b"], log_noise, np.zeros((STATES, WIDTH), np.float32), np.zeros((STATES, DEPTH)))
    if len(target):
        q = done.predicted(before[:, np.sort(rng.permutation(len(target))[: 1 << 16])])
        done.centres, done.coordinates = _centres(q, rng)
    return done


def _centres(q: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """STATES means of contexts, and their places."""
    centres = q[rng.integers(0, len(q), STATES)].copy()
    for _ in range(12):
        near = (q @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        sums = np.stack([np.bincount(near, q[:, i], STATES) for i in range(WIDTH)], 1)
        many = np.bincount(near, minlength=STATES)
        centres[many > 0] = (sums[many > 0] / many[many > 0][:, None]).astype(np.float32)
    centres = np.rint(centres * FINE) / np.float32(FINE)
    return centres, _coordinates(centres, np.bincount((q @ centres.T - (centres**2).sum(1) / 2).argmax(1), minlength=STATES) / len(q))


def _coordinates(centres: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Places of the centres along their DEPTH main directions, scaled to unit spread; share: of all contexts, in each state."""
    apart = (centres - share @ centres) * np.sqrt(share)[:, None]
    _, spread, axes = np.linalg.svd(apart, full_matrices=False)
    places = (centres - share @ centres) @ axes[:DEPTH].T
    return np.clip(places / np.maximum(spread[:DEPTH], 1e-6), -3, 3)


def warm_parameters(docs: DataFrame, units: Units) -> Parameters:
    """warm() of the training texts of smallest hash, in one task: where refine() starts.

    About twice as many as are wanted pass a bound on the hash where they lie, so that few texts travel however many
    partitions there are.
    """
    trained = docs.select(F.xxhash64(docs["doc_id"], docs["text"]).alias("key"), docs["doc_id"], docs["text"]).filter(~held_out(F.col("doc_id")))
    share = 2 * WARM_TEXTS / max(1, trained.select("doc_id").count())
    if share < 1:
        trained = trained.filter(F.col("key") < int((share - 0.5) * (1 << 64)))
    some = trained.select("key", "text").orderBy("key", "text").limit(WARM_TEXTS)
    shared = docs.sparkSession.sparkContext.broadcast(units)

    def run(batches):
        rows = sorted(((k.as_py(), t.as_py() or "") for b in batches for k, t in zip(*b.columns)))
        texts, size = [], 0
        for _, t in rows:
            texts.append([*byte_words(t), END])
            size += len(texts[-1])
            if size >= WARM_TOKENS:
                break
        got = warm(texts, shared.value)
        for k, v in vars(got).items():
            yield pa.RecordBatch.from_pydict({"name": [k], "shape": [list(v.shape)], "data": [v.astype(float).ravel()]})

    rows = some.coalesce(1).mapInArrow(run, "name string, shape array<bigint>, data array<double>").collect()
    if not rows:
        return warm([], units)
    found = {r[0]: np.array(r[2]).reshape(r[1]) for r in rows}
    return Parameters(**{k: v.astype(np.float32) if k in ("R", "C", "Q", "b", "centres") else v for k, v in found.items()})


# contexts and units over all texts


def _numpy(x, kind=None) -> np.ndarray:
    """A list value of an Arrow column as an array."""
    got = x.values.to_numpy(zero_copy_only=False)
    return got if kind is None else got.astype(kind)


@dataclass
class Opened:
    """A block's tokens as places in its dictionary, their units and contexts."""

    tokens: np.ndarray
    lengths: np.ndarray
    units: np.ndarray
    before: np.ndarray
    q: np.ndarray


def _opened(units_of: np.ndarray, p: Parameters, row: dict, texts: np.ndarray | None = None) -> Opened:
    """A block, or only those of its texts at which `texts` is true."""
    tokens, lengths = row["tokens"], _numpy(row["lengths"], np.int64)
    tokens = unpacked_tokens(tokens.as_buffer(), lengths.sum())
    if texts is not None:
        tokens, lengths = tokens[np.repeat(texts, lengths)], lengths[texts]
    of = units_of[tokens]
    before = contexts(of, lengths, len(p.b))
    return Opened(tokens, lengths, of, before, p.predicted(before))


@dataclass
class Sums:
    """Sums over training texts, whole numbers all: tokens; what targets pull and noise of weight one, in 1 / (PULLED * FINE); their curvature, in
    1 / PULLED^2; squares of contexts, in 1 / FINE^2; what contexts are pulled by, for each unit in each place, in 1 / PULLED; and how often
    each unit is in each place of the contexts of each state."""

    tokens: np.ndarray
    pulls: np.ndarray
    bends: np.ndarray
    squares: np.ndarray
    pushes: np.ndarray
    near: np.ndarray

    @classmethod
    def of(cls, n: int, flat: np.ndarray | None = None) -> Sums:
        """Views of a flat array, zeros if there is none; n: the number of units."""
        shapes = [(1,), (2, n, WIDTH + 1), (2, n), (WIDTH + 1, WIDTH + 1), (ORDER, n + 1, WIDTH), (STATES, ORDER, n + 1)]
        ends = np.cumsum([0, *(np.prod(x) for x in shapes)])
        flat = np.zeros(ends[-1]) if flat is None else flat
        return cls(*(flat[a:z].reshape(x) for a, z, x in zip(ends, ends[1:], shapes)))

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in vars(self).values()])


def _weights(p: Parameters) -> np.ndarray:
    """What noise of weight one stands for."""
    return GROUPS * NOISE * np.exp(p.log_noise)


def _add(sums: Sums, p: Parameters, before: np.ndarray, q: np.ndarray, target: np.ndarray, group: np.ndarray) -> None:
    n = len(p.b)
    offset = (np.log(NOISE) + p.log_noise).astype(np.float32)
    own, noise = p.Q.astype(float) * FINER * 16, np.rint(_weights(p)[:, None] * p.Q * FINER * 16)
    sums.tokens += len(target)

    def sigmoid(z):
        np.exp(np.negative(z, out=z), out=z)
        z += 1
        np.divide(np.float32(PULLED), z, out=z)
        return np.rint(z, out=z).astype(float)

    for at in range(0, len(q), SPAN):
        x, w, group_, there = q[at : at + SPAN], target[at : at + SPAN], group[at : at + SPAN], before[:, at : at + SPAN]
        state = p.states(x).astype(np.int64) * (n + 1)
        for i in range(ORDER):
            sums.near[:, i] += np.bincount(state + there[i], minlength=STATES * (n + 1)).reshape(STATES, n + 1)
        full, good = np.full((len(x), WIDTH + 1), float(FINE)), np.empty(len(x))
        for a in range(0, len(x), AT_A_TIME):
            part, mine = full[a : a + AT_A_TIME], w[a : a + AT_A_TIME]
            np.multiply(x[a : a + AT_A_TIME], FINE, out=part[:, :WIDTH])
            sums.squares += part.T @ part
            good[a : a + AT_A_TIME] = PULLED - sigmoid(np.einsum("tk,tk->t", x[a : a + AT_A_TIME], p.Q.take(mine, 0)) + (p.b - offset).take(mine))
        sums.bends[0] += np.bincount(w, good * (PULLED - good), n)
        for u, some in _each(w, n):
            sums.pulls[0, u] += good.take(some) @ full.take(some, 0)
        row, units = _lined_up(there, w)
        pushes = np.zeros((len(units) + ORDER, WIDTH), np.float32)
        step = max(256, CACHED // max(n // GROUPS, WIDTH))
        for g, some in _each(group_, GROUPS, step):
            push = good.take(some)[:, None] * own.take(w.take(some), 0)
            if g < n:
                bad = p.Q[g::GROUPS] @ x.take(some, 0).T
                bad += (p.b - offset)[g::GROUPS, None]
                bad = sigmoid(bad)
                pulls = bad @ full.take(some, 0)
                sums.pulls[1, g::GROUPS] += pulls
                sums.bends[1, g::GROUPS] += PULLED * pulls[:, WIDTH] / FINE - np.einsum("ut,ut->u", bad, bad)
                push -= bad.T @ noise[g::GROUPS]
            push /= FINER * 16
            pushes[row.take(some)] = np.rint(push, out=push)
        # a token is in the contexts of the ORDER rows after its own
        after = np.lib.stride_tricks.as_strided(pushes[1:], (len(units), ORDER * WIDTH), pushes.strides, writeable=False)
        # so many are added at a time that a sum of whole numbers is exact
        ones = np.ones(int(min(AT_A_TIME, max(1, (1 << 24) // max(1, pushes.max(), -pushes.min())))), np.float32)
        for u, some in _each(units, n + 1, len(ones)):
            sums.pushes[:, u] += (ones[: len(some)] @ after[some]).reshape(ORDER, WIDTH)


def _each(numbers: np.ndarray, most: int, step: int = AT_A_TIME):
    """(number, places where it stands), some places at a time."""
    order = np.argsort(numbers.astype(np.uint16 if most <= 1 << 16 else np.int64), kind="stable")
    ends = np.searchsorted(numbers[order], np.arange(most + 1)).tolist()
    for k, (a, z) in enumerate(zip(ends, ends[1:])):
        for at in range(a, z, step):
            yield k, order[at : min(at + step, z)]


def _lined_up(before: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows such that the ORDER rows before a token's hold the units before it: the row of each token, and the unit of each row.

    Where a text begins, the units before it have rows of their own.
    """
    head = np.ones(len(target), bool)
    head[1:] = before[0, 1:] != target[:-1]
    for i in range(1, ORDER):
        head[1:] |= before[i, 1:] != before[i - 1, :-1]
    row = np.arange(len(target)) + ORDER * np.cumsum(head)
    units = np.empty(len(target) + ORDER * head.sum(), np.int64)
    units[row] = target
    for i in range(ORDER):
        units[row[head] - 1 - i] = before[i, head]
    return row, units


def stepped(p: Parameters, no: int, sums: Sums, near: np.ndarray) -> Parameters:
    """p after a Newton step on sums; later steps are shorter, none is longer than LONGEST. near: as in Sums, of all rounds so far.

    The curvature of a unit's loss counts as independent of the context, and that of a context's loss as that of the mean context, so that
    both come from the sums.
    """
    tokens, eye = sums.tokens[0], np.eye(WIDTH)
    if not tokens:
        return p
    weight = _weights(p)
    bends = (sums.bends[0] + weight * sums.bends[1]) / PULLED**2
    grad = (sums.pulls[0] - weight[:, None] * sums.pulls[1]) / (PULLED * FINE)
    square = sums.squares / (FINE * FINE * tokens)
    own = np.linalg.solve(bends[:, None, None] * square + np.eye(WIDTH + 1), grad[:, :, None])[:, :, 0]
    R, C, Q = p.R.astype(float), p.C.astype(float), p.Q.astype(float)
    bend, pushes, there = (bends[:, None] * Q).T @ Q / tokens, sums.pushes / PULLED, sums.near.sum(0)
    scale = np.einsum("iu,ia,ib->uab", there, C, C) * bend + eye
    rows = np.linalg.solve(scale, np.einsum("ia,iua->ua", C, pushes)[:, :, None])[:, :, 0]
    scale = np.einsum("iu,ua,ub->iab", there, R, R, optimize=True) * bend + eye
    places = np.linalg.solve(scale, np.einsum("ua,iua->ia", R, pushes)[:, :, None])[:, :, 0]

    def short(step):
        return step / (np.maximum(1, np.sqrt((step**2).sum(1, keepdims=True)) / LONGEST) * (no + 1))

    own = short(own)
    done = Parameters(**vars(p) | {"R": (R + short(rows)).astype(np.float32), "C": (C + short(places)).astype(np.float32), "Q": _finer(Q + own[:, :WIDTH]), "b": (p.b + own[:, WIDTH]).astype(np.float32)})
    many = near[:, 0].sum(1)
    means = np.einsum("siu,iuw->sw", near, done.moved().astype(float), optimize=True) / np.maximum(many, 1)[:, None]
    done.centres = (np.rint(np.where(many[:, None] > 0, means, p.centres) * FINE) / FINE).astype(np.float32)
    done.coordinates = _coordinates(done.centres, many / many.sum())
    return done


def _finer(x: np.ndarray) -> np.ndarray:
    return (np.rint(x * FINER) / FINER).astype(np.float32)


def _summed(blocks: DataFrame, columns: tuple, shared, size: int, each) -> np.ndarray:
    """The sum over blocks of arrays of so many whole numbers; each: of shared and a row of these columns, or None."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for r in range(b.num_rows):
                got = each(shared.value, {c: b.column(i)[r] for i, c in enumerate(columns)})
                if got is not None:
                    total += got.astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "value"])

    sums = np.zeros(size)
    for r in blocks.select(*columns).mapInArrow(run, "at int, value bigint").groupBy("at").agg(F.sum("value")).collect():
        sums[r[0]] = r[1]
    shared.unpersist()
    return sums


def refine(blocks: DataFrame, units: Units, p: Parameters) -> tuple[Parameters, np.ndarray]:
    """p, which is where they start, trained over all training texts; and how often each class stood in each state there."""
    sc, n, columns = blocks.sparkSession.sparkContext, units.size, ("held", "deals", "lengths", "tokens", "words", "classes")
    counted = _summed(blocks, ("words", "counts", "classes"), sc.broadcast(units), n, lambda units, row: np.bincount(units.of(_numpy(row["words"]), _numpy(row["classes"])), _numpy(row["counts"]), n))
    log_noise = np.log((counted + 0.5) / (counted + 0.5).sum())
    p = Parameters(**vars(p) | {"b": (p.b + log_noise - p.log_noise).astype(np.float32), "log_noise": log_noise})
    near = np.zeros((STATES, ORDER, n + 1))
    for no in range(ROUNDS):

        def sums_of(shared, row, no=no):
            units, p = shared
            deals = _numpy(row["deals"], np.int64)
            texts = ~_numpy(row["held"], bool) & (deals % ROUNDS == no)
            if texts.any():
                o, sums = _opened(units.of(_numpy(row["words"]), _numpy(row["classes"])), p, row, texts), Sums.of(n)
                _add(sums, p, o.before, o.q, o.units, (np.repeat(deals[texts] // ROUNDS, o.lengths) + places_of(o.lengths)) % GROUPS)
                return sums.flat()

        sums = Sums.of(n, _summed(blocks, columns, sc.broadcast((units, p)), len(Sums.of(n).flat()), sums_of))
        near += sums.near
        p = stepped(p, no, sums, near)

    def stood_of(shared, row):
        units, p = shared
        texts = ~_numpy(row["held"], bool)
        if texts.any():
            o = _opened(units.of(_numpy(row["words"]), _numpy(row["classes"])), p, row, texts)
            own = o.units >= units.frequent
            return np.bincount((o.units[own] - units.frequent) * STATES + p.states(o.q[own]), minlength=CLASSES * STATES)

    return p, _summed(blocks, columns, sc.broadcast((units, p)), CLASSES * STATES, stood_of).reshape(CLASSES, STATES)


# words inside their classes


def _exp(x: np.ndarray) -> np.ndarray:
    """exp to the precision of a 32-bit float."""
    return np.exp(x.astype(np.float32)).astype(np.float64)


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of many small positive definite systems, eliminated side by side."""
    rows = np.ascontiguousarray(np.concatenate([a, b[:, :, None]], 2).transpose(1, 2, 0))
    n = len(rows)
    for k in range(n):
        rows[k, k:] /= rows[k, k].copy()
        for j in range(k + 1, n):
            rows[j, k + 1 :] -= rows[j, k] * rows[k, k + 1 :]
    out = rows[:, n]
    for k in range(n - 2, -1, -1):
        for j in range(k + 1, n):
            out[k] -= rows[k, j] * out[j]
    return out.T


def vectors(seen: np.ndarray, prior: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Byte vectors (words x DEPTH) from how often words stood in each state. prior: the states' shares in each word's class.

    Noise-contrastive estimation with the class's unigram as noise: of NOISE expected noise words for each token, a
    word's part in a state is its count times the state's share. Newton steps on vector and bias, a pull on the vector.
    """
    n = seen.sum(1)
    x = np.c_[places, np.ones(STATES)]
    w, noise = np.zeros((len(seen), DEPTH + 1)), NOISE * n[:, None] * prior
    pull = np.r_[np.full(DEPTH, PULL), 1e-3]
    for _ in range(NEWTON):
        s = 1 / (1 + _exp(np.clip(np.log(NOISE) - w @ x.T, -30, 30)))
        grad = (seen * (1 - s) - noise * s) @ x - pull * w
        bend = ((seen + noise) * s * (1 - s)) @ (x[:, :, None] * x[:, None, :]).reshape(STATES, -1)
        w += np.clip(_solved(bend.reshape(-1, DEPTH + 1, DEPTH + 1) + np.diag(pull), grad), -2, 2)
    return np.clip(np.rint(w[:, :DEPTH] / STEP), -127, 127).astype(np.int8)


def weights(counts: np.ndarray, codes: np.ndarray, prior: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Words x STATES: what words weigh in their class; the mean over the class's states is the smoothed count."""
    z = _exp(np.clip(codes * STEP @ places.T, -30, 30))
    return (counts + 0.5)[:, None] * z / (z * prior).sum(1, keepdims=True)


def _packed(codes: np.ndarray) -> np.ndarray:
    full = np.zeros((len(codes), 8), np.int8)
    full[:, :DEPTH] = codes
    return full.view("<i8").ravel()


def _unpacked(facts: np.ndarray) -> np.ndarray:
    return facts.astype("<i8").view(np.int8).reshape(-1, 8)[:, :DEPTH]


def priors(stood: np.ndarray) -> np.ndarray:
    """Shares of the states in each class, smoothed by those of all classes."""
    share = (stood.sum(0) + 1) / (stood.sum() + STATES)
    return (stood + 10 * share) / (stood.sum(1, keepdims=True) + 10)


def _owner_starts(words: np.ndarray, owners: int) -> np.ndarray:
    """Where each owner's slice of a dictionary sorted by unsigned hash begins."""
    edges = (np.arange(owners + 1, dtype=object) * (1 << 64)) // owners
    return np.r_[np.searchsorted(words.view(np.uint64), np.array([int(e) for e in edges[:-1]], np.uint64)), len(words)]


_MESSAGE = "owner int, block bigint, start int, words array<bigint>, classes array<tinyint>, kinds array<int>, states array<tinyint>, times array<int>"


def messages(blocks: DataFrame, units: Units, p: Parameters, owners: int) -> DataFrame:
    """What each block tells each owner: its words there, and in which states they stood how often in training texts."""
    columns = ("block", "held", "lengths", "tokens", "words", "classes")
    shared = blocks.sparkSession.sparkContext.broadcast((units, p))
    schema = pa.schema([("owner", pa.int32()), ("block", pa.int64()), ("start", pa.int32()), ("words", pa.list_(pa.int64())), ("classes", pa.list_(pa.int8())), ("kinds", pa.list_(pa.int32())), ("states", pa.list_(pa.int8())), ("times", pa.list_(pa.int32()))])

    def rows(batches):
        units, p = shared.value
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(i)[r] for i, c in enumerate(columns)}
                words, classes = _numpy(row["words"]), _numpy(row["classes"])
                o = _opened(units.of(words, classes), p, row, ~_numpy(row["held"], bool))
                cells, times = np.unique(o.tokens.astype(np.int64) * STATES + p.states(o.q), return_counts=True)
                kinds = np.bincount(cells // STATES, minlength=len(words))
                ends, starts = np.r_[0, np.cumsum(kinds)], _owner_starts(words, owners)
                states, times = (cells % STATES).astype(np.int8), times.astype(np.int32)
                for k in np.flatnonzero(np.diff(starts)).tolist():
                    a, z = int(starts[k]), int(starts[k + 1])
                    yield k, row["block"].as_py(), a, words[a:z], classes[a:z], kinds[a:z].astype(np.int32), states[ends[a] : ends[z]], times[ends[a] : ends[z]]

    def run(batches):
        yield from in_batches(rows(batches), schema, lambda r: 64 + 13 * len(r[3]) + 5 * len(r[6]))
        pa.default_memory_pool().release_unused()

    return blocks.select(*columns).mapInArrow(run, _MESSAGE)


_REPLY = "block bigint, start int, counts array<bigint>, facts array<bigint>, sums array<double>"


def replies(sent: DataFrame, units: Units, p: Parameters, prior: np.ndarray) -> DataFrame:
    """Counts and facts of the words of each message, in its order; and one row of sums for each owner, whose block is null.

    A fact is a word's packed vector, or _NUMBERED + number of a frequent word. Sums: training tokens, distinct words,
    then what the words of each class weigh in each state.
    """
    shared = sent.sparkSession.sparkContext.broadcast((units, p.coordinates, prior))
    schema = pa.schema([("block", pa.int64()), ("start", pa.int32()), ("counts", pa.list_(pa.int64())), ("facts", pa.list_(pa.int64())), ("sums", pa.list_(pa.float64()))])

    def own(group: pa.Table) -> pa.Table:
        units, places, prior = shared.value

        def flat(name):
            return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in group.column(name).chunks])

        words, which = np.unique(flat("words"), return_inverse=True)
        classes = np.zeros(len(words), np.int64)
        classes[which] = flat("classes")
        cells = np.repeat(which, flat("kinds")) * STATES + flat("states")
        seen = np.bincount(cells, flat("times"), len(words) * STATES).reshape(-1, STATES)
        counts = seen.sum(1).astype(np.int64)
        number = units.of(words, classes)
        often = number < units.frequent
        facts, total = np.zeros(len(words), np.int64), np.zeros((CLASSES, STATES))
        facts[often] = _NUMBERED + number[often]
        known = np.flatnonzero((counts > 0) & ~often)
        for at in range(0, len(known), AT_A_TIME):
            some = known[at : at + AT_A_TIME]
            codes = np.zeros((len(some), DEPTH), np.int8)
            again = counts[some] > 1
            codes[again] = vectors(seen[some[again]], prior[classes[some[again]]], places)
            facts[some] = _packed(codes)
            weigh = weights(counts[some], codes, prior[classes[some]], places)
            for k in range(STATES):
                total[:, k] += np.bincount(classes[some], np.rint(FIXED * weigh[:, k]), CLASSES)
        sizes = np.array([len(x) for c in group.column("words").chunks for x in c])
        ends = np.cumsum(sizes)
        rows = [(b, s, counts[which[a:z]], facts[which[a:z]], None) for b, s, a, z in zip(group.column("block").to_pylist(), group.column("start").to_pylist(), (ends - sizes).tolist(), ends.tolist())]
        rows.append((None, None, None, None, np.r_[counts.sum(), (counts > 0).sum(), total.ravel()]))
        return pa.Table.from_batches(in_batches(rows, schema), schema)

    return written(sent.groupBy("owner").applyInArrow(own, _REPLY), "replies")


@dataclass
class Corpus:
    """Training tokens, distinct training words, and the logs of what classes weigh in each state."""

    total: int
    distinct: int
    log_classes: np.ndarray


def corpus_of(told: DataFrame) -> Corpus:
    sums = told.filter("sums is not null").select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")))
    found = np.zeros(2 + CLASSES * STATES)
    for r in sums.collect():
        found[r[0]] = float(r[1])
    return Corpus(int(found[0]), int(found[1]), np.log(found[2:].reshape(CLASSES, STATES) / FIXED + 0.5))


def log_inside(counts: np.ndarray, facts: np.ndarray, classes: np.ndarray, prior: np.ndarray, places: np.ndarray, corpus: Corpus) -> np.ndarray:
    """Words x STATES: natural log probabilities of words within their classes; a word never seen has the place for those."""
    along = np.clip(_unpacked(facts) * STEP @ places.T, -30, 30)
    along += np.log((counts + 0.5) / (_exp(along) * prior[classes]).sum(1))[:, None]
    along[counts == 0] = np.log(0.5)
    return along - corpus.log_classes[classes]


# scores


def score(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = encode(docs)
    units = Units(frequent_words(blocks, share))
    p, stood = refine(blocks, units, warm_parameters(docs, units))
    prior = priors(stood)
    entries = blocks.agg(F.sum(F.size("words"))).first()[0] or 0
    told = replies(messages(blocks, units, p, max(1, -(-entries // OWNED))), units, p, prior)
    corpus = corpus_of(told)
    shared = docs.sparkSession.sparkContext.broadcast((units, p, prior, corpus))
    columns = ("doc_ids", "held", "lengths", "tokens", "classes", "parts")
    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def block_scores(row, factors):
        units, p, prior, corpus = shared.value
        classes = _numpy(row["classes"], np.int64)
        counts, facts = np.zeros(len(classes), np.int64), np.zeros(len(classes), np.int64)
        for part in row["parts"].values:
            a = part["start"].as_py()
            got = _numpy(part["counts"])
            counts[a : a + len(got)], facts[a : a + len(got)] = got, _numpy(part["facts"])
        often = facts >> 56 == 1  # the place of the highest byte; packed vectors have 0 there
        of = np.where(often, facts - _NUMBERED, units.frequent + classes)
        o = _opened(of, p, row)
        inside = log_inside(counts, np.where(often, 0, facts), classes, prior, p.coordinates, corpus)
        inside[often] = 0
        base = np.log10((counts + 0.5) / (corpus.total + 0.5 * (corpus.distinct + 1)))
        natural = p.log_units(o.q, o.units, o.before, factors) + inside[o.tokens, p.states(o.q)]
        first = np.cumsum(o.lengths) - o.lengths
        own = np.round(np.add.reduceat(natural, first) / np.log(10), 6)
        return [row["doc_ids"].values, row["held"].values, pa.array(o.lengths), pa.array(np.add.reduceat((counts > 0)[o.tokens].astype(np.int64), first)), pa.array(np.full(len(first), corpus.total, np.int64)), pa.array(np.add.reduceat(base[o.tokens], first)), pa.array(own)]

    def run(batches):
        factors = shared.value[1].factors()
        for b in batches:
            for r in range(b.num_rows):
                yield pa.RecordBatch.from_arrays(block_scores({c: b.column(i)[r] for i, c in enumerate(columns)}, factors), names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        pa.default_memory_pool().release_unused()

    parts = told.filter("block is not null").groupBy(F.col("block").alias("of")).agg(F.collect_list(F.struct("start", "counts", "facts")).alias("parts"))
    both = blocks.select("block", *columns[:-1]).join(parts, F.col("block") == F.col("of"))
    return both.select(*columns).mapInArrow(run, out)
