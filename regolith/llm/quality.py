"""Quality classifier by compression: which of two zstandard dictionaries fits a text better.

One dictionary is trained on good and one on bad labelled texts. A whole text is compressed with both, in blocks of BLOCK
bytes, each afresh from the dictionary, so that it weighs the same at the end of a long text as at its start. The
difference of the two sizes over the text's bytes goes through a logistic curve, fitted on labelled texts that neither dictionary
has seen.

Training takes at most SAMPLE labelled rows of each class (those with the smallest hash of their id), whole. This bound
is the only sampling; every text is scored whole. Inputs of a score are the text's bytes alone.

Cases: null and empty texts have difference 0 and get the curve's value there; texts whose blocks shrink alike with both
dictionaries come near to that value; very long texts are compressed block by block; without labels of both classes every score is
0.5; rows of labels with a null class are left out, doubled ones count twice; repeated documents get equal scores; ids may
be of any type, and a null id is never held out; an empty table gives an empty result; further columns are never read,
whatever their names, and keep_good returns them as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, BLOCK = 3_000, 4_096
DICTIONARY, LEVEL = 32_768, 3
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Of the sampled texts, each CALIBRATE-th is kept from the dictionaries for the curve.
CALIBRATE = 4


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _blocks(data: bytes) -> list[bytes]:
    return [data[a : a + BLOCK] for a in range(0, len(data), BLOCK)]


def _trained(samples: list[bytes]) -> bytes:
    """A dictionary; for so few samples that none can be trained, their own end as raw content."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


class Model:
    """Two dictionaries and the curve: slope and intercept."""

    def __init__(self, good: bytes, bad: bytes, curve: tuple[float, ...] = (0.0, 0.0)):
        self.good, self.bad, self.curve = good, bad, tuple(curve)
        self.usable = bool(good and bad)
        self.tools = [self._tool(d) for d in (good, bad)] if self.usable else []

    @staticmethod
    def _tool(content: bytes):
        d = zstandard.ZstdCompressionDict(content)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

    def difference(self, data: bytes) -> float:
        """Bytes that the good dictionary saves against the bad one, for each byte."""
        if not data:
            return 0.0
        good, bad = self.tools
        return sum(len(bad.compress(x)) - len(good.compress(x)) for x in _blocks(data)) / len(data)

    def score(self, text: str | None) -> float:
        if not self.usable:
            return 0.5
        z = self.curve[0] * self.difference((text or "").encode("utf-8", "surrogatepass")) + self.curve[1]
        return 1 / (1 + math.exp(-min(max(z, -500), 500)))


def fit(rows: list[tuple[str, int]]) -> Model:
    """Model of (text, class) rows, in the order given."""
    texts = {q: [t.encode("utf-8", "surrogatepass") for t, c in rows if c == q and t] for q in (0, 1)}
    kept = {q: [t for i, t in enumerate(ts) if i % CALIBRATE or len(ts) < 2 * CALIBRATE] for q, ts in texts.items()}
    if not kept[0] or not kept[1]:
        return Model(b"", b"")
    model = Model(*(_trained([p for t in kept[q] for p in _blocks(t)]) for q in (1, 0)))
    unseen = [(model.difference(t), q) for q, ts in texts.items() for i, t in enumerate(ts) if i % CALIBRATE == 0 or len(ts) < 2 * CALIBRATE]
    x, y = np.array([m for m, _ in unseen]), np.array([q for _, q in unseen], float)
    mean, spread = x.mean(), x.std() or 1.0
    z, w = np.c_[(x - mean) / spread, np.ones(len(x))], np.zeros(2)
    for _ in range(100):  # Newton steps on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.clip(np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(2), z.T @ (y - p) - 0.05 * w), -2, 2)
        w += step
        if abs(step).max() < 1e-9:
            break
    return Model(model.good, model.bad, (float(w[0] / spread), float(w[1] - w[0] * mean / spread)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the labelled rows outside the held-out fold; made in one task from at most 2 * sample texts."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null")
    known = known.filter(fold(F.col("doc_id")) != HELD_OUT)
    order = (F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id"))
    chosen = [known.filter(F.col("quality") == q).orderBy(*order).limit(sample) for q in (0, 1)]
    texts = docs.select(docs["doc_id"], docs["text"]).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")  # 2 * sample narrow rows

    def run(batches):
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        rows.sort(key=lambda r: (r[0], r[1] or ""))  # the order of arrival is not fixed
        m = fit([(t, q) for _, t, q in rows])
        yield pa.RecordBatch.from_pydict({"good": pa.array([m.good], pa.binary()), "bad": pa.array([m.bad], pa.binary()), "curve": pa.array([m.curve], pa.list_(pa.float64()))})

    found = texts.select(F.xxhash64(F.col("doc_id").cast("string")).alias("key"), "text", "quality").repartition(1).mapInArrow(run, "good binary, bad binary, curve array<double>").collect()
    return Model(bytes(found[0][0]), bytes(found[0][1]), tuple(found[0][2])) if found else Model(b"", b"")


def _scorer(df: DataFrame, model: Model):
    parts = df.sparkSession.sparkContext.broadcast((model.good, model.bad, model.curve))
    made: dict[str, Model] = {}

    def score(text):
        if not made:  # one for each worker
            made["x"] = Model(*parts.value)
        return made["x"].score(text)

    return score


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    score = _scorer(docs, model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((score(t.as_py()) for t in b.column(1)), pa.float64())], names=["doc_id", "score"])

    found = docs.select(docs["doc_id"], docs["text"]).mapInArrow(run, f"doc_id {kind}, score double")
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores at least the threshold."""
    at = docs.columns.index("text")
    score = _scorer(docs, model)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array((score(t.as_py()) >= threshold for t in b.column(at)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
