"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded: shares of character classes, word statistics and
hashed words go through a learned layer to a small vector. Gated attention, learned from document labels alone, weighs
the passages, and the weighted sum is scored. So one label a document suffices, and the score rests on whole texts.

Training runs on the driver over a bounded sample of encoded passages (``SAMPLE_DOCUMENTS`` of each label,
``SAMPLE_PASSAGES`` of a document); scoring runs over all passages of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.llm import kernels as K
from corpuslab.llm.staging import with_body

PASSAGE = 64
#: Bound of the labelled sample; up to 1000 a label Spark limits the groups before it shuffles them.
SAMPLE_DOCUMENTS, SAMPLE_PASSAGES = 1000, 24
HASHED, HIDDEN, GATE = 32, 16, 8
_CLASSES = ["lower", "upper", "digit", "newline", "space", "high", "stop", "comma", "bang", "bar", "hyphen", "quote", "mark", "bracket", "slash", "other"]
_CLASS = np.full(256, 15, np.uint8)
for _number, _members in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"\n", b" \t\r", bytes(range(128, 256)), b".", b",;:", b"!?", b"|", b"-_", b"'\"", b"*%&$#@", b"()[]{}<>", b"/\\"]):
    _CLASS[list(_members)] = _number
FEATURES = len(_CLASSES) + 6 + HASHED


def encode(words: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Features (float32) of every passage and the passages' bounds by row; a row without words is one empty passage."""
    passages = np.maximum(1, -(-words.count // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(passages)])
    total, n_words = int(bounds[-1]), len(words.hash)
    out = np.zeros((total, FEATURES), np.float32)
    row_of = np.repeat(np.arange(words.rows), words.count)
    of = bounds[row_of] + (np.arange(n_words) - words.bounds[row_of]) // PASSAGE
    if len(words.data):
        # A byte belongs to the passage of the last word that began before it (in its row).
        mark = np.zeros(len(words.data) + 1, np.int64)
        begin = bounds[:-1][np.diff(words.offsets) > 0]
        starts = words.offsets[:-1][np.diff(words.offsets) > 0]
        mark[starts] = begin
        mark[words.start] = of
        byte_of = np.maximum.accumulate(mark)[:-1]
        counts = np.bincount(byte_of * 16 + _CLASS[words.data], minlength=total * 16)[: total * 16].reshape(total, 16)
        size = np.maximum(1, counts.sum(1, keepdims=True))
        out[:, :16] = counts / size
    if n_words:
        count = np.bincount(of, minlength=total)
        n = np.maximum(1, count)
        length = words.end - words.start
        mean = np.bincount(of, length, minlength=total) / n
        out[:, 16] = np.log1p(count) / 5
        out[:, 17] = mean / 10
        out[:, 18] = np.sqrt(np.maximum(0, np.bincount(of, length.astype(float) ** 2, minlength=total) / n - mean**2)) / 10
        tagged = np.sort(K.mix(words.hash ^ K.mix(of.astype(np.uint64))) >> np.uint64(20) | of.astype(np.uint64) << np.uint64(44))
        new = np.concatenate([[True], tagged[1:] != tagged[:-1]])
        out[:, 19] = np.bincount((tagged[new] >> np.uint64(44)).astype(np.int64), minlength=total) / n
        same = np.zeros(n_words, bool)
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (of[1:] == of[:-1])
        out[:, 20] = np.bincount(of, same, minlength=total) / n
        last = _CLASS[words.data[words.end - 1]]
        out[:, 21] = np.bincount(of, last == 12, minlength=total) / n
        bucket = (words.hash & np.uint64(HASHED - 1)).astype(np.int64)
        sign = np.where(words.hash >> np.uint64(63), 1.0, -1.0)
        out[:, 22:] = (np.bincount(of * HASHED + bucket, sign, minlength=total * HASHED)).reshape(total, HASHED) / np.sqrt(n)[:, None] / 4
    return out, bounds


class Model:
    """Passage encoder, gated attention and output layer, with their own gradients and Adam."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        scale = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.mean, self.spread = np.zeros(FEATURES), np.ones(FEATURES)
        self.p = {"E": scale(FEATURES, HIDDEN), "e": np.zeros(HIDDEN), "V": scale(HIDDEN, GATE), "U": scale(HIDDEN, GATE), "w": scale(GATE, 1)[:, 0], "c": scale(HIDDEN, 1)[:, 0], "b": np.zeros(1)}

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        s = {"x": (x - self.mean) / self.spread}
        s["h"] = np.tanh(s["x"] @ p["E"] + p["e"])
        s["t"] = np.tanh(s["h"] @ p["V"])
        s["g"] = 1 / (1 + np.exp(-(s["h"] @ p["U"])))
        logit = (s["t"] * s["g"]) @ p["w"]
        s["of"] = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        logit = np.exp(logit - np.maximum.reduceat(logit, bounds[:-1])[s["of"]])
        s["a"] = logit / np.add.reduceat(logit, bounds[:-1])[s["of"]]
        s["z"] = np.add.reduceat(s["a"][:, None] * s["h"], bounds[:-1])
        s["y"] = 1 / (1 + np.exp(-np.clip(s["z"] @ p["c"] + p["b"][0], -30, 30)))
        return s

    def fit(self, x: np.ndarray, bounds: np.ndarray, label: np.ndarray, steps: int = 250, rate: float = 0.02, decay: float = 1e-4) -> None:
        """Full-batch logistic loss, both labels weighing the same in sum."""
        if len(label) == 0 or label.min() == label.max():
            self.p["b"][:] = 4.0 if len(label) and label.max() == 1 else -4.0 if len(label) else 0.0
            self.p["c"][:] = 0
            return
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-3
        weight = np.where(label == 1, 0.5 / (label == 1).sum(), 0.5 / (label == 0).sum())
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            s, p = self.forward(x, bounds), self.p
            dy = weight * (s["y"] - label)
            dz = dy[:, None] * p["c"]
            back = (dz[s["of"]] * s["h"]).sum(1)
            da = s["a"] * (back - np.add.reduceat(s["a"] * back, bounds[:-1])[s["of"]])
            dt = da[:, None] * p["w"] * s["g"] * (1 - s["t"] ** 2)
            dg = da[:, None] * p["w"] * s["t"] * s["g"] * (1 - s["g"])
            dh = s["a"][:, None] * dz[s["of"]] + dt @ p["V"].T + dg @ p["U"].T
            dx = dh * (1 - s["h"] ** 2)
            grad = {"E": s["x"].T @ dx, "e": dx.sum(0), "V": s["h"].T @ dt, "U": s["h"].T @ dg, "w": (s["t"] * s["g"]).T @ da, "c": s["z"].T @ dy, "b": np.array([dy.sum()])}
            for k, g in grad.items():
                g = g + decay * p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.column_bytes(batch.column(2))
        rows = []
        for first, last in K.slices(offsets):
            own = offsets[first : last + 1]
            x, bounds = encode(K.Words(data[own[0] : own[-1]], own - own[0], K.SPACE_WORDS))
            for i in range(last - first):
                mine = x[bounds[i] : bounds[i + 1]]
                if len(mine) > SAMPLE_PASSAGES:  # evenly spread
                    mine = mine[np.linspace(0, len(mine) - 1, SAMPLE_PASSAGES).astype(int)]
                rows.append(np.ascontiguousarray(mine).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["id", "label", "x"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model from a bounded sample: the first documents of each label by a hash of the id. Labels other than 0 and 1, null ids and null texts are left out; without labels every score is 0.5."""
    chance = Window.partitionBy("label").orderBy(F.xxhash64(F.lit(5), "id"), "id")
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    chosen = known.withColumn("rank", F.row_number().over(chance)).where(F.col("rank") <= SAMPLE_DOCUMENTS).select("id", "label")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").select("id", "label", "text")
    got = sorted(rows.mapInArrow(_encoded, rows.select("id", "label", F.lit(b"").alias("x")).schema).collect(), key=lambda r: (r["id"], r["label"], bytes(r["x"])))
    model = Model()
    if got:
        parts = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in got]
        model.fit(np.concatenate(parts).astype(np.float64), np.concatenate([[0], np.cumsum([len(x) for x in parts])]), np.array([r["label"] for r in got]))
    return model


def _score(shared, n_carry: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(n_carry))
            scores = []
            for first, last in K.slices(offsets):
                own = offsets[first : last + 1]
                scores.append(model.forward(*encode(K.Words(data[own[0] : own[-1]], own - own[0], K.SPACE_WORDS)))["y"])
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n_carry)] + [pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], names)

    return run


def classify(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None, column: str = "score") -> DataFrame:
    """The ``carry`` columns (default: all but the text) with ``score`` from 0 to 1 in ``column``; empty and null texts are one empty passage.

    A score of exactly one half counts for label 1; repeated rows get the same score; an empty table gives an empty
    result; an own column named like ``column`` is replaced.
    """
    carry = [c for c in docs.columns if c not in (text, column)] if carry is None else carry
    rows = with_body(docs, carry, text)
    schema = docs.select(*[f"`{c}`" for c in carry], F.lit(0.0).alias(column)).schema
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), len(carry), schema.names), schema)


def query_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; labels only of those whose checksum of the id leaves no remainder 1 by 3."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = learn(docs.select("doc_id", "text"), labels.where(~held_out))
    out = classify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
