"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded (shares of character classes, lengths,
repetition, and a hidden layer on top); a gated attention, w . (tanh(V h) * sigmoid(U h)), weighs the
passages; the weighted sum is scored by a logistic unit. Encoder, attention and scorer are learned
together from labels of whole documents, in numpy, on a bounded sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholion.llm.common import even, forget, give_back
from scholion.llm.sampling import stratified

PASSAGE_BYTES = 400
#: The bound of the training sample: rows of each label value and passages of a sampled row.
SAMPLE_PER_LABEL = 1000
SAMPLE_PASSAGES = 40
HIDDEN = 16
ATTENTION = 8
THRESHOLD = 0.3

LOWER, UPPER, DIGIT, SPACE, LINE, STOP, QUOTE, SYMBOL, HIGH, CONTROL = range(10)
CLASSES = np.full(256, SYMBOL, dtype=np.uint8)
CLASSES[:32] = CONTROL
CLASSES[127] = CONTROL
CLASSES[97:123] = LOWER
CLASSES[65:91] = UPPER
CLASSES[48:58] = DIGIT
CLASSES[[32, 9]] = SPACE
CLASSES[[10, 13]] = LINE
CLASSES[[ord(c) for c in ".,;:?"]] = STOP
CLASSES[[ord(c) for c in "'\"()-"]] = QUOTE
CLASSES[128:] = HIGH
WIDTH = 10 + 9
WORD = re.compile(rb"\S+")


def passages(raw: bytes) -> list[bytes]:
    """Cuts of about PASSAGE_BYTES, at white space where there is some; never empty as a list."""
    cuts, at = [], 0
    while at < len(raw):
        end = at + PASSAGE_BYTES
        if end < len(raw):
            space = max(raw.rfind(b" ", at + PASSAGE_BYTES // 2, end), raw.rfind(b"\n", at + PASSAGE_BYTES // 2, end))
            end = space + 1 if space > 0 else end
        cuts.append(raw[at:end])
        at = end
    return cuts or [b""]


def encode(cuts: list[bytes]) -> np.ndarray:
    """Feature rows of passages, each about between -1 and 3."""
    sizes = np.array([len(c) for c in cuts])
    kinds = CLASSES[np.frombuffer(b"".join(cuts), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(cuts)), sizes)
    counts = np.bincount(owner * 10 + kinds, minlength=10 * len(cuts)).reshape(-1, 10).astype(np.float64)
    n = np.maximum(sizes, 1)[:, None]
    words = [c.split() for c in cuts]
    n_words = np.array([max(len(w), 1) for w in words])
    distinct = np.array([len(set(w)) for w in words]) / n_words
    repeats = np.array([sum(map(bytes.__eq__, w, w[1:])) for w in words]) / n_words
    letters = counts[:, LOWER] + counts[:, UPPER] + counts[:, HIGH]
    extra = np.column_stack(
        [
            distinct,
            repeats * 2,
            np.log1p(n[:, 0] / n_words) / 2,
            np.log1p(n_words) / 4,
            counts[:, UPPER] / np.maximum(letters, 1),
            np.minimum(counts[:, SYMBOL] / n_words, 3),
            np.minimum(counts[:, STOP] / n_words, 2),
            np.minimum(counts[:, LINE] / n_words * 4, 3),
            sizes == 0,
        ]
    )
    return np.hstack([np.sqrt(counts / n), extra]).astype(np.float32)


@dataclass
class Model:
    shift: np.ndarray
    scale: np.ndarray
    W: np.ndarray
    b: np.ndarray
    V: np.ndarray
    U: np.ndarray
    w: np.ndarray
    c: np.ndarray
    bias: np.ndarray

    def names(self) -> list[str]:
        return ["W", "b", "V", "U", "w", "c", "bias"]


def _segments(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return starts, np.repeat(np.arange(len(sizes)), sizes)


def forward(model: Model, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, dict]:
    """Scores of bags whose passages follow each other in x, sizes[i] of them for bag i."""
    starts, bag = _segments(sizes)
    z = (x - model.shift) / model.scale
    h = np.tanh(z @ model.W + model.b)
    t, g = np.tanh(h @ model.V), 1 / (1 + np.exp(-(h @ model.U)))
    e = (t * g) @ model.w
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    pooled = np.add.reduceat(h * a[:, None], starts, axis=0)
    score = 1 / (1 + np.exp(-np.clip(pooled @ model.c + model.bias, -30, 30)))
    return score, {"z": z, "h": h, "t": t, "g": g, "a": a, "pooled": pooled, "bag": bag, "starts": starts}


def _gradients(model: Model, kept: dict, score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    d_out = (score - y) * weight / weight.sum()
    bag, a, h, t, g = (kept[k] for k in ("bag", "a", "h", "t", "g"))
    d_pooled = d_out[:, None] * model.c[None, :]
    d_h = d_pooled[bag] * a[:, None]
    d_a = (d_pooled[bag] * h).sum(axis=1)
    mean = np.add.reduceat(d_a * a, kept["starts"])
    d_e = a * (d_a - mean[bag])
    d_t, d_g = d_e[:, None] * model.w * g, d_e[:, None] * model.w * t
    d_v, d_u = d_t * (1 - t**2), d_g * g * (1 - g)
    d_h = d_h + d_v @ model.V.T + d_u @ model.U.T
    d_z = d_h * (1 - h**2)
    return {
        "c": kept["pooled"].T @ d_out,
        "bias": np.array([d_out.sum()]),
        "w": (t * g).T @ d_e,
        "V": h.T @ d_v,
        "U": h.T @ d_u,
        "W": kept["z"].T @ d_z,
        "b": d_z.sum(axis=0),
    }


def train(bags: list[np.ndarray], labels: np.ndarray, steps: int = 400, rate: float = 0.02, seed: int = 3) -> Model:
    """Fit all parts together by Adam over the whole sample; both labels weigh the same in sum."""
    x, sizes = np.vstack(bags).astype(np.float64), np.array([len(b) for b in bags])
    y = labels.astype(np.float64)
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
    model = Model(
        x.mean(axis=0), x.std(axis=0) + 0.05, draw(WIDTH, HIDDEN), np.zeros(HIDDEN), draw(HIDDEN, ATTENTION),
        draw(HIDDEN, ATTENTION), draw(ATTENTION), draw(HIDDEN), np.zeros(1),
    )
    share = np.clip(y.mean(), 0.02, 0.98)
    # Labels are balanced half-way: the score stays near a probability, rare labels still count.
    weight = np.where(y == 1, 1 / np.sqrt(share), 1 / np.sqrt(1 - share))
    first = {k: 0.0 for k in model.names()}
    second = {k: 0.0 for k in model.names()}
    for step in range(1, steps + 1):
        score, kept = forward(model, x, sizes)
        for k, d in _gradients(model, kept, score, y, weight).items():
            d = d + 1e-4 * getattr(model, k)
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            setattr(model, k, getattr(model, k) - rate * (1 - step / (steps + 1)) * move)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model | None:
    """Learn from documents with a label: at most per_label rows of each label value are used.

    A document with several differing labels counts as the lower one; null labels and ids are
    ignored. None if either label is missing.
    """
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    # The sample's ids are bounded by two times per_label, so they are broadcast and no text moves.
    chosen = stratified(known, "doc_id", "quality", per_label)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(chosen), "doc_id"
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                cuts = passages(text.encode())
                # Evenly spread passages of a long sampled document; scoring always reads them all.
                keep = np.unique(np.linspace(0, len(cuts) - 1, min(len(cuts), SAMPLE_PASSAGES)).astype(int))
                made.append((doc_id, encode([cuts[i] for i in keep]).ravel()))
            yield pd.DataFrame(
                {"doc_id": [m[0] for m in made], "quality": frame["quality"].tolist(), "x": [m[1] for m in made]}
            )

    got = rows.mapInPandas(run, "doc_id bigint, quality int, x array<float>").toPandas()
    if got["quality"].nunique() < 2:
        return None
    got = got.sort_values("doc_id", kind="stable")
    return train([np.asarray(x).reshape(-1, WIDTH) for x in got["x"]], got["quality"].to_numpy())


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted (1 if score >= threshold) for each whole text.

    Null and empty texts are scored as one empty passage. Without a model every score is 0.5. Other
    columns pass through; columns already named score or predicted are replaced.
    """
    kept = docs.drop("score", "predicted")
    added = T.StructType.fromDDL("score double, predicted int")
    schema = T.StructType([*kept.schema.fields, *added.fields])
    shared = docs.sparkSession.sparkContext.broadcast(model and vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        fitted = shared.value and Model(**shared.value)
        for batch in batches:
            scores = np.full(len(batch), 0.5)
            if fitted is not None:
                # Columns pass through as they are; only a few texts at a time become Python strings.
                text = batch.column("text")
                for at in range(0, len(batch), 64):
                    cuts = [passages((t or "").encode()) for t in text.slice(at, 64).to_pylist()]
                    x = encode([c for bag in cuts for c in bag])
                    scores[at : at + 64] = forward(fitted, x, np.array([len(c) for c in cuts]))[0]
            predicted = (scores >= threshold).astype(np.int32)
            yield batch.append_column("score", pa.array(scores)).append_column("predicted", pa.array(predicted))
        give_back()

    return even(kept).mapInArrow(run, schema)
