"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its words' hashed subwords (character n-grams of the word
between boundary marks, and the word itself). The embeddings and the softmax are trained together by
stochastic gradient descent in numpy on a bounded sample. Scores are calibrated by a temperature and
a rejection threshold, both fitted on a part of the sample that training does not see. As the model
is linear in the average, a word's contribution to the logits is computed once and kept.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.llm.common import even, worker_cache
from scholion.llm.sampling import stratified
from scholion.session import small_side

UNKNOWN = "und"
BUCKETS = 1 << 15
WIDTH = 12
GRAMS = (1, 2, 3, 4)
#: The bounds of the training sample: rows of each language, languages, and subwords of a row.
SAMPLE_PER_LANGUAGE = 600
MAX_LANGUAGES = 200
FEATURES_PER_ROW = 3000  # a training row's subwords; predictions use all
CACHED_WORDS = 800_000
STEP_LETTERS = 100_000
WHOLE = 40
LETTERS = re.compile(r"[^\W\d_]+")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def subwords(pieces: list[tuple[str, bool, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of the subwords of pieces of words, one row for each letter and kind of subword.

    A piece is (letters, is the word's first, is its last). Returns buckets (kinds x letters), which of
    them are real, and where each piece starts. The kinds are the n-grams from a letter on and, at its
    first letter, the word as a whole, if it is one piece of at most WHOLE letters. The last letters of a
    piece that is not the last only lead into the next one: no n-gram starts there.
    """
    marked = [f"{'<' * first}{w}{'>' * last}" for w, first, last in pieces]
    letters = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(m) for m in marked])
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(starts, sizes)
    left = np.repeat(sizes, sizes) - place
    own = left > np.repeat([0 if last else max(GRAMS) - 1 for _, _, last in pieces], sizes)
    hashes, real = [], []
    gram = np.zeros(len(letters), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        ahead = np.concatenate([letters[n - 1 :], np.zeros(n - 1, dtype=np.uint64)])
        gram = _mix(gram * np.uint64(0x9E3779B97F4A7C15) + ahead)
        if n in GRAMS:
            hashes.append(gram % np.uint64(BUCKETS))
            real.append((left >= n) & own)
    whole = np.add.reduceat(_mix(letters * np.uint64(64) + place.astype(np.uint64)), starts)
    hashes.append(np.repeat(_mix(whole) % np.uint64(BUCKETS), sizes))
    short = [first and last and len(w) <= WHOLE for w, first, last in pieces]
    real.append((place == 0) & np.repeat(short, sizes))
    return np.stack(hashes).astype(np.int32), np.stack(real), starts


def steps(words: list[str], limit: int = STEP_LETTERS) -> Iterator[tuple[np.ndarray, list]]:
    """All letters of the words in pieces of bounded size, a bounded number of letters at a time.

    Gives the numbers of the words that the pieces belong to, and the pieces. A run of letters longer than
    `limit` (a text without blanks) comes in several pieces, so that its n-grams are those of the whole.
    """
    held, total = [], 0
    for k, word in enumerate(words):
        at = 0
        while at == 0 or at < len(word):
            # What would be too short to lead on is part of the piece before it.
            last = at + limit + max(GRAMS) - 1 >= len(word)
            piece = word[at:] if last else word[at : at + limit + max(GRAMS) - 1]
            held.append((k, (piece, at == 0, last)))
            total += len(piece)
            at += limit
            if total >= limit:
                yield np.array([k for k, _ in held]), [p for _, p in held]
                held, total = [], 0
            if last:
                break
    if held:
        yield np.array([k for k, _ in held]), [p for _, p in held]


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        return _softmax((means @ self.output + self.bias) / self.temperature)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Subword buckets of a whole text and their shares, the most frequent ones at most."""
    words: dict[str, int] = {}
    for w in words_of(text):
        words[w] = words.get(w, 0) + 1
    if not words:
        return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.float32)
    count = np.zeros(len(words))
    total = np.zeros(BUCKETS)
    times = np.array(list(words.values()), dtype=float)
    # A word's subwords share its weight, so their number is needed first.
    for own, pieces in steps(list(words)):
        _, real, starts = subwords(pieces)
        np.add.at(count, own, np.add.reduceat(real.sum(axis=0), starts))
    share = times / count
    for own, pieces in steps(list(words)):
        buckets, real, starts = subwords(pieces)
        letters = np.diff(np.append(starts, real.shape[1]))
        weight = np.broadcast_to(np.repeat(share[own], letters), real.shape)
        total += np.bincount(buckets[real], weights=weight[real], minlength=BUCKETS)
    top = np.argsort(-total, kind="stable")[:FEATURES_PER_ROW]
    top = top[total[top] > 0]
    return top.astype(np.int32), (total[top] / total[top].sum()).astype(np.float32)


def training_rows(rows: DataFrame, ids: str, text: str, lang: str, per_language: int) -> pd.DataFrame:
    """Feature rows of the sample: at most per_language rows of each language reach the driver.

    Of more than MAX_LANGUAGES languages those with most rows are learnt, ties by name.
    """
    labelled = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    most = labelled.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(MAX_LANGUAGES + 1).collect()
    if len(most) > MAX_LANGUAGES:
        labelled = labelled.where(F.col(lang).isin([r[0] for r in most[:MAX_LANGUAGES]]))
    chosen = stratified(labelled, ids, lang, per_language)
    texts = labelled.select(ids, lang, text).join(
        small_side(chosen, MAX_LANGUAGES * per_language), [ids, lang], "left_semi"
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [_counts(t) for t in frame[text]]
            out = pd.DataFrame(
                {"id": frame[ids], "lang": frame[lang], "at": [m[0] for m in made], "share": [m[1] for m in made]}
            )
            yield out[[len(m[0]) > 0 for m in made]]

    got = texts.mapInPandas(run, "id bigint, lang string, at array<int>, share array<float>").toPandas()
    return got.sort_values("id", ignore_index=True).drop_duplicates(["id", "lang"], ignore_index=True)


def train(rows: pd.DataFrame, epochs: int = 12, rate: float = 4.0, seed: int = 7) -> Model | None:
    """Fit by plain stochastic gradient descent; None if there is nothing to learn from."""
    if rows.empty:
        return None
    languages = sorted(rows["lang"].unique())
    rng = np.random.default_rng(seed)
    model = Model(
        languages,
        rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32),
        np.zeros((WIDTH, len(languages)), dtype=np.float32),
        np.zeros(len(languages), dtype=np.float32),
    )
    y = np.searchsorted(languages, rows["lang"])
    at = [np.asarray(x, dtype=np.int64) for x in rows["at"]]
    share = [np.asarray(x, dtype=np.float32) for x in rows["share"]]
    # Every sixth row of the sample is kept for calibration.
    calibrating = np.arange(len(rows)) % 6 == 5 if len(rows) >= 60 else np.zeros(len(rows), bool)
    learn = np.flatnonzero(~calibrating)
    weight = len(learn) / (len(languages) * np.maximum(np.bincount(y[learn], minlength=len(languages)), 1))
    weight = np.minimum(weight, 10)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(learn):
            rows_of, part = model.embedding[at[i]], share[i]
            mean = part @ rows_of
            p = _softmax((mean @ model.output + model.bias)[None, :])[0]
            p[y[i]] -= 1
            p *= step * weight[y[i]]
            back = model.output @ p
            model.output -= np.outer(mean, p) * 0.25
            model.bias -= p * 0.05
            model.embedding[at[i]] -= part[:, None] * back[None, :]
    held = np.flatnonzero(calibrating) if calibrating.any() else learn
    means = np.stack([share[i] @ model.embedding[at[i]] for i in held])
    _calibrate(model, means, y[held])
    return model


def _calibrate(model: Model, means: np.ndarray, y: np.ndarray) -> None:
    """The temperature of least log loss, then a threshold that few right answers fall below."""

    def loss(temperature: float) -> float:
        model.temperature = temperature
        p = model.probabilities(means)[np.arange(len(y)), y]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    model.temperature = min((0.25, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 5.0), key=loss)
    p = model.probabilities(means)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    model.reject_below = float(min(np.quantile(right, 0.01), 0.9)) if len(right) else 0.0


class WordLogits:
    """Each known word's logits, bias left out, as rows of a table."""

    def __init__(self, model: Model):
        self.buckets = (model.embedding @ model.output).astype(np.float32)
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.zeros((1024, self.buckets.shape[1]), dtype=np.float32)

    def learn(self, words: set[str]) -> None:
        """Add the words that are new, a bounded number of letters at a time."""
        new = [w for w in words if w not in self.row]
        if len(self.row) + len(new) > CACHED_WORDS:
            self.clear()
            new = list(words)
        first = len(self.row)
        while len(self.table) < first + len(new):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        self.row.update(zip(new, range(first, first + len(new)), strict=True))
        if not new:
            return
        count = np.zeros(len(new))
        table = self.table[first : first + len(new)]
        table[:] = 0
        for own, pieces in steps(new, max(10_000, 4 * STEP_LETTERS // self.buckets.shape[1])):
            buckets, real, starts = subwords(pieces)
            total = np.zeros((real.shape[1], self.buckets.shape[1]), dtype=np.float32)
            for kind, here in zip(buckets, real, strict=True):
                total += self.buckets[kind] * here[:, None]
            np.add.at(table, own, np.add.reduceat(total, starts, axis=0))
            np.add.at(count, own, np.add.reduceat(real.sum(axis=0), starts))
        table /= count[:, None]

    def mean(self, words: list[str]) -> np.ndarray:
        rows = np.fromiter(map(self.row.__getitem__, words), dtype=np.int64, count=len(words))
        total = np.zeros(self.table.shape[1])
        for at in range(0, len(rows), 65536):
            total += self.table[rows[at : at + 65536]].sum(axis=0, dtype=np.float64)
        return total / len(rows)


def predict(
    rows: DataFrame, model: Model | None, ids: str = "doc_id", text: str = "text", reject: bool = True
) -> DataFrame:
    """ids, lang_pred, score, rejected of each row's whole text.

    A null text, or one without a letter, is `und` with score 0 and rejected; so is every text if there
    is no model. rejected says that the calibrated score is below the model's threshold; with reject, such
    a text is `und`, too (it keeps its score). Ties go to the first language in order. Repeated rows keep their rows.
    """
    version = uuid.uuid4().hex
    shared = rows.sparkSession.sparkContext.broadcast(model and vars(model))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = shared.value and Model(**shared.value)
        known = fitted and worker_cache("language_logits", version, lambda: WordLogits(fitted))
        for frame in frames:
            out_lang, out_score, out_rejected = [], [], []
            for at in range(0, len(frame), 200):
                said = [words_of(t) if t and fitted else [] for t in frame[text].iloc[at : at + 200]]
                if any(said):
                    known.learn(set().union(*said))
                for words in said:
                    if not words:
                        out_lang.append(UNKNOWN)
                        out_score.append(0.0)
                        out_rejected.append(True)
                        continue
                    p = _softmax((known.mean(words) + fitted.bias)[None, :] / fitted.temperature)[0]
                    best = int(p.argmax())
                    rejected = bool(p[best] < fitted.reject_below)
                    out_lang.append(UNKNOWN if reject and rejected else fitted.languages[best])
                    out_score.append(float(p[best]))
                    out_rejected.append(rejected)
            yield pd.DataFrame(
                {ids: frame[ids], "lang_pred": out_lang, "score": out_score, "rejected": out_rejected}
            )

    # Ids travel as texts, as a null among whole numbers would make them all doubles.
    slim = rows.select(F.col(ids).cast("string"), text)
    found = even(slim).mapInPandas(run, f"`{ids}` string, lang_pred string, score double, rejected boolean")
    return found.withColumn(ids, F.col(ids).cast("bigint"))


def identify(
    docs: DataFrame, learn_from: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, reject: bool = False
) -> DataFrame:
    """Train on learn_from (doc_id, text, lang) and predict every row of docs."""
    rows = training_rows(learn_from, "doc_id", "text", "lang", per_language)
    return predict(docs, train(rows), reject=reject)
