"""A quality classifier for graded ratings: cumulative-link (proportional odds) regression on hashed text.

One weight vector over hashed features is shared by all grades; ordered thresholds turn a text's score s into
P(grade >= k) = sigmoid(s - threshold_k). The sum of these tails is the expected grade, and the tail at the wanted grade
selects. Features are the distinct words of a text without the punctuation around them, the share of its distinct words
that carry each run of punctuation, and coarse bins of length, repetition and capitals, all hashed into one table.

Ratings come from the labels: a document of good quality that is not toxic has grade 2, one fault less, both 0. The
model is fitted on at most ``SAMPLE`` rated documents, those of the smallest hash of doc_id; every document is scored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.bpe import Recent, no_collection
from framesift.llm.held import held

#: Hash buckets; rated documents used at most; steps, their size, and the penalty.
BUCKETS, SAMPLE, STEPS, RATE, PENALTY = 1 << 18, 8_000, 800, 0.05, 2e-5
#: A feature gets a weight if at least so many documents of the sample have it, and the mean grade of these differs from
#: the overall mean by so many standard errors. Rare words that came with a bad grade by chance are left out.
LEAST_DOCS, LEAST_Z = 6, 4.5
GRADES, WANTED = 3, 2
PUNCTUATION = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())


def bucket(feature: bytes) -> int:
    return xxhash.xxh64_intdigest(feature, 7) % BUCKETS


def core(word: bytes) -> int:
    """The bucket of a word without the punctuation around it."""
    return bucket(b"w:" + word.strip(PUNCTUATION))


def mark(word: bytes) -> int:
    """The bucket of the punctuation around a word, -1 for none."""
    inner = word.strip(PUNCTUATION)
    if len(inner) == len(word):
        return -1
    left = word[: word.index(inner)] if inner else word
    return bucket(b"p:" + left + b" " + word[len(left) + len(inner) :])


def bins(words: list[bytes], distinct: int) -> list[int]:
    """Buckets of coarse traits of a whole text."""
    n = len(words)
    upper = sum(map(bytes.isupper, words))
    step = lambda x: min(10, int(10 * x))
    traits = (f"n{min(12, n.bit_length())}", f"d{n > 30}{step(distinct / n) if n else 0}", f"u{n > 5}{step(upper / n) if n else 0}", "all")
    return [bucket(b"t:" + t.encode()) for t in traits]


class Features:
    """Texts to hashed features: ``of`` for fitting, ``score`` for a fitted model; both sum the same terms."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = weights
        table = None if weights is None else weights.tolist()
        self.core = Recent(core if table is None else lambda w: table[core(w)])
        self.mark = Recent(mark)

    @staticmethod
    def words(text: str | None) -> tuple[list[bytes], set[bytes]]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.split()
        return words, set(raw.lower().split())

    def of(self, text: str | None) -> dict[int, float]:
        words, distinct = self.words(text)
        found = Counter(map(self.core.__getitem__, distinct))
        values = {b: float(n) for b, n in found.items()}
        for b, n in Counter(map(self.mark.__getitem__, distinct)).items():
            if b >= 0:
                values[b] = values.get(b, 0.0) + math.sqrt(n / len(distinct))
        for b in bins(words, len(distinct)):
            values[b] = values.get(b, 0.0) + 1.0
        return values

    def score(self, text: str | None) -> float:
        words, distinct = self.words(text)
        total = math.fsum(map(self.core.__getitem__, distinct))
        for b, n in Counter(map(self.mark.__getitem__, distinct)).items():
            if b >= 0:
                total += self.weights[b] * math.sqrt(n / len(distinct))
        return total + sum(self.weights[b] for b in bins(words, len(distinct)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES - 1."""
        return sigmoid(scores[:, None] - self.thresholds[None, :])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray) -> Model:
    """Maximum penalised likelihood by Adam over all rows at each step. rows: buckets and values of each document.

    Without ratings nothing is known against any document, and the thresholds let all pass.
    """
    weights, thresholds = np.zeros(BUCKETS), np.linspace(-1.0, 0.0, GRADES - 1)
    if not len(grades):
        return Model(weights, thresholds - 20)
    owner = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    at, value = np.concatenate([b for b, _ in rows]), np.concatenate([v for _, v in rows])
    have = np.bincount(at, minlength=BUCKETS)
    mean = np.bincount(at, grades[owner].astype(float), BUCKETS) / np.maximum(have, 1)
    z = (mean - grades.mean()) * np.sqrt(have) / max(grades.std(), 1e-9)
    keep = ((have >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z))[at]
    owner, value = owner[keep], value[keep]
    used, at = np.unique(at[keep], return_inverse=True)
    w, n = np.zeros(len(used)), len(grades)
    # thresholds are the first one and the logarithms of the gaps between them, which keeps them in order
    share = np.array([np.clip((grades >= k).mean(), 0.5 / n, 1 - 0.5 / n) for k in range(1, GRADES)])
    first = np.log((1 - share) / share)
    gaps = np.log(np.maximum(np.diff(first), 0.1))
    params = np.concatenate([w, first[:1], gaps])
    m1, m2 = np.zeros_like(params), np.zeros_like(params)
    edges = lambda p: np.concatenate([[-np.inf], p[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(p[len(used) + 1 :]))]), [np.inf]])
    for step in range(1, STEPS + 1):
        cut = edges(params)
        s = np.bincount(owner, params[at] * value, n)
        upper, lower = sigmoid(s - cut[grades]), sigmoid(s - cut[grades + 1])  # P(>= own), P(>= next)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        ds = du - dl
        grad = np.empty_like(params)
        grad[: len(used)] = np.bincount(at, ds[owner] * value, len(used)) / n - 2 * PENALTY * params[: len(used)]
        dcut = np.zeros(GRADES + 1)
        np.add.at(dcut, grades, -du)
        np.add.at(dcut, grades + 1, dl)
        inner = dcut[1:GRADES]
        grad[len(used)] = inner.sum() / n
        grad[len(used) + 1 :] = [inner[i + 1 :].sum() * np.exp(params[len(used) + 1 + i]) / n for i in range(GRADES - 2)]
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        params = params + RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    weights[used] = params[: len(used)]
    return Model(weights, edges(params)[1:-1])


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id and grade. Rows with a null, or values other than 0 and 1, are no ratings; of several for a document the lowest counts."""
    valid = labels.where("doc_id IS NOT NULL AND quality IN (0, 1) AND toxic IN (0, 1)")
    return valid.groupBy("doc_id").agg(F.min(F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rated documents. What comes to the driver is their features, so bounded by the sample.

    Of several rows with one rated id the text with the smallest hash is taken, chosen before the shuffle as well, so
    an id that fills much of the table costs one row a task.
    """
    chosen = ratings(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rated = named.groupBy("doc_id", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("mark"), "text")).alias("first")).select("grade", "first.text")

    def run(batches):
        features = held("features", Features)
        for batch in batches:
            found = [features.of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.float32()))], ["grade", "at", "value"])

    got = rated.mapInArrow(run, "grade int, at array<int>, value array<float>").toArrow()
    rows = [(np.asarray(a, np.int64), np.asarray(v, float)) for a, v in zip(got["at"].to_numpy(), got["value"].to_numpy())]
    order = np.array(sorted(range(len(rows)), key=lambda i: (len(rows[i][0]), rows[i][0].tobytes())), int) if rows else np.zeros(0, int)
    return fit([rows[i] for i in order], got["grade"].to_numpy()[order].astype(int) if rows else np.zeros(0, int))


def score_rows(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with expected_grade and tail (P of the wanted grade) of each row's whole text.

    The weights, 2^18 numbers whatever the input, are broadcast.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.weights, model.thresholds))
    source = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches):
        weights, thresholds = sent.value
        features = held(("ordinal", xxhash.xxh64_digest(weights.tobytes())), lambda: Features(weights))
        fitted = Model(weights, thresholds)
        for batch in batches:
            with no_collection():
                scores = np.array([features.score(t) for t in batch.column(len(keep)).to_pylist()], float)
            tails = np.round(fitted.tails(scores), 9)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.round(tails.sum(axis=1), 9)), pa.array(tails[:, WANTED - 1])], [*keep, "expected_grade", "tail"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(run, fields + "expected_grade double, tail double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade, tail and kept (tail >= 0.5, so a tie is kept) of every row.

    A null text is scored as an empty one, a text of any length whole, and repeated rows each; a null doc_id has no rating.
    Of several rows with one rated id one is fitted (see ``train``). Other columns are not read.
    """
    scored = score_rows(docs, train(docs, labels), ["doc_id"])
    return scored.select("*", (F.col("tail") >= 0.5).alias("kept"))


def select_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all columns as they were."""
    names = {f"__c{i}": c for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(c).alias(n) for n, c in names.items()], F.col("text"))
    scored = score_rows(renamed, train(docs, labels), list(names))
    return scored.where("tail >= 0.5").select(*[F.col(n).alias(c) for n, c in names.items()])
