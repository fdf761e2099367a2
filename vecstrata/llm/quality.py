"""A quality classifier learnt from overlapping heuristics, without labels.

Thirteen heuristic labellers, with bounds like those of published web-text
filters, each say good, bad or nothing about a text.  Several look at the same
faults in different ways, some often complain about sound texts.  The counts of
their joint answers over all documents are the input of expectation-maximisation
for a two-class model in which each labeller has its own answer probabilities in
either class.  It starts from the share of good answers of each combination,
every labeller weighing the same, and estimates how accurate each is; silence is
no evidence.  The posteriors of a bounded sample of documents (``SAMPLE`` rows of
least id hash) are the soft labels of a linear scorer over hashed byte trigrams
and hashed measurements, and the scorer decides on every document.

The joint answers have at most 3**13 combinations, so what reaches the driver is
bounded; the sample is bounded by its parameter.

Defined cases: null and empty texts are rejected (no words); texts of any length
are measured whole; rows with null ids are measured and decided like any other;
repeated rows get equal decisions; where all documents get one class, or the
sample is empty, the posterior alone decides; an empty table gives no rows;
other columns pass through a filter unchanged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lean import filtered, lean

#: Documents that the scorer is fitted on, at most, and buckets of its trigrams and measurements.
SAMPLE, BUCKETS = 3000, 1 << 12
#: Added to each answer's count in either class.
PRIOR = 1.0

SYMBOLS = b"*$%#&|{}[]<>~^_\\=+@"
#: What a line of prose ends with.
ENDS = (b".", b"!", b"?", b":", b'"')
MARKS = SYMBOLS + b".,;:!?\"'()"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
# Common short words of the four languages.
COMMON = frozenset(
    (
        "the of and to in is it that was for on are as with be at by this from have or an not but "
        "de la le les des et en un une du que qui dans pour par sur au est avec "
        "der die und das den von zu mit ist auf dem ein eine nicht sich als auch es im für "
        "el los las y del se una con su para al lo como más o"
    )
    .encode()
    .split()
)


NAMES = "symbols letters upper excited repeats lines fields common ends length words word pair".split()
WORDS = NAMES.index("words")


def measures(text: bytes) -> np.ndarray:
    """What the labellers measure of a whole text, in the order of ``NAMES``."""
    n, words = len(text), text.split()
    count = len(words)
    if not count:
        return np.zeros(len(NAMES))
    letters, solid = n - len(text.translate(None, LETTERS)), sum(map(len, words))
    plain = text.lower().translate(None, MARKS).split()
    lines = [x.rstrip() for x in text.split(b"\n") if x.strip()]
    return np.array(
        [
            (n - len(text.translate(None, SYMBOLS))) / count,
            letters / solid,
            (n - len(text.translate(None, UPPER))) / max(letters, 1),
            (text.count(b"!") + text.count(b"?")) / count,
            sum(map(eq, words, words[1:])) / count,
            1 - len(set(lines)) / len(lines) if len(lines) > 2 else 0.0,
            text.count(b"|") / count,
            sum(map(COMMON.__contains__, plain)) / count,
            sum(x.endswith(ENDS) for x in lines) / len(lines),
            solid / count,
            count,
            max(Counter(words).values()) / count,
            max(Counter(zip(words, words[1:], strict=False)).values(), default=0) / count,
        ]
    )


ANY = 1e9
# For each measurement, where it says bad and where good.  A labeller is silent in between.
#: (bad below, good from, good up to, bad above)
BOUNDS = np.array(
    [
        (-ANY, -ANY, 0.05, 0.10),
        (0.80, 0.90, ANY, ANY),
        (-ANY, -ANY, 0.10, 0.30),
        (-ANY, -ANY, 0.05, 0.10),
        (-ANY, -ANY, 0.03, 0.10),
        (-ANY, -ANY, 0.10, 0.30),
        (-ANY, -ANY, 0.02, 0.10),
        (0.06, 0.15, ANY, ANY),
        (0.50, 0.90, ANY, ANY),
        (3.0, 4.0, 8.0, 10.0),
        (50, 100, 20_000, 100_000),
        (-ANY, -ANY, 0.12, 0.25),
        (-ANY, -ANY, 0.04, 0.12),
    ]
)
#: Words that a labeller needs before it says anything.
NEEDS = np.array([5, 12, 12, 5, 12, 1, 5, 20, 1, 5, 1, 20, 20])


def votes(found: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, 2 silent, for each labeller."""
    bad = (found < BOUNDS[:, 0]) | (found > BOUNDS[:, 3])
    good = (found >= BOUNDS[:, 1]) & (found <= BOUNDS[:, 2])
    return np.where(found[WORDS] < NEEDS, 2, np.where(bad, 0, np.where(good, 1, 2)))


def key_of(answers: np.ndarray) -> int:
    """Answers as one number, in base 3."""
    return int(answers @ 3 ** np.arange(len(answers)))


class WeakLabels:
    """Accuracies of the labellers and posteriors of their joint answers."""

    def __init__(self, counts: dict[int, int], rounds: int = 300):
        keys = np.array(sorted(counts) or [0], np.int64)
        weight = np.array([counts.get(int(k), 0) for k in keys], float)
        answers = keys[:, None] // 3 ** np.arange(len(BOUNDS)) % 3
        bad, good = (answers == 0).sum(1), (answers == 1).sum(1)
        post = (good + 1) / (good + bad + 2)
        for _ in range(rounds):
            self.share = (post @ weight + 1) / (weight.sum() + 2)
            sides = np.stack([(1 - post) * weight, post * weight])
            table = np.stack([[sides[c] @ (answers == v) for v in range(2)] for c in range(2)]) + PRIOR
            self.table = table / table.sum(1, keepdims=True)  # class, answer, labeller
            logs = np.concatenate([np.log(self.table), np.zeros((2, 1, len(BOUNDS)))], 1)  # silence says nothing
            like = np.stack([logs[c][answers, np.arange(len(BOUNDS))].sum(1) for c in range(2)])
            odds = like[1] - like[0] + np.log(self.share / (1 - self.share))
            held, post = post, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            if np.abs(post - held).max() < 1e-9:
                break
        self.known = dict(zip(keys.tolist(), post.tolist(), strict=True))

    def accuracy(self) -> np.ndarray:
        """For each labeller, how often it is right when it says anything."""
        right = self.share * self.table[1, 1] + (1 - self.share) * self.table[0, 0]
        wrong = self.share * self.table[1, 0] + (1 - self.share) * self.table[0, 1]
        return right / (right + wrong)


def vector(text: bytes, found: np.ndarray) -> np.ndarray:
    """Hashed features: square roots of trigram shares, and a bucket for the size of each measurement."""
    out = np.zeros(BUCKETS, np.float32)
    b = np.frombuffer(text, np.uint8)
    if len(b) > 2:
        x = b.astype(np.uint32)
        h = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        out = np.sqrt(np.bincount(h >> np.uint32(20), minlength=BUCKETS) / (len(b) - 2)).astype(np.float32)
    sizes = np.sqrt(found) * 8
    sizes[WORDS] = 4 * np.log2(1 + found[WORDS])
    steps = np.minimum(sizes.astype(np.int64), 40)
    out[(np.arange(len(steps)) * 41 + steps) * 2654435761 % BUCKETS] += 1
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 2.0, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels, both classes of equal weight; the last weight is the constant."""
    w = np.zeros(x.shape[1] + 1, np.float32)
    share = np.where(y >= 0.5, 0.5 / max((y >= 0.5).sum(), 1), 0.5 / max((y < 0.5).sum(), 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        slope = ((p - y) * share).astype(np.float32)
        w[:-1] -= rate * (slope @ x + decay * w[:-1])
        w[-1] -= rate * slope.sum()
    return w


class QualityModel:
    """Decides on texts; made by ``train``."""

    def __init__(self, labels: WeakLabels, weights: np.ndarray | None):
        self.labels, self.weights = labels, weights

    def judge(self, text: bytes | None) -> tuple[float, float, bool]:
        """(posterior of the heuristics, probability by the scorer, whether it is kept)."""
        text = text or b""
        if not text.split():
            return 0.0, 0.0, False
        found = measures(text)
        posterior = self.labels.known.get(key_of(votes(found)), 0.5)
        if self.weights is None:
            return posterior, posterior, posterior >= 0.5
        odds = float(vector(text, found) @ self.weights[:-1] + self.weights[-1])
        return posterior, float(1 / (1 + np.exp(-np.clip(odds, -30, 30)))), odds >= 0


def _vote_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, int] = {}
    for b in batches:
        for t in b.column(0):
            k = key_of(votes(measures(t.as_py() or b"")))
            seen[k] = seen.get(k, 0) + 1
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(seen.values(), pa.int64())], names=["answers", "n"])


def _vector_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t.as_py() or b"" for t in b.column(0)]
        found = [measures(t) for t in texts]
        keys = [key_of(votes(m)) for m in found]
        rows = [vector(t, m).astype(np.float16).tobytes() for t, m in zip(texts, found, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rows, pa.binary())], names=["answers", "x"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> QualityModel:
    """Fit both models: the labellers' over all documents, the scorer over at most ``sample``."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    answers = rows.select("text").mapInArrow(lean(_vote_batches), "answers bigint, n bigint").groupBy("answers").agg(F.sum("n").alias("n"))
    labels = WeakLabels({r.answers: r.n for r in answers.collect()})
    taken = rows.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("k")).orderBy("k", "doc_id").limit(sample).select("doc_id").distinct()
    chosen = rows.join(F.broadcast(taken.withColumnRenamed("doc_id", "wanted")), F.col("doc_id") == F.col("wanted"), "left_semi").select("text").limit(sample)
    got = chosen.mapInArrow(lean(_vector_batches), "answers bigint, x binary").collect()
    y = np.array([labels.known[r.answers] for r in got])
    if len(y) == 0 or y.min() >= 0.5 or y.max() < 0.5:
        return QualityModel(labels, None)
    return QualityModel(labels, fit(np.stack([np.frombuffer(r.x, np.float16) for r in got]).astype(np.float32), y))


def _judge_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            made = [model.judge(t.as_py()) for t in b.column(1)]
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "posterior", "quality", "kept"])

    return run


def judge(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, posterior, quality, kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(lean(_judge_batches(shared)), "doc_id bigint, posterior double, quality double, kept boolean")


def _keep_batches(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = b.column(at).cast(pa.binary())
            yield from filtered(b, [model.judge(t.as_py())[2] for t in texts])

    return run


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier rejects, all columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col))
    return docs.mapInArrow(lean(_keep_batches(shared, docs.columns.index(text_col))), docs.schema)
