"""Toxicity by cumulative-link ordinal regression on sparse word features.

P(grade >= k) = sigmoid(w . x - theta_k): one weight per word, shared by all
ordered thresholds; the expected severity is the sum over k of P(grade >= k).
It is that of the corpus: a sampled row weighs as many labels as it stands for.

The features are hashed words and word beginnings (so that other forms of a
word count too). The model is learned from a bounded sample of labelled rows:
one pass counts in how many of its texts each feature bucket stands, the
buckets that tell the grades apart best (a bounded number, by the z-value of
their log odds) are kept, a second pass counts these per text. Labels may be
grades 0..K; 0/1 labels are spread to the grades 0, 1, 2 by how densely a
toxic text uses the buckets of the toxic side."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from .common import bounded_sample, cut, python_tasks

#: Labelled rows of each side (toxic or not) that are learned from.
SAMPLE = 10_000
#: Buckets that words are hashed to, and those of them that become features.
BUCKETS = 1 << 18
FEATURES = 1024
#: Lengths of the word beginnings that are features beside the word.
BEGINNINGS = (4, 5, 6)
#: Least number of sampled texts a feature stands in.
LEAST_TEXTS = 5
#: Expected severity from which a text is rejected.
REJECT = 0.3
_WORD = re.compile(r"[^\W\d_]+")
#: Words whose buckets a task remembers before it starts afresh.
_MEMORY = 100_000


def buckets(word: str) -> list[int]:
    """Buckets of a lower-case word: itself and its beginnings."""
    names = [word + "$", *(word[:n] for n in BEGINNINGS if len(word) > n)]
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


class Features:
    """Counts of the features ``index`` (bucket -> number) in a text."""

    def __init__(self, index: dict[int, int]):
        self.index, self.known = index, {}

    def __call__(self, text: str | None) -> Counter:
        found: Counter = Counter()
        known, index = self.known, self.index
        for w in _WORD.findall(text.lower()) if text else ():
            own = known.get(w)
            if own is None:
                if len(known) >= _MEMORY:
                    known.clear()
                own = known[w] = tuple(index[b] for b in buckets(w) if b in index)
            for k in own:
                found[k] += 1
        return found


class OrdinalModel:
    """Cumulative-link model: features (buckets), weights, ordered cuts."""

    def __init__(self, chosen: list[int], weights: np.ndarray, cuts: np.ndarray):
        self.features = Features({b: k for k, b in enumerate(chosen)})
        self.weights, self.cuts = weights, cuts

    def probabilities(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K."""
        score = sum(self.weights[k] * np.log1p(n) for k, n in self.features(text).items())
        return 1 / (1 + np.exp(np.clip(self.cuts - score, -500, 500)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int, l2: float = 0.5, steps: int = 400, standing: np.ndarray | None = None):
    """Weights and ordered cuts of the penalised likelihood, by Adam. The cuts
    are a first one plus positive distances, so they stay in order. A row counts
    ``standing`` times (once, if not given)."""
    top = int(grades.max()) if len(grades) else 0
    if top < 1:
        return np.zeros(width), np.full(max(top, 1), 50.0)
    weights, raw = np.zeros(width), np.zeros(top)
    standing = np.ones(len(grades)) if standing is None else standing
    share = np.array([np.average(grades >= k, weights=standing) for k in range(1, top + 1)])
    start = np.log((1 - share + 1e-6) / (share + 1e-6))
    raw[0] = start[0]
    raw[1:] = np.log(np.expm1(np.maximum(np.diff(start), 1e-2)))
    params = np.concatenate([weights, raw])
    m, v = np.zeros_like(params), np.zeros_like(params)
    n = len(grades)
    onehot = np.arange(top + 1)[None, :] == grades[:, None]
    for step in range(1, steps + 1):
        weights, raw = params[:width], params[width:]
        gaps = np.logaddexp(0, raw[1:])
        cuts = raw[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, weights[cols] * values, minlength=n)
        above = np.column_stack([np.ones(n), 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -500, 500))), np.zeros(n)])
        mass = np.maximum(above[:, :-1] - above[:, 1:], 1e-12)
        slope = above * (1 - above)  # d above / d score, also -d / d cut
        g = standing / (onehot * mass).sum(axis=1)
        d_score = -g * ((slope[:, :-1] - slope[:, 1:]) * onehot).sum(axis=1)
        d_cut = np.array([(g * slope[:, k] * (onehot[:, k].astype(float) - onehot[:, k - 1])).sum() for k in range(1, top + 1)])
        grad_w = np.bincount(cols, d_score[rows] * values, minlength=width) + l2 * weights
        grad_raw = np.empty(top)
        grad_raw[0] = d_cut.sum()
        tail = np.cumsum(d_cut[::-1])[::-1]
        grad_raw[1:] = tail[1:] / (1 + np.exp(-raw[1:]))
        grad = np.concatenate([grad_w, grad_raw])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params = params - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    weights, raw = params[:width], params[width:]
    return weights, raw[0] + np.concatenate([[0.0], np.cumsum(np.logaddexp(0, raw[1:]))])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", features: int = FEATURES, sample: int = SAMPLE) -> OrdinalModel:
    """The model of the labelled rows of ``docs``. What reaches the driver is
    bounded by ``features`` buckets and 2 * ``sample`` rows of their counts: of the
    texts of one id, one is learned from, the first by a hash of the text. The
    sides are sampled apart, so each sampled row is weighted by labels / sampled
    labels of its side: the ratio of the sides is that of all labels.
    Labels that are null, and of ids that are null or absent, teach nothing; of
    several labels of one id the highest counts."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.col(label_col).cast("int")).alias("grade")
    )
    sides = [bounded_sample(marks.where(c), ["id"], sample) for c in ("grade > 0", "grade <= 0")]
    sampled = cut(sides[0].unionByName(sides[1]))  # at most 2 * sample ids
    picked = F.broadcast(sampled)
    side = (F.col("grade") > 0).alias("toxic")
    there, taken = ({r["toxic"]: r["count"] for r in t.groupBy(side).count().collect()} for t in (marks, sampled))
    stands = np.array([there[k] / taken[k] if taken.get(k) else 1.0 for k in (False, True)])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    first = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("t"))).alias("own")
    chosen = texts.join(picked, "id").groupBy("id").agg(first, F.max("grade").alias("grade"))
    chosen = cut(chosen.select("grade", F.xxhash64("id").alias("key"), F.col("own.t").alias("text")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros((2, BUCKETS + 1), np.int64), {}
        for b in batches:
            for grade, text in zip(b.column("grade").to_pylist(), b.column("text").to_pylist()):
                own: set[int] = {BUCKETS}  # counts the texts
                for w in set(_WORD.findall(text.lower())):
                    if w not in known:
                        if len(known) >= _MEMORY:
                            known.clear()
                        known[w] = buckets(w)
                    own.update(known[w])
                total[int(grade > 0), list(own)] += 1
        at = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["bucket", "good", "bad"])

    told = python_tasks(chosen, count, "bucket long, good long, bad long").groupBy("bucket").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad")
    )
    told = cut(told)  # at most BUCKETS rows
    whole = told.where(F.col("bucket") == BUCKETS).first()
    if whole is None or not whole["good"] or not whole["bad"]:
        return OrdinalModel([], np.zeros(0), np.full(1, 50.0))
    yes, no = F.col("bad") + 0.5, F.col("good") + 0.5
    odds = F.log(yes / (whole["bad"] + 1 - yes)) - F.log(no / (whole["good"] + 1 - no))
    spread = F.sqrt(1 / (float(stands[1]) * yes) + 1 / (float(stands[0]) * no))
    best = (
        told.where((F.col("bucket") < BUCKETS) & (F.col("good") + F.col("bad") >= LEAST_TEXTS))
        .withColumn("z", odds / spread)
        .orderBy(F.abs("z").desc(), "bucket")
        .limit(features)
        .collect()
    )
    index, toxic_side = [r["bucket"] for r in best], np.array([r["z"] > 0 for r in best], bool)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts_of = Features({b: k for k, b in enumerate(index)})
        for b in batches:
            found = [counts_of(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("grade"), b.column("key"), pa.array([list(c) for c in found], pa.list_(pa.int32())),
                    pa.array([list(c.values()) for c in found], pa.list_(pa.int32())),
                ],
                names=["grade", "key", "cols", "counts"],
            )

    got = python_tasks(chosen, featurise, "grade int, key long, cols array<int>, counts array<int>").collect()
    got.sort(key=lambda r: (r["key"], r["grade"], r["cols"], r["counts"]))  # the same sums however rows were dealt
    grades = np.maximum([r["grade"] for r in got], 0)
    rows = np.repeat(np.arange(len(got)), [len(r["cols"]) for r in got])
    cols = np.array([c for r in got for c in r["cols"]], np.int64)
    values = np.log1p(np.array([c for r in got for c in r["counts"]], float))
    standing = stands[(grades > 0).astype(int)]
    if grades.max(initial=0) <= 1:
        dose = np.bincount(rows, values * toxic_side[cols], minlength=len(got))
        positive = grades > 0
        grades = grades + (positive & (dose > np.median(dose[positive])))
    return OrdinalModel(index, *fit_ordinal(rows, cols, values, grades, len(index), standing=standing))


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """All columns of ``docs`` as the struct ``doc``, with severity (expected
    grade), grade (the likeliest) and rejected. Null and empty texts hold no
    word: the severity of a text without features."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            above = np.array([model.probabilities(t) for t in b.column("doc").field(text_col).to_pylist()]).reshape(b.num_rows, -1)
            severity = above.sum(axis=1)
            mass = np.column_stack([np.ones(len(above)), above]) - np.column_stack([above, np.zeros(len(above))])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), pa.array(severity), pa.array(mass.argmax(axis=1).astype(np.int32)), pa.array(severity >= reject)],
                names=["doc", "severity", "grade", "rejected"],
            )

    kind = StructType([
        StructField("doc", rows.schema["doc"].dataType), StructField("severity", DoubleType()),
        StructField("grade", IntegerType()), StructField("rejected", BooleanType()),
    ])
    return python_tasks(rows, run, kind)


def rate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **how) -> DataFrame:
    """Every row of ``docs`` scored by the model of its labelled rows: see
    :func:`train` and :func:`score`. Without labels of both sides nothing is
    rejected. Rows with null or repeated ids are scored like others; no column
    but id and text is read, whatever its name. Empty: empty."""
    return score(docs, train(docs, labels, id_col, text_col, label_col, **how), id_col, text_col)
