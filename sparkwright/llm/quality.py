"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text teach it; labelled negatives are
never looked at. The class prior is estimated by the best bin of a classifier
of positives against unlabelled text (Garg et al., 2021): where only positives
are, the unlabelled share over the positive share is the prior, elsewhere it
is larger. The score then minimises the non-negative risk (Kiryo et al., 2017)

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the logistic loss, so that it is a probability of the positive class.
The model is additive over bins of text statistics; one pass over the texts
computes these, and everything after works on that small table.

Only the trusted positives are a bounded sample. Bin edges, class prior and the
unlabelled risk are of all teaching rows: edges from counts per narrow range of
values, the risk by Newton steps whose loss, gradient and curvature are sums over
the binned rows (the risk is convex in the weights). The sums are of integers, so
the model does not depend on how rows are dealt. Weights are held by a penalty of
their steps between neighbouring bins. Where the risk of negatives ends below
zero, which is overfitting, they are held tighter, as little as will do, until it
does not."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import bounded_sample, cut, python_tasks, utf8

#: Trusted positives that the model is fitted on.
SAMPLE = 20_000
#: Newton steps at most, and the largest change of a weight in one of them.
STEPS, REACH = 30, 3.0
#: How often the range of the penalty is halved, on a logarithmic scale.
HALVINGS = 4
#: Binned rows up to which the sums are taken without a Spark job each.
LOCAL_ROWS = 100_000
#: Binned rows of a task, where that makes more tasks than there are cores.
TASK_ROWS = 500_000
#: Penalty of a weight itself, beside that of its step from the next bin's.
RIDGE = 0.02
#: Sums are of integer multiples of these.
UNIT, LOSS_UNIT = 1 << 24, 1 << 20
FOLDS = 5
BINS = 12
THRESHOLD = 0.3

_UPPER, _LOWER, _DIGIT = (bytes(range(ord(a), ord(b) + 1)) for a, b in ("AZ", "az", "09"))
_MARKS, _ENDS, _SPACE = b"#*$%&|<>{}[]\\^~_=+@", b".,;:?!'\"()-", b" \t\n\r\x0b\x0c"
NAMES = (
    "words", "word_bytes", "marks", "ends", "upper", "digits", "distinct", "neighbours", "commonest",
    "line_copies", "line_words", "long_words", "exclaims",
)


def _without(text: bytes, drop: bytes) -> int:
    return len(text) - len(text.translate(None, drop))


def statistics(text: bytes | None) -> list[float]:
    """Numbers of a whole text that do not depend on its language; all zero
    without words."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    body = len(text) - _without(text, _SPACE)
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return [
        np.log1p(n),
        body / n,
        _without(text, _MARKS) / body,
        _without(text, _ENDS) / n,
        _without(text, _UPPER) / body,
        _without(text, _DIGIT) / body,
        len(counts) / n**0.75,
        sum(map(eq, words, words[1:])) / n,
        max(counts.values()) / n,
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        sum(len(w) > 25 for w in counts) / n,
        text.count(b"!") / n,
    ]


class PuModel:
    """Additive logistic model over bins; ``edges`` per statistic."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, prior: float):
        self.edges, self.weights, self.prior = edges, weights, prior

    def cells(self, x: np.ndarray) -> np.ndarray:
        """(rows, statistics) numbers of the bins, and the constant last."""
        at, first = [], 0
        for j, e in enumerate(self.edges):
            at.append(first + np.searchsorted(e, x[:, j], side="right"))
            first += len(e) + 1
        at.append(np.full(len(x), first))
        return np.column_stack(at)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.weights[self.cells(x)].sum(axis=1))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _ranges(x: np.ndarray) -> np.ndarray:
    """Number of the narrow range of each value (relative width 1/256); rises
    with the value. Statistics are not negative."""
    return np.maximum(x, 0.0).view(np.int64) >> 44


def _edges(ranges: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Inner edges of a statistic: quantiles of its values, and of their outer
    tenths again, where the unusual texts are; lower ends of the ranges."""
    q = np.concatenate([np.linspace(0, 0.1, bins // 3 + 1), np.linspace(0.1, 0.9, bins // 3 + 1), np.linspace(0.9, 1, bins // 3 + 1)])
    upto = np.cumsum(counts)
    at = np.searchsorted(upto, np.unique(q)[1:-1] * upto[-1], side="left")
    return np.unique((ranges[np.minimum(at, len(ranges) - 1)] << 44).view(np.float64))


def _pull(cells: np.ndarray, by: np.ndarray, width: int) -> np.ndarray:
    return np.bincount(cells.ravel(), np.repeat(by, cells.shape[1]), minlength=width)


def _curve(cells: np.ndarray, by: np.ndarray, width: int) -> np.ndarray:
    """Sum of ``by`` over rows for each pair of cells of a row."""
    out = np.zeros((width, width))
    for j in range(cells.shape[1]):
        for k in range(cells.shape[1]):
            out += np.bincount(cells[:, j] * width + cells[:, k], by, minlength=width * width).reshape(width, width)
    return out


def _starts(edges: list[np.ndarray]) -> np.ndarray:
    """First cell of each statistic, and the constant's cell last."""
    return np.cumsum([0, *(len(e) + 1 for e in edges)])


def _pairs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of statistics (and the constant), and the most bins of one."""
    first, second = np.triu_indices(len(starts))
    return first, second, int(np.diff(starts).max(initial=1))


def _sums(cells: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows taken as negatives: (rows and loss), gradient and curvature
    of the loss (by pair of statistics and bins of both), in whole units."""
    first, second, most = _pairs(starts)
    loss, gradient = np.zeros(2, np.int64), np.zeros(len(weights), np.int64)
    curve = np.zeros(len(first) * most * most)
    for at in range(0, len(cells), 4096):
        own = cells[at : at + 4096]
        z = np.clip(weights[own].sum(axis=1), -100, 100)
        p = _sigmoid(z)
        bins = own - starts
        spot = (np.arange(len(first)) * most + bins[:, first]) * most + bins[:, second]
        curve += np.bincount(spot.ravel(), np.repeat(np.rint(p * (1 - p) * UNIT), len(first)), minlength=len(curve))
        gradient += np.rint(_pull(own, np.rint(p * UNIT), len(weights))).astype(np.int64)
        loss += np.array([len(z), np.rint(np.logaddexp(0, z) * LOSS_UNIT).sum()]).astype(np.int64)
    return loss, gradient, np.rint(curve).astype(np.int64)


def _matrix(curve: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The curvature as a symmetric matrix over cells."""
    first, second, most = _pairs(starts)
    ends = [*starts[1:], starts[-1] + 1]
    out = np.zeros((ends[-1], ends[-1]))
    for own, j, k in zip(curve.reshape(len(first), most, most), first, second):
        block = own[: ends[j] - starts[j], : ends[k] - starts[k]]
        out[starts[j] : ends[j], starts[k] : ends[k]] = block
        out[starts[k] : ends[k], starts[j] : ends[j]] = block.T
    return out


class LocalRows:
    """Unlabelled rows held as an array of cells; ``half`` 0, 1 or None (all).
    ``halves`` tells the half of each row (else they alternate)."""

    def __init__(self, cells: np.ndarray, starts: np.ndarray, halves: np.ndarray | None = None):
        self.cells, self.starts = cells, starts
        self.halves = np.arange(len(cells)) % 2 if halves is None else halves

    def _half(self, half):
        return self.cells if half is None else self.cells[self.halves == half]

    def sums(self, weights: np.ndarray, half: int | None = None):
        return _sums(self._half(half), weights, self.starts)

    def above(self, weights: np.ndarray, thresholds: np.ndarray, half: int) -> np.ndarray:
        """Rows whose sum of weights is above each of the rising thresholds."""
        z = np.sort(weights[self._half(half)].sum(axis=1))
        return len(z) - np.searchsorted(z, thresholds, side="right")


def _cells_of(b: pa.RecordBatch, half: int | None, starts: np.ndarray) -> np.ndarray:
    """Cells of the rows of a half (None: all), the constant last."""
    column = b.column("cells")
    if half is not None:
        column = column.filter(pa.array(b.column("half").to_numpy() == half))
    bins = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), len(starts) - 1)
    return np.column_stack([bins + starts[:-1], np.full(len(bins), starts[-1])])


class SparkRows:
    """The same over a DataFrame (half int, cells binary of bin numbers)."""

    def __init__(self, rows: DataFrame, starts: np.ndarray):
        self.rows, self.starts = rows, starts

    def _gather(self, fn, size: int) -> np.ndarray:
        """Sum of the arrays that ``fn`` makes of a function from half to cells."""
        starts = self.starts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size, np.int64)
            for b in batches:
                total += fn(lambda half: _cells_of(b, half, starts))  # noqa: B023
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "v"])

        found = python_tasks(self.rows, run, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(size, np.int64)
        out[found.column("k").to_numpy()] = found.column("v").to_numpy()
        return out

    def sums(self, weights: np.ndarray, half: int | None = None):
        width, starts = len(weights), self.starts
        first, _, most = _pairs(starts)

        def own(cells):
            return np.concatenate(_sums(cells(half), weights, starts))

        flat = self._gather(own, 2 + width + len(first) * most * most)
        return flat[:2], flat[2 : 2 + width], flat[2 + width :]

    def above(self, weights: np.ndarray, thresholds: np.ndarray, half: int) -> np.ndarray:
        def own(cells):
            at = np.searchsorted(thresholds, weights[cells(half)].sum(axis=1), side="left")  # thresholds below
            return np.bincount(at, minlength=len(thresholds) + 1)

        return self._gather(own, len(thresholds) + 1)[::-1].cumsum()[::-1][1:]


def _roughness(edges: list[np.ndarray]) -> np.ndarray:
    """Penalty of weights: squared steps between neighbouring bins of a statistic,
    and a little of the weights themselves; the constant is free."""
    width = sum(len(e) + 1 for e in edges) + 1
    out, first = np.zeros((width, width)), 0
    for e in edges:
        steps = np.diff(np.eye(len(e) + 1), axis=0)
        own = slice(first, first + len(e) + 1)
        out[own, own] = steps.T @ steps + RIDGE * np.eye(len(e) + 1)
        first += len(e) + 1
    return out


def _descend(rows, start: np.ndarray, half: int | None, positive, held: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Newton steps from ``start`` on mean unlabelled loss + ``positive`` + w held
    w / 2; a step is halved while the objective rises. ``positive(w)`` gives value,
    gradient, curvature and the part of the unlabelled loss that is due to
    positives. Also the risk of negatives."""
    def look(w):
        loss, gradient, curve = rows.sums(w, half)
        n = max(int(loss[0]), 1)
        value, g, h, taken = positive(w)
        u = loss[1] / n / LOSS_UNIT
        full = _matrix(curve, rows.starts)
        return u + value + w @ held @ w / 2, gradient / n / UNIT + g + held @ w, full / n / UNIT + h + held, u - taken

    w, now = start, look(start)
    for _ in range(steps):
        value, gradient, curve, _ = now
        step = -np.linalg.solve(curve + 1e-7 * np.eye(len(w)), gradient)
        step *= min(1.0, REACH / max(np.abs(step).max(), 1e-12))
        for _ in range(6):
            new = look(w + step)
            if new[0] < value:
                break
            step = step / 2
        else:
            break
        w, now = w + step, new
        if value - new[0] < 1e-6:
            break
    return w, now[3]


def estimate_prior(score_p: np.ndarray, above_u, n_u: int, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled: the least ratio of the shares
    above a threshold, with the confidence term of both samples. ``above_u``
    counts the unlabelled above each of the rising thresholds."""
    if not len(score_p) or not n_u:
        return 0.5
    p = np.sort(score_p)
    at = np.unique(p)
    q_p = 1 - np.searchsorted(p, at) / len(p)
    q_u = above_u(np.nextafter(at, -np.inf)) / n_u
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(n_u))
    best = np.argmin((q_u + slack) / q_p)
    return float(np.clip(q_u[best] / q_p[best], 0.01, 0.99))


def fit_rows(edges: list[np.ndarray], positive: np.ndarray, rows, prior: float | None = None, l2: float = 1e-4, steps: int = STEPS) -> PuModel:
    """The model of positives (statistics) and unlabelled ``rows`` (binned by the
    same edges). ``prior`` None: estimated on the halves of both that its
    classifier has not seen."""
    model = PuModel(edges, np.zeros(1), 0.5)
    width = sum(len(e) + 1 for e in edges) + 1
    cp, rough = model.cells(positive), _roughness(edges)

    if prior is None:
        half = cp[::2]

        def against(w):
            z = w[half].sum(axis=1)
            p = _sigmoid(z)
            curve = _curve(half, p * (1 - p) / len(half), width)
            return np.logaddexp(0, -z).mean(), _pull(half, (p - 1) / len(half), width), curve, 0.0

        w, _ = _descend(rows, np.zeros(width), 0, against, l2 * rough, steps)
        n_u = int(rows.sums(np.zeros(width), 1)[0][0])
        prior = estimate_prior(w[cp[1::2]].sum(axis=1), lambda t: rows.above(w, t, 1), n_u)
    model.prior = prior
    pulled = _pull(cp, np.full(len(cp), 1 / len(cp)), width)

    def risk(w):
        # loss(+) - loss(-) of a positive is -z: straight in the weights
        z = w[cp].sum(axis=1)
        return -prior * z.mean(), -prior * pulled, 0.0, prior * np.logaddexp(0, z).mean()

    weights, negatives = _descend(rows, np.zeros(width), None, risk, l2 * rough, steps)
    loose = l2
    while negatives < 0 and l2 < 1e3:
        loose, l2 = l2, max(10 * l2, 1e-4)
        weights, negatives = _descend(rows, weights, None, risk, l2 * rough, steps)
    for _ in range(HALVINGS if l2 > loose > 0 else 0):  # the loosest hold that will do
        mid = np.sqrt(loose * l2)
        other, negatives = _descend(rows, weights, None, risk, mid * rough, steps)
        if negatives < 0:
            loose = mid
        else:
            l2, weights = mid, other
    model.weights = weights
    return model


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, l2: float = 1e-4, steps: int = STEPS) -> PuModel:
    """:func:`fit_rows` of two arrays of statistics."""
    shift = min(unlabelled.min(), positive.min(), 0.0)
    edges = []
    for column in (unlabelled - shift).T:
        ranges, counts = np.unique(_ranges(np.ascontiguousarray(column)), return_counts=True)
        edges.append(_edges(ranges, counts) + shift)
    cells = PuModel(edges, np.zeros(1), 0.5).cells(unlabelled)
    return fit_rows(edges, positive, LocalRows(cells, _starts(edges)), prior, l2, steps)


def all_edges(teach: DataFrame) -> list[np.ndarray]:
    """Bin edges of all teaching rows, from counts per statistic and range."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, len(NAMES))
            for j in range(len(NAMES)):
                r, n = np.unique(_ranges(np.ascontiguousarray(x[:, j])), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), j, np.int32)), pa.array(r), pa.array(n)], names=["j", "r", "n"])

    counted = python_tasks(teach.select("x"), count, "j int, r long, n long").groupBy("j", "r").agg(F.sum("n").alias("n")).toPandas()
    out = []
    for j in range(len(NAMES)):
        own = counted[counted["j"] == j].sort_values("r")
        out.append(_edges(own["r"].to_numpy(), own["n"].to_numpy()))
    return out


def binned(teach: DataFrame, edges: list[np.ndarray]) -> SparkRows | LocalRows:
    """All teaching rows as bin numbers, one byte a statistic, written once. Up to
    ``LOCAL_ROWS`` of them (some MB) are summed on the driver, with equal sums."""
    starts = _starts(edges)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, len(NAMES))
            bins = np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]).astype(np.uint8)
            raw = bins.tobytes()
            size = len(NAMES)
            yield pa.RecordBatch.from_arrays(
                [b.column("half"), pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())], names=["half", "cells"]
            )

    half = F.pmod(F.xxhash64("id", "x"), F.lit(2)).cast("int").alias("half")
    rows = cut(python_tasks(teach.select("x", half), cells, "half int, cells binary"))
    n = rows.count()
    if n > LOCAL_ROWS:  # many passes over few bytes: no more tasks than are of use
        return SparkRows(rows.coalesce(max(teach.sparkSession.sparkContext.defaultParallelism, n // TASK_ROWS)), starts)
    few = pa.table(rows.toArrow()).combine_chunks().to_batches()
    cells_ = [_cells_of(b, None, starts) for b in few] or [np.zeros((0, len(starts)), np.int64)]
    return LocalRows(np.concatenate(cells_), starts, np.concatenate([b.column("half").to_numpy() for b in few] or [np.zeros(0)]))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE
) -> DataFrame:
    """(``id_col``, held_out, score, predicted) of every row.

    Only rows whose crc32(id as text) mod ``FOLDS`` is not 0 teach; the others
    are held out. Up to ``sample`` positives (label 1), the first by a hash of the
    id, are fitted on, and all teaching rows as unlabelled ones; what reaches the
    driver are these positives and sums per bin. Null ids: not held out, they teach nothing. Repeated ids and
    rows are scored each; null and empty texts have all statistics zero and the
    score of that bin. Without positives every score is 0.5. Other columns are
    ignored, whatever their names. Empty: empty."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in utf8(b.column(1))], float).reshape(b.num_rows, len(NAMES))
            at = np.arange(0, x.size + 1, len(NAMES), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["id", "x"])

    kind = StructType([StructField("id", docs.schema[id_col].dataType), StructField("x", ArrayType(DoubleType()))])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fold = F.crc32(F.col("id").cast("string")) % FOLDS
    rows = cut(python_tasks(rows, measure, kind).withColumn("held_out", F.coalesce(fold == 0, F.lit(False))))
    trusted = (
        labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).where(F.col("id").isNotNull() & (fold != 0)).distinct()
    )
    teach = rows.where("id is not null and not held_out")
    positive = bounded_sample(teach.join(trusted, "id", "left_semi"), ["id", "x"], sample).select("x").toPandas()["x"]
    model = None
    if len(positive):
        edges = all_edges(teach)
        model = fit_rows(edges, np.stack(positive), binned(teach, edges))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, len(NAMES))
            s = model.score(x) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(s)], names=["id", "held_out", "score"])

    scored = python_tasks(
        rows.select("id", "held_out", "x"), score, StructType([kind["id"], rows.schema["held_out"], StructField("score", DoubleType())])
    )
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
