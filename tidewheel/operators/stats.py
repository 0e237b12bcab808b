"""Statistics of vectors: moments, histogram quantiles, covariance and principal components, all with partial aggregation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.session import cut, partitions

#: Bins of a histogram quantile, and how far its edges lie beyond the values.
BINS, EDGE = 5_000, 1e-10
#: Widest vector with a covariance: its matrix of products has to fit one task.
MOST_DIMS = 4_096
#: Distinct values of a group from which its percentiles are taken at once; of more, the interval that holds them is narrowed first, by so many parts.
MOST_VALUES, PARTS = 100_000, 1_024


def per_dim(df: DataFrame, vector: Column, *keys: str) -> DataFrame:
    """Rows of (keys, dim, x) of a vector column; nulls are left out."""
    rows = df.select(*keys, F.posexplode(vector).alias("dim", "x"))
    return rows.select(*keys, F.col("dim").cast("long").alias("dim"), F.col("x").cast("double").alias("x")).where("x is not null")


def _moments() -> tuple[Column, ...]:
    return F.count("x").alias("n"), F.avg("x").alias("mean"), F.avg(F.col("x") * F.col("x")).alias("_sq")


def _ends() -> tuple[Column, ...]:
    return (F.min("x") - EDGE).alias("_lo"), (F.max("x") + EDGE).alias("_hi")


def _with_std(rows: DataFrame) -> DataFrame:
    return rows.withColumn("std", F.sqrt(F.greatest(F.lit(0.0), F.col("_sq") - F.col("mean") * F.col("mean")))).drop("_sq")


def moments(values: DataFrame, *keys: str) -> DataFrame:
    """n, mean, std by keys: the population's deviation from the mean of squares, as merged from partial sums."""
    return _with_std(values.groupBy(*keys).agg(*_moments()))


def _histogram(values: DataFrame, summary: DataFrame, quantiles: dict[str, float], keys: tuple[str, ...], bins: int) -> DataFrame:
    """The summary's rows (keys, n, _lo, _hi and whatever else) with quantiles from equal bins between _lo and _hi."""
    joined = values.join(summary, list(keys)) if keys else values.crossJoin(F.broadcast(summary))  # one row
    bin_ = F.least(F.floor((F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).alias("_bin")
    known = summary.columns
    counts = joined.groupBy(*known, bin_).agg(F.count("*").alias("_c"))
    upto = counts.withColumn("_cum", F.sum("_c").over(Window.partitionBy(*known).orderBy("_bin")))  # at most `bins` rows of each key
    edge = lambda q: F.min(F.when(F.col("_cum") >= q * F.col("n"), F.col("_bin")))
    got = upto.groupBy(*known).agg(*(edge(q).alias(k) for k, q in quantiles.items()))
    return got.withColumns({k: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col(k) / float(bins) for k in quantiles}).drop("_lo", "_hi")


def hist_quantiles(values: DataFrame, quantiles: dict[str, float], *keys: str, bins: int = BINS) -> DataFrame:
    """Histogram quantiles by keys: the left edge of the first of equal bins between minimum and maximum that holds the rank q * n.

    Two passes, and per key at most `bins` counts; the counts of separate parts can be added up when their edges are the same.
    """
    return _histogram(values, values.groupBy(*keys).agg(F.count("x").alias("n"), *_ends()), quantiles, keys, bins)


def norm_stats(values: DataFrame, *keys: str) -> DataFrame:
    """n, mean, std, q01, q99 by keys, in two passes: what a normalisation needs."""
    summary = values.groupBy(*keys).agg(*_moments(), *_ends())
    return _with_std(_histogram(values, summary, {"q01": 0.01, "q99": 0.99}, keys, BINS))


class GrowingHistogram:
    """Counts of vectors by equal bins whose range grows with what comes, as a job that can't look twice keeps them.

    When a batch goes beyond the range, each bin's count moves to the new bin that holds its old left edge; the first range has a margin
    of EDGE on both sides, later ones have none, and a left edge that lies before the new range takes its count along. So the result
    depends on the order of the batches; hist_quantiles looks twice and doesn't.
    """

    def __init__(self, bins: int = BINS) -> None:
        self.bins, self.n = bins, 0
        self.low = self.high = self.edges = self.counts = None

    def _count(self, x: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Weights by bin and dimension; the last bin holds its right edge, what lies outside counts for nothing."""
        out = np.zeros((self.bins, x.shape[1]))
        for d, e in enumerate(self.edges):
            inside = (x[:, d] >= e[0]) & (x[:, d] <= e[-1])
            k = np.minimum(np.searchsorted(e, x[inside, d], "right") - 1, self.bins - 1)
            out[:, d] = np.bincount(k, weight[inside, d], self.bins)
        return out

    def add(self, x: np.ndarray) -> None:
        """A batch of vectors, rows by dimensions."""
        low, high = x.min(0), x.max(0)
        if self.counts is None:
            self.low, self.high = low, high
            self.edges = np.linspace(low - EDGE, high + EDGE, self.bins + 1).T
            self.counts = np.zeros((self.bins, x.shape[1]))
        elif (low < self.low).any() or (high > self.high).any():
            self.low, self.high, before = np.minimum(low, self.low), np.maximum(high, self.high), self.edges
            self.edges = np.linspace(self.low, self.high, self.bins + 1).T
            self.counts = self._count(before[:, :-1].T, self.counts)
        self.n += len(x)
        self.counts = self.counts + self._count(x, np.ones(x.shape))

    def quantile(self, q: float) -> np.ndarray:
        """By dimension the left edge of the first bin up to which q * n are counted."""
        k = (np.cumsum(self.counts, axis=0) < q * self.n).sum(0)
        return self.edges[np.arange(len(k)), k]


def growing_quantiles(df: DataFrame, vector: Column, order: Sequence[str], batch: int, quantiles: Sequence[float], bins: int = BINS) -> DataFrame:
    """(dim, q, x): quantiles of a GrowingHistogram fed in order, `batch` vectors at a time. Null vectors are left out.

    As each batch depends on those before, one task folds them, holding one batch and the histogram.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, held = GrowingHistogram(bins), []
        for b in batches:
            held += b.column(0).to_pylist()
            while len(held) >= batch:
                h.add(np.array(held[:batch], float))
                held = held[batch:]
        if held:
            h.add(np.array(held, float))
        for q in quantiles if h.n else ():
            x = h.quantile(q)
            yield pa.RecordBatch.from_pydict({"dim": np.arange(len(x)), "q": np.full(len(x), q), "x": x})

    rows = df.where(vector.isNotNull()).select(*order, vector.cast("array<double>").alias("_v")).orderBy(*order).select("_v")
    return rows.coalesce(1).mapInArrow(work, "dim long, q double, x double")


def exact_percentiles(values: DataFrame, keys: Sequence[str], value: str, percentiles: Sequence[float], n: str | None = None, most: int = MOST_VALUES) -> DataFrame:
    """(keys, p, value): exact percentiles by keys, between two ranks in proportion; n, if given, counts how often a row's value occurs.

    Values that are null or not finite are left out; a group without others gives no row. No group is ever sorted whole: equal values are
    counted first, and a group with more than `most` distinct ones is halved in on, in passes that count its values by parts of the
    interval in which the ranks lie.
    """
    keys, v = list(keys), F.col(value).cast("double")
    fine = values.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    counted = fine.groupBy(*keys, v.alias("_v")).agg((F.sum(n) if n else F.count("*")).alias("_n"))
    counted = cut(counted)
    total = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.count("*").alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    spans = total.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in percentiles)))).withColumn("_r", F.col("p") * (F.col("_total") - 1)).withColumn("_below", F.lit(0).cast("long"))
    spans, one = cut(spans), [*keys, "p"]
    while not (wide := spans.where(F.col("_d") > most)).isEmpty():
        part = F.least(F.lit(PARTS - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PARTS))
        inside = counted.join(wide, keys).where("_v between _lo and _hi").withColumn("_part", part)
        parts = inside.groupBy(*one, "_total", "_r", "_below", "_part").agg(F.sum("_n").alias("_n"), F.count("*").alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.col("_below") + F.sum("_n").over(Window.partitionBy(*one).orderBy("_part"))  # at most PARTS rows of each
        held = parts.withColumn("_upto", upto).where("_upto > floor(_r) and _upto - _n <= ceil(_r)")
        found = held.groupBy(*one, "_total", "_r").agg(F.sum("_d").alias("_d"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.min(F.col("_upto") - F.col("_n")).alias("_below"))
        spans = cut(spans.where(F.col("_d") <= most).unionByName(found.select(*spans.columns)))
    left = counted.join(spans, keys).where("_v between _lo and _hi")
    w = Window.partitionBy(*one).orderBy("_v")  # at most `most` rows of each
    ranked = left.withColumn("_upto", F.col("_below") + F.sum("_n").over(w))
    at = lambda r: F.min(F.when(F.col("_upto") > r, F.col("_v")))
    ends = ranked.groupBy(*one).agg(at(F.floor("_r")).alias("_a"), at(F.ceil("_r")).alias("_b"), F.max(F.col("_r") - F.floor("_r")).alias("_f"))
    return ends.select(*one, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias(value))


def as_vectors(stats: DataFrame) -> DataFrame:
    """One row of arrays mean, std, q01, q99 from statistics by dim (as many as a vector has)."""
    one = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std", "q01", "q99"))).alias("s"))
    return one.select(*(F.col(f"s.{k}").alias(k) for k in ("mean", "std", "q01", "q99")))


def _products(width: int):  # noqa: ANN202
    """A partition's sums of products of the vectors with a 1 appended, as one row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for b in batches:
            c = b.column(0)
            c = c.filter(c.is_valid())
            x = c.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
            x = x[np.isfinite(x).all(1)]
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    return work


def _added(width: int, last: bool):  # noqa: ANN202
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_buffer()).reshape(width + 1, width + 1)
        if not last:
            yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})
        elif (n := total[-1, -1]) > 0:
            with np.errstate(all="ignore"):
                cov = (total[:-1, :-1] - np.outer(total[:-1, -1], total[:-1, -1]) / n) / (n - 1)
            yield pa.RecordBatch.from_pydict({"n": np.array([int(n)]), "mean": [total[:-1, -1] / n], "cov": [cov.ravel()]})

    return work


def _moment_matrix(df: DataFrame, vector: Column, width: int) -> DataFrame:
    """One row n, mean, cov (width * width numbers): a block of sums per partition, added up in two steps; none without finite vectors."""
    if width > MOST_DIMS:
        raise ValueError(f"at most {MOST_DIMS} dimensions")
    sized = df.select(F.when(F.size(vector) == width, vector.cast("array<double>")).alias("v"))
    blocks = sized.mapInArrow(_products(width), "sums binary").repartition(max(1, math.isqrt(partitions(df)))).mapInArrow(_added(width, False), "sums binary")
    return blocks.coalesce(1).mapInArrow(_added(width, True), "n long, mean array<double>, cov array<double>")


def covariance(df: DataFrame, vector: Column, width: int) -> DataFrame:
    """(i, j, cov) with n - 1 in the denominator, i <= j, in one pass. Vectors of another width or with a null or not-finite element are left out."""
    pairs = _moment_matrix(df, vector, width).select(F.posexplode("cov").alias("k", "cov")).select(F.floor(F.col("k") / width).alias("i"), (F.col("k") % width).cast("long").alias("j"), "cov")
    return pairs.where("i <= j and not isnan(cov)")


def principal_components(df: DataFrame, vector: Column, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """mean, components (k x width), scales and explained share. A component's sign makes its largest entry positive; scales are 1e-3 at least."""
    found = _moment_matrix(df, vector, width).first()  # one row of width * (width + 1) numbers
    mean, cov = (np.zeros(width), np.zeros((width, width))) if found is None else (np.array(found["mean"]), np.array(found["cov"]).reshape(width, width))
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    parts = axes[:, order].T
    parts *= np.sign(parts[np.arange(k), np.abs(parts).argmax(1)])[:, None]
    return mean, parts, np.sqrt(np.maximum(values[order], 1e-6)), float(values[order].sum() / max(values.sum(), 1e-300))


def require_quantiles(stats: DataFrame) -> DataFrame:
    """The statistics, or an error of the query where a quantile is missing."""
    there = F.col("q01").isNotNull() & F.col("q99").isNotNull()
    return stats.withColumn("q01", F.when(there, F.col("q01")).otherwise(F.raise_error(F.lit("statistics without quantiles"))))


def mean_over_batches(metrics: DataFrame, order: str, most: int, *columns: str) -> DataFrame:
    """Means over the first `most` batches in order: an evaluation that ends early by definition."""
    return metrics.orderBy(order).limit(most).agg(*(F.avg(c).alias(c) for c in columns))


def _literal(rows: np.ndarray) -> Column:
    return F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in rows))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def encode(v: Column, mean: np.ndarray, parts: np.ndarray, scales: np.ndarray) -> Column:
    """Scores of a vector on the components, in units of their scales."""
    centred = F.zip_with(v.cast("array<double>"), _literal(mean[None])[0], lambda a, b: a - b)
    return F.transform(_literal(parts / scales[:, None]), lambda p: _dot(centred, p))


def reconstruct(scores: Column, mean: np.ndarray, parts: np.ndarray, scales: np.ndarray) -> Column:
    back = F.transform(_literal((parts * scales[:, None]).T), lambda w: _dot(scores, w))
    return F.zip_with(back, _literal(mean[None])[0], lambda a, b: a + b)
