"""Statistics as expressions and aggregations; small exact tests as Arrow functions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.functions.draws import uniform, uniforms
from tessera.storage import materialize

from .windows import average_rank, with_q_values


def _grouped(df: DataFrame, by: list[str]):
    return df.groupBy(*by) if by else df.groupBy()


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over rows that have both; null if either does not vary."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Correlation of average ranks by group; rows with a null in either are left out."""
    full = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = full.withColumn("_rx", average_rank(x, by)).withColumn("_ry", average_rank(y, by))
    return _grouped(ranked, by).agg(correlation("_rx", "_ry").alias("spearman_rho"), F.count("*").alias("n"))


def _sq(c: Column) -> Column:
    return c * c


def metrics_vs_zero(df: DataFrame, y: str, yhat: str, by: list[str], sign_threshold: float = 1.0) -> DataFrame:
    """R2 against a prediction of 0, mean absolute error, Pearson, sign accuracy where |y| exceeds the threshold.

    Correlation and sign need three rows and a prediction that varies; R2 and the error do not."""
    a, b = F.col(y), F.col(yhat)
    big = F.abs(a) > sign_threshold
    out = _grouped(df, by).agg(
        F.count("*").alias("n"),
        (1 - F.try_divide(F.sum(_sq(a - b)), F.sum(_sq(a)))).alias("r2"),
        F.avg(F.abs(a - b)).alias("mae"),
        correlation(y, yhat).alias("pearson_r"),
        F.count_if(big).alias("n_sign_evaluated"),
        F.avg(F.when(big, (F.signum(a) == F.signum(b)).cast("double"))).alias("sign_accuracy"),
        F.stddev_pop(b).alias("_sd"),
    )
    return out.withColumns({c: F.when((F.col("n") >= 3) & (F.col("_sd") > 0), F.col(c)) for c in ("pearson_r", "sign_accuracy")}).drop("_sd")


def metrics_vs_mean(df: DataFrame, y: str, yhat: str, by: list[str]) -> DataFrame:
    """R2 against the mean of the observations, mean absolute error and Pearson."""
    a, b = F.col(y), F.col(yhat)
    return _grouped(df, by).agg(F.count("*").alias("n"), (1 - F.try_divide(F.sum(_sq(a - b)), F.var_pop(a) * F.count("*"))).alias("r2"), F.avg(F.abs(a - b)).alias("mae"), correlation(y, yhat).alias("pearson_r"))


def identity_metrics(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """How well y repeats x: R2 of y = x, of a free line, its slope, and how often the sign agrees."""
    a, b = F.col(x), F.col(y)
    return _grouped(df, by).agg(
        F.count("*").alias("n"),
        (1 - F.try_divide(F.sum(_sq(b - a)), F.var_pop(b) * F.count("*"))).alias("r2_identity"),
        _sq(correlation(a, b)).alias("r2_linear"),
        F.regr_slope(b, a).alias("slope"),
        F.avg(((a > 0) == (b > 0)).cast("double")).alias("winner_agreement"),
    )


def r2_vs_zero(y: Column, yhat: Column) -> Column:
    return 1 - F.try_divide(F.sum(_sq(y - yhat)), F.sum(_sq(y)))


def histogram(df: DataFrame, value: str, *, low: float, high: float | Column, bins: int, by: list[str] | None = None) -> DataFrame:
    """(bin from 0, n) over [low, high] in ``bins`` equal bins, the last one closed; values outside are left out."""
    top = F.lit(high) if not isinstance(high, Column) else high
    x = F.col(value)
    k = F.least(F.floor((x - low) / (top - low) * bins).cast("int"), F.lit(bins - 1))
    inside = df.filter((x >= low) & (x <= top))
    return inside.groupBy(*(by or []), k.alias("bin")).agg(F.count("*").alias("n"))


def valley_threshold(df: DataFrame, value: str, *, lo: float, hi: float, edges: int = 81, empty_frac: float = 0.02, top: float | None = None, fallback: float | None = None) -> float | None:
    """Centre of the emptiest band of a histogram between ``lo`` and ``hi``.

    Bins reach from 0 to ``top``, or to the largest value if that exceeds 0.4.  A bin is
    empty at no more than the larger of 1 and ``empty_frac`` of the fullest.  Without
    such a bin: ``fallback``, or the median of the values.  Rounded half-even to three
    places.  The histogram is aggregated; at most ``edges`` rows reach the driver."""
    x = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(value).cast("double").alias("x"))
    if top is None:
        largest = x.agg(F.max("x")).first()[0]
        if largest is None:
            return None
        top = max(0.4, largest)
    grid = np.linspace(0, top, edges)
    counts = np.zeros(edges - 1)
    for k, n in histogram(x, "x", low=0.0, high=float(top), bins=edges - 1).collect():
        counts[k] = n
    centres = 0.5 * (grid[:-1] + grid[1:])
    empty = (centres >= lo) & (centres <= hi) & (counts <= max(1, empty_frac * counts.max(initial=0)))
    if empty.any():
        return round(float(np.median(centres[empty])), 3)
    return fallback if fallback is not None else round(float(x.agg(F.median("x")).first()[0]), 3)


# ---- exact tests --------------------------------------------------------------------------


def _log_choose(n: int, k: np.ndarray) -> np.ndarray:
    table = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))
    return table[n] - table[k] - table[n - k]


def binomial_two_sided(k: int, n: int, p: float) -> float:
    """Two-sided exact binomial p-value: outcomes at most as likely as the observed one."""
    if n == 0 or p <= 0 or p >= 1:
        return 1.0 if n == 0 or (p <= 0 and k == 0) or (p >= 1 and k == n) else 0.0
    i = np.arange(n + 1)
    logs = _log_choose(n, i) + i * math.log(p) + (n - i) * math.log1p(-p)
    return float(min(1.0, np.exp(logs[logs <= logs[k] + 1e-7]).sum()))


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function by series or continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h, i = d, 0
    while True:
        i += 1
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15 or i > 10_000:
            return min(1.0, scale * h)


def chi2_sf(x: float, df: float) -> float:
    """P(X > x) of the chi-squared distribution."""
    return _upper_gamma(df / 2, x / 2) if df > 0 else float("nan")


def wilcoxon_signed_rank(differences: np.ndarray) -> float:
    """Two-sided p: exact without ties and zeros up to 25 differences, else the normal approximation with tie correction."""
    d = np.asarray(differences, float)
    d = d[~np.isnan(d) & (d != 0)]
    n = len(d)
    if n == 0:
        return float("nan")
    size = np.abs(d)
    values, inverse, counts = np.unique(size, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    plus = ranks[d > 0].sum()
    if n <= 25 and (counts == 1).all():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        low = int(min(plus, n * (n + 1) / 2 - plus))
        return float(min(1.0, 2 * ways[: low + 1].sum() / 2**n))
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (counts**3 - counts).sum() / 48)
    return float(math.erfc(abs(plus - n * (n + 1) / 4) / spread / math.sqrt(2))) if spread else 1.0


def two_component_nnls(target: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """Non-negative weights of two components with the least squared residual, and its norm."""
    aa, bb, ab, at, bt = a @ a, b @ b, a @ b, a @ target, b @ target
    best = (0.0, 0.0)
    det = aa * bb - ab * ab
    options = [(max(0.0, at / aa) if aa else 0.0, 0.0), (0.0, max(0.0, bt / bb) if bb else 0.0)]
    if det > 1e-12 * max(aa * bb, 1e-300):
        u, v = (at * bb - bt * ab) / det, (bt * aa - at * ab) / det
        if u >= 0 and v >= 0:
            options = [(u, v)]
    best = min(options, key=lambda w: float(((target - w[0] * a - w[1] * b) ** 2).sum()))
    return best[0], best[1], float(np.sqrt(((target - best[0] * a - best[1] * b) ** 2).sum()))


@F.pandas_udf(DoubleType())
def chi2_sf_udf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(a, b) if a == a and b == b else None for a, b in zip(x, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def binomial_udf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binomial_two_sided(int(a), int(b), float(c)) for a, b, c in zip(k, n, p, strict=True)], dtype="float64")


def overdispersion(df: DataFrame, key: str, event: Column) -> DataFrame:
    """By value of a factor: k of n events against the overall rate, exact p and q-value."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(event).alias("k"))
    every = Window.partitionBy(F.lit(1))  # one row for each level of the factor
    p = F.sum("k").over(every) / F.sum("n").over(every)
    rated = counts.withColumn("p0", p).withColumn("rate", F.col("k") / F.col("n"))
    tested = rated.withColumn("p_value", binomial_udf(F.col("k"), F.col("n"), F.col("p0"))).withColumn("_all", F.lit(1))
    return with_q_values(tested, "p_value", ["_all"], name="q_value").drop("_all")


def dispersion(df: DataFrame, key: str, event: Column) -> DataFrame:
    """One row: chi-squared of the rates by level against the overall rate, over its degrees of freedom."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(event).alias("k"))
    s = counts.agg(F.sum("k").alias("K"), F.sum("n").alias("N"), F.sum(_sq(F.col("k")) / F.col("n")).alias("S"), F.count("*").alias("levels"))
    p = F.col("K") / F.col("N")
    chi2 = F.try_divide(F.col("S") - 2 * p * F.col("K") + _sq(p) * F.col("N"), p * (1 - p))
    return s.select("levels", p.alias("rate"), chi2.alias("chi2"), F.try_divide(chi2, F.col("levels") - 1).alias("dispersion"))


def binomial_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """z of two shares under their pooled share; null where that is 0 or 1."""
    p = (k1 + k2) / (n1 + n2)
    return F.try_divide(k1 / n1 - k2 / n2, F.nullif(F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2)), F.lit(0.0)))


def bootstrap(df: DataFrame, *, unit: str, replicates: int, seed: int = 0) -> DataFrame:
    """``df`` once for each replicate with the Poisson(1) ``weight`` of its unit, rows of weight 0 left out.

    Weights come from a hash of replicate and unit, so they are the same on any
    partitioning; aggregates have to be weighted by them."""
    below = [(F.col("_u") >= float(c)).cast("int") for c in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])]
    every = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_u", uniform(seed, "replicate", unit))
    return every.withColumn("weight", sum(below[1:], below[0])).drop("_u").filter("weight > 0")


def bootstrap_means(df: DataFrame, *, unit: str, value: str, by: str, replicates: int, seed: int = 0) -> DataFrame:
    """(by, replicate, m): the weighted means of :func:`bootstrap` by group, without a row for each draw.

    A group's rows come together, and weights are drawn for whole batches of them; a missing value counts as its weight only."""
    limits = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    rows = df.groupBy(by, unit).agg(F.coalesce(F.sum(value).cast("double"), F.lit(0.0)).alias("_x"), F.count("*").alias("_n"), F.count(value).alias("_m"))
    rows = rows.select(by, F.coalesce(F.col(unit).cast("string"), F.lit("")).alias("_k"), "_x", "_n", "_m").repartition(by).sortWithinPartitions(by)
    kind = dict(df.dtypes)[by]

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the group that may go on in the next batch: its value and sums

        def finished(keys: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
            at, r = np.nonzero(sums[1] > 0)
            m = np.where(sums[2][at, r] > 0, sums[0][at, r] / sums[1][at, r], np.nan)
            return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array((r + 1).astype(np.int32)), pa.array(m, from_pandas=True)], names=[by, "replicate", "m"])

        for whole in batches:
            for lo in range(0, whole.num_rows, 8192):
                batch = whole.slice(lo, 8192)
                keys = batch.column(0)
                codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                codes = np.where(np.isnan(codes.astype(float)), -1, codes)
                starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
                weights = np.searchsorted(limits, uniforms(seed, 1, replicates, batch.column(1).to_pylist()), side="right").T.astype(float)
                columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(float)[:, None] for i in (2, 3, 4)]
                sums = np.stack([np.add.reduceat(weights * c, starts, axis=0) for c in columns])
                firsts = keys.take(pa.array(starts))
                if held is not None and held[0][0].as_py() == firsts[0].as_py():
                    sums[:, 0] += held[1][:, 0]
                elif held is not None:
                    yield finished(*held)
                if len(starts) > 1:
                    yield finished(firsts[:-1], sums[:, :-1])
                held = firsts[-1:], sums[:, -1:]
        if held is not None:
            yield finished(*held)

    return rows.mapInArrow(means, f"`{by}` {kind}, replicate int, m double")


def percentile_interval(df: DataFrame, value: str, by: list[str], level: float = 0.95) -> DataFrame:
    lo, hi = (1 - level) / 2, (1 + level) / 2
    return _grouped(df, by).agg(F.percentile(value, F.lit(lo)).alias("ci_low"), F.percentile(value, F.lit(hi)).alias("ci_high"))


def coin_flips(edges: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """Null outcomes: every edge once for each replicate, its winner drawn by a hash of both."""
    flip = uniform(seed, "replicate", "strain_a", "strain_b") < 0.5
    return edges.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("a_wins", flip)


def coin_shares(edges: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """(replicate, share): how many of the edges ``strain_a`` wins by :func:`coin_flips`, without a row for each flip."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("strain_a", "strain_b")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, wins = 0, np.zeros(replicates, np.int64)
        for batch in batches:
            n += batch.num_rows
            wins += (uniforms(seed, 1, replicates, batch.column(0).to_pylist()) < 0.5).sum(axis=1)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, replicates + 1, dtype=np.int32)), pa.array(wins), pa.array(np.full(replicates, n))], names=["replicate", "wins", "n"])

    counts = edges.select(key.alias("k")).mapInArrow(count, "replicate int, wins long, n long")
    return counts.groupBy("replicate").agg((F.sum("wins") / F.sum("n")).alias("share"))


def permutation_p(nulls: DataFrame, value: str, observed: float, *, upper: bool = True, plus_one: bool = True) -> DataFrame:
    """One row: share of null values at least (at most) as extreme; (k + 1) / (n + 1) or, without ``plus_one``, k / n."""
    extreme = F.col(value) >= observed if upper else F.col(value) <= observed
    add = 1 if plus_one else 0
    return nulls.agg(((F.count_if(extreme) + add) / (F.count("*") + add)).alias("p_value"), F.avg(value).alias("null_mean"), F.stddev_pop(value).alias("null_sd"), F.count("*").alias("n"))


def permuted_labels(df: DataFrame, *, key: str, label: str, replicates: int, seed: int = 0, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(replicate, by, key, label): labels dealt anew among the keys of each group of ``by``, for each replicate, by hash order."""
    draw = uniform(seed, "replicate", key)
    every = df.select(*by, key, label).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    place = F.row_number().over(Window.partitionBy("replicate", *by).orderBy(key))
    dealt = F.row_number().over(Window.partitionBy("replicate", *by).orderBy(draw, key))
    labels = every.select("replicate", *by, F.col(label), place.alias("_n"))
    return every.select("replicate", *by, key, dealt.alias("_n")).join(labels, ["replicate", *by, "_n"]).drop("_n")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with its place (from 0) in the order of the columns ``order``: ranges are sorted on their own and counted, no task gets all rows."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    rows = materialize(rows.withColumn("_within", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = rows.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    placed = rows.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_within", "_before")


def repeated_draws(df: DataFrame, *, key: str, replicates: int, seed: int = 0) -> DataFrame:
    """``df`` once for each ``replicate`` from 1, with the ``draw`` of seed, replicate and ``key``, a column of texts."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 8192):
                batch = whole.slice(lo, 8192)
                drawn = uniforms(seed, 1, replicates, [k or "" for k in batch.column(key).to_pylist()])
                for r in range(replicates):
                    columns = [*batch.columns, pa.array(np.full(batch.num_rows, r + 1, np.int32)), pa.array(drawn[r])]
                    yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "replicate", "draw"])

    return df.mapInArrow(draw, f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, replicate int, draw double")


def split_half(df: DataFrame, *, unit: str, order: str, value: str) -> DataFrame:
    """(unit, first, rest): the first value of each unit and the mean of the others, for units with two or more."""
    w = Window.partitionBy(unit).orderBy(order)
    placed = df.withColumn("_n", F.row_number().over(w))
    out = placed.groupBy(unit).agg(F.max(F.when(F.col("_n") == 1, F.col(value))).alias("first"), F.avg(F.when(F.col("_n") > 1, F.col(value))).alias("rest"))
    return out.filter("rest IS NOT NULL")


def spearman_brown(r: Column, k: Column | float) -> Column:
    """Reliability of the mean of k replicates from that of one."""
    return F.try_divide(k * r, 1 + (k - 1) * r)


def noise_ceiling(pair_var: Column, noise_var: Column, n: Column) -> Column:
    """Largest R2 that a model of the mean of n noisy replicates can reach."""
    return 1 - F.try_divide(noise_var / n, pair_var)
