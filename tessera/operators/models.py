"""Models of pair outcomes: strengths, ridge, two-stage and boosted trees, evaluated over folds.

Strains are few hundred and a fit is small, so the work is spread over folds and
models: one group of ``applyInPandas`` holds one fold.  Everything that is fitted,
scaling and components included, sees the training pairs of its fold only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.draws import uniform
from tessera.storage import bounded_batches, materialize, remove

from .graph import connected_components

# ---- plain numerics -----------------------------------------------------------------------


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of least squares with an L2 penalty on the coefficients; solved in the smaller dimension."""
    mx, my = x.mean(axis=0), y.mean()
    xc, yc = x - mx, y - my
    n, d = xc.shape
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(d), xc.T @ yc) if d <= n else xc.T @ np.linalg.solve(xc @ xc.T + alpha * np.eye(n), yc)
    return w, float(my - mx @ w)


def standardise(z: np.ndarray, train: np.ndarray) -> np.ndarray:
    """Columns less the training mean over the training population deviation; constant columns only centred."""
    sd = z[train].std(axis=0)
    return (z - z[train].mean(axis=0)) / np.where(sd > 0, sd, 1.0)


def components(x: np.ndarray, train: np.ndarray, k: int) -> np.ndarray:
    """Scores of all rows on the first principal components of the training rows."""
    mean = x[train].mean(axis=0)
    k = max(1, min(k, len(train) - 1, x.shape[1]))
    _, _, vt = np.linalg.svd(x[train] - mean, full_matrices=False)
    signs = np.sign(vt[np.arange(len(vt[:k])), np.abs(vt[:k]).argmax(axis=1)])
    return (x - mean) @ (vt[:k] * np.where(signs == 0, 1, signs)[:, None]).T


def additive_strength(a: np.ndarray, b: np.ndarray, y: np.ndarray, n: int, *, penalty: float = 1.0) -> np.ndarray:
    """Strengths s with y ~ s[a] - s[b], sum close to 0, ridge penalty: normal equations of the design and a row of ones."""
    m = penalty * np.eye(n) + np.ones((n, n))
    r = np.zeros(n)
    np.add.at(m, (a, a), 1)
    np.add.at(m, (b, b), 1)
    np.add.at(m, (a, b), -1)
    np.add.at(m, (b, a), -1)
    np.add.at(r, a, y)
    np.add.at(r, b, -y)
    return np.linalg.solve(m, r)


def additive_yield(a: np.ndarray, b: np.ndarray, y: np.ndarray, n: int, *, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """(c, mean) with y - mean ~ c[a] + c[b] and a ridge penalty."""
    mean = float(y.mean())
    m, r = penalty * np.eye(n), np.zeros(n)
    for i, j in ((a, a), (b, b), (a, b), (b, a)):
        np.add.at(m, (i, j), 1)
    np.add.at(r, a, y - mean)
    np.add.at(r, b, y - mean)
    return np.linalg.solve(m, r), mean


def bradley_terry(a: np.ndarray, b: np.ndarray, wins_a: np.ndarray, wins_b: np.ndarray, n: int, *, steps: int = 100, errors: bool = True) -> dict:
    """Maximum likelihood strengths with strength 0 for strain 0: iteratively reweighted least squares.

    Returns strengths, standard errors (nan for the baseline), deviance, null deviance,
    residual degrees of freedom and the pseudo-R2.  A tiny ridge keeps separated data finite."""
    total = wins_a + wins_b
    s = np.zeros(n)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(s[a] - s[b])))
        w = np.maximum(total * p * (1 - p), 1e-12)
        grad, m = np.zeros(n), np.zeros((n, n))
        np.add.at(grad, a, wins_a - total * p)
        np.add.at(grad, b, -(wins_a - total * p))
        for i, j, v in ((a, a, w), (b, b, w), (a, b, -w), (b, a, -w)):
            np.add.at(m, (i, j), v)
        step = np.linalg.solve(m[1:, 1:] + 1e-9 * np.eye(n - 1), grad[1:]) if n > 1 else np.zeros(0)
        s[1:] += np.clip(step, -5, 5)
        if np.abs(step).max(initial=0) < 1e-10:
            break

    def deviance(p: np.ndarray) -> float:
        with np.errstate(divide="ignore", invalid="ignore"):
            x = np.where(wins_a > 0, wins_a * np.log(wins_a / (total * p)), 0.0) + np.where(wins_b > 0, wins_b * np.log(wins_b / (total * (1 - p))), 0.0)
        return float(2 * x.sum())

    p = 1 / (1 + np.exp(-(s[a] - s[b])))
    se = np.full(n, np.nan)
    if n > 1 and errors:
        se[1:] = np.sqrt(np.maximum(np.diag(np.linalg.pinv(m[1:, 1:])), 0))
    # the null model knows one share for all pairs
    dev, null = deviance(p), deviance(np.full(len(a), max(1e-12, min(1 - 1e-12, wins_a.sum() / max(total.sum(), 1)))))
    return {"strength": s, "se": se, "deviance": dev, "null_deviance": null, "df_resid": len(a) - (n - 1), "pseudo_r2": 1 - dev / null if null else float("nan")}


def boosted_trees(x: np.ndarray, y: np.ndarray, x_new: np.ndarray, *, trees: int = 100, depth: int = 3, rate: float = 0.1, least: int = 5, bins: int = 32) -> np.ndarray:
    """Predictions of gradient-boosted regression trees over quantile-binned features."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    bin_of = lambda m: np.stack([np.searchsorted(e, c, "right") for e, c in zip(edges, m.T, strict=True)], axis=1)
    xb, nb = bin_of(x), bin_of(x_new)
    base = float(y.mean())
    fit, out = np.full(len(y), base), np.full(len(x_new), base)

    def grow(rows: np.ndarray, new: np.ndarray, left: int, residual: np.ndarray) -> None:
        value = residual[rows].mean() if len(rows) else 0.0
        best = (1e-12, -1, -1)
        if left and len(rows) >= 2 * least:
            total, n = residual[rows].sum(), len(rows)
            for f in range(x.shape[1]):
                count = np.bincount(xb[rows, f], minlength=bins + 1)
                sums = np.bincount(xb[rows, f], residual[rows], minlength=bins + 1)
                nl, sl = np.cumsum(count)[:-1], np.cumsum(sums)[:-1]
                ok = (nl >= least) & (n - nl >= least)
                if ok.any():
                    gain = np.where(ok, sl**2 / np.maximum(nl, 1) + (total - sl) ** 2 / np.maximum(n - nl, 1) - total**2 / n, -np.inf)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
        if best[1] < 0:
            fit[rows] += rate * value
            out[new] += rate * value
            return
        _, f, k = best
        for side in (True, False):
            grow(rows[(xb[rows, f] <= k) == side], new[(nb[new, f] <= k) == side], left - 1, residual)

    for _ in range(trees):
        grow(np.arange(len(y)), np.arange(len(x_new)), depth, y - fit)
    return out


# ---- one fold -----------------------------------------------------------------------------


@dataclass
class Fold:
    """Pairs of one fold as positions of strains; ``features`` and ``totals`` are rows by strain.

    ``distances``: strain by strain, for controls that know taxonomy only."""

    a: np.ndarray
    b: np.ndarray
    y: np.ndarray
    train: np.ndarray
    test: np.ndarray
    features: np.ndarray
    totals: np.ndarray
    symmetric: np.ndarray
    distances: np.ndarray | None = None
    n_components: int = 20
    units: np.ndarray | None = None
    cache: dict = field(default_factory=dict)

    @property
    def train_strains(self) -> np.ndarray:
        return np.unique(np.concatenate((self.a[self.train], self.b[self.train])))

    def reduced(self, source: str = "features") -> np.ndarray:
        """Scaled components of features, or of distances to the training strains."""
        if source not in self.cache:
            x = self.features if source == "features" else self.distances[:, self.train_strains]
            self.cache[source] = standardise(components(x, self.train_strains, self.n_components), self.train_strains)
        return self.cache[source]

    def design(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both orientations: differences, sums, symmetric covariates, differences of totals."""
        t = standardise(self.totals, self.train_strains)
        rows = lambda p, q: np.hstack((z[p] - z[q], z[p] + z[q], self.symmetric, t[p] - t[q]))
        return rows(self.a, self.b), rows(self.b, self.a)

    def symmetric_design(self, z: np.ndarray) -> np.ndarray:
        t = standardise(self.totals, self.train_strains)
        return np.hstack((z[self.a] + z[self.b], np.abs(z[self.a] - z[self.b]), t[self.a] + t[self.b], np.abs(t[self.a] - t[self.b]), self.symmetric))

    def antisymmetric(self, z: np.ndarray, predict: Callable) -> np.ndarray:
        """(f(a, b) - f(b, a)) / 2 of a learner trained on both orientations."""
        fwd, rev = self.design(z)
        x, y = np.vstack((fwd[self.train], rev[self.train])), np.concatenate((self.y[self.train], -self.y[self.train]))
        both = predict(x, y, np.vstack((fwd[self.test], rev[self.test])))
        n = len(self.test)
        return (both[:n] - both[n:]) / 2

    def strengths(self) -> tuple[np.ndarray, np.ndarray]:
        """(training strains, their strengths from training pairs)."""
        strains = self.train_strains
        at = np.searchsorted(strains, self.a[self.train]), np.searchsorted(strains, self.b[self.train])
        return strains, additive_strength(*at, self.y[self.train], len(strains))


def _ridge_predict(alpha: float) -> Callable:
    def predict(x, y, x_new):
        w, c = ridge(x, y, alpha)
        return x_new @ w + c

    return predict


def _two_stage(fold: Fold, z: np.ndarray, predict: Callable) -> np.ndarray:
    """Strength of a strain from its features, then the difference of both strengths."""
    strains, s = fold.strengths()
    every = predict(z[strains], s, z)
    return every[fold.a[fold.test]] - every[fold.b[fold.test]]


def _observed(fold: Fold) -> np.ndarray:
    strains, s = fold.strengths()
    every = np.zeros(len(fold.features))
    every[strains] = s
    return every[fold.a[fold.test]] - every[fold.b[fold.test]]


def _clone_lookup(fold: Fold) -> np.ndarray:
    """Mean strength of the training strains of a strain's genome unit (without units: of the same features); 0 for a unit never seen."""
    strains, s = fold.strengths()
    unit = [f.tobytes() for f in fold.features] if fold.units is None else list(fold.units)
    groups: dict = {}
    for k, v in zip(strains, s, strict=True):
        groups.setdefault(unit[k], []).append(v)
    every = np.array([np.mean(groups.get(u, [0.0])) for u in unit])
    return every[fold.a[fold.test]] - every[fold.b[fold.test]]


#: Models of antisymmetric outcomes by name.
MODELS: dict[str, Callable[[Fold], np.ndarray]] = {
    "zero": lambda f: np.zeros(len(f.test)),
    "strength_observed": _observed,
    "clone_lookup": _clone_lookup,
    "ridge": lambda f: f.antisymmetric(f.reduced(), _ridge_predict(100.0)),
    "ridge_16s": lambda f: f.antisymmetric(f.reduced("distances"), _ridge_predict(100.0)),
    "boosted": lambda f: f.antisymmetric(f.reduced(), boosted_trees),
    "boosted_raw": lambda f: f.antisymmetric(f.features, boosted_trees),
    "two_stage_ridge": lambda f: _two_stage(f, f.reduced(), _ridge_predict(50.0)),
    "two_stage_ridge_16s": lambda f: _two_stage(f, f.reduced("distances"), _ridge_predict(50.0)),
    "two_stage_ridge_both": lambda f: _two_stage(f, np.hstack((f.reduced(), f.reduced("distances"))), _ridge_predict(50.0)),
    "two_stage_boosted": lambda f: _two_stage(f, f.reduced(), lambda x, y, n: boosted_trees(x, y, n, trees=60, depth=2)),
}


def _yield_additive(f: Fold) -> np.ndarray:
    strains = f.train_strains
    c, mean = additive_yield(np.searchsorted(strains, f.a[f.train]), np.searchsorted(strains, f.b[f.train]), f.y[f.train], len(strains))
    every = np.zeros(len(f.features))
    every[strains] = c
    return mean + every[f.a[f.test]] + every[f.b[f.test]]


def _yield_model(z: Callable, predict: Callable) -> Callable:
    def run(f: Fold) -> np.ndarray:
        x = f.symmetric_design(z(f))
        return predict(x[f.train], f.y[f.train], x[f.test])

    return run


def _yield_two_stage(f: Fold) -> np.ndarray:
    strains, z = f.train_strains, f.reduced()
    c, mean = additive_yield(np.searchsorted(strains, f.a[f.train]), np.searchsorted(strains, f.b[f.train]), f.y[f.train], len(strains))
    every = _ridge_predict(50.0)(z[strains], c, z)
    return mean + every[f.a[f.test]] + every[f.b[f.test]]


#: Models of symmetric outcomes by name.
YIELD_MODELS: dict[str, Callable[[Fold], np.ndarray]] = {
    "mean": lambda f: np.full(len(f.test), f.y[f.train].mean()),
    "additive": _yield_additive,
    "ridge": _yield_model(lambda f: f.reduced(), _ridge_predict(50.0)),
    "ridge_16s": _yield_model(lambda f: f.reduced("distances"), _ridge_predict(50.0)),
    "boosted": _yield_model(lambda f: f.reduced(), boosted_trees),
    "boosted_raw": _yield_model(lambda f: f.features, boosted_trees),
    "two_stage_ridge": _yield_two_stage,
}


# ---- over folds ---------------------------------------------------------------------------


def cross_validate(
    roles: DataFrame,
    pairs: DataFrame,
    features: pd.DataFrame,
    *,
    target: str,
    models: dict[str, Callable[[Fold], np.ndarray]] | None = None,
    covariates: tuple[str, ...] = (),
    distances: pd.DataFrame | None = None,
    n_components: int = 20,
    units: dict | None = None,
    shuffled: bool = False,
    seed: int = 0,
) -> DataFrame:
    """(rep, fold, model, strain_a, strain_b, y_true, y_pred) over all folds and models.

    ``roles``: (rep, fold, strain_a, strain_b, role).  ``features`` and ``distances`` are indexed by
    strain: a dimension that every task gets.  Pairs with a strain outside it, or
    without the target, are left out.  ``units`` names the genome unit of strains.  ``shuffled`` permutes the training labels of each
    fold, a control that should predict nothing.  A task holds one fold, unless every model is one of SCORED and
    the largest fold has over FOLD_PAIRS pairs: then :func:`scored_folds` finds the same predictions, with no fold in one place."""
    chosen = models or MODELS
    if not shuffled and all(k in SCORED and MODELS[k] is f for k, f in chosen.items()):
        most = roles.groupBy("rep", "fold").count().agg(F.max("count")).first()[0]
        if most and most > FOLD_PAIRS:
            return scored_folds(roles, pairs, features, target=target, models=list(chosen), n_components=n_components)
    strains = features.index.to_numpy()
    matrix, at = features.to_numpy(float), {s: i for i, s in enumerate(strains)}
    unit_of = None if units is None else np.array([str(units.get(s, s)) for s in strains])
    far = None if distances is None else distances.loc[strains, strains].to_numpy(float)
    rows = roles.join(pairs.select("strain_a", "strain_b", F.col(target).cast("double").alias("_y"), *covariates), ["strain_a", "strain_b"]).filter("_y IS NOT NULL")
    kind = dict(roles.dtypes)["strain_a"]
    schema = f"rep int, fold int, model string, strain_a {kind}, strain_b {kind}, y_true double, y_pred double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["strain_a"].isin(at) & pdf["strain_b"].isin(at)].sort_values(["strain_a", "strain_b"])
        role = pdf["role"].to_numpy()
        train, test = np.flatnonzero(role == "train"), np.flatnonzero(role == "test")
        out = []
        if len(train) >= 3 and len(test):
            y = pdf["_y"].to_numpy(float)
            if shuffled:
                y = y.copy()
                y[train] = np.random.default_rng([seed, int(pdf["rep"].iloc[0]), int(pdf["fold"].iloc[0])]).permutation(y[train])
            sym = pdf[list(covariates)].to_numpy(float).reshape(len(pdf), len(covariates))
            fold = Fold(pdf["strain_a"].map(at).to_numpy(), pdf["strain_b"].map(at).to_numpy(), y, train, test, matrix, matrix.sum(axis=1, keepdims=True), np.nan_to_num(sym), far, n_components, unit_of)
            for name, model in chosen.items():
                out.append(pd.DataFrame({"rep": pdf["rep"].iloc[0], "fold": pdf["fold"].iloc[0], "model": name, "strain_a": pdf["strain_a"].to_numpy()[test], "strain_b": pdf["strain_b"].to_numpy()[test], "y_true": y[test], "y_pred": model(fold)}))
        return pd.concat(out) if out else pd.DataFrame(columns=[f.split(" ")[0] for f in schema.split(", ")])

    return rows.groupBy("rep", "fold").applyInPandas(run, schema)


#: Models that predict the difference of a score of either strain, found from sums over the training pairs (a ridge of both orientations, too:
#: what is the same for both gets no weight).
SCORED = ("zero", "strength_observed", "ridge", "two_stage_ridge")
#: Pairs of a fold up to which one task holds it.
FOLD_PAIRS = 2_000_000


def scored_folds(roles: DataFrame, pairs: DataFrame, features: pd.DataFrame, *, target: str, models: list[str], n_components: int = 20) -> DataFrame:
    """As :func:`cross_validate`, for models of SCORED and any number of pairs.

    Strengths are solved by conjugate gradients on the driver, whose vectors are as long as the strains; each step
    is one pass over the training pairs of all folds.  Sums of strengths are zero, as right-hand sides have sum zero,
    so the row of ones of :func:`additive_strength` changes nothing."""
    spark = roles.sparkSession
    strains, matrix = features.index.to_numpy(), features.to_numpy(float)
    n, kind = len(strains), dict(roles.dtypes)["strain_a"]
    table = spark.createDataFrame(pd.DataFrame({"s": strains, "i": np.arange(n, dtype=np.int32)}), f"s {kind}, i int")
    at = lambda c, name: table.select(F.col("s").alias(c), F.col("i").alias(name))
    rows = roles.join(pairs.select("strain_a", "strain_b", F.col(target).cast("double").alias("y")), ["strain_a", "strain_b"]).filter("y IS NOT NULL")
    rows = materialize(rows.join(at("strain_a", "a"), "strain_a").join(at("strain_b", "b"), "strain_b").select("rep", "fold", "role", "strain_a", "strain_b", "a", "b", "y"), "roles")
    counts = rows.groupBy("rep", "fold").agg(F.count_if(F.col("role") == "train").alias("train"), F.count_if(F.col("role") == "test").alias("test")).filter("train >= 3 AND test > 0")
    keys = sorted((r["rep"], r["fold"]) for r in counts.collect())
    number = {k: i for i, k in enumerate(keys)}
    train = rows.filter("role = 'train'").select("rep", "fold", "a", "b", "y")

    def summed(work: Callable, shape: tuple) -> np.ndarray:
        """(folds, *shape): sums of ``work(a, b, y, k)`` over batches of training pairs of fold k."""

        def run(batches):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                rep, fold, a, b, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
                for key in set(zip(rep.tolist(), fold.tolist(), strict=True)) & set(number):
                    own, k = (rep == key[0]) & (fold == key[1]), number[key]
                    got = work(a[own], b[own], y[own], k)
                    total[k] = total[k] + got if k in total else got
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["k", "v"])

        out = np.zeros((len(keys), *shape))
        for r in train.mapInArrow(run, "k int, v binary").toLocalIterator():
            out[r["k"]] += np.frombuffer(r["v"]).reshape(shape)
        return out

    ends = lambda a, b, x, y: np.bincount(a, x, n) + np.bincount(b, y, n)
    first = summed(lambda a, b, y, k: np.stack((ends(a, b, y, -y), ends(a, b, None, None))), (2, n))
    right, degree = first[:, 0], first[:, 1]
    strength = np.zeros((len(keys), n))
    if {"strength_observed", "two_stage_ridge"} & set(models):
        left, diagonal = right.copy(), degree + 1.0
        z = left / diagonal
        d, lz, goal = z.copy(), (left * z).sum(axis=1), 1e-13 * np.abs(right).max(axis=1, initial=0)
        for _ in range(2 * n + 50):
            if (np.abs(left).max(axis=1, initial=0) <= goal).all():
                break
            q = diagonal * d - summed(lambda a, b, y, k, d=d: ends(a, b, d[k][b], d[k][a]), (n,))
            dq = (d * q).sum(axis=1)
            step = np.divide(lz, dq, out=np.zeros_like(lz), where=dq > 0)[:, None]
            strength += step * d
            left -= step * q
            z = left / diagonal
            lz, before = (left * z).sum(axis=1), lz
            d = z + np.divide(lz, before, out=np.zeros_like(lz), where=before > 0)[:, None] * d
    reduced, seen = [], [np.flatnonzero(x > 0) for x in degree]
    if {"ridge", "two_stage_ridge"} & set(models):
        reduced = [standardise(components(matrix, own, n_components), own) for own in seen]
    gram = []
    if "ridge" in models:
        sides = [np.hstack((z, standardise(matrix.sum(axis=1, keepdims=True), own))) for z, own in zip(reduced, seen, strict=True)]
        width = max((x.shape[1] for x in sides), default=0)

        def products(a, b, y, k):
            x, out = sides[k][a] - sides[k][b], np.zeros((width, width))
            out[: x.shape[1], : x.shape[1]] = x.T @ x
            return out

        gram = summed(products, (width, width))
    every = []
    for k, key in enumerate(keys):
        score = {"zero": np.zeros(n), "strength_observed": np.where(degree[k] > 0, strength[k], 0.0)}
        if "ridge" in models:
            x = sides[k]
            m = x.shape[1]
            score["ridge"] = x @ np.linalg.solve(2 * gram[k][:m, :m] + 100.0 * np.eye(m), 2 * x.T @ right[k])
        if "two_stage_ridge" in models:
            w, c = ridge(reduced[k][seen[k]], strength[k][seen[k]], 50.0)
            score["two_stage_ridge"] = reduced[k] @ w + c
        every.append(pd.DataFrame({"rep": np.int32(key[0]), "fold": np.int32(key[1]), "i": np.arange(n, dtype=np.int32)} | {m: score[m] for m in models}))
    scores = spark.createDataFrame(pd.concat(every), "rep int, fold int, i int, " + ", ".join(f"{m} double" for m in models)) if every else spark.createDataFrame([], "rep int, fold int, i int, " + ", ".join(f"{m} double" for m in models))
    side = lambda c: scores.select("rep", "fold", F.col("i").alias(c), F.array(*models).alias(f"_{c}"))
    both = rows.filter("role = 'test'").join(side("a"), ["rep", "fold", "a"]).join(side("b"), ["rep", "fold", "b"])
    differ = F.zip_with("_a", "_b", lambda x, y: x - y)
    named = both.withColumn("_p", F.explode(F.arrays_zip(F.array(*map(F.lit, models)).alias("model"), differ.alias("y_pred"))))
    return named.select(F.col("rep").cast("int").alias("rep"), F.col("fold").cast("int").alias("fold"), F.col("_p.model").alias("model"), "strain_a", "strain_b", F.col("y").alias("y_true"), F.col("_p.y_pred").alias("y_pred"))


def fold_scores(predictions: DataFrame, *, symmetric: bool = False, by: tuple[str, ...] = ("rep", "fold", "model")) -> DataFrame:
    """Metrics of each fold and model, Spearman included."""
    from .stats import metrics_vs_mean, metrics_vs_zero, spearman

    score = metrics_vs_mean if symmetric else metrics_vs_zero
    rho = spearman(predictions, "y_true", "y_pred", list(by)).drop("n")
    return score(predictions, "y_true", "y_pred", list(by)).join(rho, list(by))


#: Strains of one component up to which a fit solves dense systems (a matrix of doubles then has 32 MB); larger ones are solved by conjugate gradients.
DENSE_STRAINS = 2_000
#: Steps of minorisation from equal strengths, which place components that no pair connects.
PLACING_STEPS = 120


def minorised(a: np.ndarray, b: np.ndarray, wins_a: np.ndarray, wins_b: np.ndarray, n: int) -> np.ndarray:
    """Log strengths after PLACING_STEPS steps of p = wins / sum(games / (p + p of the rival)) from p = 1, or once nothing moves; -inf without a win."""
    total = wins_a + wins_b
    wins = np.bincount(a, wins_a, n) + np.bincount(b, wins_b, n)
    p, scale = np.ones(n), 0.0
    for _ in range(PLACING_STEPS):
        share = total / (p[a] + p[b])
        new = wins / (np.bincount(a, share, n) + np.bincount(b, share, n))
        factor = new.max()
        moved = np.abs(new - p).max()
        p, scale = new / factor, scale + np.log(factor)
        if moved < 1e-15 * factor:
            break
        p = np.maximum(p, np.where(wins > 0, 1e-300, 0.0)) + np.where(wins > 0, 0.0, 1e-300)
    with np.errstate(divide="ignore"):
        return np.where(wins > 0, np.log(p), -np.inf) + scale


def _solve_laplacian(a: np.ndarray, b: np.ndarray, w: np.ndarray, right: np.ndarray) -> np.ndarray:
    """x with x[0] = 0 of the weighted Laplacian of edges (a, b, w) plus a ridge of 1e-9: conjugate gradients scaled by the diagonal."""
    n = len(right)
    diagonal = np.bincount(a, w, n) + np.bincount(b, w, n) + 1e-9
    x, r = np.zeros(n), right.copy()
    r[0] = 0
    z = r / diagonal
    d, rz, goal = z.copy(), float(r @ z), float(np.abs(r).max(initial=0)) * 1e-13
    for _ in range(2 * n + 50):
        if np.abs(r).max(initial=0) <= goal:
            break
        q = diagonal * d - np.bincount(a, w * d[b], n) - np.bincount(b, w * d[a], n)
        q[0] = 0
        step = rz / float(d @ q)
        x += step * d
        r -= step * q
        z = r / diagonal
        rz, before = float(r @ z), rz
        d = z + rz / before * d
    return x


def sparse_bradley_terry(a: np.ndarray, b: np.ndarray, wins_a: np.ndarray, wins_b: np.ndarray, n: int, *, steps: int = 100, errors: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(strengths, standard errors) as :func:`bradley_terry` finds them, with memory for the pairs only; ``errors`` takes a solution for each strain."""
    total = wins_a + wins_b
    s, w = np.zeros(n), np.zeros(len(a))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(s[a] - s[b])))
        w = np.maximum(total * p * (1 - p), 1e-12)
        left = wins_a - total * p
        step = np.clip(_solve_laplacian(a, b, w, np.bincount(a, left, n) - np.bincount(b, left, n)), -5, 5)
        s += step
        if np.abs(step).max(initial=0) < 1e-10:
            break
    se = np.full(n, np.nan)
    for k in range(1, n) if errors else ():
        unit = np.zeros(n)
        unit[k] = 1
        se[k] = np.sqrt(max(_solve_laplacian(a, b, w, unit)[k], 0.0))
    return s, se


def _fit_component(pdf: pd.DataFrame, errors: bool) -> pd.DataFrame:
    """Strengths of one component on the scale of :func:`minorised`; its sums are in the first row."""
    strains = np.unique(np.concatenate((pdf["strain_a"], pdf["strain_b"])))
    n = len(strains)
    a, b = np.searchsorted(strains, pdf["strain_a"]), np.searchsorted(strains, pdf["strain_b"])
    wins_a, wins_b = pdf["n_reads_a"].to_numpy(float), pdf["n_reads_b"].to_numpy(float)
    if n <= DENSE_STRAINS:
        fit = bradley_terry(a, b, wins_a, wins_b, n, errors=errors)
        s, se = fit["strength"], fit["se"]
    else:
        s, se = sparse_bradley_terry(a, b, wins_a, wins_b, n, errors=errors)
    placed = minorised(a, b, wins_a, wins_b, n)
    some = np.isfinite(placed)
    s = s + (placed[some].mean() - s[some].mean() if some.any() else 0.0)
    out = pd.DataFrame({"strain": strains, "s": s, "bt_se": se, "fitted": 0.0, "own": 0.0, "won": 0.0, "lost": 0.0, "n_pairs": 0})
    total, d = wins_a + wins_b, s[a] - s[b]
    log_p, log_q = -np.logaddexp(0, -d), -np.logaddexp(0, d)
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.where(wins_a > 0, wins_a * np.log(wins_a / total), 0.0) + np.where(wins_b > 0, wins_b * np.log(wins_b / total), 0.0)
    out.loc[0, ["fitted", "own", "won", "lost"]] = [(wins_a * log_p + wins_b * log_q).sum(), own.sum(), wins_a.sum(), wins_b.sum()]
    out.loc[0, "n_pairs"] = len(a)
    return out


#: Pairs of one component up to which a task fits it (about 200 bytes each); a larger one is fitted from sums over blocks of its pairs.
TASK_PAIRS = 1_000_000
#: Pairs of a block, numbers of a piece of a sum, and strains whose errors are solved for at once.
BLOCK_PAIRS, PIECE, ERRORS_AT_ONCE = 1 << 17, 1 << 14, 16


class PairBlocks:
    """Pairs of numbered strains, packed into rows of BLOCK_PAIRS; sums over all of them by strain, in vectors that the driver holds.

    A task holds one block and the sums it makes; these are added up piece by piece before the driver gets them."""

    def __init__(self, pairs: DataFrame, n: int):
        """``pairs``: a, b (from 0, below ``n``), n_reads_a, n_reads_b."""
        self.spark, self.n = pairs.sparkSession, n
        bounded_batches(self.spark)

        def pack(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            a, b, x, y = (c.to_numpy() for c in pa.Table.from_batches(rows).columns)
            kind = np.min_scalar_type(max(int(x.max()), int(y.max()), 0)) if min(x.min(), y.min()) >= 0 and x.dtype.kind == y.dtype.kind == "i" else np.dtype(float)
            columns = [a.astype(np.int32), b.astype(np.int32), x.astype(kind), y.astype(kind)]
            return pa.RecordBatch.from_arrays([*[pa.array([c.tobytes()]) for c in columns], pa.array([kind.str])], names=["a", "b", "x", "y", "kind"])

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, rows = [], 0
            for batch in batches:
                held.append(batch)
                rows += batch.num_rows
                if rows >= BLOCK_PAIRS:
                    yield pack(held)
                    held, rows = [], 0
            if rows:
                yield pack(held)

        self.table = materialize(pairs.select("a", "b", "n_reads_a", "n_reads_b").mapInArrow(packed, "a binary, b binary, x binary, y binary, kind string"), "blocks")

    def sums(self, work: Callable, k: int, **vectors: np.ndarray) -> np.ndarray:
        """k rows by strain: ``work(add, a, b, wins_a, wins_b, **vectors)`` calls ``add(row, strains, values)`` for each block."""
        size, given = k * self.n, self.spark.sparkContext.broadcast(vectors)
        n = self.n

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((k, n))

            def add(row: int, strains: np.ndarray, values: np.ndarray) -> None:
                out[row] += np.bincount(strains, values, n)

            for batch in batches:
                for a, b, x, y, kind in zip(*[batch.column(c) for c in range(5)], strict=True):
                    work(add, *[np.frombuffer(c.as_buffer(), np.int32) for c in (a, b)], *[np.frombuffer(c.as_buffer(), kind.as_py()).astype(float) for c in (x, y)], **given.value)
            for lo in range(0, size, PIECE):
                yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int64()), pa.array([out.reshape(-1)[lo : lo + PIECE].tobytes()])], names=["lo", "v"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[int, np.ndarray] = {}
            for batch in batches:
                for lo, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    out[lo] = out.get(lo, 0) + np.frombuffer(v.as_buffer())
            for lo, v in out.items():
                yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int64()), pa.array([v.tobytes()])], names=["lo", "v"])

        schema = "lo long, v binary"
        whole = np.zeros(size)
        for r in self.table.coalesce(self.spark.sparkContext.defaultParallelism).mapInArrow(part, schema).repartition("lo").mapInArrow(added, schema).collect():
            whole[r["lo"] : r["lo"] + PIECE] = np.frombuffer(r["v"])
        given.destroy()
        return whole.reshape(k, n)


def _rival_sums(add, a, b, x, y, p):
    share = (x + y) / (p[a] + p[b])
    add(0, a, share)
    add(0, b, share)


def _win_sums(add, a, b, x, y):
    add(0, a, x)
    add(0, b, y)


def _slopes(add, a, b, x, y, s):
    p = 1 / (1 + np.exp(-(s[a] - s[b])))
    w, left = np.maximum((x + y) * p * (1 - p), 1e-12), x - (x + y) * p
    add(0, a, left)
    add(0, b, -left)
    add(1, a, w)
    add(1, b, w)


def _rival_weights(add, a, b, x, y, s, d):
    p = 1 / (1 + np.exp(-(s[a] - s[b])))
    w = np.maximum((x + y) * p * (1 - p), 1e-12)
    for k, v in enumerate(d):
        add(k, a, w * v[b])
        add(k, b, w * v[a])


def _likelihoods(add, a, b, x, y, s):
    total, d = x + y, s[a] - s[b]
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.where(x > 0, x * np.log(x / total), 0.0) + np.where(y > 0, y * np.log(y / total), 0.0)
    for k, v in enumerate((-x * np.logaddexp(0, -d) - y * np.logaddexp(0, d), own, x, y, np.ones(len(a)))):
        add(k, a, v)


def blockwise_bradley_terry(blocks: PairBlocks, starts: np.ndarray, *, place: bool, steps: int = 100, errors: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(strengths, standard errors, five sums by strain) as :func:`bradley_terry` finds them for each component, with passes over blocks.

    Strains are numbered component by component, from ``starts``.  With ``place`` strengths are on the scale of :func:`minorised`."""
    n = blocks.n
    sizes = np.diff(np.append(starts, n))
    total = lambda v: np.repeat(np.add.reduceat(v, starts), sizes)
    most = lambda v: np.repeat(np.maximum.reduceat(v, starts), sizes)
    s, se, placed = np.zeros(n), np.full(n, np.nan), None
    if place:
        wins, p, scale = blocks.sums(_win_sums, 1)[0], np.ones(n), np.zeros(n)
        for _ in range(PLACING_STEPS):
            new = wins / blocks.sums(_rival_sums, 1, p=p)[0]
            factor, moved = most(new), np.abs(new - p)
            p, scale = new / factor, scale + np.log(factor)
            if (moved < 1e-15 * factor).all():
                break
            p = np.maximum(p, 1e-300)
        some = wins > 0
        placed = np.log(p, out=np.zeros(n), where=some) + scale
        s = np.where(some, placed - total(np.where(some, placed, 0.0)) / np.maximum(total(some.astype(float)), 1), 0.0)

    def solved(right: np.ndarray, diagonal: np.ndarray, goal: float) -> np.ndarray:
        """Rows x of the weighted Laplacian at s for rows ``right`` that add up to 0 in each component: conjugate gradients scaled by the diagonal."""
        centre = lambda v: v - np.array([total(u) for u in v]) / np.repeat(sizes, sizes)
        x, r = np.zeros_like(right), centre(right)
        goal = goal * np.abs(r).max(axis=1)
        z = r / diagonal
        d, rz = z.copy(), (r * z).sum(axis=1)
        for _ in range(2 * n + 50):
            if (np.abs(r).max(axis=1) <= goal).all():
                break
            q = diagonal * d - blocks.sums(_rival_weights, len(d), s=s, d=d)
            dq = (d * q).sum(axis=1)
            step = np.divide(rz, dq, out=np.zeros_like(rz), where=dq > 0)[:, None]
            x += step * d
            r = centre(r - step * q)
            z = r / diagonal
            rz, before = (r * z).sum(axis=1), rz
            d = z + np.divide(rz, before, out=np.zeros_like(rz), where=before > 0)[:, None] * d
        return x

    first = None
    for _ in range(steps):
        slope, weights = blocks.sums(_slopes, 2, s=s)
        steep = np.abs(slope).max()
        first = first or steep or 1.0
        # the last steps decide: far from the maximum, a step need not be solved to the last digit
        step = np.clip(solved(slope[None], weights + 1e-9, min(1e-2, max(1e-13, 0.1 * steep / first)))[0], -5, 5)
        s = s + step
        if np.abs(step).max() < 1e-10:
            break
    if errors:
        weights, base = blocks.sums(_slopes, 2, s=s)[1] + 1e-9, np.repeat(starts, sizes)
        others = np.flatnonzero(np.arange(n) != base)
        for lo in range(0, len(others), ERRORS_AT_ONCE):
            k = others[lo : lo + ERRORS_AT_ONCE]
            unit, row = np.zeros((len(k), n)), np.arange(len(k))
            unit[row, k], unit[row, base[k]] = 1, -1
            x = solved(unit, weights, 1e-13)
            se[k] = np.sqrt(np.maximum(x[row, k] - x[row, base[k]], 0))
    sums = blocks.sums(_likelihoods, 5, s=s)
    if place:
        some_s = total(np.where(some, s, 0.0)) / np.maximum(total(some.astype(float)), 1)
        s = s + total(np.where(some, placed, 0.0)) / np.maximum(total(some.astype(float)), 1) - some_s
    return s, se, sums


def _fit_large(pooled: DataFrame, component: DataFrame, schema: str, *, place: bool, errors: bool) -> DataFrame:
    """Rows as :func:`_fit_component` gives them for the components of ``component`` (strain_a, component)."""
    # a number for each strain, a dimension of the experiment; the driver holds a few vectors over them
    number = materialize(component.select(F.col("strain_a").alias("strain"), "component", (F.row_number().over(Window.orderBy("component", "strain_a")) - 1).alias("i")), "numbers")
    starts = np.array(sorted(r[0] for r in number.groupBy("component").agg(F.min("i")).select("min(i)").collect()), np.int64)
    n = number.count()
    at = lambda c, name: (F.broadcast if n <= 1_000_000 else lambda x: x)(number.select(F.col("strain").alias(c), F.col("i").alias(name)))
    blocks = PairBlocks(pooled.join(at("strain_a", "a"), "strain_a").join(at("strain_b", "b"), "strain_b"), n)
    s, se, sums = blockwise_bradley_terry(blocks, starts, place=place, errors=errors)
    remove(blocks.spark, blocks.table)
    fitted = blocks.spark.sparkContext.broadcast((s, se, sums))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, se, sums = fitted.value
        for pdf in batches:
            i = pdf["i"].to_numpy()
            yield pd.DataFrame({"strain": pdf["strain"], "s": s[i], "bt_se": se[i], **dict(zip(("fitted", "own", "won", "lost"), sums[:4, i], strict=True)), "n_pairs": sums[4, i].astype(np.int64)})

    return number.select("strain", "i").mapInPandas(rows, schema)


def fit_bradley_terry(pooled: DataFrame, *, errors: bool = True) -> DataFrame:
    """(strain, bt_strength, bt_se, bt_rank, pseudo_r2, deviance, null_deviance, df_resid), any number of strains.

    ``pooled``: strain_a, strain_b, n_reads_a, n_reads_b, a row for each pair.  The smallest
    strain is the baseline; logs are natural.  A task fits a connected component of up to TASK_PAIRS pairs; larger ones are
    fitted together from sums over blocks of pairs, and no task holds their pairs.  Nothing says how strains that no pairs connect compare: components
    are placed where minorisation from equal strengths leaves them.  Without ``errors`` bt_se is null;
    it is relative to the smallest strain of the component."""
    kind = dict(pooled.dtypes)["strain_a"]
    schema = f"strain {kind}, s double, bt_se double, fitted double, own double, won double, lost double, n_pairs long"
    pooled = materialize(pooled.select("strain_a", "strain_b", "n_reads_a", "n_reads_b"), "pooled")
    component = connected_components(pooled, "strain_a", "strain_b").select(F.col("vertex").alias("strain_a"), "component")
    n_pairs = pooled.groupBy("strain_a").count().join(component, "strain_a").groupBy("component").agg(F.sum("count").alias("n"))
    large = [r["component"] for r in n_pairs.filter(F.col("n") > TASK_PAIRS).select("component").collect()]
    several = component.select("component").distinct().limit(len(large) + 1).count() > len(large)
    fits = []
    if several or not large:
        fits.append(pooled.join(component.filter(~F.col("component").isin(large)), "strain_a").groupBy("component").applyInPandas(lambda pdf: _fit_component(pdf, errors), schema))
    if large:
        fits.append(_fit_large(pooled, component.filter(F.col("component").isin(large)), schema, place=several or len(large) > 1, errors=errors))
    fits = materialize(reduce(DataFrame.unionByName, fits), "strengths")
    one = fits.agg(F.min_by("s", "strain").alias("base"), F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("fitted", "own", "won", "lost", "n_pairs")])
    log = lambda k: F.when(F.col(k) > 0, F.col(k) * F.ln(F.col(k) / (F.col("won") + F.col("lost")))).otherwise(0.0)
    deviance, null = 2 * (F.col("own") - F.col("fitted")), 2 * (F.col("own") - log("won") - log("lost"))  # the null model knows one share for all pairs
    one = one.select("base", deviance.alias("deviance"), null.alias("null_deviance"), (F.col("n_pairs") - F.col("n") + 1).cast("int").alias("df_resid"))
    # strains are a dimension: one ordered window; strengths that differ by rounding only are ties
    place = F.row_number().over(Window.orderBy(F.desc(F.round("s", 9)), "strain"))
    ranked = fits.select("strain", "s", F.nanvl("bt_se", F.lit(None).cast("double")).alias("bt_se"), place.alias("bt_rank")).join(F.broadcast(one), F.lit(True))
    r2 = 1 - F.try_divide("deviance", F.nullif(F.col("null_deviance"), F.lit(0.0)))
    return ranked.select("strain", (F.col("s") - F.col("base")).alias("bt_strength"), "bt_se", "bt_rank", r2.alias("pseudo_r2"), "deviance", "null_deviance", "df_resid")


def strength_residuals(pairs: DataFrame, strengths: DataFrame, *, natural_log: bool = False) -> DataFrame:
    """(strain, mean, sd) of outcomes less predicted differences, seen from each strain.

    Strengths are natural log odds and outcomes log2 ratios, so the difference is
    divided by ln 2; ``natural_log`` leaves that out, for comparison with figures made so."""
    import math

    unit = 1.0 if natural_log else math.log(2)
    out = pairs
    for side in ("a", "b"):
        out = out.join(strengths.select(F.col("strain").alias(f"strain_{side}"), F.col("bt_strength").alias(f"_{side}")), f"strain_{side}")
    left = F.col("mean_log2_ratio_a_over_b") - (F.col("_a") - F.col("_b")) / unit
    seen = out.select(F.explode(F.array(F.struct(F.col("strain_a").alias("s"), left.alias("r")), F.struct(F.col("strain_b").alias("s"), (-left).alias("r")))).alias("x"))
    return seen.groupBy(F.col("x.s").alias("strain")).agg(F.avg("x.r").alias("bt_residual_mean"), F.stddev_samp("x.r").alias("bt_residual_sd"))


def goodness_of_fit(strengths: DataFrame) -> DataFrame:
    """One row: likelihood-ratio and deviance tests of a fit by :func:`fit_bradley_terry`, and the dispersion."""
    from .stats import chi2_sf_udf

    one = strengths.agg(F.count("*").alias("n_strains"), *[F.first(c).alias(c) for c in ("deviance", "null_deviance", "df_resid", "pseudo_r2")])
    df = F.col("n_strains") - 1
    lr = F.col("null_deviance") - F.col("deviance")
    return one.withColumns(
        {
            "lr_stat": lr, "p_strains_differ": chi2_sf_udf(lr.cast("double"), df.cast("double")), "p_gof": chi2_sf_udf(F.col("deviance"), F.col("df_resid").cast("double")), "dispersion_ratio": F.try_divide("deviance", "df_resid"),
        }
    )


def simulated_outcomes(pooled: DataFrame, strengths: DataFrame, replicates: int, *, seed: int = 0) -> DataFrame:
    """(replicate, strain_a, strain_b, n_reads_a, n_reads_b): reads of each pair drawn anew under the fitted hierarchy."""
    out = pooled
    for side in ("a", "b"):
        out = out.join(strengths.select(F.col("strain").alias(f"strain_{side}"), F.col("bt_strength").alias(f"_{side}")), f"strain_{side}")
    rows = out.select("strain_a", "strain_b", (F.col("n_reads_a") + F.col("n_reads_b")).cast("long").alias("n"), (1 / (1 + F.exp(F.col("_b") - F.col("_a")))).alias("p"))
    kind = dict(pooled.dtypes)["strain_a"]

    def run(batches):
        for pdf in batches:
            for s_a, s_b, n, p in pdf.itertuples(index=False):
                wins = np.random.default_rng([seed, *f"{s_a}|{s_b}".encode()]).binomial(n, p, replicates)
                yield pd.DataFrame({"replicate": np.arange(replicates, dtype=np.int32), "strain_a": s_a, "strain_b": s_b, "n_reads_a": wins, "n_reads_b": n - wins})

    return rows.mapInPandas(run, f"replicate int, strain_a {kind}, strain_b {kind}, n_reads_a long, n_reads_b long")


def select_features(x: np.ndarray, y: np.ndarray, *, diverse: int = 500, keep: int = 100, max_corr: float = 0.95) -> list[int]:
    """Columns by variance, then by correlation with y, near-copies of a kept one left out; on training rows only."""
    sd = x.std(axis=0)
    order = np.argsort(-sd, kind="stable")[:diverse]
    order = order[sd[order] > 0]
    z = (x[:, order] - x[:, order].mean(axis=0)) / sd[order]
    gain = np.abs(z.T @ (y - y.mean()))
    kept: list[int] = []
    for k in np.argsort(-gain, kind="stable"):
        if all(abs(float(z[:, k] @ z[:, j])) / len(z) < max_corr for j in kept):
            kept.append(int(k))
        if len(kept) == keep:
            break
    return [int(order[k]) for k in kept]


def leave_strains_out(pairs: DataFrame, features: pd.DataFrame, *, target: str, n_splits: int = 10, repeats: int = 3, sources: dict[str, pd.DataFrame] | None = None, alpha: float = 50.0, n_components: int = 20, symmetric: bool = False, seed: int = 0) -> DataFrame:
    """(source, strain, observed, predicted): a strain's strength (or yield) from its genome alone, its pairs held out.

    ``sources`` names the representations to compare, all indexed by strain (default: the
    features).  Predictions are means over repeats; a group is one repeat, fold and source."""
    named = sources or {"features": features}
    strains = list(features.index)
    spark = pairs.sparkSession
    table = pairs.filter(F.col("strain_a").isin(strains) & F.col("strain_b").isin(strains)).select("strain_a", "strain_b", F.col(target).cast("double").alias("y")).dropna().toPandas()
    at = {s: i for i, s in enumerate(strains)}
    a, b, y = table["strain_a"].map(at).to_numpy(), table["strain_b"].map(at).to_numpy(), table["y"].to_numpy()
    n = len(strains)
    fit = (lambda p, q, v, k: additive_yield(p, q, v, k)[0]) if symmetric else additive_strength
    whole = fit(a, b, y, n)
    matrices = {k: m.loc[strains].to_numpy(float) for k, m in named.items()}
    kind = dict(pairs.dtypes)["strain_a"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rep, k, source = (pdf[c].iloc[0] for c in ("rep", "fold", "source"))
        fold_of = np.random.default_rng([seed, int(rep)]).permutation(n) % n_splits
        train, test = np.flatnonzero(fold_of != k), np.flatnonzero(fold_of == k)
        keep = np.isin(a, train) & np.isin(b, train)
        s = fit(np.searchsorted(train, a[keep]), np.searchsorted(train, b[keep]), y[keep], len(train))
        z = standardise(components(matrices[source], train, n_components), train)
        w, c = ridge(z[train], s, alpha)
        return pd.DataFrame({"source": source, "strain": [strains[i] for i in test], "observed": whole[test], "predicted": z[test] @ w + c})

    jobs = spark.createDataFrame([(r, k, s) for r in range(repeats) for k in range(n_splits) for s in named], "rep int, fold int, source string")
    out = jobs.groupBy("rep", "fold", "source").applyInPandas(run, f"source string, strain {kind}, observed double, predicted double")
    return out.groupBy("source", "strain").agg(F.first("observed").alias("observed"), F.avg("predicted").alias("predicted"))


def transfer(strengths: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` of another experiment with the log2 ratio and share that the strengths predict; pairs with an unknown strain are left out."""
    import math

    out = pairs
    for side in ("a", "b"):
        out = out.join(strengths.select(F.col("strain").alias(f"strain_{side}"), F.col("bt_strength").alias(f"_{side}")), f"strain_{side}")
    d = F.col("_a") - F.col("_b")
    return out.withColumns({"predicted_log2": d / math.log(2), "predicted_share": 1 / (1 + F.exp(-d))}).drop("_a", "_b")


def permuted_rows(features: pd.DataFrame, seed: int) -> pd.DataFrame:
    """The same strains with each other's features."""
    order = np.random.default_rng(seed).permutation(len(features))
    return pd.DataFrame(features.to_numpy()[order], index=features.index, columns=features.columns)


def against_permutations(real: float, nulls: list[float]) -> dict:
    """z of a score against those of permuted mappings, and whether it beats them all."""
    x = np.array(nulls, float)
    sd = float(x.std())
    return {"real": real, "null_mean": float(x.mean()), "null_sd": sd, "z": (real - float(x.mean())) / sd if sd else float("nan"), "beats_all": bool((real > x).all())}


def matched_removal(a: np.ndarray, b: np.ndarray, train: np.ndarray, removable: np.ndarray, n_remove: int, rng) -> np.ndarray:
    """Training pairs left when whole random strains among ``removable`` go until at least ``n_remove`` pairs are gone."""
    gone = np.zeros(len(removable), bool)
    for s in rng.permutation(np.intersect1d(np.flatnonzero(removable), np.concatenate((a[train], b[train])))):
        if (gone[a[train]] | gone[b[train]]).sum() >= n_remove:
            break
        gone[s] = True
    return train[~(gone[a[train]] | gone[b[train]])]


def matched_feature_sets(prevalence: np.ndarray, size: np.ndarray | list[int], draws: int, rng, bins: int = 20) -> list[np.ndarray]:
    """Random feature sets with as many features of each prevalence bin as the given set."""
    rank = np.argsort(np.argsort(prevalence, kind="stable"), kind="stable")
    stratum = rank * bins // max(1, len(prevalence))
    wanted = np.bincount(stratum[np.asarray(size)], minlength=bins)
    return [np.sort(np.concatenate([rng.choice(np.flatnonzero(stratum == s), k, replace=False) for s, k in enumerate(wanted) if k])) for _ in range(draws)]


def learning_curve(pairs: DataFrame, *, sizes: list[int], unit: str = "strain", repeats: int = 5, seed: int = 0) -> DataFrame:
    """(size, rep, strain_a, strain_b, …): the pairs among ``size`` strains, the first in a seeded hash order of each repeat."""
    strains = pairs.select(F.explode(F.array("strain_a", "strain_b")).alias("s")).distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    place = F.row_number().over(Window.partitionBy("rep").orderBy(uniform(seed, "rep", "s"), "s"))
    placed = strains.withColumn("_n", place)
    both = pairs.join(placed.select(F.col("s").alias("strain_a"), "rep", F.col("_n").alias("_na")), "strain_a").join(placed.select(F.col("s").alias("strain_b"), "rep", F.col("_n").alias("_nb")), ["strain_b", "rep"])
    listed = F.array(*map(F.lit, sizes))
    return both.withColumn("size", F.explode(F.filter(listed, lambda k: (F.col("_na") <= k) & (F.col("_nb") <= k)))).drop("_na", "_nb")
