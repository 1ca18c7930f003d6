import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import folds, models, stats


@pytest.fixture(scope="module")
def experiment(spark):
    rng = np.random.default_rng(0)
    strains = [f"s{k:02d}" for k in range(36)]
    x = (rng.random((36, 12)) < 0.4).astype(float)
    s = x[:, :4] @ np.array([2.0, -1.5, 1.0, 0.7])
    s -= s.mean()
    rows = []
    for i in range(36):
        for j in range(i + 1, 36):
            n = 60
            k = rng.binomial(n, 1 / (1 + np.exp(-(s[i] - s[j]))))
            rows.append((strains[i], strains[j], int(k), int(n - k), float(np.log2((k + 0.5) / (n - k + 0.5)))))
    pairs = spark.createDataFrame(rows, "strain_a string, strain_b string, n_reads_a long, n_reads_b long, mean_log2_ratio_a_over_b double")
    return pairs, pd.DataFrame(x, index=strains), s


def test_bradley_terry(experiment):
    pairs, x, s = experiment
    fit = models.fit_bradley_terry(pairs)
    got = fit.toPandas().set_index("strain")["bt_strength"].loc[x.index].to_numpy()
    assert np.corrcoef(got, s)[0, 1] > 0.98 and got[0] == 0 and 0.5 < fit.first()["pseudo_r2"] <= 1
    gof = models.goodness_of_fit(fit).first()
    assert gof["p_strains_differ"] < 1e-6 and 0.5 < gof["dispersion_ratio"] < 2
    residual = models.strength_residuals(pairs, fit)
    assert residual.agg(F.max(F.abs("bt_residual_mean"))).first()[0] < 1.0
    drawn = models.simulated_outcomes(pairs, fit, 5)
    assert drawn.count() == 5 * pairs.count()


def test_two_strains():
    fit = models.bradley_terry(np.array([0]), np.array([1]), np.array([30.0]), np.array([70.0]), 2)
    assert fit["strength"][1] == pytest.approx(np.log(0.7 / 0.3), abs=1e-6)


def test_strengths_of_many_strains(spark):
    """More strains than a dense fit takes, and components that nothing connects."""
    rng, n = np.random.default_rng(1), 60
    a, b = np.triu_indices(n, 1)
    wins, lost = rng.integers(1, 30, len(a)).astype(float), rng.integers(1, 30, len(a)).astype(float)
    dense = models.bradley_terry(a, b, wins, lost, n)
    s, se = models.sparse_bradley_terry(a, b, wins, lost, n)
    assert np.allclose(s, dense["strength"], atol=1e-8) and np.allclose(se[1:], dense["se"][1:], rtol=1e-5)
    star = [(0, i) for i in range(1, 5002)]
    rows = [(min(e), max(e), 7, 7) for e in star] + [(6000 + int(i), 6000 + int(j), int(w), int(x)) for i, j, w, x in zip(a, b, wins, lost, strict=True)]
    fit = models.fit_bradley_terry(spark.createDataFrame(rows, "strain_a long, strain_b long, n_reads_a long, n_reads_b long"), errors=False).toPandas().set_index("strain").sort_index()
    got = fit["bt_strength"]
    assert len(got) == 5002 + n and np.abs(got.loc[:5001]).max() < 1e-9 and sorted(fit["bt_rank"]) == list(range(1, len(got) + 1))
    ours = got.loc[6000:].to_numpy()
    assert np.allclose(ours - ours[0], dense["strength"], atol=1e-8)
    assert ours.mean() == pytest.approx(models.minorised(a, b, wins, lost, n).mean() - models.minorised(*np.array(star).T, np.full(5001, 7.0), np.full(5001, 7.0), 5002)[0], abs=1e-9)
    share = (5001 * 7 + wins.sum()) / (5001 * 14 + wins.sum() + lost.sum())
    null = 2 * (5001 * 7 * np.log(0.5 / share) + 5001 * 7 * np.log(0.5 / (1 - share)) + sum(w * np.log(w / (w + x) / share) + x * np.log(x / (w + x) / (1 - share)) for w, x in zip(wins, lost, strict=True)))
    assert fit["deviance"].iloc[0] == pytest.approx(dense["deviance"]) and fit["null_deviance"].iloc[0] == pytest.approx(null)


def test_large_components_are_not_held_in_one_task(spark, monkeypatch):
    """Sums over blocks of pairs give the strengths, errors and deviances of fits in one task, several components included."""
    rng, rows = np.random.default_rng(3), []
    for first, n in ((0, 30), (100, 25), (200, 3)):
        rows += [(first + int(i), first + int(j), int(x), int(y)) for i, j, x, y in zip(*np.triu_indices(n, 1), *rng.integers(1, 40, (2, n * (n - 1) // 2)), strict=True)]
    schema = "strain_a long, strain_b long, n_reads_a long, n_reads_b long"
    gof = lambda fit: models.goodness_of_fit(spark.createDataFrame(fit.reset_index())).select("n_strains", "lr_stat", "df_resid", "dispersion_ratio").first().asDict()
    for some in (rows, [r for r in rows if r[0] < 100]):
        fit = lambda: models.fit_bradley_terry(spark.createDataFrame(some, schema)).toPandas().set_index("strain").sort_index()  # noqa: E731, B023
        with monkeypatch.context() as m:
            whole = fit()
            m.setattr(models, "TASK_PAIRS", 100)
            m.setattr(models, "BLOCK_PAIRS", 64)
            m.setattr(models, "PIECE", 16)
            task = models._fit_component
            m.setattr(models, "_fit_component", lambda pdf, errors: task(pdf, errors) if len(pdf) <= 100 else None)
            parts = fit()
        assert whole.index.equals(parts.index) and list(whole["bt_rank"]) == list(parts["bt_rank"])
        for c in ("bt_strength", "deviance", "null_deviance", "df_resid", "pseudo_r2"):
            assert np.allclose(whole[c], parts[c], rtol=1e-9, atol=1e-8), c
        assert gof(whole) == pytest.approx(gof(parts), rel=1e-8)
        assert np.allclose(whole["bt_se"], parts["bt_se"], rtol=1e-5, equal_nan=True) and whole["bt_se"].notna().sum() == len(whole) - (3 if len(some) == len(rows) else 1)


def test_cross_validation_orders_models(spark, experiment):
    pairs, x, _ = experiment
    units = spark.createDataFrame([(s,) for s in x.index], "strain string")
    roles = folds.strain_folds(pairs, folds.unit_folds(units, "strain", 4))
    chosen = {k: models.MODELS[k] for k in ("zero", "strength_observed", "two_stage_ridge", "ridge", "boosted")}
    scores = models.fold_scores(models.cross_validate(roles, pairs, x, target="mean_log2_ratio_a_over_b", models=chosen)).toPandas().groupby("model")["r2"].mean()
    assert scores["zero"] == 0 and scores["strength_observed"] == 0  # test strains were never seen
    assert scores["two_stage_ridge"] > 0.15 and scores["ridge"] > 0.15
    pair_roles = folds.pair_folds(pairs, 4).withColumn("rep", F.lit(0)).withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(3))))
    pair_roles = pair_roles.select("rep", F.col("f").alias("fold"), "strain_a", "strain_b", F.when(F.col("f") == F.col("fold"), "test").otherwise("train").alias("role"))
    seen = models.fold_scores(models.cross_validate(pair_roles, pairs, x, target="mean_log2_ratio_a_over_b", models={"strength_observed": models.MODELS["strength_observed"]})).toPandas()
    assert seen["r2"].mean() > 0.8
    shuffled = models.fold_scores(models.cross_validate(roles, pairs, x, target="mean_log2_ratio_a_over_b", models={"two_stage_ridge": models.MODELS["two_stage_ridge"]}, shuffled=True)).toPandas()
    assert shuffled["r2"].mean() < scores["two_stage_ridge"] / 2


def test_predictions_are_antisymmetric(experiment):
    _, x, s = experiment
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 36, 200), rng.integers(0, 36, 200)
    keep = a != b
    a, b = a[keep], b[keep]
    y = s[a] - s[b]
    train, test = np.arange(100), np.arange(100, len(a))
    kw = {"features": x.to_numpy(), "totals": x.to_numpy().sum(axis=1, keepdims=True), "symmetric": np.zeros((len(a), 0))}
    one = models.Fold(a, b, y, train, test, **kw)
    a2, b2, y2 = a.copy(), b.copy(), y.copy()
    a2[test], b2[test], y2[test] = b[test], a[test], -y[test]
    two = models.Fold(a2, b2, y2, train, test, **kw)
    for name in ("ridge", "two_stage_ridge", "boosted"):
        assert np.allclose(models.MODELS[name](one), -models.MODELS[name](two))


def test_yield_models(experiment):
    _, x, s = experiment
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 36, 300) for _ in range(2))
    y = 3 + s[a] + s[b]
    f = models.Fold(a, b, y, np.arange(200), np.arange(200, 300), x.to_numpy(), x.to_numpy().sum(axis=1, keepdims=True), np.zeros((300, 0)))
    base = ((y[200:] - y[:200].mean()) ** 2).sum()
    for name in ("additive", "ridge", "two_stage_ridge", "boosted"):
        assert ((y[200:] - models.YIELD_MODELS[name](f)) ** 2).sum() < 0.6 * base, name


def test_numerics():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(30, 5)), rng.normal(size=30)
    wide = np.hstack((x, rng.normal(size=(30, 60))))
    for m in (x, wide):
        w, c = models.ridge(m, y, 2.0)
        mc, yc = m - m.mean(axis=0), y - y.mean()
        assert np.allclose(mc.T @ (yc - mc @ w), 2.0 * w) and c == pytest.approx(y.mean() - m.mean(axis=0) @ w)
    assert stats.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_sf(124.342, 100) == pytest.approx(0.05, abs=1e-4)
    assert stats.binomial_two_sided(8, 10, 0.5) == pytest.approx(0.109375)
    assert stats.wilcoxon_signed_rank(np.array([1.0, 2, 3, 4, 5, 6])) == pytest.approx(2 / 64)
    u, v, r = stats.two_component_nnls(2 * x[:, 0] + 0.5 * x[:, 1], x[:, 0], x[:, 1])
    assert (u, v, r) == pytest.approx((2, 0.5, 0), abs=1e-9)
    assert stats.two_component_nnls(-x[:, 0], x[:, 0], np.zeros(30))[:2] == (0.0, 0.0)
    cols = models.select_features(np.column_stack((x, x[:, 0] * 2)), x[:, 0], keep=3)
    assert len(cols) == 3 and (0 in cols) != (5 in cols)


def test_large_folds_are_not_held_in_one_task(spark, experiment, monkeypatch):
    """Sums over pairs give the predictions of whole folds; no task gets a fold."""
    pairs, x, _ = experiment
    units = spark.createDataFrame([(k,) for k in x.index], "strain string")
    roles = folds.strain_folds(pairs, folds.unit_folds(units, "strain", 3))
    # test pairs whose strains were trained on, too
    roles = roles.unionByName(roles.filter("fold = 0 AND role = 'train'").limit(40).withColumn("role", F.lit("test")))
    chosen = {k: models.MODELS[k] for k in models.SCORED}
    run = lambda: models.cross_validate(roles, pairs, x, target="mean_log2_ratio_a_over_b", models=chosen, n_components=5)
    order = ["rep", "fold", "model", "strain_a", "strain_b"]
    whole = run().toPandas().sort_values(order).reset_index(drop=True)
    monkeypatch.setattr(models, "FOLD_PAIRS", 1)
    monkeypatch.setattr(models, "Fold", None)
    parts = run().toPandas().sort_values(order).reset_index(drop=True)
    assert whole[order].equals(parts[order]) and np.allclose(whole["y_true"], parts["y_true"], atol=0)
    assert np.allclose(whole["y_pred"], parts["y_pred"], atol=1e-9) and whole["y_pred"].abs().max() > 0.1
