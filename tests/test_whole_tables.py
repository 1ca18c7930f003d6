"""Queries without SQL cover their whole tables: more suppliers, parts and orders than earlier cuts let through."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """2,100 orders of two lines each, 40 suppliers, 900 parts (three plates)."""
    root = str(tmp_path_factory.mktemp("wide"))
    rng = np.random.default_rng(0)
    orders = [1 + k // 2 for k in range(4200)]
    first = [1 + 2 * (k // 2 % 20) + k % 2 for k in range(4200)]
    lines = pd.DataFrame({"l_orderkey": orders, "l_partkey": [1 + k % 900 for k in range(4200)], "l_suppkey": first, "l_linenumber": [1 + k % 7 for k in range(4200)]})
    lines["l_quantity"] = rng.integers(1, 50, 4200).astype(float)
    lines["l_extendedprice"] = rng.random(4200).round(4) * 1000
    lines["l_returnflag"] = "N"
    late = lines["l_orderkey"] > 2000
    lines.loc[late, "l_suppkey"] = lines.loc[late, "l_suppkey"].map(lambda s: s + 1000)
    parts = pd.DataFrame({"p_partkey": range(1, 901)})
    parts["p_name"], parts["p_brand"] = "blue ivory", [f"b{k % 7}" if k <= 400 else f"late{k % 7}" for k in range(1, 901)]
    parts["p_size"], parts["p_retailprice"] = [1 + k % 20 for k in range(900)], 1.0
    suppliers = pd.DataFrame({"s_suppkey": sorted(set(lines["l_suppkey"])), "s_nationkey": 1})
    for name, frame in {"lineitem": lines, "part": parts, "supplier": suppliers}.items():
        spark.createDataFrame(frame).write.parquet(f"{root}/{name}.parquet")
    return root, lines, parts


def test_lines_and_suppliers(spark, wide):
    root, lines, _ = wide
    couples = {tuple(sorted(g)) for _, g in lines.groupby("l_orderkey")["l_suppkey"]}
    lower = {a for a, _ in couples}
    assert max(lower) > 1000
    assert {r["strain_a"] for r in QUERIES["bootstrap_ci"](spark, root).collect()} == lower
    assert {r["strain_a"] for r in QUERIES["replicate_direction"](spark, root).collect()} == lower
    assert {(r["strain_a"], r["strain_b"]) for r in QUERIES["pair_folds"](spark, root).collect()} == couples
    assert {r["l_partkey"] for r in QUERIES["tiled_hits"](spark, root).collect()} == set(range(1, 901))


def test_plates_and_brands(spark, wide):
    root, _, parts = wide
    got = QUERIES["consensus_vote"](spark, root).collect()
    assert {r["strain"]: r["informative_wells"] for r in got} == parts.groupby("p_brand").size().to_dict()
    assert {r["plate"] for r in QUERIES["transform_search"](spark, root).collect()} == {0, 1, 2}
    cells = {(k // 384, k % 384 // 24, k % 24): b for k, b in zip(parts["p_partkey"], parts["p_brand"], strict=True)}
    near = [(dr, dc) for dr in range(3) for dc in range(-2, 3) if dr or dc > 0]
    same = sum(cells.get((p, r + dr, c + dc)) == b for (p, r, c), b in cells.items() for dr, dc in near)
    assert QUERIES["adjacency_enrichment"](spark, root).first()["observed"] == same


def test_group_cv_and_locality(spark, wide, monkeypatch):
    from tessera.operators import models
    from tessera.operators import plate_controls as P

    root, lines, parts = wide
    seen = {}
    whole = models.cross_validate
    monkeypatch.setattr(models, "cross_validate", lambda roles, pairs, frame, **k: seen.update(frame=frame, pairs=pairs) or whole(roles, pairs, frame, **k))
    locality = P.locality
    monkeypatch.setattr(P, "locality", lambda events, homes, wells, **k: seen.update(wells=wells) or locality(events, homes, wells, **k))
    assert QUERIES["group_cv"](spark, root).count() > 0
    assert set(seen["frame"].index) == set(lines["l_suppkey"])
    assert seen["pairs"].agg(F.max("strain_a")).first()[0] > 1000
    QUERIES["locality"](spark, root)
    wells = {(r["row"], r["col"]) for r in seen["wells"].collect()}
    assert wells == {(k % 384 // 24, k % 24) for k in parts["p_partkey"]} and (0, 0) in wells
