"""Densities and spectra of wells as features of strains and pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .stats import two_component_nnls
from .windows import detrend, zscore

UNMIX = StructType([StructField(c, DoubleType()) for c in ("weight_a", "weight_b", "residual", "log2_weights", "closer_a")])


def well_densities(cells: DataFrame, layout: DataFrame, *, value: str = "od") -> DataFrame:
    """Layout wells with density less the plate's blank, detrended and z-scored within the plate (population deviation).

    ``cells``: plate, row, col, od; ``layout``: plate, row, col and what describes the wells."""
    unused = cells.join(layout.select("plate", "row", "col"), ["plate", "row", "col"], "left_anti")
    blank = unused.groupBy("plate").agg(F.median(value).alias("_blank"))
    wells = layout.join(cells, ["plate", "row", "col"]).join(blank, "plate", "left")
    wells = wells.withColumn("od_net", F.col(value) - F.coalesce("_blank", F.lit(0.0))).drop("_blank")
    wells = wells.withColumn("od_flat", detrend("od_net", ["plate"], "row", "col"))
    return wells.withColumn("od_z", zscore("od_flat", ["plate"]))


def spectra(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, wavelengths, spectrum): readings of a well in order of wavelength, as arrays."""
    listed = F.sort_array(F.collect_list(F.struct("wavelength", "value")))
    return cells.groupBy(*keys).agg(listed.alias("_s")).select(*keys, F.transform("_s", lambda x: x["wavelength"]).alias("wavelengths"), F.transform("_s", lambda x: x["value"]).alias("spectrum"))


def band_mean(spectrum: Column, wavelengths: Column, low: float, high: float) -> Column:
    """Mean over a band of wavelengths, both ends included; null if it is empty."""
    inside = F.filter(F.zip_with(spectrum, wavelengths, lambda v, w: F.when((w >= low) & (w <= high), v)), lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(inside, F.lit(0.0), lambda s, v: s + v), F.size(inside))


def mono_features(wells: DataFrame, *, visible: tuple[float, float] = (400, 550), infrared: float = 800, reference: float = 600) -> DataFrame:
    """(strain, mono_od_z, mono_pigment, mono_nir_slope, shape): the first monoculture of each strain, its spectrum over its own density.

    ``wells``: strain, sample_id, od_z, wavelengths, spectrum."""
    one = wells.groupBy("strain").agg(F.min_by(F.struct("od_z", "wavelengths", "spectrum"), "sample_id").alias("w")).select("strain", "w.*")
    at = F.greatest(F.element_at("spectrum", F.array_position("wavelengths", F.lit(int(reference))).cast("int")), F.lit(1e-3))
    shape = one.withColumn("shape", F.transform("spectrum", lambda v: v / at))
    return shape.select("strain", F.col("od_z").alias("mono_od_z"), band_mean(F.col("shape"), F.col("wavelengths"), *visible).alias("mono_pigment"), band_mean(F.col("shape"), F.col("wavelengths"), infrared, 1e9).alias("mono_nir_slope"), "shape")


@F.pandas_udf(UNMIX)
def unmix_udf(pair: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = []
    for v, x, y in zip(pair, a, b, strict=True):
        if v is None or x is None or y is None:
            rows.append((None,) * 5)
            continue
        v, x, y = (np.asarray(s, float) for s in (v, x, y))
        wa, wb, rest = two_component_nnls(v, x, y)
        cosine = lambda p, q: 1 - float(p @ q) / max(float(np.linalg.norm(p) * np.linalg.norm(q)), 1e-12)
        rows.append((wa, wb, rest / max(float(np.linalg.norm(v)), 1e-6), float(np.log2(max(wa, 1e-3) / max(wb, 1e-3))), cosine(v, y) - cosine(v, x)))
    return pd.DataFrame(rows, columns=UNMIX.names).astype("float64")


def pair_features(pairs: DataFrame, monos: DataFrame) -> DataFrame:
    """Features of co-cultures against both monocultures; complete cases only, so that all models see the same pairs.

    ``pairs``: strain_a, strain_b, od_z, shape (means over a pair's wells); ``monos``: strain,
    mono_od_z, shape.  Yield deviation and residual do not change when the pair is
    turned; weights and closeness change sign."""
    out = pairs
    for k in ("a", "b"):
        out = out.join(monos.select(F.col("strain").alias(f"strain_{k}"), F.col("mono_od_z").alias(f"_z{k}"), F.col("shape").alias(f"_s{k}")), f"strain_{k}")
    out = out.withColumn("_u", unmix_udf("shape", "_sa", "_sb"))
    return out.select(
        *pairs.columns,
        (F.col("od_z") - (F.col("_za") + F.col("_zb")) / 2).alias("yield_dev"),
        F.col("_u.residual").alias("unmix_resid"),
        F.col("_u.log2_weights").alias("unmix_log2"),
        (F.try_divide(F.col("_u.weight_a"), F.col("_u.weight_a") + F.col("_u.weight_b")) - 0.5).alias("unmix_frac_a"),
        (F.abs(F.col("od_z") - F.col("_zb")) - F.abs(F.col("od_z") - F.col("_za"))).alias("od_closer_a"),
        F.col("_u.closer_a").alias("spec_closer_a"),
    ).dropna()


def band_profile(pairs: DataFrame, shapes: DataFrame, target: str) -> DataFrame:
    """(channel, n, r): per spectral channel, correlation of the monocultures' difference with the outcome."""
    from .stats import correlation

    side = lambda k: shapes.select(F.col("strain").alias(f"strain_{k}"), F.col("shape").alias(f"_{k}"))
    both = pairs.join(side("a"), "strain_a").join(side("b"), "strain_b")
    diff = both.select(F.col(target).alias("_y"), F.posexplode(F.zip_with("_a", "_b", lambda x, y: x - y)).alias("channel", "_x"))
    return diff.groupBy("channel").agg(F.count("*").alias("n"), correlation("_x", "_y").alias("r"))


def slope_through_origin(x: Column, y: Column) -> Column:
    return F.try_divide(F.sum(x * y), F.sum(x * x))
