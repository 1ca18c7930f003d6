"""Plate geometry: neighbours, shifts, relabellings, and what they would look like by chance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.draws import uniform, uniforms
from tessera.storage import materialize

from .stats import correlation, numbered, permuted_labels, repeated_draws, spearman

# wells are (row, col) from 0 within a plate of rows x cols


def neighbour_pairs(wells: DataFrame, *, reach: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """Couples of wells of a plate at most ``reach`` rows and columns apart, each once: ``plate``, columns of ``keep`` twice (``_1``, ``_2``)."""
    side = lambda k: wells.select("plate", F.col("row").alias(f"row_{k}"), F.col("col").alias(f"col_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in keep])
    near = (F.abs(F.col("row_1") - F.col("row_2")) <= reach) & (F.abs(F.col("col_1") - F.col("col_2")) <= reach)
    later = (F.col("row_1") < F.col("row_2")) | ((F.col("row_1") == F.col("row_2")) & (F.col("col_1") < F.col("col_2")))
    return side(1).join(side(2), "plate").filter(near & later)


def _alike_neighbours(pdf: pd.DataFrame, reach: int, kinds: int) -> np.ndarray:
    """By replicate: couples of wells of a plate at most ``reach`` apart with the same label; nothing if there is no such couple."""
    pdf = pdf.sort_values(["replicate", "row", "col"], kind="stable")
    codes = pd.factorize(pdf["_l"])[0].reshape(kinds, -1)
    row, col = (pdf[c].to_numpy(np.int64)[: codes.shape[1]] for c in ("row", "col"))
    wide = int(col.max() - col.min()) + 2 * reach + 1
    key = row * wide + (col - col.min())
    times = np.searchsorted(key, key, "right") - np.searchsorted(key, key, "left")  # rows of a well
    out, couples = np.zeros(kinds, np.int64), 0
    for d_row, d_col in [(r, c) for r in range(reach + 1) for c in range(-reach, reach + 1) if r or c > 0]:
        low = np.searchsorted(key, key + d_row * wide + d_col, "left")
        n = np.searchsorted(key, key + d_row * wide + d_col, "right") - low
        a = np.repeat(np.arange(len(key)), n)
        b = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        couples += len(a)
        out += ((codes[:, a] == codes[:, b]) & (codes[:, a] >= 0)) @ (times[a] * times[b])
    return out if couples else out[:0]


#: Wells up to which a task holds all of them, with the labels of a few replicates (some 200 bytes a well); more are numbered over all replicates at once.
HELD_WELLS = 1_500_000


def _held_counts(wells: DataFrame, reach: int, replicates: int, seed: int) -> DataFrame | None:
    """(replicate, n): couples of neighbours with the same label, 0 for the real ones; a task deals the labels of whole replicates. None if places are too far apart."""
    spark = wells.sparkSession
    pdf = wells.orderBy("_id").toPandas()
    inside = np.flatnonzero(pdf[["plate", "row", "col"]].notna().all(axis=1))
    plate = pd.factorize(pdf["plate"].iloc[inside])[0]
    row, col = (pdf[c].iloc[inside].to_numpy(np.int64) for c in ("row", "col"))
    high, wide = (int(x.max(initial=0)) - int(x.min(initial=0)) + 2 * reach + 1 for x in (row, col))
    if (int(plate.max(initial=0)) + 2) * high * wide >= 1 << 62:
        return None
    key = (plate * high + row - row.min(initial=0) + reach) * wide + col - col.min(initial=0) + reach
    given = spark.sparkContext.broadcast((pa.array(pdf["_id"].tolist(), pa.string()), pd.factorize(pdf["_l"])[0].astype(np.int32), inside, key))
    chunk = max(1, min(50, 4_000_000 // max(len(pdf), 1)))
    chunks = -(-replicates // chunk)

    def couples(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        key = key[order]
        times = np.searchsorted(key, key, "right") - np.searchsorted(key, key, "left")  # rows of a well
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for d_row, d_col in [(r, c) for r in range(reach + 1) for c in range(-reach, reach + 1) if r or c > 0]:
            low = np.searchsorted(key, key + d_row * wide + d_col, "left")
            n = np.searchsorted(key, key + d_row * wide + d_col, "right") - low
            a = np.repeat(np.arange(len(key)), n)
            b = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out.append((order[a].astype(np.int32), order[b].astype(np.int32), times[a] * times[b]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, codes, inside, key = given.value
        a, b, w = couples(key)
        alike = lambda x: int(((x[inside][a] == x[inside][b]) & (x[inside][a] >= 0)) @ w)
        for pdf in batches:
            for k in pdf["id"] if len(a) else ():
                first, last = 1 + k * chunk, min((k + 1) * chunk, replicates)
                counts = [(0, alike(codes))] if k == 0 else []
                drawn = np.concatenate([uniforms(seed, first, last, ids[lo : lo + 8192].to_pylist()) for lo in range(0, len(ids), 8192)], axis=1)
                for r, draw in enumerate(drawn, first):
                    dealt = np.empty_like(codes)
                    dealt[np.argsort(draw, kind="stable")] = codes  # the n-th as they are drawn gets the label of the n-th by name
                    counts.append((r, alike(dealt)))
                yield pd.DataFrame(counts, columns=["replicate", "n"])

    return spark.range(0, max(chunks, 1), 1, max(1, min(chunks, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(run, "replicate int, n long")


def _dealt_counts(wells: DataFrame, total: int, reach: int, replicates: int, seed: int) -> DataFrame:
    """As :func:`_held_counts`, for any number of wells: all replicates are sorted together, in ranges."""
    # the n-th of the wells as they are drawn gets the label of the n-th by name; both are numbered over all replicates at once
    labels = numbered(wells.select("_id", "_l"), ["_id"], "_n").select("_n", "_l")
    drawn = materialize(repeated_draws(wells.drop("_l"), key="_id", replicates=replicates, seed=seed), "draws")
    dealt = numbered(drawn, ["replicate", "draw", "_id"], "_n").withColumn("_n", F.col("_n") % max(total, 1))
    nulls = dealt.join(labels.hint("merge"), "_n").select("plate", "row", "col", "replicate", "_l")
    every = wells.select("plate", "row", "col", F.lit(0).alias("replicate"), "_l").unionByName(nulls).dropna(subset=["plate", "row", "col"])

    def alike(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = _alike_neighbours(pdf, reach, replicates + 1)
        return pd.DataFrame({"replicate": np.arange(len(counts), dtype=np.int32), "n": counts})

    return every.groupBy("plate").applyInPandas(alike, "replicate int, n long").groupBy("replicate").agg(F.sum("n").alias("n"))


def adjacency_enrichment(wells: DataFrame, label: str, *, reach: int = 2, replicates: int = 5000, seed: int = 0) -> DataFrame:
    """One row: couples of neighbours that share the label, their mean over permuted labels, z and p = k / n."""
    wells = wells.select("plate", "row", "col", F.col(label).alias("_l"), F.concat_ws(":", "plate", "row", "col").alias("_id"))
    wells = materialize(wells, "wells")
    total = wells.count()
    held = _held_counts(wells, reach, replicates, seed) if total <= HELD_WELLS else None
    counts = _dealt_counts(wells, total, reach, replicates, seed) if held is None else held
    real, chance = F.max(F.when(F.col("replicate") == 0, F.col("n"))), F.when(F.col("replicate") > 0, F.col("n"))
    out = counts.agg(real.alias("observed"), F.avg(chance).alias("null_mean"), F.stddev_pop(chance).alias("null_sd"), F.sort_array(F.collect_list(chance)).alias("_n"))
    share = F.try_divide(F.size(F.filter("_n", lambda x: x >= F.col("observed"))), F.size("_n"))
    return out.select("observed", "null_mean", "null_sd", F.try_divide(F.col("observed") - F.col("null_mean"), "null_sd").alias("z"), share.alias("p_value"))


def shifted(cells: DataFrame, d_row: Column | int, d_col: Column | int) -> DataFrame:
    """Cells as seen from wells ``d_row``, ``d_col`` before them."""
    return cells.withColumns({"row": F.col("row") - d_row, "col": F.col("col") - d_col})


def offset_control(left: DataFrame, right: DataFrame, value: str, offsets: list[tuple[int, int]]) -> DataFrame:
    """(d_row, d_col, n, r): correlation of two plates when the second is read at an offset; the true one is (0, 0)."""
    listed = F.explode(F.array(*[F.struct(F.lit(r).alias("d_row"), F.lit(c).alias("d_col")) for r, c in offsets])).alias("o")
    moved = right.select("plate", "row", "col", F.col(value).alias("_y"), listed)
    moved = shifted(moved, F.col("o.d_row"), F.col("o.d_col"))
    both = left.select("plate", "row", "col", F.col(value).alias("_x")).join(moved, ["plate", "row", "col"])
    return both.groupBy("o.d_row", "o.d_col").agg(F.count("*").alias("n"), correlation("_x", "_y").alias("r"))


def candidate_transforms(spark, rows: int = 16, cols: int = 24) -> DataFrame:
    """(transform, row, col, to_row, to_col): identity, flips, the half turn, and shifts by one or two wells that stay on the plate."""
    cells = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    r, c = F.col("row"), F.col("col")
    named = [("identity", r, c), ("flip_rows", rows - 1 - r, c), ("flip_cols", r, cols - 1 - c), ("half_turn", rows - 1 - r, cols - 1 - c)]
    named += [(f"shift_{a}_{b}", r + a, c + b) for a in range(-2, 3) for b in range(-2, 3) if (a, b) != (0, 0)]
    # quadrants of a 384-well plate exchanged: even and odd rows, even and odd columns
    named += [("swap_odd_rows", r + F.when(r % 2 == 0, 1).otherwise(-1), c), ("swap_odd_cols", r, c + F.when(c % 2 == 0, 1).otherwise(-1))]
    moves = F.explode(F.array(*[F.struct(F.lit(n).alias("transform"), a.cast("int").alias("to_row"), b.cast("int").alias("to_col")) for n, a, b in named])).alias("m")
    out = cells.select("row", "col", moves).select("m.transform", "row", "col", "m.to_row", "m.to_col")
    return out.filter(F.col("to_row").between(0, rows - 1) & F.col("to_col").between(0, cols - 1))


def transform_support(claimed: DataFrame, found: DataFrame, transforms: DataFrame, *, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(by, transform, n, supported, share): how many wells hold, at their transformed place, the label that was claimed there.

    ``claimed`` and ``found``: row, col, label.  All transforms are scored on the wells
    that every transform keeps on the plate, so their shares compare."""
    kinds = transforms.select("transform").distinct().count()
    common = transforms.groupBy("row", "col").agg(F.count("*").alias("_k")).filter(F.col("_k") == kinds).select("row", "col")
    moved = transforms.join(common, ["row", "col"], "left_semi").join(found.select(*by, "row", "col", F.col("label").alias("_f")), ["row", "col"])
    target = claimed.select(*by, F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("label").alias("_c"))
    both = moved.join(target, [*by, "to_row", "to_col"])
    return both.groupBy(*by, "transform").agg(F.count("*").alias("n"), F.count_if(F.col("_f") == F.col("_c")).alias("supported")).withColumn("share", F.col("supported") / F.col("n"))


def transform_search(claimed: DataFrame, found: DataFrame, transforms: DataFrame, *, replicates: int = 100, seed: int = 0, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Support of each transform with its family-wise p: how often the best transform of permuted labels does as well.

    With ``by`` (``["plate"]``) every group is a plate of its own, with labels permuted within it."""
    kinds = transforms.select("transform").distinct().count()
    common = transforms.groupBy("row", "col").agg(F.count("*").alias("_k")).filter(F.col("_k") == kinds).select("row", "col")
    moves = transforms.join(common, ["row", "col"], "left_semi").toPandas()  # wells of a plate times transforms
    moves["_t"], names = pd.factorize(moves["transform"], sort=True)
    moves = moves[["row", "col", "to_row", "to_col", "_t"]]
    keys = list(by) or ["_all"]
    sides = [(side if by else side.withColumn("_all", F.lit(0))).select(*keys, "row", "col", "label").dropna(subset=keys) for side in (claimed, found)]
    types = dict(sides[1].dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "transform string, n long, supported long, share double, family_p double"])

    def search(plate: pd.DataFrame) -> pd.DataFrame:
        """One plate: labels are permuted among all its wells, also those that no transform keeps on it."""
        columns = schema.replace("`", "").split(", ")
        here, there = plate[plate["_found"]], plate[~plate["_found"]]
        if here.empty or there.empty:
            return pd.DataFrame(columns=[c.split(" ")[0] for c in columns])
        ids = [":".join(str(int(x)) for x in rc if not pd.isna(x)) for rc in zip(here["row"], here["col"], strict=True)]
        code = pd.factorize(pd.concat((here["label"], there["label"])))[0]
        own, claim = code[: len(here)], code[len(here) :]
        by_id = np.array(sorted(range(len(ids)), key=ids.__getitem__), np.int64)
        rank = np.empty(len(ids), np.int64)
        rank[by_id] = np.arange(len(ids))
        labels = np.empty((replicates + 1, len(ids)), np.int64)
        labels[0] = own
        for r, u in enumerate(uniforms(seed, 1, replicates, ids) if ids else (), 1):
            labels[r, np.lexsort((rank, u))] = own[by_id]
        both = moves.merge(here[["row", "col"]].assign(_h=np.arange(len(here))).dropna(), on=["row", "col"])
        both = both.merge(there[["row", "col"]].set_axis(["to_row", "to_col"], axis=1).assign(_c=np.arange(len(there))).dropna(), on=["to_row", "to_col"])
        if both.empty:
            return pd.DataFrame(columns=[c.split(" ")[0] for c in columns])
        t, h, c = (both[k].to_numpy() for k in ("_t", "_h", "_c"))
        n = np.bincount(t, minlength=len(names))
        k = np.stack([np.bincount(t, (x[h] == claim[c]) & (claim[c] >= 0), len(names)) for x in labels]).astype(np.int64)
        best = k[1:].max(axis=1)
        some = np.flatnonzero(n)
        p = ((best[:, None] >= k[0, some]).sum(axis=0) + 1) / (replicates + 1)
        out = pd.DataFrame({"transform": np.asarray(names)[some], "n": n[some], "supported": k[0, some], "share": k[0, some] / n[some], "family_p": p})
        return out.assign(**{q: here[q].iloc[0] for q in keys})[[c.split(" ")[0] for c in columns]]

    both_ = sides[0].withColumn("_found", F.lit(False)).unionByName(sides[1].withColumn("_found", F.lit(True)))
    out = both_.groupBy(*keys).applyInPandas(search, schema)
    return out if by else out.drop("_all")


def locality(events: DataFrame, homes: DataFrame, wells: DataFrame, *, draws: int = 200, seed: int = 0) -> DataFrame:
    """One row: mean distance of events to the nearest home of their label, against events put into random wells.

    ``events`` and ``homes``: plate, row, col, label; ``wells``: all wells of a plate (row, col), numbered by hash order for the draws."""
    place = F.row_number().over(Window.orderBy("row", "col")) - 1
    numbered = wells.select("row", "col").distinct().withColumn("_w", place)  # the wells of a plate
    n = numbered.count()
    keyed = events.withColumn("_e", F.concat_ws(":", "plate", "row", "col", "label"))
    drawn = keyed.select("plate", "label", "_e", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    drawn = drawn.withColumn("_w", F.floor(uniform(seed, "draw", "_e") * n).cast("int")).join(numbered, "_w").select("plate", "label", "_e", "draw", "row", "col")
    every = keyed.select("plate", "label", "_e", F.lit(0).alias("draw"), "row", "col").unionByName(drawn)
    near = every.join(homes.select("plate", "label", F.col("row").alias("_r"), F.col("col").alias("_c")), ["plate", "label"])
    far = F.sqrt((F.col("row") - F.col("_r")) * (F.col("row") - F.col("_r")) + (F.col("col") - F.col("_c")) * (F.col("col") - F.col("_c")))
    per = near.groupBy("draw", "_e").agg(F.min(far).alias("d")).groupBy("draw").agg(F.avg("d").alias("d"))
    out = per.agg(F.max(F.when(F.col("draw") == 0, F.col("d"))).alias("observed"), F.avg(F.when(F.col("draw") > 0, F.col("d"))).alias("null_mean"), F.collect_list(F.when(F.col("draw") > 0, F.col("d"))).alias("_n"))
    return out.select("observed", "null_mean", (F.size(F.filter("_n", lambda x: x <= F.col("observed"))) / F.size("_n")).alias("p_value"))


def univariate_screen(pairs: DataFrame, features: list[str], target: str, *, sign_threshold: float = 1.0) -> DataFrame:
    """(feature, n, pearson_r, spearman_rho, sign_accuracy) of each feature on its own, from one long table."""
    long_ = pairs.select(F.col(target).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in features]).unpivot(["_y"], features, "feature", "_x")
    long_ = long_.filter("_x IS NOT NULL AND _y IS NOT NULL")
    big = F.abs("_y") > sign_threshold
    base = long_.groupBy("feature").agg(F.count("*").alias("n"), correlation("_x", "_y").alias("pearson_r"), F.avg(F.when(big, (F.signum("_x") == F.signum("_y")).cast("double"))).alias("sign_accuracy"))
    return base.join(spearman(long_, "_x", "_y", ["feature"]).drop("n"), "feature")


def join_test(distances: DataFrame, jaccard: DataFrame, mapping: DataFrame, *, replicates: int = 200, seed: int = 0) -> DataFrame:
    """One row: Spearman correlation of sequence distance and genome similarity under the mapping, against permuted mappings.

    ``distances``: strain a, b, d; ``jaccard``: genome a, b, jaccard (a < b); ``mapping``: strain, genome."""
    named = mapping.select(F.col("strain"), "genome")
    dealt = permuted_labels(named, key="strain", label="genome", replicates=replicates, seed=seed).select("strain", "genome", "replicate")
    every = named.withColumn("replicate", F.lit(0)).unionByName(dealt)
    side = lambda k: every.select("replicate", F.col("strain").alias(k), F.col("genome").alias(f"g{k}"))
    placed = distances.join(side("a"), "a").join(side("b"), ["replicate", "b"])
    placed = placed.withColumns({"_1": F.least("ga", "gb"), "_2": F.greatest("ga", "gb")})
    both = placed.join(jaccard.select(F.col("a").alias("_1"), F.col("b").alias("_2"), "jaccard"), ["_1", "_2"])
    rho = spearman(both, "d", "jaccard", ["replicate"])
    null = F.when(F.col("replicate") > 0, F.col("spearman_rho"))
    out = rho.agg(F.max(F.when(F.col("replicate") == 0, F.col("spearman_rho"))).alias("rho"), F.avg(null).alias("null_mean"), F.stddev_pop(null).alias("null_sd"))
    z = F.try_divide(F.abs(F.col("rho") - F.col("null_mean")), "null_sd")
    return out.withColumn("z", z).withColumn("passed", F.coalesce((z > 3) & (F.abs("rho") > 0.15), F.lit(False)))


def confusable(barcodes: DataFrame, combinations: DataFrame, edits: int) -> DataFrame:
    """(sample, n): other samples whose barcodes lie within twice the edits on both ends.

    ``barcodes``: a, b, d of all couples, a barcode with itself included; ``combinations``: sample, fwd, rev."""
    near = barcodes.filter(F.col("d") <= 2 * edits)
    c = combinations
    other = c.select(F.col("sample").alias("other"), F.col("fwd").alias("f2"), F.col("rev").alias("r2"))
    hit = c.join(near.select(F.col("a").alias("fwd"), F.col("b").alias("f2")), "fwd").join(other, "f2").join(near.select(F.col("a").alias("rev"), F.col("b").alias("r2")), ["rev", "r2"])
    counts = hit.filter("sample <> other").groupBy("sample").agg(F.count("*").alias("n"))
    return c.select("sample").join(counts, "sample", "left").na.fill(0, ["n"])
