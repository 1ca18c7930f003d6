"""Plate-reader files: free-text headers over stacked grids."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.sequence import quadrant, well_label

OD600_NM = 600
SHAPES = {12: 8, 24: 16}
GRID = "path string, grid int, wavelength int, row int, col int, value double"


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, value) with latin-1 bytes decoded."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "ISO-8859-1").alias("value"))


def headers(files: DataFrame) -> DataFrame:
    """(path, test_name, date, time, id1, plate): ``plate`` is a numeric ID1, else null."""
    field = lambda k: F.nullif(F.trim(F.regexp_extract("value", rf"(?m){k}:[ \t]*([^\r\n,;]*)", 1)), F.lit(""))
    out = files.select("path", field("Testname").alias("test_name"), field("Date").alias("date"), field("Time").alias("time"), field("ID1").alias("id1"))
    return out.withColumn("plate", F.col("id1").try_cast("int"))


def parse_grids(text: str) -> list[tuple[int, int | None, int, int, float | None]]:
    """(grid, wavelength, row, col, value) of stacked 8 x 12 or 16 x 24 blocks.

    A block follows its ``Wavelength:`` line if it has one; unreadable cells are
    None; rows of another width end a block, an incomplete block is dropped."""
    out, block, wavelength, grid = [], [], None, 0
    for line in [*text.splitlines(), ""]:
        if m := re.search(r"Wavelength:\s*(\d+)", line):
            wavelength, block = int(m[1]), []
            continue
        cells = [c.strip() for c in re.split(r"[,;\t]", line.strip().rstrip(",;\t"))]
        if cells and re.fullmatch(r"[A-P]", cells[0]):
            cells = cells[1:]
        numeric = sum(bool(re.fullmatch(r"-?\d+(\.\d+)?([eE]-?\d+)?", c)) for c in cells)
        if len(cells) not in SHAPES or numeric == 0 or (block and len(block[0]) != len(cells)) or cells == [str(k) for k in range(1, len(cells) + 1)]:
            block = block if not line.strip() else []
            continue
        values = []
        for c in cells:
            try:
                values.append(float(c))
            except ValueError:
                values.append(None)
        block.append(values)
        if len(block) == SHAPES[len(cells)]:
            out += [(grid, wavelength, r, c, v) for r, row in enumerate(block) for c, v in enumerate(row)]
            grid, block = grid + 1, []
    return out


def grids(files: DataFrame) -> DataFrame:
    """(path, grid, wavelength, row, col, value) of all grids; rows and columns from 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, value in zip(pdf["path"], pdf["value"], strict=True):
                rows = parse_grids(value)
                yield pd.DataFrame([(path, *r) for r in rows], columns=["path", "grid", "wavelength", "row", "col", "value"]).astype({"wavelength": "Int32"})

    return files.select("path", "value").mapInPandas(run, GRID)


def pick_wavelength(cells: DataFrame, wavelength: int = OD600_NM) -> DataFrame:
    """Cells of the grid nearest to a wavelength (exact first, ties to the earlier), the first grid where none is named."""
    far = F.coalesce(F.abs(F.col("wavelength") - wavelength), F.lit(1 << 30))
    chosen = cells.groupBy("path").agg(F.min_by("grid", F.struct(far.alias("far"), "grid")).alias("grid"))
    return cells.join(chosen, ["path", "grid"], "left_semi")


def to_long(cells: DataFrame, value_name: str = "od") -> DataFrame:
    return cells.select("path", well_label(F.col("row"), F.col("col") + 1).alias("well"), "row", "col", F.col("value").alias(value_name))


def load_folder(spark: SparkSession, path: str, wavelength: int = OD600_NM) -> DataFrame:
    """(plate, well, od) of a folder, plates from numeric ID1; raises when a plate and well occurs twice."""
    files = read_files(spark, path)
    od = to_long(pick_wavelength(grids(files), wavelength)).join(headers(files).select("path", "plate"), "path").filter("plate IS NOT NULL")
    if not od.groupBy("plate", "well").count().filter("count > 1").isEmpty():
        raise ValueError("a plate was read twice")
    return od.select("plate", "well", "od")


def spectrum_table(cells: DataFrame, plate: Column, wavelengths: list[int]) -> DataFrame:
    """(plate, well) with a column for each known wavelength."""
    long_ = cells.withColumn("plate", plate).withColumn("well", well_label(F.col("row"), F.col("col") + 1))
    return long_.groupBy("plate", "well").pivot("wavelength", wavelengths).agg(F.avg("value"))


def od_cycles(cells: DataFrame) -> DataFrame:
    """(path, cycle, well, od): stacked grids as cycles of a growth curve."""
    return cells.select("path", F.col("grid").alias("cycle"), well_label(F.col("row"), F.col("col") + 1).alias("well"), F.col("value").alias("od"))


def assemble_384(cells: DataFrame, row_offset: Column, col_offset: Column) -> DataFrame:
    """96-well cells at their places in the 384-well plate of their quadrant."""
    r, c = quadrant(F.col("row"), F.col("col"), row_offset, col_offset)
    return cells.withColumns({"row": r, "col": c})


def run_metadata(cells: DataFrame) -> DataFrame:
    """(path, n_grids, format, first_mean, last_mean) of each file."""
    last = F.max("grid").over(Window.partitionBy("path"))
    return cells.withColumn("_l", last).groupBy("path").agg(
        F.count_distinct("grid").alias("n_grids"), F.when(F.max("col") > 11, 384).otherwise(96).alias("format"), F.avg(F.when(F.col("grid") == 0, F.col("value"))).alias("first_mean"), F.avg(F.when(F.col("grid") == F.col("_l"), F.col("value"))).alias("last_mean")
    )


def blanks_of(cells: DataFrame, occupied: DataFrame, plate: str = "plate") -> DataFrame:
    """(plate, blank): median of the wells that the layout does not use.  ``occupied``: plate, well."""
    return cells.join(occupied.select(plate, "well"), [plate, "well"], "left_anti").groupBy(plate).agg(F.median("od").alias("blank"))
