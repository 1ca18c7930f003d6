"""Nearest references, rank retrieval, twins and label verdicts by edit distance.

Without a limit, a stated set of references is compared with every query: a dimension
of a few hundred sequences, broadcast after a check of its bytes.  With a limit on the
distance, couples are found by equi-joins on shared segments, whatever the tables' sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.sequence import norm_edit_distance
from tessera.storage import materialize

#: Bytes of a table that is sent to every task.
MAX_BROADCAST = 64 << 20


def checked(df: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """``df``, to be broadcast; an error if its rows have more than ``most`` bytes as text."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    if size > most:
        raise ValueError(f"{size} bytes are too many to send to every task ({most}); give a distance limit or split the references")
    return F.broadcast(df)


def _near(q: DataFrame, r: DataFrame, limit: int) -> DataFrame:
    """Couples (query, _q, ref, _r) that may be within ``limit`` edits: a text cut into ``limit`` + 1 segments keeps
    one of them whole, at most ``limit`` places off, in any text within ``limit`` edits."""
    parts = limit + 1
    begin = lambda length, i: F.floor(i * length / parts).cast("int")
    pieces = F.sequence(F.lit(0), F.lit(limit))
    own = F.transform(pieces, lambda i: F.struct(F.length("_r").alias("n"), i.alias("i"), F.substring(F.col("_r"), begin(F.length("_r"), i) + 1, begin(F.length("_r"), i + 1) - begin(F.length("_r"), i)).alias("part")))
    left = r.select("ref", "_r", F.explode(own).alias("k")).select("ref", "_r", "k.*")
    n = F.length("_q")
    asked = q.select("query", "_q", F.explode(F.sequence(F.greatest(n - limit, F.lit(0)), n + limit)).alias("n")).select("query", "_q", "n", F.explode(pieces).alias("i"))
    start, size = begin(F.col("n"), F.col("i")), begin(F.col("n"), F.col("i") + 1) - begin(F.col("n"), F.col("i"))
    last = F.least(start + limit, F.length("_q") - size)
    first = F.greatest(start - limit, F.lit(0))
    places = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    right = asked.withColumn("_size", size).withColumn("part", F.explode(F.array_distinct(F.transform(places, lambda p: F.substring(F.col("_q"), p + 1, F.col("_size")))))).drop("_size")
    return right.join(left, ["n", "i", "part"]).select("query", "_q", "ref", "_r").distinct()


def distances(queries: DataFrame, references: DataFrame, *, limit: int | None = None) -> DataFrame:
    """(query, ref, bp, dist) of every query against every reference: ``name, seq`` of each.

    With ``limit``, only pairs within that many edits.  Null sequences are near to nothing."""
    q = queries.select(F.col("name").alias("query"), F.col("seq").alias("_q"))
    r = references.select(F.col("name").alias("ref"), F.col("seq").alias("_r"))
    if limit is None:
        both = q.join(checked(r), F.lit(True)).withColumn("bp", F.levenshtein("_q", "_r"))
        return both.select("query", "ref", "bp", norm_edit_distance(F.col("_q"), F.col("_r")).alias("dist"))
    both = _near(q, r, limit).withColumn("bp", F.levenshtein("_q", "_r", limit)).filter("bp >= 0")
    return both.select("query", "ref", "bp", F.try_divide("bp", F.greatest(F.length("_q"), F.length("_r"))).alias("dist"))


def nearest(found: DataFrame) -> DataFrame:
    """(query, best, bp, ties): the nearest reference, of equals the first by name, and all at that distance."""
    w = Window.partitionBy("query")
    at_best = found.withColumn("_m", F.min("bp").over(w)).filter("bp = _m")
    return at_best.groupBy("query").agg(F.min("ref").alias("best"), F.first("bp").alias("bp"), F.sort_array(F.collect_list("ref")).alias("ties"))


def best_hits(found: DataFrame, k: int = 3) -> DataFrame:
    """The k nearest references of each query with their rank."""
    place = F.row_number().over(Window.partitionBy("query").orderBy("dist", "ref"))
    return found.withColumn("hit", place).filter(F.col("hit") <= k)


def attribution(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(query, expected, best, best_dist, runner_up, margin, self_rank, self_dist) against all references."""
    w = Window.partitionBy("query").orderBy("dist", "ref")
    ranked = found.withColumns({"_k": F.row_number().over(w), "_r": F.rank().over(Window.partitionBy("query").orderBy("dist"))}).join(expected, "query")
    own = F.col("ref") == F.col("expected")
    out = ranked.groupBy("query", "expected").agg(
        F.max(F.when(F.col("_k") == 1, F.col("ref"))).alias("best"),
        F.max(F.when(F.col("_k") == 1, F.col("dist"))).alias("best_dist"),
        F.max(F.when(F.col("_k") == 2, F.col("dist"))).alias("runner_up"),
        F.min(F.when(own, F.col("_r"))).alias("self_rank"),
        F.min(F.when(own, F.col("dist"))).alias("self_dist"),
    )
    return out.withColumn("margin", F.col("runner_up") - F.col("best_dist"))


def rank_summary(attributed: DataFrame) -> DataFrame:
    """One row: queries, share whose own reference is first, among five and ten, median rank."""
    r = F.col("self_rank")
    return attributed.agg(F.count("*").alias("n"), *[F.avg((r <= k).cast("double")).alias(f"top{k}") for k in (1, 5, 10)], F.median("self_rank").alias("median_rank"))


def twins(found: DataFrame, floor: float) -> DataFrame:
    """(name, twin) of references indistinguishable from each other, both ways, without itself; not transitive."""
    return found.filter((F.col("dist") <= floor) & (F.col("query") != F.col("ref"))).select(F.col("query").alias("name"), F.col("ref").alias("twin"))


def verdicts(found: DataFrame, expected: DataFrame, twin: DataFrame, references: DataFrame) -> DataFrame:
    """supported, ambiguous, contradicted or absent for each expected label, with distances and margin."""
    from .quality import identity_verdict

    best = best_hits(found, 1).select("query", F.col("ref").alias("best_hit"), F.col("dist").alias("best_dist"))
    own = found.select("query", F.col("ref").alias("expected"), F.col("dist").alias("own_dist"))
    known = references.select(F.col("name").alias("expected"), F.lit(True).alias("_known")).distinct()
    pairs = twin.select(F.col("name").alias("expected"), F.col("twin").alias("best_hit"), F.lit(True).alias("_twin"))
    n_twins = twin.groupBy(F.col("name").alias("expected")).agg(F.count("*").alias("n_twins"))
    out = expected.join(best, "query", "left").join(own, ["query", "expected"], "left").join(known, "expected", "left").join(pairs, ["expected", "best_hit"], "left").join(n_twins, "expected", "left")
    verdict = identity_verdict(F.col("best_hit"), F.col("expected"), F.coalesce("_known", F.lit(False)), F.col("_twin"))
    return out.select("query", "expected", "best_hit", "best_dist", "own_dist", (F.col("own_dist") - F.col("best_dist")).alias("margin"), F.coalesce("n_twins", F.lit(0)).alias("n_twins"), verdict.alias("verdict"))


def agreement(sequences: DataFrame) -> DataFrame:
    """Per strain and couple of sources the highest identity over their copies: ``strain, source, seq``.

    Distinct sequences are compared, and not at all for couples that share one (identity 1)."""
    sequences = materialize(sequences.select("strain", "source", "seq").distinct(), "sequences")
    a = sequences.select("strain", F.col("source").alias("source_a"), F.col("seq").alias("_a"))
    b = sequences.select("strain", F.col("source").alias("source_b"), F.col("seq").alias("_b"))
    couple = ["strain", "source_a", "source_b"]
    same = a.join(b.withColumnRenamed("_b", "_a"), ["strain", "_a"]).filter("source_a < source_b AND length(_a) > 0").select(*couple).distinct()
    which = sequences.select("strain", "source").distinct()
    couples = which.select("strain", F.col("source").alias("source_a")).join(which.select("strain", F.col("source").alias("source_b")), "strain").filter("source_a < source_b")
    both = couples.join(same, couple, "left_anti").join(a, ["strain", "source_a"]).join(b, ["strain", "source_b"])
    compared = both.groupBy(*couple).agg(F.max(1 - norm_edit_distance(F.col("_a"), F.col("_b"))).alias("identity"))
    return compared.unionByName(same.withColumn("identity", F.lit(1.0)))


def collapse_copies(copies: DataFrame, query: Column | None = None) -> DataFrame:
    """One sequence for each name: the copy nearest to ``query``, else the longest; ties to the first in order."""
    key = F.struct(-F.length("seq"), "seq") if query is None else F.struct(F.levenshtein(F.col("seq"), query), "seq")
    return copies.groupBy("name").agg(F.min_by("seq", key).alias("seq"), F.count("*").alias("n_copies"))


def separable(found: DataFrame, floor_bp: float) -> DataFrame:
    """One row: sequences that differ from all others by at least ``floor_bp``, and how many there are."""
    close = F.count_if((F.col("bp") < floor_bp) & (F.col("query") != F.col("ref")))
    return found.groupBy("query").agg(close.alias("_c")).agg(F.count_if(F.col("_c") == 0).alias("n_separable"), F.count("*").alias("n"))


def well_offsets(verdict: DataFrame, expected: str = "expected", best: str = "best_hit") -> DataFrame:
    """(d_row, d_col, n, frac) between claimed and matching wells of contradicted labels, most frequent first; five at most."""
    from tessera.functions.sequence import well_col, well_row

    e, b = F.col(expected), F.col(best)
    bad = verdict.filter("verdict = 'contradicted'").select((well_row(b) - well_row(e)).alias("d_row"), (well_col(b) - well_col(e)).alias("d_col")).dropna()
    counts = bad.groupBy("d_row", "d_col").agg(F.count("*").alias("n"))
    return counts.withColumn("frac", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).orderBy(F.desc("n"), "d_row", "d_col").limit(5)


def expected_candidates(wells: DataFrame, references: DataFrame) -> DataFrame:
    """(sample_id, strain, ordinal, seq): distinct expected strains of a well that have a reference, in order."""
    listed = F.array_distinct(F.filter(F.array("strain1", "strain2"), lambda s: s.isNotNull() & (s != "")))
    rows = wells.select("sample_id", F.posexplode(listed).alias("ordinal", "strain"))
    return rows.join(checked(references.select(F.col("name").alias("strain"), "seq")), "strain")


def constrained_mapping(reads: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per read the nearer of its well's candidates (first on ties), its distance and the margin to the other."""
    both = reads.select("sample_id", "read_id", F.col("seq").alias("_read")).join(candidates, "sample_id")
    d = both.withColumn("dist", norm_edit_distance(F.col("_read"), F.col("seq")))
    ranked = d.groupBy("sample_id", "read_id").agg(F.sort_array(F.collect_list(F.struct("dist", "ordinal", "strain"))).alias("c"))
    one, two = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    return ranked.select("sample_id", "read_id", one["strain"].alias("best_match_strain"), one["dist"].alias("best_dist"), (two["dist"] - one["dist"]).alias("margin_to_runner_up"), F.size("c").alias("n_candidates"))


def pair_reference_distances(pairs: DataFrame, references: DataFrame) -> DataFrame:
    """Distance of the references of every tested pair; a missing reference is flagged, not dropped."""
    ref = checked(references.select("name", "seq"))
    out = pairs.select("strain_a", "strain_b").distinct()
    for side in ("a", "b"):
        out = out.join(ref.select(F.col("name").alias(f"strain_{side}"), F.col("seq").alias(f"_{side}")), f"strain_{side}", "left")
    bp = F.levenshtein("_a", "_b")
    return out.select("strain_a", "strain_b", bp.alias("bp_dist"), norm_edit_distance(F.col("_a"), F.col("_b")).alias("norm_dist"), F.length("_a").alias("len_a"), F.length("_b").alias("len_b"), (F.col("_a").isNull() | F.col("_b").isNull()).alias("missing_reference"))
