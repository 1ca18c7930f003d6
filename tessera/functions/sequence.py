"""Sequence expressions that Catalyst can run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases and the ambiguity codes of sets of them (fixed values).
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
BIT = {"A": 1, "C": 2, "G": 4, "T": 8}
MASK = {code: sum(BIT[b] for b in bases) for code, bases in IUPAC.items()}
COMPLEMENT = ("ACGTRYSWKMBDHVNacgtryswkmbdhvn", "TGCAYRSWMKVHDBNtgcayrswmkvhdbn")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, *COMPLEMENT))


def edit_distance(a: Column, b: Column, limit: int | None = None) -> Column:
    """Global edits; with a ``limit``, -1 beyond it."""
    return F.levenshtein(a, b) if limit is None else F.levenshtein(a, b, limit)


def norm_edit_distance(a: Column, b: Column) -> Column:
    """Edits over the longer length; null if both are empty."""
    return F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b)))


def identity(a: Column, b: Column) -> Column:
    return 1 - norm_edit_distance(a, b)


def oriented(seq: Column, anchor: Column) -> Column:
    """The strand nearer to the anchor, the given one on ties."""
    other = reverse_complement(seq)
    return F.when(F.levenshtein(seq, anchor) <= F.levenshtein(other, anchor), seq).otherwise(other)


def base_masks(seq: Column) -> Column:
    """Four-bit masks of the bases that each code stands for; 0 for gaps and unknown letters."""
    codes = F.create_map(*[F.lit(x) for pair in MASK.items() for x in pair])
    return F.transform(F.array_remove(F.split(F.upper(seq), ""), ""), lambda c: F.coalesce(F.element_at(codes, c), F.lit(0)))


def mask_mismatches(a: Column, b: Column, min_overlap: int = 900) -> Column:
    """Columns of two aligned mask arrays, both covered, that share no base; null below the overlap."""
    both = F.zip_with(a, b, lambda x, y: F.when((x > 0) & (y > 0), F.when(x.bitwiseAND(y) == 0, 1).otherwise(0)))
    seen = F.filter(both, lambda d: d.isNotNull())
    return F.when(F.size(seen) >= min_overlap, F.aggregate(seen, F.lit(0), lambda s, d: s + d))


def fill_ambiguity(consensus: Column, sites: Column) -> Column:
    """The consensus with each site's base and alternative written as their code.

    ``sites``: array of structs with ``pos`` (from 0) and ``alt``; sites whose base is
    the alternative, or no plain base, stay as they are."""
    code = {frozenset(v): k for k, v in IUPAC.items() if len(v) == 2}
    pairs = {x + y: code[frozenset((x, y))] for x in "ACGT" for y in "ACGT" if x != y}
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    letters = F.array_remove(F.split(consensus, ""), "")

    def letter(c: Column, i: Column) -> Column:
        alt = F.array_max(F.transform(sites, lambda s: F.when(s["pos"] == i, s["alt"])))
        return F.coalesce(F.element_at(table, F.concat(c, alt)), c)

    return F.array_join(F.transform(letters, letter), "")


def header_label(header: Column) -> Column:
    """Name of a FASTA record: the first token, up to ``|``, without a ``_consensus`` suffix."""
    return F.regexp_replace(F.regexp_extract(header, r"^>?([^|\s]+)", 1), "_consensus$", "")


def assembly_accession(name: Column) -> Column:
    """``GCF_`` or ``GCA_`` accession with version at the start of a name; the name itself without one."""
    found = F.regexp_extract(name, r"(GC[AF]_\d+\.\d+)", 1)
    return F.when(found != "", found).otherwise(name)


def match_class(header: Column) -> Column:
    """Two-letter class of how both barcodes of a read were matched (H exact, h with edits)."""
    return F.nullif(F.regexp_extract(header, r"\|([Hh]{2})\(", 1), F.lit(""))


def read_quality(header: Column) -> Column:
    """Mean quality from the header tag ``qs:f:``; null without it."""
    return F.nullif(F.regexp_extract(header, r"qs:f:([0-9.]+)", 1), F.lit("")).cast("double")


def sample_id(plate: Column, well: Column) -> Column:
    return F.format_string("Plate%02d_%s", plate.cast("int"), well)


def well_row(well: Column) -> Column:
    """Row from 0 of a label like ``B07``; null if it is none of a 384-well plate."""
    return F.when(_is_well(well), F.ascii(F.upper(well)) - 65)


def well_col(well: Column) -> Column:
    """Column from 1 of a well label."""
    return F.when(_is_well(well), F.regexp_extract(well, r"(\d+)$", 1).cast("int"))


def _is_well(well: Column) -> Column:
    return F.coalesce(F.rlike(well, F.lit(r"^[A-Pa-p]0*([1-9]|1\d|2[0-4])$")), F.lit(False))


def well_label(row: Column, col: Column) -> Column:
    return F.concat(F.chr(row + 65), col.cast("string"))


def quadrant(row: Column, col: Column, row_offset: Column, col_offset: Column) -> tuple[Column, Column]:
    """Place in a 384-well plate of a 96-well position (both from 0) of the quadrant with these offsets."""
    return row * 2 + row_offset, col * 2 + col_offset
