"""Reads laid against an anchor sequence, as a matrix: votes, alleles and haplotypes are array operations on it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd

from .alignment import align, spans
from .sequence import IUPAC

#: Limits of alleles (fixed values).
HET_MIN_READS, HET_SCAN_READS, HET_MAF, HAP_MIN_FRAC, PROFILE_EDGE = 30, 200, 0.20, 0.10, 15
BASES = np.frombuffer(b"ACGT", np.uint8)
GAP = ord("-")
#: Ambiguity code of every couple of bases.
CODE_OF = {frozenset(v): k for k, v in IUPAC.items()}


def letters_of(seq: str) -> np.ndarray:
    return np.frombuffer(seq.encode("latin-1"), np.uint8)


def text_of(letters: np.ndarray) -> str:
    return letters.astype(np.uint8).tobytes().decode("latin-1")


@dataclass(frozen=True)
class Pileup:
    """``letters[r, p]``: what read r shows at position p of ``anchor`` (``-``: a gap); ``blocks``: slot, block, a row for each
    run of letters that a read has before the anchor position ``slot`` and the anchor lacks."""

    anchor: np.ndarray
    letters: np.ndarray
    blocks: pd.DataFrame

    @classmethod
    def of(cls, anchor: str, reads: list[str]) -> Pileup:
        letters = np.full((len(reads), len(anchor)), GAP, np.uint8)
        blocks = []
        for row, read in zip(letters, reads, strict=True):
            own = letters_of(read)
            size, kind, here, there = spans(align(read, anchor)[0])
            for n, i, j in zip(*(x[np.isin(kind, ("=", "X"))] for x in (size, here, there)), strict=True):
                row[j : j + n] = own[i : i + n]
            blocks += [(j, read[i : i + n]) for n, i, j in zip(*(x[kind == "I"] for x in (size, here, there)), strict=True)]
        return cls(letters_of(anchor), letters, pd.DataFrame(blocks, columns=["slot", "block"]))

    def consensus(self, insertion_rule: str = "block") -> str:
        """The most frequent letter of each column (of equals the one seen in the earliest read), gaps left out, and insertions
        that more than half of the reads share: the same block (``block``), or any, the most frequent standing in (``any``)."""
        reads = len(self.letters)
        kinds = np.unique(self.letters)
        shows = self.letters[None] == kinds[:, None, None]
        votes = shows.sum(axis=1) * (reads + 1) - np.where(shows.any(axis=1), shows.argmax(axis=1), reads)
        chosen = kinds[votes.argmax(axis=0)] if len(kinds) else np.zeros(0, np.uint8)
        pieces = [chr(x) if x != GAP else "" for x in chosen.tolist()] + [""]
        if len(self.blocks):
            tally = self.blocks.groupby(["slot", "block"], sort=False).size()
            top = tally.groupby(level="slot").idxmax()
            carried = tally.groupby(level="slot").max() if insertion_rule == "block" else tally.groupby(level="slot").sum()
            for slot in carried.index[2 * carried > reads]:
                pieces[slot] = top[slot][1] + pieces[slot]
        return "".join(pieces)

    @cached_property
    def counts(self) -> np.ndarray:
        """(positions, 4): reads with A, C, G and T."""
        return (self.letters[:, :, None] == BASES).sum(axis=0)

    def minor_alleles(self, maf: float = HET_MAF) -> list[tuple[int, float, str]]:
        """(position, share, base) of substitutions that ``maf`` of the reads of a well-covered position carry; of
        equals the first base.  PROFILE_EDGE positions on either side are left out."""
        coverage = self.counts.sum(axis=1)
        others = np.where(self.anchor[:, None] == BASES, -1, self.counts)
        share = others.max(axis=1, initial=0) / np.maximum(coverage, 1)
        inner = np.arange(len(self.anchor))
        inner = (inner >= PROFILE_EDGE) & (inner < len(self.anchor) - PROFILE_EDGE)
        at = np.flatnonzero(inner & (coverage >= 0.8 * len(self.letters)) & (share >= maf))
        return [(p, round(float(share[p]), 3), "ACGT"[others[p].argmax()]) for p in at.tolist()]


def het_sites(anchor: str, reads: list[str], maf: float = HET_MAF) -> list[tuple[int, float, str]] | None:
    """:meth:`Pileup.minor_alleles` of the first HET_SCAN_READS reads; None below HET_MIN_READS."""
    return Pileup.of(anchor, reads[:HET_SCAN_READS]).minor_alleles(maf) if len(reads) >= HET_MIN_READS else None


def coded(anchor: str, sites: list[tuple[int, float, str]]) -> str:
    """The anchor with the code of both alleles at each site that has a plain base."""
    out = letters_of(anchor).copy()
    for at, _, base in sites:
        both = frozenset((anchor[at], base))
        out[at] = ord(CODE_OF[both]) if anchor[at] in "ACGT" and len(both) == 2 else out[at]
    return text_of(out)


def haplotypes(anchor: str, sites: list[tuple[int, float, str]], reads: list[str], min_frac: float = HAP_MIN_FRAC) -> list[tuple[str, float, str]]:
    """(sequence, share, pattern) of operon types, most frequent first; without sites the anchor alone.

    A read calls a site 0 (the anchor's base) or 1 (the other allele).  Patterns are those of
    ``min_frac`` of the reads that call all sites; reads that call at least half of them
    then count for the pattern they contradict least, of equals the more frequent one."""
    if not sites:
        return [(anchor, 1.0, "")]
    at = np.array([p for p, _, _ in sites])
    other = np.array([ord(b) for _, _, b in sites], np.uint8)
    shown = Pileup.of(anchor, reads).letters[:, at]
    calls = np.where(shown == letters_of(anchor)[at], 0, np.where(shown == other, 1, -1))
    whole = calls[(calls >= 0).all(axis=1)]
    kinds, first, size = np.unique(whole, axis=0, return_index=True, return_counts=True)
    order = np.lexsort((first, -size))
    kinds = kinds[order][size[order] >= min_frac * len(whole)]
    if not len(kinds):
        return [(anchor, 1.0, "0" * len(at))]
    some = calls[2 * (calls >= 0).sum(axis=1) >= len(at)]
    against = ((some[:, None, :] >= 0) & (some[:, None, :] != kinds[None])).sum(axis=2)
    tally = np.bincount(against.argmin(axis=1), minlength=len(kinds))
    share = tally / max(tally.sum(), 1)
    sequences = np.tile(letters_of(anchor), (len(kinds), 1))
    sequences[:, at] = np.where(kinds == 1, other, sequences[:, at])
    return [(text_of(sequences[k]), float(share[k]), "".join(map(str, kinds[k]))) for k in np.argsort(-share, kind="stable")]


def position_map(a: str, b: str) -> dict[int, int]:
    """Position in a -> position in b over paired columns of the global alignment."""
    size, kind, here, there = spans(align(a, b)[0])
    paired = np.isin(kind, ("=", "X"))
    step = np.concatenate([np.arange(n) for n in size[paired]]) if paired.any() else np.zeros(0, int)
    return dict(zip((np.repeat(here[paired], size[paired]) + step).tolist(), (np.repeat(there[paired], size[paired]) + step).tolist(), strict=True))
