"""Exact token counts of every prefix of a text, by dynamic programming.

Of all tokens that end at a position exactly one can be the last token of the
byte-pair encoding up to there: the one that starts the word, or that may stand
after the last token of the shorter prefix.  So ``count[i] = count[i - length] + 1``,
filled in from left to right, without encoding any prefix.  Distinct words of
many texts are filled in side by side.  The counts answer how long a text is,
where a budget of tokens ends and what a truncation costs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import bounded_batches

from .vocabulary import BYTE_BPE, ByteBpe, byte_bpe

#: Words up to so many bytes are filled in side by side, longer ones on their own.
WIDE = 48
#: Words and token pairs that a worker remembers before it starts anew.
REMEMBERED_WORDS, REMEMBERED_PAIRS = 500_000, 1_000_000
RUN_CHARS = 2 << 20
MULTIPLIER, SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


class TokenTable:
    """Token ids by bytes: an open-addressing table over hashes, hits compared byte by byte."""

    def __init__(self, tokens: dict[bytes, int]):
        self.longest = max(map(len, tokens))
        self.width = min(self.longest, WIDE)
        items = [(t, i) for t, i in tokens.items() if len(t) <= self.width]
        self.bits = 19
        while len(items) * 4 > 1 << self.bits:
            self.bits += 1
        size = 1 << self.bits
        self.ids, self.keys = np.full(size, -1, np.int32), np.zeros(size, np.uint64)
        n = max(tokens.values()) + 1
        self.bytes, self.sizes = np.zeros((n, self.width), np.uint8), np.zeros(n, np.int32)
        for token, i in items:
            self.bytes[i, : len(token)] = np.frombuffer(token, np.uint8)
            self.sizes[i] = len(token)
        keys = np.zeros(n, np.uint64)
        for k in range(self.width):
            more = self.sizes > k
            keys[more] = keys[more] * MULTIPLIER + self.bytes[more, k] + np.uint64(1)
        for _, i in items:
            slot = int(self._slot(keys[i : i + 1])[0])
            while self.ids[slot] >= 0:
                slot = (slot + 1) % size
            self.ids[slot], self.keys[slot] = i, keys[i]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Ids of the rows of ``text`` (their hashes in ``keys``), -1 where they are no token."""
        out = np.full(len(keys), -1, np.int32)
        rows, slot = np.arange(len(keys)), self._slot(keys)
        while len(rows):
            ids = self.ids[slot]
            hit = (ids >= 0) & (self.keys[slot] == keys[rows])
            out[rows[hit]] = ids[hit]
            on = (ids >= 0) & ~hit
            rows, slot = rows[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        found = np.flatnonzero(out >= 0)
        ids = out[found]
        same = (self.sizes[ids] == text.shape[1]) & (self.bytes[ids, : text.shape[1]] == text[found]).all(axis=1)
        out[found[~same]] = -1
        return out


class Numbers(dict):
    """Numbers words as they are met; ``new`` holds the bytes of those not filled in yet."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word.encode())
        return number


class PrefixCounter:
    def __init__(self, bpe: ByteBpe):
        self.bpe, self.table = bpe, TokenTable(bpe.ranks)
        self.text_of = {i: t for t, i in bpe.ranks.items()}
        self.piece = bpe.core._core_bpe.encode_single_piece
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(bpe.special, key=len, reverse=True)))) if bpe.special else None
        self.base = len(self.text_of) + 1
        self.pairs: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.index = Numbers()
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def may_follow(self, first: int, token: int) -> bool:
        """Whether the two are the encoding of their text; ``first`` is -1 at the start of a word."""
        key = (first + 1) * self.base + token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            wanted = [token] if first < 0 else [first, token]
            known = self.pairs[key] = self.piece(b"".join(self.text_of[t] for t in wanted)) == wanted
        return known

    def _follow(self, first: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        keys, back = np.unique((first.astype(np.int64) + 1) * self.base + tokens, return_inverse=True)
        return np.array([self.may_follow(k // self.base - 1, k % self.base) for k in keys.tolist()], bool)[back]

    @cached_property
    def suffixes(self) -> ahocorasick.Automaton:
        """Finds all tokens that end at each byte of a word in one pass."""
        out = ahocorasick.Automaton()
        for token, i in self.bpe.ranks.items():
            out.add_word(token.decode("latin-1"), (i, len(token)))
        out.make_automaton()
        return out

    def _one(self, word: bytes) -> np.ndarray:
        """Counts of a single word: at each byte the tokens that end there are tried until one may follow."""
        count, last = [0] * (len(word) + 1), [-1] * (len(word) + 1)
        pairs, base, done = self.pairs, self.base, 0
        for end, (token, size) in self.suffixes.iter(word.decode("latin-1")):
            if end < done:
                continue
            first = last[end + 1 - size]
            fits = pairs.get((first + 1) * base + token)
            if fits or fits is None and self.may_follow(first, token):
                done = end + 1
                count[done], last[done] = count[done - size] + 1, token
        return np.array(count, np.int32)

    def _side_by_side(self, words: list[bytes]) -> list[np.ndarray]:
        """Counts of words of at most WIDE bytes, longest words first."""
        longest = len(words[0])
        sizes = np.array([len(w) for w in words])
        text = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in words), np.uint8).reshape(len(words), longest)
        count = np.zeros((len(words), longest + 1), np.int32)
        last = np.full((len(words), longest + 1), -1, np.int32)
        keys: list[np.ndarray] = []  # keys[s - 1]: hashes of the s bytes that end here
        for i in range(1, longest + 1):
            live = int(np.searchsorted(-sizes, -i, "right"))
            byte = text[:live, i - 1].astype(np.uint64) + np.uint64(1)
            keys = [byte, *(k[:live] * MULTIPLIER + byte for k in keys[: self.table.width - 1])]
            open_ = np.arange(live)
            for size in range(len(keys), 0, -1):
                ids = self.table.find(keys[size - 1][open_], text[open_, i - size : i])
                some = np.flatnonzero(ids >= 0)
                rows = open_[some]
                fits = self._follow(last[rows, i - size], ids[some])
                rows, ids = rows[fits], ids[some][fits]
                last[rows, i] = ids
                count[rows, i] = count[rows, i - size] + 1
                left = np.ones(len(open_), bool)
                left[some[fits]] = False
                open_ = open_[left]
                if not len(open_):
                    break
        return [count[r, : n + 1] for r, n in enumerate(sizes.tolist())]

    def _learn(self) -> None:
        """Fill in the words that were met since the last call."""
        new = self.index.new
        if not new:
            return
        order = sorted(range(len(new)), key=lambda k: -len(new[k]))
        tables: list[np.ndarray] = [np.zeros(0, np.int32)] * len(new)
        narrow = [k for k in order if len(new[k]) <= WIDE]
        for k in order[: len(order) - len(narrow)]:
            tables[k] = self._one(new[k])
        if narrow:
            for k, t in zip(narrow, self._side_by_side([new[k] for k in narrow]), strict=True):
                tables[k] = t
        sizes = np.array([len(t) for t in tables])
        self.flat = np.concatenate((self.flat, *tables))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(sizes)))
        self.index.new = []

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, bounds): text k has ``counts[bounds[k] + i]`` tokens in its first i bytes, i from 0 to its length.

        Inside a character the bytes so far count as they stand.  What a prefix
        changes in the words before its end is taken into account: white space
        before a word belongs to its run while the word has not begun, and a
        contraction that is not complete is an apostrophe and a letter."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        if len(self.index) > REMEMBERED_WORDS:
            self.forget()
        number, pattern = self.index.__getitem__, self.pattern
        words: list[int] = []
        owner, skip = [], []  # text of each part; bytes at its end that only lead up to a special string
        sizes = []  # words of each part
        runs: list[tuple[int, int, int, int]] = []  # (white space, word after it, the run with that word's first character, bytes of this)
        split: list[int] = []
        for k, text in enumerate(texts):
            parts, at = [], 0
            if self.special is not None:
                for m in self.special.finditer(text):
                    parts.append((text[at : m.end() - 1], len(m[0].encode()) - 1))
                    at = m.end()
            parts.append((text[at:], 0))
            for part, extra in parts:
                found = pattern.findall(part)
                base = len(words)
                words += map(number, found)
                owner.append(k)
                skip.append(extra)
                sizes.append(len(found))
                if "'" in part:
                    split += [base + j for j, w in enumerate(found) if len(w) == 3 and w in CONTRACTIONS]
                for j in range(1, len(found)) if TWO_SPACES.search(part) else ():
                    before = found[j - 1]
                    if before[-1] in SPACES and found[j][0] in SPACES and before.isspace():
                        runs.append((base + j - 1, base + j, number(before + found[j][0]), len(found[j][0].encode())))
        self._learn()
        word = np.array(words, np.int64)
        size = self.at[word + 1] - self.at[word] - 1
        whole = self.flat[self.at[word + 1] - 1].astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        begin = np.concatenate(([0], np.cumsum(size)))  # bytes of all parts one after the other
        cum = np.concatenate(([0], np.cumsum(whole)))
        part_of = np.repeat(np.arange(len(sizes)), sizes)
        base = cum[:-1] - cum[bounds[part_of]]
        inside = np.arange(int(begin[-1])) - np.repeat(begin[:-1], size) + 1
        values = np.repeat(base, size) + self.flat[np.repeat(self.at[word], size) + inside]
        for before, after, run, first in runs:
            values[begin[after] + first - 1] = base[before] + self.flat[self.at[run + 1] - 1]
        for w in split:
            values[begin[w] + 1] = base[w] + 2
        # parts into texts: a special string adds one token to what its part counts without the bytes that lead up to it
        ends = begin[bounds[1:]]
        pieces: list[np.ndarray] = []
        text_bounds, offset, current = [0], 0, -1
        starts = begin[bounds[:-1]]
        length = 0
        for p, k in enumerate(owner):
            if k != current:
                if current >= 0:
                    text_bounds.append(length)
                current, offset = k, 0
                pieces.append(np.zeros(1, np.int64))
                length += 1
            own = values[starts[p] : ends[p]] + offset
            pieces.append(own)
            length += len(own)
            if skip[p]:
                kept = len(own) - skip[p]
                offset = (int(own[kept - 1]) if kept else offset) + 1
                pieces.append(np.array([offset]))
                length += 1
        if current >= 0:
            text_bounds.append(length)
        return (np.concatenate(pieces)), np.array(text_bounds, np.int64)


#: Contractions of three bytes, and white space, of the vocabulary's word pattern (fixed values).
CONTRACTIONS = frozenset({"'re", "'ve", "'ll"})
TWO_SPACES = regex.compile(r"\s\s")
SPACES = frozenset(chr(c) for c in range(0x3001) if regex.match(r"\s", chr(c)))


@lru_cache(maxsize=2)
def prefix_counter(vocabulary: str = BYTE_BPE) -> PrefixCounter:
    return PrefixCounter(byte_bpe(vocabulary))


def budget_end(data: np.ndarray, counts: np.ndarray, budget: int) -> int:
    """Bytes of the longest prefix, cut between characters, of at most ``budget`` tokens."""
    between = np.ones(len(counts), bool)
    between[:-1] = (data & 0xC0) != 0x80
    return int(np.flatnonzero(between & (counts <= budget))[-1])


def prefix_token_counts(docs: DataFrame, *, text_col: str = "text", vocabulary: str = BYTE_BPE, budget: int | None = None, keep_table: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens``; with a ``budget`` also ``fit_bytes``, the
    length of the longest prefix within it, and with ``keep_table`` also
    ``prefix_tokens``, the count at every byte from 0 to the end.

    Counts are those of the ``tokenizers`` library without added special tokens, over
    whole texts; null counts as empty.  Added columns replace those of their names."""
    added = ["n_bytes", "n_tokens", *["fit_bytes"] * (budget is not None), *["prefix_tokens"] * keep_table]
    bounded_batches(docs.sparkSession)
    keep = docs.drop(*added)
    position = keep.columns.index(text_col)
    schema = keep.select("*", *[F.lit(0).cast("long").alias(c) for c in added if c != "prefix_tokens"], *[F.array(F.lit(0)).alias("prefix_tokens")] * keep_table).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(position).to_pylist()]
            columns: dict[str, list] = {c: [] for c in added}
            first = 0
            while first < len(texts):
                end, chars = first, 0
                while end < len(texts) and (end == first or chars + len(texts[end]) <= RUN_CHARS):
                    chars += len(texts[end])
                    end += 1
                counts, bounds = counter.counts(texts[first:end])
                for k in range(end - first):
                    own = counts[bounds[k] : bounds[k + 1]]
                    columns["n_bytes"].append(len(own) - 1)
                    columns["n_tokens"].append(int(own[-1]))
                    if budget is not None:
                        over = own[-1] > budget
                        columns["fit_bytes"].append(budget_end(np.frombuffer(texts[first + k].encode(), np.uint8), own, budget) if over else len(own) - 1)
                    if keep_table:
                        columns["prefix_tokens"].append(own.astype(np.int32))
                first = end
            arrays = [pa.array(columns[c], pa.list_(pa.int32()) if c == "prefix_tokens" else pa.int64()) for c in added]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *added])

    return keep.mapInArrow(run, schema)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = prefix_token_counts(docs, budget=512)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "fit_bytes")
