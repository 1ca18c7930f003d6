"""Draws by hash: the same numbers on any engine, partitioning and rerun.

A draw is the MD5 sum of its parts (seed, replicate, key, ...) as text joined by
``|``; its first 13 hexadecimal digits are the 52 bits of a number in [0, 1)."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column | str | int) -> Column:
    """Uniform in [0, 1); names are columns, integers literals; null counts as empty."""
    columns = [F.lit(p) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / float(1 << 52)


def uniform_sql(*parts: str | int) -> str:
    """The same number as an SQL expression over columns that hold no null."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(map(str, parts))})), 1, 13) AS BIGINT) / 4503599627370496.0)"


# ---- the same numbers for whole arrays: what needs many draws a row makes them in Arrow batches ----

_SHIFTS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]])
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _digests(words: list[np.ndarray | int]) -> tuple[np.ndarray, np.ndarray]:
    """First two words of the MD5 sums of messages of one block, whose 16 ``words`` are arrays, or integers where all messages agree."""
    size = next(w for w in words if not isinstance(w, int)).shape
    a, b, c, d = (np.full(size, x, np.uint32) for x in _START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            g = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        if isinstance(words[g], int):
            np.add(f, np.uint32((_SINES[i] + words[g]) & 0xFFFFFFFF), out=f)
        else:
            np.add(f, np.uint32(_SINES[i]), out=f)
            np.add(f, words[g], out=f)
        s = int(_SHIFTS[turn, i % 4])
        np.left_shift(f, np.uint32(s), out=t)
        np.right_shift(f, np.uint32(32 - s), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    return a + np.uint32(_START[0]), b + np.uint32(_START[1])


def uniforms(seed: int, first: int, last: int, keys: list[str]) -> np.ndarray:
    """(replicates, keys): :func:`uniform` of seed, replicate and key for the replicates ``first`` to ``last``; ``keys`` are texts (parts of a key joined by ``|``)."""
    out = np.empty((last - first + 1, len(keys)))
    for at in range(0, len(keys), 8192):  # blocks of so many messages stay in the cache
        part = [k.encode() for k in keys[at : at + 8192]]
        size = np.array([len(k) for k in part])
        width, lead = 0, -1
        for r in range(first, last + 1):
            head = f"{seed}|{r}|".encode()
            row = out[r - first, at : at + len(part)]
            if len(head) != lead:
                # replicates with as many digits share all words but the first ones
                lead, short = len(head), len(head) + size <= 55
                width = -(-lead // 4)
                block = np.zeros((len(part), 64), np.uint8)
                keep = max(0, 56 - lead)
                text = np.frombuffer(b"".join(k[:keep].ljust(keep, b"\0") for k in part), np.uint8)
                block[:, 56 - keep : 56] = text.reshape(len(part), keep)
                block[np.arange(len(part)), np.where(short, lead + size, 0)] = 0x80
                columns = np.ascontiguousarray(block.view("<u4").T)
                columns[14] = 8 * (lead + size)
                words = [w if w.min() != w.max() else int(w[0]) for w in columns] if len(part) > 1 else list(columns)
            if short.any():
                fixed = np.frombuffer(head.ljust(4 * width, b"\0"), "<u4")
                now = [words[k] | int(fixed[k]) if isinstance(words[k], int) else words[k] | fixed[k] for k in range(width)] + words[width:]
                if all(isinstance(w, int) for w in now):
                    now[0] = np.full(len(part), now[0], np.uint32)
                a, b = (x.byteswap().astype(np.uint64) for x in _digests(now))
                row[:] = ((a << np.uint64(20)) | (b >> np.uint64(12))).astype(float) / float(1 << 52)
            for i in np.flatnonzero(~short):
                row[i] = int(hashlib.md5(head + part[i]).hexdigest()[:13], 16) / float(1 << 52)
    return out
