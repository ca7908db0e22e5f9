"""Vectorised helpers over Arrow text columns (used inside Spark tasks).

A *word* is a maximal run of bytes outside ``\\x20\\x09-\\x0D``.  UTF-8 never uses
those bytes inside a longer sequence, so words can be found on the raw bytes.
Word hashes are 64-bit polynomials over random byte codes, computed for a
bounded slice of bytes at a time, so memory does not depend on the batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (multiply and xor-shift), element-wise."""
    x = np.array(x, dtype=np.uint64, copy=True)
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(mult)
    x ^= x >> np.uint64(31)
    return x


def odd_constant(n: int) -> np.uint64:
    return mix64(np.array([n * 7919 + 11], dtype=np.uint64))[0] | np.uint64(1)


def _codes(seed: int, lower: bool) -> np.ndarray:
    t = mix64(np.arange(256, dtype=np.uint64) + np.uint64(1000 * (seed + 1)))
    if lower:
        t[65:91] = t[97:123]
    t[WHITE] = 0
    return t


_POWERS: dict[int, np.ndarray] = {}


def _powers(seed: int, n: int) -> np.ndarray:
    """First n powers of the seed's odd base, modulo 2^64."""
    have = _POWERS.get(seed)
    if have is None or len(have) < n:
        p = np.full(max(n, 1024), odd_constant(seed), dtype=np.uint64)
        p[0] = 1
        have = _POWERS[seed] = np.cumprod(p, dtype=np.uint64)
    return have[:n]


def text_array(column: pa.Array) -> pa.Array:
    """A string column as large_string without nulls (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array; offsets has len+1 entries."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    buf = column.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data, off


@dataclass
class Words:
    """The words of some consecutive documents lo..hi-1 of a batch."""

    lo: int
    hi: int
    offsets: np.ndarray            # hi-lo+1 word offsets
    hashes: list[np.ndarray]       # one uint64 array per seed
    start: np.ndarray | None       # byte positions in the batch buffer
    end: np.ndarray | None

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.offsets))


def _hash_slice(data: np.ndarray, cuts: np.ndarray, seeds: int, lower: bool):
    """Word starts, ends and hashes of one slice; cuts are document starts in it."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, [np.zeros(0, np.uint64) for _ in range(seeds)]
    white = WHITE[data]
    edge = np.ones(n, dtype=bool)
    edge[1:] = white[:-1]
    edge[cuts[cuts < n]] = True
    starts = np.flatnonzero(edge & ~white)
    if len(starts) == 0:
        z = np.zeros(0, np.int64)
        return z, z, [np.zeros(0, np.uint64) for _ in range(seeds)]
    last = np.ones(n, dtype=bool)
    last[:-1] = white[1:]
    inner = cuts[(cuts > 0) & (cuts <= n)]
    last[inner - 1] = True
    ends = np.flatnonzero(last & ~white) + 1
    span = np.diff(np.append(starts, n))
    pos = np.arange(n, dtype=np.int64)
    pos[starts[0]:] -= np.repeat(starts, span)
    pos[:starts[0]] = 0
    widest = int(span.max()) + 1
    pos = np.minimum(pos, widest)
    out = []
    for s in range(seeds):
        v = _codes(s, lower)[data] * _powers(s, widest + 1)[pos]
        out.append(mix64(np.add.reduceat(v, starts) + (ends - starts).astype(np.uint64)))
    return starts, ends, out


def words(column: pa.Array, seeds: int = 1, lower: bool = False, spans: bool = False) -> Iterator[Words]:
    """Yield the hashed words of a text column, some whole documents at a time.

    A document longer than one slice is hashed in pieces cut at white space and
    yielded alone, still whole.
    """
    data, off = raw(column)
    n_docs = len(off) - 1
    lo = 0
    while lo < n_docs:
        hi = int(np.searchsorted(off, off[lo] + SLICE_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + (1 << 19), n_docs)
        a, b = int(off[lo]), int(off[hi])
        if b - a <= SLICE_BYTES:
            st, en, hs = _hash_slice(data[a:b], off[lo:hi] - a, seeds, lower)
            wo = np.searchsorted(st, off[lo:hi + 1] - a, side="left")
            yield Words(lo, hi, wo, hs, st + a if spans else None, en + a if spans else None)
        else:                                   # one long document
            sts, ens, hss, x = [], [], [[] for _ in range(seeds)], a
            while x < b:
                y = min(x + SLICE_BYTES, b)
                step = SLICE_BYTES
                while y < b:
                    gap = np.flatnonzero(WHITE[data[x:y]])
                    if len(gap):
                        y = x + int(gap[-1]) + 1
                        break
                    step *= 2                   # a word longer than a slice stays whole
                    y = min(x + step, b)
                st, en, hs = _hash_slice(data[x:y], np.zeros(1, np.int64), seeds, lower)
                if spans:
                    sts.append(st + x)
                    ens.append(en + x)
                for i in range(seeds):
                    hss[i].append(hs[i])
                x = y
            hs = [np.concatenate(h) for h in hss]
            yield Words(lo, hi, np.array([0, len(hs[0])]), hs,
                        np.concatenate(sts) if spans else None, np.concatenate(ens) if spans else None)
        lo = hi


def gram_hashes(h: np.ndarray, n: int, seed: int = 50) -> np.ndarray:
    """Hash of the n words from each position (doubling); the last n-1 entries
    run past the end and must be masked by the caller."""
    base = odd_constant(seed)

    def shifted(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros_like(x)
        if k < len(x):
            out[:len(x) - k] = x[k:]
        return out

    power, width = h.astype(np.uint64), 1
    acc, have = None, 0
    mult = {1: base}
    with np.errstate(over="ignore"):
        while True:
            if n & width:
                if acc is None:
                    acc, have = power, width
                else:
                    acc = acc + _pow(base, have) * shifted(power, have)
                    have += width
            width *= 2
            if width > n:
                break
            power = power + _pow(base, width // 2) * shifted(power, width // 2)
    del mult
    return mix64(acc)


def _pow(base: np.uint64, k: int) -> np.uint64:
    return np.uint64(pow(int(base), k, 1 << 64))


def starts_of_grams(offsets: np.ndarray, n: int) -> np.ndarray:
    """Mask over words: does a run of n words of the same document start here?"""
    total = int(offsets[-1])
    ok = np.zeros(total, dtype=bool)
    size = np.diff(offsets)
    left = np.repeat(offsets[1:], size) - np.arange(offsets[0], total) if total else np.zeros(0, np.int64)
    ok[offsets[0]:] = left >= n
    return ok


def long_column(x: np.ndarray) -> pa.Array:
    """uint64 hashes as a signed 64-bit Arrow column."""
    return pa.array(np.ascontiguousarray(x).view(np.int64), type=pa.int64())


def batches_of(table: pa.Table, rows: int = 200_000) -> Iterable[pa.RecordBatch]:
    return table.combine_chunks().to_batches(max_chunksize=rows)
