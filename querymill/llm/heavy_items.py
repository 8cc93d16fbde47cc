"""Most frequent values by code-based identification (combinatorial group testing).

Every value has a 28-bit fingerprint, which a Reed-Solomon code over GF(16) turns into 15 symbols. Three times over,
fingerprints are hashed to groups, and a group counts, at each position, how often each of the 16 symbols occurs.
A value that outweighs the rest of a group shows its symbols as the heaviest at most positions; the code corrects up to
four positions that others won. Decoded fingerprints are taken out of all counters (peeling), which uncovers lighter
ones. What is decoded is only a candidate: a second pass counts the candidates' values exactly.

Memory: 3 x groups x 240 counters, whatever the number of rows or distinct values; a share so small that it needs more than MOST_GROUPS groups is an error. Neither pass shuffles by value before
a map-side combine, so a value that holds a third of all rows costs no more than another.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FP_BITS = 28
SYMBOLS = 15
MESSAGE = 7
CELLS = SYMBOLS * 16
REPS = 3
MOST_GROUPS = 1 << 14  # three times so many groups of 240 counters of 8 bytes are 94 MB a task
_BLOCK = 64
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _field() -> tuple[np.ndarray, np.ndarray]:
    """exp and log of GF(16) modulo x^4 + x + 1."""
    exp, log, x = np.zeros(30, np.int64), np.zeros(16, np.int64), 1
    for i in range(15):
        exp[i] = exp[i + 15] = x
        log[x] = i
        x = (x << 1) ^ (0x13 if x & 8 else 0)
    return exp, log


EXP, LOG = _field()


def _mul(a: int, b: int) -> int:
    return 0 if not a or not b else int(EXP[LOG[a] + LOG[b]])


def _tables() -> np.ndarray:
    """codeword (15 nibbles in 60 bits) that each value of each message nibble contributes: the code is linear."""
    out = np.zeros((MESSAGE, 16), np.int64)
    for i in range(MESSAGE):
        for v in range(16):
            for j in range(SYMBOLS):
                out[i, v] |= _mul(v, int(EXP[(i * j) % 15])) << (4 * j)
    return out


TABLES = _tables()


def encode(fp: np.ndarray) -> np.ndarray:
    """Codewords of fingerprints."""
    word = np.zeros(len(fp), np.int64)
    for i in range(MESSAGE):
        word ^= TABLES[i, (fp >> (4 * i)) & 15]
    return word


def group_of(fp: np.ndarray, rep: int, groups: int) -> np.ndarray:
    mixed = (fp.astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX[rep])
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(_MIX[(rep + 1) % 3])
    return ((mixed >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)


def _interpolate(at: list[int], symbols: np.ndarray) -> int:
    """Fingerprint whose codeword has the symbols at the seven positions: Gaussian elimination over GF(16)."""
    rows = [[int(EXP[(i * j) % 15]) for i in range(MESSAGE)] + [int(symbols[j])] for j in at]
    for c in range(MESSAGE):
        p = next(r for r in range(c, MESSAGE) if rows[r][c])
        rows[c], rows[p] = rows[p], rows[c]
        inv = int(EXP[(15 - LOG[rows[c][c]]) % 15])
        rows[c] = [_mul(x, inv) for x in rows[c]]
        for r in range(MESSAGE):
            if r != c and rows[r][c]:
                f = rows[r][c]
                rows[r] = [x ^ _mul(f, y) for x, y in zip(rows[r], rows[c])]
    return sum(rows[i][MESSAGE] << (4 * i) for i in range(MESSAGE))


def decode(symbols: np.ndarray, trust: np.ndarray) -> int | None:
    """The fingerprint whose codeword agrees with at least 11 of the 15 symbols, tried from the most trusted positions."""
    order = list(np.argsort(-trust, kind="stable"))
    tried = 0
    for out in (*[()], *combinations(range(MESSAGE), 1), *combinations(range(MESSAGE), 2)):
        at = [p for k, p in enumerate(order[: MESSAGE + len(out)]) if k not in out][:MESSAGE]
        fp = _interpolate(at, symbols)
        word = int(encode(np.array([fp]))[0])
        if sum(((word >> (4 * j)) & 15) == symbols[j] for j in range(SYMBOLS)) >= SYMBOLS - 4:
            return fp
        tried += 1
        if tried >= 29:
            break
    return None


def peel(counts: np.ndarray, least: float) -> dict[int, int]:
    """Candidates with their approximate counts from counters of shape (REPS, groups, 15, 16); least: the smallest
    count of interest. The counters are changed."""
    groups, found, failed = counts.shape[1], {}, {}
    while True:
        top = counts.max(axis=3)
        strength = np.median(top, axis=2)
        order = np.argwhere(strength >= least)
        order = order[np.argsort(-strength[order[:, 0], order[:, 1]], kind="stable")]
        progress = False
        for rep, g in order:
            cell = counts[rep, g]
            mass = float(np.median(cell.max(axis=1)))
            if mass < least or failed.get((rep, g)) == mass:
                continue
            ranked = np.sort(cell, axis=1)
            fp = decode(cell.argmax(axis=1), ranked[:, -1] - ranked[:, -2])
            if fp is None or int(group_of(np.array([fp]), rep, groups)[0]) != g:
                failed[(rep, g)] = mass
                continue
            word = int(encode(np.array([fp]))[0])
            at = [(r, int(group_of(np.array([fp]), r, groups)[0])) for r in range(REPS)]
            own = [(word >> (4 * j)) & 15 for j in range(SYMBOLS)]
            n = min(float(np.median([counts[r, h, j, s] for j, s in enumerate(own)])) for r, h in at)
            n = int(min(n, min(counts[r, h, j, s] for r, h in at for j, s in enumerate(own)) * 1.02 + 1))
            if n < least:
                failed[(rep, g)] = mass
                continue
            for r, h in at:
                for j, s in enumerate(own):
                    counts[r, h, j, s] = max(0, counts[r, h, j, s] - n)
            found[fp] = found.get(fp, 0) + n
            progress = True
        if not progress:
            return found


def candidates(df: DataFrame, column: str, share: float = 0.004, groups: int | None = None) -> DataFrame:
    """(fp, approx_n, total): fingerprints that may belong to a value with at least the given share of the non-null
    rows, and the number of those rows. Empty for an empty table."""
    groups = groups or 1 << max(6, int(np.ceil(np.log2(4 / share))))
    if groups > MOST_GROUPS:
        raise ValueError(f"a share of {share} needs {groups} groups; the least that MOST_GROUPS allows is {4 / MOST_GROUPS}")
    blocks = -(-groups // _BLOCK)

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, total = np.zeros((REPS, groups * CELLS), np.int64), 0
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            total += len(fp)
            word = encode(fp)
            for rep in range(REPS):
                base = group_of(fp, rep, groups) * CELLS
                for j in range(SYMBOLS):
                    cells[rep] += np.bincount(base + j * 16 + ((word >> (4 * j)) & 15), minlength=groups * CELLS) if len(fp) > 4096 else 0
                    if 0 < len(fp) <= 4096:
                        np.add.at(cells[rep], base + j * 16 + ((word >> (4 * j)) & 15), 1)
        if total:
            parts = [(r, b, np.ascontiguousarray(cells[r].reshape(groups, CELLS)[b * _BLOCK : (b + 1) * _BLOCK]), total if r == b == 0 else 0) for r in range(REPS) for b in range(blocks)]
            yield _rows(parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, totals = {}, {}
        for batch in batches:
            for r, b, raw, total in zip(*(batch.column(i).to_pylist() for i in range(4))):
                part = _unpack(raw)
                sums[r, b] = sums[r, b] + part if (r, b) in sums else part.copy()
                totals[r, b] = totals.get((r, b), 0) + total
        if sums:
            yield _rows([(r, b, x, totals[r, b]) for (r, b), x in sums.items()])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros((REPS, groups, SYMBOLS, 16), np.int64), 0
        for batch in batches:
            for r, b, raw, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                part = _unpack(raw).reshape(-1, SYMBOLS, 16)
                counts[r, b * _BLOCK : b * _BLOCK + len(part)] += part
                total += n
        if total:
            found = peel(counts, max(1.0, share * total * 0.5))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64()), pa.array([total] * len(found), pa.int64())], ["fp", "approx_n", "total"])

    shape = "rep int, block int, counts binary, total long"
    prints = df.where(F.col(column).isNotNull()).select(_fingerprint(column).alias("fp"))
    merged = prints.mapInArrow(accumulate, shape).repartition("rep", "block").mapInArrow(merge, shape)
    return merged.repartition(1).mapInArrow(find, "fp long, approx_n long, total long")


def heavy_items(df: DataFrame, column: str, share: float = 0.004) -> DataFrame:
    """(<column>, approx_n, n, total): every value with at least the given share of the rows whose value isn't null, its
    count from the counters and its exact count.

    Nulls are left out; the empty text is a value like any other; an empty table or one of nulls gives no row. Ties at
    the share are all in. Columns besides the one named are ignored, whatever their names."""
    found = candidates(df, column, share)
    hits = df.where(F.col(column).isNotNull()).select(F.col(column), _fingerprint(column).alias("__fp"))
    # at most 1 / (0.5 * share) fingerprints per group and repetition can be decoded: a fixed bound, whatever the data
    counted = hits.join(F.broadcast(found.withColumnRenamed("fp", "__fp")), "__fp").groupBy(column, "approx_n", "total").agg(F.count("*").alias("n"))
    millionth = round(share * 1_000_000)
    return counted.where(F.col("n") * 1_000_000 >= F.col("total") * millionth).select(column, "approx_n", "n", "total")


def _fingerprint(column: str):
    return F.xxhash64(F.col(column)).bitwiseAND(F.lit((1 << FP_BITS) - 1))


def _rows(parts: list) -> pa.RecordBatch:
    raw = [_pack(x) for _, _, x, _ in parts]
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int32()), pa.array(raw, pa.binary()), pa.array([p[3] for p in parts], pa.int64())], ["rep", "block", "counts", "total"])


def _pack(x: np.ndarray) -> bytes:
    """A byte for the width, then the counters as narrow as they allow."""
    top = int(x.max(initial=0))
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{raw[0]}", offset=1).astype(np.int64)
