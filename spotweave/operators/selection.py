"""Exact order statistics without sorting: radix selection over the bits of doubles.

A double's bits, with those of negative numbers turned over, ascend as the numbers do. Each pass counts the next ``DIGIT`` bits
of the values that agree with the searched rank so far; a task sends one row for each count that isn't zero, and the counts
say which bits the rank has. A pass reads the values and moves counts only. As soon as few values agree, they are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits that a pass decides (a count for each of their values), and values that are sorted at the end.
DIGIT, FEW = 16, 4096


def image(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles (NaN last, as in Spark)."""
    values = np.where(np.isnan(values), np.nan, values)  # one NaN
    bits = np.ascontiguousarray(values, np.float64).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def value_of(found: int) -> float:
    """The double that an image is of."""
    bits = found - (1 << 63) if found >> 63 else ~found & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def counted(rows: DataFrame, value: str, prefixes: list[int], done: int) -> DataFrame:
    """``n`` values that have prefix ``which`` of ``prefixes`` in their first ``done`` bits and ``digit`` in the next DIGIT bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(prefixes), 1 << DIGIT), np.int64)
        for batch in batches:
            bits = image(batch.column(0).to_numpy(zero_copy_only=False))
            for k, prefix in enumerate(prefixes):
                own = bits if not done else bits[bits >> np.uint64(64 - done) == np.uint64(prefix)]
                digits = (own >> np.uint64(64 - done - DIGIT)) & np.uint64((1 << DIGIT) - 1)
                total[k] += np.bincount(digits.astype(np.int64), minlength=1 << DIGIT)
        which, digit = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int64)), pa.array(digit.astype(np.int64)), pa.array(total[which, digit])], names=["which", "digit", "n"])

    known = rows.select(F.col(value).cast("double").alias("v")).where("v is not null")
    return known.mapInArrow(run, "which long, digit long, n long").groupBy("which", "digit").agg(F.sum("n").alias("n"))


def _counts(rows: DataFrame, value: str, prefixes: list[int], done: int) -> dict[tuple[int, int], int]:
    found = counted(rows, value, prefixes, done).collect()  # 2 ** DIGIT rows for each prefix at most
    return {(prefixes[r["which"]], r["digit"]): r["n"] for r in found}


def _sorted(rows: DataFrame, value: str, prefix: int, done: int) -> list[float]:
    """The values whose first ``done`` bits are ``prefix``, in order; FEW at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(own[image(own) >> np.uint64(64 - done) == np.uint64(prefix)])], names=["v"])

    known = rows.select(F.col(value).cast("double").alias("v")).where("v is not null")
    found = np.array([r["v"] for r in known.mapInArrow(run, "v double").collect()], np.float64)
    return found[np.argsort(image(found), kind="stable")].tolist()


def quantile(rows: DataFrame, value: str, share: float) -> float | None:
    """The exact quantile of a column, between two values by their distance; nulls don't count. None without values.

    ``rows`` are read a few times: give a written table.
    """
    counts = _counts(rows, value, [0], 0)
    n = sum(counts.values())
    if not n:
        return None
    at = share * (n - 1)
    low = int(np.floor(at))
    ranks = [low] if at == low else [low, low + 1]
    # each rank: the bits that are known, the rank among the values that have them
    known = {r: (0, r) for r in ranks}
    done, found = 0, {}
    while known:
        if done:
            counts = _counts(rows, value, sorted({p for p, _ in known.values()}), done)
        done += DIGIT
        for rank, (prefix, left) in list(known.items()):
            for digit, c in sorted((d, c) for (p, d), c in counts.items() if p == prefix):
                if left < c:
                    known[rank] = (prefix << DIGIT | digit, left)
                    if done == 64:
                        found[rank] = value_of(known.pop(rank)[0])
                    elif c <= FEW:
                        found[rank] = (known.pop(rank), done)
                    break
                left -= c
    lists: dict[int, list[float]] = {}
    for rank, x in found.items():
        if isinstance(x, tuple):
            (prefix, left), bits = x
            if prefix not in lists:
                lists[prefix] = _sorted(rows, value, prefix, bits)
            found[rank] = lists[prefix][left]
    a, b = found[ranks[0]], found[ranks[-1]]
    return a if a == b else a + (at - low) * (b - a)
