"""Count-min sketches of 64-bit values, one row deep, merged by range of counters.

A task sends the numbers of the counters its values fall on, by slice of 65,536 counters and as two bytes each;
a slice is added up where it is dealt to. Counts of different values may add up, so a count is never too small.
No task or the driver holds the counters of the whole sketch; what comes back is of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, partitions, rows, stored

SLICE_BITS = 16
SLICE = "slice int, lows binary"
FLUSH = 1 << 21


def counters(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> np.uint64(64 - bits)).astype(np.uint32)


def sent(arrays: Iterable[np.ndarray], bits: int) -> Iterator[tuple[int, bytes]]:
    """(slice, counters in it) of the values of a task, with bounded memory."""
    held, total = [], 0

    def flush():
        all_ = np.sort(np.concatenate(held))
        edges = np.searchsorted(all_, np.arange((1 << bits - SLICE_BITS) + 1, dtype=np.uint64) << np.uint64(SLICE_BITS))
        lows = (all_ & np.uint32((1 << SLICE_BITS) - 1)).astype("<u2")
        for s in np.flatnonzero(np.diff(edges)).tolist():
            yield s, lows[edges[s]:edges[s + 1]].tobytes()
    for a in arrays:
        held.append(counters(a, bits))
        total += len(a)
        if total >= FLUSH:
            yield from flush()
            held, total = [], 0
    if total:
        yield from flush()


def _slices(batches) -> Iterator[tuple[int, np.ndarray]]:
    """(slice, its counts) of rows sorted by slice."""
    now, counts, held = None, np.zeros(1 << SLICE_BITS, np.int64), []

    def added():
        return counts + np.bincount(np.frombuffer(b"".join(held), "<u2"), minlength=1 << SLICE_BITS)
    for s, lows in rows(batches):
        if s != now:
            if now is not None:
                yield now, added()
            now, counts, held = s, np.zeros(1 << SLICE_BITS, np.int64), []
        held.append(lows)
        if len(held) >= 256:
            counts, held = added(), []
    if now is not None:
        yield now, added()


def _dealt(blobs: DataFrame) -> DataFrame:
    return blobs.repartition(partitions(blobs.sparkSession), "slice").sortWithinPartitions("slice")


def most_frequent(counted: DataFrame, most: int) -> DataFrame:
    """The rows with the largest ``n``, whole values of it only and at most ``most``: by a histogram of the counts (one
    row for each distinct count, of which a corpus has few) and a filter where the rows lie, not by a sort in one task."""
    histogram = counted.groupBy("n").agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.orderBy(F.desc("n")))
    cut = histogram.select("n", upto.alias("upto")).where(F.col("upto") <= most).agg(F.min("n")).first()[0]
    return counted.where(F.col("n") >= cut) if cut is not None else counted.limit(0)


def heaviest(blobs: DataFrame, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The counters with the largest counts, at most ``most`` of them (whole counts only), in order of their number; and the counts."""
    def task(batches):
        for s, counts in _slices(batches):
            for c in np.flatnonzero(counts >= least).tolist():
                yield (s << SLICE_BITS) + c, int(counts[c])
    top = most_frequent(stored(arrow_map(_dealt(blobs), task, "counter bigint, n bigint", batch_rows=16384)), most).toArrow()
    number, n = (top.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(number)
    return number[order].astype(np.uint32), n[order].astype(np.int64)


def bitmap(blobs: DataFrame, bits: int, least: int) -> np.ndarray:
    """A bit for each counter: whether its count reaches ``least``. Of fixed size, 2 ** bits bits."""
    def task(batches):
        for s, counts in _slices(batches):
            if (counts >= least).any():
                yield s, np.packbits(counts >= least, bitorder="little").tobytes()
    out = np.zeros(1 << bits - 3, np.uint8)
    width = 1 << SLICE_BITS - 3
    for s, part in rows(arrow_map(_dealt(blobs), task, "slice int, bits binary").toArrow().to_batches()):
        out[s * width:(s + 1) * width] = np.frombuffer(part, np.uint8)
    return out


def marked(bits: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Which counters have their bit set."""
    return (bits[number >> np.uint32(3)] >> (number & np.uint32(7)).astype(np.uint8)) & 1 == 1
