"""Harmonic packing of whole documents into fixed-length sequences.

A remainder of length r belongs to the reciprocal class k = C // r: k of its kind fit a sequence of C ids. Every
worker fills sequences of class k with exactly k pieces, without a look at any other worker or class, and so no
data move. Since documents may be cut, a document is first cut into whole sequences, and a remainder that would
leave more than ``slack`` of its k-th share of a sequence empty is cut at C // (k + 1), the next reciprocal;
what is left of it shrinks quadratically, so that one or two cuts do.

What is not full when a worker ends (fewer than k pieces for each class met) is a second, small table, bounded by
workers times classes. It is packed in groups of workers by first fit over all classes, longest piece first.

Defined cases: a null or empty text has the end id alone; null and equal document ids are packed as any other
(their pieces tell by start and checksum); an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_map, groups, ids_and_text, rows, stored

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
WORKERS_A_GROUP = 64


def cuts(length: int, capacity: int, slack: float = 0.02, least: int = 16) -> list[int]:
    """Lengths of a document's pieces: whole sequences, then pieces close to a reciprocal of the capacity."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if rest <= least or rest * k >= capacity * (1 - slack):
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


def harmonic_pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, slack: float = 0.02,
                  id_col: str = "doc_id", text_col: str = "text", cache_words: int = tokens.CACHE_WORDS, hold: bool = False) -> DataFrame:
    """A row per piece: where it lies in its document, and in which sequence at which offset.

    ``cache_words`` bounds a worker's caches of word ids; with ``hold`` they last from task to task of this stage.
    """
    schema = f"{PIECE}, worker int, bin bigint, offset bigint"

    def task(batches):
        from pyspark import TaskContext
        enc, worker, bins = tokens.encoder(tokenizer, cache_words), TaskContext.get().partitionId(), 0
        end, open_bins = np.array([end_id], "<u4").tobytes(), {}
        for held in groups(rows(batches), lambda r: len(r[1]) + 16, 1 << 21):
            for (doc, _), data in zip(held, enc.many([t for _, t in held])):
                data, start = data + end, 0
                n = len(data) // 4
                for length in cuts(n, capacity, slack):
                    piece = (doc, start, length, zlib.crc32(data[start * 4:(start + length) * 4]), n)
                    start += length
                    k = capacity // length
                    own = open_bins.setdefault(k, [])
                    own.append(piece)
                    if len(own) == k:
                        at = 0
                        for p in own:
                            yield *p, worker, bins, at
                            at += p[2]
                        bins += 1
                        del open_bins[k]
        if not hold:
            enc.forget()
        for own in open_bins.values():
            for p in own:
                yield *p, worker, None, None

    packed = stored(arrow_map(ids_and_text(docs, id_col, text_col), task, schema, keeps="encoders"))
    loose = stored(_pack_loose(packed.where(F.col("bin").isNull()), capacity))
    full = packed.where(F.col("bin").isNotNull())
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    # even numbers for the workers' sequences, odd ones for the groups' sequences
    number = lambda unit, kind: (F.col(unit).cast("bigint") * (1 << 38) + F.col("bin") * 2 + kind).alias("sequence_id")
    return (full.select(*columns[:5], number("worker", 0), "offset")
            .unionAll(loose.select(*columns[:5], number("unit", 1), "offset")))


def _pack_loose(loose: DataFrame, capacity: int) -> DataFrame:
    """First fit, longest first, over the open pieces of some workers at a time."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def fit(key, table):
        import pyarrow as pa
        lengths = table["length"].to_numpy()
        order = np.lexsort((table["start"].to_numpy(), table["ids_crc32"].to_numpy(), -lengths))
        used, free, bins, offsets = [], {}, np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k in order:
            need = int(lengths[k])
            room = min((r for r in free if r >= need), default=None)     # at most one entry per room left
            if room is None:
                b = len(used)
                used.append(0)
                room = capacity
            else:
                b = free[room].pop()
                if not free[room]:
                    del free[room]
            bins[k], offsets[k] = b, used[b]
            used[b] += need
            if room > need:
                free.setdefault(room - need, []).append(b)
        unit = pa.array(np.full(len(lengths), key[0].as_py(), np.int32))
        return pa.table([*[table[c] for c in names], unit, pa.array(bins), pa.array(offsets)],
                        names=[*names, "unit", "bin", "offset"])

    grouped = loose.select(*names, F.floor(F.col("worker") / WORKERS_A_GROUP).cast("int").alias("unit")).groupBy("unit")
    return grouped.applyInArrow(fit, f"{PIECE}, unit int, bin bigint, offset bigint")
