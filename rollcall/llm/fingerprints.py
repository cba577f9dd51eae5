"""Fuzzy document fingerprints: context-triggered piecewise hashing.

A hash of the last seven bytes ends a chunk wherever its low bits are zero, so boundaries depend on the text
around them alone and an edit changes a few chunks. A signature has one of 64 characters for the hash of each
chunk; a fingerprint is ``block:signature:signature at twice the block``. The block size is the power of two that
gives about 32 to 64 chunks. Signatures have at most 64 and 32 characters; the last one then covers all the rest.

Likeness is 1 - edit distance / longer length, the best over signatures of equal block size, and 0 without a
common run of characters (seven, fewer for short signatures); runs of one character count three at most.

Defined cases: null texts are empty; the fingerprint of an empty text is ``4::``, likeness of two such is 1; equal
texts have equal fingerprints. Equal document ids are ordered by text, null ids come first. A single document is
its own next document. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import edits
from .common import BYTE_BASE, arrow_map, byte_codes, groups, ids_and_text, mix, partitions, powers, rows, stored

ROLL, FIRST, SECOND, LEAST = 7, 64, 32, 4
SIGNS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def fingerprint_many(parts: list[str]) -> list[str]:
    """Fingerprints of some texts, hashed together."""
    raw = [p.encode("utf-8", "replace") for p in parts]
    data = np.frombuffer(b"\n" * ROLL + b"".join(raw), np.uint8)
    up, down = powers(BYTE_BASE, len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte_codes()[data] * up[:-1], dtype=np.uint64)])
    rolled = np.zeros(len(data), np.uint64)                       # hash of the bytes that end here
    rolled[ROLL - 1:] = mix((sums[ROLL:] - sums[:-ROLL]) * down[:len(data) - ROLL + 1])
    out, start = [], ROLL

    def signature(block: int, most: int) -> str:
        ends = inside[(rolled[inside] & np.uint64(block - 1)) == 0] + 1
        if len(ends) == 0 or ends[-1] != stop:
            ends = np.append(ends, stop)
        if len(ends) > most:
            ends = np.append(ends[:most - 1], stop)
        begins = np.concatenate([[start], ends[:-1]])
        h = mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))
        return SIGNS[(h >> np.uint64(58)).astype(np.intp)].tobytes().decode()

    for p in raw:
        stop = start + len(p)
        if not p:
            out.append(f"{LEAST}::")
            continue
        block = max(LEAST, 1 << ((len(p) - 1) // FIRST).bit_length())
        inside = np.arange(start + ROLL - 1, stop)
        inside = inside[(rolled[inside] & np.uint64(LEAST - 1)) == 0]
        first = signature(block, FIRST)
        while len(first) < SECOND and block > LEAST:
            block //= 2
            first = signature(block, FIRST)
        out.append(f"{block}:{first}:{signature(block * 2, SECOND)}")
        start = stop
    return out


def _short_runs(s: str) -> str:
    out = []
    for c in s:
        if out[-3:] != [c] * 3:
            out.append(c)
    return "".join(out)


def _alike(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    n = min(ROLL, max(2, min(len(a), len(b)) // 4), len(a), len(b))
    if {a[i:i + n] for i in range(len(a) - n + 1)}.isdisjoint(b[i:i + n] for i in range(len(b) - n + 1)):
        return 0.0
    a, b = _short_runs(a), _short_runs(b)
    return 1.0 - edits.distance(a, b) / max(len(a), len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1, for fingerprints whose block sizes are equal or one step apart."""
    if x == y:
        return 1.0
    (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
    bx, by = int(bx), int(by)
    if bx == by:
        return max(_alike(x1, y1), _alike(x2, y2))
    if bx == 2 * by:
        return _alike(x1, y2)
    if by == 2 * bx:
        return _alike(x2, y1)
    return 0.0


def edited(text: str, following: str) -> str:
    """The second half of a text replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


RESULT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _pairs(chain: list[tuple], prints: list[str]):
    """Result rows of documents that have their next document beside them."""
    changed = [edited(a[1], b[1]) for a, b in zip(chain, chain[1:])]
    for (doc, text), own, following, new, new_print in zip(chain, prints, prints[1:], changed, fingerprint_many(changed)):
        yield (doc, len(text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), own, new_print,
               likeness(own, new_print), likeness(own, following))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row, where the rows lie."""
    def task(batches):
        for held in groups(rows(batches), lambda r: len(r[1]) + 16, 1 << 19):
            yield from zip([d for d, _ in held], fingerprint_many([t for _, t in held]))
    return arrow_map(ids_and_text(docs, id_col, text_col), task, "doc_id bigint, fingerprint string")


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness (also to the next document's).

    One range shuffle brings neighbours together. Only the first and last text of each range are stored beside the
    results, and meet in a join of at most one row per range.
    """
    spark = docs.sparkSession
    ordered = ids_and_text(docs, id_col, text_col).repartitionByRange(partitions(spark), "doc_id")

    def task(batches):
        from pyspark import TaskContext
        worker, last, last_print = TaskContext.get().partitionId(), None, None
        blank = (None,) * 6
        for held in groups(rows(batches), lambda r: len(r[1]) + 16, 1 << 19):
            prints = fingerprint_many([t for _, t in held])
            if last is None:
                yield held[0][0], *blank, worker, "first", held[0][1]
                chain = held
            else:
                chain, prints = [last, *held], [last_print, *prints]
            for r in _pairs(chain, prints):
                yield *r, worker, None, None
            last, last_print = held[-1], prints[-1]
        if last is not None:
            yield last[0], *blank, worker, "last", last[1]

    found = stored(arrow_map(ordered.sortWithinPartitions("doc_id", "text"), task,
                             f"{RESULT}, worker int, edge string, text string"))
    names = [f.split(" ")[0] for f in RESULT.split(", ")]
    firsts, lasts = found.where("edge = 'first'"), found.where("edge = 'last'")
    workers = sorted(r.worker for r in firsts.select("worker").collect())           # one number per range with rows
    follow = spark.createDataFrame([(a, b) for a, b in zip(workers, workers[1:] + workers[:1])], "worker int, next int")
    edges = (lasts.select("doc_id", "text", "worker").join(F.broadcast(follow), "worker")
             .join(firsts.select(F.col("worker").alias("next"), F.col("text").alias("next_text")), "next")
             .select("doc_id", "text", "next_text"))

    def close(batches):
        for doc, text, following in rows(batches, 8):
            chain = [(doc, text), (None, following)]
            yield from _pairs(chain, fingerprint_many([text, following]))

    return found.where(F.col("edge").isNull()).select(*names).unionAll(arrow_map(edges, close, RESULT))
