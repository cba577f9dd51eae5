"""Removal of repeated passages: every window of W words whose words also start earlier somewhere is covered.

A first pass counts, over all documents, the anchors of windows: the smallest hash of the W-12-word runs in a
window, so that equal windows have equal anchors and about seven windows in a row share one. The partition sketches
of these counts are merged; a merged counter is at least the count of any window on it, so a window whose counter
says one is certainly alone, and no repeat is lost. A second pass groups exactly the windows estimated repeated, by
96 bits of hash. Each task first settles the repeats among its own documents, and sends on only the earliest of each
window, so that a window found in a third of all documents is one row per task.

The sketch has a fixed size (``BITS``). Where the corpus outgrows it, more windows take part in the second pass;
the result is the same.

Earlier means: smaller document id, or the same document and a smaller place. Defined cases: null texts have no
words; rows without an id have no order, take no part and are kept whole; rows with the same id count as one
document in repeated copies, places covered in one are removed in all of them; texts shorter than a window have no
repeats; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketches
from .common import WORD_BASE_2, Words, arrow_map, ids_and_text, mix2, partitions, rows, texts, window_docs, windows

WINDOW, ANCHOR_SPAN, BITS = 20, 13, 28
PLACE_BITS = 24
FLUSH_WINDOWS, CHUNK = 1_000_000, 1 << 22


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows within one text, the place of each one's anchor, and the hashes of anchor runs by place."""
    span = min(ANCHOR_SPAN, window)
    runs = windows(words.hash, window - span + 1)
    starts = np.flatnonzero(window_docs(words, window))
    places = np.empty(len(starts), np.int64)
    for at in range(0, len(words) - window + 1, CHUNK):
        part = runs[at:at + CHUNK + span - 1]
        # smallest high bits first, then the leftmost place: the same choice wherever the window stands
        low = (part & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while width < span:
            step = min(width, span - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        lo, hi = np.searchsorted(starts, (at, at + CHUNK))
        places[lo:hi] = at + (low[starts[lo:hi] - at] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    return starts, places, runs


def repeated_anchors(source: DataFrame, window: int, bits: int) -> np.ndarray:
    """Bits of the counters that two or more anchor places of the corpus fall on."""
    def task(batches):
        def values():
            for _, parts in texts(batches):
                _, places, runs = anchors(Words(parts), window)
                yield runs[np.unique(places)]
        yield from sketches.sent(values(), bits)
    return sketches.bitmap(arrow_map(source, task, sketches.SLICE), bits, 2)


class _Held:
    """Windows of a task: anchor hash, 32 more bits of the window, document id, start."""

    def __init__(self):
        self.parts, self.total = [], 0

    def add(self, anchor, more, doc, start):
        self.parts.append((anchor, more, doc, start))
        self.total += len(anchor)

    def settled(self):
        """All windows sorted, and which of them are not the earliest of their words."""
        anchor, more, doc, start = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((start, doc, more, anchor))
        anchor, more, doc, start = anchor[order], more[order], doc[order], start[order]
        same = np.zeros(len(anchor), bool)
        same[1:] = (anchor[1:] == anchor[:-1]) & (more[1:] == more[:-1])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(anchor))))
        later = same & ((doc != doc[first]) | (start != start[first]))       # copies of a row are not later than it
        return anchor, more, doc, start, later, same


def _by_doc(doc: np.ndarray, start: np.ndarray):
    """(document id, starts) of covered windows."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order].astype("<u4")
    edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(doc[a]), start[a:b].tobytes()


def covered_windows(source: DataFrame, window: int = WINDOW, bits: int = BITS) -> DataFrame:
    """(doc_id, starts): windows whose words start earlier, as packed starts; a document may have several rows."""
    spark = source.sparkSession
    n_slices = 16 * partitions(spark)
    shared = spark.sparkContext.broadcast(repeated_anchors(source, window, bits))

    def first_pass(batches):
        flags = shared.value

        def flush(held):
            anchor, more, doc, start, later, same = held.settled()
            for d, blob in _by_doc(doc[later], start[later]) if later.any() else ():
                yield hash(d) % n_slices, d, blob, None, None, None
            keep = ~same
            anchor, more, doc, start = anchor[keep], more[keep], doc[keep], start[keep]
            part = ((anchor >> np.uint64(32)) * np.uint64(n_slices) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((start, doc, anchor, part))
            anchor, more, doc, start, part = anchor[order], more[order], doc[order], start[order], part[order]
            edges = np.searchsorted(part, np.arange(n_slices + 1))
            for s in np.flatnonzero(np.diff(edges)).tolist():
                cut = slice(edges[s], edges[s + 1])
                fresh = np.flatnonzero(np.concatenate([[True], anchor[cut][1:] != anchor[cut][:-1]]))
                steps = np.diff(start[cut], prepend=0).astype("<i4")         # runs of neighbours are runs of ones
                docs_ = np.diff(doc[cut], prepend=0).astype("<i8")
                counts = np.diff(np.append(fresh, edges[s + 1] - edges[s])).astype("<u4")
                yield (s, None, more[cut].astype("<u4").tobytes(), anchor[cut][fresh].astype("<u8").tobytes() + counts.tobytes(),
                       docs_.tobytes(), steps.tobytes())

        held = _Held()
        for keys, parts in texts(batches):
            words = Words(parts)
            starts, places, runs = anchors(words, window)
            ids = np.array([k for k, in keys], np.int64)
            keep = sketches.marked(flags, sketches.counters(runs[places], bits))
            starts, places = starts[keep], places[keep]
            if not len(starts):
                continue
            more = (mix2(windows(words.hash, window, WORD_BASE_2)[starts]) >> np.uint64(32)).astype(np.uint32)
            doc = words.doc[starts]
            held.add(runs[places], more, ids[doc], starts - words.first[doc])
            if held.total >= FLUSH_WINDOWS:
                yield from flush(held)
                held = _Held()
        if held.total:
            yield from flush(held)

    def second_pass(batches):
        now, held = None, _Held()

        def close():
            _, _, doc, start, later, _ = held.settled()
            return _by_doc(doc[later], start[later]) if later.any() else ()
        for s, doc_id, more, fresh, docs_, steps in rows(batches, 64):
            if s != now:
                if held.total:
                    yield from close()
                now, held = s, _Held()
            if doc_id is not None:
                yield doc_id, more
                continue
            n = len(fresh) // 12
            anchor, counts = np.frombuffer(fresh[:8 * n], "<u8"), np.frombuffer(fresh[8 * n:], "<u4")
            held.add(np.repeat(anchor, counts), np.frombuffer(more, "<u4"), np.cumsum(np.frombuffer(docs_, "<i8")),
                     np.cumsum(np.frombuffer(steps, "<i4").astype(np.int64)))
        if held.total:
            yield from close()

    posted = arrow_map(source, first_pass, "slice int, doc_id bigint, a binary, b binary, c binary, d binary")
    dealt = posted.repartition(partitions(spark), "slice").sortWithinPartitions("slice")
    return arrow_map(dealt, second_pass, "doc_id bigint, starts binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW, bits: int = BITS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one blank) of every row."""
    source = ids_and_text(docs, id_col, text_col)
    covered = (covered_windows(source.where(F.col("doc_id").isNotNull()), window, bits).groupBy("doc_id")
               .agg(F.collect_list("starts").alias("starts")))
    joined = source.join(covered, "doc_id", "left").select("doc_id", "starts", "text")

    def task(batches):
        for doc_id, blobs, text in rows(batches):
            words = text.encode("utf-8", "replace").split()
            gone = 0
            if blobs:
                edge = np.zeros(len(words) + window + 1, np.int32)
                starts = np.unique(np.concatenate([np.frombuffer(b, "<u4") for b in blobs]))
                starts = starts[starts + window <= len(words)]
                edge[starts] += 1
                edge[starts + window] -= 1
                stay = np.cumsum(edge)[:len(words)] == 0
                gone = len(words) - int(stay.sum())
                words = [w for w, k in zip(words, stay.tolist()) if k]
            yield doc_id, len(words) + gone, gone, b" ".join(words).decode()
    return arrow_map(joined, task, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
