"""Benchmark decontamination by edit distance, with the pigeonhole principle as the filter.

Texts and items are compared with ASCII case folded and white space runs as one blank. An item of n bytes may
occur with up to floor(n * RATIO) edits. Cut into that many pieces plus one, at least one piece is unchanged in
any such occurrence. A piece's first bytes are looked up by hash at every place of a text, hits are compared
whole, and the surroundings of a hit are verified by Myers' bit-parallel distance.

Items are taken in blocks of bounded size; the pieces of a block travel to the tasks and documents stay where they
are, so nothing is shuffled and no pair is made that does not share a piece.

Items with fewer than ``SHORTEST`` bytes after folding allow no edits and are looked for as they are, with no letter,
digit or byte above 127 on either side.

Defined cases: null texts are empty and match nothing, items without a visible byte as well; equal items are reported under each of their ids; repeated documents
are judged alike; without items or documents nothing is found. Extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import edits
from .common import BYTE_BASE, LOWER, arrow_map, byte_codes, groups, ids_and_text, keep_rows, mix, powers, texts, worker_state

RATIO, SHORTEST, BLOCK_BYTES = 0.05, 24, 8 << 20
# places that are not between two bytes of a word
_EDGE = re.compile(rb"(?<![a-z0-9\x80-\xff])(?s:.)|(?s:.)(?<![a-z0-9\x80-\xff])")


def folded(text: bytes) -> bytes:
    return b" ".join(text.translate(LOWER).split())


def pieces(n: int, budget: int) -> list[tuple[int, int]]:
    """Starts and ends of budget + 1 pieces of about equal length."""
    edges = [n * i // (budget + 1) for i in range(budget + 2)]
    return list(zip(edges, edges[1:]))


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple[int, bytes]], ratio: float):
        self.items = [(i, t, int(len(t) * ratio)) for i, t in items if len(t) >= SHORTEST]
        self.short: dict[bytes, list[int]] = {}
        for i, t in items:
            if len(t) < SHORTEST:
                self.short.setdefault(t, []).append(i)
        self.lengths = sorted({len(t) for t in self.short})
        self.pieces = [(k, a, b) for k, (_, t, e) in enumerate(self.items) for a, b in pieces(len(t), e)]
        self.width = min((b - a for _, a, b in self.pieces), default=1)
        heads = [self.items[k][1][a:a + self.width] for k, a, _ in self.pieces]
        h = self._hashes(b"".join(heads))[::self.width] if heads else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.keys, self.order = h[order], order
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.keys >> np.uint64(42)] = True

    def _hashes(self, data: bytes) -> np.ndarray:
        """Hash of the ``width`` bytes from each place on."""
        codes = byte_codes()[np.frombuffer(data, np.uint8)]
        if len(codes) < self.width:
            return np.empty(0, np.uint64)
        up, down = powers(BYTE_BASE, len(codes))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up, dtype=np.uint64)])
        return mix((sums[self.width:] - sums[:-self.width]) * down[:len(codes) - self.width + 1])

    def _short_in(self, text: bytes) -> dict[int, int]:
        """Short items that stand in a text between word boundaries."""
        found: dict[int, int] = {}
        if self.short:
            edges = [m.start() for m in _EDGE.finditer(text)] + [len(text)]
            ends = set(edges)
            for a in edges:
                for n in self.lengths:
                    if a + n in ends and text[a:a + n] in self.short:
                        found.update(dict.fromkeys(self.short[text[a:a + n]], 0))
        return found

    def find(self, parts: list[bytes]) -> list[dict[int, int]]:
        """For each text, the distance of each item found within its budget."""
        found: list[dict[int, int]] = [self._short_in(p) for p in parts]
        data = b"\n".join(parts)
        if not self.items or not data:
            return found
        h = self._hashes(data)
        place = np.flatnonzero(self.maybe[h >> np.uint64(42)])
        low, high = (np.searchsorted(self.keys, h[place], side) for side in ("left", "right"))
        starts = np.cumsum([0] + [len(p) + 1 for p in parts])
        tried = set()
        for p, lo, hi in zip(place[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
            d = int(np.searchsorted(starts, p, "right")) - 1
            first, last = int(starts[d]), int(starts[d + 1]) - 1
            for j in self.order[lo:hi].tolist():
                k, a, b = self.pieces[j]
                item, text, budget = self.items[k]
                if found[d].get(item) == 0 or (d, k, p - a) in tried or data[p:p + b - a] != text[a:b]:
                    continue
                tried.add((d, k, p - a))
                around = data[max(first, p - a - budget):min(last, p - a + len(text) + budget)]
                best = 0 if text in around else edits.best_match(text, around) if budget else 1
                if best <= budget:
                    found[d][item] = min(best, found[d].get(item, best))
        return found


def _matcher(shared, ratio: float) -> Matcher:
    """The matcher of a broadcast block, made once for a Python worker."""
    held = worker_state().setdefault("matcher", {})
    if held.get("key") != (shared._path, ratio):
        held.update(key=(shared._path, ratio), matcher=Matcher(shared.value, ratio))
    return held["matcher"]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> list[list[tuple[int, bytes]]]:
    """Items in blocks of bounded size, read one block at a time from the item table (the stated query set)."""
    rows = items.select(F.col(id_col).cast("bigint"), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator()
    usable = ((i, t) for i, t in ((i, folded(t.encode("utf-8", "replace"))) for i, t in rows if i is not None)
              if t)
    return groups(usable, lambda r: len(r[1]), BLOCK_BYTES)


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """(doc_id, item_id, distance): the items found in each document."""
    def one(block):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def task(batches):
            for ids, parts in texts(batches):
                for (doc,), hits in zip(ids, _matcher(shared, ratio).find([folded(p) for p in parts])):
                    for item, d in hits.items():
                        yield doc, item, d
        return arrow_map(ids_and_text(docs, id_col, text_col), task, "doc_id bigint, item_id bigint, distance int", keeps="matcher")
    empty = docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, distance int")
    parts = [one(b) for b in _blocks(items, item_col, item_text_col)]
    return reduce(DataFrame.unionAll, parts) if parts else empty


def remove_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                        item_text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """The rows in which no item is found, with all their columns, filtered where they lie."""
    def one(kept, block):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(parts):
            return np.array([not hits for hits in _matcher(shared, ratio).find([folded(p) for p in parts])], bool)
        return keep_rows(kept, text_col, clean)
    return reduce(one, _blocks(items, item_col, item_text_col), docs)
