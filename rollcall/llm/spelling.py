"""Spelling variants by reduced-alphabet generation.

1. Words are counted per task and summed (combined before the shuffle); those long and frequent enough are the
   vocabulary.
2. Letters are hashed to ``SYMBOLS`` symbols. Two words one edit apart have reduced words that are equal or one edit
   apart, so every word generates the full one-edit neighbourhood of its reduced word. An edit in one half of a word
   leaves the other half as it is: a neighbour's key also holds the untouched half of the *original* word. So a
   crowded reduced word is dealt out over many keys, and few candidates fail.
3. Keys of neighbours are joined to the keys of the reduced vocabulary (two a word, one for each half), and candidate
   pairs are verified on the original strings. A key is a 64-bit hash of what it stands for: equal things have equal
   keys, so no pair is lost, and a chance collision ends at the verification.
4. A word's form is its most frequent near word; forms are followed to the root by pointer doubling (a form has at
   least ``ratio`` times the count, so there are no cycles and few rounds).

A word longer than ``LONG`` code points is carried by its digest until candidates are known, so that a run of a
million letters costs rows of a fixed size.

Defined cases: a null text has no words, a null id reads as empty text where ids matter; repeated rows count each for
itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import mix, partitions, powers, release, rows, short_batches, stored, trim

SYMBOLS_BITS = 2                  # letters are hashed to 4 symbols
LONG = 64
REDUCED_BASE, LETTER_BASE = 0xD6E8FEB86659FD93, 0x8CB92BA72F3D8DD7
SIDES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
# a letter of [A-Za-zÀ-ÿ] in Latin-1, lower-cased if it is A-Z; all else is a blank
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
FLUSH_WORDS, CELLS = 500_000, 1 << 20


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function that yields lists of columns."""
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def task(batches):
        release(None)
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type)
                                              for c, f in zip(columns, arrow)], schema=arrow)
        trim()
    short_batches(df.sparkSession)
    return df.mapInArrow(task, out)


# ---------------------------------------------------------------- words

def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3,
                change: Callable[[bytes, int], bytes] | None = None) -> DataFrame:
    """word, n: maximal runs of letters of all texts, A-Z lower-cased, of enough code points and occurrences.

    ``change`` may alter a run of a document: it gets the run in Latin-1 and the crc32 of ``<id>:<run>`` in UTF-8.
    """
    source = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def tally(batches):
        seen: dict[bytes, int] = {}

        def flush():
            yield [[w.decode("latin-1") for w in seen], list(seen.values())]
            seen.clear()
        for doc, text in rows(batches):
            own = Counter(text.encode("latin-1", "replace").translate(LETTERS).split())
            if change is not None:
                head = zlib.crc32(f"{doc}:".encode())
                for w, n in own.items():
                    c = change(w, zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), head))
                    if len(c) >= least_length:
                        seen[c] = seen.get(c, 0) + n
            else:
                for w, n in own.items():
                    if len(w) >= least_length:
                        seen[w] = seen.get(w, 0) + n
            if len(seen) > FLUSH_WORDS:
                yield from flush()
        yield from flush()
    return (map_batches(source, tally, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least_count))


# ---------------------------------------------------------------- keys

class _Hashes:
    """Prefix sums of words of one length, reduced and original; hashes of their neighbours and halves."""

    def __init__(self, words: list[str]):
        self.length = length = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.uint64)
        codes = mix((codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        self.symbols = (codes >> np.uint64(64 - SYMBOLS_BITS)) + np.uint64(1)
        self.up, self.down = powers(REDUCED_BASE, length + 2)
        up, self.letter_down = powers(LETTER_BASE, length + 2)
        self.reduced, self.letters = self._sums(self.symbols * self.up[:length]), self._sums(codes * up[:length])

    @staticmethod
    def _sums(values: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros((len(values), 1), np.uint64), np.cumsum(values, axis=1, dtype=np.uint64)], axis=1)

    def half(self, length: int, right: bool) -> np.ndarray:
        """The untouched half of a neighbour of this length, as a hash of the original letters."""
        if not right:
            part = self.letters[:, length // 2]
        else:
            at = self.length - (length - length // 2)
            part = (self.letters[:, self.length] - self.letters[:, at]) * self.letter_down[at]
        return mix(part + SIDES[int(right)] * np.uint64(2 * length + 1))

    def own(self) -> np.ndarray:
        """The two keys of every word."""
        return np.stack([mix(self.reduced[:, -1] + self.half(self.length, r)) for r in (False, True)], axis=1)

    def neighbours(self) -> np.ndarray:
        """Keys of all reduced words within one edit; each edit goes with the half that it leaves alone."""
        n, length = len(self.reduced), self.length
        total, every = self.reduced[:, -1:], np.arange(1, (1 << SYMBOLS_BITS) + 1, dtype=np.uint64)
        at = self.up[:length] * np.ones((n, 1), np.uint64)
        replaced = (total + (np.uint64(0) - self.symbols) * at)[:, :, None] + every * at[:, :, None]
        removed = (self.reduced[:, :-1] + (total - self.reduced[:, 1:]) * self.down[1])[:, :, None]
        added = ((self.reduced + (total - self.reduced) * self.up[1])[:, :, None]
                 + every * (self.up[:length + 1])[None, :, None])
        keys = []
        for made, size in ((replaced, length), (removed, length - 1), (added, length + 1)):
            place = np.arange(made.shape[1])
            for right, chosen in ((False, place >= size // 2), (True, place < size // 2)):
                if chosen.any():
                    part = made[:, chosen, :].reshape(n, -1)
                    keys.append(mix(part + self.half(size, right)[:, None]))
        return np.sort(np.concatenate(keys, axis=1), axis=1)


def _by_length(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str], pa.RecordBatch]]:
    """(places, words, batch): words of equal length, a bounded number of cells at a time."""
    for batch in batches:
        groups: dict[int, list[int]] = {}
        words = batch.column(0).to_pylist()
        for i, w in enumerate(words):
            groups.setdefault(len(w), []).append(i)
        for length, places in groups.items():
            step = max(1, CELLS // ((length + 1) << SYMBOLS_BITS + 1))
            for k in range(0, len(places), step):
                yield places[k:k + step], [words[i] for i in places[k:k + step]], batch


def _keys(words: DataFrame, neighbours: bool, carried: str) -> DataFrame:
    """key and the carried columns of every word: of its reduced neighbours, or of itself."""
    names = words.columns[1:]

    def task(batches):
        for places, held, batch in _by_length(batches):
            hashes = _Hashes(held)
            keys = hashes.neighbours() if neighbours else hashes.own()
            fresh = np.ones(keys.shape, bool)
            fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
            which = pa.array(np.array(places)[np.nonzero(fresh)[0]])
            yield [pa.array(keys[fresh].view(np.int64))] + [batch.column(1 + i).take(which) for i in range(len(names))]
    return map_batches(words, task, f"key bigint, {carried}")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """word, near, near_n: ordered pairs of words that differ by exactly one inserted, deleted or replaced code point."""
    short = vocabulary.where(F.length("word") <= LONG)
    left = _keys(short.select("word", F.col("word").alias("w")), True, "word string")
    right = _keys(short.select("word", F.col("word").alias("w"), "n"), False, "near string, near_n bigint")
    one = F.levenshtein("word", "near", 1) == 1
    pairs = left.join(right, "key").where(one).select("word", "near", "near_n")
    long = vocabulary.where(F.length("word") >= LONG).withColumn("id", F.sha2("word", 256))
    if long.isEmpty():
        return pairs
    left = _keys(long.select("word", "id"), True, "a string")
    right = _keys(long.select("word", "id"), False, "b string")
    found = left.join(right, "key").where("a <> b").select("a", "b").distinct()
    more = (found.join(long.select(F.col("id").alias("a"), "word"), "a")
            .join(long.select(F.col("id").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n")), "b")
            # pairs within the limit are among the short ones already
            .where(one & (F.greatest(F.length("word"), F.length("near")) > LONG)).select("word", "near", "near_n"))
    return pairs.unionAll(more)


def roots(links: DataFrame) -> DataFrame:
    """word, root from an acyclic table (word, form): pointers are doubled until none moves; every round is written."""
    now = stored(links.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                F.col("next").isNotNull().alias("moved")))
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def group_variants(vocabulary: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n for a table (word, n) of distinct words."""
    vocabulary = stored(vocabulary.select("word", "n"))
    # one shuffle by word serves both the removal of repeated pairs and the sums; a word has a bounded number of near words
    pairs = near_pairs(vocabulary).repartition(partitions(vocabulary.sparkSession), "word").groupBy("word", "near", "near_n").agg(F.lit(1).alias("one"))
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    enough = -F.col("best.minus") >= ratio * F.col("n")
    told = stored(vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")))
    ends = roots(told.where("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
