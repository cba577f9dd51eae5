"""What the operators share: stored tables, Arrow batches in and out of a task, hashing of words in bulk."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.keys import ensure_checkpoint_dir

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# ---------------------------------------------------------------- tables

def shared_dir(spark: SparkSession) -> str:
    """A new folder under the checkpoint folder of the cluster, which the driver and all executors reach."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        ensure_checkpoint_dir(spark)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base}/rollcall-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a table that is read more than once to the shared folder; its lineage ends there."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ids_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names, so that other columns of any name cannot clash."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


# ---------------------------------------------------------------- Arrow in a task

def worker_state() -> dict:
    """What the tasks of one Python worker may share: loaded models and bounded caches."""
    return vars(sys.modules.setdefault("_rollcall_worker", types.ModuleType("_rollcall_worker")))


def rows(batches: Iterable[pa.RecordBatch], step: int = 512) -> Iterator[tuple]:
    """Rows as tuples, a few at a time, so that a batch of long texts is not turned into objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns))


def groups(records: Iterable[tuple], size: Callable[[tuple], int], most: int) -> Iterator[list[tuple]]:
    """Consecutive records up to a total size; a record beyond it makes a group of its own."""
    held, total = [], 0
    for r in records:
        n = size(r)
        if held and total + n > most:
            yield held
            held, total = [], 0
        held.append(r)
        total += n
    if held:
        yield held


def texts(batches: Iterable[pa.RecordBatch], most: int = 1 << 19, lower: bool = False) -> Iterator[tuple[list, list[bytes]]]:
    """Keys and UTF-8 texts (last column) of about half a megabyte of documents at a time; whole texts, however long."""
    def encoded():
        for r in rows(batches):
            t = (r[-1] or "").encode("utf-8", "replace")
            yield r[:-1], t.translate(LOWER) if lower else t
    for held in groups(encoded(), lambda r: len(r[1]) + 16, most):
        yield [k for k, _ in held], [t for _, t in held]


BATCH_ROWS, DEFAULT_BATCH_ROWS = "1000", "10000"


def short_batches(spark: SparkSession) -> None:
    """Texts are long: unless the session has its own number, a thousand rows go to a Python worker at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, DEFAULT_BATCH_ROWS) == DEFAULT_BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def trim() -> None:
    """Return freed memory of a finished task to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def release(keeps: str | None) -> None:
    """Drop what earlier tasks left in this worker, but for small tables and what the next task goes on with."""
    state = worker_state()
    for name in [n for n in state if n not in ("powers", "codes", keeps) and not n.startswith("__")]:
        del state[name]


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], schema: str | StructType,
              batch_rows: int = 1024, batch_bytes: int = 4 << 20, keeps: str | None = None) -> DataFrame:
    """``mapInArrow`` for a function that yields tuples; batches are bounded in rows and bytes.

    ``keeps`` names the worker state (a loaded model, a cache) that tasks of this kind share.
    """
    out = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def pack(held):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    def weight(r):
        return batch_bytes // batch_rows + sum(v.nbytes if isinstance(v, np.ndarray) else len(v)
                                               for v in r if isinstance(v, (bytes, str, list, np.ndarray)))

    def task(batches):
        release(keeps)
        for held in groups(fn(batches), weight, batch_bytes):
            yield pack(held)
        trim()
    short_batches(df.sparkSession)
    return df.mapInArrow(task, out)


def keep_rows(docs: DataFrame, text_col: str, keep: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """The rows whose UTF-8 texts (null: empty) a function keeps, with all columns, filtered where they lie."""
    def task(batches):
        release("matcher")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                parts = [(t or "").encode("utf-8", "replace") for t in part.column(place).to_pylist()]
                mask = np.concatenate([keep(held) for held in groups(parts, lambda t: len(t) + 16, 1 << 19)])
                yield part.filter(pa.array(mask))
    place = docs.columns.index(text_col)
    short_batches(docs.sparkSession)
    return docs.mapInArrow(task, docs.schema)


# ---------------------------------------------------------------- words in bulk

def _mixed(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(a)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(b)
    return x ^ (x >> np.uint64(31))


def mix(x: np.ndarray) -> np.ndarray:
    return _mixed(x, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix2(x: np.ndarray) -> np.ndarray:
    return _mixed(x + np.uint64(0x9E3779B97F4A7C15), 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, kept for the worker."""
    held = worker_state().setdefault("powers", {})
    if base not in held or len(held[base][0]) < n:
        size = max(1 << 17, 1 << n.bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        held[base] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return held[base][0][:n], held[base][1][:n]


BYTE_BASE, WORD_BASE, WORD_BASE_2 = 0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def byte_codes() -> np.ndarray:
    state = worker_state()
    if "codes" not in state:
        state["codes"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return state["codes"]


class Words:
    """The words (runs without ASCII white space) of several texts: place, document and 64-bit hash of each.

    The hash of any span of bytes is a difference of prefix sums, so no word becomes a Python object.
    """

    def __init__(self, parts: list[bytes]):
        data = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)
        white = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        up, self._down = powers(BYTE_BASE, len(data))
        self._sums = np.cumsum(byte_codes()[data] * up, dtype=np.uint64)
        self.at = np.cumsum(np.array([1] + [len(p) + 1 for p in parts], np.int64))
        self.first = np.searchsorted(self.start, self.at)           # number of the first word of each text
        self.doc = np.repeat(np.arange(len(parts)), np.diff(self.first))
        self.hash = self.span(self.start, self.end)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end - 1] - self._sums[start - 1]) * self._down[start] + (end - start).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.start)


def windows(h: np.ndarray, width: int, base: int = WORD_BASE) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive values."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    up, down = powers(base, len(h))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)])
    return mix((sums[width:] - sums[:-width]) * down[:len(h) - width + 1])


def window_docs(words: Words, width: int) -> np.ndarray:
    """Which windows lie within one text (mask over all windows of the texts)."""
    n = len(words) - width + 1
    return words.doc[:n] == words.doc[width - 1:] if n > 0 else np.empty(0, bool)
