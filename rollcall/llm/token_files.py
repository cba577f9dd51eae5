"""Token-id files: flat unsigned integers, 64-bit document offsets, and a manifest with the base of each shard.

One shard is one range of ascending document ids and one task. A task writes ``<shard>.bin`` (ids, unsigned 16 bits
where the vocabulary allows, else 32), ``<shard>.off`` (unsigned 64-bit offsets into the shard, one more than
documents) and ``<shard>.doc`` (signed 64-bit document ids). The manifest (Parquet) has a row per shard; its bases
are prefix sums of the shards' counts, so that shards are written independently and still form one id sequence.

Files are written under another name and renamed when complete. A repeated task writes the same rows in the same
order, so an executor may be lost at any time.

Defined cases: a null text is empty and has the end id alone; a null document id is written as the smallest
64-bit value and comes back as null; equal document ids are ordered by text; an empty table gives a manifest
without rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_map, groups, ids_and_text, partitions, rows

NO_ID = -(1 << 63)
READ_DOCS = 256
MANIFEST = "shard int, n_docs bigint, n_tokens bigint, width int"


def _open_fs(folder: str):
    """A file system that reaches the shared folder from any executor: local mounts, HDFS or object stores."""
    from pyarrow import fs
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text", shards: int | None = None, cache_words: int = tokens.CACHE_WORDS, hold: bool = False) -> DataFrame:
    """Encode whole texts in ascending document order into token files; returns the manifest with bases.

    ``cache_words`` bounds a worker's caches; with ``hold`` they last from task to task of this stage.
    """
    spark = docs.sparkSession
    n = shards or partitions(spark)

    def task(batches):
        from pyspark import TaskContext
        enc = tokens.encoder(tokenizer, cache_words)
        dtype = np.dtype("<u2" if max(len(enc.closes) - 1, end_id) < 1 << 16 else "<u4")
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, path = _open_fs(folder)
        store.create_dir(path, recursive=True)
        ends, ids, total, end = [0], [], 0, np.array([end_id], "<u4").tobytes()
        part = f"{path}/.{shard}-{attempt}"
        with store.open_output_stream(f"{part}.bin") as out:
            for held in groups(rows(batches), lambda r: len(r[1]) + 16, 1 << 21):
                made = enc.many([t for _, t in held])
                for (doc, _), data in zip(held, made):
                    total += len(data) // 4 + 1
                    ends.append(total)
                    ids.append(NO_ID if doc is None else doc)
                out.write(np.frombuffer(end.join([*made, b""]), "<u4").astype(dtype).tobytes())
        if not hold:
            enc.forget()
        for ext, values in (("off", np.array(ends, "<u8")), ("doc", np.array(ids, "<i8"))):
            with store.open_output_stream(f"{part}.{ext}") as out:
                out.write(values.tobytes())
        for ext in ("bin", "off", "doc"):
            store.move(f"{part}.{ext}", f"{path}/{shard:06d}.{ext}")
        if ids:
            yield shard, len(ids), total, dtype.itemsize

    ordered = ids_and_text(docs, id_col, text_col).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    arrow_map(ordered, task, MANIFEST, keeps="encoders").write.parquet(f"{folder}/counts")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard with the ids and documents before it (a prefix sum over shards, not over documents)."""
    counts = spark.read.schema(MANIFEST).parquet(f"{folder}/counts")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("*", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"),
                         F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("doc_base"))


class Shard:
    """A shard's arrays, memory-mapped where the folder is a mounted one, else read by ranges."""

    def __init__(self, folder: str, shard: int, n_docs: int, width: int):
        self.store, path = _open_fs(folder)
        self.name, self.dtype = f"{path}/{shard:06d}", np.dtype(f"<u{width}")
        self.mapped = None
        if self.store.type_name == "local":
            self.mapped = np.memmap(f"{self.name}.bin", self.dtype, "r")
        self.offsets = self._read("off", "<u8", 0, n_docs + 1)
        self.docs = self._read("doc", "<i8", 0, n_docs)

    def _read(self, ext: str, dtype, start: int, stop: int) -> np.ndarray:
        kind = np.dtype(dtype)
        with self.store.open_input_file(f"{self.name}.{ext}") as f:
            return np.frombuffer(f.read_at((stop - start) * kind.itemsize, start * kind.itemsize), kind)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids of some documents in a row."""
        a, b = int(self.offsets[first]), int(self.offsets[last])
        return self.mapped[a:b] if self.mapped is not None else self._read("bin", self.dtype, a, b)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document, read from the files: its place in the whole id sequence and a checksum of its ids."""
    def task(batches) -> Iterator[tuple]:
        for shard, n_docs, _, width, base, _ in rows(batches):
            part = Shard(folder, shard, n_docs, width)
            for at in range(0, n_docs, READ_DOCS):
                to = min(at + READ_DOCS, n_docs)
                data, edge = memoryview(part.ids(at, to).astype("<u4").tobytes()), part.offsets[at:to + 1].tolist()
                for doc, a, b in zip(part.docs[at:to].tolist(), edge, edge[1:]):
                    yield (None if doc == NO_ID else doc, base + a, b - a,
                           zlib.crc32(data[(a - edge[0]) * 4:(b - edge[0]) * 4]))

    table = manifest(spark, folder)
    shards = table.repartition(partitions(spark), "shard")
    return arrow_map(shards, task, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
