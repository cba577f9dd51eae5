"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree, searched best bin first.

1. The tree is grown on a sample of about ``SAMPLE`` rows (a stated bound, drawn by a hash of the row): k-means with
   ``BRANCHES`` centres, again within each part, until a leaf has about ``LEAF_ROWS`` rows of the sample. The tree is
   the only thing that is broadcast beside the calibration queries; both have that bound.
2. Every row of the table is assigned to a leaf and packed with others of its leaf into blocks of ``BLOCK`` vectors.
   A leaf with many rows (a very common vector) is dealt out over several keys, ``KEY_ROWS`` rows each.
3. Calibration: for at most ``CALIBRATION`` queries the true neighbours come from one scan of all rows. The number of
   leaf visits is widened until the share of true neighbours in the first leaves of each query's own order reaches
   the wanted recall.
4. A query goes through the tree with a priority queue: the node with the largest expected inner product (centre, plus
   the query's length times the node's spread) is opened first, until it has visited so many leaves, and in any case
   until these hold enough rows for a full answer. Queries are packed by leaf and joined to the blocks by key.
5. A task keeps the best ``k`` of each query over its blocks; scores are computed again in double precision, in one
   order of summation for all, before they are ranked.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do vectors
whose length is not the most common one (ties: the smallest). Rows with equal or null ids are told apart: each is a
query of its own if its id asks for it, and a candidate of the others. Fewer candidates than ``k``: all of them.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, partitions, rows, stored

SAMPLE, BRANCHES, LEAF_ROWS, ROUNDS = 1 << 16, 8, 160, 8
BLOCK, KEY_ROWS, PROBE = 128, 4096, 64
CALIBRATION, RECALL = 256, 0.95
HELD = 1 << 19                     # candidates a task holds before it keeps the best k of each query


class Tree:
    """Centres and spreads of all nodes, children of inner nodes, numbers of leaves."""

    def __init__(self, sample: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.centre, self.spread, self.children, self.leaf, self.leaves = [], [], [], [], 0
        waiting = [(self._node(sample), sample)]
        while waiting:
            node, own = waiting.pop()
            parts = self._split(own, rng) if len(own) > LEAF_ROWS else []
            if len(parts) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            made = [self._node(p) for p in parts]
            self.children[node] = made
            waiting += zip(made, parts)
        self.centre, self.spread = np.array(self.centre), np.array(self.spread)
        self.children = [np.array(c, np.int64) for c in self.children]

    def _node(self, own: np.ndarray) -> int:
        centre = own.mean(axis=0)
        self.centre.append(centre)
        # the standard deviation of a row's product with a unit vector, doubled: what a good row of the node may add
        self.spread.append(2 * math.sqrt(float(((own - centre) ** 2).sum(axis=1).mean()) / own.shape[1]))
        self.children.append([])
        self.leaf.append(-1)
        return len(self.centre) - 1

    @staticmethod
    def _split(own: np.ndarray, rng) -> list[np.ndarray]:
        k = min(BRANCHES, max(2, len(own) // LEAF_ROWS))
        centres = own[rng.choice(len(own), k, replace=False)]
        for _ in range(ROUNDS):
            part = nearest(own, centres)
            centres = np.array([own[part == i].mean(axis=0) for i in range(len(centres)) if (part == i).any()])
        part = nearest(own, centres)
        return [own[part == i] for i in range(len(centres)) if (part == i).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row: the nearest centre at each level."""
        out, waiting = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while waiting:
            node, idx = waiting.pop()
            below = self.children[node]
            if not len(below):
                out[idx] = self.leaf[node]
                continue
            part = nearest(x[idx], self.centre[below])
            waiting += [(int(c), idx[part == i]) for i, c in enumerate(below) if (part == i).any()]
        return out

    def best_first(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a priority queue over nodes."""
        size, queue = float(np.sqrt(query @ query)), [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if not len(below):
                yield self.leaf[node]
                continue
            likely = self.centre[below] @ query + size * self.spread[below]
            for p, c in zip((-likely).tolist(), below.tolist()):
                heapq.heappush(queue, (p, c))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(axis=1)[None, :] - 2 * (x @ centres.T), axis=1)


def best(of: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of each value of ``of``; ties go to the smaller ``tie``."""
    order = np.lexsort((tie, -score, of))
    own = of[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return order[rank < k]


def products(vectors: np.ndarray, ids: np.ndarray, row: np.ndarray, queries: np.ndarray, query_rows: np.ndarray, k: int):
    """(query place, vector place, score) of what may be among the k best of these vectors for each query."""
    rough = vectors @ queries.T
    rough[row[:, None] == query_rows[None, :]] = -np.inf
    cut = np.partition(rough, len(rough) - k, axis=0)[len(rough) - k] if len(rough) > k else np.full(len(queries), -np.inf)
    slack = 1e-9 * (np.abs(vectors).max() * np.abs(queries).max() * vectors.shape[1] + 1e-300)
    v, q = np.nonzero((rough >= cut[None, :] - slack) & (rough > -np.inf))
    score = (vectors[v] * queries[q]).sum(axis=1)
    keep = best(q, score, ids[v], k)
    return q[keep], v[keep], score[keep]


class Kept:
    """The best k candidates of each query of a task, with a bound on what is held between."""

    def __init__(self, k: int):
        self.k, self.parts, self.size, self.most = k, [], 0, HELD

    def add(self, *columns: np.ndarray) -> None:
        """query row, query id, score, candidate id, candidate's row (or another number to hand on)."""
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size > self.most:
            self.parts = [self._best()]
            self.size = len(self.parts[0][0])
            self.most = max(HELD, 2 * self.size)

    def _best(self):
        c = [np.concatenate(x) for x in zip(*self.parts)]
        keep = best(c[0], c[2], c[3], self.k)
        return [x[keep] for x in c]

    def rows(self) -> Iterator[tuple]:
        if self.parts:
            yield from zip(*(c.tolist() for c in self._best()))


CANDIDATE = "query_row bigint, query_id bigint, score double, vec_id bigint, extra bigint"


def valid(df: DataFrame, id_col: str, vector_col: str, is_query: Column) -> DataFrame:
    """row, vec_id, vector (doubles), query: rows whose vectors can take part, of the most common length."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    out = stored(df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("vec_id"), v.alias("vector"),
                           F.coalesce(is_query, F.lit(False)).alias("query")).where(fine))
    sizes = out.groupBy(F.size("vector").alias("size")).count()
    size = sizes.agg(F.min(F.struct((-F.col("count")).alias("n"), "size"))["size"]).first()[0]
    return out.where(F.size("vector") == F.lit(size if size is not None else 0))


def search(df: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row chosen as a query, against all rows."""
    spark = df.sparkSession
    table = valid(df, id_col, vector_col, is_query)
    total = table.count()
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    drawn = F.pmod(F.xxhash64("row", F.lit(17)), F.lit(1 << 30)) < F.lit(math.ceil((1 << 30) * min(1.0, SAMPLE / total)))
    sample = [np.array(r.vector) for r in table.where(drawn).select("vector").toLocalIterator()]
    tree = spark.sparkContext.broadcast(Tree(np.array(sample or [table.first().vector])))

    # vectors travel in their own precision; sums are in double precision
    sent = "<f4" if dict(df.select(vector_col).dtypes)[vector_col] == "array<float>" else "<f8"

    def to_leaves(batches):
        for held in _matrices(batches):
            for leaf, r in zip(tree.value.assign(held[1]).tolist(), held[0]):
                yield leaf, r[0], r[1], r[2], np.array(r[3], sent).tobytes()
    index = stored(arrow_map(table.select("row", "vec_id", "query", "vector"), to_leaves,
                             "leaf int, row bigint, vec_id bigint, query boolean, vector binary"))
    counts = np.zeros(tree.value.leaves, np.int64)
    for r in index.groupBy("leaf").count().collect():            # one row a leaf: bounded by the tree
        counts[r["leaf"]] = r["count"]
    keys = np.maximum(1, -(-counts // KEY_ROWS))

    visits = calibrate(index, tree, k, recall, sent)
    # one row for each leaf with several keys: bounded by the tree
    split = spark.createDataFrame([(i, int(n)) for i, n in enumerate(keys) if n > 1] or [(-1, 1)], "leaf int, keys int")
    part = F.pmod(F.col("row"), F.coalesce("keys", F.lit(1))).cast("int").alias("part")
    packed = (index.join(F.broadcast(split), "leaf", "left").select("leaf", part, "row", "vec_id", "vector")
              .repartition(partitions(spark), "leaf", "part").sortWithinPartitions("leaf", "part"))

    def blocks(batches):
        held, key = [], None

        def out():
            yield key[0], key[1], _packed([r[0] for r in held]), _packed([r[1] for r in held]), b"".join(r[2] for r in held)
        for leaf, part, row, vec_id, vector in rows(batches):
            if held and (key != (leaf, part) or len(held) >= BLOCK):
                yield from out()
                held = []
            key = leaf, part
            held.append((row, vec_id, vector))
        if held:
            yield from out()
    data = arrow_map(packed, blocks, "leaf int, part int, rows binary, ids binary, vectors binary")

    def probes(batches):
        for queries in _chunks(rows(batches), 2048):
            asked: dict[int, list[tuple]] = {}
            for q in queries:
                found = 0
                for i, leaf in enumerate(tree.value.best_first(_vectors(q[2], sent, 1)[0])):
                    if i >= visits and found > k:
                        break
                    found += int(counts[leaf])
                    if counts[leaf]:
                        asked.setdefault(leaf, []).append(q)
            for leaf, held in asked.items():
                for at in range(0, len(held), PROBE):
                    p = held[at:at + PROBE]
                    for part in range(int(keys[leaf])):
                        yield leaf, part, _packed([q[0] for q in p]), _packed([q[1] for q in p]), b"".join(q[2] for q in p)
    asked = arrow_map(index.where("query").select("row", "vec_id", "vector"), probes,
                      "leaf int, part int, query_rows binary, query_ids binary, queries binary")

    def score(batches):
        kept = Kept(k)
        for r, i, v, qr, qi, q in rows(batches, 16):
            r, i, qr, qi = (np.frombuffer(x, "<i8") for x in (r, i, qr, qi))
            v, q = _vectors(v, sent, len(r)), _vectors(q, sent, len(qr))
            a, b, s = products(v, i, r, q, qr, k)
            kept.add(qr[a], qi[a], s, i[b], r[b])
        yield from kept.rows()
    found = data.join(asked, ["leaf", "part"]).select("rows", "ids", "vectors", "query_rows", "query_ids", "queries")
    found = arrow_map(found, score, CANDIDATE, batch_rows=16384)
    place = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc("vec_id"), "extra")
    shown = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return (found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            .select(shown("query_id"), "rank", shown("vec_id"), "score"))


def calibrate(index: DataFrame, tree, k: int, recall: float, sent: str) -> int:
    """The number of leaf visits at which bounded calibration queries find this share of their true neighbours."""
    wanted = index.where("query")
    total = wanted.count()
    if not total:
        return 1
    drawn = F.pmod(F.xxhash64("row", F.lit(29)), F.lit(1 << 30)) < F.lit(math.ceil((1 << 30) * min(1.0, CALIBRATION / total)))
    chosen = wanted.where(drawn).select("row", "vector").collect() or wanted.select("row", "vector").limit(CALIBRATION).collect()
    asked = [(r["row"], _vectors(bytes(r["vector"]), sent, 1)[0]) for r in chosen]
    queries_of = index.sparkSession.sparkContext.broadcast((np.array([a for a, _ in asked]), np.array([v for _, v in asked])))

    def scan(batches):
        query_rows, queries = queries_of.value
        kept = Kept(k)
        for held in _chunks(rows(batches), 2048):
            leaf, r, i = (np.array([h[j] for h in held], np.int64) for j in range(3))
            a, b, s = products(_vectors(b"".join(h[3] for h in held), sent, len(held)), i, r, queries, query_rows, k)
            kept.add(query_rows[a], query_rows[a], s, i[b], leaf[b])
        yield from kept.rows()
    place = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc("vec_id"), "extra")
    ids = index.select("leaf", "row", F.coalesce("vec_id", F.lit(NULL_ID)).alias("vec_id"), "vector")
    true = (arrow_map(ids, scan, CANDIDATE).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            .select("query_row", F.col("extra").alias("leaf")).collect())
    if not true:
        return 1
    order = {row: {leaf: i for i, leaf in enumerate(tree.value.best_first(v))} for row, v in asked}
    places = np.array([order[r["query_row"]][r["leaf"]] for r in true])
    visits = 1
    while (places < visits).mean() < recall:
        visits = max(visits + 1, math.ceil(visits * 1.1))
    return visits


NULL_ID = -(1 << 63)              # stands for a null id within tasks


def _packed(numbers: list) -> bytes:
    return np.array([NULL_ID if x is None else x for x in numbers], "<i8").tobytes()


def _vectors(data: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(n, -1).astype(np.float64)


def _chunks(items, size: int) -> Iterator[list]:
    held = []
    for x in items:
        held.append(x)
        if len(held) >= size:
            yield held
            held = []
    if held:
        yield held


def _matrices(batches) -> Iterator[tuple[list, np.ndarray]]:
    for held in _chunks(rows(batches), 4096):
        yield held, np.array([r[3] for r in held], np.float64)
