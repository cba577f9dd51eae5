"""Exact n-gram Jaccard join and its components, by prefixes under several global token orders.

A document is the set of its distinct word n-grams (ASCII case folded); documents with equal sets are one node.
Two sets with a similarity of T or more share a token among the first |x| - ceil(T |x|) + 1 tokens of each, under
any one order of all tokens. Three orders are used:

* The first has tokens of heavy use last, by a merged sketch of all documents' tokens (``HEAVIEST`` heaviest
  counters, a fixed number), and generates candidates: each token of a prefix is dealt out with its node, set size
  and place. Sizes and places bound the overlap that is still possible, and most pairs fail by that alone.
* The second and third order tokens by other hashes within the same classes. A candidate must also share a prefix
  token under both, which is tested on the prefixes, before any whole set is moved for the verification.

A token with few nodes gives all its pairs. One with many gives a star each: a node is paired with the smallest
earlier node that it may be similar to. Links of stars join nodes to components; then only pairs of nodes that share
such a token and lie in *different* components are left. A token with a linear number of these gives them all; one
with more gives stars between components again, with other centres in each round, as long as rounds join many nodes;
then all that is left is verified. So a group of thousands of near copies costs a few pairs per member, no link
between different groups is missed, and the components are those of all links.

Whole sets are read again for candidates only: documents of candidate nodes are picked by a bitmap of fixed size
(some more may pass, none is missed).

Node numbers are 62-bit hashes of sets. Defined cases: null texts, texts without words: no tokens, linked with
nothing, a component of their own; fewer words than n: the whole sequence is the one token; rows with equal ids are
one document each and share a component (and with null id have none); an empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sketches
from .common import Words, arrow_map, ids_and_text, mix, mix2, partitions, rows, stored, texts, window_docs, windows
from .components import components, forest

WORDS, SHARE = 5, (75, 100)
HEAVY_BITS, HEAVY_LEAST, HEAVIEST = 28, 16, 1 << 18
PICK_BITS = 26
FEW = 6
LINEAR = 4                  # pairs a member up to which a token gives all its pairs between components
PAYING = 8                  # stars between components go on while one in so many of their pairs joins a node
BLOCK = 2048
FLUSH_POSTS, KNOWN_PAIRS = 1_000_000, 200_000


def token_sets(parts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each (case-folded) text."""
    words = Words(parts)
    grams = windows(words.hash, n)
    inside = window_docs(words, n)
    out = []
    for k in range(len(parts)):
        a, b = int(words.first[k]), int(words.first[k + 1])
        if b - a >= n:
            out.append(np.unique(grams[a:b - n + 1]))
        elif b > a:
            out.append(windows(words.hash[a:b], b - a))
        else:
            out.append(np.empty(0, np.uint64))
    assert len(grams) == 0 or inside.sum() == sum(max(0, int(d) - n + 1) for d in np.diff(words.first))
    return out


def node_of(tokens: np.ndarray) -> int:
    """A positive 62-bit number of a set."""
    spread = np.arange(1, len(tokens) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(np.array([mix2(tokens ^ spread).sum(dtype=np.uint64)]) + np.uint64(len(tokens)))[0] >> np.uint64(2))


def prefix_length(n, share=SHARE):
    """Tokens of a set of n of which one must be shared."""
    return n - (share[0] * n + share[1] - 1) // share[1] + 1


def overlap_needed(x, y, share=SHARE):
    """Least common tokens of similar sets of x and y tokens."""
    return (share[0] * (x + y) + share[0] + share[1] - 1) // (share[0] + share[1])


class Orders:
    """Prefixes of sets under the orders; heavy: (counters, counts) in order of the counters."""

    def __init__(self, heavy: tuple[np.ndarray, np.ndarray]):
        self.counters, self.counts = heavy

    def prefix(self, tokens: np.ndarray, order: int = 0, share=SHARE) -> np.ndarray:
        p = prefix_length(len(tokens), share)
        number = sketches.counters(tokens, HEAVY_BITS)
        at = np.minimum(np.searchsorted(self.counters, number), max(0, len(self.counters) - 1))
        use = np.where(self.counters[at] == number, self.counts[at], 0) if len(self.counters) else np.zeros(len(tokens), np.int64)
        key = tokens if order == 0 else mix2(tokens) if order == 1 else mix(~tokens)
        return tokens[np.lexsort((key, use))[:p]]


def _possible(n, i, m, j, share=SHARE):
    """May two sets of n and m tokens whose first common token is at places i and j be similar?"""
    return (share[1] * np.minimum(n, m) >= share[0] * np.maximum(n, m)) & \
        (np.minimum(n - i, m - j) >= overlap_needed(n, m, share))


def _stars(node, n, i, share):
    """Each node of a token with one of the last few centres it may be similar to, in order of size; linear.

    Which centre is taken matters for speed only: pairs that stars leave out are found across components.
    """
    heads: list[int] = []
    for k in range(len(node)):
        for h in heads:
            if _may_be(n[h], i[h], n[k], i[k], share):
                yield node[h], node[k]
                break
        else:
            heads = [*heads[-3:], k]


def _stars_across(node, n, i, component, share):
    """Each node of a token with one of the last few centres of other components it may be similar to; linear."""
    heads: dict[int, int] = {}                          # by component, the latest last
    for k in range(len(node)):
        for c, h in reversed(heads.items()):
            if c != component[k] and _may_be(n[h], i[h], n[k], i[k], share):
                yield node[h], node[k]
                break
        heads.pop(component[k], None)
        heads[component[k]] = k
        if len(heads) > 4:
            del heads[next(iter(heads))]


def _two_centres(stars: DataFrame) -> DataFrame:
    """Of the stars (x, y), two centres of each member y: the one met most often and the smallest."""
    return (stars.groupBy("x", "y").agg(F.count("*").alias("met")).groupBy("y")
            .agg(F.max(F.struct("met", "x"))["x"].alias("most"), F.min("x").alias("least"))
            .select(F.explode(F.array("most", "least")).alias("x"), "y"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _may_be(n: int, i: int, m: int, j: int, share) -> bool:
    return share[1] * min(n, m) >= share[0] * max(n, m) and min(n - i, m - j) >= overlap_needed(n, m, share)


def _first_pass(source: DataFrame, n: int, heavy: tuple, share) -> DataFrame:
    """Documents with their nodes, candidate pairs, and the tokens that many nodes share."""
    spark = source.sparkSession
    n_slices = 16 * partitions(spark)
    shared = spark.sparkContext.broadcast(heavy)

    def post(batches):
        own, seen, held, total = Orders(shared.value), set(), [], 0

        def flush():
            token = np.concatenate([h[0] for h in held])
            size = [len(h[0]) for h in held]
            node, count = (np.repeat(np.array([h[k] for h in held], np.int64), size) for k in (1, 2))
            place = np.concatenate([np.arange(s) for s in size])
            part = ((token >> np.uint64(32)) * np.uint64(n_slices) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(n_slices + 1))
            for s in np.flatnonzero(np.diff(edges)).tolist():
                cut = order[edges[s]:edges[s + 1]]
                # a node's tokens of a slice lie together, and its number and size travel once
                fresh = np.flatnonzero(np.concatenate([[True], node[cut][1:] != node[cut][:-1]]))
                runs = np.diff(np.append(fresh, len(cut)))
                yield (s, None, None, None, token[cut].astype("<u8").tobytes(), place[cut].astype("<u4").tobytes(),
                       node[cut][fresh].astype("<i8").tobytes() + count[cut][fresh].astype("<i8").tobytes()
                       + runs.astype("<i8").tobytes())
        for keys, parts in texts(batches, lower=True):
            for (doc,), tokens in zip(keys, token_sets(parts, n)):
                node = node_of(tokens)
                yield (hash(doc) if doc is not None else 0) % n_slices, doc, len(tokens), node, None, None, None
                if len(tokens) and node not in seen:
                    seen.add(node)
                    p = own.prefix(tokens, 0, share)
                    held.append((p, node, len(tokens)))
                    total += len(p)
                    if total >= FLUSH_POSTS:
                        yield from flush()
                        held, total = [], 0
        if held:
            yield from flush()

    def meet(batches):
        now, held, pairs = None, [], set()

        def close():
            token, place, node, n_ = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((node, token))
            token, place, node, n_ = token[order], place[order], node[order], n_[order]
            keep = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
            token, place, node, n_ = token[keep], place[keep], node[keep], n_[keep]
            edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
            some = np.flatnonzero(np.diff(edges) > 1)
            for a, b in zip(edges[some].tolist(), edges[some + 1].tolist()):
                by = a + np.lexsort((node[a:b], n_[a:b]))
                x, c, i = node[by], n_[by], place[by]
                if b - a <= FEW:
                    first, second = np.triu_indices(b - a, 1)
                    ok = _possible(c[first], i[first], c[second], i[second], share)
                    kind, found = "pair", zip(x[first[ok]].tolist(), x[second[ok]].tolist())
                else:
                    kind, found = "star", _stars(x.tolist(), c.tolist(), i.tolist(), share)
                    for at in range(0, b - a, BLOCK):
                        cut = slice(at, at + BLOCK)
                        yield ("many", int(token[a].astype(np.int64)), None, None, x[cut].astype("<i8").tobytes()
                               + c[cut].astype("<i8").tobytes() + i[cut].astype("<i8").tobytes())
                for p, q in found:
                    if (p, q) not in pairs:
                        if len(pairs) > KNOWN_PAIRS:        # the rest of equal pairs is removed after the shuffle
                            pairs.clear()
                        pairs.add((p, q))
                        yield kind, p, q, None, None
        for s, doc, size, node, token, place, nodes in rows(batches, 64):
            if node is not None:
                yield "node", doc, node, size, None
                continue
            if s != now:
                if held:
                    yield from close()
                now, held = s, []
            own, counts, runs = np.frombuffer(nodes, "<i8").reshape(3, -1)
            held.append((np.frombuffer(token, "<u8"), np.frombuffer(place, "<u4").astype(np.int64), np.repeat(own, runs),
                         np.repeat(counts, runs)))
        if held:
            yield from close()

    posted = arrow_map(source, post, "slice int, doc_id bigint, n bigint, node bigint, token binary, place binary, nodes binary")
    dealt = posted.repartition(partitions(spark), "slice").sortWithinPartitions("slice")
    return stored(arrow_map(dealt, meet, "kind string, x bigint, y bigint, n bigint, members binary", batch_rows=8192))


def _sets(source: DataFrame, wanted: DataFrame, n: int, heavy: tuple, share) -> DataFrame:
    """Token sets, and prefixes under the second and third order, of the wanted documents and perhaps some others."""
    def places(batches):
        def values():
            for held in _arrays(batches):
                yield mix(held.astype(np.uint64))
        yield from sketches.sent(values(), PICK_BITS)

    picked = sketches.bitmap(arrow_map(wanted.select("doc_id"), places, sketches.SLICE), PICK_BITS, 1)
    spark = source.sparkSession
    shared, pick = spark.sparkContext.broadcast(heavy), spark.sparkContext.broadcast(picked)

    def task(batches):
        own, bits = Orders(shared.value), pick.value

        def chosen():
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).astype(np.uint64)
                at = np.flatnonzero(sketches.marked(bits, sketches.counters(mix(ids), PICK_BITS)))
                yield batch.take(at)
        for _, parts in texts(chosen(), lower=True):
            for tokens in token_sets(parts, n):
                if len(tokens):
                    second, third = (np.unique(own.prefix(tokens, k, share).astype(np.uint32).astype(np.int32)) for k in (1, 2))
                    yield node_of(tokens), len(tokens), second, third, tokens.astype(np.int64)

    made = arrow_map(source.where(F.col("doc_id").isNotNull()), task,
                     "node bigint, n bigint, second array<int>, third array<int>, tokens array<bigint>", batch_rows=1024)
    return stored(made)


def _arrays(batches):
    for batch in batches:
        yield batch.column(0).to_numpy(zero_copy_only=False)


def similar(common: Column, n: Column, m: Column, share=SHARE) -> Column:
    return share[1] * common >= share[0] * (n + m - common)


def _verified(pairs: DataFrame, sets: DataFrame, share) -> DataFrame:
    """The candidate pairs (a, b) that share prefix tokens under the other orders and are similar."""
    light = sets.select("node", "second", "third")
    left = light.select(F.col("node").alias("a"), F.col("second").alias("sa"), F.col("third").alias("ta"))
    right = light.select(F.col("node").alias("b"), F.col("second").alias("sb"), F.col("third").alias("tb"))
    close = (pairs.join(left, "a").join(right, "b")
             .where(F.arrays_overlap("sa", "sb") & F.arrays_overlap("ta", "tb")).select("a", "b"))
    whole = close.join(sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("x")), "a")
    whole = whole.join(sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("y")), "b")
    return whole.where(similar(F.size(F.array_intersect("x", "y")), F.col("na"), F.col("nb"), share)).select("a", "b")


def _left_over(many: DataFrame, labels: DataFrame, share, turn: int, whole: bool) -> DataFrame:
    """(x, y, star): possible pairs of nodes that share a token of many nodes and lie in different components.

    Unless ``whole``, a token with more than a linear number of them gives stars, in an order that ``turn`` changes.
    """
    spark = many.sparkSession

    def members(batches):
        for token, blob in rows(batches, 64):
            x, n, i = np.frombuffer(blob, "<i8").reshape(3, -1)
            yield from zip([token] * len(x), x.tolist(), n.tolist(), i.tolist())

    flat = arrow_map(many.select("x", "members"), members, "token bigint, node bigint, n bigint, place bigint", batch_rows=16384)
    known = (flat.join(labels, "node", "left")
             .select("token", "node", "n", "place", F.coalesce("component", "node").alias("component")))
    known = stored(known)
    open_ = (known.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo <> hi").select("token"))
    rest = (known.join(open_, "token", "left_semi").repartition(partitions(spark), "token")
            .sortWithinPartitions("token", "n", "node"))

    def cross(batches):
        def every(x, n, i, c):
            for at in range(0, len(x), BLOCK):
                for to in range(at, len(x), BLOCK):
                    if share[1] * n[at:at + BLOCK][-1] < share[0] * n[to]:
                        break                                          # sizes only grow from here
                    r, s = slice(at, at + BLOCK), slice(to, to + BLOCK)
                    ok = (c[r, None] != c[None, s]) & _possible(n[r, None], i[r, None], n[None, s], i[None, s], share)
                    p, q = np.nonzero(np.triu(ok, 1) if at == to else ok)
                    yield x[r][p], x[s][q]

        def done(token_rows):
            x, n, i, c = (np.array(v, np.int64) for v in zip(*token_rows))
            held, total = [], 0
            for p, q in every(x, n, i, c):
                if whole:
                    yield from ((a, b, False) for a, b in zip(p.tolist(), q.tolist()))
                    continue
                held.append((p, q))
                total += len(p)
                if total > LINEAR * len(x):
                    by = np.argsort(mix(x.astype(np.uint64) + np.uint64(turn)))
                    for a, b in _stars_across(*(v[by].tolist() for v in (x, n, i, c)), share):
                        yield a, b, True
                    return
            for p, q in held:
                yield from ((a, b, False) for a, b in zip(p.tolist(), q.tolist()))
        now, held = None, []
        for token, node, n, place, component in rows(batches, 8192):
            if token != now and held:
                yield from done(held)
                held = []
            now = token
            held.append((node, n, place, component))
        if held:
            yield from done(held)
    return stored(arrow_map(rest, cross, "x bigint, y bigint, star boolean", batch_rows=16384))


def jaccard_components(docs: DataFrame, n: int = WORDS, share: tuple[int, int] = SHARE, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles (size of the set) and component_id (smallest linked id, itself included) of every row."""
    source = ids_and_text(docs, id_col, text_col)

    def use(batches):
        def values():
            for _, parts in texts(batches, lower=True):
                yield np.concatenate(token_sets(parts, n))
        yield from sketches.sent(values(), HEAVY_BITS)
    heavy = sketches.heaviest(arrow_map(source, use, sketches.SLICE), HEAVY_LEAST, HEAVIEST)

    found = _first_pass(source, n, heavy, share)
    ident = found.where("kind = 'node'").select(F.col("x").alias("doc_id"), F.col("y").alias("node"), F.col("n"))
    nodes = ident.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    many = found.where("kind = 'many'")

    def linked(pairs):
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = _sets(source, nodes.join(ends, "node"), n, heavy, share)
        return _verified(pairs, sets.dropDuplicates(["node"]), share)

    # a member of stars keeps two centres; left-over pairs come later
    stars = _two_centres(found.where("kind = 'star'").select("x", "y"))
    tried = stored(_ordered(found.where("kind = 'pair'").select("x", "y").unionAll(stars)))
    links = stored(forest(linked(tried)))
    labels, turn, whole, left = components(links), 0, False, True
    while left:
        across = _left_over(many, labels, share, turn, whole)
        left = not across.where("star").isEmpty()                       # some pairs wait for a later round
        both = across.where("not star").select("x", "y").unionAll(_two_centres(across.where("star").select("x", "y")))
        more = stored(_ordered(both).join(tried, ["a", "b"], "left_anti"))
        checked, joined = more.count(), 0
        if checked:
            new = stored(forest(linked(more)))
            joined = new.count()
            tried = tried.unionAll(more)
        if joined:
            links = links.unionAll(new)
            labels = components(links)
        turn, whole = turn + 1, joined * PAYING <= checked
    least = nodes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    smallest = least.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_node = least.join(smallest, "component").select("node", "component_id")
    # most nodes are alone: only nodes of several documents or with links need the join
    return (ident.join(by_node, "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")))
