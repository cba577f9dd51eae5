"""Toxicity scores: logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

Features of a text, each counted once: hashes of its words (letters and digits, ASCII case folded), of the first
four and five bytes of longer words, of word pairs, and of pairs with one word between. Hashes have 64 bits, so
that long texts do not meet other features' weights by chance.

Training takes a documented, bounded sample of labelled rows (at most ``SAMPLE`` of either label, lowest hashes
of the document id first), and gives each coordinate its own rate and an L1 threshold: most weights are exactly
zero, and the rest travel to all tasks as two small arrays. Features met in fewer than ``MIN_DOCS`` sampled texts
are left out. Scoring reads every whole text once, without a shuffle.

Defined cases: null texts are empty and score by the bias alone; without labelled rows of both kinds every score
is the share of toxic labels (0.5 without any); repeated labels of a document count once, the largest; null
labels and labels of unknown documents are not used. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_map, ids_and_text, keep_rows, mix, texts

SAMPLE, MIN_DOCS, EPOCHS = 3000, 4, 6
THRESHOLD = 0.7
ALPHA, BETA, L1, L2 = 2.0, 1.0, 10.0, 1.0
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def features(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Document number and 64-bit feature of every n-gram and skip-gram occurrence of some texts."""
    words = Words([p.translate(LETTERS) for p in parts])
    h, doc, size = words.hash, words.doc, words.end - words.start
    out = [(doc, h)]
    for stem in (4, 5):
        long = size > stem
        out.append((doc[long], mix(words.span(words.start[long], words.start[long] + stem) + np.uint64(stem))))
    for gap, odd in ((1, 0x9FB21C651E98DF25), (2, 0xC2B2AE3D27D4EB4F)):
        same = doc[:-gap] == doc[gap:]
        out.append((doc[:-gap][same], mix(h[:-gap] * np.uint64(odd) + h[gap:])[same]))
    return np.concatenate([d for d, _ in out]), np.concatenate([k for _, k in out])


def ftrl(samples: list[np.ndarray], labels: list[int], size: int, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights of ``size`` coordinates and the bias, from samples given as arrays of coordinates."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)           # the last coordinate is the bias, without L1

    def weights(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(zi) <= L1] = 0.0
        if len(at) and at[-1] == size:
            w[-1] = -zi[-1] / ((BETA + np.sqrt(n[size])) / ALPHA)
        return w

    for _ in range(epochs):
        for at, y in zip(samples, labels):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            old = n[at]
            z[at] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / ALPHA * w
            n[at] = old + g * g
    w = weights(np.arange(size + 1))
    return w[:size], float(w[size])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample: int = SAMPLE, usable: Column | None = None) -> dict:
    """A model from a bounded sample of labelled documents. ``usable``: condition on ``doc_id`` for training rows."""
    known = (labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
             .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y")))
    if usable is not None:
        known = known.where(usable)
    share = known.agg(F.avg("y")).first()[0]
    rank = known.withColumn("h", F.xxhash64("doc_id"))
    # of either label, the lowest hashes: two bounded top lists, 2 * sample rows in all
    chosen = [r for y in (0, 1) for r in rank.where(F.col("y") == y).orderBy("h", "doc_id").limit(sample).collect()]
    empty = {"keys": np.empty(0, np.uint64), "weights": np.empty(0), "bias": float(np.log(share / (1 - share)))
             if share not in (None, 0.0, 1.0) else 0.0 if share is None else (30.0 if share else -30.0)}
    if len({r.y for r in chosen}) < 2:
        return empty
    ids = docs.sparkSession.createDataFrame([(r.doc_id, r.y, r.h) for r in chosen], "doc_id bigint, y int, h bigint")
    rows_ = (ids_and_text(docs, id_col, text_col).join(F.broadcast(ids), "doc_id")
             .select("h", "y", "text").repartition(1).sortWithinPartitions("h", "text"))

    def task(batches):
        ys, per_doc, met = [], [], np.zeros(1 << 24, np.uint8)
        for keys, parts in texts(batches):
            doc, key = features(parts)
            order = np.argsort(doc, kind="stable")
            for k in np.split(key[order], np.searchsorted(doc[order], np.arange(1, len(parts)))):
                per_doc.append(np.unique(k))
                at = np.unique(per_doc[-1] >> np.uint64(40))
                met[at] = np.minimum(met[at], MIN_DOCS) + 1            # never below the number of texts, up to MIN_DOCS
            ys += [y for _, y in keys]
        if not ys:
            return
        for i, k in enumerate(per_doc):
            per_doc[i] = k[met[k >> np.uint64(40)] >= MIN_DOCS]
        names, count = np.unique(np.concatenate(per_doc), return_counts=True)
        names = names[count >= MIN_DOCS]
        found = []
        for k in per_doc:
            at = np.searchsorted(names, k)
            ok = at < len(names)
            at, k = at[ok], k[ok]
            found.append(np.append(at[names[at] == k], len(names)))
        w, bias = ftrl(found, ys, len(names))
        yield b"", bias
        for k, v in zip(names[w != 0], w[w != 0]):
            yield int(k).to_bytes(8, "little"), float(v)

    learned = arrow_map(rows_, task, "key binary, weight double").collect()
    if not learned:
        return empty
    kept = sorted((int.from_bytes(r.key, "little"), r.weight) for r in learned if r.key)
    drawn = sum(r.y for r in chosen) / len(chosen)
    prior = float(np.log(share / (1 - share)) - np.log(drawn / (1 - drawn)))        # the sample's shares are not the labels'
    return {"keys": np.array([k for k, _ in kept], np.uint64), "weights": np.array([w for _, w in kept]),
            "bias": next(r.weight for r in learned if not r.key) + prior}


def _scores(model: dict, parts: list[bytes]) -> np.ndarray:
    keys, weights = model["keys"], model["weights"]
    total = np.full(len(parts), model["bias"])
    if len(keys):
        if "maybe" not in model:
            model["maybe"] = np.zeros(1 << 20, bool)
            model["maybe"][keys >> np.uint64(44)] = True
        doc, key = features(parts)
        hit = model["maybe"][key >> np.uint64(44)]
        doc, key = doc[hit], key[hit]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        ok = keys[at] == key
        pair = np.unique(doc[ok] * len(keys) + at[ok])
        total += np.bincount(pair // len(keys), weights[pair % len(keys)], len(parts))
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score in [0, 1] of every row; the model is bounded by its training sample."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        for ids, parts in texts(batches):
            for (doc_id,), s in zip(ids, _scores(shared.value, parts).tolist()):
                yield doc_id, s
    return arrow_map(ids_and_text(docs, id_col, text_col), task, "doc_id bigint, score double", batch_rows=16384)


def remove_toxic(docs: DataFrame, model: dict, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows that score below the threshold, with all their columns, filtered where they lie."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text_col, lambda parts: _scores(shared.value, parts) < threshold)


def held_out(col: str = "doc_id") -> Column:
    """Rows whose labels are kept for testing: crc32 of the id as text leaves 1 modulo 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
