"""Conversation repair, nearest neighbours and spelling variants against brute force, on small awkward tables."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import neighbours, queries, repair, spelling

SF = "/root/testdata/sf0.001"
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


# ---------------------------------------------------------------- conversation repair

def plain_report(own):
    """The contract, word by word, for rows (turn, role, text) in order."""
    faults, seen = [], set()
    for _, role, text in own:
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @functools.cache
    def least(i, state, inserted):
        ways = []
        if i == len(own) and state in (0, 3):
            ways.append((0, "", ()))
        if inserted < 3:
            for r in "ua":
                if (state, r) in step:
                    c, a, o = least(i, step[state, r], inserted + 1)
                    ways.append((c + 5, "I" + a, (({"u": "user", "a": "assistant"}[r], ""), *o)))
        if i < len(own):
            c, a, o = least(i + 1, state, 0)
            ways.append((c + 2, "D" + a, o))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 * (faults[i] == "truncated")
                for letter, role, cost in [("K", own[i][1], 0), ("R", "user", 1), ("R", "assistant", 1)]:
                    if (state, role[:1]) in step:
                        c, a, o = least(i + 1, step[state, role[:1]], 0)
                        ways.append((c + cost + extra, letter + a, ((role, own[i][2]), *o)))
        return min(ways) if ways else (math.inf, "", ())
    for i in range(len(own), -1, -1):                # from the end, so that the recursion stays shallow
        for state in range(4):
            least(i, state, 0)
    cost, audit, out = least(0, 0, 0)
    turns = [t for t, _, _ in own if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def plain_damage(turns):
    """Rows of every conversation after damage, in order."""
    out = collections.defaultdict(list)
    for conv, turn, role, text in turns:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.sha256(r[2].encode()).hexdigest()))
    return out


def conversations(seed):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "Why? ", "", None, "x" * 3000 + "!", "\n", "a.b", "Fine. ", "Ж."]
    out = [(c, rng.choice([None, *range(9)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), rng.choice(texts))
           for c in [None, *range(40)] for _ in range(rng.randint(1, 9))]
    return out + [(99, t, "user" if t % 2 else "assistant", f"{rng.randint(0, 400)}" + rng.choice(["", "."])) for t in range(300)] + [(98, 3, "user", "Same.")] * 50


def as_rows(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


TURNS = "conv_id bigint, turn bigint, role string, text string, copies string, gone string, at string"


@pytest.mark.parametrize("held,piece", [(4 << 20, 1 << 20), (300, 37)])
def test_repair_equals_plain_search(spark, monkeypatch, held, piece):
    monkeypatch.setattr(repair, "HELD_CHARS", held)
    monkeypatch.setattr(repair, "PIECE", piece)
    turns = conversations(3)
    df = queries.damaged_turns(spark.createDataFrame([(*t, "c", "g", "a") for t in turns], TURNS).repartition(3))
    got = repair.repair(df, copies=F.col("copies"), gone=F.col("gone"))
    rows = got.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    want = plain_damage(turns)
    got = as_rows(got)
    assert got.keys() == want.keys()
    for conv, own in want.items():
        assert got[conv] == plain_report(own), conv


def test_repair_without_rows(spark):
    none = spark.createDataFrame([], TURNS)
    assert repair.repair(none).count() == 0
    gone = as_rows(repair.repair(spark.createDataFrame([(1, 0, "user", "a.", "", "", "")], TURNS), gone=F.lit(True)))
    assert gone == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_block_tables_equal_single_steps():
    t, rng = repair.Tables(), np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 8, 41):
        syms = rng.integers(0, repair.SYMBOLS, n).astype(np.uint8)
        carried = t.carry(syms)
        for v in range(len(t.vectors)):
            now = v
            for s in syms[::-1]:
                now = t.step[now, s]
            assert now == carried[v]


def test_op11_over_the_given_table(spark):
    got = as_rows(queries.op11(spark, SF))
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == {c: plain_report(own) for c, own in plain_damage(turns).items()}


# ---------------------------------------------------------------- nearest neighbours

VECTORS = "vec_id bigint, embedding array<float>, row string, score string, leaf string"


def plain_neighbours(vectors, k):
    """{query row number: [(score, vec_id), ...]} of valid rows."""
    ok = [(i, v) for i, v in vectors if v is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8]
    out = []
    for n, (i, v) in enumerate(ok):
        if i is not None and i % 20 == 0:
            score = [(-float(np.dot(np.float64(np.float32(v)), np.float64(np.float32(w)))), -math.inf if j is None else j)
                     for m, (j, w) in enumerate(ok) if m != n]
            out.append((i, sorted(score)[:k]))
    return out


def test_neighbours_of_awkward_vectors(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=8).astype("f4").tolist()) for i in range(700)]
    vectors += [(i, [1.0] * 8) for i in range(700, 1300)]                         # a very common vector
    vectors += [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [1.0] * 7 + [None]), (2080, [float("nan")] * 8), (2100, [1.0] * 3),
                (2120, [float("inf")] * 8), (None, [0.5] * 8), (40, [3.0] * 8), (2140, [1e-3] * 8)]
    df = spark.createDataFrame([(i, v, "r", "s", "l") for i, v in vectors], VECTORS).repartition(3)
    got = collections.defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = plain_neighbours(vectors, 20)
    assert set(got) == {i for i, _ in want}
    hits = total = 0
    for i, near in want:
        if i == 40:                                                               # two rows have this id
            assert len(got[i]) == 40
            continue
        assert [r for r, _, _ in got[i]] == list(range(1, 21))
        assert [(-s, v if v is not None else -1) for _, v, s in got[i]] == sorted((-s, v if v is not None else -1) for _, v, s in got[i])
        hits += sum(-s <= near[-1][0] + 1e-9 for _, _, s in got[i])
        total += 20
    assert hits / total >= 0.9


def test_neighbours_when_there_are_few(spark):
    assert neighbours.search(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(20, [1.0, 2.0], "", "", "")], VECTORS)
    assert neighbours.search(one, F.col("vec_id") % 20 == 0).count() == 0
    three = spark.createDataFrame([(20, [1.0, 2.0], "", "", ""), (7, [2.0, 2.0], "", "", ""), (3, [2.0, 2.0], "", "", "")], VECTORS)
    got = neighbours.search(three, F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == [(20, 1, 3, 6.0), (20, 2, 7, 6.0)]


def test_op12_recall(spark):
    data = [(r.vec_id, np.array(r.embedding, np.float64)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = collections.defaultdict(dict)
    for r in queries.op12(spark, SF).collect():
        got[r.query_id][r.vec_id] = r.score
    hits = 0
    for i, v in data:
        if i % 20 == 0:
            near = sorted((-float(v @ w), j) for j, w in data if j != i)[:20]
            hits += len({j for _, j in near} & set(got[i]))
            assert all(abs(got[i][j] - float(v @ dict(data)[j])) < 1e-12 for j in got[i]) and len(got[i]) == 20
    assert hits >= 0.9 * 20 * len(got) and len(got) == sum(i % 20 == 0 for i, _ in data)


# ---------------------------------------------------------------- spelling variants

def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1:] == s for i in range(len(t)))


def plain_variants(docs, damage=True):
    count = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            count[run[:h % len(run)] + run[h % len(run) + 1:] if damage and h % 97 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def test_spelling_equals_all_pairs(spark):
    rng = random.Random(6)
    stems = ["mountain", "colour", "aaaaa", "élève", "ÿ×÷øß", "b" * 64, "c" * 65, "letter" * 40, "abababab"]

    def word():
        w = rng.choice(stems)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            p = rng.randrange(len(w))
            w = rng.choice([w[:p] + w[p + 1:], w[:p] + rng.choice("abéz") + w[p:], w[:p] + rng.choice("abéz") + w[p + 1:]])
        return w.upper() if rng.random() < 0.1 and w.isascii() else w
    docs = [(i, rng.choice([" ", "-", "_1", "Ж", "\n"]).join(word() for _ in range(rng.randint(1, 60)))) for i in range(150)]
    docs += [(None, "colour colour colour"), (5, None), (6, ""), (7, "1 2 3"), (8, " ".join(["q" * 20_000, "q" * 20_001] * 3)), (8, "colour")]
    df = spark.createDataFrame([(*d, "k", "n", "w") for d in docs], "doc_id bigint, text string, key string, n string, word string").repartition(4)
    words = spelling.word_counts(df, change=queries.misspelt)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(words).collect()}
    assert got == plain_variants(docs)
    assert sum(f is not None for f, *_ in got.values()) > 50


def test_spelling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.group_variants(spelling.word_counts(none)).count() == 0


def test_op13_over_the_given_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op13(spark, SF).collect()}
    want = plain_variants(docs)
    assert got == want
