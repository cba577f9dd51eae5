"""The operators on small awkward tables, against brute force, round trips and held-out labels."""

import base64
import collections
import gzip
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import (chat, components, decontaminate, edits, fingerprints, jaccard, packing, queries, repeats, secret_scan,
                          token_counts, token_files, toxicity)
from rollcall.llm.common import shared_dir

WORD = queries.tokenizer_path("word_bpe_49k.json")
PIECE = queries.tokenizer_path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
random.seed(5)
LONG = " ".join(random.choice(["alpha", "beta", "Gamma,", "ñandú.", "don't", "x1", "\n", "É"]) + str(i % 97) for i in range(9000))
TEXTS = [(0, "one two  three\nfour "), (1, None), (2, ""), (3, "  \n "), (4, LONG), (5, LONG + " tail"), (6, "<|endoftext|> A <s> b </s>"),
         (7, "one two  three\nfour "), (8, "\n\nx \n y"), (9, "H̱ İI Σς ﬁ 3.5!!"), (10, "a" * 5000), (7, "one two  three\nfour "), (None, "no id here")]
# names that the operators use themselves
SCHEMA = "doc_id bigint, text string, start string, n_tokens string, score string, node string, spans string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", "n", "x", "y", "z") for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def whole_ids(text):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(WORD).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, docs, none):
    folder = shared_dir(spark)
    token_files.write_token_files(docs, folder, WORD, 2)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, folder).collect())
    want, start = [], 0
    for doc, text in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = whole_ids(text) + [2]
        want.append((start, doc, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    folder = shared_dir(spark)
    token_files.write_token_files(none, folder, WORD, 2)
    assert token_files.read_token_files(spark, folder).count() == 0


def test_marks_after_every_letter():
    """Words that end in any letter, before each closing mark, as the library has them; caches that turn over."""
    from tokenizers import Tokenizer

    from rollcall.llm import tokens
    lib = Tokenizer.from_file(WORD)
    enc = tokens.WordEncoder(WORD, words=5000)
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    for mark in tokens.MARKS:
        some = [f"x{c}{mark}" for c in letters]
        want = [e.ids for e in lib.encode_batch_fast(some, add_special_tokens=False)]
        got = []
        for at in range(0, len(some), 3000):
            got += [np.frombuffer(b, "<u4").tolist() for b in enc.many(some[at:at + 3000])]
        assert got == want
        assert len(enc.known) + len(enc.known.old) < 20_000
    again = ["one two. Three, İ. one"] * 3
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.many(again)] == [lib.encode(again[0], add_special_tokens=False).ids] * 3


def test_letters_and_signs_go_to_the_model_by_themselves(monkeypatch):
    """Latin words and the signs after them: the ids of the whole text, without a word given to the general tokenizer."""
    from tokenizers import Tokenizer

    from rollcall.llm import tokens
    lib = Tokenizer.from_file(WORD)
    words = ["Über", "straße", "STRASSE", "éÈê", "Ÿx", "\u212Bm", "\u212Aelvin", "x\u0130y", "\u1E9Ea", "ab\u0301c", "o'clock", "it's", "a1b", "ǅ", "ΣΑΣ", "日本"]
    tails = ["", ".", "'", "''", "###", ".%%%", ",&&&", "$$$!", "'s", "\"),", "-", "|", "<", "=", "~\u0301"]
    text = " ".join(w + t for w in words for t in tails) + " " + " ".join(t + w for w in words for t in tails)
    some = [text, text.upper(), text.replace(" ", "\n"), ""]
    enc = tokens.WordEncoder(WORD)
    assert enc.letters
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.many(some)] == [lib.encode(t, add_special_tokens=False).ids for t in some]
    monkeypatch.setattr(tokens, "LETTER_RUNS", [])
    old = tokens.WordEncoder(WORD)
    assert old.letters is None and old.many(some) == enc.many(some)

    given = []

    class Seen:
        def encode_batch_fast(self, some, **given_too):
            given.extend(some)
            return lib.encode_batch_fast(some, **given_too)
    enc.lib = Seen()
    enc.many(["Never seen, words### here.%%% größer$$$ éÈê"])
    assert all(not any(c.isalpha() for c in t) for t in given)


def test_cased_tokenizers_are_refused():
    from tokenizers import Tokenizer

    from rollcall.llm import tokens
    lib = Tokenizer.from_file(WORD)
    lib.normalizer = None
    with pytest.raises(ValueError, match="does not cut"):
        tokens.check_tokenizer(lib)


def test_packing_keeps_every_id_once(docs, none):
    rows = packing.harmonic_pack(docs, WORD, 1).collect()
    ids = collections.defaultdict(list)
    for r in rows:
        ids[r.sequence_id].append((r.offset, r.length))
    for parts in ids.values():                                     # gapless, within the capacity
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    all_pieces = collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    for doc, text in TEXTS:
        own = whole_ids(text) + [1]
        start = 0
        for n in packing.cuts(len(own), 2048):
            piece = (doc, start, n, crc(own[start:start + n]), len(own))
            assert all_pieces[piece] > 0
            all_pieces[piece] -= 1
            start += n
        assert start == len(own)
    assert sum(all_pieces.values()) == 0 and packing.harmonic_pack(none, WORD, 1).count() == 0
    assert all(sum(packing.cuts(n, 2048)) == n for n in range(0, 6000, 7))


@pytest.mark.parametrize("hot", [4, 1 << 19])
def test_token_counts_equal_the_library(docs, none, hot):
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, PIECE, hot=hot).collect()), key=key)
    assert got == sorted(((i, len((t or "").encode()), len(m.encode(t or ""))) for i, t in TEXTS), key=key)
    assert token_counts.count_tokens(none, PIECE).count() == 0


def test_pre_tokens_are_independent():
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rng = random.Random(1)
    for _ in range(500):
        t = "".join(rng.choice([" ", "  ", "\n", "a", "the", "é", "▁", "<s>", "\t", "。"]) for _ in range(rng.randint(0, 14)))
        assert sum(token_counts.piece_counts(PIECE, token_counts.pre_tokens(t))) == len(m.encode(t)), repr(t)


def test_toxicity_on_held_out_labels(spark, docs, none):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(d, labels, usable=~toxicity.held_out())
    r = (toxicity.score(d, model).join(labels, "doc_id").where(toxicity.held_out())
         .groupBy("toxic").agg(F.avg((F.col("score") >= 0.7).cast("int")).alias("hit")).collect())
    hit = {x.toxic: x.hit for x in r}
    assert hit[1] > 0.75 and hit[0] < 0.01          # 267 toxic texts to learn from; 0.99 with 1400
    scores = toxicity.score(docs, model).collect()
    assert len(scores) == len(TEXTS) and all(0 <= s.score <= 1 for s in scores)
    kept = toxicity.remove_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(s.score < 0.7 for s in scores)
    empty = toxicity.train(none, labels.limit(0))
    assert {s.score for s in toxicity.score(docs, empty).collect()} == {0.5} and toxicity.score(none, model).count() == 0


def test_fingerprints_of_neighbours(spark, docs, none):
    got = fingerprints.edit_likeness(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).orderBy("doc_id").collect()
    rows = sorted({(i, t or "") for i, t in TEXTS if i is not None})
    prints = fingerprints.fingerprint_many([t for _, t in rows])
    assert [(r.doc_id, r.n_chars, r.fingerprint) for r in got] == [(i, len(t), p) for (i, t), p in zip(rows, prints)]
    for k, r in enumerate(got):
        nxt = rows[(k + 1) % len(rows)][1]
        changed = fingerprints.fingerprint_many([fingerprints.edited(rows[k][1], nxt)])[0]
        assert r.edited_fingerprint == changed and r.near_edited == pytest.approx(fingerprints.likeness(prints[k], changed))
        assert r.near_next == pytest.approx(fingerprints.likeness(prints[k], prints[(k + 1) % len(rows)]))
    assert fingerprints.likeness(prints[4], prints[5]) > 0.9 and fingerprints.edit_likeness(none).count() == 0
    assert fingerprints.fingerprints(docs).count() == len(TEXTS)
    assert fingerprints.edit_likeness(docs.where("doc_id = 4")).first().near_next == 1.0


def test_edit_distance_equals_dynamic_programming():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        row = list(range(len(b) + 1))
        free = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            old, row = row, [i]
            old_free, free = free, [i]
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
                free.append(min(old_free[j] + 1, free[-1] + 1, old_free[j - 1] + (x != y)))
        assert edits.distance(a, b) == row[-1] and edits.best_match(a, b) == min(free)


def test_items_are_found_within_their_budget(spark, docs, none):
    rng = random.Random(3)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(40))
    budget = int(len(item) * decontaminate.RATIO)
    def damaged(n):
        out = list(item)
        for p in rng.sample(range(len(out)), n):
            out[p] = "Z"
        return "".join(out)
    rows = [(1, f"before {item.upper()}\n after"), (2, "x " + damaged(budget)), (3, damaged(3 * budget)), (4, None), (5, item[:80]), (6, item)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("distance", F.lit("clash"))
    items = spark.createDataFrame([(7, item), (8, None), (9, "short"), (10, item)], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_items(d, items).collect()}
    assert set(found) == {(i, k) for i in (1, 2, 6) for k in (7, 10)} and found[1, 7] == 0 and 0 < found[2, 7] <= budget
    kept = decontaminate.remove_contaminated(d, items)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5] and kept.columns == d.columns
    assert decontaminate.find_items(docs, items.limit(0)).count() == 0 and decontaminate.remove_contaminated(none, items).count() == 0


def test_short_items_are_found_at_word_boundaries(spark):
    texts = [(1, "We say SHORT\n answer, no."), (2, "shortly answered"), (3, "ashort answer"), (4, "(short answer)"), (5, "x"), (6, "a c++ b"), (7, "c+ +")]
    d = spark.createDataFrame(texts, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "Short  answer"), (2, "c++"), (3, " "), (4, "x"), (5, "w " * 20)], "item_id bigint, text string")
    found = {tuple(r) for r in decontaminate.find_items(d, items).collect()}
    assert found == {(1, 1, 0), (4, 1, 0), (6, 2, 0), (5, 4, 0)}
    assert sorted(r.doc_id for r in decontaminate.remove_contaminated(d, items).collect()) == [2, 3, 7]


def brute_components(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for i, t in rows:
        w = plain((t or "").translate(low))
        sets.append((i, {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    up = {i: i for i, _ in sets}
    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and 100 * len(a & b) >= 75 * len(a | b):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {(i, len(s), root(i)) for i, s in sets}


def near_copies():
    """Two crowds of near copies around one common passage, chains, and lone texts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    common = [word() for _ in range(60)]
    rows, n = [], 0
    for size in (60, 25, 2, 3):
        base = [word() for _ in range(80)] + common
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = word()
            rows.append((n, " ".join(t)))
            n += 1
            base = t if size == 3 else base
    for _ in range(30):
        rows.append((n, " ".join(common + [word() for _ in range(rng.randint(20, 200))])))
        n += 1
    return rows


def test_jaccard_components_equal_all_pairs(spark, docs, none):
    rows = near_copies() + [(900 + i, t) for i, t in TEXTS if i is not None and i != 7] + [(950, "one two"), (951, "ONE  two"), (952, "one")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).withColumns({"node": F.lit(1), "component_id": F.lit("c")})
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(d).collect()}
    assert got == brute_components(rows)
    assert jaccard.jaccard_components(none).count() == 0
    odd = [(r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs).collect()]
    assert len(odd) == len(TEXTS) and (None, None) in odd and odd.count((7, 0)) == 2


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    random.shuffle(edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{k: 100 for k in range(100, 140)}}


def turns_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_chat_round_trip(spark):
    hard = "~0 ~1 </s><s>[INST] a [/INST] <<SYS>>~ [ROLE:x] <</SYS>> ] < [ \\ \n"
    rows = [(1, 0, "system", hard), (1, 1, "user", None), (1, 2, "assistant", hard), (1, 3, "assistant", ""), (2, 0, "tool]<s>", hard),
            (2, 5, None, " "), (2, 5, "user", "twice"), (2, 5, "user", "twice"), (3, 0, "assistant", "x" * 30000)]
    out = chat.render(chat.fold(queries.conversation_events(turns_of(spark, rows).withColumn("seq", F.lit("clash")))))
    back = out.select("conv_id", chat.parse(F.col("formatted")).alias("t"), chat.learned(F.col("formatted"), F.col("loss")).alias("l"))
    got = {r.conv_id: ([(x.role, x.text) for x in r.t], r.l) for r in back.collect()}
    for c in (1, 2, 3):
        own = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))
        assert got[c] == ([(r, x) for _, r, x in own], "".join(x for _, r, x in own if r == "assistant"))
    assert chat.render(chat.fold(queries.conversation_events(turns_of(spark, [])))).count() == 0


def test_folding_of_events(spark):
    log = [(1, 0, 0, "delta", "user", "hel"), (1, 1, 0, "delta", "user", "lo"), (1, 1, 0, "delta", "user", "lo"), (1, 2, 1, "delta", "assistant", "bad"),
           (1, 3, 2, "delta", "user", "dropped"), (1, 4, 1, "regenerate", None, None), (1, 5, 1, "delta", None, "go"), (1, 6, 1, "delta", None, "od"),
           (1, 7, 2, "delta", "user", "dropped too"), (1, 8, 3, "delta", "user", "b"), (1, 9, 3, "edit", "user", "c"), (1, 10, 3, "delta", "user", "d")]
    events = spark.createDataFrame(log, "conv_id bigint, seq bigint, message bigint, kind string, role string, text string").repartition(4)
    got = [(r.message, r.role, r.text) for r in chat.fold(events).orderBy("message").collect()]
    assert got == [(0, "user", "hello"), (1, "assistant", "good"), (3, "user", "cd")]


def test_secrets_in_layers(spark, docs, none):
    secret = "password = hunter2hunter2"
    b64 = base64.b64encode(secret.encode()).decode()
    packed = base64.b64encode(gzip.compress(b64.encode())).decode()
    url = "x=" + "".join(f"%{b:02x}" for b in secret.encode())
    esc = "".join(f"\\u{ord(c):04x}" for c in "token:abcdefgh")
    twice = "".join(f"%25{b:02X}" for b in b"secret=qwertyuiop")
    texts = [secret, f"é {b64} z", f"a {packed} b", url, f"-- {esc} --", twice, "api_key=short", "AKIA" + "A" * 16, "f" * 24 + "g" + "f" * 23,
             "PASSWD:\"x.y/z=1\"", "paſſword=hunter2", "%%%41%", "\\u00", "=" * 50]
    spans = [[s[:3] for s in secret_scan.scan_text(t)] for t in texts]
    assert spans[0] == [("assign", 0, 25)]
    assert spans[1] == [("assign", 2, 2 + len(b64))] and spans[2] == [("assign", 2, 2 + len(packed))]
    assert spans[3] == [("assign", 2, len(url))] and spans[4] == [("assign", 3, 3 + len(esc))] and spans[5] == [("assign", 0, len(twice))]
    assert spans[6] == [] and spans[7] == [("access", 0, 20)] and spans[8] == [("hex", 0, 24)] and spans[9] == [("assign", 0, 15)]
    assert spans[10] == [] and spans[11:] == [[], [], []]
    assert secret_scan.redacted(f"a {secret} b {b64}") == "a [ASSIGN] b [ASSIGN]"
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, None])], "doc_id bigint, text string, n_chars bigint")
    rows = {r.doc_id: r.text for r in secret_scan.redact(d, "text", "n_chars").collect()}
    assert rows[0] == "[ASSIGN]" and rows[14] is None and len(rows) == 15
    assert secret_scan.scan(docs).count() == len(TEXTS) and secret_scan.scan(none).count() == 0


def test_secrets_in_url_safe_and_wrapped_base64():
    rng = random.Random(7)
    noise = "".join(rng.choice("abcdefghij klmno>?~ÿ") for _ in range(300))
    for encode in (base64.b64encode, base64.urlsafe_b64encode):
        for pack in (bytes, gzip.compress, zlib.compress):
            part = encode(pack(f"{noise}??>>~~ token=abcdef123456 {noise}".encode())).decode()
            for width in (40, 50, 64, 76, len(part)):
                for end in ("\n", "\r\n", "\n  "):
                    lines = end.join(part[i:i + width] for i in range(0, len(part), width))
                    assert secret_scan.scan_text(f"é: {lines}\nend") == [("assign", 3, 3 + len(lines), 1)]
    url = base64.urlsafe_b64encode(b"afetch https://h.example/a/bb?token=abcdef123456&x=1 now please").decode()
    assert "_" in url and secret_scan.redacted(f"{url} b") == "[ASSIGN] b"
    # parts that stand alone in their lines stay apart; a run of one alphabet before a mark of the other is still read
    alone = base64.b64encode(b"token=abcdef123").decode()
    assert [s[1:3] for s in secret_scan.scan_text(f"{alone}\n{alone}")] == [(0, 20), (21, 41)]
    assert [s[1:3] for s in secret_scan.scan_text(f"{alone}-tail")] == [(0, 20)]
    assert [s[1:3] for s in secret_scan.scan_text(f"a/b-{alone}")] == [(4, 24)]


def test_secrets_in_any_part_of_compressed_layers():
    def found(data):
        part = base64.b64encode(data).decode()
        return [s[:3] for s in secret_scan.scan_text(f"é {part} z")] == [("assign", 2, 2 + len(part))]

    rng = random.Random(8)
    secret, long = b" token=abcdef123456 ", ("é" * 3_000_000).encode()
    deep = base64.b64encode(gzip.compress(secret))
    for pack in (gzip.compress, zlib.compress):
        assert found(pack(b"a" + long + secret)) and found(pack(long + secret + long)) and found(pack(long + b" " + deep))
        assert found(pack(long) + pack(b"") + pack(secret)) and found(pack(b"a") + secret) and not found(pack(long))
        assert found(pack(rng.randbytes(2000) + secret)) and found(pack(b"\0" * 300 + secret + long))
        # a damaged end, and one run of the alphabet across all of a large layer
        assert found(pack(secret + rng.randbytes(5000))[:-900]) and found(pack(base64.b64encode(long + secret)))
        assert found(pack(b"%61" + long + b"%74oken=abcdef123456"))
    assert found(b"x^ plain text that begins like zlib" + secret)
    assert secret_scan.scan_text(base64.b64encode(rng.randbytes(50) + secret).decode())
    cycle = zlib.compress(base64.b64encode(zlib.compress(b"x" * 99)))
    assert not found(cycle)


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(6)
    for _ in range(300):
        t = "".join(rng.choice(["password", "=", ":", " ", "AKIA", "ABCDEFGHIJ", "0123456789ab", "cdef", "x", "\"", "token", "api_key", "g"]) for _ in range(12))
        want = [("assign", *m.span()) for m in re.finditer(secret_scan.ASSIGN, t, re.I | re.A) if len(m[2]) >= 6]
        want += [("access", *m.span()) for m in re.finditer(secret_scan.ACCESS, t) if len(m[0]) >= 20]
        want += [("hex", *m.span()) for m in re.finditer(secret_scan.HEX, t) if len(m[0]) >= 24]
        assert secret_scan.plain_spans(t) == want


@pytest.mark.parametrize("bits", [28, 16])
def test_repeats_equal_brute_force(spark, docs, none, bits):
    rows = near_copies() + [(900 + i, t) for i, t in TEXTS if i is not None and i != 7] + [(960, "be " * 300)]
    first, words = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        words[i] = plain(t)
        for s in range(len(words[i]) - 19):
            first.setdefault(tuple(words[i][s:s + 20]), (i, s))
    want = set()
    for i, w in words.items():
        gone = {p for s in range(len(w) - 19) if first[tuple(w[s:s + 20])] < (i, s) for p in range(s, s + 20)}
        want.add((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).withColumn("starts", F.lit("clash"))
    assert {tuple(r) for r in repeats.remove_repeats(d, bits=bits).collect()} == want
    twice = repeats.remove_repeats(d.where("doc_id < 3").unionAll(d.where("doc_id < 3")), bits=bits).collect()
    assert len(twice) == 6 and len(set(map(tuple, twice))) == 3
    assert repeats.remove_repeats(none, bits=bits).count() == 0 and repeats.remove_repeats(docs, bits=bits).count() == len(TEXTS)


def test_pipeline_drops_repeated_rows_and_null_ids(spark):
    import corpus_pipeline as p
    one, two, three = ("".join(f"{w}{i} " for i in range(30)) for w in ("a", "b", "c"))
    rows = [(5, one), (5, one), (None, one), (7, one + "tail"), (None, two), (None, two + "tail"), (8, three), (8, "d e f"), (9, three), (10, None), (None, "")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, n_chars bigint").repartition(3)
    out = p.drop_near_duplicates(spark, docs, "")
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert out.columns == docs.columns
    assert [r for r in got if r[1] not in (two, two + "tail")] == sorted([(5, one), (8, three), (8, "d e f"), (10, None), (None, "")], key=str)
    assert len([r for r in got if r[1] in (two, two + "tail")]) == 1


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source, columns = docs, docs.columns
    for name, stage in p.STAGES:
        out = p.stored(stage(spark, docs, SF))
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), usable=~toxicity.held_out())
            want = {r.doc_id for r in toxicity.score(docs, model).where("score < 0.7").collect()}
        elif name == "ngram_jaccard":
            want = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in docs.collect()]) if i == c}
        elif name == "decontamination":
            items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            exact = {r.doc_id for r in docs.collect() if any(t in " ".join((r.text or "").lower().split()) for t in items)}
            want = {r.doc_id for r in out.collect()}
            assert not want & exact
        elif name == "secret_scan":
            want = {r.doc_id for r in docs.collect()}
            assert not any(secret_scan.scan_text(r.text or "") for r in out.collect())
            assert all(r.n_chars == len(r.text) for r in out.where("text is not null").collect())
        else:
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
            break
        assert out.columns == columns and {r.doc_id for r in out.collect()} == want
        docs = out
    assert 0 < docs.count() < source.count()


def test_long_words_are_decoded_in_linear_time():
    import time
    for code, letter in (("%41", "A"), ("\\u0041", "A")):
        text = "x" * 300_000 + " " + "y" * 300_000 + code + "KIA" + "Z" * 20 + " " + "w" * 300_000
        start = time.perf_counter()
        spans = secret_scan.scan_text(text)
        # the decoded word holds a key: its span is that of the code and what follows, in the text's own places
        assert [(k, d) for k, _, _, d in spans] == [("access", 1)]
        assert text[spans[0][1]:spans[0][2]].startswith(code) and time.perf_counter() - start < 20


def test_encoded_words_equal_the_pattern():
    rng = random.Random(1)
    patterns = [(re.compile(r"[^\s%]*%[0-9A-Fa-f]{2}\S*"), secret_scan._URL_CODES, "%"),
                (re.compile(r"[^\s\\]*\\(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})\S*"), secret_scan._ESCAPE, "\\")]
    pieces = ["%41", "%", "%z", " ", "\n", " ", "\\u0041", "\\x41", "\\", "u", "a", "　", "\x1c", "%%20"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        for pattern, codes, sign in patterns:
            assert [m.span() for m in pattern.finditer(text)] == list(secret_scan._encoded_words(text, codes, sign))
