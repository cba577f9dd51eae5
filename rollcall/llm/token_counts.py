"""Token counts without token ids of documents: pieces are counted once per distinct pre-token.

With this kind of model (no normalisation, a word mark before words, no piece that continues past a blank or a
line end) a text falls into pre-tokens that never merge with one another: a run of blanks with the word after it,
or a line end with what follows it. The count of a text is the sum of its pre-tokens' counts.

1. Every task counts its pre-tokens; sums over tasks give the distinct pre-tokens of the corpus (combined before
   the shuffle, so that a frequent one is a row per task).
2. The library counts the pieces of each distinct pre-token once.
3. The most frequent ones, ``HOT`` at most, are broadcast and summed where the documents lie. Only the rare
   rest becomes rows (document, pre-token, frequency), joined to the counts by key and summed per document.

``check_model`` refuses models for which the first statement does not hold.

Defined cases: a null text is empty and has no tokens; rows with equal or null document ids are counted each for
itself; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, groups, ids_and_text, rows, stored, worker_state
from .sketches import most_frequent

HOT, HOT_CHARS = 1 << 19, 64          # bound of the broadcast: so many pre-tokens of at most so many characters
PART = re.compile(r"\n[^ \n]*| +[^ \n]*")


def pre_tokens(text: str) -> list[str]:
    """Keys of a text's pre-tokens: without their first blank, or with their line end."""
    if not text:
        return []
    text = text.replace("▁", " ")               # the model's own sign for a blank
    if "  " in text or " \n" in text or text[0] == " " or text[-1] == " ":
        return [t[1:] if t[0] == " " else t for t in PART.findall(" " + text)]
    return (" " + text).replace("\n", " \n").split(" ")[1:]


def model(path: str):
    import sentencepiece
    held = worker_state().setdefault("piece_models", {})
    if path not in held:
        held[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return held[path]


def check_model(path: str) -> None:
    """Fail unless pre-tokens are independent under this model."""
    m = model(path)
    for i in range(m.get_piece_size()):
        p = m.id_to_piece(i)
        if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i)) and ("▁" in p.lstrip("▁") or "\n" in p):
            raise ValueError(f"piece {p!r} continues past a blank or line end")
    if m.encode("a  b\n c ", out_type=str) == m.encode("a b c", out_type=str) or m.encode("a", out_type=str)[0] != "▁a":
        raise ValueError("the model changes white space or adds no word mark")


def piece_counts(path: str, keys: list[str]) -> list[int]:
    ids = model(path).encode(keys, num_threads=1)
    # the library puts a word mark before a key: wanted for words, one too many before a line end, none before nothing
    return [1 if not k else len(i) - (k[0] == "\n") for k, i in zip(keys, ids)]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row."""
    check_model(path)
    spark = docs.sparkSession
    source = ids_and_text(docs, id_col, text_col)

    def tally(batches):
        seen: Counter = Counter()
        for _, text in rows(batches):
            seen.update(pre_tokens(text))
            if len(seen) > 1_000_000:
                yield from seen.items()
                seen.clear()
        yield from seen.items()

    def counted(batches):
        for held in groups(rows(batches), lambda r: len(r[0]) + 64, 4 << 20):
            yield from zip([k for k, _ in held], [n for _, n in held], piece_counts(path, [k for k, _ in held]))

    total = arrow_map(source, tally, "key string, n bigint", batch_rows=32768).groupBy("key").agg(F.sum("n").alias("n"))
    vocabulary = stored(arrow_map(total, counted, "key string, n bigint, pieces int", batch_rows=32768, keeps="piece_models"))
    known = most_frequent(vocabulary.where(F.length("key") <= HOT_CHARS), hot).select("key", "pieces")
    frequent = spark.sparkContext.broadcast(dict(_collected(known)))

    def per_document(batches):
        own = frequent.value
        for doc, text in rows(batches):
            freq, held, rest = Counter(pre_tokens(text)), 0, []
            for k, n in freq.items():
                p = own.get(k)
                if p is None:
                    rest.append({"key": k, "n": n})
                else:
                    held += p * n
            yield doc, len(text.encode("utf-8", "replace")), held, rest

    rare = "array<struct<key: string, n: int>>"
    first = arrow_map(source, per_document, f"doc_id bigint, n_bytes bigint, held bigint, rare {rare}")
    # the row number of a stored table keeps rows with equal ids apart
    per_doc = stored(first.withColumn("row", F.monotonically_increasing_id()))
    one = per_doc.select("row", F.explode("rare").alias("r")).select("row", F.col("r.key").alias("key"), F.col("r.n").alias("n"))
    sums = (one.join(vocabulary.select("key", "pieces"), "key").groupBy("row")
            .agg(F.sum(F.col("n") * F.col("pieces")).alias("more")))
    return (per_doc.select("row", "doc_id", "n_bytes", "held").join(sums, "row", "left")
            .select("doc_id", "n_bytes", (F.col("held") + F.coalesce("more", F.lit(0))).alias("n_tokens")))


def _collected(df: DataFrame):
    table = df.toArrow()
    return zip(table.column(0).to_pylist(), table.column(1).to_pylist())
