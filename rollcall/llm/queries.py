"""The queries of the operators over the given tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import (chat, decontaminate, fingerprints, jaccard, neighbours, packing, repair, repeats, secret_scan, spelling, token_counts,
               token_files, toxicity)
from .common import shared_dir

CACHE_WORDS = 350_000               # where encoding has the workers for itself
QUERIES: dict = {}
SQL: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            SQL[name] = oracle
        return fn
    return add


@query("op1_token_files")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"), end_id=2,
                                  cache_words=CACHE_WORDS, hold=True)
    return token_files.read_token_files(spark, folder)


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=~toxicity.held_out())
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score",
                                              (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op3_fingerprints")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(table(spark, sf_dir, "documents"))


@query("op4_harmonic_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.harmonic_pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, cache_words=CACHE_WORDS, hold=True)


@query("op5_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


@query("op7_ngram_jaccard")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '~', ''))
    + len(regexp_extract_all(text, '</?s>|<</?SYS>>|\[/?INST\]|\[ROLE:|\[/ROLE\]')) + 2
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE length(role) + 14 END AS size
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""


def conversation_events(turns: DataFrame) -> DataFrame:
    """An event log of finished turns: user and system messages arrive and are edited, assistant ones are streamed,
    regenerated and streamed again in two deltas. Equal turn numbers are ordered by role and text."""
    from pyspark.sql import Window
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))

    def event(k, kind, text):
        return F.struct((F.col("message") * 4 + k).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    streamed = F.array(event(0, "delta", first), event(1, "regenerate", F.lit("")), event(2, "delta", first), event(3, "delta", rest))
    typed = F.array(event(0, "delta", first), event(1, "edit", F.col("text")))
    return (turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
            .withColumn("message", place.cast("bigint"))
            .select("conv_id", "message", "role", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(typed)).alias("e"))
            .select("conv_id", "message", "role", "e.*"))


@query("op8_chat_format", CHAT_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(extra)
    formatted = chat.render(chat.fold(conversation_events(turns)))
    back = formatted.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"),
                            chat.learned(F.col("formatted"), F.col("loss")).alias("learned"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
                       F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"))


@query("op9_secret_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["depth"] == 0)
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in secret_scan.KINDS],
                        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


REPEATS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS s FROM w WHERE len(ws) >= 20),
h AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM win),
f AS (SELECT doc_id, s, min((doc_id, s)) OVER (PARTITION BY k) AS first FROM h),
cov AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS p FROM f WHERE (doc_id, s) <> first),
words AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS p, unnest(ws) AS word FROM w),
kept AS (
  SELECT words.doc_id, count(cov.p) AS n_removed,
    string_agg(CASE WHEN cov.p IS NULL THEN word END, ' ' ORDER BY words.p) AS kept
  FROM words LEFT JOIN cov ON words.doc_id = cov.doc_id AND words.p = cov.p GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


@query("op10_substring_dedup", REPEATS_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (repeats.remove_repeats(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))


def damaged_turns(turns: DataFrame) -> DataFrame:
    """Rows with planted faults: ``copies`` of a row, ``gone`` for a dropped one; nulls are one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.pmod(F.crc32(key), F.lit(20))
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    return turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
                        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                        F.when(kind == 3, 2).otherwise(1).alias("copies"), (kind == 0).alias("gone"))


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = damaged_turns(table(spark, sf_dir, "conversations"))
    return repair.repair(turns, copies=F.col("copies"), gone=F.col("gone"))


@query("op12_nearest_neighbours")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def misspelt(run: bytes, h: int) -> bytes:
    """A run in which one code point is deleted if 97 divides the hash."""
    return run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"), least_length=5, least_count=3, change=misspelt)
    return spelling.group_variants(words, ratio=2)


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
