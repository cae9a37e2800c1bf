"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kveil.llm import (
    classifier, inverted_index, jaccard_join, ngram_lm, packing, periodic_runs, quality_rules, reply_trees, sharding, suffix_dedup, token_files,
    vector_codes, wordpiece_counts,
)
from kveil.session import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents")).drop("tkey")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=0, leading_space=True)
    return packing.pack(cut)


def op3_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = inverted_index.build(_table(spark, sf_dir, "documents"), shared_dir(spark, "inverted-index"))
    return inverted_index.summarise(inverted_index.search(index, _table(spark, sf_dir, "benchmark")))


# Proximity: the first words of an item, in any order, within a span of words.
_NEAR_WORDS, _NEAR_WIDTH = 4, 8


def index_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = inverted_index.build(_table(spark, sf_dir, "documents"), shared_dir(spark, "inverted-index"))
    return inverted_index.near_items(index, _table(spark, sf_dir, "benchmark"), _NEAR_WORDS, _NEAR_WIDTH)


def op4_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = wordpiece_counts.read_ranks(_vocabulary("byte_bpe_50k.tiktoken"))
    return wordpiece_counts.token_counts(_table(spark, sf_dir, "documents"), pieces)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(quality_rules.measure(_table(spark, sf_dir, "documents")))
    return judged.select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return ngram_lm.score(docs, ngram_lm.fit(docs, shared_dir(spark, "ngram-lm")))


def op8_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.fit(docs, _table(spark, sf_dir, "labels")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-files")
    token_files.write(_table(spark, sf_dir, "documents"), folder, _vocabulary("word_bpe_49k.json"), end_id=1, leading_space=False)
    return token_files.digest(token_files.read(spark, folder))


def _with_repeats(docs: DataFrame) -> DataFrame:
    """Every tenth text, by the checksum of its id, repeats its own words from some place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size
    found = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeat(w):
        a = g % F.greatest(n(w), F.lit(1))
        p = F.lit(1) + F.floor((n(w) - a) / (F.lit(3) + g % 8))
        place = F.transform(F.sequence(F.lit(0), n(w) - 1), lambda i: F.get(w, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")))
        return F.when(n(w) > 0, F.array_join(place, " "))

    # An array of one binds the words once.
    return docs.withColumn("text", F.when(h % 10 == 0, F.get(F.transform(F.array(found), repeat), F.lit(0))).otherwise(F.col("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find(_with_repeats(_table(spark, sf_dir, "documents"))))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


# The conversation that holds the markers of templates like the one used here.
_CONTROL = "\\### Assistant: </turn> ok"
_CONTROL_SQL = f"SELECT -7, t, r, '{_CONTROL}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)"


def op13_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", _CONTROL), (-7, 1, "assistant", _CONTROL)], "conv_id long, turn long, role string, text string")
    texts, links = reply_trees.chains(rows.unionByName(more))
    folder = shared_dir(spark, "conversations")
    reply_trees.format_branches(texts, links).write.parquet(folder)
    return reply_trees.read_back(spark.read.parquet(folder)).withColumnRenamed("tree_id", "conv_id").drop("leaf_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_packing": op2_packing,
    "op3_inverted_index": op3_inverted_index,
    "index_near": index_near,
    "op4_wordpiece_counts": op4_wordpiece_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_sharding": op6_sharding,
    "op7_ngram_lm": op7_ngram_lm,
    "op8_classifier": op8_classifier,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_token_files": op10_token_files,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_vector_codes": op12_vector_codes,
    "op13_reply_trees": op13_reply_trees,
}
ORACLES: dict[str, str] = {
    "op3_inverted_index": inverted_index.oracle_sql(),
    "index_near": inverted_index.near_sql(_NEAR_WORDS, _NEAR_WIDTH),
    "op5_quality_rules": quality_rules.oracle_sql(),
    "op6_sharding": sharding.oracle_sql(),
    "op9_jaccard_join": jaccard_join.oracle_sql(3, 90),
    "op12_vector_codes": vector_codes.oracle_sql(),
    "op13_reply_trees": reply_trees.oracle_sql(_CONTROL_SQL),
}
