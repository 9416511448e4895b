"""A cleaning pipeline over documents in five stages, each an operator of gridloom.llm over all that the one before kept.

Each stage's rows are written to the shared folder and read again as the next one's input, so a stage gets a table of
files that stay. Rows of one id and one text are one document; a null doc_id names none, and an id with two texts is
two. A null text is an empty one: it scores by the intercept alone, links with nothing, repeats nothing, contains no
benchmark item and has no tokens. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontaminate, jaccard, quality, suffix
from gridloom.llm.common import small_batches, table, written

#: The score from which a document stays, as in op2.
KEEP_FROM = 0.3


def _packed(docs: DataFrame) -> tuple[DataFrame, list]:
    """doc_id, text and all other columns in one, rest, so that names can't clash; and what brings the columns back."""
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(other))) if other else F.struct(F.lit(True).alias("none"))
    return docs.select("doc_id", "text", rest.alias("rest")), [F.col(f"rest.c{other.index(c)}").alias(c) if c in other else F.col(c) for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of the documents here, but for the held-out fifth. Repeated rows fare alike; a null doc_id is judged like any other but not learned from."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    weights = quality.train(docs, labels.filter(quality.fold_of("doc_id", 5) != 0))
    packed, back = _packed(docs)
    return quality.score(packed, weights, ("text", "rest")).filter(F.col("score") >= KEEP_FROM).select(*back)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 75 % connect, one row stays: that of the smallest id, nulls last, then of the least hash of its text. Rows without shingles stay, but for repeated ones of an id."""
    small_batches(spark)
    packed, back = _packed(docs)
    # ids may be null or repeated, so rows have keys of their own, written once
    keyed = written(packed.withColumn("row_key", F.monotonically_increasing_id()), "keyed-docs")
    near = jaccard.linked(keyed.select(F.col("row_key").alias("doc_id"), "text"), stable=True).withColumnRenamed("doc_id", "row_key")
    rows = keyed.select("row_key", "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.xxhash64("doc_id", "text", "rest").alias("row_hash"))
    bare = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    group = [bare.alias("bare"), F.when(bare, F.col("doc_id")).otherwise(F.col("component_id")).alias("group"), F.when(bare, F.col("text_hash")).alias("copy")]
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "row_hash", "row_key")
    first = near.join(rows, "row_key").groupBy(*group).agg(F.min(order).alias("first")).select("first.row_key")
    return keyed.join(first, "row_key", "left_semi").select(*back)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that an earlier document has are cut out of the texts; every document stays. A character of which only some bytes are cut goes whole. n_chars, if there is one, is that of what is left."""
    small_batches(spark)
    packed, back = _packed(docs)
    cut = suffix.remove_repeats(packed, keep=("text", "rest"), stable=True)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.select(*(new[c].alias(c) if c in new else x for c, x in zip(docs.columns, back, strict=True)))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; repeated rows fare alike."""
    small_batches(spark)
    return decontaminate.without(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the digests of the ids and of what they decode to; a row for each row, whatever its id."""
    small_batches(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN, stable=True), bpe.token_bytes(spark, ranks))
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_array_dedup", repeat_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("byte_bpe", token_stage),
]

#: No SQL: the classifier learns its weights. tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
