"""A training corpus from raw documents, in five stages: each works on all rows that the one before kept, and is written as Parquet
before the next reads it. Extra columns of any name pass through all stages but the last."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm import bottomk, bpe, cube_mix, lang_hier, secret_forest
from roadweave.llm.common import shared_path, written
from roadweave.llm.queries import TOKENIZER


def own_columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def unused(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as keep it apart from the columns of docs, whatever their case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Those without a letter go: null and empty texts, digits, marks and emoji only.

    Rows are judged one by one: repeated rows and null ids stay or go with their text. If nothing can be learned, since no row has a
    language, all go. An empty table stays empty.
    """
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.lit(False))
    lang, score = unused(docs, "lang_pred"), unused(docs, "score")
    told = lang_hier.identified(docs, lang_hier.fit(docs, learn=fold), lang_to=lang, score_to=score)
    return told.filter(F.col(lang) != "und").select(*own_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id.

    An id stays once: of several rows with it whose text is kept, that of the lowest text hash. Rows without an id stay. Texts without
    words are alone. An empty table stays empty.
    """
    decided = written(bottomk.near_duplicates(docs, width=5, threshold=80).filter("doc_id is not null").select("doc_id", "text_mark", "kept"), "decided")
    repeated = decided.groupBy("doc_id").agg(F.min(F.when(F.col("kept"), F.col("text_mark"))).alias("mark"), F.count("*").alias("rows")).filter("rows > 1")
    repeated = written(repeated.select("doc_id", "mark"), "repeated-ids")
    gone = decided.filter("not kept").drop("kept").unionByName(decided.filter("kept").join(repeated, "doc_id").filter("text_mark <> mark").select("doc_id", "text_mark"))
    gone = written(gone.distinct(), "gone")
    gone_id, gone_mark = unused(docs, "gone_id"), unused(docs, "gone_mark")
    ids = gone.select(F.col("doc_id").alias(gone_id), F.col("text_mark").alias(gone_mark))
    # Few rows that go, 16 MB at most, are sent to the texts; more are joined by a shuffle.
    ids = F.broadcast(ids) if gone.count() <= bottomk.MAX_BROADCAST else ids
    kept = docs.join(ids, (F.col("doc_id") == F.col(gone_id)) & (F.xxhash64("text") == F.col(gone_mark)), "left_anti")
    if not repeated.isEmpty():
        kept = kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id is null"))
    return kept.select(*own_columns(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets masked and n_chars counted anew; a null text stays null, with null n_chars."""
    clean = secret_forest.redact(docs, secret_forest.fit(secret_forest.labelled_findings(spark)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*own_columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once, or up to three times.

    A number for each row, fixed in a table, leads its decision back to it, so repeated rows and ids, and null ones, have a decision
    each. A null source is a source of its own; a row without words may be taken or not. An empty table stays empty.
    """
    row, taken = unused(docs, "row_number"), unused(docs, "taken_row")
    times = unused(docs, "times")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    copies = cube_mix.mix(rows, carry=(row,)).filter("copies > 0").select(F.col(row).alias(taken), F.col("copies").alias(times))
    # Texts are dealt by row at every size; the decisions, not the texts, are the side that is hashed.
    found = rows.join(copies.hint("shuffle_hash"), F.col(row) == F.col(taken))
    return found.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*own_columns(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row that is left, repeated rows included; a null or empty text has no tokens. Other columns end here."""
    return bpe.bpe_round_trip(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("tokens", tokens)]

#: Learned models and hashes that SQL has no words for; tests/llm hold the operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
