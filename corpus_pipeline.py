"""The corpus pipeline: language ID, quality rules, near duplicates, PII, packing. Each stage's rows are written and reread."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.llm import jaccard_join, language_id, packing, pii, quality_rules
from fernweave.llm.common import discard, recorded, stash
from fernweave.llm.queries import surrogate_key

#: Each stage takes tables of documents with any further columns, of any names, and hands all columns on. It takes null
#: and repeated ids as separate rows, keeps an empty table empty, and reads whole texts.


_left: list[DataFrame] = []

#: Ten thousand whole texts, Spark's usual batch, are held several times over by the executor and by each of its workers.
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def short_batches(spark: SparkSession) -> None:
    """Workers get texts in batches of _BATCH_BYTES, or of fewer if the session says so. No result depends on it.

    It stays set, since a stage's result is lazy.
    """
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if not 0 < now <= _BATCH_BYTES:
        spark.conf.set(_BATCH, str(_BATCH_BYTES))


def stage(f):
    """f as a stage. What it stashes goes when the next stage starts: by then its result has been written and reread."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        short_batches(spark)
        discard(*(t for t in _left if t.sparkSession.sparkContext is spark.sparkContext))
        _left.clear()
        with recorded() as made:
            out = f(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_stage


@stage
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects: null and empty texts, those without letters, or below the calibrated score.

    The model is learned from these documents' own labels; without any, all are rejected. Rows are judged one by one:
    repeated rows and ties go or stay together.
    """
    judged = language_id.predict(docs, language_id.fit(docs), lang="__lang", score="__score", rejected="__rejected")
    return judged.where(~F.col("__rejected")).drop("__lang", "__score", "__rejected")


@stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail a quality rule (null and empty texts do) or that the calibrated forest holds anomalous.

    Without labels of both kinds the rules alone decide. Rows are judged one by one.
    """
    # By place, so that no column of the table is taken for one of the statistics.
    places = [f"c{i}" for i in range(len(docs.columns))]
    place = dict(zip(docs.columns, places, strict=True))
    measured = stash(quality_rules.measured(docs.toDF(*places), text_column=place["text"]), "quality-measured")
    model = quality_rules.fit_measured(measured, spark.read.parquet(f"{sf_dir}/labels.parquet"), id_column=place["doc_id"])
    judged = quality_rules.judge_measured(measured, model)
    return judged.where("kept").select(*places).toDF(*docs.columns)


@stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document of the smallest id stays.

    Rows of one id, or without one, go only if all of them go; of rows with the same id and text one stays, the same in
    every run. Documents with a null text or without words stay.
    """
    groups = jaccard_join.link_documents(docs, jaccard_join.Settings(k=5, percent=80))
    stays = (F.col("component_id") == F.col("doc_id")) | F.col("component_id").isNull()
    heads = groups.groupBy(F.col("doc_id").alias("__head")).agg(F.count("*").alias("__n"), F.max(stays).alias("__stays")).where("__stays").drop("__stays")
    kept = docs.join(heads, F.col("doc_id").eqNullSafe(F.col("__head"))).drop("__head")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Few ids, if any, stand there twice: only their texts are shuffled by content.
    twice = kept.where("__n > 1").groupBy("doc_id", F.sha2("text", 256).alias("__text")).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("__row"))
    return kept.where("__n = 1").drop("__n").unionByName(twice.select(*(F.col("__row").getField(c).alias(c) for c in docs.columns)))


@stage
def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; n_chars, if there is one, follows the new text, null for a null one. Every row stays; equal
    texts stay equal.
    """
    safe = pii.protect(docs, surrogate_key(spark))
    return safe.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else safe


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as sequences of 2048 tokens: a row for each piece of a document, with its ids. Null and empty texts are
    their end id alone; columns other than doc_id and text end here.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", known_language), ("quality_rules", good_quality), ("near_duplicates", one_of_each), ("pii", without_pii), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned models and token packing have no SQL; tests compare each stage with a version of one process.
ORACLE_SQL = None
