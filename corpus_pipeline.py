"""The corpus pipeline: five stages from the documents table to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import jaccard, langid, linededup, packing, quality
from inkloom.llm.common import cut, table
from inkloom.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    return quality.score_quality(docs.select(COLUMNS), table(spark, sf_dir, "labels")).where("accepted").select(COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learnt language.

    Those go that have no letters, that no language claims with at least half of the
    probability, or that (of 64 characters or more) no model fits: which need a quarter
    more bits a byte than any text of the training sample under the trees of other texts.
    Rows without text go; null metadata and repeated rows need no care.
    """
    texts = langid.sample_texts(langid.lettered(docs))
    named = langid.identify(docs, langid.train(texts) if texts else None, tuple(COLUMNS))
    most = F.lit(1.25 * langid.usual_bits(texts) if texts else 8.0)
    return named.where("lang_pred <> 'und' AND score >= 0.5").where((F.length("text") < 64) | (F.col("bits_per_byte") <= most)).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line passages that stand in an earlier one; what is left of a text may not be blank."""
    done = linededup.dedup_lines(docs.select(COLUMNS))
    return done.where("n_removed = 0 OR text RLIKE '[^ \\\\n]'").withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id, and of that the smallest hash of text.

    Of rows that agree in doc_id and text the one with the smallest (lang, source, n_chars)
    stays, nulls first, also where doc_id is null; such documents are linked with no other.
    """
    groups = jaccard.similar_components(docs, by_text=True)
    gone = groups.where("NOT first").select("doc_id", "text_hash").distinct()
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    one = docs.select(COLUMNS).groupBy("doc_id", F.xxhash64("text").alias("text_hash")).agg(F.min(F.struct(*rest, "text")).alias("row"))
    return one.join(gone, ["doc_id", "text_hash"], "left_anti").select("doc_id", "row.*").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in training sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("language id", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each on what the one before kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages learn models, so SQL cannot express them; tests hold each against a brute-force version.
ORACLE_SQL = None
