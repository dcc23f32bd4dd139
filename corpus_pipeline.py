"""A corpus from documents: quality rules, near-duplicates, personal data, source mixing, packing.

Every stage reads what the one before it wrote. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import mixing, neardup, packing, pii, quality_rules
from wavemill.llm.common import Workspace
from wavemill.llm.queries import table, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a learned one go, so null, empty and very short texts do; repeated rows fare alike.

    Rules are learned from a bounded sample, and no row is stored twice.
    """
    labels = table(spark, sf_dir, "labels")
    rules = quality_rules.learn(Workspace(spark, "quality"), quality_rules.labelled(docs, labels), labels)
    rows = docs.select("doc_id", "text", whole(docs))
    # a filter is not pushed below a column of row numbers, so the statistics it asks for are computed once
    measured = quality_rules.stats(rows, ["doc_id", "whole"]).withColumn("_at", F.monotonically_increasing_id())
    return quality_rules.apply(measured, rules).filter(F.col("kept") & (F.col("_at") >= 0)).select("whole.*")


def whole(docs: DataFrame) -> Column:
    """A row's columns as one, which clash with no others."""
    return F.struct(*["`" + c.replace("`", "``") + "`" for c in docs.columns]).alias("whole")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share four fifths of their five-word shingles one row stays, that of the smallest doc_id. Texts without words
    and rows without a doc_id stay."""
    return neardup.one_of_each(Workspace(spark, "neardup"), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are replaced by their kinds; n_chars follows the text. Null texts stay null, with their n_chars; no row goes."""
    clean = pii.sanitise(Workspace(spark, "pii"), docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as many times as the mix takes its words, rounded half up: left out, once or twice. Texts without words go.

    Rows that repeat a doc_id and text each come as often as they are taken on average; rows without a doc_id or source are documents like others.
    """
    ws = Workspace(spark, "mix")
    times = ws.save(mixing.times(mixing.mix(ws, docs)), "times")
    rows = docs.select(mixing.row_key().alias("key"), F.col("source").alias("of"), whole(docs))
    taken = rows.join(times, (rows.key == times.row_key) & rows.of.eqNullSafe(times.source))
    return taken.select("whole", F.explode(F.sequence(F.lit(1), "times"))).select("whole.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 4096 tokens. A document that the mix repeats is packed as often; a null text is its end id alone."""
    return packing.pack(Workspace(spark, "pack"), docs, packing.Packing(tokenizer_path()))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("pii", personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: Learned rules, near-duplicates by signatures and tokens are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = ws.save(docs, name)
    return docs
