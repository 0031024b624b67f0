"""Corpus pipeline: toxicity, near duplicates, decontamination, secrets, encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the
columns of docs, whatever they are named; the last one returns the encoded texts.  In every stage a null text has
no words and no characters, an empty table gives an empty one, texts pass whole however long they are, and
repeated rows are rows, but for near copies, of which one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtrail.llm import bpe, decontaminate, jaccard, secrets, toxicity
from evtrail.llm.common import drop_written, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.3 or more.  Null and empty texts have a score like others; equal rows go or stay together; without labels
    of toxic rows the model finds none and all stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(model)("text") < 0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of near copies (five words, 80 %), once;
    documents that share an id but not the text count apart; rows without id stay, once each.  Texts without words
    are no copies of each other."""
    found = jaccard.jaccard_components(docs, size=5, percent=80, nodes=True)
    first = found.where("doc_id is not null").groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    node = "node"
    while node in docs.columns:
        node += "_"
    at = docs.where("doc_id is not null").withColumn(node, F.xxhash64("doc_id", "text"))
    kept = at.join(first.select(F.col("first.node").alias(node)), node, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(docs.columns).union(docs.where("doc_id is null").distinct())


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a benchmark window; texts without words stay, and an empty benchmark lets all stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=tuple(docs.columns)).where("n_hit = 0").select("rest.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; every document stays, a null text stays null.  Owners are the `source` of docs, which without that column is
    one owner."""
    owned = docs if "source" in docs.columns else docs.withColumn("source", F.lit(None).cast("string"))
    found = secrets.scan_secrets(owned, carry=tuple(c for c in docs.columns if c not in ("text", "n_chars")))
    text = found.select("rest.*", F.when(F.col("text").isNotNull(), secrets.redacted(F.col("text"), F.col("spans"))).alias("text"))
    return (text.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else text).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each row; a null or empty text has none."""
    import public_tokenizers

    coded = bpe.encode(docs, path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("encoding", encode),
]

#: The label model and the byte-level merges have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each is written, and what the next one has read is deleted."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            drop_written(last)
        last = docs
    return docs
