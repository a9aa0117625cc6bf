"""From raw documents to token ids: each stage keeps, drops or rewrites documents, the last one encodes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuesheet.llm import decontaminate, langid, minhash, pieces, pii
from cuesheet.operators.scans import global_position
from cuesheet.session import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the training rows; the others go, as do those without a letter."""
    model = langid.fit(langid.training_rows(docs))
    return langid.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Rows without a doc_id or without words stay. Rows that repeat a doc_id with another text are documents of their own,
    each decided by its own text, the smaller text digest first; rows that repeat both are one document, and one stays.
    """
    digest = F.sha2("text", 256)
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", digest.alias("digest"))
    several = stored(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    if several.isEmpty():
        gone = minhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # Documents are numbered by id and text, so the smallest number of a group is of its smallest id.
    nodes = stored(global_position(rows.distinct(), "doc_id", ["digest"], "node"), "documents")
    mine = [docs["doc_id"] == nodes["doc_id"], digest == nodes["digest"]]
    texts = docs.join(nodes, mine).select(nodes["node"].alias("doc_id"), "text")
    found = stored(minhash.near_duplicates(texts), "near-duplicates")
    gone = found.where("NOT kept").select(F.col("doc_id").alias("node")).distinct()
    lost = stored(nodes.join(gone, "node", "left_semi").select("doc_id", "digest"), "lost-documents")
    left = docs.join(lost, [docs["doc_id"] == lost["doc_id"], digest == lost["digest"]], "left_anti").select(docs.columns)
    # Of rows that repeat both, the one with the smallest other columns stays.
    plain = left.join(several, "doc_id", "left_anti").unionByName(left.join(several, "doc_id", "left_semi").where("text IS NULL"))
    again = left.where("text IS NOT NULL").join(several, "doc_id", "left_semi").groupBy("doc_id", digest.alias("_digest"))
    one = again.agg(F.min(F.struct(*[F.col(c) for c in docs.columns])).alias("_row"))
    return plain.select(docs.columns).unionByName(one.select("_row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item, each decided by its own text, with or without a doc_id."""
    # Equal texts hold the same windows, so a text's digest stands for its rows; only null texts have none, and they stay.
    digest = F.sha2("text", 256)
    found = decontaminate.contamination(docs.select(digest.alias("doc_id"), "text"), _table(spark, sf_dir, "benchmark"))
    leaked = found.where("contaminated").select("doc_id").distinct()
    return docs.join(leaked, digest == leaked["doc_id"], "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in ``text`` masked and ``n_chars`` the new length.

    Null and empty texts stay as they are, repeated rows are masked alike, and texts may be of any length.
    """
    return pii.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, lossless: a sampled segmentation of every document.

    A null text has null ids, an empty one the empty list. Rows that repeat doc_id and text get the same ids.
    """
    return pieces.encode(docs)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
