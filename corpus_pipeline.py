"""Corpus pipeline: quality rules, line dedup, SimHash near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before it kept; all but the last
return the columns of ``documents``. No stage can be put in one SQL statement with the others (token ids,
XXH64 and packing are beyond SQL), so ORACLE_SQL is None and tests compare stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import durable, table
from tidemill.llm.decontaminate import find_contamination
from tidemill.llm.line_dedup import dedup_lines
from tidemill.llm.packing import pack_documents
from tidemill.llm.quality_rules import quality_rules
from tidemill.llm.simhash import FOUR_FIFTHS, near_duplicates

ORACLE_SQL = None
#: Near-duplicates are judged on shingles of five words.
SHINGLE = 5


def _same_row() -> list:
    """What identifies a row: its id and a hash of its text; rows alike in both get the same decision."""
    return [F.col("doc_id"), F.xxhash64("text").alias("tie")]


def _filtered(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, tie) is in ``decisions``; columns of any names are kept."""
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    doc_id, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    chosen = decisions.select("doc_id", "tie").distinct()
    same = F.col(doc_id).eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("tie"))
    return inner.join(chosen, same, "left_semi").toDF(*docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts under a ``key`` that also holds the text's hash, for operators that answer per id; ``lang`` where there is one."""
    return docs.select(F.struct(*_same_row()).alias("key"), "text", *[c for c in ("lang",) if c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have no words and go. Rows that repeat go or stay together; null ids and languages are no
    obstacle; an empty table stays empty; all columns stay.
    """
    judged = quality_rules(_keyed(docs), id_col="key")
    return _filtered(docs, judged.where("kept").select("key.doc_id", "key.tie"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with later copies of repeated line runs deleted from their texts, and n_chars of what is left.

    A later copy of a whole text leaves an empty text. Null texts stay null; rows that repeat in id and text are
    one document and all keep their lines; an empty table stays empty; all columns stay.
    """
    edited = dedup_lines(docs)
    deleted = F.col(edited.columns[-2])
    if "n_chars" in docs.columns:
        edited = edited.withColumn("n_chars", F.when(deleted > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return edited.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more): the least id, then the least text hash.

    Null and empty texts are one group. Rows that repeat in id and text stay together; a null id is least; an
    empty table stays empty; all columns stay.
    """
    found = near_duplicates(_keyed(docs), id_col="key", like=FOUR_FIFTHS, shingle=SHINGLE)
    return _filtered(docs, found.where(F.col("key").eqNullSafe(F.col("component_id"))).select("key.doc_id", "key.tie"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts hold none and stay. Rows that repeat go or stay together; without documents or items
    nothing goes; all columns stay.
    """
    found = find_contamination(_keyed(docs), table(spark, sf_dir, "benchmark"), id_col="key")
    return _filtered(docs, found.where(F.size("hits") == 0).select("key.doc_id", "key.tie"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences.

    A null or empty text is one piece that holds the end id; rows that repeat are packed each; null ids are kept;
    an empty table gives no pieces.
    """
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = durable(docs, f"stage{number}")
    return docs
