"""The corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Between stages the rows are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.llm import decontaminate, jaccard_join, linedup, packing, quality
from labelwright.llm.common import discard, settle, sized, table, written
from labelwright.llm.queries import word_vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule go, as do those of hosts most of whose documents fail any rule.

    Null and empty texts have no words and go; null hosts are one host; null ids and repeated rows are judged like any
    others; very long texts count whole; hosts of equal rates have one verdict; other columns pass through, whatever their
    names; an empty table gives no rows.
    """
    return quality.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines spread over sites leave every text; n_chars follows the text, every document stays.

    A text without a line of its own keeps its lines if it stands on several rows: near-duplicate removal leaves one of
    them. Null and empty texts, null ids and repeated rows stay as they are or are cut alike; very long texts are cut
    whole, and of a line that repeats in a text all places go; null hosts are one site; other columns pass through,
    whatever their names; an empty table gives no rows.
    """
    cut = linedup.dedup_lines(docs, keep_copies=True, total_as="__line_total", removed_as="__line_removed", wholly_as="__wholly_spread")
    length = F.when(F.col("__line_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*(length.alias(c) if c == "n_chars" else c for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the smallest id, of equal ids that with the least digest.

    Rows are told by id and text, that by 128 bits. Null and empty texts stay; a class of null ids keeps one row; repeated
    rows are copies; very long texts count whole; other columns pass through, whatever their names; an empty table gives
    no rows.
    """
    return jaccard_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go; told by the digest of the text, as ids can be null.

    Null and empty texts stay; repeated rows go or stay together; very long texts are searched whole; items that stand as
    well in several places of a text take it once; other columns pass through, whatever their names; an empty table gives
    no rows, an empty benchmark takes none.
    """
    since = written()
    digest = jaccard_join.text_digest(docs["text"])
    hits = decontaminate.contaminated(docs.select(digest.alias("doc_id"), docs["text"]), table(spark, sf_dir, "benchmark"), id_type="binary")
    gone = settle(hits.select(F.col("doc_id").alias("__gone")).distinct(), "contaminated", since)
    return docs.join(sized(gone), digest == F.col("__gone"), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in its sequence.

    Null and empty texts are one end id; very long texts are cut into pieces; null ids stay null; of equally long pieces the
    one with the smaller id, then start, comes first; repeated rows are packed each; other columns are left out, whatever
    their names; an empty table gives no rows.
    """
    return packing.pack_documents(docs, word_vocabulary()).drop("group_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: SQL can express neither the approximate join nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's rows, and what it wrote besides, go when the next one's are written."""
    docs = before = None
    for name, stage in STAGES[:-1]:
        since = written()
        docs = settle(stage(spark, table(spark, sf_dir, "documents") if docs is None else docs, sf_dir), f"pipeline-{name}", since)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
