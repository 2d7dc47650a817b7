"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, extra ones included, whatever their names.

Edge cases: rows are told apart by their places, so rows with one id and different texts are different documents, and equal
rows, with or without an id, count one by one: near duplicates keep one of them, the mix takes them as often in all as it
takes them in op4. Null and empty texts pass the first three stages and have no words to be mixed, so the mix leaves them
out; so it does with what the third stage empties. Empty tables give empty tables. Each stage begins by giving back what the
driver still holds of the one before, as all stages share its memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import few, free, placed, small_batches, stash, table, tidy
from quillmesh.llm.mixing import times
from quillmesh.llm.ngram_join import surplus
from quillmesh.llm.packing import pack_documents
from quillmesh.llm.suffix_dedup import strip_repeats
from quillmesh.llm.toxicity import learned, score

#: Places of rows (24 bytes each) that may be broadcast; beyond that the same joins shuffle.
BROADCAST_ROWS = 1_000_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. Null and empty texts stay."""
    tidy(spark)
    model = learned(spark, docs, table(spark, sf_dir, "labels"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kept = score(plain, model, text=f"c{docs.columns.index('text')}", keep=tuple(plain.columns)).filter("predicted = 0")
    return kept.select(*plain.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that n-gram Jaccard links join one row stays: that with the smallest id, a null id last, and once if repeated."""
    tidy(spark)
    held = placed(docs)
    gone = stash(surplus(held, *(f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))))
    return held.join(few(gone, BROADCAST_ROWS), ["file", "place"], "left_anti").drop("file", "place").toDF(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur elsewhere too are cut out; n_chars follows the text."""
    tidy(spark)
    small_batches(spark)
    return strip_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice."""
    tidy(spark)
    held = placed(docs)
    taken = stash(times(held, ("file", "place"), *(f"c{docs.columns.index(c)}" for c in ("doc_id", "text", "source"))))
    both = held.join(few(taken, BROADCAST_ROWS), ["file", "place"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return both.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all that is left; see op8."""
    tidy(spark)
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("packing", packing)]

#: Toxicity scores and token ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stash(stage(spark, docs, sf_dir))
        if k:
            free(before)
    return docs
