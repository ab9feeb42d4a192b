"""A training-data pipeline over ``documents``.

Stages, in order, each on all that the one before kept:

1. ``toxicity``: documents that the network scores at the threshold or above go.
2. ``line_dedup``: later copies of line runs of fifty words or more are cut out of the texts; a document of which nothing
   is left goes.
3. ``ngram_jaccard``: of each component of similar documents (five-word shingles, 0.8) the one with the smallest id stays.
   Documents without words are similar to none and stay.
4. ``decontamination``: documents that hold a ten-word window of a test item go.
5. ``sentencepiece``: token ids of what is left, with a check that they decode to the text.

Each stage returns the columns of ``documents`` (``n_chars`` follows the text), the last one those of the encoding. Null
texts pass every stage as texts without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsift.llm import decontaminate, jaccard, linededup, pieces, toxicity
from packsift.llm.queries import PIECES
from packsift.llm.shared import packed, small, unpacked
from packsift.session import cut_lineage


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = packed(docs, "doc_id", "text")
    model = toxicity.fit(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = toxicity.scored(rows, model).filter(F.col("score") < toxicity.THRESHOLD)
    return unpacked(kept, docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # staged before the filter, which the optimizer would else put below the cutting, once for each line
    cut = cut_lineage(linededup.deduplicated(packed(docs, "doc_id", "text"), 50))
    cut = cut.filter((F.col("n_deleted") == 0) | F.col("text").rlike(linededup.HAS_WORD))
    size = F.when(F.col("n_deleted") == 0, F.col("rest.n_chars")).otherwise(F.char_length("text")) if "n_chars" in docs.columns else None
    return unpacked(cut, docs.columns, **({} if size is None else {"n_chars": size}))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = cut_lineage(jaccard.similar_groups(docs, 5, 80))
    gone = small(groups.filter("component_id <> doc_id").select("doc_id").distinct())
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # rows that repeat an id are copies of one document, unless they have no words
    again = cut_lineage(groups.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    one = kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10, slop=None)
    gone = small(found.filter("contaminated").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs.select("doc_id", "text"), PIECES, keep_text=False).select("doc_id", "n_tokens", "ids", "exact")


STAGES = [("toxicity", toxic_stage), ("line_dedup", line_stage), ("ngram_jaccard", near_stage), ("decontamination", leak_stage), ("sentencepiece", piece_stage)]
#: The network and the encoder have no SQL form; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
