"""From documents to token ids: quality, toxicity, near-duplicates, decontamination, encoding.

Each stage works on all that the one before kept. What it rejects is gone from then on; the columns
of documents stay as they are up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mil, neardup, toxicity, winnow
from tidemark.llm.bpe import encoded
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.shared import new_path, staged, table

#: Thresholds of the two classifiers, as in their own queries.
QUALITY, TOXIC = 0.3, 0.5
#: Ids that are broadcast at most, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number of their own for each row, and the column's name; ids may be null or repeat."""
    key = "row_key"
    while key in [c.lower() for c in docs.columns]:
        key += "_"
    return staged(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _less(keyed: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``keyed`` without the rows whose numbers are the only column of ``gone``, and without the numbers."""
    gone = _few(staged(gone.toDF("gone_id"), "gone"))
    return keyed.join(gone, keyed[key] == gone["gone_id"], "left_anti").drop(key)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score for quality reaches the threshold, row by row.

    A null or empty text has a score like others; rows that repeat stay or go together. No documents, or no labels,
    make no error.
    """
    model = mil.learned(docs, table(spark, sf_dir, "labels"))
    return docs.where(mil.scorer(model)("text") >= QUALITY)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score for toxicity stays under the threshold, row by row.

    A null or empty text has no hits and stays; rows that repeat stay or go together. Without labels all stay.
    """
    lexicon = toxicity.learned(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(spark, lexicon)("text") < TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the smallest id, a null one last; of rows that repeat id and text one."""
    keyed, key = _keyed(docs)
    found = staged(neardup.near_duplicates(keyed, doc_id=key), "found")
    # groups are labelled by their smallest row; where another one has the smallest id, the two change places
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), F.col(key).alias("row"))
    rows = found.select(F.col("doc_id").alias("own"), "component_id").join(keyed.select(F.col(key).alias("own"), place.alias("place")), "own")
    swap = staged(rows.groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("component_id").alias("was"), F.col("place.row").alias("now")).where("was <> now"), "swap")
    gone = found.where("not kept").select("doc_id").union(swap.select("was"))
    left = _less(keyed, key, gone.join(swap, gone["doc_id"] == swap["now"], "left_anti"))
    again = docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 and doc_id is not null").select("doc_id")
    if again.isEmpty():
        return left
    again = _few(again)
    return left.join(again, "doc_id", "left_anti").select(left.columns).union(left.join(again, "doc_id", "left_semi").select(left.columns).dropDuplicates(["doc_id", "text"]))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs, row by row.

    A null or empty text stays, and so does a clean row that shares its id with a contaminated one. Without items all stay.
    """
    keyed, key = _keyed(docs)
    return _less(keyed, key, winnow.contamination(keyed, table(spark, sf_dir, "benchmark"), doc_id=key).where("contaminated").select("doc_id"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each row.

    A null or empty text has no ids; rows that repeat, or have a null id, are rows of the result.
    """
    made = encoded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), tokenizer_path("byte_bpe_50k.tiktoken"))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxic),
    ("minhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", tokens),
]

#: Models that are trained cannot be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
