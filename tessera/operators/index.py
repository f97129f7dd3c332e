"""Inverted index: postings, posting lists, a persisted index sorted by term, and lookups in it.

In the persisted index a term's list is cut into blocks of ids, so that a term that a third of all documents hold is many
rows of bounded size and not one; df counts the whole list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import analysis
from tessera.sources.scratch import scratch_path

#: Ids in a block of a posting list, at most.
BLOCK = 1 << 20
SCHEMA = T.StructType([T.StructField("term", T.StringType()), T.StructField("block", T.LongType()), T.StructField("df", T.LongType()), T.StructField("postings", T.ArrayType(T.LongType(), False))])


def postings(docs: DataFrame, key: str, text: str, most: int | None = analysis.MAX_TERMS) -> DataFrame:
    """term and key, once for each of a document's first `most` distinct terms."""
    return docs.select(F.explode(analysis.index_terms(analysis.tokens(F.col(text)), most)).alias("term"), F.col(key))


def token_postings(analyzed: DataFrame, key: str, most: int | None = analysis.MAX_TERMS) -> DataFrame:
    """The same from the tokens column of `analyze`."""
    return analyzed.select(F.explode(analysis.index_terms(F.col("tokens"), most)).alias("term"), F.col(key))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def dictionary_size(postings: DataFrame) -> DataFrame:
    """One row: terms and postings."""
    return document_frequency(postings).agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))


def posting_blocks(postings: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """term, block, df, postings (ascending): a block holds the ids of a range of `block` ids; df is the term's."""
    rows = postings.withColumn("block", F.floor(F.col(key) / block).cast("long"))
    cut = rows.groupBy("term", "block").agg(F.array_sort(F.collect_set(F.col(key).cast("long"))).alias("postings"))
    df = F.sum(F.size("postings").cast("long")).over(Window.partitionBy("term"))  # over a term's blocks, few even of a common term
    return cut.select("term", "block", df.alias("df"), "postings")


def inverted_index(postings: DataFrame, key: str) -> DataFrame:
    """term, df, postings: the whole list of each term in one row, for corpora whose lists fit one."""
    lists = postings.groupBy("term").agg(F.array_sort(F.collect_set(F.col(key).cast("long"))).alias("postings"))
    return lists.select("term", F.size("postings").cast("long").alias("df"), "postings")


def save_index(postings: DataFrame, key: str, path: str) -> None:
    """Writes the blocks sorted by term, so that a term is found by the statistics of few row groups. The blocks are written
    once before they are sorted, as ranges are found by a sample that would make them again."""
    spark = postings.sparkSession
    staged = scratch_path(spark, "blocks")
    posting_blocks(postings, key).write.parquet(staged)
    spark.read.parquet(staged).repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """The index at the path; ValueError if its columns aren't those of an index."""
    found = spark.read.parquet(path)
    if [(f.name, f.dataType.simpleString()) for f in found.schema] != [(f.name, f.dataType.simpleString()) for f in SCHEMA]:
        raise ValueError(f"not an index: {found.schema.simpleString()}")
    return found


def find_term(index: DataFrame, term: str) -> DataFrame:
    """term and df of one dictionary entry; no row if there is none."""
    return index.where(F.col("term") == term).select("term", "df").distinct()


def search_exact(index: DataFrame, term: str, key: str = "doc_id") -> DataFrame:
    """The ids of an exact dictionary key; the term isn't analysed."""
    return index.where(F.col("term") == term).select(F.explode("postings").alias(key))


def merge_postings(lists: Column) -> Column:
    """One ascending list without repeats from an array of lists."""
    return F.array_sort(F.array_distinct(F.flatten(lists)))
