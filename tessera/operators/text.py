"""The text pipeline and its statistics over DataFrames of documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import analysis
from tessera.operators.stem import stem_tokens


@dataclass(frozen=True)
class AnalyzerOptions:
    stopwords: bool = True
    stem: bool = True
    drop_single: bool = True
    max_terms_per_doc: int | None = analysis.MAX_TERMS


def analyze(docs: DataFrame, key: str, text: str, options: AnalyzerOptions = AnalyzerOptions()) -> DataFrame:
    """key and tokens of each document after tokenising, normalising, stop-words, stemming and single letters."""
    t = analysis.tokens(F.col(text))
    if options.stopwords:
        t = analysis.without_stopwords(t)
    out = docs.select(F.col(key), t.alias("tokens"))
    if options.stem:
        out = out.withColumn("tokens", stem_tokens(F.col("tokens")))
    if options.drop_single:
        out = out.withColumn("tokens", analysis.without_single_letters(F.col("tokens")))
    return out


def token_statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each document: key, token_count, total_token_length, input_size_bytes."""
    out = docs.select(F.col(key), F.octet_length(text).cast("long").alias("input_size_bytes"), analysis.tokens(F.col(text)).alias("t"))
    return out.select(key, F.size("t").cast("long").alias("token_count"), analysis.token_chars(F.col("t")).alias("total_token_length"), "input_size_bytes")


def corpus_token_statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row: documents, tokens, token characters, bytes and mean token length."""
    sums = token_statistics(docs, key, text).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("token_count").alias("token_count"),
        F.sum("total_token_length").alias("total_token_length"),
        F.sum("input_size_bytes").alias("input_size_bytes"),
    )
    return sums.withColumn("mean_token_length", F.when(F.col("token_count") > 0, F.col("total_token_length") / F.col("token_count")).otherwise(0.0))


def term_frequency(docs: DataFrame, text: str) -> DataFrame:
    """term, frequency over the whole corpus; counted on the map side first."""
    return docs.select(F.explode(analysis.tokens(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("frequency"))


def top_terms(docs: DataFrame, text: str, k: int) -> DataFrame:
    return term_frequency(docs, text).orderBy(F.col("frequency").desc(), "term").limit(k)


def frequency_spectrum(frequencies: DataFrame) -> DataFrame:
    """frequency, n_terms: how many terms occur so often."""
    return frequencies.groupBy("frequency").agg(F.count(F.lit(1)).alias("n_terms"))


def zipf_table(frequencies: DataFrame) -> DataFrame:
    """rank (ties in any order, each its own), frequency, zipf_frequency = top frequency / rank.

    Ranks come from running sums over the spectrum, whose rows are the distinct frequencies, and not from a sort of all
    terms in one task: the distinct frequencies of n tokens are at most the square root of 2 n.
    """
    from pyspark.sql import Window

    order = Window.orderBy(F.col("frequency").desc())
    spectrum = frequency_spectrum(frequencies)
    spectrum = spectrum.withColumn("last", F.sum("n_terms").over(order)).withColumn("top", F.first("frequency").over(order))
    ranks = F.explode(F.sequence(F.col("last") - F.col("n_terms") + 1, F.col("last")))
    out = spectrum.select(ranks.alias("rank"), "frequency", "top")
    return out.select("rank", "frequency", (F.col("top") / F.col("rank")).alias("zipf_frequency"))


def zipf_summary(docs: DataFrame, text: str) -> DataFrame:
    """One row: files, tokens, distinct tokens, top frequency."""
    totals = term_frequency(docs, text).agg(F.coalesce(F.sum("frequency"), F.lit(0)).alias("total_tokens"), F.count(F.lit(1)).alias("distinct_tokens"), F.coalesce(F.max("frequency"), F.lit(0)).alias("top_frequency"))
    return totals.crossJoin(docs.agg(F.count(F.lit(1)).alias("files")))  # one row by one row
