"""Full-text search: postings, BM25, and stems of terms if asked for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources import stemmer

#: English function words, fixed values.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with")


def terms(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Lower-case words of a text, accents off, stop words out."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*stopwords))


@F.pandas_udf("string")
def stem(word: pd.Series) -> pd.Series:
    """The stem of a lower-case English word, by Porter's rules; other words stay."""
    return word.map(stemmer.stem, na_action="ignore")


def postings(docs: DataFrame, id_col: str, text_col: str, stemmed: bool = False) -> DataFrame:
    """(term, id, tf, len): counted within each document before any shuffle of terms. stemmed: terms are
    stems, of which each document's are told from its distinct words."""
    rows = docs.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("w")).withColumn("len", F.size("w"))
    counted = rows.select("id", "len", F.explode("w").alias("term")).groupBy("term", "id", "len").agg(F.count("*").alias("tf"))
    return counted.groupBy(stem("term").alias("term"), "id", "len").agg(F.sum("tf").alias("tf")) if stemmed else counted


def match_bm25(index: DataFrame, docs: DataFrame, id_col: str, query: str, k: float = 1.2, b: float = 0.75, conjunctive: bool = False, stemmed: bool = False) -> DataFrame:
    """(id, score) of documents with a query's terms. Postings of these terms alone are read and joined.
    stemmed: as the index was made, so that words find their inflected forms."""
    spark = index.sparkSession
    wanted = [w for w in spark.range(1).select(terms(F.lit(query)).alias("w")).first()["w"]]
    if stemmed:
        wanted = [stemmer.stem(w) for w in wanted]
    stats = index.select("id", "len").distinct().agg(F.avg("len").alias("avgdl"))
    n = docs.agg(F.count(id_col).alias("n"))
    hits = index.filter(F.col("term").isin(*dict.fromkeys(wanted)))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(n))  # a row for each query term; one row each
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k + 1) / (F.col("tf") + k * (1 - b + b * F.col("len") / F.col("avgdl")))
    out = rows.groupBy("id").agg(F.sum(part).alias("score"), F.count("*").alias("found"))
    return (out.filter(F.col("found") == len(set(wanted))) if conjunctive else out).drop("found")

