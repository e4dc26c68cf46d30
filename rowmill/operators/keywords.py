"""Keyword search over sparse vectors: an inverted index from words to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.operators.search import hybrid, top


def keyword_index(df: DataFrame, key: str, text: str, name: str = "id", vocabulary: list[str] | None = None) -> DataFrame:
    """(word, ``name``, w): the words of each text, runs of letters in lower case, by their share of the vector of
    counts scaled to length 1.  With ``vocabulary`` only its words count; texts without any have no row."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: (w != "") if vocabulary is None else w.isin(*vocabulary))
    counts = df.select(F.col(key).alias(name), F.explode(words).alias("word")).groupBy(name, "word").agg(F.count(F.lit(1)).cast("double").alias("c"))
    norms = counts.groupBy(name).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    return counts.join(norms, name).select("word", name, (F.col("c") / F.col("norm")).alias("w"))


def keyword_scores(pairs: DataFrame, asked: DataFrame, index: DataFrame) -> DataFrame:
    """``pairs`` (query_id, id and others) with ``keyword``, the cosine of their words: exact, over all words that
    both have, 0 where there is none.  ``asked`` is an index named query_id."""
    both = pairs.select("query_id", "id").join(asked.withColumnRenamed("w", "wq"), "query_id").join(index, ["id", "word"])
    score = both.groupBy("query_id", "id").agg(F.sum(F.col("wq") * F.col("w")).alias("_kw"))
    return pairs.join(score, ["query_id", "id"], "left").withColumn("keyword", F.coalesce("_kw", F.lit(0.0))).drop("_kw")


def keyword_candidates(asked: DataFrame, index: DataFrame, most_rows: int) -> DataFrame:
    """(query_id, id) of the rows that share a word with a query, other than the query itself, through the words that
    stand in ``most_rows`` rows or less: each word of a query brings so many rows at most, and common words
    bring none (they count in ``keyword_scores`` all the same)."""
    rare = index.groupBy("word").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= most_rows).select("word")
    return asked.select("query_id", "word").join(index.join(rare, "word").select("word", "id"), "word").where("query_id <> id").select("query_id", "id").distinct()


def keyword_search(queries: DataFrame, base: DataFrame, key: str, text: str, k: int, most_rows: int) -> DataFrame:
    """(query_id, id, keyword, rank): the best k by keywords among the rows that a rare word finds."""
    asked, index = keyword_index(queries, key, text, "query_id"), keyword_index(base, key, text)
    scored = keyword_scores(keyword_candidates(asked, index, most_rows), asked, index).withColumn("keyword", F.round("keyword", 10))
    return top(scored, "query_id", "keyword", "id", k)


def hybrid_search(semantic: DataFrame, asked: DataFrame, index: DataFrame, k: int, least_semantic: float = 0.45, least: float = 0.4) -> DataFrame:
    """(query_id, id, keyword, score, hybrid, rank) from ``semantic`` scores (query_id, id, score): the best 3k by
    meaning are fetched (30 at most), those below the floor of meaning go, then 0.4 keyword + 0.6 meaning
    ranks the rest above its own floor."""
    fetched = top(semantic, "query_id", "score", "id", min(3 * k, 30)).drop("rank").where(F.col("score") >= least_semantic)
    both = keyword_scores(fetched, asked, index).withColumn("keyword", F.round("keyword", 10))
    both = both.withColumn("hybrid", F.round(hybrid(F.col("keyword"), F.col("score"), least_semantic, least), 8)).where("hybrid IS NOT NULL")
    return top(both, "query_id", "hybrid", "id", k)
