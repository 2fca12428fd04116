"""Text search: terms, inverted index, weighted rank, and the scoring formulas of ranked search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight labels of terms by the part of a document they are in.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with")


def terms(text: str) -> Column:
    """Lower-cased runs of letters, digits and underscores. Terms are not stemmed."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def query_terms(query: str) -> list[str]:
    import re

    return list(dict.fromkeys(re.findall(r"\w+", query.lower())))


def hashtags_in(text: str) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"#(\w+)"), F.lit(1)), lambda x: F.concat(F.lit("#"), x))


def inverted_index(docs: DataFrame, key: str, parts: dict[str, str], stop_words: Sequence[str] = ()) -> DataFrame:
    """(term, key, tf, weight) over parts: column name to weight label. A term's weight is that of its best part."""
    rows = None
    for column, label in parts.items():
        x = docs.select(F.col(key), F.explode(terms(column)).alias("term"), F.lit(WEIGHTS[label]).alias("weight"))
        rows = x if rows is None else rows.unionByName(x)
    if stop_words:
        rows = rows.filter(~F.col("term").isin(list(stop_words)))
    return rows.groupBy("term", key).agg(F.count("*").alias("tf"), F.max("weight").alias("weight"))


def match_all(index: DataFrame, key: str, wanted: Sequence[str]) -> DataFrame:
    """Keys of documents that hold every term, with the summed weight and tf of those."""
    hits = index.filter(F.col("term").isin(list(wanted)))
    return hits.groupBy(key).agg(F.count("*").alias("_n"), F.sum(F.col("weight") * F.log1p("tf")).alias("rank")).filter(F.col("_n") == len(set(wanted))).drop("_n")


def count_term(text: str, term: str) -> Column:
    """How often a term is in a text, by one pattern in the scan: for a few terms that need no index."""
    import re

    word = re.escape(term)  # matched first: what stands before it is looked at afterwards
    return F.regexp_count(F.lower(text), F.lit(rf"{word}(?<![\p{{L}}\p{{N}}_]{word})(?![\p{{L}}\p{{N}}_])"))


def match_any(index: DataFrame, key: str, wanted: Sequence[str]) -> DataFrame:
    return index.filter(F.col("term").isin(list(wanted))).select(key).distinct()


def search_score(rank: Column, age_seconds: Column, likes: str = "likes", retweets: str = "retweets", views: str = "views") -> Column:
    """Relevance, hyperbolic freshness with six hours' scale, and engagement."""
    fresh = 0.4 / (1 + age_seconds / 21600.0)
    engaged = 0.3 * (0.012 * F.log1p(likes) + 0.012 * F.log1p(retweets) + 0.006 * F.log1p(F.col(views) / 1000.0))
    return 0.3 * rank + fresh + engaged


def search_score_exponential(age_seconds: Column, likes: str = "likes", retweets: str = "retweets", views: str = "views") -> Column:
    """Exponential freshness and engagement."""
    return 0.6 * F.exp(-age_seconds / 21600.0) + 0.4 * (0.4 * F.log1p(likes) + 0.4 * F.log1p(retweets) + 0.2 * F.log1p(F.col(views) / 1000.0))


def search_score_daily(rank: Column, age_seconds: Column, likes: str = "likes", retweets: str = "retweets", views: str = "views") -> Column:
    """As search_score with heavier engagement, whole thousands of views."""
    return 0.3 * rank + 0.4 / (1 + age_seconds / 21600.0) + 0.3 * (0.02 * F.log1p(likes) + 0.02 * F.log1p(retweets) + 0.01 * F.log1p(F.expr(f"{views} div 1000")))


def simple_score(text: str, tags: str, age_seconds: Column, likes: str = "likes", retweets: str = "retweets", views: str = "views") -> Column:
    """Length and tags, engagement, one hour's exponential freshness; two decimals."""
    engaged = F.log1p(likes) + F.log1p(retweets) + F.log1p(views)
    return F.round(0.3 * (F.length(text) + F.size(tags)) + 0.3 * engaged + 0.3 * F.exp(-age_seconds / 3600.0), 2)


def prefixes(term: str, longest: int = 15) -> Column:
    return F.transform(F.sequence(F.lit(1), F.least(F.length(term), F.lit(longest))), lambda i: F.substring(F.col(term), F.lit(1), i))


def autocomplete_index(scored: DataFrame, k: int = 3, longest: int = 15, shortest_term: int = 2) -> DataFrame:
    """(prefix, term, score, rank) of the k best terms of each prefix. scored: term, score."""
    from lakeloom.operators.aggregates import top_per_group

    rows = scored.filter(F.length("term") >= shortest_term).select(F.explode(prefixes("term", longest)).alias("prefix"), "term", "score")
    return top_per_group(rows, ["prefix"], [F.col("score").desc(), F.col("term")], k)
