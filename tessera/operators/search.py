"""Keyword and vector search over chunks, as relational operators.

Postings are (token, id, tf) rows.  A query touches only its own tokens' postings, so scoring is a
filter, a join with the per-token document frequencies of a handful of tokens, and one aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.sources.shared import kept

K1, B = 1.2, 0.75
COSINE_WEIGHT, KEYWORD_WEIGHT = 0.7, 0.3
TOP_K, PER_DOC, FLOOR, ALWAYS = 6, 2, 0.3, 2
BOOST = 0.3


def term_lists(chunks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key and its tokens."""
    return chunks.select(key, tokens(F.col(text)).alias("terms"))


def occurrences(terms: Column, word: str) -> Column:
    return F.size(F.filter(terms, lambda t: t == F.lit(word)))


def postings(chunks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """token, key, tf."""
    return term_lists(chunks, key, text).select(key, F.explode("terms").alias("token")).groupBy("token", key).agg(F.count(F.lit(1)).alias("tf"))


def bm25(chunks: DataFrame, key: str, query: list[str], text: str = "text") -> DataFrame:
    """key and bm25 of all chunks that hold a query token.

    Term frequencies of the query's tokens are taken within the row, so no posting of another token is ever
    made.  One pass over the texts keeps the few numbers of the rows that hold a token and observes the
    corpus's statistics, a handful of numbers, on the way.
    """
    terms = sorted(set(query))
    if not terms:
        return chunks.select(key, F.lit(0.0).alias("bm25")).limit(0)
    counted = term_lists(chunks, key, text).select(key, F.size("terms").alias("dl"), *[occurrences(F.col("terms"), w).alias(f"tf{i}") for i, w in enumerate(terms)])
    seen = Observation()
    sums = [F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]]
    hits = kept(counted.observe(seen, *sums).filter(F.greatest(*[F.col(f"tf{i}") for i in range(len(terms))], F.lit(0)) > 0))
    stats = seen.get
    total = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), stats[f"df{i}"]
        idf = math.log(1 + (stats["n"] - df + 0.5) / (df + 0.5))
        total = total + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / (stats["avgdl"] or 1.0)))
    return hits.select(key, total.alias("bm25"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_to(vectors: DataFrame, key: str, query: list[float], values: str = "embedding") -> DataFrame:
    """key and cos of all vectors of the query's length with a finite norm over 0."""
    q = F.array(*[F.lit(float(x)) for x in query])
    usable = vectors.filter(F.size(values) == len(query)).select(key, dot(F.col(values), q).alias("d"), F.sqrt(dot(F.col(values), F.col(values))).alias("n"))
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    return usable.filter((F.col("n") > 0) & (F.col("n") < float("inf"))).select(key, (F.col("d") / F.col("n") / norm).alias("cos"))


def minmax(df: DataFrame, column: str, out: str) -> DataFrame:
    """column scaled to 0..1 over all rows where it isn't null; 0 if its range is under 1e-9 or it is null."""
    ends = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    wide = F.col("__hi") - F.col("__lo") > 1e-9
    scaled = F.when(wide & F.col(column).isNotNull(), (F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.0)
    return df.crossJoin(F.broadcast(ends)).withColumn(out, scaled).drop("__lo", "__hi")


def hybrid(all_keys: DataFrame, key: str, cosine: DataFrame, keyword: DataFrame) -> DataFrame:
    """key, score of rows with a vector or a key word: weighted min-max scores, keywords over all rows."""
    joined = all_keys.select(key).join(cosine, key, "left").join(keyword, key, "left")
    filled = joined.withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    scaled = minmax(minmax(filled, "bm25", "__k"), "cos", "__c")
    kept = scaled.filter(F.col("cos").isNotNull() | (F.col("bm25") > 0))
    return kept.select(key, (COSINE_WEIGHT * F.col("__c") + KEYWORD_WEIGHT * F.col("__k")).alias("score"))


def capped(hits: DataFrame, key: str, doc: str, k: int = TOP_K, per_doc: int = PER_DOC) -> DataFrame:
    """At most k hits, best first, per_doc of each document; under FLOOR only while fewer than ALWAYS."""
    order = [F.desc("score"), F.col(key)]
    few = hits.withColumn("__d", F.row_number().over(Window.partitionBy(doc).orderBy(*order))).filter(F.col("__d") <= per_doc)
    top = few.orderBy(*order).limit(k)  # the rank below is over k rows
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.filter((F.col("score") >= FLOOR) | (F.col("rank") <= ALWAYS)).drop("__d")


def best_of(searches: list[DataFrame], key: str) -> DataFrame:
    """Each hit of several searches at its best score."""
    union = searches[0].select(key, "score")
    for other in searches[1:]:
        union = union.unionByName(other.select(key, "score"))
    return union.groupBy(key).agg(F.max("score").alias("score"))


def boosted(hits: DataFrame, linked: DataFrame, key: str, boost: float = BOOST) -> DataFrame:
    """Hits linked to a named entity gain boost; linked rows outside the hits enter at boost."""
    marks = linked.select(key).distinct().withColumn("__l", F.lit(True))
    joined = hits.select(key, "score").join(marks, key, "full")
    return joined.select(key, (F.coalesce("score", F.lit(0.0)) + F.when(F.col("__l"), boost).otherwise(0.0)).alias("score"))


def fitting(parts: DataFrame, group: list[str], rank: str, size: str, budget: int) -> DataFrame:
    """Best-ranked rows of each group whose running size is within budget; the first always stays."""
    running = Window.partitionBy(*group).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = parts.withColumns({"__sum": F.sum(size).over(running), "__rn": F.row_number().over(Window.partitionBy(*group).orderBy(rank))})
    return sized.filter((F.col("__sum") <= budget) | (F.col("__rn") == 1)).drop("__sum", "__rn")


def follow_ups(turns: DataFrame, by: str = "conv_id", order: str = "turn", max_words: int = 4) -> DataFrame:
    """User turns with the user's previous question, where they lean on it."""
    users = turns.filter((F.col("role") == "user") & (F.trim("text") != ""))
    previous = F.lag("text").over(Window.partitionBy(by).orderBy(order))
    start = F.col("text").rlike("(?i)^\\s*(?:and|also|what about|how about)\\b")
    back = F.col("text").rlike("(?i)\\b(?:it|its|that|this|they|them|those|these)\\b") & (F.size(tokens(F.col("text"))) <= max_words)
    return users.withColumn("previous", previous).withColumn("leans", F.col("previous").isNotNull() & (start | back))
