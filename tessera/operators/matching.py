"""Which entities a question means: names written out, then names that are near in meaning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import flat

# fixed values
LEAST_COSINE, MOST_MEANT, LEAST_CHARS = 0.72, 3, 3
#: Vectors of one block; a task holds one block of questions, one of names and SLICE names' scores.
BLOCK, SLICE = 8192, 1024
#: Decimals to which two cosines are told apart, so that equal vectors tie on every machine.
DIGITS = 9


def missing_names(entities: DataFrame, stored: DataFrame) -> DataFrame:
    """Keys of entities that have no stored vector, each once: what is left to embed."""
    return entities.select("key").filter("key is not null").distinct().join(stored.select("key"), "key", "left_anti")


def aliases(entities: DataFrame) -> DataFrame:
    """id, seq, alias: an entity's key and a person's first name, if they are long enough to be searched as words."""
    first = F.when((F.col("type") == "PERSON") & F.col("key").contains(" "), F.substring_index("key", " ", 1))
    names = entities.select("id", "seq", F.explode(F.array_distinct(F.array_compact(F.array("key", first)))).alias("alias"))
    return names.filter(F.length("alias") >= LEAST_CHARS)


def runs_of_words(text: Column, sizes: list[int]) -> Column:
    """All runs of so many words of a flat text, each once."""
    words = F.split(text, " ")

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - n + 1)
        return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " ")))

    runs = [of(n) for n in sizes]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*runs))))


def written_out(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """question_id, id, seq and the length of the longest alias that the question's words hold.

    The question's runs of words meet the aliases by equality, so a pair is made only where there is a match; the
    lengths of runs are those that aliases have (numbers of words, a handful)."""
    named = aliases(entities)
    sizes = sorted(r[0] for r in named.select(F.size(F.split("alias", " "))).distinct().collect())
    if not sizes:
        return questions.select("question_id").join(named.select("id", "seq", F.length("alias").alias("length")), F.lit(False))
    runs = questions.select("question_id", F.explode(runs_of_words(flat(F.col("text")), sizes)).alias("alias"))
    return runs.join(named, "alias").groupBy("question_id", "id", "seq").agg(F.max(F.length("alias")).alias("length"))


def blocks(rows: DataFrame, key: str) -> tuple[DataFrame, int]:
    n = max(1, -(-rows.count() // BLOCK))
    return rows.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n


def unit(vectors: pd.Series) -> np.ndarray:
    rows = np.array(vectors.tolist(), float)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has a finite length over 0."""
    squares = F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return rows.filter(F.col(vector).isNotNull() & (squares > 0) & (squares < float("inf")))


def meant(questions: DataFrame, names: DataFrame, least: float = LEAST_COSINE, most: int = MOST_MEANT) -> DataFrame:
    """question_id, id, seq, cos: for questions (question_id, vector, found) the names (id, seq, vector) with the
    largest cosines, none under least, without the ids in found; the lower seq on a tie.

    A blocked join: each block of names meets each block of questions in one task, which keeps the best of a
    question while it goes through the names slice by slice; then the best of all blocks.  Exact."""
    left, n_left = blocks(usable(questions, "vector"), "question_id")
    right, n_right = blocks(usable(names, "vector"), "id")

    def to_all(others: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("__other")

    left = left.select("question_id", "vector", "found", "__block", to_all(n_right)).withColumn("cell", F.col("__block") * n_right + F.col("__other"))
    right = right.select("id", "seq", "vector", "__block", to_all(n_left)).withColumn("cell", F.col("__other") * n_right + F.col("__block"))

    def best(asked: pd.DataFrame, named: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(named):
            named = named.sort_values("seq", kind="stable").reset_index(drop=True)
            q = unit(asked["vector"])
            place = {i: k for k, i in enumerate(named["id"])}
            known = [np.array([place[i] for i in found if i in place], int) for found in asked["found"]]
            score, who = np.full((len(q), 0), -2.0), np.zeros((len(q), 0), int)
            for lo in range(0, len(named), SLICE):
                part = unit(named["vector"][lo : lo + SLICE])
                new = np.round(q @ part.T, DIGITS)
                for row, own in zip(new, known):
                    row[own[(own >= lo) & (own < lo + len(part))] - lo] = -2.0
                score, who = np.hstack([score, new]), np.hstack([who, np.broadcast_to(np.arange(lo, lo + len(part)), new.shape)])
                keep = np.argsort(-score, axis=1, kind="stable")[:, :most]  # names are in order of seq, so ties are too
                score, who = np.take_along_axis(score, keep, 1), np.take_along_axis(who, keep, 1)
            rows, cols = np.nonzero(score >= least)
            at = who[rows, cols]
            out.append(pd.DataFrame({"question_id": asked["question_id"].to_numpy()[rows], "id": named["id"].to_numpy()[at], "seq": named["seq"].to_numpy()[at], "cos": score[rows, cols]}))
        return out[0] if out else pd.DataFrame({c: [] for c in ("question_id", "id", "seq", "cos")})

    kinds = {f.name: f.dataType.simpleString() for f in [*questions.schema, *names.schema]}
    schema = f"question_id {kinds['question_id']}, id {kinds['id']}, seq long, cos double"
    found = left.drop("__block", "__other").groupBy("cell").cogroup(right.drop("__block", "__other").groupBy("cell")).applyInPandas(best, schema)
    order = Window.partitionBy("question_id").orderBy(F.desc("cos"), "seq")
    return found.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= most).drop("__r")


def entities_in(questions: DataFrame, entities: DataFrame, vectors: DataFrame) -> DataFrame:
    """question_id, id, rank: entities (id, seq, type, key) that questions (question_id, text, vector) name, the
    longest alias first, then the older; after them those that are near in meaning, best first.

    vectors: key and vector, one row a key.  A blank question and a null one name nothing."""
    asked = questions.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    written = written_out(asked, entities)
    ids = written.groupBy("question_id").agg(F.collect_set("id").alias("found"))
    kind = entities.schema["id"].dataType.simpleString()
    left = asked.select("question_id", "vector").join(ids, "question_id", "left").withColumn("found", F.coalesce("found", F.array().cast(f"array<{kind}>")))
    near = meant(left, entities.select("id", "seq", "key").join(vectors.select("key", "vector"), "key").drop("key"))
    both = written.select("question_id", "id", F.lit(0).alias("__how"), (-F.col("length")).cast("double").alias("__by"), "seq").unionByName(
        near.select("question_id", "id", F.lit(1).alias("__how"), (-F.col("cos")).alias("__by"), "seq")
    )
    order = Window.partitionBy("question_id").orderBy("__how", "__by", "seq")
    return both.withColumn("rank", F.row_number().over(order)).select("question_id", "id", "rank")
