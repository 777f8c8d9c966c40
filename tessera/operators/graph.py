"""Entity graph as two DataFrames: nodes (id, type, name) and edges (edge_id, src, rel, dst, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import name_key, name_rank
from tessera.sources.shared import kept

# fixed values: domain and range of each relation, None for any type
NOT_PERSON = ["PROJECT", "CONCEPT", "DECISION", "ORG", "PLACE", "DOCUMENT", "OBLIGATION", "EVENT"]
RELATIONS = {
    "LANDLORD_OF": (["PERSON"], ["PERSON"]),
    "EMPLOYED_BY": (["PERSON"], ["ORG"]),
    "STUDIED_AT": (["PERSON"], ["ORG"]),
    "BANKS_WITH": (["PERSON"], ["ORG"]),
    "WORKS_ON": (["PERSON"], ["PROJECT"]),
    "DECIDED": (["PERSON"], ["DECISION"]),
    "PART_OF": ([t for t in NOT_PERSON if t != "ORG"], ["PROJECT", "CONCEPT"]),
    "ABOUT": (["DECISION", "DOCUMENT", "EVENT", "CONCEPT", "OBLIGATION"], None),
    "PAID": (["PERSON", "ORG"], ["PERSON", "ORG", "OBLIGATION"]),
    "DUE_ON": (["OBLIGATION", "DOCUMENT"], ["EVENT"]),
    "PARTY_TO": (["PERSON", "ORG"], ["DOCUMENT", "OBLIGATION"]),
    "RELATES_TO": (None, None),
    "MENTIONED_IN": (None, ["DOCUMENT"]),
}


def relation_allowed(rel, src_type, dst_type):
    """Do the types of an edge's ends fit its relation (unknown relations fit any)?"""
    out = F.lit(True)
    for name, (domain, range_) in RELATIONS.items():
        ok = (src_type.isin(domain) if domain else F.lit(True)) & (dst_type.isin(range_) if range_ else F.lit(True))
        out = F.when(rel == name, F.coalesce(ok, F.lit(False))).otherwise(out)
    return out


def neighbourhood(edges: DataFrame, start: list[str], hops: int) -> DataFrame:
    """id and hop of all nodes within hops of the start, edges taken both ways.  A hop joins the edges with the last
    frontier only, leaves out what was seen, and stores the new frontier, so that no hop is planned again."""
    seen = edges.sparkSession.createDataFrame([(s, 0) for s in start], "id string, hop int")
    frontier = seen
    for hop in range(1, hops + 1):
        ends = frontier.select("id")
        out = edges.join(ends, edges["src"] == ends["id"], "left_semi").select(F.col("dst").alias("id"))
        back = edges.join(ends, edges["dst"] == ends["id"], "left_semi").select(F.col("src").alias("id"))
        reached = out.union(back).distinct().join(seen, "id", "left_anti")
        frontier = kept(reached.withColumn("hop", F.lit(hop)))
        seen = seen.union(frontier)
    return seen


def grouped_edges(edges: DataFrame) -> DataFrame:
    """One row for each (src, rel, dst): edges, distinct sources, closed only if all are."""
    return edges.groupBy("src", "rel", "dst").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("source_id").alias("n_sources"), F.every(F.col("closed")).alias("closed"))


def degrees(groups: DataFrame) -> DataFrame:
    """Current edge groups at each node; a loop counts twice."""
    live = groups.filter("not closed")
    return live.select(F.col("src").alias("id")).union(live.select("dst")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def unlinked(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    live = groups.filter("not closed")
    ends = live.select(F.col("src").alias("id")).union(live.select("dst"))
    return nodes.join(ends, "id", "left_anti")


def neighbours(groups: DataFrame, node: str) -> DataFrame:
    """rel, id of the far end, outgoing, of the current groups at one node."""
    live = groups.filter("not closed")
    out = live.filter(F.col("src") == node).select("rel", F.col("dst").alias("id"), F.lit(True).alias("outgoing"))
    return out.union(live.filter((F.col("dst") == node) & (F.col("src") != node)).select("rel", F.col("src"), F.lit(False)))


def touched(edges: DataFrame) -> DataFrame:
    """source_id and the distinct nodes at its edges."""
    return edges.select("source_id", F.explode(F.array("src", "dst")).alias("id")).distinct()


def resolved(mentions: DataFrame) -> DataFrame:
    """Mentions (seq, type, name) as entities: one for each key, documents apart; the first type wins, the
    best spelling is shown, mentions are counted."""
    keyed = mentions.withColumns({"key": name_key(F.col("name")), "is_document": F.col("type") == "DOCUMENT"})
    best = F.struct(name_rank(F.col("name")).alias("r"), (-F.col("seq")).alias("s"))
    return keyed.groupBy("key", "is_document").agg(
        F.min_by("type", "seq").alias("type"), F.max_by("name", best).alias("name"), F.count(F.lit(1)).alias("n_mentions"), F.min("seq").alias("first_seq")
    )


def first_name_merges(people: DataFrame) -> DataFrame:
    """one_id to full_id: a person known by one word is the only person whose full name starts with it."""
    full = people.filter(F.col("key").contains(" ")).withColumn("first", F.substring_index("key", " ", 1))
    only = full.groupBy("first").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("full_id")).filter("n = 1")
    single = people.filter(~F.col("key").contains(" ")).select(F.col("id").alias("one_id"), F.col("key").alias("first"))
    return single.join(only, "first").select("one_id", "full_id")


def repointed(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges with merged ids replaced; an edge that becomes a loop is closed."""
    out = edges
    for end in ("src", "dst"):
        ids = merges.select(F.col("one_id").alias("__one"), F.col("full_id").alias("__full"))
        out = out.join(ids, out[end] == ids["__one"], "left").withColumn(end, F.coalesce("__full", end)).drop("__one", "__full")
    return out.withColumn("closed", F.col("closed") | (F.col("src") == F.col("dst")))
