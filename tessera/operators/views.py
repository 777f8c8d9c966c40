"""Read views: lookups, status views, queues, counters and orderings over the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def looked_up(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of a list of keys in the list's order (position), each key once."""
    first = wanted.groupBy(key).agg(F.min("position").alias("position"))
    return rows.join(first, key)


def by_status(rows: DataFrame, status: str | None = None, column: str = "status") -> DataFrame:
    return rows if status is None else rows.filter(F.col(column) == status)


def signed(documents: DataFrame) -> DataFrame:
    """Live documents with a valid issuer signature."""
    return documents.filter(F.col("removed_at").isNull() & (F.col("signature_status") == "issuer_signed"))


def of_owner(documents: DataFrame) -> DataFrame:
    """Signed documents whose holder is unknown or verified."""
    return documents.filter((F.col("signature_status") == "issuer_signed") & F.coalesce(F.col("holder_status") == "verified", F.lit(True)))


def not_of_owner(documents: DataFrame) -> DataFrame:
    return documents.filter((F.col("signature_status") == "issuer_signed") & (F.col("holder_status") != "verified"))


def with_partner(requests: DataFrame, requesters: DataFrame, key: str) -> DataFrame:
    """Requests with name and status of who asks; unknown ones stay."""
    return requests.join(requesters, key, "left")


def existing_evidence(edges: DataFrame, chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges at one of the nodes whose source chunk still exists, each once."""
    ends = nodes.select(F.col("id").alias("__id")).distinct()
    near = edges.join(ends, edges["src"] == ends["__id"], "left_semi").union(edges.join(ends, edges["dst"] == ends["__id"], "left_semi"))
    return near.distinct().join(chunks.select("source_id"), "source_id", "left_semi")  # a semi-join needs no distinct chunks


def first_by(rows: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__r") <= n).drop("__r")


def tail(log: DataFrame, n: int, most: int = 5000) -> DataFrame:
    """The newest entries, most of them at most."""
    return log.orderBy(F.desc("seq")).limit(max(0, min(n, most)))


def last_learned(facts: DataFrame, by: list[str]) -> DataFrame:
    return facts.groupBy(*by).agg(F.max("learned").alias("last_learned"))


def ordered_fields(groups: DataFrame) -> DataFrame:
    """Rank of field groups: scheduled ones first, then the last learned, then by name."""
    order = [F.desc("scheduled"), F.desc("last_learned"), F.asc("field")]
    return groups.withColumn("rank", F.row_number().over(Window.partitionBy("entity_id").orderBy(*order)))


def merged_events(events: DataFrame, by: list[str], key: list[str], most: int = 12) -> DataFrame:
    """Newest first, each key once, most of them for each reader."""
    once = first_by(events, [*by, *key], [F.desc("seq")])
    return first_by(once, by, [F.desc("seq")], most)


def ingest_counters(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Per document how many rows of each kind it added; kinds in one aggregate."""
    union = None
    for kind, rows in parts.items():
        some = rows.select(key, F.lit(kind).alias("kind"))
        union = some if union is None else union.unionByName(some)
    return union.groupBy(key).agg(*[F.count_if(F.col("kind") == kind).alias(f"{kind}_added") for kind in parts])


def owned_versions(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Versions but those of signed documents of another holder; hidden counts these by key."""
    bad = documents.filter((F.col("signature_status") == "issuer_signed") & F.col("holder_status").isin("mismatch", "unknown")).select("doc_id")
    marked = versions.join(bad.withColumn("__bad", F.lit(True)), "doc_id", "left")
    return marked.groupBy("entity_id", "field").agg(F.count_if(F.col("__bad").isNull()).alias("shown"), F.count_if(F.col("__bad").isNotNull()).alias("hidden"))


def queue(requesters: DataFrame, requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """What waits for the owner: all requesters, open requests, planned tasks; tagged by kind."""
    return (
        requesters.select(F.lit("requester").alias("kind"), "id", "status")
        .unionByName(requests.filter("status <> 'done'").select(F.lit("request").alias("kind"), "id", "status"))
        .unionByName(tasks.filter("status = 'planned'").select(F.lit("task").alias("kind"), "id", "status"))
    )


def paired(requesters: DataFrame, decisions: DataFrame) -> DataFrame:
    """Requesters with the status of their last decision: paired or blocked; pending without one."""
    last = decisions.groupBy("id").agg(F.max_by("accept", "seq").alias("accept"))
    joined = requesters.join(last, "id", "left")
    return joined.withColumn("status", F.when(F.col("accept").isNull(), "pending").when(F.col("accept"), "paired").otherwise("blocked")).drop("accept")


def rejected_as_audit(requests: DataFrame) -> DataFrame:
    """Every rejection as an audit entry: event, ref, details in canonical form."""
    detail = F.concat(F.lit('{"reason":"'), F.col("reason"), F.lit('"}'))
    return requests.filter(F.col("reason").isNotNull()).select("seq", F.lit("ask_rejected").alias("event"), F.col("requester").alias("ref"), detail.alias("detail_json"))


#: Status codes of reject reasons; unknown and replayed ids share one, so that ids can't be probed.
REJECT_STATUS = {"too_long": 400, "stale_ts": 400, "blocked": 403, "pending_pairing": 403, "unknown": 404, "replay": 404}


def reject_status(reason: Column) -> Column:
    table = F.create_map(*[F.lit(x) for item in REJECT_STATUS.items() for x in item])
    return F.coalesce(F.try_element_at(table, reason), F.lit(400))


def channel(loopback: Column, header: Column) -> Column:
    return F.when(loopback & (header == "mcp"), "mcp").otherwise("direct")


def anchor(rows: DataFrame) -> DataFrame:
    """The identity that counts for each owner: that of the e-KYC file, else of a signed card, else the
    configured one; newest of a source; the name only as initials."""
    rank = F.when(F.col("source") == "ekyc", 0).when(F.col("source") == "signed_id", 1).otherwise(2)
    best = first_by(rows.filter("removed_at is null").withColumn("__rank", rank), ["owner"], [F.col("__rank"), F.desc("seq")])
    return best.drop("__rank")


def recompute_holders(documents: DataFrame, anchors: DataFrame) -> DataFrame:
    """Holder status of every signed document against the present anchor; others have none."""
    joined = documents.join(anchors.select("owner", F.col("name_key").alias("__name")), "owner", "left")
    status = F.when(F.col("__name").isNull(), "unknown").when(F.col("name_key") == F.col("__name"), "verified").otherwise("mismatch")
    return joined.withColumn("holder_status", F.when(F.col("signature_status") == "issuer_signed", status)).drop("__name")


def pinned_key(answers: DataFrame) -> DataFrame:
    """Trust on first use: the first key of a partner counts, answers with another one don't."""
    first = answers.groupBy("partner").agg(F.min_by("key", "seq").alias("pinned"))
    return answers.join(first, "partner").withColumn("trusted", F.col("key") == F.col("pinned"))
