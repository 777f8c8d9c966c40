"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in a shuffled order, and after them all once more (a document is
taken twice at most).  A copy's virtual finish time is the source's cumulative tokens up to and
with it, divided by the source's target; so all sources reach time 1 at their targets.  The copies
of all sources are ordered by that time and the mix is cut where its tokens reach the budget.

Cumulative sums are in two levels: by hash bucket of a source (or bin of virtual time), then within
one bucket, so no task sees a whole source.

Defined cases: a null text has size 0; a null source is a source, last in order; sources without a
word have target 0 and take nothing; documents of size 0 take nothing; equal documents are
interchangeable; an empty table gives an empty table; further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_PATTERN, cut, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BUCKETS = 4096
BINS = 16384


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_PATTERN), "")).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target: weights repeat over the sources by code point, null last; the
    share of all sizes is dealt by weight, no source gets over MOST times its size and what is over
    goes to the others by weight.  Source by source in order of the level at which each is full."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    full = F.col("weight") / (MOST * F.col("source_size"))  # the larger, the sooner it is full
    ranked = sums.withColumn("weight", weight)
    order = Window.orderBy(F.when(F.col("source_size") > 0, -full).otherwise(F.lit(float("-inf"))), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumns(
        {
            "__spent": F.coalesce(F.sum(F.col("source_size") * MOST).over(before), F.lit(0)),
            "__left": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
            "__all": F.sum("source_size").over(every),
        }
    )
    level = (SHARE * F.col("__all") - F.col("__spent")) / F.col("__left")
    # the level of the first source that isn't filled by it; up to there all are full
    open_ = ranked.withColumn("__level", F.when(level * F.col("weight") <= MOST * F.col("source_size"), level))
    first = F.first("__level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("weight") * F.coalesce(first, F.lit(float("inf"))), (MOST * F.col("source_size")).cast("double"))
    return open_.withColumn("target", target).select("source", "source_size", "target")


def mixed(sized: DataFrame) -> DataFrame:
    """sized (doc_id, source, size and more; stored) with source_size, target, first_finish,
    second_finish (virtual times of the two copies), copies (0 to 2) and taken."""
    keyed = sized.withColumns({"__key": F.xxhash64("doc_id", "size")}).withColumn("__bucket", F.shiftrightunsigned("__key", 52).cast("int"))
    keyed = keyed.withColumns({"__none": F.col("source").isNull(), "__name": F.coalesce(F.col("source"), F.lit(""))})
    goals = cut(targets(sized)).select(F.col("source").isNull().alias("__none"), F.coalesce(F.col("source"), F.lit("")).alias("__name"), "source_size", "target")
    sums = keyed.groupBy("__none", "__name", "__bucket").agg(F.sum("size").alias("__sum"))
    running = Window.partitionBy("__none", "__name").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.join(goals, ["__none", "__name"]).withColumn("__before", F.coalesce(F.sum("__sum").over(running), F.lit(0))).drop("__sum")
    placed = keyed.join(cut(offsets), ["__none", "__name", "__bucket"])
    inside = Window.partitionBy("__none", "__name", "__bucket").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    finish = F.col("__before") + F.sum("size").over(inside)
    timed = placed.withColumn("__finish", finish).withColumns(
        {
            "first_finish": F.when(F.col("target") > 0, F.col("__finish") / F.col("target")),
            "second_finish": F.when(F.col("target") > 0, (F.col("source_size") + F.col("__finish")) / F.col("target")),
        }
    )
    timed = written(timed.drop("__bucket", "__none", "__name", "__before", "__finish"), "mix")
    size, live = F.col("size"), timed.filter("size > 0 and target > 0")
    # both copies of a document lie in its row; for the cut they are told apart by bin of their time
    two = F.array(*[F.struct(F.lit(k).alias("copy"), F.col(c).alias("time")) for k, c in ((1, "first_finish"), (2, "second_finish"))])
    copies = live.select("__key", "doc_id", "size", F.inline(two)).withColumn("bin", F.least(F.floor(F.col("time") * BINS), F.lit(2 * BINS)).cast("int"))
    bins = copies.groupBy("bin").agg(F.sum("size").alias("sum"))
    upto = F.sum("sum").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    budget = int(SHARE * (sized.agg(F.sum("size")).first()[0] or 0))
    edge = bins.withColumn("upto", upto).filter(F.col("upto") > budget).orderBy("bin").first()
    if edge is None:  # all copies fit
        return marked(timed, F.lit(True), F.lit(True))
    order = Window.partitionBy("bin").orderBy("time", "__key", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = copies.filter(F.col("bin") == edge["bin"]).withColumn("upto", edge["upto"] - edge["sum"] + F.sum(size).over(order))
    last = inside.filter(F.col("upto") <= budget).agg(F.max(F.struct("time", "__key", "doc_id", "copy")).alias("last")).first()["last"]
    kinds = ("double", "long", timed.schema["doc_id"].dataType, "int")
    bound = F.struct(*[F.lit(v).cast(k) for v, k in zip(last or (edge["bin"] / BINS, -(1 << 63), None, 0), kinds)])
    taken = [F.struct(F.col(c), F.col("__key"), F.col("doc_id"), F.lit(k)) <= bound for k, c in ((1, "first_finish"), (2, "second_finish"))]
    return marked(timed, *taken)


def marked(timed: DataFrame, first: Column, second: Column) -> DataFrame:
    live = (F.col("size") > 0) & (F.col("target") > 0)
    copies = F.when(live, first.cast("int") + second.cast("int")).otherwise(F.lit(0))
    return timed.withColumn("copies", copies).withColumn("taken", (F.col("copies") * F.col("size")).cast("long")).drop("__key")


def mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, times, copies, taken."""
    sized = written(docs.select("doc_id", "source", word_count(F.col(text)).alias("size")), "sizes")
    return mixed(sized)


def mixed_documents(docs: DataFrame, text: str = "text", ordered: bool = True) -> DataFrame:
    """docs as the mix holds them: each row as often as its document is taken, in the order of the mix.

    Rows equal in doc_id, source and text are told apart by number only: each is a document of the mix,
    and what is taken of them is dealt to them evenly."""
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    keys = ["doc_id", "source", "__mark"]
    sized = docs.select("doc_id", "source", mark.alias("__mark"), word_count(F.col(text)).alias("size")).groupBy(*keys, "size").agg(F.count(F.lit(1)).alias("__n"))
    each = sized.withColumn("__each", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).drop("__each", "__n")
    taken = mixed(written(each, "sizes")).filter("copies > 0")
    sums = taken.groupBy(*keys).agg(F.sum("copies").alias("__copies"), F.min("first_finish").alias("__first"), F.min("second_finish").alias("__second"))
    counts = sized.filter("__n > 1").groupBy(*keys).agg(F.sum("__n").alias("__n"))
    names = {"doc_id": "__id", "source": "__of", "__mark": "__hash"}

    def renamed(rows: DataFrame) -> DataFrame:
        return rows.withColumnsRenamed(names)

    def same(right: str) -> Column:
        return (F.col("__mark") == F.col("__hash" + right)) & F.col("doc_id").eqNullSafe(F.col("__id" + right)) & F.col("source").eqNullSafe(F.col("__of" + right))

    sums = renamed(sums).join(renamed(counts).withColumnsRenamed({c: c + "2" for c in names.values()}), (F.col("__hash") == F.col("__hash2")) & F.col("__id").eqNullSafe(F.col("__id2")) & F.col("__of").eqNullSafe(F.col("__of2")), "left")
    sums = written(sums.select(*names.values(), "__copies", "__first", "__second", F.coalesce("__n", F.lit(1)).alias("__n")), "taken")
    joined = docs.withColumn("__mark", mark).join(sums, same(""))
    even = joined.filter("__copies % __n = 0").withColumn("__copy", F.expr("explode(sequence(1, int(__copies / __n)))"))
    # only rows equal to one at the cut are numbered
    place = F.row_number().over(Window.partitionBy("__id", "__of", "__hash").orderBy(F.lit(0)))
    own = F.expr("int(__copies div __n) + if(__place <= __copies % __n, 1, 0)")
    rest = joined.filter("__copies % __n <> 0").withColumn("__place", place).withColumn("__own", own).filter("__own > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__own"))))
    out = even.unionByName(rest.drop("__place", "__own"))
    if ordered:
        time = F.when(F.col("__copy") == 1, F.col("__first")).otherwise(F.col("__second"))
        out = out.withColumn("__time", time).repartitionByRange("__time", "__mark").sortWithinPartitions("__time", "__mark")
    return out.select(*docs.columns)
