"""Line dedup by levelled sorted runs of line hashes.

A run is a bucketed table, sorted by the 128-bit hash of a line's key, with the number of documents
that hold the key, the largest of them, and whether an older run has the key.  A batch of documents
adds a run: its keys, counted, are merge-joined to the runs there are; rows without a partner (the
anti-join) are new keys, the others repeat an older one.  When two runs have the same level they are
compacted into one of the next level by a merge.  Runs share their bucketing, so neither the
anti-join nor a compaction shuffles a run: only a batch's own keys move.  After the last batch a key
that no run repeats is judged by its own row; repeats are few and are summed first.

A key is a line stripped of ASCII white space at both ends, A-Z lower-cased.  Keys of at least LEAST
code points in at least DOCUMENTS documents lose all their lines but those of the largest doc_id.

Hot keys: a key is counted per task before each shuffle; where lines meet the crowded keys, keys with
over 1/HEAVY of all counted lines (fewer than HEAVY of them) are broadcast, the rest is shuffled.

Defined cases: a null or empty text is one empty line; rows of one doc_id are one document; a null
doc_id is below all others, and rows without an id are one document for each distinct text, ordered by
its hash; an empty table gives an empty table; columns named like a result are replaced by it, others
stay.  A very long text is one array of lines in one row; its dropped lines are found by position, so
the work is linear in its length.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import erase, shared_dir, written

LEAST = 20
DOCUMENTS = 3
BATCHES = 5
HEAVY = 5_000
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]


def split_lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def row_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def line_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, row, pos, h1, h2 of all lines whose key is long enough."""
    lines = docs.select("doc_id", row_hash(text).alias("row"), F.posexplode(split_lines(text)).alias("pos", "line"))
    stripped = lines.withColumn("line", F.btrim("line", F.lit(SPACES))).filter(F.length("line") >= LEAST)
    ascii_only = F.octet_length("line") == F.length("line")
    key = F.when(ascii_only, F.lower("line")).otherwise(F.translate("line", UPPER, LOWER))
    return stripped.select("doc_id", "row", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def counted(keys: DataFrame) -> DataFrame:
    """h1, h2, n (documents), top (largest doc_id), tie (largest hash of a text without id)."""
    tie = F.when(F.col("doc_id").isNull(), F.col("row"))
    single = keys.select(*HASH, "doc_id", tie.alias("tie")).distinct()
    return single.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"), F.max("tie").alias("tie"))


@dataclass
class LineRuns:
    """An index of line keys that grows by batches; its runs lie in one folder of the shared storage."""

    spark: SparkSession
    path: str = ""
    levels: list[tuple[int, str]] = field(default_factory=list)  # level and table of each run, oldest first

    def __post_init__(self) -> None:
        self.path = self.path or f"{shared_dir(self.spark)}/tessera-lineruns-{uuid.uuid4().hex}"
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def stored(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def dropped(self, *names: str) -> None:
        for name in names:
            run = self.spark.table(name)
            erase(run)
            self.spark.sql(f"DROP TABLE {name}")

    def add(self, keys: DataFrame) -> None:
        """Merge-anti-join a batch's keys with all runs and add its own run; compact runs of one level."""
        own = counted(keys)
        known = F.lit(False)
        for i, (_, name) in enumerate(self.levels):
            own = own.join(self.spark.table(name).select(*HASH, F.lit(True).alias(f"in{i}")).hint("merge"), HASH, "left")
            known = known | F.col(f"in{i}").isNotNull()
        self.levels.append((0, self.stored(own.select(*HASH, "n", "top", "tie", known.alias("known")))))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (level, old), (_, new) = self.levels[-2:]
            self.levels[-2:] = [(level + 1, self.stored(self.merged(old, new)))]
            self.dropped(old, new)

    def merged(self, old: str, new: str) -> DataFrame:
        """Two runs as one; a key that the newer repeats of the older is as new as it was in the older."""
        a, b = (self.spark.table(n).select(*HASH, *[F.col(c).alias(f"{c}{i}") for c in ("n", "top", "tie", "known")]) for i, n in enumerate((old, new)))
        both = a.join(b.hint("merge"), HASH, "full")
        n = F.coalesce(F.col("n0"), F.lit(0)) + F.coalesce(F.col("n1"), F.lit(0))
        largest = [F.greatest(f"{c}0", f"{c}1").alias(c) for c in ("top", "tie")]
        return both.select(*HASH, n.alias("n"), *largest, F.coalesce("known0", "known1").alias("known"))

    def crowded(self, documents: int = DOCUMENTS) -> DataFrame:
        """h1, h2, n, top, tie of the keys in at least so many documents."""
        runs = [self.spark.table(name) for _, name in self.levels]
        repeats, found = None, None
        for run in runs[1:]:
            rows = run.filter("known").select(*HASH, "n", "top", "tie")
            repeats = rows if repeats is None else repeats.unionByName(rows)
        if repeats is not None:
            repeats = repeats.groupBy(*HASH).agg(F.sum("n").alias("n2"), F.max("top").alias("top2"), F.max("tie").alias("tie2"))
        for run in runs:
            rows = run.filter("NOT known").select(*HASH, "n", "top", "tie")
            if repeats is not None:
                rows = rows.join(repeats.hint("merge"), HASH, "left")
                rows = rows.select(*HASH, (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), *[F.greatest(c, f"{c}2").alias(c) for c in ("top", "tie")])
            rows = rows.filter(F.col("n") >= documents)
            found = rows if found is None else found.unionByName(rows)
        return found

    def erase(self) -> None:
        self.dropped(*[name for _, name in self.levels])
        self.levels = []


def dropped_lines(keys: DataFrame, crowded: DataFrame) -> DataFrame:
    """doc_id, row and the positions of the lines to drop."""
    crowded = crowded.select(*HASH, "n", "top", "tie")
    total = crowded.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(crowded.filter(F.col("n") * HEAVY > total).drop("n"))
    light = crowded.filter(F.col("n") * HEAVY <= total).drop("n")
    rows = keys.select("doc_id", "row", "pos", *HASH)
    met = rows.join(heavy, HASH).unionByName(rows.join(heavy.select(*HASH), HASH, "left_anti").join(light, HASH))
    stays = F.when(F.col("top").isNotNull(), F.col("doc_id").eqNullSafe(F.col("top"))).otherwise(F.col("row") == F.col("tie"))
    gone = met.filter(~stays)
    return gone.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("__gone"))


def dedup_lines(docs: DataFrame, text: str = "text", batches: int = BATCHES) -> DataFrame:
    """docs with repeated lines taken out of the text, and n_lines (before), n_dropped."""
    spark = docs.sparkSession
    batch = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("row"))), F.lit(batches)).cast("int")
    keys = written(line_keys(docs, text).withColumn("batch", batch), "linekeys", "batch")
    runs = LineRuns(spark)
    for k in range(batches):
        runs.add(keys.filter(F.col("batch") == k))
    crowded = written(runs.crowded(), "crowded")
    runs.erase()
    gone = written(dropped_lines(keys, crowded), "droppedlines")
    erase(keys, crowded)
    gone = gone.select(F.col("doc_id").alias("__doc"), F.col("row").alias("__of"), "__gone")
    rows = docs.select(*[c for c in docs.columns if c not in (text, "n_lines", "n_dropped")], row_hash(text).alias("__row"), split_lines(text).alias("__lines"))
    joined = rows.join(gone, (F.col("__row") == F.col("__of")) & F.col("doc_id").eqNullSafe(F.col("__doc")), "left")
    n, lost = F.size("__lines").cast("long"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long")
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.coalesce("__gone", F.array().cast("array<int>")))
    left = F.array_join(F.transform(places, lambda i: F.get(F.col("__lines"), i)), "\n")
    kept = F.when(F.col("__gone").isNull(), F.array_join("__lines", "\n")).otherwise(left)
    named = {text: kept, "n_lines": n, "n_dropped": F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(lost).cast("long")}
    out = [c for c in docs.columns if c not in named or c == text]
    return joined.select(*[named.pop(c).alias(c) if c == text else F.col(c) for c in out], *[v.alias(k) for k, v in named.items()])
