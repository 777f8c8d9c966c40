"""Quality rules: base counts of every text, then robust multivariate outliers.

Everything is DataFrame functions.  Per language and source the minimum-covariance-determinant
estimate of location and scatter is found by concentration steps from several starts: medians with
MADs, and SUBSETS elemental sets of DIMS + 1 rows chosen by hash.  Each step bins the rows by their
distance, sums moments by group, start and bin (pre-aggregated before the shuffle), keeps the nearest
half of the group (of the bin at the edge a part, by weight) and takes mean and covariance of those.
After FIRST_STEPS the start of least determinant stays in each group and is concentrated until no
determinant falls any more.  Rows whose Mahalanobis distance passes a chi-square limit are rejected.

Sums are of integers (statistics in 1/1024), so results don't depend on the order of rows.

Defined cases: a null text has no words and so fails the base rules; null languages and sources
are groups of their own; groups of fewer than MIN_GROUP rows are pooled by language, then all
together; repeated rows and ties get equal verdicts; an empty table gives an empty table; further
columns are kept, clashing ones are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_PATTERN, are_few, cut, join_group_values, written

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "[#*$%&|<>]+"
MIN_GROUP = 30
#: Chi-square limit with 4 degrees of freedom for a tail of 1e-5.
LIMIT = 28.47
#: Elemental starts, steps of every start, most steps of the best one (it stops when no determinant falls).
SUBSETS, FIRST_STEPS, MOST_STEPS = 3, 2, 12
#: Partitions of the stored estimates where groups are few.
PARTS = 8
SCALE = 1024
#: Least standard deviation of each transformed statistic: without it the many texts that have no
#: symbol at all would make one symbol an outlier.
FLOORS = (0.04, 0.25, 0.25, 0.1)
DIMS = len(FLOORS)
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs at least twice; hashes are those of all windows."""

    def covered(ordered: Column) -> Column:
        def twice(j: Column) -> Column:
            own = F.get(ordered, j)["h"]
            return F.coalesce(own == F.get(ordered, j - 1)["h"], F.lit(False)) | F.coalesce(own == F.get(ordered, j + 1)["h"], F.lit(False))

        places = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), twice), lambda j: F.get(ordered, j)["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(places, start, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")))["n"]

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(ordered, covered))


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the five counts and base_failed; texts are read once and whole."""
    kept = [F.col(c) for c in docs.columns if c not in [*STATS, "base_failed"]]
    split = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    split = split.select(*kept, "__t", F.array_remove(F.split("__t", SPACE_PATTERN), "").alias("__w"))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    last = F.size("__w") - WINDOW + 1
    windows = F.when(last > 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("__w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    counted = split.select(
        *kept,
        F.size("__w").cast("long").alias("n_words"),
        F.aggregate("__w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.length("__t") - F.length(F.regexp_replace("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        let(windows, repeated_words).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def transformed() -> list[Column]:
    """The statistic vector in integers of 1/SCALE: word length (smoothed by 40 words of 5 letters),
    symbols, repeated lines and repeated windows for each word."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    vector = [
        F.log((F.col("word_chars") + 200) / (n + 40)),
        F.log1p(20 * F.col("n_symbols") / n),
        F.log1p(20 * F.col("n_dup_lines") / n),
        F.col("n_repeat_words") / n,
    ]
    return [F.round(v * SCALE).cast("long").alias(f"__y{i}") for i, v in enumerate(vector)]


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def median_start(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: medians and a diagonal inverse scatter from the MADs."""
    ys = [f"__y{i}" for i in range(DIMS)]
    # exact percentiles hold one counter for each value; values are integers of a small range
    medians = cut(rows.groupBy(*keys).agg(*[F.percentile(y, 0.5).alias(f"__m{i}") for i, y in enumerate(ys)]))
    spread = join_group_values(rows, medians, keys, F.col("__id"))
    mads = spread.groupBy(*keys).agg(
        *[F.first(f"__m{i}").alias(f"__m{i}") for i in range(DIMS)],
        *[F.percentile(F.abs(F.col(y) - F.col(f"__m{i}")), 0.5).alias(f"__d{i}") for i, y in enumerate(ys)],
    )
    sds = [F.greatest(1.4826 * F.col(f"__d{i}"), F.lit(FLOORS[i] * SCALE)) for i in range(DIMS)]
    inverse = [(1 / (sds[i] * sds[i]) if i == j else F.lit(0.0)).alias(f"__v{i}{j}") for i in range(DIMS) for j in range(i + 1)]
    return cut(mads.select(*keys, *[f"__m{i}" for i in range(DIMS)], *inverse))


def distance() -> Column:
    """Squared Mahalanobis distance of a row joined to its group's estimate."""
    gap = [F.col(f"__y{i}") - F.col(f"__m{i}") for i in range(DIMS)]
    return total([F.col(f"__v{i}{j}") * gap[i] * gap[j] * (1 if i == j else 2) for i in range(DIMS) for j in range(i + 1)])


def consistency() -> float:
    """Factor for the covariance of the nearest half of a normal sample in 4 dimensions."""
    half = 3.3566939800333215  # median of chi-square with 4 degrees of freedom
    x = half / 2
    return 0.5 / (1 - math.exp(-x) * (1 + x + x * x / 2))


def inverted(means: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, inverse covariance and log determinant (__det) from __n, __s* and __q* by Cholesky factors."""
    n = F.col("__n").cast("double")
    c, keep = consistency(), [*keys, *[f"__m{i}" for i in range(DIMS)]]
    out = means.withColumns({f"__m{i}": F.col(f"__s{i}") / n for i in range(DIMS)})
    out = out.select(
        *keep,
        *[(c * (F.col(f"__q{i}{j}") / n - F.col(f"__m{i}") * F.col(f"__m{j}")) + (FLOORS[i] * SCALE) ** 2 * (i == j)).alias(f"__c{i}{j}") for i in range(DIMS) for j in range(i + 1)],
    )
    for j in range(DIMS):  # column j of the factor
        square = F.col(f"__c{j}{j}") - total([F.lit(0.0), *[F.col(f"__l{j}{k}") ** 2 for k in range(j)]])
        out = out.withColumn(f"__l{j}{j}", F.sqrt(F.greatest(square, F.lit((FLOORS[j] * SCALE) ** 2))))
        for i in range(j + 1, DIMS):
            rest = F.col(f"__c{i}{j}") - total([F.lit(0.0), *[F.col(f"__l{i}{k}") * F.col(f"__l{j}{k}") for k in range(j)]])
            out = out.withColumn(f"__l{i}{j}", rest / F.col(f"__l{j}{j}"))
    for j in range(DIMS):  # inverse of the factor
        out = out.withColumn(f"__i{j}{j}", 1 / F.col(f"__l{j}{j}"))
        for i in range(j + 1, DIMS):
            out = out.withColumn(f"__i{i}{j}", -total([F.col(f"__l{i}{k}") * F.col(f"__i{k}{j}") for k in range(j, i)]) / F.col(f"__l{i}{i}"))
    inverse = [total([F.col(f"__i{k}{i}") * F.col(f"__i{k}{j}") for k in range(i, DIMS)]).alias(f"__v{i}{j}") for i in range(DIMS) for j in range(i + 1)]
    det = total([2 * F.log(F.col(f"__l{j}{j}")) for j in range(DIMS)]).alias("__det")
    return out.select(*keep, *inverse, det)


def moments(weight: Column | None = None) -> dict[str, Column]:
    """Sums of a group: __n, __s* and __q*; of rows, or of weighted sums of the same names."""
    ys = [F.col(f"__y{i}") for i in range(DIMS)]
    if weight is None:
        parts = {"__n": F.lit(1)} | {f"__s{i}": ys[i] for i in range(DIMS)} | {f"__q{i}{j}": ys[i] * ys[j] for i in range(DIMS) for j in range(i + 1)}
    else:
        parts = {k: F.col(k) * weight for k in ["__n", *[f"__s{i}" for i in range(DIMS)], *[f"__q{i}{j}" for i in range(DIMS) for j in range(i + 1)]]}
    return {k: F.sum(v) for k, v in parts.items()}


def elemental_starts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and start 1 .. SUBSETS: the estimate of the DIMS + 1 distinct vectors with the least
    hashes; copies of a vector count once here, and a group with fewer vectors has no such start."""
    rows = rows.select(*keys, *[f"__y{i}" for i in range(DIMS)]).distinct().withColumn("__id", F.xxhash64(*[f"__y{i}" for i in range(DIMS)]))
    sizes = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")))
    some = join_group_values(rows, sizes, keys, F.col("__id"))
    starts = F.array(*[F.struct(F.lit(k).alias("__start"), F.xxhash64("__id", F.lit(k)).alias("__hash")) for k in range(1, SUBSETS + 1)])
    hashed = some.select(*keys, "__id", "__size", *[f"__y{i}" for i in range(DIMS)], F.inline(starts))
    share = F.pmod("__hash", F.lit(1 << 40)) / float(1 << 40)
    few = hashed.filter(share * F.col("__size") < 8 * (DIMS + 1))  # a few rows of a group, whatever its size
    order = Window.partitionBy(*keys, "__start").orderBy("__hash", *[f"__y{i}" for i in range(DIMS)])
    chosen = few.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= DIMS + 1)
    sums = chosen.groupBy(*keys, "__start").agg(*[v.alias(k) for k, v in moments().items()])
    return inverted(sums.filter(F.col("__n") == DIMS + 1), [*keys, "__start"])


def stored(estimate: DataFrame, few: bool) -> DataFrame:
    """A stored estimate; of few groups in few partitions, which every later step reads again."""
    return cut(estimate.coalesce(PARTS) if few else estimate)


def concentrate(rows: DataFrame, estimate: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """One concentration step of every group and start: the estimate of the rows nearest to the last one,
    whose determinant comes along as __was."""
    each = [*keys, "__start", "__was"]
    last = estimate.withColumnRenamed("__det", "__was")
    near = join_group_values(rows, last, keys, F.col("__id"), few).filter("__start is not null")
    near = near.withColumn("__bin", F.floor(64 * F.log1p(distance())).cast("int"))
    binned = near.groupBy(*each, "__bin").agg(*[v.alias(k) for k, v in moments().items()])
    by = Window.partitionBy(*each)
    upto = by.orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = binned.withColumns({"__upto": F.sum("__n").over(upto), "__all": F.sum("__n").over(by)})
    half = F.floor((F.col("__all") + DIMS + 2) / 2)
    weight = F.least(F.lit(1.0), (half - (F.col("__upto") - F.col("__n"))) / F.col("__n"))
    kept = ranked.withColumn("__weight", weight).filter("__weight > 0").groupBy(*each).agg(*[v.alias(k) for k, v in moments(F.col("__weight")).items()])
    return stored(inverted(kept, each), few)


def least_determinant(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The estimate of every group: the best of all starts, concentrated until no determinant falls."""
    begun = elemental_starts(rows, keys)
    columns = begun.columns
    estimate = median_start(rows, keys).withColumns({"__start": F.lit(0), "__det": F.lit(None).cast("double")}).select(*columns).union(begun)
    few = are_few(rows.select(*keys).distinct())
    estimate = stored(estimate, few)
    for _ in range(FIRST_STEPS):
        estimate = concentrate(rows, estimate, keys, few).select(*columns)
    best = F.min(F.struct("__det", "__start", *[c for c in columns if c not in (*keys, "__det", "__start")])).alias("__best")
    estimate = stored(estimate.groupBy(*keys).agg(best).select(*keys, "__best.*").select(*columns), few)
    for _ in range(MOST_STEPS):
        new = concentrate(rows, estimate, keys, few)
        estimate = new.select(*columns)
        if new.filter(F.col("__det") < F.col("__was") - 1e-9).isEmpty():
            break
    return estimate.drop("__start", "__det")


def grouped(rows: DataFrame, by: list[str]) -> DataFrame:
    """Add __g0, __g1 ...: the group of a row, small groups pooled by the first key, then all together."""
    keys = [f"__g{i}" for i in range(len(by))]
    named = rows.withColumns({k: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for k, c in zip(keys, by)})
    for level in range(len(keys) - 1, -1, -1):  # MIN_GROUP is a parameter of the method: a covariance of fewer rows says little
        sizes = cut(named.filter(~F.col("base_failed")).groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")))
        small = F.coalesce(F.col("__size"), F.lit(0)) < MIN_GROUP
        pool = F.lit("pool")
        named = join_group_values(named, sizes, keys, F.col("__id")).withColumns({k: F.when(small, pool).otherwise(F.col(k)) for k in keys[level:]}).drop("__size")
    return named


def judged(counted: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Add kept (and distance2) to rows that hold the base statistics; counted is read several times
    and must be stored."""
    keys = [f"__g{i}" for i in range(len(by))]
    extra = [c for c in counted.columns if c not in ("kept", "distance2")]
    # equal rows get equal groups and verdicts, so the row's own hash is enough of an id
    vectors = counted.select(*extra, *transformed(), F.xxhash64(*[F.col(c) for c in STATS], *by).alias("__id"))
    if counted.limit(1).count() == 0:
        return counted.select(*extra, F.lit(None).cast("double").alias("distance2"), F.lit(False).alias("kept"))
    narrow = grouped(counted.select(*by, "base_failed", *transformed(), F.xxhash64(*[F.col(c) for c in STATS], *by).alias("__id")), list(by))
    fit = cut(narrow.filter(~F.col("base_failed")).select(*keys, "__id", *[f"__y{i}" for i in range(DIMS)]))
    estimate = least_determinant(fit, keys)
    found = join_group_values(grouped(vectors, list(by)), estimate, keys, F.col("__id"))
    found = found.withColumn("distance2", F.when(~F.col("base_failed"), distance()))
    return found.select(*extra, "distance2", (~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= LIMIT)).alias("kept"))


def quality_rules(docs: DataFrame, text: str = "text", by: tuple[str, ...] = ("lang", "source"), keep_text: bool = True) -> DataFrame:
    """All columns of docs (without the text if keep_text is false), the counts, base_failed,
    distance2 and kept.  Counts are stored once in the shared folder."""
    counted = base_statistics(docs, text)
    if not keep_text:
        counted = counted.drop(text)
    return judged(written(counted, "quality"), by)
