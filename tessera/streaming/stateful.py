"""Structured Streaming forms: debounce, replay guard, freshness, sessions, the ledger and the fact fold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark, schema, path: str, pattern: str, per_trigger: int = 100) -> DataFrame:
    """New files of a folder whose names match, with path and time."""
    return spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).schema(schema).load(path)


def bursts(events: DataFrame, by: str, ts: str, quiet: str, late: str) -> DataFrame:
    """One row for each burst of a key: nothing follows within the quiet time."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(F.col(by), F.session_window("__ts", quiet)).agg(F.count(F.lit(1)).alias("n"), F.max("__ts").alias("last")).select(by, "n", "last")


def once(requests: DataFrame, ts: str, keys: list[str], window: str) -> DataFrame:
    """The first request of equal keys within the watermark."""
    return requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, window).dropDuplicatesWithinWatermark(keys)


def fresh_and_stale(requests: DataFrame, ts: str, arrived: str, seconds: int) -> tuple[DataFrame, DataFrame]:
    """Fresh requests, and the late ones as rows of their own: they are rejected, not dropped."""
    gap = F.abs(F.unix_micros(F.col(arrived).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp")))
    return requests.filter(gap <= seconds * 1_000_000), requests.filter(gap > seconds * 1_000_000).withColumn("reason", F.lit("stale_ts"))


def ledger_stream(questions: DataFrame, by: str, width: float, most: int = 3, days: int = 30) -> DataFrame:
    """The disclosure ledger over a stream of questions (by, seq, ts, threshold, answer): a key's state is
    its interval and what was attested in the last days."""
    kind = questions.schema[by].dataType.simpleString()
    out = f"{by} {kind}, seq long, allowed boolean"
    state_type = "lo double, hi double, thresholds array<double>, times array<long>"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lo, hi, seen, when = state.get if state.exists else (float("-inf"), float("inf"), [], [])
        told = list(zip(seen, when))
        rows = pd.concat(list(batches)).sort_values("seq")
        decided = []
        for seq, ts, t, yes in rows[["seq", "ts", "threshold", "answer"]].itertuples(index=False):
            now = int(pd.Timestamp(ts).value // 1000)
            low, high = (max(lo, t), hi) if yes else (lo, min(hi, t))
            told = [x for x in told if x[1] >= now - days * 86_400_000_000]
            recent = {x for x, _ in told}
            ok = bool(high - low >= width and (t in recent or len(recent) < most))
            if ok:
                lo, hi = low, high
                told.append((float(t), now))
            decided.append((key[0], seq, ok))
        state.update((lo, hi, [x for x, _ in told], [w for _, w in told]))
        yield pd.DataFrame(decided, columns=[by, "seq", "allowed"])

    return questions.select(by, "seq", "ts", "threshold", "answer").groupBy(by).applyInPandasWithState(run, out, state_type, "append", GroupStateTimeout.NoTimeout)


def version_stream(facts: DataFrame, by: str) -> DataFrame:
    """Latest value of a key over a stream of facts (by, seq, value): a row whenever it changes."""
    kind = facts.schema[by].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else None
        out = []
        for seq, new in pd.concat(list(batches)).sort_values("seq")[["seq", "value"]].itertuples(index=False):
            if new != value:
                out.append((key[0], seq, value, new))
                value = new
        state.update((value,))
        yield pd.DataFrame(out, columns=[by, "seq", "previous", "value"])

    return facts.select(by, "seq", "value").groupBy(by).applyInPandasWithState(run, f"{by} {kind}, seq long, previous string, value string", "value string", "append", GroupStateTimeout.NoTimeout)
