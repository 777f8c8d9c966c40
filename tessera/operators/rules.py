"""Claims, disclosure rules, the cumulative ledger, credentials, intake and the audit chain."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.parse import age, iso_date, number

# fixed values
CLAIM_FIELDS = {"income": "monthly_income", "loan_default_12m": "loan_default_12m", "age": "date_of_birth", "percentage": "percentage", "result": "result", "board": "board"}
ISSUER_CLAIMS = [
    "income_ge_25000", "income_ge_50000", "income_ge_75000", "income_ge_100000", "loan_default_12m", "age_over_18", "age_over_21",
    "percentage_ge_60", "percentage_ge_75", "percentage_ge_90", "result_pass", "board",
]
FAVOURABLE = {"income": True, "loan_default_12m": False, "age": True, "percentage": True, "result": True}
LEAST_WIDTH = {"income": 25000.0, "percentage": 15.0}
MOST_ATTESTED, ATTESTED_DAYS = 3, 30
FRESH_SECONDS = 120
GENESIS = "0" * 64


def issuer_claim(claim: Column, op: Column, value: Column) -> Column:
    """The signed claim that answers exactly, else null."""
    name = (
        F.when(claim.isin("income", "percentage") & (op == "ge"), F.concat(claim, F.lit("_ge_"), value))
        .when((claim == "age") & (op == "ge"), F.concat(F.lit("age_over_"), value))
        .when((claim == "loan_default_12m") & (op == "is"), "loan_default_12m")
        .when((claim == "result") & (op == "is"), "result_pass")
        .when((claim == "board") & (op == "is"), "board")
    )
    return F.when(name.isin(ISSUER_CLAIMS), name)


def well_formed(claim: Column, op: Column, value: Column) -> Column:
    whole = value.rlike("^\\d{1,15}$") & (value.try_cast("long") > 0)
    return F.coalesce(
        F.when(claim.isin("income", "percentage", "age"), (op == "ge") & whole)
        .when(claim == "loan_default_12m", (op == "is") & (value == "true"))
        .when(claim == "result", (op == "is") & (value == "pass"))
        .when(claim == "board", ((op == "is") & value.isNull()) | ((op == "eq") & (F.trim(value) != ""))),
        F.lit(False),
    )


def compared(claim: Column, op: Column, value: Column, fact: Column, today: Column) -> Column:
    """Yes or no from a fact's value; null where it can't be read."""
    word = F.lower(F.trim(fact))
    return (
        F.when(claim.isin("income", "percentage"), number(fact) >= value.try_cast("decimal(30,8)"))
        .when(claim == "age", age(iso_date(fact), today) >= value.try_cast("int"))
        .when(claim == "loan_default_12m", F.when(word.isin("true", "yes", "y", "1"), True).when(word.isin("false", "no", "n", "0", "none", "nil"), False))
        .when(claim == "result", F.when(word.startswith("pass"), True).when(word.startswith("fail"), False))
        .when((claim == "board") & (op == "eq"), F.lower(F.regexp_replace(F.trim(fact), "\\s+", " ")) == F.lower(F.regexp_replace(F.trim(value), "\\s+", " ")))
    )


def described(claim: Column, op: Column, value: Column) -> Column:
    """A claim in words: its threshold only, never a fact's value."""
    return (
        F.when(claim == "income", F.concat(F.lit("monthly income ≥ ₹"), F.format_number(value.try_cast("long"), 0)))
        .when(claim == "percentage", F.concat(F.lit("percentage ≥ "), value))
        .when(claim == "age", F.concat(F.lit("age ≥ "), value))
        .when(claim == "loan_default_12m", "loan defaults in the last 12 months")
        .when(claim == "result", "the exam result")
        .when((claim == "board") & (op == "is"), "your exam board")
        .otherwise(F.concat(F.lit("the exam board being "), value))
    )


def decided(claims: DataFrame) -> DataFrame:
    """Rules in order over claims joined to what is known: columns claim, op, value, signed (an unused
    credential's value), fact (grounded value), ledger_ok, today.  Adds answer_type, result, favourable."""
    c, op, v = F.col("claim"), F.col("op"), F.col("value")
    known = c.isin(*CLAIM_FIELDS)
    answer = compared(c, op, v, F.col("fact"), F.col("today"))
    kind = (
        F.when(~known | ~well_formed(c, op, v), "REFUSED")
        .when(issuer_claim(c, op, v).isNotNull() & F.col("signed").isNotNull(), "ISSUER_PROOF")
        .when((c == "board") & (op == "is"), "CANNOT_CONFIRM")
        .when(answer.isNull(), "CANNOT_CONFIRM")
        .when(~F.col("ledger_ok"), "REFUSED")
        .otherwise("OWNER_ATTESTED")
    )
    result = F.when(kind == "ISSUER_PROOF", F.col("signed")).when(kind == "OWNER_ATTESTED", answer)
    table = F.create_map(*[F.lit(x) for item in FAVOURABLE.items() for x in item])
    return claims.withColumns({"answer_type": kind, "result": result, "favourable": result == F.try_element_at(table, c)})


def intervals(answers: DataFrame, by: list[str]) -> DataFrame:
    """What disclosed answers (threshold, answer) narrow a value to: [lo, hi)."""
    lo = F.max(F.when(F.col("answer"), F.col("threshold")))
    hi = F.min(F.when(~F.col("answer"), F.col("threshold")))
    return answers.groupBy(*by).agg(lo.alias("lo"), hi.alias("hi"), F.countDistinct("threshold").alias("n_thresholds"))


def recent_thresholds(answers: DataFrame, by: list[str], now: str, days: int = ATTESTED_DAYS) -> DataFrame:
    since = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    return answers.filter(F.col("ts") >= since).groupBy(*by).agg(F.countDistinct("threshold").alias("n_recent"))


def of_keys(stored: DataFrame, rows: DataFrame, by: str) -> DataFrame:
    """Stored rows of the keys that the new rows have; null is a key."""
    keys = rows.select(F.col(by).alias("__key")).distinct()
    return stored.join(keys, stored[by].eqNullSafe(keys["__key"]), "left_semi")


LEDGER_ROW = "seq long, allowed boolean, reason string, lo double, hi double, attested array<struct<t:double,at:long>>"
TRACE = pa.list_(pa.struct([("t", pa.float64()), ("at", pa.int64())]))


def walked_ledger(questions: DataFrame, by: str, state: DataFrame | None = None, most: int = MOST_ATTESTED, days: int = ATTESTED_DAYS) -> DataFrame:
    """Questions (by, seq, ts, threshold, answer, signed, width) with allowed, reason, lo and hi, and for each
    key its state after them (seq null, with attested).  A question without threshold narrows nothing; a signed
    answer isn't counted among the attested thresholds.  state: by, lo, hi, attested, from earlier questions.

    A refused question leaves no trace, so what is allowed depends on earlier decisions: sorted partitions
    are walked batch by batch.  Of a key only the interval and the thresholds of the last days are held, and
    of those there are never more than most."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = questions.select(by, F.lit(1).alias("kind"), "seq", micros.alias("at"), "threshold", "answer", F.coalesce("signed", F.lit(False)).alias("signed"), F.coalesce("width", F.lit(0.0)).alias("width"))
    if state is not None:
        rows = rows.unionByName(of_keys(state, questions, by).select(by, F.lit(0).alias("kind"), "lo", "hi", "attested"), allowMissingColumns=True)
    else:
        rows = rows.withColumns({"lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"), "attested": F.lit(None).cast("array<struct<t:double,at:long>>")})
    names = [by, "kind", "seq", "at", "threshold", "answer", "signed", "width", "lo", "hi", "attested"]
    ordered = rows.select(*names).repartition(by).sortWithinPartitions(by, "kind", "seq")
    span = days * 86_400_000_000
    low_end, high_end = float("-inf"), float("inf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, started, lo, hi, seen, field = None, False, low_end, high_end, {}, None

        def shown(*values):
            return (*values, None if lo == low_end else lo, None if hi == high_end else hi)

        def closing():
            return (key, None, None, *shown(None), [{"t": t, "at": at} for t, at in sorted(seen.items())])

        def packed(out):
            columns = list(zip(*out))
            kinds = [field.type, pa.int64(), pa.bool_(), pa.string(), pa.float64(), pa.float64(), TRACE]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[by, "seq", "allowed", "reason", "lo", "hi", "attested"])

        for batch in batches:
            field, out = batch.schema.field(0), []
            for who, kind, seq, at, t, yes, signed, width, low, high, attested in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or who != key:
                    if started:
                        out.append(closing())
                    key, started, lo, hi, seen = who, True, low_end, high_end, {}
                if kind == 0:
                    lo, hi, seen = low_end if low is None else low, high_end if high is None else high, {x["t"]: x["at"] for x in attested or ()}
                    continue
                if t is None or yes is None:
                    out.append((key, seq, True, *shown(None), None))
                    continue
                low, high = (max(lo, t), hi) if yes else (lo, min(hi, t))
                seen = {x: when for x, when in seen.items() if when >= at - span}
                reason = "too narrow" if high - low < width else "too many thresholds" if not signed and t not in seen and len(seen) >= most else None
                if reason is None:
                    lo, hi = low, high
                    if not signed:
                        seen[t] = at
                out.append((key, seq, reason is None, *shown(reason), None))
            if out:
                yield packed(out)
        if started:
            yield packed([closing()])

    kind = questions.schema[by].dataType.simpleString()
    return ordered.mapInArrow(run, f"{by} {kind}, {LEDGER_ROW}")


def ledger(questions: DataFrame, by: str, width: float, most: int = MOST_ATTESTED, days: int = ATTESTED_DAYS) -> DataFrame:
    """Each question (by, seq, ts, threshold, answer) with allowed, lo and hi after it."""
    asked = questions.select(by, "seq", "ts", "threshold", "answer", F.lit(False).alias("signed"), F.lit(float(width)).alias("width"))
    return walked_ledger(asked, by, None, most, days).filter("seq is not null").select(by, "seq", "allowed", "lo", "hi")


def wallet_status(credentials: DataFrame, by: list[str]) -> DataFrame:
    return credentials.groupBy(*by).agg(F.count_if(F.col("used") == 0).alias("unused"), F.count(F.lit(1)).alias("total"))


def found_copies(claims: DataFrame, credentials: DataFrame) -> DataFrame:
    """For each wanted claim the unused credential with the least (type, copy) that discloses it."""
    shown = credentials.filter("used = 0").select("cred_id", "credential_type", "copy", F.explode("disclosures").alias("d")).select("cred_id", "credential_type", "copy", "d.claim", "d.value")
    first = shown.groupBy("claim").agg(F.min(F.struct("credential_type", "copy", "cred_id", "value")).alias("m"))
    return claims.join(first, "claim").select(*claims.columns, F.col("m.cred_id").alias("cred_id"), F.col("m.value").alias("signed"))


def digest(salt: Column, claim: Column, value_json: Column) -> Column:
    """URL-safe base64 of the SHA-256 of salt|claim|value."""
    raw = F.unhex(F.sha2(F.concat_ws("|", salt, claim, value_json).cast("binary"), 256))
    return F.rtrim(F.translate(F.base64(raw), "+/", "-_"), F.lit("="))


def fingerprint(key: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a URL-safe base64 key."""
    padded = F.rpad(F.translate(key, "-_", "+/"), (F.ceil(F.length(key) / 4) * 4).cast("int"), F.lit("="))
    return F.substring(F.sha2(F.unbase64(padded), 256), 1, 16)


def intake(requests: DataFrame, now: str, most: int = 500) -> DataFrame:
    """Adds reason: why a request is rejected, null if it is admitted.  Columns: requester, status, nonce,
    ts, question, seq.  The first of equal (requester, nonce) is admitted."""
    first = F.row_number().over(Window.partitionBy("requester", "nonce").orderBy("seq")) == 1
    late = F.abs(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) > FRESH_SECONDS * 1_000_000
    reason = (
        F.when(F.length("question") > most, "too_long")
        .when(late, "stale_ts")
        .when(F.col("status").isNull(), "unknown")
        .when(F.col("status") == "blocked", "blocked")
        .when(F.col("status") == "pending", "pending_pairing")
        .when(~first, "replay")
    )
    return requests.withColumn("reason", reason)


def entry_hash(previous: Column, entry: Column) -> Column:
    return F.sha2(F.concat(previous, entry).cast("binary"), 256)


def chained(entries: DataFrame, by: str, seq: str = "seq", body: str = "body", heads: DataFrame | None = None) -> DataFrame:
    """Entries of each log with prev_hash and entry_hash, after the heads (by, entry_hash) that logs have, if any.
    A chain is serial, so a log is one task's; of it only the last hash is held, from batch to batch.  verify()
    is parallel over all entries."""
    given = entries.select(by, F.lit(1).alias("kind"), seq, body)
    if heads is not None:
        known = of_keys(heads, entries, by)
        given = given.unionByName(known.select(by, F.lit(0).alias("kind"), F.col("entry_hash").alias(body)), allowMissingColumns=True)
    names = [by, seq, body, "prev_hash", "entry_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, last, started = None, None, False
        for batch in batches:
            before, after, own = [], [], []
            for key, kind, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if not started or key != log:
                    log, last, started = key, GENESIS, True
                own.append(kind == 1)
                before.append(last)
                last = text if kind == 0 else None if last is None or text is None else hashlib.sha256((last + text).encode()).hexdigest()
                after.append(last)
            done = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(before, pa.string()), pa.array(after, pa.string())], names=names)
            yield done.filter(pa.array(own, pa.bool_()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "kind")
    return given.repartition(by).sortWithinPartitions(by, "kind", seq, body).mapInArrow(run, f"{kinds}, prev_hash string, entry_hash string")


def verified(chain: DataFrame, by: str, seq: str = "seq", body: str = "body") -> DataFrame:
    """Per log: intact, the first broken seq, entries."""
    before = F.lag("entry_hash", 1, GENESIS).over(Window.partitionBy(by).orderBy(seq))
    bad = (F.col("prev_hash") != before) | (entry_hash(F.col("prev_hash"), F.col(body)) != F.col("entry_hash"))
    marked = chain.withColumn("__bad", bad)
    return marked.groupBy(by).agg((F.count_if("__bad") == 0).alias("intact"), F.min(F.when(F.col("__bad"), F.col(seq))).alias("broken_at"), F.count(F.lit(1)).alias("entries"))
