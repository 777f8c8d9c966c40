"""Tables that grow by batches: a batch is written as a unit and may be written again.

Each batch has folders of its own and, last of all, a mark; only marked batches are read, and a batch is
worked out from the batches below it alone.  A repeat therefore replaces its own folders with equal rows.
One writer at a time is assumed, as a streaming query is one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import rules


@dataclass
class Batches:
    """Folders of tables by batch, below one path of the shared storage."""

    spark: SparkSession
    path: str

    def put(self, batch: int, tables: dict[str, DataFrame]) -> None:
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/marks/batch={batch}")

    def is_empty(self) -> bool:
        marks = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/marks")
        return not marks.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(marks)

    def get(self, name: str, schema: str, below: int | None = None) -> DataFrame:
        """Rows of all marked batches (below one, if given), with batch."""
        if self.is_empty():
            return self.spark.createDataFrame([], f"{schema}, batch long")
        marks = self.spark.read.schema("batch long").parquet(f"{self.path}/marks").distinct()
        rows = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{name}")
        if below is not None:
            rows = rows.filter(F.col("batch") < below)
        return rows.join(F.broadcast(marks), "batch", "left_semi")  # a row a batch


def newest(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of each key the row of its last batch."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), "batch").alias("__r")).select(*by, "__r.*").drop("batch")


class LedgerStore(Batches):
    """The disclosure ledger of claims: what was answered so far narrows what may be answered next.

    Questions: claim, seq, ts, threshold (null: nothing is narrowed), answer, signed, width."""

    STATE = "claim string, lo double, hi double, attested array<struct<t:double,at:long>>"
    DECIDED = "claim string, seq long, allowed boolean, reason string, lo double, hi double"

    def decide(self, batch: int, questions: DataFrame) -> DataFrame:
        """Decisions on a batch of questions after all batches below; its ledger rows are stored with them."""
        walked = rules.walked_ledger(questions, "claim", state=self.state(below=batch)).checkpoint()
        decided = walked.filter("seq is not null").select(*[c.split()[0] for c in self.DECIDED.split(", ")])
        state = walked.filter("seq is null").select("claim", "lo", "hi", "attested")
        self.put(batch, {"decisions": decided, "ledger": state})
        return decided

    def state(self, below: int | None = None) -> DataFrame:
        return newest(self.get("ledger", self.STATE, below), ["claim"])

    def decisions(self) -> DataFrame:
        return self.get("decisions", self.DECIDED).drop("batch")


class AuditStore(Batches):
    """Hash-chained logs that batches of entries (log, seq, body) are appended to."""

    ENTRIES = "log string, seq long, body string, prev_hash string, entry_hash string"
    HEADS = "log string, seq long, entry_hash string"

    def append(self, batch: int, entries: DataFrame) -> None:
        """Chain a batch onto the heads that the batches below left; entries at or below a log's head are refused."""
        heads = self.heads(below=batch)
        last = heads.select(F.col("log").alias("__log"), F.col("seq").alias("__last"))
        joined = entries.join(last, entries["log"].eqNullSafe(last["__log"]), "left")
        late = joined.filter(F.col("seq") <= F.col("__last"))
        fresh = joined.filter(F.coalesce(F.col("seq") > F.col("__last"), F.lit(True)))
        chain = rules.chained(fresh.select("log", "seq", "body"), "log", heads=heads).checkpoint()
        tails = chain.groupBy("log").agg(F.max("seq").alias("seq"), F.max_by("entry_hash", "seq").alias("entry_hash"))
        self.put(batch, {"entries": chain, "heads": tails, "refused": late.select("log", "seq", "body")})

    def heads(self, below: int | None = None) -> DataFrame:
        return newest(self.get("heads", self.HEADS, below), ["log"])

    def entries(self) -> DataFrame:
        return self.get("entries", self.ENTRIES).drop("batch")

    def refused(self) -> DataFrame:
        return self.get("refused", "log string, seq long, body string").drop("batch")


def threshold(claim: Column, issuer_claim: Column, op: Column, value: Column) -> Column:
    """The t of a claim "at least t" that narrows a tracked value: from the signed claim's name, else from its own
    number; null where nothing is narrowed."""
    named = F.regexp_extract(issuer_claim, f"^(?:{'|'.join(rules.LEAST_WIDTH)})_ge_(\\d+)$", 1).try_cast("double")
    own = F.when(op == "ge", value.try_cast("double"))
    return F.when(claim.isin(list(rules.LEAST_WIDTH)), F.coalesce(named, own))


def released(requests: DataFrame, credentials: DataFrame) -> DataFrame:
    """cred_id for each request (request_id, seq, claim) that asks for a signed proof: the oldest request of a claim
    takes its first unused copy (cred_id, claim, used, credential_type, copy), the next one the next; a copy is
    never given twice.  Null where none is left.

    Requests and copies of a claim are numbered and joined on the number, which is what handing them out one by
    one comes to."""
    ask = F.row_number().over(Window.partitionBy("claim").orderBy("seq", "request_id"))
    have = F.row_number().over(Window.partitionBy("claim").orderBy("credential_type", "copy", "cred_id"))
    wanted = requests.withColumn("__n", ask)
    free = credentials.filter("used = 0").select("claim", "cred_id", "credential_type", "copy").withColumn("__n", have).select("claim", "cred_id", "__n")
    return wanted.join(free, ["claim", "__n"], "left").drop("__n")


def settled(requests: DataFrame, ledger: DataFrame, credentials: DataFrame) -> DataFrame:
    """Requests (request_id, seq, claim, proof, answer) with status, cred_id and the audit event of each: a proof
    that finds a copy is released with it; else the ledger (claim, seq, allowed) refuses or lets the answer go;
    without an answer it can't be confirmed."""
    proofs = released(requests.filter("proof").select("request_id", "seq", "claim"), credentials).select("request_id", "cred_id")
    rows = requests.join(proofs, "request_id", "left").join(ledger.select("claim", "seq", "allowed"), ["claim", "seq"], "left")
    status = (
        F.when(F.col("cred_id").isNotNull(), "ISSUER_PROOF")
        .when(F.col("answer").isNull(), "CANNOT_CONFIRM")
        .when(~F.coalesce("allowed", F.lit(True)), "REFUSED")
        .otherwise("OWNER_ATTESTED")
    )
    event = F.when(F.col("status") == "REFUSED", "ledger_refused").when(F.col("status") == "CANNOT_CONFIRM", "not_confirmed").otherwise("answer_released")
    return rows.withColumn("status", status).withColumns({"event": event, "answer": F.when(F.col("status").isin("ISSUER_PROOF", "OWNER_ATTESTED"), F.col("answer"))}).drop("allowed")
