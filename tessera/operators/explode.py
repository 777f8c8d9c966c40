"""Operators that make several rows of one: chunks, chat messages and windows, statement rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE, OVERLAP = 600, 100
#: Texts of a batch that are cut at once.
TEXTS = 64
GAP_SECONDS = 6 * 3600
#: "18/09/26, 19:42 - ", "[18/09/26, 19:42:10] " and 12-hour forms: day, month, year, hour, minute, a or p, rest
HEADER = "(?i)^\\[?(\\d{1,2})[/.](\\d{1,2})[/.](\\d{4}|\\d{2}),?\\s+(\\d{1,2}):(\\d{2})(?::\\d{2})?\\s*(?:([ap])\\.?\\s?m?\\.?)?\\]?\\s*(?:-\\s+)?(.*)$"


def cuts(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of chunks: each ends at the best break of its second half, the next starts on a word about
    `overlap` before that end."""
    spans, start, n = [], 0, len(text)
    while start < n:
        end = n
        if start + size < n:
            half, limit = start + size // 2, start + size
            ends = (text.rfind(s, half, limit) + len(s) for s in ("\n\n", "\n", ". ", " ") if text.rfind(s, half, limit) >= 0)
            end = next(ends, limit)
        spans.append((start, end))
        if end >= n:
            break
        back = max(end - overlap, start + 1)
        while not text[back - 1].isspace() and back < end:
            back += 1
        start = back
    return spans


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunk ends depend on the one before: a fold over the text, in Arrow.  Of a batch only TEXTS texts at once are
    strings of Python, so that a task's memory is one batch's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                some = batch.slice(start, TEXTS)
                rows, numbers, parts = [], [], []
                for row, whole in enumerate(some.column(1).to_pylist()):
                    body = (whole or "").strip()
                    found = [p for a, b in cuts(body, SIZE, OVERLAP) if (p := body[a:b].strip())]
                    rows += [row] * len(found)
                    numbers += range(len(found))
                    parts += found
                keys = some.column(0).take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(numbers, pa.int32()), pa.array(parts, pa.string())], names=[key, "n", "text"])

    schema = T.StructType([docs.schema[key], T.StructField("n", T.IntegerType(), False), T.StructField("text", T.StringType())])
    return docs.select(key, text).mapInArrow(run, schema)


def messages(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Messages of chat exports: key, seq, ts, sender, text.  Lines without a header continue the message
    before; system lines, media and deleted messages are left out; days come first unless some second
    field of the file is over 12."""
    plain = F.regexp_replace(F.regexp_replace(F.col(text), "[\\u200e\\u200f\\u202a-\\u202e]", ""), "\\r\\n", "\n")
    lines = files.select(key, F.posexplode(F.split(plain, "\n")).alias("line", "raw")).withColumn("raw", F.trim("raw"))
    run = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("head", F.col("raw").rlike(HEADER)).withColumn("m", F.sum(F.col("head").cast("int")).over(run)).filter("m > 0")
    parts = [F.regexp_extract("raw", HEADER, i) for i in range(1, 8)]
    fields = F.struct(*[p.alias(n) for p, n in zip(parts, ("d1", "d2", "y", "h", "mi", "ap", "rest"))])
    numbered = numbered.withColumn("f", F.when(F.col("head"), fields)).withColumn("body", F.when(F.col("head"), F.col("f.rest")).otherwise(F.col("raw")))
    whole = numbered.groupBy(key, "m").agg(F.first("f", ignorenulls=True).alias("f"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), "\n").alias("body"))
    whole = whole.withColumn("month_first", F.bool_or(F.col("f.d2").cast("int") > 12).over(Window.partitionBy(key)))
    sender = F.regexp_extract("body", "(?s)^([^:\\n]{1,60}?):\\s(.*)$", 1)
    said = F.trim(F.array_join(F.filter(F.split(F.regexp_extract("body", "(?s)^([^:\\n]{1,60}?):\\s(.*)$", 2), "\n"), lambda x: x != ""), "\n"))
    day, month = (F.when(F.col("month_first"), F.col(a)).otherwise(F.col(b)).cast("int") for a, b in (("f.d2", "f.d1"), ("f.d1", "f.d2")))
    year = F.col("f.y").cast("int") + F.when(F.length("f.y") == 2, 2000).otherwise(0)
    hour = F.when(F.col("f.ap") == "", F.col("f.h").cast("int")).otherwise(F.col("f.h").cast("int") % 12 + F.when(F.lower("f.ap") == "p", 12).otherwise(0))
    stamp = F.format_string("%04d-%02d-%02d %02d:%02d", year, month, day, hour, F.col("f.mi").cast("int"))
    out = whole.select(key, F.col("m").alias("seq"), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm")).alias("ts"), F.trim(F.regexp_replace(sender, "\\s+", " ")).alias("sender"), said.alias("text"))
    skip = F.col("text").rlike("(?i)^(?:<media omitted>|this message was deleted|you deleted this message|null)$")
    return out.filter((F.col("sender") != "") & (F.col("text") != "") & ~skip & F.col("ts").isNotNull())


def message_line(ts, sender, text):
    return F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit("] "), sender, F.lit(": "), text)


def conversation_windows(found: DataFrame, key: str = "path", size: int = SIZE) -> DataFrame:
    """Windows of messages: key, locator, text.  A silence over GAP_SECONDS starts a new one, and so does a
    line that would pass the size, then with the last line once more.  Silences cut the series into
    independent runs natively; the size rule is a fold within a run."""
    order = Window.partitionBy(key).orderBy("seq")
    silent = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(order)) > GAP_SECONDS
    runs = found.withColumn("run", F.sum(F.coalesce(silent.cast("int"), F.lit(1))).over(order)).withColumn("line", message_line(F.col("ts"), F.col("sender"), F.col("text")))
    entry = F.struct("seq", "line")
    lists = runs.groupBy(key, "run").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    empty = F.array().cast("array<array<string>>")

    def add(done, x):
        last = F.element_at(done, -1)
        tail = F.element_at(last, -1)
        long = F.length(F.array_join(last, "\n")) + 1 + F.length(x["line"]) > size
        again = (F.size(last) > 1) & (F.length(tail) + F.length(x["line"]) < size)
        begun = F.when(again, F.array(tail, x["line"])).otherwise(F.array(x["line"]))
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.array(x["line"]))))
        return F.when(F.size(done) == 0, F.array(F.array(x["line"]))).when(long, F.concat(done, F.array(begun))).otherwise(grown)

    windows = lists.select(key, "run", F.posexplode(F.aggregate("e", empty, add)).alias("n", "w"))
    return windows.select(key, "run", "n", F.concat(F.lit("chat: "), F.substring(F.element_at("w", 1), 2, 16)).alias("locator"), F.array_join("w", "\n").alias("text"))


def statement_rows(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Dated rows of a flattened statement: key, n, day, description, amount, party and whether it is paid
    to them (UPI/...) or by them (CREDIT)."""
    row = "^(\\d{4}-\\d{2}-\\d{2})\\s+(.*?)\\s+([\\d,]+\\.\\d{2})\\s+[\\d,]+\\.\\d{2}"
    pieces = texts.select(key, F.posexplode(F.split(F.col(text), "(?=\\d{4}-\\d{2}-\\d{2}\\s)")).alias("n", "piece")).filter(F.col("piece").rlike(row))
    out = pieces.select(key, "n", F.try_to_date(F.regexp_extract("piece", row, 1)).alias("day"), F.regexp_extract("piece", row, 2).alias("description"), F.regexp_replace(F.regexp_extract("piece", row, 3), ",", "").cast("decimal(18,2)").alias("amount"))
    paid, got = F.regexp_extract("description", "UPI/[A-Z ]+/(.+)$", 1), F.regexp_extract("description", "CREDIT\\s+(?:FROM\\s+)?(.+)$", 1)
    return out.withColumns({"party": F.coalesce(F.nullif(paid, F.lit("")), F.nullif(got, F.lit(""))), "outgoing": paid != ""})


def running_balance(rows: DataFrame, by: list[str], order: list[str], amount: str, opening: float = 0.0) -> DataFrame:
    return rows.withColumn("balance", F.lit(opening) + F.sum(amount).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def citation_checks(answers: DataFrame, supplied: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Per answer: how many sentences, which of them cite nothing, which numbers were never supplied."""
    from tessera.functions.text import CITATION, cited_numbers, sentences

    parts = answers.select(key, F.col(text).alias("__t"), sentences(F.col(text)).alias("s"))
    bare = F.size(F.filter("s", lambda x: ~x.rlike(CITATION)))
    flat = parts.select(key, F.size("s").alias("n_sentences"), bare.alias("n_bare"), F.explode_outer(cited_numbers(F.col("__t"))).alias("n"))
    known = supplied.select(F.col(key).alias("__k"), F.col("n").alias("__n"))
    joined = flat.join(known, (F.col(key) == F.col("__k")) & (F.col("n") == F.col("__n")), "left")
    agg = joined.groupBy(key).agg(F.first("n_sentences").alias("n_sentences"), F.first("n_bare").alias("n_bare"), F.count("n").alias("n_citations"), F.count_if(F.col("n").isNotNull() & F.col("__n").isNull()).alias("n_invalid"))
    uncited = (F.col("n_citations") > 0) & (F.col("n_bare") > 0)
    return agg.withColumns({"no_citation": F.col("n_citations") == 0, "uncited_sentence": uncited, "citation_ok": (F.col("n_citations") > 0) & (F.col("n_invalid") == 0)})
