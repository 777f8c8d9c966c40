"""Repair of conversations by weighted finite-state composition.

A conversation is an acceptor of its rows.  The edit transducer reads a row and writes a role's
initial or nothing: K keeps the row, R gives it another role, D deletes it; I writes a role without
reading.  The role grammar accepts (s?(ua)+)?.  The three are composed lazily: a state of the
composition is (rows read, state of the grammar), made when a path reaches it.  A weight is a pair
(cost, label string), smaller ones first by cost and then by the string's ASCII order; the best path is
found in topological order of the rows.  Cost is a function of the label string and rises with each
insertion, so of two equally dear strings for the same rows none is a prefix of the other, and least
weights stay least when paths are put together.  That lets a long conversation be cut: each block of
rows gives the best weights between all grammar states, and blocks are put together in order.

Blocks are cut from rows that are sorted over the cluster by conversation and turn (BLOCK rows and
about BYTES of text at most), so a conversation of any length is spread over tasks.  A later stage
sees a conversation's blocks in order, one at a time.  What is serial by nature: one task joins a
conversation's label strings, and one reads its texts, block by block, for the one hash over all of them.

Defined cases: null roles, texts and parts of the damage key count as one space; a null conv_id is a
conversation; rows of one turn go by role and text; equal rows are equal (the second is a duplicate);
the initial of a role is its first character, and a role without one fits no state; conversations that
lose all rows have zeros and the empty audit; an empty table gives an empty table; further columns play
no part.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import erase, written

FAULTS = 20
BLOCK = 128
BYTES = 1 << 20
SPACES = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
#: The grammar: the state after each initial that may come next; 0 is the start, ACCEPTED may end.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ACCEPTED = (0, 3)
LEGAL = ("su", "ua", "au")
RELABEL, DELETE, CUT, INSERT = 1, 2, 5, 5
#: What a row is found to be.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)

Best = dict[int, tuple[int, str]]  # the least weight with which a state of the grammar is reached


def edits(initial: str, fault: int) -> Iterator[tuple[str, int, str | None]]:
    """Label, cost and output of what the transducer does with a row."""
    yield "D", DELETE, None
    if fault not in (BLANK, DUPLICATE):
        extra = CUT if fault == TRUNCATED else 0
        yield "K", extra, initial
        for role in ROLES:
            yield "R", RELABEL + extra, role


def reach(best: Best, state: int, weight: tuple[int, str]) -> bool:
    if state in best and best[state] <= weight:
        return False
    best[state] = weight
    return True


def inserted(best: Best) -> Best:
    """After any insertions."""
    out, todo = dict(best), list(best)
    while todo:
        state = todo.pop()
        cost, label = out[state]
        todo += [t for role in ROLES if (t := GRAMMAR[state].get(role)) is not None and reach(out, t, (cost + INSERT, label + "I"))]
    return out


def composed(rows: list[tuple[str, int]], start: int) -> Best:
    """Least weights from a state of the grammar over rows (initial, fault)."""
    best: Best = {start: (0, "")}
    for initial, fault in rows:
        after: Best = {}
        for state, (cost, label) in inserted(best).items():
            for edit, more, out in edits(initial, fault):
                t = state if out is None else GRAMMAR[state].get(out)
                if t is not None:
                    reach(after, t, (cost + more, label + edit))
        best = after
    return best


def best_audit(blocks: list[dict[int, Best]]) -> tuple[int, list[tuple[int, str]]]:
    """Cost of a conversation, and for each block the state it starts in and its labels.

    Strings are kept without the part that all candidates have in common, so they stay short."""
    best: Best = {0: (0, "")}
    came: list[dict[int, int]] = []
    for block in [*blocks, {s: inserted({s: (0, "")}) for s in GRAMMAR}]:
        after: Best = {}
        from_: dict[int, int] = {}
        for s, (cost, label) in best.items():
            for t, (more, labels) in block.get(s, {}).items():
                if reach(after, t, (cost + more, label + labels)):
                    from_[t] = s
        same = len(os.path.commonprefix([label for _, label in after.values()]))
        best = {t: (cost, label[same:]) for t, (cost, label) in after.items()}
        came.append(from_)
    end = min(ACCEPTED, key=lambda t: best.get(t, (float("inf"), "")))
    cost, path, state = best[end][0], [], came[-1][end]
    tail = inserted({state: (0, "")})[end][1]
    for block, from_ in zip(reversed(blocks), reversed(came[:-1])):
        start = from_[state]
        path.append((start, block[start][state][1] + tail))
        state, tail = start, ""
    return cost, path[::-1]


def repaired(start: int, labels: str, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
    """Label, role and text of what the labels leave of a block's rows."""
    state, at = start, 0
    for label in labels:
        role, text = (roles[at], texts[at]) if label != "I" else ("", "")
        at += label != "I"
        if label in "RI":
            role = ROLES[next(r for r in ROLES if r in GRAMMAR[state])]
        if label != "D":
            state = GRAMMAR[state][role[:1]]
            yield label, role, text


def space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage, and live: false for rows that were dropped."""
    key = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")))
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (key % FAULTS).alias("__fault"))
    text = F.when(F.col("__fault") == 1, F.lit("")).when(F.col("__fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("__fault") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("__fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", (F.col("__fault") != 0).alias("live"), "turn", role.alias("role"), text.alias("text"), copies.alias("__copy")).drop("__copy")


BLOCK_FIELDS = "part int, seq long, first boolean, roles array<string>, texts array<string>, blanks array<boolean>, ends array<boolean>, keys array<string>, low long, high long, last long, n_turns long"


def blocks(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, live) as blocks of one conversation each, in order of (part, seq).

    first: no other block of the conversation comes before, as far as the part can tell."""
    stripped = F.rtrim(F.col("text"), F.lit(SPACES))
    rows = rows.withColumns(
        {
            "blank": stripped == "",
            "ends": F.substring(stripped, -1, 1).isin(".", "!", "?"),
            "key": F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")),
            "tie": F.monotonically_increasing_id(),
        }
    )
    order = ["conv_id", "live", "turn", "role", "text", "tie"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "live", "turn", "role", "text", "blank", "ends", "key")
    names = [f.split()[0] for f in BLOCK_FIELDS.split(", ")]
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, conv, begun, first, held, size = TaskContext.get().partitionId(), 0, None, False, False, [], 0
        schema = None

        def block() -> dict[str, Any]:
            turns = [r[2] for r in held if r[2] is not None]
            lists = [list(c) for c in zip(*[r[3:] for r in held])] or [[], [], [], [], []]
            ends = [turns[0] if turns else None, turns[-1] if turns else None, held[-1][2] if held else None, len(set(turns))]
            return dict(zip(["conv_id", *names], [conv, part, seq, first, *lists, *ends]))

        for batch in batches:
            schema = schema or pa.schema([pa.field("conv_id", batch.schema.field(0).type), *ARROW_BLOCK])
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or row[0] != conv:
                    if begun:
                        out.append(block())
                        seq += 1
                    # the first rows of a part may go on with a conversation of the part before
                    conv, first, begun, held, size = row[0], begun, True, [], 0
                elif held and (len(held) >= BLOCK or size >= BYTES):
                    out.append(block())
                    seq, first, held, size = seq + 1, False, [], 0
                if row[1]:
                    held.append(row)
                    size += len(row[4])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if begun:
            yield pa.RecordBatch.from_pylist([block()], schema)

    return ordered.mapInArrow(run, f"conv_id {kind}, {BLOCK_FIELDS}")


STRINGS, FLAGS = pa.list_(pa.string()), pa.list_(pa.bool_())
ARROW_BLOCK = [
    pa.field(name, kind)
    for name, kind in (
        ("part", pa.int32()), ("seq", pa.int64()), ("first", pa.bool_()), ("roles", STRINGS), ("texts", STRINGS), ("blanks", FLAGS), ("ends", FLAGS),
        ("keys", STRINGS), ("low", pa.int64()), ("high", pa.int64()), ("last", pa.int64()), ("n_turns", pa.int64()),
    )
]


def seen_before(made: DataFrame) -> DataFrame:
    """part, seq and the keys of a block that an earlier block of its conversation has."""
    keys = made.select("conv_id", "part", "seq", F.explode(F.array_distinct("keys")).alias("key"))
    place = F.struct("part", "seq")
    repeated = keys.groupBy("conv_id", "key").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = repeated.select(F.col("conv_id").alias("__conv"), F.col("key").alias("__key"), "at")
    later = keys.join(repeated, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("key") == F.col("__key"))).filter(place > F.col("at"))
    return later.groupBy("part", "seq").agg(F.collect_set("key").alias("seen"))


WEIGHT_FIELDS = "part int, seq long, initials string, low long, high long, last long, n_turns long, blank long, duplicate long, truncated long, illegal long, paths array<struct<start:int,state:int,cost:long,label:string>>"


def weighed(made: DataFrame) -> DataFrame:
    """Faults, counts and best paths of each block; texts are not read."""
    seen = seen_before(made)
    rows = made.drop("texts").join(seen, ["part", "seq"], "left").select("conv_id", "part", "seq", "first", "roles", "blanks", "ends", "keys", "low", "high", "last", "n_turns", "seen")
    kind = made.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                seen, faults = set(r.pop("seen") or ()), []
                for blank, ends, key in zip(r.pop("blanks"), r.pop("ends"), r.pop("keys")):
                    faults.append(BLANK if blank else DUPLICATE if key in seen else SOUND if ends else TRUNCATED)
                    seen.add(key)
                initials = [role[:1] for role in r.pop("roles")]
                starts = [0] if r.pop("first") else list(GRAMMAR)
                paths = {s: composed(list(zip(initials, faults)), s) for s in starts}
                r |= {name: faults.count(fault) for name, fault in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
                r["illegal"] = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
                r["initials"] = (initials[0] + "," + initials[-1]) if initials else None
                r["paths"] = [{"start": s, "state": t, "cost": c, "label": x} for s, best in paths.items() for t, (c, x) in best.items()]
                out.append(r)
            path = pa.struct([("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("label", pa.string())])
            longs = ["low", "high", "last", "n_turns", "blank", "duplicate", "truncated", "illegal"]
            schema = pa.schema([batch.schema.field(0), ("part", pa.int32()), ("seq", pa.int64()), ("initials", pa.string()), *[(c, pa.int64()) for c in longs], ("paths", pa.list_(path))])
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(run, f"conv_id {kind}, {WEIGHT_FIELDS}")


SUMS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
CHOICE_FIELDS = "part int, seq long, start int, label string, final boolean, " + ", ".join(f"{c} long" for c in SUMS) + ", audit string"


def summary(made: list[dict[str, Any]]) -> tuple[dict[str, Any], list[tuple[int, str]]]:
    """What is returned of a conversation, from its blocks in order, and the path of each block."""
    cost, path = best_audit([paths_of(b) for b in made])
    lows, highs = [b["low"] for b in made if b["low"] is not None], [b["high"] for b in made if b["high"] is not None]
    turns = sum(b["n_turns"] for b in made)
    full = [b for b in made if b["initials"] is not None]
    illegal = sum(b["illegal"] for b in made)
    for a, b in zip(full, full[1:]):
        turns -= a["last"] is not None and a["last"] == b["low"]  # a turn that two blocks share
        illegal += a["initials"].split(",")[-1] + b["initials"].split(",")[0] not in LEGAL
    total = {c: sum(b[c] for b in made) for c in ("blank", "duplicate", "truncated")}
    gaps = highs[-1] - lows[0] + 1 - turns if lows else 0
    return total | {"gaps": gaps, "illegal": illegal, "cost": cost, "audit": "".join(x for _, x in path)}, path


def paths_of(block: dict[str, Any]) -> dict[int, Best]:
    out: dict[int, Best] = {}
    for p in block["paths"]:
        out.setdefault(p["start"], {})[p["state"]] = (p["cost"], p["label"])
    return out


def chosen(weights: DataFrame) -> DataFrame:
    """The path of each block; the last block of a conversation has its results."""
    kind = weights.schema["conv_id"].dataType.simpleString()
    ordered = weights.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, Any]] = []
        schema = None

        def out() -> list[dict[str, Any]]:
            found, path = summary(held)
            rows = [{"conv_id": b["conv_id"], "part": b["part"], "seq": b["seq"], "start": s, "label": x, "final": False} for b, (s, x) in zip(held, path)]
            rows[-1] |= found | {"final": True}
            return rows

        for batch in batches:
            longs = [(c, pa.int64()) for c in SUMS]
            schema = pa.schema([batch.schema.field(0), ("part", pa.int32()), ("seq", pa.int64()), ("start", pa.int32()), ("label", pa.string()), ("final", pa.bool_()), *longs, ("audit", pa.string())])
            rows = []
            for r in batch.to_pylist():
                if held and held[-1]["conv_id"] != r["conv_id"]:
                    rows += out()
                    held = []
                held.append(r)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if held:
            yield pa.RecordBatch.from_pylist(out(), schema)

    return ordered.mapInArrow(run, f"conv_id {kind}, {CHOICE_FIELDS}")


def in_order(made: DataFrame, choices: DataFrame) -> DataFrame:
    """Each block's choice and after it its rows, a conversation in one part."""
    texts = made.select("conv_id", "part", "seq", F.lit(1).alias("kind"), "roles", "texts")
    both = choices.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq", "kind")


RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def read_out(ordered: DataFrame, as_rows: bool) -> DataFrame:
    """The repaired rows, or per conversation its results with the hash of them."""
    kind = ordered.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, place, choice = hashlib.sha256(), 0, None
        for batch in batches:
            out = []
            if as_rows:
                schema = pa.schema([batch.schema.field("conv_id"), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
            else:
                schema = pa.schema([batch.schema.field("conv_id"), *[(c, pa.int64()) for c in RESULT[1:7]], ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    choice = r
                    continue
                for label, role, text in repaired(choice["start"], choice["label"], r["roles"], r["texts"]):
                    if as_rows:
                        out.append({"conv_id": r["conv_id"], "place": place, "edit": label, "role": role, "text": text})
                    else:
                        digest.update((("\n" if place else "") + f"{role}:{text}").encode())
                    place += 1
                if choice["final"]:
                    if not as_rows:
                        out.append({c: choice[c] for c in RESULT[:-1]} | {"repaired_sha256": digest.hexdigest()})
                    digest, place = hashlib.sha256(), 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    rows = f"conv_id {kind}, place long, edit string, role string, text string"
    digests = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in RESULT[1:7]) + ", audit string, repaired_sha256 string"
    return ordered.mapInArrow(run, rows if as_rows else digests)


def repair(rows: DataFrame, outputs: str = "digests") -> DataFrame:
    """Repair conversations (conv_id, turn, role, text, and live: false for rows that only name their conversation).

    outputs: "digests" gives RESULT per conversation, "rows" the repaired rows (conv_id, place, edit, role, text)."""
    made = written(blocks(rows), "turnblocks")
    out = written(read_out(in_order(made, chosen(weighed(made))), outputs == "rows"), "repaired")
    erase(made)
    return out
