"""From hits and facts to a checked answer: fact lines, conditions, context, citations, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import parse
from tessera.functions.text import CITATION, sentences, tokens
from tessera.operators import citations

FIRST_CHUNKS, CHAT_WINDOWS = 8, 16
MOST_CHECKS, HISTORY = 2, 6


def has_cue(text: Column, cues: list[str]) -> Column:
    """A cue word outside the time stamps of a chat."""
    return F.regexp_replace(text, "\\[\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}\\]", " ").rlike("(?i)\\b(?:" + "|".join(cues) + ")\\b")


def within_budget(chunks: DataFrame, by: str = "doc_id", order: str = "n") -> DataFrame:
    """Chunks a model may read, of documents (is_chat, cue): the first FIRST_CHUNKS of a text; of a chat the
    CHAT_WINDOWS best, those with a cue first, then the newest; in their own order again."""
    place = Window.partitionBy(by)
    first = F.row_number().over(place.orderBy(order))
    best = F.row_number().over(place.orderBy(F.desc("cue"), F.desc(order)))
    limit = F.when(F.col("is_chat"), best <= CHAT_WINDOWS).otherwise(first <= FIRST_CHUNKS)
    return chunks.withColumn("__in", limit).filter("__in").withColumn("position", F.row_number().over(place.orderBy(order))).drop("__in")


def relevant(question: Column, text: Column) -> Column:
    """Do question and text share a token?"""
    return F.arrays_overlap(tokens(question), tokens(text))


def fact_line(field: Column, value: Column, valid_from: Column, scheduled: Column) -> Column:
    """A known fact as a line of text."""
    named = F.concat(F.replace(field, F.lit("_"), F.lit(" ")), F.lit(": "), value)
    day = F.date_format(valid_from, "yyyy-MM-dd")
    return F.when(scheduled, F.concat(named, F.lit(" (from "), day, F.lit(")"))).otherwise(F.concat(named, F.coalesce(F.concat(F.lit(" (since "), day, F.lit(")")), F.lit(""))))


def known_facts(facts: DataFrame, as_of: str) -> DataFrame:
    """Open facts, current and scheduled, as lines."""
    later = F.coalesce(F.col("valid_from") > F.lit(as_of).cast("date"), F.lit(False))
    live = facts.filter("valid_to is null and superseded_by is null").withColumn("scheduled", later)
    return live.withColumn("line", fact_line(F.col("field"), F.col("value"), F.col("valid_from"), F.col("scheduled")))


def condition_line(met: Column, stops: Column) -> Column:
    return F.when(~met, "not met").when(stops.isNotNull(), F.concat(F.lit("met, stops on "), F.date_format(stops, "yyyy-MM-dd"))).when(met, "met").otherwise("unknown")


def oldest_checks(conditions: DataFrame, by: str, most: int = MOST_CHECKS) -> DataFrame:
    """The oldest conditions of a question, distinct by what they test."""
    once = conditions.groupBy(by, "field", "op", "amount").agg(F.min("seq").alias("seq"))
    return once.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy("seq"))).filter(F.col("__r") <= most).drop("__r")


def best_sentence(texts: DataFrame, key: str, question: Column, limit: int = citations.QUOTE) -> DataFrame:
    """The sentence with the most tokens of the question, the first on a tie, cut at a word before the limit."""
    split = texts.select(key, F.array_distinct(tokens(question)).alias("__q"), F.posexplode(sentences(F.col("text"))).alias("__pos", "sentence"))
    shared = F.size(F.array_intersect(tokens(F.col("sentence")), F.col("__q")))
    best = F.max_by("sentence", F.struct(shared.alias("n"), (-F.col("__pos")).alias("p")))
    return split.groupBy(key).agg(citations.cut_at_word(best, limit).alias("quote"), F.max(shared).alias("n_shared"))


def says_not_found(text: Column) -> Column:
    """Does an answer say that it isn't known?"""
    return citations.denies(text)


def citations_of_denials_dropped(text: Column) -> Column:
    return citations.without_citations_of_denials(text)


def unrelated_citations(answers: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Cited chunks that share no token with the sentence that cites them: key, n, related."""
    s = answers.select(key, F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    numbers = F.flatten(F.transform(F.regexp_extract_all("sentence", F.lit(CITATION), F.lit(1)), lambda g: F.transform(F.split(g, ","), lambda n: F.trim(n).cast("int"))))
    cited = s.select(key, "pos", tokens(F.regexp_replace("sentence", CITATION, "")).alias("__t"), F.explode(numbers).alias("n"))
    joined = cited.join(chunks.select(key, "n", tokens(F.col("chunk")).alias("__c")), [key, "n"])
    return joined.select(key, "pos", "n", F.arrays_overlap("__t", "__c").alias("related"))


def assembled(rows: DataFrame, by: str, rank: str, line: str) -> DataFrame:
    """Numbered lines of a context, in order of rank."""
    cells = F.sort_array(F.collect_list(F.struct(rank, line)))
    return rows.groupBy(by).agg(F.array_join(F.transform(cells, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x[line])), "\n").alias("context"))


def history(turns: DataFrame, by: str = "conv_id", order: str = "turn", last: int = HISTORY) -> DataFrame:
    """The user's turns among the last ones of a conversation, joined, without their citations."""
    recent = turns.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).filter((F.col("__r") <= last) & (F.col("role") == "user"))
    return recent.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: F.trim(citations.uncited(x["text"]))), "\n").alias("history"), F.count(F.lit(1)).alias("n_turns"))


def newest_matching(rows: DataFrame, by: str, patterns: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Facts of statement rows: for each pattern (in the description) the newest row, as an amount field
    and a day field."""
    parts = None
    for pattern, amount_field, day_field in patterns.values():
        hit = rows.filter(F.col("description").rlike(pattern))
        newest = hit.groupBy(by).agg(F.max(F.struct("day", "seq", "amount")).alias("m"))
        cells = F.array(F.struct(F.lit(amount_field).alias("field"), F.col("m.amount").cast("long").cast("string").alias("value")), F.struct(F.lit(day_field).alias("field"), F.dayofmonth("m.day").cast("string").alias("value")))
        some = newest.select(by, F.inline(cells))
        parts = some if parts is None else parts.unionByName(some)
    return parts


def email_of(attributes: Column) -> Column:
    """The first value of a map that is an address, in lower case."""
    return F.lower(F.try_element_at(F.filter(F.map_values(attributes), lambda v: v.rlike("^[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+$")), F.lit(1)))


def recipient(candidates: DataFrame, by: str) -> DataFrame:
    """Whom an instruction means: a typed address before a role before a name."""
    order = F.when(F.col("how") == "typed", 0).when(F.col("how") == "role", 1).otherwise(2)
    return candidates.groupBy(by).agg(F.min_by("address", F.struct(order, "seq")).alias("address"))


def future_date(text: Column, today: Column) -> Column:
    day = parse.iso_date(text)
    return F.when(day > today, day)


def refused(question: Column, words: list[str]) -> Column:
    """A question for what is never disclosed, told before any model is asked."""
    return question.rlike("(?i)\\b(?:" + "|".join(words) + ")\\b")
