"""Citations of an answer: cut into pieces with their separators, so that all that isn't dropped stays as it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import CITATION, SENTENCE_END, cited_numbers, sentences, tokens
from tessera.sources.shared import spread

QUOTE = 200
#: Marks put around separators; both are noncharacters, which texts don't hold.
OPEN, CLOSE = "﷐", "﷑"
#: Ends of a clause: after a comma, semicolon or colon outside brackets, or before "but".
CLAUSE_END = "(?i)(?<=[,;:])\\s+(?![^\\[]*\\])|\\s+(?=but\\b)"
DENIALS = ("dont have that", "do not have that")
#: Openings of lines that were computed, which are quoted whole.
COMPUTED = "^(?:condition check \\(computed\\) for |[a-z][a-z0-9_]* (?:today|from \\d{4}-\\d{2}-\\d{2}) = )"


def pieces(text: Column, end: str) -> Column:
    """array<struct<text, sep>>: a text cut at its separators; all texts and separators in order are the text."""
    marked = F.split(F.regexp_replace(text, f"({end})", f"{OPEN}$1{CLOSE}"), CLOSE)
    return F.transform(marked, lambda p: F.struct(F.split_part(p, F.lit(OPEN), F.lit(1)).alias("text"), F.split_part(p, F.lit(OPEN), F.lit(2)).alias("sep")))


def denies(text: Column) -> Column:
    """Does it say "I don't have that"?  Marks and case don't matter, words do."""
    bare = F.regexp_replace(F.lower(text), "['’]", "")
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " ")), F.lit(" "))
    return words.contains(f" {DENIALS[0]} ") | words.contains(f" {DENIALS[1]} ")


def closed_up(text: Column) -> Column:
    return F.regexp_replace(text, "\\s+(?=[.!?,;:]|$)", "")


def uncited(text: Column) -> Column:
    return F.regexp_replace(text, CITATION, "")


def only_cites(text: Column) -> Column:
    return (F.trim(text) != "") & ~uncited(text).rlike("(?U)\\w")


def without_citations_of_denials(text: Column) -> Column:
    """Citations go from clauses that deny having something, and from a piece of citations only that follows one."""
    clean = lambda c: F.when(c.rlike(CITATION) & denies(c), closed_up(uncited(c))).otherwise(c)
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("sep"), F.lit(False).alias("after"))

    def step(s: Column, p: Column) -> Column:
        clauses = F.array_join(F.transform(pieces(p["text"], CLAUSE_END), lambda c: F.concat(clean(c["text"]), c["sep"])), "")
        gone = s["after"] & only_cites(p["text"])
        return F.struct(
            F.when(gone, s["done"]).otherwise(F.concat(s["done"], s["sep"], clauses)).alias("done"),
            p["sep"].alias("sep"),
            F.when(F.trim(p["text"]) == "", s["after"]).otherwise(F.when(gone, s["after"]).otherwise(denies(p["text"]))).alias("after"),
        )

    return F.aggregate(pieces(text, SENTENCE_END), start, step, lambda s: F.concat(s["done"], s["sep"]))


def content(text: Column) -> Column:
    """Tokens that say something: no lone letter."""
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) > 1) | t.rlike("^\\d$")))


def without_unrelated(answers: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """key, text, n_dropped of answers (key, text): a citation goes if its chunk (key, n, text) shares no content
    with the piece that cites it, a piece of citations only counting as part of the one before it.  Numbers of
    no chunk stay."""
    cut = spread(answers, key).select(key, F.posexplode(pieces(F.col("text"), SENTENCE_END)).alias("pos", "p")).select(key, "pos", "p.*")
    own = cut.withColumn("words", content(uncited(F.col("text"))))
    said = F.last(F.when(F.size("words") > 0, F.col("words")), ignorenulls=True).over(Window.partitionBy(key).orderBy("pos"))
    own = own.withColumn("words", F.coalesce(said, F.array().cast("array<string>")))
    cited = own.select(key, "pos", "words", F.explode(cited_numbers(F.col("text"))).alias("n"))
    known = spread(chunks, key).select(key, "n", content(F.col("text")).alias("chunk_words"))
    bad = cited.join(known, [key, "n"]).filter(~F.arrays_overlap("words", "chunk_words"))
    bad = bad.groupBy(key, "pos").agg(F.collect_set("n").alias("bad"), F.count(F.lit(1)).alias("dropped"))
    joined = own.drop("words").join(bad, [key, "pos"], "left")

    def pruned(p: Column) -> Column:
        numbers = F.split(F.regexp_extract(p["sep"], CITATION, 1), "\\s*,\\s*")
        keep = F.filter(numbers, lambda n: ~F.array_contains("bad", n.cast("int")))
        new = F.when(F.size(keep) == F.size(numbers), p["sep"]).when(F.size(keep) > 0, F.concat(F.lit("["), F.array_join(keep, ", "), F.lit("]"))).otherwise("")
        return F.concat(p["text"], F.when(p["sep"] == "", "").otherwise(new))

    new = closed_up(F.array_join(F.transform(pieces(F.col("text"), CITATION.replace("(\\d", "(?:\\d")), pruned), ""))
    rows = joined.select(key, "pos", "sep", F.when(F.col("bad").isNotNull(), new).otherwise(F.col("text")).alias("text"), F.coalesce("dropped", F.lit(0)).alias("dropped"), F.col("bad").isNotNull().alias("changed"))
    cells = F.sort_array(F.collect_list(F.struct("pos", "text", "sep", "changed")))
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("sep"))

    def step(s: Column, p: Column) -> Column:
        emptied = p["changed"] & (F.trim(p["text"]) == "")  # the separator before it goes too
        return F.struct(F.concat(s["done"], F.when(emptied, "").otherwise(s["sep"]), p["text"]).alias("done"), p["sep"].alias("sep"))

    return rows.groupBy(key).agg(F.aggregate(cells, start, step, lambda s: F.concat(s["done"], s["sep"])).alias("text"), F.sum("dropped").alias("n_dropped"))


def cut_at_word(text: Column, limit: int = QUOTE) -> Column:
    head = F.substring(text, 1, limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.coalesce(F.nullif(F.regexp_extract(head, "(?s)^(.*) ", 1), F.lit("")), head))


def cited_quotes(answers: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """key, n, quote of the cited chunks: the sentence of the chunk that shares most tokens with the sentences of the
    answer that cite it, the first on a tie, cut at a word; a computed line is quoted whole."""
    said = answers.select(key, F.explode(sentences(F.col("text"))).alias("s"))
    citing = said.select(key, F.explode(cited_numbers(F.col("s"))).alias("n"), tokens(uncited(F.col("s"))).alias("t"))
    wanted = citing.groupBy(key, "n").agg(F.array_distinct(F.flatten(F.collect_set("t"))).alias("wanted"))
    split = sentences(F.col("text"))
    own = chunks.select(key, "n", F.col("text").alias("whole"), F.posexplode(F.when(F.col("text").rlike(COMPUTED) | (F.size(split) == 0), F.array("text")).otherwise(split)).alias("pos", "s"))
    own = own.withColumn("t", F.array_distinct(tokens(F.col("s")))).join(wanted, [key, "n"])
    best = F.max_by(F.struct("whole", "s"), F.struct(F.size(F.array_intersect("t", "wanted")), -F.col("pos")))
    found = own.groupBy(key, "n").agg(best.alias("b"))
    return found.select(key, "n", F.when(F.col("b.whole").rlike(COMPUTED), F.col("b.whole")).otherwise(F.trim(cut_at_word(F.col("b.s")))).alias("quote"))
