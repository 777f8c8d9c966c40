"""Language ID by a linear-chain conditional random field over words.

Each word has affix features (its first and last one to three letters), hashed letter n-grams and
a lexicon feature; the weights and the transitions between languages are learned together by
gradient ascent on the conditional log-likelihood.  Training sequences are code-switched: stretches
of words of documents of different languages, one after another, so the word labels and the
switches are known.  Forward-backward over every word of a text gives each word's language
distribution; the text's language is that with the largest mean over its words with letters, and
that mean is the score.

The fit uses a bounded sample: of every language PER_LANGUAGE documents, or an equal part of SAMPLE
where there are many languages, those with the least hash of id and text; of a text at most STRETCHES
stretches of words reach the driver.  Prediction reads whole texts.

Defined cases: a null text or one without a letter is `und` with score 0; without any training row
everything is `und`; equal means are decided by the language's code point order; rows with a null id
are learned from and predicted like others, and aren't held out; rows are independent, so repeated
rows, empty tables and further columns need no rule (clashing columns are replaced).
"""

from __future__ import annotations

import hashlib
import io
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, join_group_values

#: Training documents of a language, and of all languages; stretches of a long text and their words.
PER_LANGUAGE, SAMPLE, STRETCHES, WORDS = 250, 25_000, 16, 24
LEXICON = 4000
AFFIX_BINS, GRAM_BINS = 1 << 13, 1 << 15
SEQUENCES, LENGTH, STRETCH = 1500, 60, 12
STEPS, RATE, DECAY = 45, 0.12, 1e-3
UNDETERMINED = "und"
#: Words times languages of texts whose chains are walked together.
TOGETHER = 4_000_000
#: Characters of words that are no letters: digits, fractions, raised and Roman numbers.
NUMBERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha())
LETTER = re.compile(f"[^\\W{NUMBERS}_]")
EDGE = re.compile(f"^[\\W{NUMBERS}_]+|[\\W{NUMBERS}_]+$")


class Crf:
    def __init__(self, languages: list[str], lexicon: dict[str, int]) -> None:
        self.languages, self.lexicon = languages, lexicon
        n = len(languages)
        self.affix = np.zeros((AFFIX_BINS, n), np.float32)
        self.gram = np.zeros((GRAM_BINS, n), np.float32)
        self.lex = np.zeros((len(lexicon) + 1, n), np.float32)  # the last: not in the lexicon
        self.switch = np.zeros((n, n), np.float32)
        self.start = np.zeros(n, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.affix, self.gram, self.lex, self.switch, self.start]

    def moves(self) -> np.ndarray:
        """Transition potentials, the largest of all 1."""
        return np.exp(np.maximum(self.switch - self.switch.max(), -40))

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, names=np.array([*self.languages]), words=np.array([*self.lexicon]), **dict(zip("abcde", self.weights())))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Crf:
        found = np.load(io.BytesIO(data))
        crf = cls(found["names"].tolist(), {w: i for i, w in enumerate(found["words"].tolist())})
        crf.affix, crf.gram, crf.lex, crf.switch, crf.start = (found[k] for k in "abcde")
        return crf


def cleaned(token: str) -> str:
    """The word of a token: lower case without marks and digits at its ends; "" without a letter."""
    if token.isalpha():
        return token
    return EDGE.sub("", token) if LETTER.search(token) else ""


def features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By classes of length: numbers of words, their affix bins, n-gram bins, and a mask of those."""
    sizes = np.array([len(w) for w in words])
    width = 8
    low = 0
    while low < (sizes.max() if len(sizes) else 0):
        at = np.flatnonzero((sizes > low) & (sizes <= width))
        low, wide = width, width
        width *= 2
        for k in range(0, len(at), max(1, 2_000_000 // wide)):
            some = at[k : k + max(1, 2_000_000 // wide)]
            letters = np.array([words[i] for i in some], dtype=f"U{wide}").view(np.uint32).reshape(len(some), wide).astype(np.uint64)
            n = sizes[some]
            rows = np.arange(len(some))
            heads, tails = [], []
            head = tail = np.zeros(len(some), np.uint64)
            for j in range(3):
                inside = n > j
                head = np.where(inside, head * np.uint64(8191) + letters[:, j] + np.uint64(1), head)
                tail = np.where(inside, tail * np.uint64(8191) + letters[rows, np.maximum(n - 1 - j, 0)] + np.uint64(1), tail)
                heads.append(hashed(head * np.uint64(8) + np.uint64(j), AFFIX_BINS))
                tails.append(hashed(tail * np.uint64(8) + np.uint64(j + 4), AFFIX_BINS))
            place = np.arange(wide)
            two = letters[:, :-1] * np.uint64(65599) + letters[:, 1:]
            three = two[:, :-1] * np.uint64(65599) + letters[:, 2:]
            grams = np.concatenate([hashed(two * np.uint64(2), GRAM_BINS), hashed(three * np.uint64(2) + np.uint64(1), GRAM_BINS)], axis=1)
            mask = np.concatenate([place[None, 1:] < n[:, None], place[None, 2:] < n[:, None]], axis=1)
            yield some, np.stack(heads + tails, axis=1), grams, mask


def hashed(x: np.ndarray, bins: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (bins - 1)


def potentials(crf: Crf, words: list[str]) -> np.ndarray:
    """Log potentials of distinct words; "" has none."""
    out = np.zeros((len(words), len(crf.languages)), np.float32)
    gram = np.concatenate([crf.gram, np.zeros((1, out.shape[1]), np.float32)])
    for some, affixes, grams, mask in features(words):
        total = crf.affix[affixes[:, 0]]
        for j in range(1, affixes.shape[1]):
            total = total + crf.affix[affixes[:, j]]
        grams = np.where(mask, grams, GRAM_BINS)
        for j in range(grams.shape[1]):
            if mask[:, j].any():
                total += gram[grams[:, j]]
        out[some] = total
    known = np.array([crf.lexicon.get(w, len(crf.lexicon)) for w in words], np.int64)
    out += crf.lex[known]
    out[[i for i, w in enumerate(words) if not w]] = 0
    return out


def scaled(log: np.ndarray) -> np.ndarray:
    """Potentials with the largest of each row 1; never 0, so no chain dies."""
    return np.exp(np.maximum(log - log.max(axis=-1, keepdims=True), -40))


def walk(crf: Crf, emission: np.ndarray, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, each=None, labels: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward over texts in order of falling size: word i of text k is ids[starts[k] + i],
    emission holds its potentials.  Returns the sum of the marginals of each text; `each` is told
    the marginals of every step, labels are filled with the likeliest language of every word."""
    move, n = crf.moves(), len(crf.languages)
    first = scaled(crf.start)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts longer than t
    forward = np.empty((len(ids), n), np.float32)
    alpha = np.empty((0, n), np.float32)
    for t in range(longest):
        k = active[t]
        at = starts[:k] + t
        e = emission[ids[at]]
        alpha = e * first if t == 0 else e * (alpha[:k] @ move)
        alpha /= alpha.sum(axis=1, keepdims=True)
        forward[at] = alpha
    total = np.zeros((len(sizes), n))
    beta = np.ones((len(sizes), n), np.float32)
    back = move.T.copy()
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        b = beta[:k]
        marginal = forward[at] * b
        marginal /= marginal.sum(axis=1, keepdims=True)
        word = ids[at]
        if labels is not None:
            labels[at] = np.where(word == 0, -1, marginal.argmax(axis=1))
        if each is not None:
            each(t, at, marginal, forward, b)
        else:
            marginal[word == 0] = 0  # 0 is the token without a letter
        total[:k] += marginal
        b = (b * emission[word]) @ back
        beta[:k] = b / b.sum(axis=1, keepdims=True)
    return total


def trained(rows: list[tuple[list[str], str]], seed: int = 7) -> Crf | None:
    """Fit on (stretches, language) rows in a fixed order; a stretch holds words of a text."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    of = {lang: [] for lang in languages}
    counts: Counter[str] = Counter()
    for stretches, lang in rows:
        found = [[w for w in map(cleaned, stretch.lower().split()) if w] for stretch in stretches]
        counts.update({w for words in found for w in words})
        if any(found):
            of[lang].append([words for words in found if words])
    languages = [lang for lang in languages if of[lang]]
    if not languages:
        return None
    lexicon = {w: i for i, (w, c) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]) if c > 2}
    crf = Crf(languages, lexicon)
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {"": 0}
    ids, labels = np.empty((SEQUENCES, LENGTH), np.int64), np.empty((SEQUENCES, LENGTH), np.int64)
    for s in range(SEQUENCES):
        at = 0
        while at < LENGTH:
            lang = int(rng.integers(len(languages)))
            stretches = of[languages[lang]][int(rng.integers(len(of[languages[lang]])))]
            words = stretches[int(rng.integers(len(stretches))) if len(stretches) > 1 else 0]
            n = min(int(rng.geometric(1 / STRETCH)), LENGTH - at)
            i = int(rng.integers(max(1, len(words) - n + 1)))
            some = words[i : i + n]
            ids[s, at : at + len(some)] = [number.setdefault(w, len(number)) for w in some]
            labels[s, at : at + len(some)] = lang
            at += len(some)
    fit(crf, [*number], ids, labels)
    return crf


def fit(crf: Crf, words: list[str], ids: np.ndarray, labels: np.ndarray) -> None:
    """Adam on the conditional log-likelihood of equally long sequences, with weight decay."""
    n, (many, long) = len(crf.languages), ids.shape
    spread = [*features(words)]
    known = np.array([crf.lexicon.get(w, len(crf.lexicon)) for w in words])
    starts, sizes, flat = np.arange(many) * long, np.full(many, long), ids.ravel()
    gold = np.eye(n, dtype=np.float32)[labels]
    observed = np.zeros((n, n))
    np.add.at(observed, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1)
    weights = crf.weights()
    moment = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for step in range(1, STEPS + 1):
        emission = scaled(potentials(crf, words)).astype(np.float32)
        marginals, expected = np.empty((many * long, n), np.float32), np.zeros((n, n))
        move = crf.moves()

        def each(t, at, marginal, forward, beta):
            marginals[at] = marginal
            if t:
                pair = forward[at - 1][:, :, None] * move[None] * (beta * emission[flat[at]])[:, None, :]
                pair /= pair.sum(axis=(1, 2), keepdims=True)
                expected[:] += pair.sum(axis=0)

        walk(crf, emission, flat, starts, sizes, each)
        error = (gold.reshape(-1, n) - marginals) / many
        by_word = np.stack([np.bincount(flat, weights=error[:, j], minlength=len(words)) for j in range(n)], axis=1).astype(np.float32)
        gradient = [np.zeros_like(w) for w in weights]
        for some, affixes, grams, mask in spread:
            g = by_word[some]
            rows = np.broadcast_to(np.arange(len(some))[:, None], grams.shape)[mask]
            for j in range(n):
                gradient[0][:, j] += np.bincount(affixes.ravel(), weights=np.repeat(g[:, j], affixes.shape[1]), minlength=AFFIX_BINS)
                gradient[1][:, j] += np.bincount(grams[mask], weights=g[rows, j], minlength=GRAM_BINS)
        np.add.at(gradient[2], known, by_word)
        gradient[3] += ((observed - expected) / many).astype(np.float32)
        gradient[4] += (gold[:, 0].mean(axis=0) - marginals.reshape(many, long, n)[:, 0].mean(axis=0)).astype(np.float32)
        for w, g, (m, v) in zip(weights, gradient, moment):
            g -= DECAY * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def spans(labels: np.ndarray, languages: list[str]) -> list[dict]:
    """Runs of words of one language; words without a letter belong to the run before them."""
    place = np.flatnonzero(labels >= 0)
    heads = np.flatnonzero(np.r_[True, np.diff(labels[place]) != 0]) if len(place) else place
    begins = place[heads].tolist()
    return [{"lang": languages[labels[b]], "first": b, "last": e - 1} for b, e in zip(begins, [*begins[1:], len(labels)])]


def predicted(crf: Crf | None, texts: list[str | None], runs: list | None = None) -> tuple[list[str], list[float]]:
    """Languages and scores of whole texts; runs, a list of as many items, is filled with their spans."""
    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if crf is None:
        return names, scores
    together = max(1, TOGETHER // len(crf.languages))
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i] or ""))
    at = 0
    while at < len(order):
        number: dict[str, int] = {}
        lists, chosen, used = [], [], 0
        while at < len(order) and (not chosen or used < together):
            words = (texts[order[at]] or "").lower().split()
            lists.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
            chosen.append(order[at])
            used += len(words)
            at += 1
        distinct: dict[str, int] = {"": 0}
        of_token = np.fromiter((distinct.setdefault(cleaned(w), len(distinct)) for w in number), np.int64, len(number))
        emission = scaled(potentials(crf, [*distinct])).astype(np.float32)
        sizes = np.array([len(x) for x in lists], np.int64)
        by_size = np.argsort(-sizes, kind="stable")
        ids = of_token[np.concatenate(lists)] if used else np.empty(0, np.int64)
        starts = np.cumsum(np.r_[0, sizes[:-1]])[by_size]
        labels = np.empty(len(ids), np.int64) if runs is not None else None
        total = walk(crf, emission, ids, starts, sizes[by_size], labels=labels)
        if runs is not None:
            for k, start in zip(by_size, starts):
                runs[chosen[k]] = spans(labels[start : start + sizes[k]], crf.languages)
        for k, row in zip(by_size, total):
            if (whole := row.sum()) > 0:
                best = int(row.argmax())
                names[chosen[k]], scores[chosen[k]] = crf.languages[best], float(min(1.0, row[best] / whole))
    return names, scores


def remainder(column: str, divisor: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def stretches(text: Column) -> tuple[Column, Column]:
    """The words of a text; and, of those as __words: all in one stretch, of a long text STRETCHES stretches
    of WORDS words spread over it."""
    words = F.split(F.trim(text), "\\s+")
    step = (F.size("__words") - WORDS) / STRETCHES
    some = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda k: F.array_join(F.slice("__words", F.floor(k * step).cast("int") + 1, F.lit(WORDS)), " "))
    return words, F.when(F.size("__words") <= STRETCHES * WORDS, F.array(F.array_join("__words", " "))).otherwise(some)


def training_rows(docs: DataFrame, usable, text: str = "text", lang: str = "lang") -> list[tuple[list[str], str]]:
    """A bounded sample of (stretches of words, language): of every language of the usable rows those with
    the least hash.  Rates leave about twice the wanted rows, so no language is ordered whole."""
    rows = docs.filter(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = cut(rows.groupBy(lang).agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed(lang, "__lang"))
    wanted = max(1, min(PER_LANGUAGE, SAMPLE // max(1, counts.count())))
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    some = rows.select(F.col("doc_id").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("__lang")).withColumn("__share", share)
    few = join_group_values(some, counts, ["__lang"], F.col("__share")).filter(F.col("__share") * F.col("__n") < 2 * wanted + 20)
    words, chosen = stretches(F.col("text"))
    made = few.withColumn("__words", words).select("__lang", "__share", "doc_id", chosen.alias("stretches"))
    first = F.row_number().over(Window.partitionBy("__lang").orderBy("__share", "doc_id"))
    found = made.withColumn("__r", first).filter(F.col("__r") <= wanted).select("__lang", "__r", "stretches").collect()  # SAMPLE short rows
    return [(r["stretches"], r["__lang"]) for r in sorted(found, key=lambda r: (r["__lang"], r["__r"]))]


_LOADED: dict[str, Crf] = {}


def loaded(data: bytes) -> Crf | None:
    if not data:
        return None
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Crf.load(data)
    return _LOADED[key]


SPANS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


def identify(docs: DataFrame, crf: Crf | None, text: str = "text", with_spans: bool = False) -> DataFrame:
    """Add lang_pred and score to all rows, and spans if asked: runs of words (numbered from 0) of one language."""
    model = docs.sparkSession.sparkContext.broadcast(crf.save() if crf else b"")
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())] + [T.StructField("spans", SPANS)] * with_spans
    names_added = [f.name for f in added]
    keep = [f for f in docs.schema.fields if f.name not in names_added]
    passed = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = loaded(model.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            runs = [[] for _ in texts] if with_spans else None
            names, scores = predicted(fitted, texts, runs)
            made = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            if with_spans:
                made.append(pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in passed] + made, names=[*passed, *names_added])

    return docs.mapInArrow(run, T.StructType(keep + added))


def language_id(docs: DataFrame, text: str = "text", lang: str = "lang", folds: int = 4, held: int = 2, with_spans: bool = False) -> DataFrame:
    """docs with held_out, lang_pred and score (and spans); learned from the rows that aren't held out."""
    held_out = F.coalesce(remainder("doc_id", folds) == held, F.lit(False))
    crf = trained(training_rows(docs, ~held_out, text, lang))
    return identify(docs.withColumn("held_out", held_out), crf, text, with_spans)
