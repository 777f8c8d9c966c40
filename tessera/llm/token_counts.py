"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch lie in one flat numpy array of symbols with the number of their sequence.
In each round every sequence merges its own lowest-rank pair, all sequences at once; when no pair
can be merged the surviving symbols are counted.  A text's count is the sum over its pre-tokens.
A sequence of over LONG letters has an array of its own, with the places of each rank in a queue, so
that a round costs what it changes and not the sequence's length.

Texts are cut where no piece of the vocabulary can lie across: before a space mark, and between two
letters that no piece holds side by side.  So counts of the parts add up exactly.

Defined cases: a null or empty text has 0 tokens; letters outside the vocabulary count one token a
UTF-8 byte (byte fallback); rows are independent, so ties, repeats, empty tables and more columns
change nothing, and a clashing input column is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE_MARK = "▁"
LIMIT = 4096
#: Pre-tokens in each of a worker's two generations of memo, and the longest that it keeps.
MEMO, MEMO_CHARS = 500_000, 48
NONE = np.iinfo(np.int64).max
LONG = 256


class Pieces:
    """A BPE vocabulary of the sentencepiece format: pieces with scores, byte fallback."""

    def __init__(self, source: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(source)
        kinds = proto.SentencePiece
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("only the identity normaliser with byte fallback is supported")
        self.prefix = " " if spec.add_dummy_prefix else ""
        ranked = sorted((x for x in proto.pieces if x.type in (kinds.NORMAL, kinds.USER_DEFINED)), key=lambda x: -x.score)
        if any(x.type == kinds.USER_DEFINED for x in ranked):
            raise ValueError("user-defined pieces are not supported")
        rank = {x.piece: i for i, x in enumerate(ranked)}
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in rank):
            raise ValueError("pieces across words are not supported")
        #: symbols: ranks of pieces; letters outside the vocabulary get numbers above.
        self.rank, self.size = rank, len(rank)
        self.beside = {p[i : i + 2] for p in rank for i in range(len(p) - 1)}
        # every split of a piece into two pieces or letters is a pair that merges to it
        keys, merged = [], []
        self.letters: dict[str, int] = {c: rank[c] for c in rank if len(c) == 1}
        for p in rank:
            for c in p:
                self.letters.setdefault(c, self.size + len(self.letters))
        self.base = max(self.letters.values(), default=0) + self.size + 2
        for p, r in rank.items():
            for k in range(1, len(p)):
                a, b = self.symbol(p[:k]), self.symbol(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.base + b)
                    merged.append(r)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]
        # a merge can be applied to all its places at once if no better pair can come of it
        best = np.full(self.base, NONE, np.int64)
        for side in (self.keys // self.base, self.keys % self.base):
            np.minimum.at(best, side, self.merged)
        self.all_at_once = best[: self.size] > np.arange(self.size)
        self.memo: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def symbol(self, part: str) -> int | None:
        return self.letters.get(part) if len(part) == 1 else self.rank.get(part)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def count(self, sequences: list[str]) -> np.ndarray:
        """Surviving symbols of each sequence, bytes of unknown letters included."""
        long = [i for i, s in enumerate(sequences) if len(s) > LONG]
        if not long:
            return self.count_short(sequences)
        total = np.zeros(len(sequences), np.int64)
        total[long] = [self.count_long(sequences[i]) for i in long]
        short = [i for i, s in enumerate(sequences) if len(s) <= LONG]
        if short:
            total[short] = self.count_short([sequences[i] for i in short])
        return total

    def spelled(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of a text's letters and the tokens that each is if nothing merges it: a letter without a
        piece of its own is a fallback of its bytes."""
        unknown = self.base - 1
        kinds = {c: (self.letters.get(c, unknown), 1 if self.letters.get(c, unknown) < self.size else len(c.encode("utf-8", "surrogatepass"))) for c in set(text)}
        both = np.array([kinds[c] for c in text], np.int64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()

    def count_long(self, text: str) -> int:
        symbols, width = self.spelled(text)
        n = len(symbols)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        queue: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def push(places: np.ndarray) -> None:
            ranks = self.pair_ranks(symbols[places], symbols[after[places]])
            places, ranks = places[ranks != NONE], ranks[ranks != NONE]
            order = np.argsort(ranks, kind="stable")
            kinds, starts = np.unique(ranks[order], return_index=True)
            for rank, some in zip(kinds.tolist(), np.split(places[order], starts[1:])):
                if rank not in queue:
                    queue[rank] = []
                    heapq.heappush(heap, rank)
                queue[rank].append(some)

        push(np.arange(n - 1))
        while heap:
            rank = heapq.heappop(heap)
            at = np.unique(np.concatenate(queue.pop(rank)))
            at = at[alive[at]]
            at = at[after[at] < n]
            at = at[self.pair_ranks(symbols[at], symbols[after[at]]) == rank]
            if not len(at):
                continue
            if self.all_at_once[rank]:  # of touching places every second one, from the left
                place = np.arange(len(at))
                begun = np.r_[True, at[1:] != after[at[:-1]]]
                at = at[(place - np.maximum.accumulate(np.where(begun, place, 0))) % 2 == 0]
            elif len(at) > 1:
                queue[rank] = [at[1:]]
                heapq.heappush(heap, rank)
                at = at[:1]
            right = after[at]
            symbols[at], width[at], alive[right] = rank, 1, False
            after[at] = after[right]
            inside = after[at] < n
            before[after[at[inside]]] = at[inside]
            near = np.concatenate([at[inside], before[at][before[at] >= 0]])
            push(np.unique(near))
        return int(width[alive].sum())

    def count_short(self, sequences: list[str]) -> np.ndarray:
        letters, unknown = self.letters, self.base - 1
        sizes = np.array([len(s) for s in sequences], np.int64)
        symbols = np.array([letters.get(c, unknown) for s in sequences for c in s], np.int64)
        owner = np.repeat(np.arange(len(sequences)), sizes)
        # a letter without a piece of its own stays a fallback of its bytes unless it is merged
        width = np.fromiter((1 if letters.get(c, unknown) < self.size else len(c.encode("utf-8", "surrogatepass")) for s in sequences for c in s), np.int64, len(symbols))
        total = np.zeros(len(sequences), np.int64)
        while len(symbols):
            ranks = np.full(len(symbols), NONE, np.int64)
            if len(symbols) > 1:
                ranks[:-1] = np.where(owner[:-1] == owner[1:], self.pair_ranks(symbols[:-1], symbols[1:]), NONE)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(symbols)])
            low = np.minimum.reduceat(ranks, starts)
            each = np.repeat(low, lengths)
            alive = each != NONE
            if not alive.all():
                done = ~alive
                total += np.bincount(owner[done], weights=width[done], minlength=len(total)).astype(np.int64)
                symbols, owner, width, ranks, each = symbols[alive], owner[alive], width[alive], ranks[alive], each[alive]
                if not len(symbols):
                    break
            hit = np.flatnonzero(ranks == each)
            first = np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]
            # of touching places in a run only every second one, from the left
            run = np.r_[True, (hit[1:] != hit[:-1] + 1) | first[1:]]
            in_run = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            take = hit[first | (self.all_at_once[each[hit]] & (in_run % 2 == 0))]
            symbols[take], width[take] = each[take], 1
            stay = np.ones(len(symbols), bool)
            stay[take + 1] = False
            symbols, owner, width = symbols[stay], owner[stay], width[stay]
        return total

    def parts(self, word: str) -> list[str]:
        """Cut a long word between letters that no piece holds side by side."""
        beside, out, at = self.beside, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in beside:
                out.append(word[at:i])
                at = i
        return [*out, word[at:]]

    def words(self, text: str) -> list[str]:
        """Pre-tokens without their first space mark; a run of marks keeps all but its last one."""
        return (self.prefix + text.replace(SPACE_MARK, " ")).split(" ")

    def counts(self, texts: list[str]) -> list[int]:
        memo = self.memo
        split = [self.words(t) if t else [] for t in texts]
        new = {w for ws in split for w in ws if w not in memo}
        local: dict[str, int] = {}  # what this batch needs beside the memo
        if len(memo) + len(new) > MEMO:  # words in use move over, the others go
            self.old, self.memo = memo, {}
            memo = self.memo
            new = {w for ws in split for w in ws}
        old = self.old
        for w in new if old else ():
            if w in old:
                memo[w] = old[w]
        new = [w for w in new if w not in memo]
        todo = sorted(new)
        for i in range(0, len(todo), 20_000):
            some = todo[i : i + 20_000]
            owners, parts = [], []
            for k, w in enumerate(some):
                found = self.parts(SPACE_MARK + w)
                parts += found
                owners += [k] * len(found)
            summed = np.bincount(owners, weights=self.count(parts), minlength=len(some)).astype(int).tolist()
            for w, n in zip(some, summed):
                (memo if len(w) <= MEMO_CHARS and len(memo) < MEMO else local)[w] = n
        out = []
        for text, ws in zip(texts, split):
            out.append(self.total(text, ws, memo, local))
        return out

    def total(self, text: str, ws: list[str], memo: dict[str, int], local: dict[str, int]) -> int:
        if not text:
            return 0
        start = 0 if self.prefix else len(ws[0])  # without a prefix the first word has no mark
        if "" in ws[1 if self.prefix else 0 :] or start:
            return self.spaced(text)
        if local:
            return sum([memo[w] if w in memo else local[w] for w in ws[1:]])
        return sum(map(memo.__getitem__, ws[1:]))

    def spaced(self, text: str) -> int:
        """A text with runs of spaces: pre-tokens are a whole run of marks and the letters after it."""
        marked = (self.prefix + text).replace(" ", SPACE_MARK)
        found = re.findall(f"{SPACE_MARK}+[^{SPACE_MARK}]*|[^{SPACE_MARK}]+", marked)
        names = dict.fromkeys(found)
        owners, parts = [], []
        for k, w in enumerate(names):
            cut = self.parts(w)
            parts += cut
            owners += [k] * len(cut)
        summed = np.bincount(owners, weights=self.count(parts), minlength=len(names)).astype(int).tolist()
        of = dict(zip(names, summed))
        return sum(map(of.__getitem__, found))


_LOADED: dict[str, Pieces] = {}


def loaded(source: bytes) -> Pieces:
    key = hashlib.sha256(source).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Pieces(source)
    return _LOADED[key]


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text."""
    with open(vocabulary, "rb") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    names = [f.name for f in added]
    keep = [f for f in docs.schema.fields if f.name not in names]
    passed = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(source.value)
        for batch in batches:
            n_bytes, n_tokens = [], []
            column = batch.column(batch.schema.get_field_index(text))
            for i in range(0, len(column), 1000):
                texts = [t or "" for t in column.slice(i, 1000).to_pylist()]
                n_bytes += [len(t.encode("utf-8")) for t in texts]
                n_tokens += pieces.counts(texts)
            made = [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in passed] + made, names=passed + names)

    return docs.mapInArrow(run, T.StructType(keep + added))
