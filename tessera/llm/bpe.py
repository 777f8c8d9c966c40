"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each pre-token is a row of symbols.  Leaf i of the tree holds (rank of the pair that starts at
symbol i, i), so the root is the leftmost lowest-rank merge; a merge changes at most three leaves,
each in logarithmic time, until no pair of the row can be merged.  The trees of many short words
are arrays that are updated together; a long word has a tree of its own.  Pre-tokens never cross
white space, so whole texts are encoded chunk by chunk with a bounded memo of chunks a worker has seen.

Defined cases: null text is the empty text (no ids, decoded ""); strings of the vocabulary's added
tokens inside a text are those tokens; rows are independent, so ties, repeated rows, empty tables
and further columns need no rule: every input column is kept, and an output column that clashes
with an input column replaces it.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Chunks in each of the two generations that a Python worker remembers.
MEMO = 100_000
#: Longer chunks are encoded each time, to bound the memo's bytes.
MEMO_CHARS = 64
#: Letters of texts whose new chunks are encoded together, and the longest words of a forest.
TOGETHER, FOREST = 2_000_000, 64
#: White space of the vocabulary's pattern (the Unicode property).
SPACE = "\t-\r\\x20\x85\xa0  -     　"
#: Characters that str.split() takes for white space and the pattern doesn't.
NOT_SPACE = frozenset("\x1c\x1d\x1e\x1f")
# What the library's Unicode tables (16.0) and lower-case table (17.0) have differently
# from the regex module's and Python's.
#: Letters and numbers of later Unicode versions; unassigned, so symbols, to the library.
LATER = regex.compile(
    "[\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959"
    "\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2"
    "\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    "\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f]"
)
#: Capitals that Python's lower() doesn't know yet.
LATER_CAPITALS = regex.compile("[\u1c89\ua7cb\ua7cc\ua7ce\ua7d2\ua7d4\ua7da\ua7dc\U00010d50-\U00010d65\U00016ea0-\U00016eb8]")
LATER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LATER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Of a chunk: number of ids, ids as text, tokens as text, ids as 32-bit integers.
Piece = tuple[int, str, str, bytes]


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 bytes stand
    for themselves, the others follow from U+0100 on, in order."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(shifted)) for b in range(256)]


def packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def joined(pieces: list[Piece]) -> np.ndarray:
    return np.frombuffer(b"".join([p[3] for p in pieces]), np.int32)


class PairTree:
    """Minimum tree over the leaves rank * size + position; NONE marks a leaf without a merge."""

    NONE = 1 << 62

    def __init__(self, ranks: list[int]) -> None:
        size, none = 1, self.NONE
        while size < len(ranks):
            size *= 2
        self.size = size
        nodes = [none] * size + [none if r < 0 else r * size + i for i, r in enumerate(ranks)] + [none] * (size - len(ranks))
        for k in range(size - 1, 0, -1):
            a, b = nodes[2 * k], nodes[2 * k + 1]
            nodes[k] = a if a < b else b
        self.nodes = nodes

    def put(self, i: int, rank: int) -> None:
        nodes, k = self.nodes, i + self.size
        low = self.NONE if rank < 0 else rank * self.size + i
        if nodes[k] == low:
            return
        nodes[k] = low
        while k > 1:
            other = nodes[k ^ 1]
            k >>= 1
            if other < low:
                low = other
            if nodes[k] == low:
                return
            nodes[k] = low

    def best(self) -> int:
        """Position of the leftmost lowest-rank merge, or -1."""
        root = self.nodes[1]
        return -1 if root == self.NONE else root % self.size


class PairForest:
    """The same tree for many words of at most `size` symbols at once: nodes[k] holds node k of every
    word's tree, leaf i of a word is node size + i."""

    NONE = 1 << 62

    def __init__(self, ranks: np.ndarray) -> None:
        count, self.size = ranks.shape
        self.count = count
        self.nodes = np.full((2 * self.size, count), self.NONE, np.int64)
        self.nodes[self.size :] = np.where(ranks < 0, self.NONE, ranks * self.size + np.arange(self.size)).T
        for k in range(self.size - 1, 0, -1):
            np.minimum(self.nodes[2 * k], self.nodes[2 * k + 1], out=self.nodes[k])
        self.flat = self.nodes.ravel()

    def put(self, trees: np.ndarray, places: np.ndarray, ranks: np.ndarray) -> None:
        self.flat[(places + self.size) * self.count + trees] = np.where(ranks < 0, self.NONE, ranks * self.size + places)

    def mend(self, trees: np.ndarray, places: np.ndarray) -> None:
        """Recompute the paths from changed leaves to the roots, level by level."""
        node, flat, count = (places + self.size) >> 1, self.flat, self.count
        while len(node) and node[0]:  # all leaves are equally deep
            left = 2 * node * count + trees
            flat[node * count + trees] = np.minimum(flat[left], flat[left + count])
            node = node >> 1


class Bpe:
    """A vocabulary in the tokenizers library's JSON format, of the kind with word ends."""

    def __init__(self, source: bytes) -> None:
        spec = json.loads(source)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.token_of = {i: t for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of |= {i: t for t, i in self.added.items()}
        self.base = max(vocab.values()) + 1
        #: rank of the pair of ids (a, b) at a * base + b; the id that the merge of a rank makes
        self.pairs = {vocab[a] * self.base + vocab[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        self.made = [vocab[a + b] for a, b in model["merges"]]
        self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in zip(*sorted(self.pairs.items()))) if self.pairs else (np.zeros(1, np.int64), np.full(1, -1, np.int64))
        self.made_ids = np.array(self.made or [0], np.int64)
        letters = byte_letters()
        self.inner = [vocab.get(c) for c in letters]
        self.last = [vocab.get(c + self.suffix) for c in letters]
        self.inner_ids, self.last_ids = (np.array([-1 if i is None else i for i in x], np.int64) for x in (self.inner, self.last))
        self.names = {i: str(i) for i in self.token_of}
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pretoken = regex.compile(pattern.replace("\\s", SPACE))
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.memo: dict[str, Piece] = {}
        self.old: dict[str, Piece] = {}

    def merge(self, ids: list[int]) -> list[int]:
        n, rank_of, base, made = len(ids), self.pairs.get, self.base, self.made
        if n < 2:
            return ids
        ranks = [rank_of(a * base + b, -1) for a, b in zip(ids, ids[1:])]
        tree = PairTree(ranks)
        after, before, put = [*range(1, n), -1], [*range(-1, n - 1)], tree.put
        while (i := tree.best()) >= 0:
            j = after[i]
            x = ids[i] = made[rank_of(ids[i] * base + ids[j])]
            ids[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                put(j, -1)
                before[k] = i
                put(i, rank_of(x * base + ids[k], -1))
            else:
                put(i, -1)
            if (h := before[i]) >= 0:
                put(h, rank_of(ids[h] * base + x, -1))
        return [x for x in ids if x >= 0]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, -1 for pairs that don't merge."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def grown(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the words in the rows of ids (words x size) until no pair is left; which of them stay."""
        many, size = ids.shape
        place = np.arange(size)
        inside = place[None, :-1] < sizes[:, None] - 1
        ranks = np.full((many, size), -1, np.int64)
        pair = np.flatnonzero(inside.ravel())
        at = pair // (size - 1) * size + pair % (size - 1)
        flat = ids.ravel()
        ranks.ravel()[at] = self.rank_of(flat[at], flat[at + 1])
        forest = PairForest(ranks)
        # links to the next and the last symbol of a word; size and -1 end them
        after = np.where(place[None, :] + 1 < sizes[:, None], place[None, :] + 1, size).ravel()
        before = np.tile(place - 1, many)
        trees = np.flatnonzero(forest.nodes[1] != forest.NONE)
        while len(trees):
            root = forest.nodes[1, trees]
            row, i = trees * size, root % size
            j, x = after[row + i], self.made_ids[root // size]
            k, h = after[row + j], before[row + i]
            flat[row + i], flat[row + j] = x, -1
            after[row + i] = k
            right, left = np.flatnonzero(k < size), np.flatnonzero(h >= 0)
            before[row[right] + k[right]] = i[right]
            none = np.full(len(trees), -1, np.int64)
            forest.put(trees, j, none)
            none[right] = self.rank_of(x[right], flat[row[right] + k[right]])
            forest.put(trees, i, none)
            forest.put(trees[left], h[left], self.rank_of(flat[row[left] + h[left]], x[left]))
            forest.mend(np.concatenate([trees, trees, trees[left]]), np.concatenate([i, j, h[left]]))
            trees = trees[forest.nodes[1, trees] != forest.NONE]
        return flat, (flat.reshape(many, size) >= 0) & (place[None, :] < sizes[:, None])

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and where those of each word start and end; words of up
        to FOREST symbols are merged together."""
        data = [w.encode("utf-8") for w in words]
        letters = np.frombuffer(b"".join(data), np.uint8)
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        ends = np.cumsum(sizes)
        symbols = self.inner_ids[letters]
        symbols[ends - 1] = self.last_ids[letters[ends - 1]]
        known = symbols >= 0  # bytes outside the vocabulary have no symbol
        if not known.all():
            sizes = np.add.reduceat(known.astype(np.int64), ends - sizes)
            symbols, ends = symbols[known], np.cumsum(sizes)
        starts = ends - sizes
        order, counts, kept, low = [np.flatnonzero(sizes == 0)], [np.zeros((sizes == 0).sum(), np.int64)], [], 0
        for size in (1, 4, 8, 16, 32, FOREST):
            at = np.flatnonzero((sizes > low) & (sizes <= size))
            low = size
            if not len(at):
                continue
            order.append(at)
            if size == 1:
                kept.append(symbols[starts[at]])
                counts.append(np.ones(len(at), np.int64))
            else:
                place = np.arange(size)
                rows = np.where(place[None, :] < sizes[at, None], symbols[np.minimum(starts[at, None] + place, len(symbols) - 1)], -1)
                flat, stay = self.grown(rows, sizes[at])
                kept.append(flat[stay.ravel()])
                counts.append(stay.sum(axis=1))
        for w in np.flatnonzero(sizes > FOREST):
            order.append(np.array([w]))
            kept.append(np.array(self.merge(symbols[starts[w] : ends[w]].tolist()), np.int64))
            counts.append(np.array([len(kept[-1])]))
        first, last = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        stops = np.cumsum(np.concatenate(counts))
        last[np.concatenate(order)] = stops
        first[np.concatenate(order)] = stops - np.concatenate(counts)
        return np.concatenate(kept) if kept else np.zeros(0, np.int64), first, last

    def words(self, chunk: str) -> list[str]:
        if chunk.isascii() or not LATER.search(chunk):
            return self.pretoken.findall(chunk)
        return [chunk[m.start() : m.end()] for m in self.pretoken.finditer(LATER.sub("¦", chunk))]

    def learn(self, chunks: set[str]) -> dict[str, Piece]:
        """Pieces of new chunks without white space."""
        number: dict[str, int] = {}
        put = number.setdefault
        spans = [(put(c, len(number)),) if c.isalpha() else [put(w, len(number)) for w in self.words(c)] for c in chunks]
        ids, first, last = self.encode_words([*number])
        blob, ids, join = ids.astype(np.int32).tobytes(), ids.tolist(), " ".join
        names, tokens = [*map(self.names.__getitem__, ids)], [*map(self.token_of.__getitem__, ids)]
        found = [(b - a, join(names[a:b]), join(tokens[a:b]), blob[4 * a : 4 * b]) for a, b in zip(first.tolist(), last.tolist())]
        out = {}
        for chunk, span in zip(chunks, spans):
            if len(span) == 1:
                out[chunk] = found[span[0]]
            else:
                parts = [p for k in span if (p := found[k])[0]]
                out[chunk] = (sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts]), b"".join([p[3] for p in parts]))
        return out

    def chunks(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case letter by letter
            if LATER_CAPITALS.search(text):
                text = text.translate(LATER_LOWER)
        text = text.lower()
        if NOT_SPACE.isdisjoint(text):
            return text.split()
        return [c for c in regex.split(f"[{SPACE}]+", text) if c]

    def parts(self, text: str) -> list[str | int]:
        """Chunks of a text, and the ids of added tokens in it."""
        if self.split_added is None or "<|" not in text and not any(t in text for t in self.added):
            return self.chunks(text)
        out: list[str | int] = []
        for part in self.split_added.split(text):
            out += [self.added[part]] if part in self.added else self.chunks(part)
        return out

    def pieces(self, texts: list[str]) -> Iterator[list[Piece]]:
        """The pieces of each text; the new chunks of texts of up to TOGETHER letters are encoded together."""
        at = 0
        while at < len(texts):
            split, letters = [], 0
            while at < len(texts) and letters < TOGETHER:
                split.append(self.parts(texts[at]))
                letters += len(texts[at])
                at += 1
            used = set().union(*split)
            new, old = used.difference(self.memo), self.old
            if len(self.memo) >= MEMO:  # chunks in use move over, the others go
                self.old = old = self.memo
                self.memo, new = {}, used
            kept = {c: old[c] for c in new if c in old} if old else {}
            kept |= {i: (1, str(i), self.token_of[i], packed([i])) for i in new.intersection(self.added.values())}
            kept |= self.learn(new.difference(kept) if kept else new)
            long = {c: kept.pop(c) for c in [c for c in kept if c not in self.token_of and len(c) > MEMO_CHARS]}
            self.memo |= kept
            for parts in split:
                yield [long[c] if c in long else self.memo[c] for c in parts] if long else [*map(self.memo.__getitem__, parts)]

    def forget(self) -> None:
        """Empty the memo, so that a worker that waits for its next task holds the vocabulary alone."""
        self.memo, self.old = {}, {}
        pa.default_memory_pool().release_unused()

    def encode(self, text: str | None) -> list[int]:
        return joined(next(self.pieces([text or ""]))).tolist()

    def decode(self, ids) -> str:
        """The vocabulary has no decoder: tokens joined by one space."""
        of = self.token_of
        return " ".join([of[i] for i in ids if i in of])


_LOADED: dict[str, Bpe] = {}


def loaded(source: bytes) -> Bpe:
    key = hashlib.sha256(source).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Bpe(source)
    return _LOADED[key]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


#: Output columns by what is asked for.
OUTPUTS = {
    "tokens": [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())],
    "ids": [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType())],
    "digests": [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())],
}


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", outputs: str = "tokens") -> DataFrame:
    """Encode every whole text, decode the ids again.

    vocabulary: path of the JSON file, read on the driver and broadcast (a few MB, fixed by the
    vocabulary).  outputs "tokens" adds n_tokens, ids and decoded; "ids" has the SHA-256 of the
    decoded text in its place, and "digests" that of the joined ids too, so that neither leaves the task.
    """
    with open(vocabulary, "rb") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    added = OUTPUTS[outputs]
    names = {f.name for f in added}
    keep = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType(keep + added)
    passed = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(source.value)
        try:
            for batch in batches:
                n_tokens, first, second = [], [], []
                for found in bpe.pieces([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]):
                    n_tokens.append(sum([p[0] for p in found]))
                    decoded = " ".join([p[2] for p in found if p[0]])
                    second.append(decoded if outputs == "tokens" else sha(decoded))
                    if outputs == "digests":
                        first.append(sha(" ".join([p[1] for p in found if p[0]])))
                    else:
                        first.append(joined(found))
                made = [pa.array(n_tokens, pa.int64()), pa.array(first, pa.string() if outputs == "digests" else pa.list_(pa.int32())), pa.array(second, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in passed] + made, names=passed + [f.name for f in added])
        finally:
            bpe.forget()

    return docs.mapInArrow(run, schema)
