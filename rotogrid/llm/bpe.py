"""Byte-pair encoding of a corpus in numpy: length-bucketed padded matrices of distinct words.

A text is split by rule into words that no merge can cross; the distinct words of a chunk are encoded once. Every
round, each row of a matrix merges its leftmost pair of minimum rank; ranks come from a hash table of pairs, and
rows without a pair leave the matrix.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie by default; every entry point takes another place.
TOKENIZERS = "/opt/tokenizers"
NONE = np.int32(2**31 - 1)
#: Bytes of text encoded together, of one document at least.
CHUNK_BYTES = 4 << 20
#: Distinct words whose tokens a worker keeps between chunks; a speed-up that results don't depend on.
KEPT_WORDS = 400_000
#: Words longer than this many symbols are merged one by one.
LONG = 192
#: Cells of a matrix at most.
CELLS = 1 << 21
WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
MARK, LETTER, NUMBER, SPACE = range(4)


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point: letter (L*), number (N*), white space, or other mark."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = NUMBER
    out[list(WHITE_SPACE)] = SPACE
    return out


class PairTable:
    """Open-addressing hash table of pairs of token ids to the id of their merge, which is also its rank."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)
    EMPTY = np.uint64(2**64 - 1)

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        keys = (left.astype(np.uint64) << np.uint64(24)) | right.astype(np.uint64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, self.EMPTY, np.uint64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == self.EMPTY
            _, first = np.unique(slot[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[slot[placed]] = keys[todo[placed]]
            self.values[slot[placed]] = merged[todo[placed]]
            rest = np.ones(len(todo), bool)
            rest[placed] = False
            todo, slot = todo[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where it can't merge or an id is negative."""
        keys = (left.astype(np.int64).view(np.uint64) << np.uint64(24)) | right.astype(np.int64).view(np.uint64)
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where((there == keys) & (left >= 0) & (right >= 0), self.values[slot], NONE)
        again = np.flatnonzero((there != keys) & (there != self.EMPTY))
        while len(again):
            slot_a, key = (slot[again] + 1) & ((1 << self.bits) - 1), keys[again]
            slot[again] = slot_a
            there = self.keys[slot_a]
            hit = there == key
            at = again[hit]
            out[at] = self.values[slot_a[hit]]
            again = again[~hit & (there != self.EMPTY)]
        bad = (left < 0) | (right < 0)
        if bad.any():
            out[bad] = NONE
        return out


@dataclass
class Vocabulary:
    """A merge table and the rule that splits text into words.

    ``bytewise``: symbols are bytes, words follow the pattern of the rank files. Otherwise symbols are characters,
    a text gets a blank in front, and words end wherever no piece holds the two neighbouring characters.
    """

    name: str
    pairs: PairTable
    bytewise: bool
    first: np.ndarray  # id of each byte, or of each character (-1: none)
    bytes_at: int = 0  # id of byte 0, for characters without an id
    chars: np.ndarray | None = None  # number of each code point within joined, 0: in no piece with another
    joined: np.ndarray | None = None
    rank_of: np.ndarray | None = None  # rank of each id where it isn't the id itself; equal ranks merge from the left
    known: pa.Array | None = None
    tokens: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    ends: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        merged = self.pairs(left, right)
        return merged if self.rank_of is None else np.where(merged == NONE, NONE, self.rank_of[np.where(merged == NONE, 0, merged)])

    # -- encoding of distinct words

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words in a row, and where each word's begin (one more entry than words)."""
        n = len(words)
        offsets = np.frombuffer(words.buffers()[1], np.int32, n + 1, words.offset * 4).astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.empty(0, np.uint8)
        data = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if self.bytewise:
            symbols, starts = self.first[data], offsets
            code = None
        else:
            code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
            lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            starts = lead[offsets]
            symbols = np.where(code == 32, self.first[0x2581], self.first[code])
            # characters without an id stand for themselves below -1
            symbols = np.where(symbols < 0, -2 - code.astype(np.int64), symbols).astype(np.int64)
        sizes = np.diff(starts)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, counts, tokens
        order = np.argsort(sizes, kind="stable")
        sorted_sizes = sizes[order]
        lo = int(np.searchsorted(sorted_sizes, 1))
        while lo < n:
            width = int(sorted_sizes[lo])
            if width > LONG:
                break
            top = width if width <= 8 else min(LONG, -(-width // 8) * 8)
            hi = min(int(np.searchsorted(sorted_sizes, top, "right")), lo + max(1, CELLS // top))
            own = order[lo:hi]
            top = int(sorted_sizes[hi - 1])
            cells = starts[own][:, None] + np.arange(top)
            inside = np.arange(top) < sizes[own][:, None]
            matrix = np.where(inside, symbols[np.minimum(cells, len(symbols) - 1)], -1)
            out += [(own[w], c, t) for w, c, t in self._merge_rows(matrix)]
            lo = hi
        for w in order[lo:]:
            t = self._merge_long(symbols[starts[w] : starts[w + 1]])
            out.append((np.array([w]), np.array([len(t)]), t))
        counts = np.zeros(n, np.int64)
        for w, c, _ in out:
            counts[w] = c
        begin = np.concatenate([[0], np.cumsum(counts)])
        tokens = np.empty(begin[-1], np.int64)
        for w, c, t in out:
            at = np.repeat(begin[w], c) + np.arange(len(t)) - np.repeat(np.cumsum(c) - c, c)
            tokens[at] = t
        if not self.bytewise:
            tokens, begin = self._spell(tokens, begin)
        return tokens.astype(np.int32), begin

    def _merge_rows(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merge all rows (padded with -1) to the end; yields rows, their token counts and tokens."""
        rows = np.arange(len(ids))
        ranks = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while True:
            if ranks.shape[1]:
                at = ranks.argmin(1)
                best = ranks[np.arange(len(ids)), at]
                done = best == NONE
            else:
                done = np.ones(len(ids), bool)
            if done.any():
                part = ids[done]
                full = part != -1
                yield rows[done], full.sum(1), part[full]
                keep = ~done
                ids, ranks, rows = ids[keep], ranks[keep], rows[keep]
                if not len(ids):
                    return
                at, best = at[keep], best[keep]
            n, width = ids.shape
            row = np.arange(n)
            ids[row, at] = best if self.rank_of is None else self.pairs(ids[row, at], ids[row, at + 1])
            keep = np.ones((n, width), bool)
            keep[row, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[row, at] = False
            ranks = ranks[keep].reshape(n, width - 2)
            left = np.flatnonzero(at > 0)
            right = np.flatnonzero(at < width - 2)
            r = np.concatenate([left, right])
            c = np.concatenate([at[left] - 1, at[right]])
            if len(r):
                ranks[r, c] = self.ranks(ids[r, c], ids[r, c + 1])

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long word, by a queue of ranks with their places and links between neighbours: each round merges all places
        of the least rank, so its cost follows the places and not the word. Where a merge could make a pair of no higher
        rank, places merge one by one from the left."""
        n = len(ids)
        ids = np.append(ids, -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[-1] = n
        queue: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def merge(at: np.ndarray) -> np.ndarray:
            """Join each place with its neighbour; the places whose pairs are new."""
            gone = after[at]
            ids[at] = self.pairs(ids[at], ids[gone])
            ids[gone] = -1
            following = after[gone]
            after[at] = following
            before[following[following < n]] = at[following < n]
            return np.unique(np.concatenate([at, before[at][before[at] >= 0]]))

        def one_by_one(rank: int, at: np.ndarray) -> None:
            """Merge the places of a rank from the left until none is left or a lower rank comes up."""
            places = at.tolist()
            while places:
                place = np.array([heapq.heappop(places)])
                if ids[place[0]] == -1 or self.ranks(ids[place], ids[after[place]])[0] != rank:
                    continue
                near = merge(place)
                ranks = self.ranks(ids[near], ids[after[near]])
                for p in near[ranks == rank].tolist():
                    heapq.heappush(places, p)
                if (ranks != rank).any():
                    push(near[ranks != rank])
                if (ranks < rank).any():
                    push(np.array(places, np.int64))
                    return

        def push(places: np.ndarray) -> None:
            ranks = self.ranks(ids[places], ids[after[places]])
            able = ranks != NONE
            places, ranks = places[able], ranks[able]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts)):
                if rank not in queue:
                    queue[rank] = []
                    heapq.heappush(heap, rank)
                queue[rank].append(part)

        push(np.arange(n))
        while heap:
            rank = heapq.heappop(heap)
            at = np.unique(np.concatenate(queue.pop(rank)))
            at = at[ids[at] != -1]
            at = at[self.ranks(ids[at], ids[after[at]]) == rank]
            if not len(at):
                continue
            if len(at) > 1:
                # of overlapping places every second, from the left
                fresh = np.concatenate([[True], after[at[:-1]] != at[1:]])
                begin = np.flatnonzero(fresh)
                chosen = (np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % 2 == 0
                merged = self.pairs(ids[at], ids[after[at]])
                left = np.where(before[at] >= 0, ids[before[at]], -1)
                right = ids[after[after[at]]]
                near = np.minimum(np.minimum(self.ranks(left, merged), self.ranks(merged, right)), self.ranks(merged, merged))
                if (near <= rank).any() or (merged != merged[0]).any():
                    one_by_one(rank, at)
                    continue
                at = at[chosen]
            push(merge(at))
        return ids[:-1][ids[:-1] != -1]

    def _spell(self, tokens: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without an id become the ids of their bytes."""
        strange = np.flatnonzero(tokens < -1)
        if not len(strange):
            return tokens, begin
        code = -2 - tokens[strange]
        size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        lengths = np.ones(len(tokens), np.int64)
        lengths[strange] = size
        ends = np.concatenate([[0], np.cumsum(lengths)])
        out = np.repeat(tokens, lengths)
        spelt = np.frombuffer(b"".join(chr(c).encode("utf-8", "surrogatepass") for c in code), np.uint8)
        where = np.repeat(ends[strange], size) + np.arange(len(spelt)) - np.repeat(np.cumsum(size) - size, size)
        out[where] = self.bytes_at + spelt.astype(np.int64)
        return out, ends[begin]

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all known words, and the number of each of ``words`` among them."""
        known = self.known if self.known is not None else words[:0]
        place = pc.index_in(words, value_set=known)
        missing = pc.is_null(place)
        new = words.filter(missing)
        if len(new):
            if len(known) + len(new) > KEPT_WORDS and len(known):
                self.known, self.tokens, self.ends = None, np.empty(0, np.int32), np.zeros(1, np.int64)
                return self.lookup(words)
            tokens, begin = self.encode_words(new)
            self.ends = np.concatenate([self.ends, self.ends[-1] + begin[1:]])
            self.tokens = np.concatenate([self.tokens, tokens])
            at = np.array(place.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            at[missing.to_numpy(zero_copy_only=False)] = len(known) + np.arange(len(new))
            self.known = pa.concat_arrays([known, new])
            return at, self.ends
        return place.to_numpy(zero_copy_only=False).astype(np.int64), self.ends

    def __getstate__(self):
        return self.__dict__ | {"known": None, "tokens": np.empty(0, np.int32), "ends": np.zeros(1, np.int64)}


@dataclass
class LibraryVocabulary:
    """A tokenizer of another kind, by its JSON file and its own library."""

    name: str
    path: str
    tokenizer: object = None

    def ids(self, texts: list[str | None]) -> list[list[int]]:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.tokenizer.encode_special_tokens = True
        return [[] if not t else self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    def __getstate__(self):
        return self.__dict__ | {"tokenizer": None}


def pattern_starts(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where words begin, by the rule of the rank files' pattern; ``doc`` is true at the first character of a text.

    Runs of letters, numbers and marks take one blank before them; of white space before anything else the last character
    stands apart; the English contractions after an apostrophe that begins a word are words.
    """
    n = len(code)
    kind = char_classes()[code]
    start = doc.copy()
    start[1:] |= kind[1:] != kind[:-1]
    white = kind == SPACE
    last_white = np.zeros(n, bool)
    last_white[:-1] = white[:-1] & ~white[1:] & ~doc[1:]
    start |= last_white
    start[1:] &= ~(last_white[:-1] & (code[:-1] == 32))
    quote = np.flatnonzero((code == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~doc[quote + 1]]
    if len(quote):
        a = code[quote + 1]
        b = np.where((quote + 2 < n) & ~doc[np.minimum(quote + 2, n - 1)], code[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        start[quote[one | two] + 1] = False
        for at in (quote[one] + 2, quote[two] + 3):
            start[at[at < n]] = True
    return start


def joint_starts(code: np.ndarray, doc: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Where words begin if a word ends wherever no piece holds the two neighbouring characters."""
    at = vocabulary.chars[code]
    start = doc.copy()
    start[1:] |= ~vocabulary.joined[at[:-1], at[1:]]
    return start


@dataclass
class Split:
    """Words of a chunk of texts: the distinct ones, each word's number among them, and words per text."""

    distinct: pa.Array
    number: np.ndarray
    texts: np.ndarray  # the first word of each text, and the number of words


def split_texts(data: bytes, sizes: np.ndarray, vocabulary: Vocabulary) -> Split:
    """Split joined texts (``sizes`` in bytes) into words."""
    code = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    width = 1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width, dtype=np.int32)])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.zeros(len(code) + 1, bool)
    doc[np.searchsorted(at, begins)] = True
    doc = doc[:-1]
    start = (pattern_starts(code, doc) if vocabulary.bytewise else joint_starts(code, doc, vocabulary)) if len(code) else doc
    offsets = np.append(at[:-1][start], np.int32(len(data))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = words.dictionary_encode()
    return Split(coded.dictionary, coded.indices.to_numpy(), np.searchsorted(offsets[:-1], begins))


def chunks(texts: pa.Array, prefix: bytes = b"") -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Slices (from, to, joined bytes, bytes of each) of a text column; null texts are empty."""
    texts = pc.cast(texts, pa.large_binary())
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(lengths)])
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(sums, sums[lo] + CHUNK_BYTES, "right")) - 1)
        part = texts[lo:hi].to_pylist()
        if prefix:
            part = [prefix + t if t else t for t in part]
        sizes = lengths[lo:hi]
        yield lo, hi, b"".join(t or b"" for t in part), np.where(sizes > 0, sizes + len(prefix), 0)
        lo = hi


def _pair_table(tokens: dict[bytes | str, int]) -> PairTable:
    """Every way to join two tokens to a third."""
    found = [(a, b, i) for t, i in tokens.items() for k in range(1, len(t)) if (a := tokens.get(t[:k])) is not None and (b := tokens.get(t[k:])) is not None]
    array = np.array(found, np.int64).reshape(-1, 3)
    return PairTable(array[:, 0], array[:, 1], array[:, 2].astype(np.int32))


def load_vocabulary(name: str, folder: str = TOKENIZERS) -> Vocabulary | LibraryVocabulary:
    """Read ``name``.tiktoken (byte-level ranks) or ``name``.model (pieces with byte fallback) from ``folder``; if
    there is only ``name``.json, its library encodes."""
    ranks_file, model_file = os.path.join(folder, f"{name}.tiktoken"), os.path.join(folder, f"{name}.model")
    if os.path.exists(ranks_file):
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        return Vocabulary(name, _pair_table(ranks), True, np.array([ranks[bytes([b])] for b in range(256)], np.int32))
    json_file = os.path.join(folder, f"{name}.json")
    if not os.path.exists(model_file) and os.path.exists(json_file):
        return LibraryVocabulary(name, json_file)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    pieces = {model.id_to_piece(i): i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    first = np.full(0x110000, -1, np.int32)
    numbers: dict[str, int] = {}
    links = set()
    for piece, i in pieces.items():
        if len(piece) == 1:
            first[ord(piece)] = i
        for a, b in zip(piece, piece[1:]):
            links.add((numbers.setdefault(a, len(numbers) + 1), numbers.setdefault(b, len(numbers) + 1)))
    chars = np.zeros(0x110000, np.int32)
    for c, k in numbers.items():
        chars[ord(c)] = k
    chars[32] = chars[0x2581]
    joined = np.zeros((len(numbers) + 1, len(numbers) + 1), bool)
    joined[tuple(np.array(sorted(links)).T)] = True
    scores = np.array([model.get_score(i) for i in range(size)])
    rank_of = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
    return Vocabulary(name, _pair_table(pieces), False, first, model.piece_to_id("<0x00>"), chars, joined, rank_of)


def encode_column(texts: pa.Array, vocabulary: Vocabulary) -> pa.ListArray:
    """Ids of each text; empty and null texts have none."""
    if isinstance(vocabulary, LibraryVocabulary):
        return pa.array(vocabulary.ids(texts.to_pylist()), pa.list_(pa.int32()))
    parts = []
    for _, _, data, sizes in chunks(texts, b"" if vocabulary.bytewise else b" "):
        split = split_texts(data, sizes, vocabulary)
        at, ends = vocabulary.lookup(split.distinct)
        begin, length = ends[at], ends[at + 1] - ends[at]
        each = length[split.number]
        total = np.concatenate([[0], np.cumsum(each)])
        shift = begin[split.number] - total[:-1]
        ids = vocabulary.tokens[np.repeat(shift, each) + np.arange(total[-1])]
        parts.append(pa.ListArray.from_arrays(pa.array(total[split.texts].astype(np.int32)), pa.array(ids, pa.int32())))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def count_column(texts: pa.Array, vocabularies: list[Vocabulary]) -> list[np.ndarray]:
    """Number of tokens of each text under each vocabulary; byte-level ones share the split into words."""
    out: list[np.ndarray] = [np.zeros(len(texts), np.int64) for _ in vocabularies]
    for i, v in enumerate(vocabularies):
        if isinstance(v, LibraryVocabulary):
            out[i][:] = [len(x) for x in v.ids(texts.to_pylist())]
    own = [i for i, v in enumerate(vocabularies) if isinstance(v, Vocabulary)]
    groups: list[list[int]] = [[i for i in own if vocabularies[i].bytewise], *[[i] for i in own if not vocabularies[i].bytewise]]
    for group in filter(None, groups):
        for lo, hi, data, sizes in chunks(texts, b"" if vocabularies[group[0]].bytewise else b" "):
            split = split_texts(data, sizes, vocabularies[group[0]])
            for i in group:
                at, ends = vocabularies[i].lookup(split.distinct)
                total = np.concatenate([[0], np.cumsum((ends[at + 1] - ends[at])[split.number])])
                out[i][lo:hi] = np.diff(total[split.texts])
    return out


def encode_corpus(docs: DataFrame, tokenizer: str, folder: str = TOKENIZERS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids) of every row: the token ids of its text without special tokens, as an int array.

    Defined cases: null and empty texts give an empty list; strings that look like special tokens are ordinary
    text; texts of any length are encoded whole; repeated rows and null ids are kept; other columns are ignored; an
    empty table gives none. Narrow: no shuffle; the vocabulary, of fixed size, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(tokenizer, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                yield pa.RecordBatch.from_arrays([part.column(0), encode_column(part.column(1), vocabulary)], names=[id_column, "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text_column).cast("string")).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")
