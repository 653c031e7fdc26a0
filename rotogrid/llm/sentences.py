"""Sentence boundaries across languages and scripts by a maximum-entropy classifier of candidate marks.

Text cells are split into blocks; marks within a block are candidates, described by the tokens around them, case, length,
digits, script, closing quotes and brackets. How often a token ends or begins a block is counted over the whole
corpus. The classifier is fitted on reliable cases: block ends, which are boundaries whatever stands there, and marks
that can't be one (within brackets, before a comma, next to tokens that never end or begin a block).
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotogrid.session import cut

#: Labelled candidates that the classifier is fitted on, about.
TRAINING_ROWS = 200_000
#: Tokens whose counts are broadcast at most: those of at least 1 / COUNTED_TOKENS of all occurrences. The others' are joined.
COUNTED_TOKENS = 10_000
#: Characters from its end that tell a token before a mark; longer ones that end alike count as one.
TOKEN_CHARS = 40
#: Occurrences below which a token has no level, whatever the corpus's size.
LEAST = 3
#: Occurrences from which on a token that (almost) never ends or begins a block is taken to be unable to.
NEVER = 10

BLANK = " \t\r\n\v\f\xa0  -​    ⁠　﻿"
MARKS = re.compile("([.!?…‥。｡．！？؟۔।॥።፧;;]+)((?:[ \xa0 ](?=[»›]))?\\*{0,3}[)\\]}\"'”»’“‘）】〉》」』›`]*\\*{0,3})")
PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“”", "«": "»", "»": "«", "「": "」", "『": "』", "（": "）", "【": "】", "‘": "’", "‹": "›", "”": "“", '"': '"', "`": "`", "'": "'", "《": "》", "〈": "〉"}
OPENERS = {c: [k for k, v in PAIRS.items() if c in v] for c in "".join(PAIRS.values())}
ENCLOSING = re.compile("[" + re.escape("".join(dict.fromkeys("".join(k + v for k, v in PAIRS.items())))) + "]")
NEXT = re.compile(f"([{BLANK}]*)([*_]*[(\\[{{“„«「『（【‘‹”\"'`《〈¿¡»]*[*_]*)([^\\W\\d_]+|[0-9٠-٩०-९]+|[^\\s]?)")
STOPS = frozenset(" \t\r\n\v\f\xa0​ 　([{“„«「『（【‘‹\"'`*,;:，、：；—–/|")
HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]+|$)")
MARKER = re.compile(r"[ \t]*(?:[-*+][ \t]+|\d{1,9}[.)][ \t]+|>[ \t]?)")
QUOTE = re.compile(r"[ \t]{0,3}>")
FENCE = re.compile(r"[ \t]{0,3}(```+|~~~+)")
IMAGE = re.compile(rf"[ \t]*!\[[^\]]*\]\([^)]*\)[{BLANK}]*$")
RULE = re.compile(r"[ \t]*([-*_])[ \t]*(?:\1[ \t]*){2,}$")
EDGE = re.compile(f"[{BLANK}]*")
THAI_GAP = re.compile(f"(?<=[ก-ฮะ-ฺเ-๎])[{BLANK}]+(?=[ก-ฮะ-ฺเ-๎])")
TRIM = "".join(chr(c) for c in range(0x10000) if re.match(f"[{BLANK}]", chr(c)))

SCRIPTS = ("OTHER", "LATIN", "GREEK", "CYRILLIC", "ARABIC", "DEVANAGARI", "ETHIOPIC", "HANGUL", "HIRAGANA", "KATAKANA", "CJK", "THAI")
UNSPACED = frozenset(("HIRAGANA", "KATAKANA", "CJK", "THAI"))


@lru_cache(1 << 16)
def script(c: str) -> int:
    name = unicodedata.name(c, "").split(" ")[0].split("-")[0]
    return SCRIPTS.index(name) if name in SCRIPTS else 0


@lru_cache(1 << 17)
def token_code(token: str) -> int:
    """31 bits of the token, 0 for none; digits count alike."""
    return zlib.crc32(re.sub(r"\d+", "0", token).encode("utf-8", "surrogatepass")) & 0x7FFFFFFF if token else 0


@lru_cache(1 << 16)
def _before_class(token: str) -> int:
    """Kind (10) and length bucket (5) of the token before a mark."""
    if not token:
        kind = 0
    elif token[-1].isdigit():
        kind = 1
    elif not token[-1].isalpha() and not unicodedata.category(token[-1]).startswith("M"):
        kind = 2
    elif "." in token:
        kind = 3
    elif any(c.isdigit() for c in token):
        kind = 4
    elif len(token) == 1 and token.isupper():
        kind = 5
    elif token.isupper():
        kind = 6
    elif token[0].isupper():
        kind = 7
    elif token.islower():
        kind = 8
    else:
        kind = 9
    n = len(token)
    return kind * 5 + (0 if n <= 1 else 1 if n == 2 else 2 if n == 3 else 3 if n <= 5 else 4)


@lru_cache(1 << 16)
def _after_class(opening: str, token: str) -> int:
    """Kind (9) of what follows a mark."""
    if not token:
        return 0
    c = token[0]
    if c.isalpha():
        return 1 if c.isupper() else 2 if c.islower() else 3
    if c.isdigit():
        return 4
    if c in ",;:)]}، ；：，、）】」』”»’%":
        return 5
    if c in "-—–=/+&|":
        return 6
    return 7 if unicodedata.category(c).startswith("S") else 8


@lru_cache(1 << 12)
def _mark_class(mark: str) -> int:
    if mark[0] in "….‥":
        return 0 if mark == "." else 1 if set(mark) <= set("….‥") else 2
    if mark[0] in "!?！？؟፧":
        return 3
    if mark[0] in ";;":
        return 4
    return 5


def enclosed(s: str) -> list[tuple[int, int]]:
    """Spans (open, close) of matched quotes and brackets; unmatched ones don't count."""
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {c: [] for c in PAIRS}  # where each kind stands in the stack
    out = []
    for m in ENCLOSING.finditer(s):
        c, at = m.group(), m.start()
        if stack and stack[-1][0] == "`" and c != "`":
            continue
        before = s[at - 1] if at else " "
        after = s[at + 1] if at + 1 < len(s) else " "
        if c in "'’" and before.isalnum() and after.isalnum():
            continue
        k = max((places[o][-1] for o in OPENERS.get(c, ()) if places[o]), default=None)
        if c in "'" and k is None and not (after.isalnum() and not before.isalnum()):
            continue
        if k is not None and not (c == "'" and before in STOPS):
            out.append((stack[k][1], at))
            while len(stack) > k:
                places[stack.pop()[0]].pop()
        elif c in PAIRS and not (c in "”»" and (before.isalnum() or after in TRIM)):
            places[c].append(len(stack))
            stack.append((c, at))
    return out


class Enclosures:
    """The quotes and brackets of a block, for lookups by bisection."""

    def __init__(self, s: str) -> None:
        spans = sorted(enclosed(s))
        self.opens = [a for a, _ in spans]
        self.all_closes = [b for _, b in spans]
        self.closes = set(self.all_closes)
        self.tops: list[int] = []
        self.ends: list[int] = []
        for a, b in spans:
            if not self.ends or a > self.ends[-1]:
                self.tops.append(a)
                self.ends.append(b)
            else:
                self.ends[-1] = max(self.ends[-1], b)

    def hold(self, at: int, until: int) -> bool:
        """Does a quote or bracket opened before ``at`` close at ``until`` or later?"""
        k = bisect_left(self.tops, at) - 1
        return k >= 0 and self.ends[k] >= until

    def opened(self, at: int, low: int) -> int:
        """Behind the last opening mark before ``at`` that is still open there, ``low`` at least."""
        k = bisect_left(self.opens, at) - 1
        return max(low, self.opens[k] + 1) if k >= 0 and self.all_closes[k] >= at else low


def blocks(cell: str) -> Iterator[tuple[bool, int, int]]:
    """(heading?, begin, end) of every block of a text cell, markers left out."""
    at, fence, open_from, last = 0, "", -1, -1
    for line in cell.splitlines(keepends=True):
        begin, at = at, at + len(line)
        body = line.rstrip("\r\n\v\f\x1c\x1d\x1e\x85  ")
        if fence:
            if body.strip().startswith(fence) and not body.strip().strip(fence[0]):
                fence = ""
            continue
        stripped = body.strip(TRIM)
        mark = FENCE.match(body)
        special = bool(mark) or stripped.startswith("|") or bool(IMAGE.match(body)) or bool(RULE.match(body))
        heading = None if special else HEADING.match(body)
        marker = None if special or heading else MARKER.match(body)
        if open_from >= 0 and (not stripped or special or heading or marker):
            yield False, open_from, last
            open_from = -1
        if mark:
            fence = mark.group(1)
        if not stripped or special:
            continue
        if heading:
            if body[heading.end():].strip(TRIM):
                yield True, begin + heading.end(), begin + len(body)
            continue
        if marker:
            skip = 0
            while (m := MARKER.match(body, skip)) and m.end() > skip:
                skip = m.end()
            inner = HEADING.match(body, skip)
            if inner:
                if body[inner.end():].strip(TRIM):
                    yield True, begin + inner.end(), begin + len(body)
                continue
            open_from = begin + skip
        elif open_from < 0:
            open_from = begin
        last = begin + len(body)
    if open_from >= 0:
        yield False, open_from, last


class Lookback:
    """The last character of a kind before ever later places of a block: each character is looked at once."""

    def __init__(self, s: str, low: int, wanted: Callable[[str], bool]) -> None:
        self.s, self.seen, self.wanted, self.last = s, low, wanted, low - 1

    def __call__(self, i: int) -> int:
        """Its place before ``i``, or one before the block's begin."""
        j = i - 1
        while j >= self.seen and not self.wanted(self.s[j]):
            j -= 1
        if j >= self.seen:
            self.last = j
        self.seen = max(self.seen, i)
        return self.last


def _token_before(s: str, i: int, low: int, stops: Lookback) -> str:
    """The token that ends at ``i``, told by its last ``TOKEN_CHARS`` characters."""
    token = s[max(low, stops(i) + 1, i - TOKEN_CHARS) : i]
    return token[-2:] if token and SCRIPTS[script(token[-1])] in UNSPACED else token


def _after(s: str, i: int) -> tuple[bool, int, str, str]:
    """Blank?, where the text goes on, opening marks, and the token there."""
    m = NEXT.match(s, i)
    blank, opening, token = m.groups()
    if token and SCRIPTS[script(token[0])] in UNSPACED:
        token = token[:2]
    return bool(blank), m.start(2), opening, token


def scan(text: str, cells: list[dict]) -> tuple[list, list, list]:
    """Blocks (begin, stop, code of the first token or 0 for headings), forced boundaries (stop, next) and
    candidates (stop, next, token before, token after, packed description)."""
    spans, forced, found = [], [], []
    ended: list | None = None  # the last block's end, as a candidate without what follows
    for cell in cells:
        if cell is None or cell["cell_kind"] != "text" or (cell["n_chars"] or 0) < 1 or cell["begin_at"] is None or cell["begin_at"] < 0:
            continue
        at = cell["begin_at"]
        body = text[at : at + cell["n_chars"]]
        for heading, lo, hi in blocks(body):
            s = body[lo:hi]
            skip = EDGE.match(s).end()
            s = s.rstrip(TRIM)
            if skip >= len(s):
                continue
            base = at + lo
            if heading:
                spans.append((base + skip, base + len(s), 0))
                ended = None
                continue
            s = s.replace("\n", " ").replace("\r", " ")
            _, _, opening, token = _after(s, skip)
            first = token_code(token)
            spans.append((base + skip, base + len(s), first))
            if ended is not None:
                found.append((-1, -1, ended[0], first, ended[1] | _after_class(opening, token) << 16 | 1 << 24))
                ended = None
            inside = Enclosures(s)
            if "฀" <= max(s):
                for m in THAI_GAP.finditer(s):
                    if not inside.hold(m.start(), m.start() + 1):
                        forced.append((base + m.start(), base + m.end()))
            letters, words, stops = Lookback(s, skip, str.isalpha), Lookback(s, skip, str.isalnum), Lookback(s, skip, STOPS.__contains__)
            for m in MARKS.finditer(s, skip):
                i, stop = m.start(), m.end()
                mark, closing = m.groups()
                if mark[0] == ";" and ((j := letters(i)) < skip or SCRIPTS[script(s[j])] != "GREEK"):
                    continue
                if closing:
                    # only marks that close something belong to the sentence
                    k = m.end(1)
                    if s[k] in TRIM:  # a closing guillemet may stand apart
                        k += (k + 1) in inside.closes
                    while k < stop and (s[k] == "*" or k in inside.closes or s[k] in ")]}”»’」』）】"):
                        k += 1
                    stop = k
                if mark == "." and stop < len(s) and s[stop].isdigit() and i > skip and (s[i - 1].isdigit() or s[i - 1] in "-=+,"):
                    continue
                j = words(i)
                token = _token_before(s, i, inside.opened(i, skip), stops)
                before = token_code(token)
                kinds = s[m.end(1) : stop]
                close = 0 if not kinds else 1 if kinds[-1] in ")]}）】" else 2 if kinds[-1] not in "`*" else 3
                held = inside.hold(i, stop)
                code = _mark_class(mark) | close << 3 | held << 5 | _before_class(token) << 6 | script(s[j] if j >= skip else " ") << 12
                if stop >= len(s):
                    ended = [before, code | 1 << 20]
                    continue
                blank, go, opening, token = _after(s, stop)
                found.append((base + stop, base + go, before, token_code(token), code | _after_class(opening, token) << 16 | blank << 20 | bool(opening) << 21))
    return spans, forced, found


_INTS = pa.list_(pa.int32())
SCANNED = ("begin", "stop", "first", "forced_stop", "forced_next", "mark_stop", "mark_next", "before", "after", "code")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            columns: list[list] = [[] for _ in SCANNED]
            for text, cells in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                spans, forced, found = scan(text, cells) if text and cells else ([], [], [])
                for k, group in ((0, spans), (3, forced), (5, found)):
                    rows = list(zip(*group)) if group else [()] * (3, 0, 0, 2, 0, 5)[k]
                    for i, values in enumerate(rows):
                        columns[k + i].append(values)
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, _INTS) for c in columns]], names=["doc_id", *SCANNED])


class Counts:
    """How often tokens stand at a block's edge and within a block at a mark, by token code."""

    def __init__(self, rows: list) -> None:
        table = np.array(sorted((r[0], r[1], r[2]) for r in rows), np.int64).reshape(-1, 3)
        self.codes, self.edge, self.inner = table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()

    @classmethod
    def of(cls, codes: np.ndarray, edge: np.ndarray, inner: np.ndarray) -> Counts:
        """From columns in the order of the codes."""
        out = cls([])
        out.codes, out.edge, out.inner = codes, edge, inner
        return out

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.codes):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = self.codes[at] == codes
        return np.where(hit, self.edge[at], 0), np.where(hit, self.inner[at], 0)


def _level(edge: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Seven levels, from tokens never at an edge to tokens mostly there; 0 if seldom seen at all."""
    share = edge / np.maximum(edge + inner, 1)
    out = np.where(share >= 0.3, 6, np.where(share >= 0.15, 5, np.where(share >= 0.05, 4, 3)))
    never = edge <= 0.02 * inner
    out = np.where(never, np.where(inner >= NEVER, 1, np.where(inner >= 3, 2, 0)), out)
    return np.where(edge + inner < LEAST, 0, out)


#: Sizes of the feature groups: each candidate has one feature of every group.
GROUPS = (8, 2, 4, 2, 10, 5, 12, 9, 2, 7, 7, 49, 8 * 7, 8 * 7, 9 * 7, 4 * 7 * 2, 9 * 4 * 2, 8 * 2 * 9, 12 * 7)


def features(code: np.ndarray, ending: np.ndarray, starting: np.ndarray) -> np.ndarray:
    """Feature numbers of each candidate, from its description and the levels of the tokens around it."""
    mark, close, held, kind = code & 7, code >> 3 & 3, code >> 5 & 1, code >> 6 & 63
    writing, following, blank, opening = code >> 12 & 15, code >> 16 & 15, code >> 20 & 1, code >> 21 & 1
    kind, size = kind // 5, kind % 5
    values = (
        mark, blank, close, held, kind, size, writing, following, opening, ending, starting, ending * 7 + starting, mark * 7 + ending,
        mark * 7 + starting, following * 7 + starting, (close * 7 + starting) * 2 + blank, (following * 4 + close) * 2 + blank, (mark * 2 + blank) * 9 + following, writing * 7 + starting,
    )
    offsets = np.concatenate([[0], np.cumsum(GROUPS)[:-1]])
    return np.stack([v + o for v, o in zip(values, offsets)], 1).astype(np.int32)


def labels(code: np.ndarray, ending: np.ndarray, starting: np.ndarray) -> np.ndarray:
    """1 for reliable boundaries, 0 for reliable others, -1 where neither is certain."""
    out = np.full(len(code), -1, np.int8)
    mark, held, following, blank, caseless = code & 7, code >> 5 & 1, code >> 16 & 15, code >> 20 & 1, (code >> 16 & 15) == 3
    strong = (mark >= 3) | (ending >= 5)
    out[strong & (starting >= 5) & ((blank == 1) | caseless | (following == 1))] = 1
    out[starting == 1] = 0
    out[(mark <= 1) & (ending == 1)] = 0
    out[(held == 1) | (following == 5) | (following == 6)] = 0
    out[(code >> 24 & 1) == 1] = 1
    return out


def fit(columns: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic model over one-of-group features, by diagonally scaled gradient steps; the last is the bias."""
    n = int(sum(GROUPS))
    weights, scale = np.zeros(n + 1), np.full(n + 1, 1e-8)
    if not len(y):
        return weights
    share = len(y) / np.maximum(2 * np.bincount(y, minlength=2), 1)
    # equal rows are fitted once, with their weight of either label
    columns, place = np.unique(columns, axis=0, return_inverse=True)
    no, yes = (np.bincount(place.ravel()[y == k], minlength=len(columns)) * share[k] / len(y) for k in (0, 1))
    for _ in range(rounds * 10):
        p = 1 / (1 + np.exp(-(weights[columns].sum(1) + weights[-1])))
        error = p * (no + yes) - yes
        gradient = np.bincount(columns.ravel(), np.repeat(error, columns.shape[1]), n + 1)
        gradient[-1] = error.sum()
        gradient[:-1] += ridge * weights[:-1]
        scale += gradient**2
        weights -= 0.3 * gradient / np.sqrt(scale)
    return weights


def scan_documents(docs: DataFrame) -> DataFrame:
    """Blocks and candidates of every document with text cells, as arrays (columns ``SCANNED``)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        docs.where(F.col("text").isNotNull() & F.exists("cells", lambda c: (c["cell_kind"] == "text") & (c["n_chars"] > 0)))
        .select("doc_id", "text", F.expr("transform(filter(cells, c -> c.cell_kind = 'text'), c -> struct(c.cell_kind as cell_kind, c.begin_at as begin_at, c.n_chars as n_chars))").alias("cells"))
        .mapInArrow(_scan, ", ".join([f"doc_id {kind}", *[f"{c} array<int>" for c in SCANNED]]))
    )


def _counted(pairs: DataFrame) -> tuple[Counts, DataFrame]:
    """Exact counts of the tokens seen ``LEAST`` times or more: the frequent ones', and a table of all others'."""
    counts = cut(pairs.where("token <> 0").groupBy("token").agg(F.sum("edge").alias("edge"), F.sum("inner").alias("inner")).where(F.col("edge") + F.col("inner") >= LEAST))
    total = counts.agg(F.sum(F.col("edge") + F.col("inner"))).first()[0] or 0
    frequent = F.col("edge") + F.col("inner") >= max(LEAST, -(-total // COUNTED_TOKENS))
    return Counts(counts.where(frequent).collect()), counts.where(~frequent)  # COUNTED_TOKENS rows at most


class Tokens:
    """Counts of the tokens of one list column: the frequent ones broadcast, the others joined to the rows that hold them."""

    def __init__(self, scanned: DataFrame, column: str, pairs: DataFrame) -> None:
        frequent, rare = _counted(pairs)
        self.column, self.shared = column, (shared := scanned.sparkSession.sparkContext.broadcast(frequent))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                token, row = _flat(batch.column(column))
                edge, inner = shared.value(token)
                wanted = (token != 0) & (edge + inner == 0)
                held = np.unique(row[wanted] << 31 | token[wanted])
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(held >> 31)), pa.array(held & 0x7FFFFFFF)], names=["row", "token"])

        # a token that isn't frequent has a small share of the rows, so none is hot
        held = scanned.select("row", column).mapInArrow(run, "row bigint, token bigint").join(rare, "token")
        self.rare = cut(held.groupBy("row").agg(F.collect_list(F.struct("token", "edge", "inner")).alias("c")).select("row", *[F.col(f"c.{x}").alias(f"{column}_{x}") for x in ("token", "edge", "inner")]))

    def join(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.rare, "row", "left")


def levels(batch: pa.RecordBatch, column: str, frequent: Counts) -> np.ndarray:
    """The level of each candidate's token in a batch that the counts of rare tokens are joined to."""
    token, row = _flat(batch.column(column))
    code, _ = _flat(batch.column("code"))
    edge, inner = frequent(token)
    rare, rare_row = _flat(batch.column(f"{column}_token"))
    order = np.argsort(keys := rare_row << 31 | rare)
    joined = Counts.of(keys[order], *[_flat(batch.column(f"{column}_{x}"))[0][order] for x in ("edge", "inner")])
    more_edge, more_inner = joined(row << 31 | token)
    # a block's end with the next block's start is counted once at either edge
    return _level(np.maximum(edge + more_edge - (code >> 24 & 1), 0), inner + more_inner)


def token_counts(scanned: DataFrame) -> tuple[Tokens, Tokens]:
    """Counts of the tokens before full stops and of those that begin blocks or follow marks, over all documents.

    A full stop within a block counts for the block's edge if a token follows that often begins blocks: a word is
    no abbreviation only because its sentence never closes a paragraph.
    """
    marks = scanned.select(F.explode(F.arrays_zip("before", "after", "code")).alias("c")).select("c.*")
    begun = scanned.select(F.explode("first").alias("token")).select("token", F.lit(1).alias("edge"), F.lit(0).alias("inner"))
    followed = marks.where(F.shiftright("code", 24).bitwiseAND(F.lit(1)) == 0).select(F.col("after").alias("token"), F.lit(0).alias("edge"), F.lit(1).alias("inner"))
    starts = Tokens(scanned, "after", begun.unionByName(followed))
    shared = starts.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, code = (_flat(batch.column(c))[0] for c in ("before", "code"))
            starting, dot = levels(batch, "after", shared.value), (code & 7) <= 1
            before, starting, code = before[dot], starting[dot], code[dot]
            edge = ((code >> 24 & 1) == 1) | (starting == 6) & ((code >> 20 & 1) == 1) & ((code >> 5 & 1) == 0)
            token, place = np.unique(before, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token), *[pa.array(np.bincount(place, x, len(token)).astype(np.int64)) for x in (edge, ~edge)]], names=["token", "edge", "inner"]
            )

    return Tokens(scanned, "before", starts.join(scanned.select("row", "before", "after", "code")).mapInArrow(run, "token bigint, edge bigint, inner bigint")), starts


def with_levels(scanned: DataFrame, ends: Tokens, starts: Tokens) -> DataFrame:
    """The scanned rows with the levels of the tokens before and after each candidate."""
    e, s = ends.shared, starts.shared
    names = ["doc_id", *SCANNED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.diff(batch.column("code").offsets.to_numpy()))]).astype(np.int32))
            made = [pa.ListArray.from_arrays(offsets, pa.array(levels(batch, t, c.value).astype(np.int32))) for t, c in (("before", e), ("after", s))]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *made], names=[*names, "ending", "starting"])

    kind = scanned.schema["doc_id"].dataType.simpleString()
    return starts.join(ends.join(scanned)).mapInArrow(run, ", ".join([f"doc_id {kind}", *[f"{c} array<int>" for c in (*SCANNED, "ending", "starting")]]))


def train(scanned: DataFrame, rows: int = TRAINING_ROWS) -> np.ndarray:
    """Fit on the candidates of documents drawn by hash so that about ``rows`` are collected, twice that at most."""
    total = scanned.agg(F.sum(F.size("code"))).first()[0] or 0
    share = min(1.0, rows / max(total, 1))
    drawn = scanned.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    cells = drawn.select(F.explode(F.arrays_zip("code", "ending", "starting")).alias("c")).select("c.*").limit(2 * rows).toPandas().to_numpy(np.int64).reshape(-1, 3)
    columns = features(*cells.T)
    y = labels(*cells.T)
    sure = y >= 0
    return fit(columns[sure], y[sure].astype(np.int64))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and each one's row."""
    lengths = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(column)), lengths)


def assemble(batch: pa.RecordBatch, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and stop of each sentence of a scanned batch."""
    begin, row = _flat(batch.column("begin"))
    stop, _ = _flat(batch.column("stop"))
    forced_stop, forced_row = _flat(batch.column("forced_stop"))
    forced_next, _ = _flat(batch.column("forced_next"))
    mark_stop, mark_row = _flat(batch.column("mark_stop"))
    mark_next, _ = _flat(batch.column("mark_next"))
    columns = features(*(_flat(batch.column(c))[0] for c in ("code", "ending", "starting")))
    chosen = (weights[columns].sum(1) + weights[-1] > 0) & (mark_stop >= 0)
    rows = np.concatenate([row, forced_row, mark_row[chosen]])
    begins = np.concatenate([begin, forced_next, mark_next[chosen]])
    stops = np.concatenate([stop, forced_stop, mark_stop[chosen]])
    a, b = np.lexsort((begins, rows)), np.lexsort((stops, rows))
    keep = begins[a] < stops[b]
    return rows[a][keep], begins[a][keep], stops[b][keep]


def sentences(docs: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, begin_at, stop_at): one row for each sentence in cells of kind ``text``, as code points of the text.

    Defined cases: null and empty texts, documents without text cells and blank cells give no rows; a cell that reaches
    beyond the text ends with it; cells without a place are skipped; fenced code, table, image and rule lines hold no sentence; a block without marks is one sentence;
    repeated rows give repeated sentences; texts of any length are read whole; without reliable cases of both
    kinds the classifier keeps its prior and empty tables give no rows; further columns are ignored.

    Plan: one narrow pass writes blocks and candidates (integers only) to the shared folder; token counts are combined
    map-side; those of tokens above a share of all occurrences reach the driver and are broadcast, all others are joined by
    token and brought back to their documents; the fit sees about ``training_rows`` rows; a last narrow pass classifies the
    candidates of all documents in Arrow batches.
    """
    scanned = cut(scan_documents(docs).withColumn("row", F.monotonically_increasing_id()))  # documents may be repeated
    scanned = cut(with_levels(scanned, *token_counts(scanned)))
    shared = docs.sparkSession.sparkContext.broadcast(train(scanned, training_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, begin, stop = assemble(batch, shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(begin, pa.int32()), pa.array(stop, pa.int32())], names=["doc_id", "begin_at", "stop_at"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return scanned.mapInArrow(run, f"doc_id {kind}, begin_at int, stop_at int")
