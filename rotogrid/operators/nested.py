"""Flattening of nested CTF documents into linked tables by Arrow buffers, list offsets and parent indices.

Bodies are never walked element by element: whole chunks of them are split into tokens at once, from the byte buffer of the Arrow
column (JSON) or by one scan of a regular expression (XML). Depths, parents and places come from running sums and sorts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATTRIBUTES = "@attributes"
#: Documents, and bytes of them, flattened at a time within an Arrow batch; a larger document is flattened alone.
CHUNK, CHUNK_BYTES = 512, 1 << 20
#: Path steps held at a time.
STEPS = 1 << 21
FIELDS = ("Name", "Value", "X", "Y", "Z", "Width", "Height", "Depth")
GRIDS = ("GridCTF", "GridCTFPhase")
SCHEMA = (
    "ctf_id bigint, kind string, tag string, parent_path string, item_path string, name string, value string, "
    "x double, y double, z double, width double, height double, depth double"
)
COLUMNS = [c.split(" ")[0] for c in SCHEMA.split(", ")]
NUMBERS = COLUMNS[-6:]
NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"


@dataclass
class Elements:
    """The elements of many documents in document order: document, parent (-1 for a root), tag, and fields by element."""

    doc: np.ndarray
    parent: np.ndarray
    tag: pa.Array
    fields: dict[str, pa.Array]


# JSON --------------------------------------------------------------------------------------------------------------
OPEN, CLOSE, LIST, LISTEND, COLON, COMMA, STRING, SCALAR = range(1, 9)
BLANK, CONTROL = 9, 10
_CLASS = np.zeros(256, np.uint8)
_CLASS[:32] = CONTROL
for _c, _k in zip(b'{}[]:," \t\n\r', (OPEN, CLOSE, LIST, LISTEND, COLON, COMMA, STRING, BLANK, BLANK, BLANK, BLANK)):
    _CLASS[_c] = _k
_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdefABCDEF", np.uint8))
_ESCAPED = np.isin(np.arange(256), np.frombuffer(b'"\\/bfnrtu', np.uint8))
LITERAL = r"^(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)$"


def _slices(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Byte ranges as an Arrow string array."""
    lengths = stop - begin
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], lengths)
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at].tobytes()))


def _texts(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Contents of JSON strings; those with escapes, which are rare, are decoded one by one."""
    out = _slices(data, begin, stop)
    escaped = pc.fill_null(pc.find_substring(out, "\\"), -1).to_numpy(zero_copy_only=False) >= 0
    if escaped.any():
        decoded = [json.loads(f'"{t}"').encode("utf-8", "replace").decode() for t in out.filter(pa.array(escaped)).to_pylist()]
        out = pc.replace_with_mask(out, pa.array(escaped), pa.array(decoded, pa.large_string()))
    return out


def _escapes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of the backslashes that escape the next byte: every second one of a run within a document."""
    at = np.flatnonzero(data == 92)
    if not len(at):
        return at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | np.isin(at[1:], starts)
    run = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    return at[place % 2 == 0]


def json_elements(bodies: pa.Array) -> tuple[Elements, np.ndarray]:
    """Elements of JSON bodies (a large string array without nulls) and which of these are well formed."""
    offsets = np.frombuffer(bodies.buffers()[1], np.int64)[bodies.offset : bodies.offset + len(bodies) + 1]
    data = np.frombuffer(bodies.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    doc_of = lambda at: np.searchsorted(ends, at, "right")
    good = ends > starts

    def refuse(at: np.ndarray) -> None:
        good[doc_of(at)] = False

    kinds = _CLASS[data]
    quote = data == 34
    escapes = _escapes(data, starts)
    if len(escapes):
        then = escapes + 1
        fits = then < ends[doc_of(escapes)]
        refuse(escapes[~fits])
        then = then[fits]
        quote[then] = False
        refuse(then[~_ESCAPED[data[then]]])
        unicode = then[data[then] == 117]
        if len(unicode):
            fits = unicode + 4 < ends[doc_of(unicode)]
            refuse(unicode[~fits])
            unicode = unicode[fits]
            refuse(unicode[~_HEX[data[unicode[:, None] + np.arange(1, 5)]].all(1)])
    # within strings the number of quotes so far is odd; bodies with an odd number in all are refused
    count = np.concatenate([[0], np.cumsum(quote)])
    good &= (count[ends] - count[starts]) % 2 == 0
    odd = (count[1:] - np.repeat(count[starts], ends - starts)) % 2 == 1
    refuse(np.flatnonzero(odd & (data < 32)))
    outside = ~odd & ~quote
    word = outside & ((kinds == 0) | (kinds == CONTROL))
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[starts[starts < len(data)]] = word[starts[starts < len(data)]]
    token = (outside & (kinds >= OPEN) & (kinds <= COMMA)) | (quote & odd) | first
    at = np.flatnonzero(token)
    doc = doc_of(at)
    keep = good[doc]
    at, doc = at[keep], doc[keep]
    kind = kinds[at].astype(np.int64)
    kind[(kind == 0) | (kind == CONTROL)] = SCALAR
    n = len(at)
    head = np.ones(n, bool)
    head[1:] = doc[1:] != doc[:-1]
    good[np.setdiff1d(np.flatnonzero(good), doc)] = False  # nothing but blanks

    # ends of strings and scalars
    stop = at + 1
    close = np.flatnonzero(quote & ~odd)
    stop[kind == STRING] = close[np.searchsorted(close, at[kind == STRING])]
    gaps = np.flatnonzero(~word)
    scalar = kind == SCALAR
    after = np.append(gaps, len(data))[np.searchsorted(gaps, at[scalar])]
    stop[scalar] = np.minimum(after, ends[doc[scalar]])
    literal = _slices(data, at[scalar], stop[scalar])
    refuse_doc = lambda which: good.__setitem__(doc[which], False)
    refuse_doc(np.flatnonzero(scalar)[~pc.match_substring_regex(literal, LITERAL).to_numpy(zero_copy_only=False)])
    null = np.zeros(n, bool)
    null[scalar] = pc.equal(literal, "null").to_numpy(zero_copy_only=False)

    # depths, and the container of every token: the last bracket before it that opens one level up
    opens, closes = (kind == OPEN) | (kind == LIST), (kind == CLOSE) | (kind == LISTEND)
    level = np.cumsum(opens.astype(np.int64) - closes)
    base = np.concatenate([[0], level])[:-1]
    base = base - np.repeat(base[head], np.diff(np.append(np.flatnonzero(head), n)))  # depth before a token
    after_level = base + opens - closes
    refuse_doc(after_level < 0)
    last = np.append(head[1:], True) if n else head
    refuse_doc(last & (after_level != 0))
    opened = np.flatnonzero(opens)
    keys = np.sort(np.maximum(base[opened], 0) * (n + 1) + opened)
    place = np.searchsorted(keys, (base - 1) * (n + 1) + np.arange(n)) - 1
    inner = base > 0
    container = np.where(inner & (place >= 0), keys[np.maximum(place, 0)] % (n + 1) if len(keys) else -1, -1)
    held = np.where(container >= 0, kind[container] if n else 0, 0)
    before = np.where(head, 0, np.concatenate([[0], kind])[:-1]) if n else kind

    # grammar: each token by its container and the token before it
    member = (kind == STRING) & (held == OPEN) & ((before == OPEN) | (before == COMMA))
    done = np.concatenate([[False], (closes | scalar | (kind == STRING)) & ~member])[:-1] & ~head
    value = opens | scalar | (kind == STRING)
    fine = np.zeros(n, bool)
    fine |= (held == 0) & head & value
    fine |= (held == OPEN) & (member | value & (before == COLON))
    fine |= (held == OPEN) & (kind == COLON) & np.concatenate([[False], member])[:-1]
    fine |= (held == LIST) & value & ((before == LIST) | (before == COMMA))
    fine |= (held > 0) & (kind == COMMA) & done
    fine |= (held == OPEN) & (kind == CLOSE) & (done | (before == OPEN))
    fine |= (held == LIST) & (kind == LISTEND) & (done | (before == LIST))
    refuse_doc(~fine)
    refuse_doc(head & (kind != OPEN))

    # names of members; of a name given twice in an object the last counts
    named = np.flatnonzero(member)
    names = _texts(data, at[named] + 1, stop[named])
    codes = pc.dictionary_encode(names).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((named, codes, container[named]))
    same = (codes[order][1:] == codes[order][:-1]) & (container[named][order][1:] == container[named][order][:-1])
    valid = np.ones(len(named), bool)
    valid[order[:-1][same]] = False
    members = np.bincount(container[named][valid], minlength=n + 1)[:n] if len(named) else np.zeros(n, np.int64)
    refuse_doc(head & (members != 1))

    name_of = np.full(n + 2, -1)  # of a member's value, two tokens behind its name
    name_of[named[valid] + 2] = np.flatnonzero(valid)
    name_of = name_of[:n]
    usable = np.append(~pc.match_substring_regex(names, "^[@#]").to_numpy(zero_copy_only=False), False)
    # a value belongs to the object around it, or around the list that it is in
    direct = value & (name_of >= 0)
    listed = value & (held == LIST)
    up = np.where(direct, container, -1)
    up[listed] = np.where(name_of[container[listed]] >= 0, container[container[listed]], -1)
    own_name = np.where(direct, name_of, -1)
    own_name[listed] = name_of[container[listed]]
    root = up >= 0
    root[root] = head[up[root]]
    ok = (up >= 0) & ~null & np.where(root, direct, usable[own_name] & ~(direct & (kind == LIST)))
    ok[head] = True
    # all the way up
    jump = np.where(up >= 0, up, np.arange(n))
    while True:
        ok = ok & ok[jump]
        if (jump[jump] == jump).all():
            break
        jump = jump[jump]
    ok &= ~head & good[doc] if n else ok
    element = np.flatnonzero(ok)
    index = np.full(n + 1, -1)
    index[element] = np.arange(len(element))

    # fields: members of the attributes' object, whose own name stands two tokens before it
    fields = {}
    is_attributes = np.append(pc.equal(names, ATTRIBUTES).to_numpy(zero_copy_only=False), False)
    around = container[named]
    owner = np.where(around >= 0, container[around], -1)
    wanted = valid & (around >= 0) & (owner >= 0)
    wanted &= is_attributes[name_of[around]] & (index[owner] >= 0)
    for f in FIELDS:
        mine = named[wanted & pc.equal(names, f).to_numpy(zero_copy_only=False)]
        v = mine + 2
        inner_end = stop[v].copy()
        nested = opens[v]
        if nested.any():  # an object or list stays as it is written
            level_close = np.flatnonzero(closes)
            ck = np.sort(after_level[level_close] * (n + 1) + level_close)
            inner_end[nested] = at[ck[np.searchsorted(ck, base[v][nested] * (n + 1) + v[nested])] % (n + 1)] + 1
        text = kind[v] == STRING
        values = np.empty(len(v), object)
        values[text] = _texts(data, at[v][text] + 1, stop[v][text]).to_numpy(zero_copy_only=False)
        values[~text] = _slices(data, at[v][~text], inner_end[~text]).to_numpy(zero_copy_only=False)
        values[null[v]] = None
        column = np.full(len(element), None, object)
        column[index[container[container[mine]]]] = values
        fields[f] = pa.array(column, pa.large_string())
    tag = names.take(pa.array(own_name[element]))
    parent = index[up[element]]
    return Elements(doc[element], parent, tag, fields), good


# XML ---------------------------------------------------------------------------------------------------------------
TOKEN = re.compile(r"(\0)|<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<(/?)([^\s/>!?]+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
FIELD = re.compile(r"(\0)|([^\s=\0]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
ENTITY = re.compile(r"&(?:#x([0-9A-Fa-f]+)|#([0-9]+)|(lt|gt|amp|quot|apos));")
ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


def _well_formed(body: str) -> bool:
    try:
        expat.ParserCreate("utf-8").Parse(body.encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError:
        return False
    return True


def _expanded(body: str) -> str:
    """A document with a type definition, whose entities may hold elements and whose elements default fields, written without it."""
    out: list[str] = []
    quoted = lambda v: v.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace("\t", "&#9;").replace("\n", "&#10;").replace("\r", "&#13;")
    parser = expat.ParserCreate("utf-8")
    parser.StartElementHandler = lambda tag, own: out.append(f"<{tag}" + "".join(f' {k}="{quoted(v)}"' for k, v in own.items()) + ">")
    parser.EndElementHandler = lambda tag: out.append(f"</{tag}>")
    parser.Parse(body.encode("utf-8", "surrogatepass"), True)
    return "".join(out)


def _decoded(text: str) -> str:
    return ENTITY.sub(lambda m: chr(int(m[1], 16)) if m[1] else chr(int(m[2])) if m[2] else ENTITIES[m[3]], text)


def _columns(found: list[tuple], n: int) -> list[tuple]:
    return list(zip(*found)) or [()] * n


def xml_elements(bodies: list[str]) -> tuple[Elements, np.ndarray]:
    """Elements of XML bodies and which of these are well formed, which the C parser tells without callbacks."""
    good = np.array([_well_formed(b) for b in bodies], bool)
    ready = [_expanded(b) if "<!DOCTYPE" in b else b for b, ok in zip(bodies, good) if ok]
    mark, slash, tags, rest = _columns(TOKEN.findall("\0".join(["", *ready])), 4)
    tag, rest = pa.array(tags, pa.large_string()), pa.array(rest, pa.large_string())
    doc = np.cumsum(pc.not_equal(pa.array(mark, pa.large_string()), "").to_numpy(zero_copy_only=False)) - 1
    closing = pc.equal(pa.array(slash, pa.large_string()), "/").to_numpy(zero_copy_only=False)
    starting = pc.not_equal(tag, "").to_numpy(zero_copy_only=False) & ~closing
    lone = pc.ends_with(rest, "/").to_numpy(zero_copy_only=False)
    delta = (starting & ~lone).astype(np.int64) - closing
    at = np.flatnonzero(starting)
    depth = (np.cumsum(delta) - delta)[at]
    n = len(at)
    # the parent is the last element before it that is one level up
    keys = np.sort(depth * (n + 1) + np.arange(n))
    place = np.searchsorted(keys, (depth - 1) * (n + 1) + np.arange(n)) - 1
    parent = np.where(depth > 0, keys[np.maximum(place, 0)] % (n + 1) if n else -1, -1)
    tag, rest = tag.take(pa.array(at)), rest.take(pa.array(at))

    sep, names, double, single = _columns(FIELD.findall("\0" + "\0".join(rest.to_pylist())), 4)
    owner = np.cumsum(pc.not_equal(pa.array(sep, pa.large_string()), "").to_numpy(zero_copy_only=False)) - 1
    names, double, single = (pa.array(c, pa.large_string()) for c in (names, double, single))
    value = pc.if_else(pc.equal(double, ""), single, double)
    fields = {}
    for f in FIELDS:
        mine = np.flatnonzero(pc.equal(names, f).to_numpy(zero_copy_only=False))
        own = pc.replace_substring_regex(value.take(pa.array(mine)), "\r\n|[\t\n\r]", " ")
        coded = pc.greater_equal(pc.find_substring(own, "&"), 0)
        if pc.any(coded).as_py():
            own = pc.replace_with_mask(own, coded, pa.array([_decoded(t) for t in own.filter(coded).to_pylist()], pa.large_string()))
        row = np.full(n, -1)
        row[owner[mine]] = np.arange(len(mine))
        fields[f] = own.take(pa.array(row, mask=row < 0))
    return Elements(np.flatnonzero(good)[doc[at]] if n else at, parent, tag, fields), good


# Tables ------------------------------------------------------------------------------------------------------------
def _ordinals(parents: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """The 1-based place of each element among the siblings of its tag."""
    order = np.lexsort((tags, parents))
    new = np.ones(len(order), bool)
    new[1:] = (parents[order][1:] != parents[order][:-1]) | (tags[order][1:] != tags[order][:-1])
    starts = np.flatnonzero(new)
    places = np.empty(len(order), np.int64)
    places[order] = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order)))) + 1
    return places


def _above(own: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Has an element one with ``own`` anywhere above it? Pointers to ancestors double each round."""
    up = np.where(parent >= 0, parent, len(parent))
    up = np.append(up, len(parent))
    flag = np.append(own, False)[up]
    while (up < len(parent)).any():
        flag = flag | flag[up]
        up = up[up]
    return flag[:-1]


def _depths(parent: np.ndarray) -> np.ndarray:
    """Elements above each element, by doubling pointers as well."""
    n = len(parent)
    up = np.append(np.where(parent >= 0, parent, n), n)
    depth = (up < n).astype(np.int64)
    while (up < n).any():
        depth += depth[up]
        up = up[up]
    return depth[:-1]


def _chains(rows: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """List offsets and flat elements of the way from below the root down to each row."""
    found, owners, at, owner = [], [], rows, np.arange(len(rows))
    while len(at):
        below = parent[at] >= 0
        at, owner = at[below], owner[below]
        found.append(at)
        owners.append(owner)
        at = parent[at]
    flat, owner = (np.concatenate(x)[::-1] if x else np.zeros(0, np.int64) for x in (found, owners))
    order = np.argsort(owner, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(rows)))]), flat[order]


def tables(elements: Elements, ids: pa.Array) -> Iterator[pa.Table]:
    """Rows of items, grids and parents of items (columns of ``SCHEMA``)."""
    parent, tag = elements.parent, elements.tag
    n = len(parent)
    if not n:
        return
    below = parent >= 0
    is_tag = lambda *names: pc.is_in(tag, pa.array(names, pa.large_string())).to_numpy(zero_copy_only=False)
    inner = lambda own: own & below
    grid = inner(is_tag(*GRIDS))
    param = inner(is_tag("Param")) & _above(inner(is_tag("CTF")), parent)
    node = inner(is_tag("Node")) & grid[parent]
    item = param | node
    held = np.zeros(n, bool)
    held[parent[item]] = True
    kind = np.full(n, "element", object)
    kind[grid], kind[param], kind[node] = "grid", "param", "node"
    codes = pc.dictionary_encode(tag).indices.to_numpy(zero_copy_only=False)
    text = lambda x: pa.scalar(x, pa.large_string())
    step = pc.binary_join_element_wise(tag, text("["), pc.cast(pa.array(_ordinals(parent, codes)), pa.large_string()), text("]"), text(""))
    rows = np.flatnonzero(below & (item | grid | held))
    part = np.cumsum(_depths(parent)[rows]) // STEPS
    for k in np.unique(part):
        own = rows[part == k]
        offsets, flat = _chains(own, parent)
        lists = pa.LargeListArray.from_arrays(pa.array(offsets), step.take(pa.array(flat)))
        last = np.zeros(len(flat), bool)
        last[offsets[1:] - 1] = True
        fewer = np.concatenate([[0], np.cumsum(np.diff(offsets) - 1)])
        above = pa.LargeListArray.from_arrays(pa.array(fewer), step.take(pa.array(flat[~last])))
        at = pa.array(own)
        columns = [
            ids.take(pa.array(elements.doc[own])), pa.array(kind[own], pa.string()), tag.take(at), pc.binary_join(above, text("/")), pc.binary_join(lists, text("/")),
            *[elements.fields[f].take(at) for f in FIELDS],
        ]
        yield pa.table(columns, names=COLUMNS)


def _numbers(table: pa.Table) -> pa.RecordBatch:
    columns = []
    for name in table.column_names:
        column = table[name].combine_chunks()
        if name in NUMBERS:
            text = pc.if_else(pc.fill_null(pc.match_substring_regex(column, NUMBER), False), pc.replace_substring_regex(pc.utf8_trim_whitespace(column), r"^\+", ""), None)
            column = pc.cast(text, pa.float64())
        elif name != "ctf_id":
            column = pc.cast(column, pa.string())
        columns.append(column)
    return pa.RecordBatch.from_arrays(columns, names=table.column_names)


def flatten(ids: pa.Array, kinds: pa.Array, bodies: pa.Array) -> Iterator[pa.Table]:
    """The rows of the documents of one chunk."""
    body = pc.replace_substring_regex(pc.cast(bodies, pa.large_string()), "^﻿", "")
    start = pc.utf8_slice_codeunits(pc.utf8_ltrim(body, " \t\r\n﻿"), 0, 1)
    looks = pc.is_in(start, pa.array(["{", "["], pa.large_string()))
    is_json = pc.if_else(pc.is_null(kinds), looks, pc.equal(pc.utf8_lower(pc.cast(kinds, pa.large_string())), "json"))
    some = pc.not_equal(pc.utf8_trim_whitespace(body), "")
    for chosen, read in ((pc.and_(some, is_json), lambda b: json_elements(b)), (pc.and_(some, pc.invert(is_json)), lambda b: xml_elements(b.to_pylist()))):
        own = body.filter(chosen)
        if len(own):
            yield from tables(read(pa.concat_arrays([own]))[0], ids.filter(chosen))


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of documents of at most ``CHUNK`` and ``CHUNK_BYTES``."""
    lengths = pc.binary_length(batch.column("body")).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(lengths):
        if i > at and (i - at >= CHUNK or held + n > CHUNK_BYTES):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if batch.num_rows:
        yield batch.slice(at)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _chunks(batch):
            for table in flatten(*[part.column(c) for c in ("ctf_id", "file_kind", "body")]):
                yield _numbers(table)


def flatten_documents(docs: DataFrame) -> DataFrame:
    """Rows of the items, grids and parents of items of every well-formed document (columns: ``SCHEMA``).

    ``kind`` is ``param`` (a Param with a CTF above), ``node`` (directly below a GridCTF or GridCTFPhase), ``grid`` (such a
    grid) or ``element``. ``parent_path`` of a row is the ``item_path`` of its parent ('' below the root), which links the tables.
    Defined cases: null, blank and malformed bodies give no rows; bodies may be nested to any depth; null list entries and null
    members aren't elements, empty objects and scalars are; of a member given twice in an object the last counts; a JSON
    document needs one root; values are kept in ``value`` as they are written, numbers included, and those that aren't
    numbers are null in the number columns; documents delivered twice give rows under each id; an unknown
    file kind is told by the first character; empty tables give no rows; further columns are ignored.

    Plan: one narrow Arrow stage without a shuffle. Whole chunks of bodies become tokens at once (:func:`json_elements`,
    :func:`xml_elements`); parents are found by sorted levels, ancestors by doubling pointers, paths are Arrow lists of steps
    that are joined, and keys follow by ``take``. Only documents with a type definition and strings with escapes are
    handled one by one.
    """
    return docs.select("ctf_id", "file_kind", "body").where(F.col("body").isNotNull()).mapInArrow(_run, SCHEMA)


def params(flat: DataFrame) -> DataFrame:
    return flat.where(F.col("kind") == "param").select("ctf_id", "parent_path", "item_path", F.col("name").alias("param"), F.col("value").alias("param_value"))


def grids(flat: DataFrame) -> DataFrame:
    return flat.where(F.col("kind") == "grid").select("ctf_id", "parent_path", "item_path", F.col("tag").alias("grid"), "width", "height", "depth")


def nodes(flat: DataFrame) -> DataFrame:
    return flat.where(F.col("kind") == "node").select("ctf_id", "parent_path", "item_path", "x", "y", "z", F.expr("try_cast(value as double)").alias("node_value"))


def parents(flat: DataFrame) -> DataFrame:
    """The elements that items hang from, for joins on (ctf_id, item_path)."""
    used = flat.where(F.col("kind").isin("param", "node")).select("ctf_id", F.col("parent_path").alias("item_path")).distinct()
    return flat.select("ctf_id", "parent_path", "item_path", "tag").join(used, ["ctf_id", "item_path"], "left_semi")
