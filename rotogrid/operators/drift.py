"""Ingestion of export files whose fields drift: typed target columns, a rescue column, and every change."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from decimal import Decimal
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rotogrid.operators.nested import json_elements
from rotogrid.operators.skew import join_small
from rotogrid.session import cut

#: The typed columns of the one table, all double.
TARGETS = ("angles", "weights", "detail")
KEYS = {"wedge": "zvalue", "orientations": "pick_id"}
MISSING = frozenset(("", ".", "?", "na", "nan", "null"))
INTEGER = re.compile(r"[+-]?[0-9]+", re.ASCII)
DECIMAL = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", re.ASCII)
INTEGERS = re.compile(rf"{INTEGER.pattern}(?:\n{INTEGER.pattern})*", re.ASCII)
DECIMALS = re.compile(rf"{DECIMAL.pattern}(?:\n{DECIMAL.pattern})*", re.ASCII)
KINDS = ("", "integer", "decimal", "text")
BLANKS = " \t\r\n\v\f\xa0"
#: Aliases that travel as one literal map; more are joined by file.
LITERAL_ALIASES = 100_000
#: How rescued text becomes a double, tried in order; each gives null for what it doesn't read.
CASTS = (
    "try_cast(regexp_extract({0}, '^([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)[A-Za-z°%]*$', 1) as double)",
    "try_cast(replace(regexp_extract({0}, '^([+-]?[0-9]+,[0-9]+)$', 1), ',', '.') as double)",
    "try_cast(regexp_extract({0}, '^[A-Za-z]([+-]?[0-9]+)$', 1) as double)",
)

INGESTED = (
    "file_id bigint, stream_id string, record_kind string, tomo_id string, written_at timestamp, "
    "fields array<struct<name: string, kind: string>>, record_keys array<string>, "
    + ", ".join(f"{t} array<double>" for t in TARGETS)
    + ", rescued array<string>"
)
CHANGES = "file_id bigint, change string, old_field string, new_field string"


class Lexeme(str):
    """A JSON number as written; JSON strings stay plain."""

    __slots__ = ()


_DECODER = json.JSONDecoder(parse_int=Lexeme, parse_float=Lexeme, parse_constant=Lexeme)
_ENCODER = json.JSONEncoder(ensure_ascii=False)
_PIECE = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+')


def _lines(body: str) -> list[str]:
    return re.split(r"\r\n|\n|\r", body.lstrip("﻿"))


def _text_rows(body: str) -> tuple[list[str], list[list[str]]]:
    """Header names and rows of cells of a tab-separated body."""
    names, rows = None, []
    for line in _lines(body):
        if names is None:
            if line.strip(BLANKS) and not line.lstrip(BLANKS).startswith("#"):
                names = [n.strip(BLANKS) for n in line.split("\t")]
        elif line.strip(BLANKS):
            rows.append([v.strip(BLANKS) for v in line.split("\t")])
    return names or [], rows


def _star_rows(body: str) -> tuple[list[str], list[list[str]]]:
    """The same of a STAR body."""
    names, rows = [], []
    for line in _lines(body):
        line = line.strip(BLANKS)
        if not line or line[0] == "#" or not rows and (line.startswith("data_") or line == "loop_"):
            continue
        if not rows and line[0] == "_":
            names.append(re.sub(r"\s+#\s*\d*$", "", line)[1:].strip(BLANKS))
            continue
        rows.append(line.split())
    return names, rows


def _jsonl_records(body: str):
    for line in _lines(body):
        if line.strip(BLANKS):
            try:
                record = _DECODER.decode(line)
            except ValueError:
                continue
            except RecursionError:
                record = _deep_record(line)
            if isinstance(record, dict):
                yield {k.strip(BLANKS): v for k, v in record.items()}


def _deep_record(line: str) -> dict | None:
    """The members of an object nested too deeply for the decoder; nested values stay as they are written."""
    if line.lstrip(BLANKS)[:1] != "{" or not json_elements(pa.array([f'{{"r":{line}}}'], pa.large_string()))[1][0]:
        return None
    out: dict[str, object] = {}
    depth, name, begin = 0, None, 0
    for m in _PIECE.finditer(line):
        piece = m.group()
        depth += piece in "{[" and 1
        if depth == 1 and piece == ":":
            begin = m.end()
        elif depth == 1 and piece in ",}":
            if name is not None:
                text = line[begin : m.start()].strip(BLANKS)
                out[name] = text if text[0] in "{[" else _DECODER.decode(text)
            name = None
        elif depth == 1 and name is None and piece[0] == '"':
            name = json.loads(piece)
        depth -= piece in "}]" and 1
    return out


def _column_kind(values: list[str]) -> int:
    """The widest type of present, unquoted values."""
    if not values:
        return 0
    joined = "\n".join(values)
    return 1 if INTEGERS.fullmatch(joined) else 2 if DECIMALS.fullmatch(joined) else 3


def _kind(value) -> int:
    if not isinstance(value, Lexeme):
        return 3
    return 1 if INTEGER.fullmatch(value) else 2 if DECIMAL.fullmatch(value) else 3


def _lexeme(value) -> str | None:
    """The value as text; None where it is missing."""
    if value is None:
        return None
    text = value.strip(BLANKS) if isinstance(value, str) else json.dumps(value, sort_keys=True, ensure_ascii=False)
    return None if text.lower() in MISSING else text


def _number(text: str) -> float | None:
    return float(text) if DECIMAL.fullmatch(text) else None


def _key(text: str | None) -> str | None:
    """Keys equal as numbers are one key."""
    if text is None or not DECIMAL.fullmatch(text):
        return text
    try:
        value = Decimal(text)
        return str(int(value)) if value == value.to_integral_value() and abs(value.adjusted()) < 40 else str(value.normalize())
    except ArithmeticError:
        return text


def ingest_file(body: str | None, file_kind: str | None, key_field: str | None):
    """Fields in order of first appearance with their widest type; per record its key, the castable target
    values, and all else that isn't missing as a JSON object."""
    if file_kind == "jsonl":
        return _ingest_objects(_jsonl_records(body or ""), key_field)
    return _ingest_rows(*(_star_rows if file_kind == "star" else _text_rows)(body or ""), key_field)


def _ingest_rows(names: list[str], rows: list[list[str]], key_field: str | None):
    """A table with a header, column by column."""
    width, n = len(names), len(rows)
    columns = list(zip(*[(*row[:width], *[""] * (width - len(row))) for row in rows])) if rows else [()] * width
    fields, keys, rest = [], [None] * n, []
    typed: dict[str, list] = {t: [None] * n for t in TARGETS}
    taken: set[str] = set()
    for at, name in enumerate(names):
        column = [None if v.lower() in MISSING else v for v in columns[at]]
        if name in taken:
            # a name given twice: the further columns are rescued whole under names of their own
            free = next(f"{name} ({k})" for k in range(2, width + 2) if f"{name} ({k})" not in taken and f"{name} ({k})" not in names)
            taken.add(free)
            rest.append((free, column))
            continue
        taken.add(name)
        if name == key_field:
            keys = [_key(v) for v in column]
            continue
        present = [v for v in column if v is not None]
        kind = _column_kind(present)
        fields.append({"name": name, "kind": KINDS[kind]})
        if name in typed:
            numbers = [None if v is None else _number(v) for v in column]
            typed[name] = numbers
            if kind == 3:
                rest.append((name, [v if x is None else None for v, x in zip(column, numbers)]))
        elif present:
            rest.append((name, column))
    over = [" ".join(row[width:]) for row in rows]
    if any(over):
        rest.append(("", [v or None for v in over]))
    rescued = []
    for i in range(n):
        kept = {name: column[i] for name, column in rest if column[i] is not None}
        rescued.append(_ENCODER.encode(kept) if kept else None)
    return fields, keys, typed, rescued


def _ingest_objects(records: Iterator[dict], key_field: str | None):
    """Objects whose fields vary, one by one."""
    kinds: dict[str, int] = {}
    keys, rescued = [], []
    typed: dict[str, list] = {t: [] for t in TARGETS}
    for record in records:
        rest: dict[str, str] = {}
        cast = dict.fromkeys(TARGETS)
        key = None
        for name, value in record.items():
            text = _lexeme(value)
            if name == key_field:
                key = _key(text)
                continue
            kinds.setdefault(name, 0)
            if text is None:
                continue
            kinds[name] = max(kinds[name], _kind(value))
            if name in cast and (number := _number(text)) is not None:
                cast[name] = number
            else:
                rest[name] = text
        keys.append(key)
        for t in TARGETS:
            typed[t].append(cast[t])
        rescued.append(_ENCODER.encode(rest) if rest else None)
    return [{"name": n, "kind": KINDS[k]} for n, k in kinds.items()], keys, typed, rescued


def _lists(values: list[list], kind: pa.DataType) -> pa.ListArray:
    """A list column from one flat list and its offsets."""
    offsets = [0, *accumulate(map(len, values))]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(list(chain.from_iterable(values)), kind))


def _ingest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    head = ["file_id", "stream_id", "record_kind", "tomo_id", "written_at"]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            bodies = zip(*[part.column(c).to_pylist() for c in ("record_kind", "file_kind", "body")])
            read = [ingest_file(body, form, KEYS.get(kind or "")) for kind, form, body in bodies]
            fields = [f for f, *_ in read]
            offsets = pa.array([0, *accumulate(map(len, fields))], pa.int32())
            flat = [pa.array([f[k] for own in fields for f in own], pa.string()) for k in ("name", "kind")]
            made = [
                pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(flat, ["name", "kind"])),
                _lists([r[1] for r in read], pa.string()), *[_lists([r[2][t] for r in read], pa.float64()) for t in TARGETS], _lists([r[3] for r in read], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([part.column(h) for h in head] + made, names=[*head, "fields", "record_keys", *TARGETS, "rescued"])


def ingest(files: DataFrame) -> DataFrame:
    """One row for each file (columns ``INGESTED``): the target schema is enforced on every record, unknown fields and
    uncastable values are kept in ``rescued``, a JSON object of field to text for each record.

    Defined cases: null and empty bodies give a file without fields and records; byte-order marks, CRLF, padded
    headers and comments are taken off; lines that aren't JSON objects are no records; cells beyond the header
    are rescued under the empty name; of a header name given twice the first column counts and the others are rescued as
    ``name (2)`` and so on; JSON lines may be nested to any depth; missing marks are null; an unknown ``file_kind`` is read as tab-separated text; a null or unknown ``record_kind`` has no key, so its
    records have none and no rename is found between its files; further columns are ignored. Narrow: no shuffle.
    """
    return files.select("file_id", "stream_id", "record_kind", "file_kind", "tomo_id", "written_at", "body").mapInArrow(_ingest, INGESTED)


def predecessors(headers: DataFrame) -> DataFrame:
    """(file_id, before_id) of each file that has one before it in its stream, by written_at (nulls first), then file_id.

    Files are range-partitioned by (stream, time, id); the first of a stream in a partition takes the last of the
    stream's nearest earlier partition from a table of one row per stream and partition. A stream of any size is
    thus spread, and no window holds more than a partition. Files without a stream have no predecessor.
    """
    placed = cut(
        headers.where(F.col("stream_id").isNotNull()).select("stream_id", "written_at", "file_id")
        .repartitionByRange("stream_id", F.col("written_at").asc_nulls_first(), "file_id")
        .withColumn("part", F.spark_partition_id())
    )
    order = [F.col("written_at").asc_nulls_first(), F.col("file_id")]
    inside = placed.withColumn("before_id", F.lag("file_id").over(Window.partitionBy("stream_id", "part").orderBy(*order)))
    last = placed.groupBy("stream_id", "part").agg(
        F.max_by("file_id", F.struct(F.col("written_at").isNotNull(), F.coalesce("written_at", F.lit(0).cast("timestamp")), "file_id")).alias("last_id")
    )
    earlier = last.withColumn("earlier_id", F.lag("last_id").over(Window.partitionBy("stream_id").orderBy("part"))).drop("last_id")
    return (
        inside.join(earlier, ["stream_id", "part"])
        .select("file_id", F.coalesce("before_id", "earlier_id").alias("before_id"))
        .where(F.col("before_id").isNotNull())
    )


def _columns(row: Mapping) -> dict[str, dict]:
    """field -> key -> value (a float or text) of one ingested file; of a repeated record the first value counts."""
    out: dict[str, dict] = {f["name"]: {} for f in row["fields"]}
    for i, key in enumerate(row["record_keys"]):
        if key is None:
            continue
        for t in TARGETS:
            if (v := row[t][i]) is not None and t in out:
                out[t].setdefault(key, v)
        for name, text in json.loads(row["rescued"][i] or "{}").items():
            if name in out:
                out[name].setdefault(key, text if (v := _number(text)) is None else v)
    return out


def _agree(a: dict, b: dict) -> bool:
    both = a.keys() & b.keys()
    return bool(both) and all(a[k] == b[k] for k in both)


def compare(before: Mapping, after: Mapping) -> Iterator[tuple[str, str, str]]:
    """Changes (change, old_field, new_field) between two ingested files of a stream."""
    was = {f["name"]: f["kind"] for f in before["fields"]}
    now = {f["name"]: f["kind"] for f in after["fields"]}
    lost, new = [n for n in was if n not in now], [n for n in now if n not in was]
    pairs = [(n, n) for n in was if n in now]
    if lost and new:
        old_values, new_values = _columns(before), _columns(after)
    for name in list(lost):
        match = next((n for n in new if _agree(old_values[name], new_values[n])), None) if new else None
        if match is None:
            yield "removed", name, ""
        else:
            new.remove(match)
            pairs.append((name, match))
            yield "renamed", name, match
    for name in new:
        yield "added", "", name
    for a, b in pairs:
        if was[a] and now[b] and was[a] != now[b]:
            yield "retyped", a, b


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file_id", pa.int64()), ("change", pa.string()), ("old_field", pa.string()), ("new_field", pa.string())])
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = [
                dict(zip(schema.names, (row["after"]["file_id"], *found)))
                for row in batch.slice(at, 256).to_pylist()
                for found in compare(row["before"], row["after"])
            ]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def changes(ingested: DataFrame, headers: DataFrame) -> DataFrame:
    """Every change between a file and the one before it in its stream, from the rescue-column form of both.

    ``ingested`` is of :func:`ingest`, best written first, as it is read more than once; ``headers`` has file_id, stream_id
    and written_at. Field lists alone are compared first, in the JVM: only pairs that both lose and gain fields can hold
    a rename, and only their records are shuffled and compared. Pairs are joined by file id, which spreads
    evenly, however large a stream is. Empty tables give no rows.
    """
    profile = ingested.select("file_id", "fields")
    pairs = cut(
        profile.withColumnRenamed("fields", "now").join(predecessors(headers), "file_id")
        .join(profile.select(F.col("file_id").alias("before_id"), F.col("fields").alias("was")), "before_id")
        .withColumn("lost", F.expr("array_except(was.name, now.name)"))
        .withColumn("new", F.expr("array_except(now.name, was.name)"))
    )
    empty = F.lit("")
    both = F.expr("filter(transform(was, w -> struct(w.name as name, w.kind as a, get(filter(now, n -> n.name = w.name), 0).kind as b)), x -> x.b is not null and x.a <> '' and x.b <> '' and x.a <> x.b).name")
    row = lambda change, a, b: F.struct(F.lit(change).alias("change"), a.alias("old_field"), b.alias("new_field"))
    plain = (
        pairs.where((F.size("lost") == 0) | (F.size("new") == 0))
        .select("file_id", F.explode(F.concat(
            F.transform("lost", lambda n: row("removed", n, empty)), F.transform("new", lambda n: row("added", empty, n)), F.transform(both, lambda n: row("retyped", n, n)),
        )).alias("c"))
        .select("file_id", "c.*")
    )
    whole = F.struct("file_id", "fields", "record_keys", *TARGETS, "rescued")
    open_pairs = pairs.where((F.size("lost") > 0) & (F.size("new") > 0)).select("file_id", "before_id")
    after = join_small(ingested.select("file_id", whole.alias("after")), open_pairs, ["file_id"]).select("before_id", "after")
    before = join_small(ingested.select(F.col("file_id").alias("before_id"), whole.alias("before")), open_pairs.select("before_id"), ["before_id"], "left_semi")
    renamed = before.join(after, "before_id").select("before", "after").mapInArrow(_compare, CHANGES)
    return plain.unionByName(renamed)


def approved_aliases(found: DataFrame, targets: Sequence[str] = TARGETS, min_files: int = 2) -> DataFrame:
    """(name, target): field names that renames link to a target, directly or over others, by links of ``min_files`` renames or more.

    Names are reached outward from the targets, a round for each step, and every name takes the target of its strongest link
    (most renames, then by name) to a name reached before. All links stay in Spark; rounds are written to the shared folder.
    """
    links = (
        found.where((F.col("change") == "renamed") & (F.col("old_field") != F.col("new_field")))
        .groupBy("old_field", "new_field").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_files)
    )
    links = cut(
        links.select(F.col("old_field").alias("name"), F.col("new_field").alias("near"), "n")
        .unionByName(links.select(F.col("new_field").alias("name"), F.col("old_field").alias("near"), "n"))
    )
    spark = found.sparkSession
    start = spark.createDataFrame([(t, t) for t in targets], "name string, target string")
    reached, new = start, start
    while True:
        near = links.join(new.withColumnRenamed("name", "near"), "near").join(reached.select("name"), "name", "left_anti")
        best = F.max_by("target", F.struct("n", "near"))  # one row a name, so ties are told by the name it hangs from
        new = cut(near.groupBy("name").agg(best.alias("target")))
        if new.isEmpty():
            return reached.join(start.select("name"), "name", "left_anti")
        reached = cut(reached.unionByName(new))


def unapproved(ingested: DataFrame, aliases: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """(name, n_files): fields that are neither targets nor approved aliases, whose values stay in ``rescued``."""
    seen = ingested.select(F.explode("fields.name").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n_files"))
    return seen.where(~F.col("name").isin(*targets)).join(aliases, "name", "left_anti")


def records(ingested: DataFrame, aliases: DataFrame | Mapping[str, str], targets: Sequence[str] = TARGETS, literal: int = LITERAL_ALIASES) -> DataFrame:
    """One row for each record, with rescued values of approved aliases (name, target) replayed into the typed columns.

    A value is replayed if its column is null and one of ``CASTS`` reads it: a number with or without a unit behind it
    (``2.50deg``), with a decimal comma (``-15,05``), or an integer behind one letter (``c2``). It then leaves ``rescued``.
    Of several names of a target in one record, the target's own comes first, then the others by name. All else, such as lists
    and marks of failure, stays there. Files without records give no rows.

    Up to ``literal`` aliases travel as one literal map and the work is narrow; more are joined to the files' fields and
    grouped by file.
    """
    spark = ingested.sparkSession
    if isinstance(aliases, Mapping):
        aliases = spark.createDataFrame(list(aliases.items()), "name string, target string")
    if aliases.limit(literal + 1).count() <= literal:
        known = {r[0]: r[1] for r in aliases.collect()} | {t: t for t in targets}
        files = ingested.withColumn("__alias", F.from_json(F.lit(json.dumps(known)), "map<string,string>"))
    else:
        every = aliases.unionByName(spark.createDataFrame([(t, t) for t in targets], "name string, target string"))
        held = join_small(ingested.select("file_id", F.explode(F.array_distinct("fields.name")).alias("name")), every, ["name"])
        by_file = held.distinct().groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "target"))).alias("__alias"))
        files = ingested.join(by_file, "file_id", "left").withColumn("__alias", F.coalesce("__alias", F.expr("cast(map() as map<string,string>)")))
    head = ["file_id", "stream_id", "record_kind", "tomo_id", "written_at"]
    rows = files.select(*head, "__alias", F.posexplode(F.arrays_zip("record_keys", *targets, "rescued")).alias("record_no", "r")).select(
        *head, "__alias", "record_no", F.col("r.record_keys").alias("record_key"), *[F.col(f"r.{t}").alias(t) for t in targets],
        F.from_json("r.rescued", "map<string,string>").alias("extra"),
    )
    number = "coalesce(" + ", ".join(c.format("extra[k]") for c in CASTS) + ")"
    for t in targets:
        rows = rows.withColumn(
            "__name",
            F.when(F.col(t).isNull(), F.expr(
                f"get(transform(array_sort(transform(filter(map_keys(extra), k -> __alias[k] = '{t}' and {number} is not null), k -> struct(k <> '{t}' as other, k))), x -> x.k), 0)"
            )),
        )
        rows = rows.withColumn(t, F.coalesce(F.col(t), F.expr(f"get(transform(array(__name), k -> {number}), 0)"))).withColumn(
            "extra", F.when(F.col("__name").isNotNull(), F.expr("map_filter(extra, (k, v) -> k <> __name)")).otherwise(F.col("extra"))
        )
    return rows.drop("__name", "__alias").withColumn("rescued", F.when(F.size("extra") > 0, F.to_json("extra"))).drop("extra")
