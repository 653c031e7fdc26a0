from __future__ import annotations

import datetime as dt
import json
import random

from rotogrid.operators import drift

SCHEMA = "file_id bigint, stream_id string, record_kind string, tomo_id string, file_kind string, written_at timestamp, body string, fields int"


def file(i, stream, hour, body, form="text", kind="wedge"):
    return (i, stream, kind, None, form, None if hour is None else dt.datetime(2024, 1, 1, hour), body, 1)


FILES = [
    file(1, "s", 1, "﻿# note\r\n zvalue \t angles\tdose\tstatus\r\n0\t-60\t1.0\tok\r\n1\t-57\t2.0\tNA\r\n1\t-57\t2.0\tNA\r\n"),
    file(2, "s", 2, "zvalue\tangles\tweights\tqc\n0\t-60.0\t1\tok\n2\t5\t9\tbad\n"),
    file(3, "s", 2, "zvalue\tangles\tweights\tqc\n0\t-60deg\t1\t?\n2\t5deg\t9\tbad\textra\n"),
    file(4, "s", 3, None),
    file(5, "j", 1, '{"zvalue": 0, "a": "1.50", "b": 1, "gone": null}\nnot json\n{"zvalue": "1", "c": [1]}', "jsonl"),
    file(6, "j", 1, '{"zvalue": 0, " x ": 1.5, "b": "1"}\n{"zvalue": 1, "d": [1]}', "jsonl"),
    file(7, "t", None, "# v\n\ndata_x\nloop_\n_zvalue #1\n_Angles #2\n0 1\n1 nan\n", "star"),
    file(8, "t", 1, "data_x\nloop_\n_zvalue\n_angles\n0 1\n1 2.5\n", "star"),
    file(9, None, 1, "zvalue\tq\n0\t1"),
    file(10, None, 2, "zvalue\tr\n0\t1"),
    file(11, "n", 1, "zvalue\tq\n0\t1", None, None),
    file(12, "n", 2, "zvalue\tr\n0\t1", "other", "kind"),
    file(None, "n", 3, "zvalue\tr\n0\t1"),
]
EXPECTED = {
    (2, "renamed", "dose", "weights"), (2, "renamed", "status", "qc"), (2, "retyped", "angles", "angles"), (2, "retyped", "dose", "weights"),
    (3, "retyped", "angles", "angles"),
    (4, "removed", "angles", ""), (4, "removed", "weights", ""), (4, "removed", "qc", ""),
    (6, "renamed", "a", "x"), (6, "retyped", "a", "x"), (6, "retyped", "b", "b"), (6, "removed", "gone", ""), (6, "renamed", "c", "d"),
    (12, "removed", "q", ""), (12, "added", "", "r"),
    (8, "renamed", "Angles", "angles"), (8, "retyped", "Angles", "angles"),
}


def test_changes_and_replay(spark):
    files = spark.createDataFrame(FILES, SCHEMA)
    ingested = drift.ingest(files).cache()
    found = drift.changes(ingested, files)
    assert {tuple(r) for r in found.collect()} == EXPECTED
    aliases = drift.approved_aliases(found, min_files=1)
    assert {tuple(r) for r in aliases.collect()} == {("Angles", "angles"), ("dose", "weights")}
    assert {r.name for r in drift.unapproved(ingested, aliases).collect()} >= {"status", "qc", "q"}
    joined = drift.records(ingested, aliases, literal=0)
    assert sorted(map(str, joined.collect())) == sorted(map(str, drift.records(ingested, aliases).collect()))
    rows = {(r.file_id, r.record_no): r for r in drift.records(ingested, aliases).collect()}
    assert rows[1, 0].weights == 1.0 and rows[1, 0].rescued == '{"status":"ok"}'
    assert rows[3, 0].angles == -60.0 and rows[3, 0].weights == 1.0 and rows[3, 0].rescued is None
    assert rows[3, 1].rescued == '{"qc":"bad","":"extra"}' and rows[7, 1].angles is None
    assert len(rows) == 3 + 2 + 2 + 2 + 2 + 2 + 2 + 1 + 1 + 1 + 1 + 1


def test_replay_of_other_spellings(spark):
    cells = ["2.50deg", "-15,05", "c2", "c-1", "1e2", "[1;2]", "bad", "12..5", "1,2,3", "--"]
    files = spark.createDataFrame([file(1, "s", 1, "zvalue\tdose\n" + "\n".join(f"{i}\t{c}" for i, c in enumerate(cells)))], SCHEMA)
    rows = drift.records(drift.ingest(files), {"dose": "weights"}).orderBy("record_no").collect()
    assert [r.weights for r in rows] == [2.5, -15.05, 2.0, -1.0, 100.0, None, None, None, None, None]
    assert [r.rescued is None for r in rows] == [True] * 5 + [False] * 5


def test_aliases_over_several_names_take_the_strongest_link(spark):
    renames = [("weights", "dose")] * 3 + [("dose", "Dose")] * 2 + [("Dose", "d")] * 2 + [("angles", "d")] * 5 + [("detail", "x")] + [("y", "z")] * 9
    found = spark.createDataFrame([(i, "renamed", *r) for i, r in enumerate(renames)], "file_id bigint, change string, old_field string, new_field string")
    assert {tuple(r) for r in drift.approved_aliases(found).collect()} == {("dose", "weights"), ("d", "angles"), ("Dose", "weights")}


def test_names_given_twice_and_deep_lines_are_rescued(spark):
    deep = '{"zvalue": 3, "deep": ' + '{"a": [' * 20_000 + "1" + "]}" * 20_000 + ', "dose": 2.5, "s": "x,}"}'
    files = spark.createDataFrame([file(1, "s", 1, "zvalue\tangles\tangles\tq\n0\t1\t2\t3"), file(2, "s", 2, deep + "\n" + deep[:-1], "jsonl")], SCHEMA)
    rows = {r.file_id: r for r in drift.records(drift.ingest(files), {"dose": "weights"}).collect()}
    assert rows[1].angles == 1.0 and rows[1].rescued == '{"angles (2)":"2","q":"3"}'
    assert rows[2].record_key == "3" and rows[2].weights == 2.5 and len(rows) == 2
    kept = json.loads(rows[2].rescued)
    assert kept["s"] == "x,}" and kept["deep"] == deep[deep.index(': {"a"') + 2 : deep.index(', "dose"')]
    fields = {r.file_id: [f.name for f in r.fields] for r in drift.ingest(files).collect()}
    assert fields == {1: ["angles", "q"], 2: ["deep", "dose", "s"]}


def test_predecessors_of_a_hot_stream_with_ties(spark):
    rng = random.Random(1)
    heads = [(i, rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([None, *(dt.datetime(2024, 1, 1, h) for h in range(5))])) for i in range(500)]
    rng.shuffle(heads)
    got = {tuple(r) for r in drift.predecessors(spark.createDataFrame(heads, "file_id bigint, stream_id string, written_at timestamp")).collect()}
    expected = set()
    for s in ("hot", "a", "b"):
        own = [h[0] for h in sorted((h for h in heads if h[1] == s), key=lambda h: (h[2] is not None, h[2] or dt.datetime.min, h[0]))]
        expected |= set(zip(own[1:], own))
    assert got == expected


def test_empty_table(spark):
    files = spark.createDataFrame([], SCHEMA)
    ingested = drift.ingest(files)
    assert drift.changes(ingested, files).count() == 0
    assert drift.records(ingested, {}).count() == 0
