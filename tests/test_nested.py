from __future__ import annotations

import json
from collections import Counter
from xml.etree import ElementTree

from rotogrid.operators import nested

XML = """<?xml version="1.0"?><!-- c --><TiltSeries A="1"><CTF><Param Name="Cs" Value="2.7"/><Group><Param Name="V" Value="&lt;x"/></Group></CTF>
<Options><Param Name="no" Value="1"/></Options><GridCTF Width="1" Height="+2" Depth=""><Node X="0" Y="1" Z="1e2" Value="3"/><Box><Node X="9"/></Box><Node><![CDATA[ t ]]></Node></GridCTF>
<Movie><CTF><CTF><Param/></CTF></CTF><GridCTFPhase><Node Value="q"/></GridCTFPhase><GridCTFDoming><Node/></GridCTFDoming></Movie><CTF/></TiltSeries>"""
TREE = {"TiltSeries": {"@attributes": {"A": 1}, "CTF": [None, {"Param": [{"@attributes": {"Name": "Cs", "Value": 2.7}}, None, {}, "text"]}, []], "GridCTF": {"Node": {"@attributes": {"X": 0.0, "Value": None}}}, "GridCTFPhase": {"Node": []}, "Param": {"CTF": None}}}


def walk(tag, kids, path, above, out):
    seen = Counter()
    for name, sub in kids:
        seen[name] += 1
        at = f"{path}/{name}[{seen[name]}]".lstrip("/")
        if name == "Param" and "CTF" in above or name == "Node" and above[-1:] in (["GridCTF"], ["GridCTFPhase"]):
            out.append((path, at))
        walk(name, sub(), at, [*above, name], out)
    return out


def xml_kids(e):
    return [(c.tag, lambda c=c: xml_kids(c)) for c in e]


def json_kids(node):
    if not isinstance(node, dict):
        return []
    return [(k, lambda x=x: json_kids(x)) for k, v in node.items() if k[0] != "@" for x in (v if isinstance(v, list) else [v]) if x is not None]


def test_paths_equal_a_recursive_walk(spark):
    docs = [(1, "xml", XML), (2, "json", json.dumps(TREE)), (3, "xml", XML[:-3]), (4, "json", json.dumps(TREE)[:-1]), (5, "xml", None), (6, "json", " "), (7, "xml", ""), (8, "json", "[1]"), (9, "json", '{"T": {"CTF": {"Param": NaN}}}'), (10, "xml", "﻿<T/>"), (11, None, XML), (12, "json", "{}"), (None, "xml", "<T><CTF><Param/></CTF></T>"), (13, "xml", "<T>" + "<CTF>" * 3000 + "<Param/>" + "</CTF>" * 3000 + "</T>")]
    flat = nested.flatten_documents(spark.createDataFrame([(*d, "clash") for d in docs], "ctf_id bigint, file_kind string, body string, item_path string")).cache()
    items = {(r.ctf_id, r.parent_path, r.item_path) for r in flat.where("kind in ('param', 'node')").collect()}
    from_xml = walk("", xml_kids(ElementTree.fromstring(XML)), "", [], [])
    from_json = walk("", json_kids(TREE["TiltSeries"]), "", [], [])
    deep = "/".join(["CTF[1]"] * 3000)
    assert items == {(i, *p) for i in (1, 11) for p in from_xml} | {(2, *p) for p in from_json} | {(13, deep, deep + "/Param[1]"), (None, "CTF[1]", "CTF[1]/Param[1]")}
    assert len(from_xml) == 6 and len(from_json) == 4
    grid = nested.grids(flat).where("ctf_id = 1 and grid = 'GridCTF'").first()
    assert (grid.width, grid.height, grid.depth) == (1.0, 2.0, None)
    node = nested.nodes(flat).where("ctf_id = 1").orderBy("item_path").first()
    assert (node.x, node.y, node.z, node.node_value) == (0.0, 1.0, 100.0, 3.0)
    assert {r.param_value for r in nested.params(flat).where("ctf_id = 1").collect()} == {"2.7", "<x", None}
    links = nested.parents(flat)
    assert flat.where("kind in ('param', 'node') and ctf_id is not null").join(links.selectExpr("ctf_id", "item_path as parent_path"), ["ctf_id", "parent_path"], "left_anti").count() == 0


def found(kind, *bodies):
    import pyarrow as pa

    ids, kinds = pa.array(range(len(bodies)), pa.int64()), pa.array([kind] * len(bodies), pa.string())
    rows = [r for t in nested.flatten(ids, kinds, pa.array(bodies, pa.string())) for r in t.to_pylist()]
    return sorted((r["ctf_id"], r["item_path"], r["name"], r["value"]) for r in rows if r["kind"] in ("param", "node"))


def test_bodies_of_any_depth():
    n = 20_000
    body = '{"T": ' + '{"CTF": ' * n + '{"Param": {}}' + "}" * n + "}"
    xml = "<T>" + "<CTF>" * n + "<Param/>" + "</CTF>" * n + "</T>"
    path = "/".join(["CTF[1]"] * n + ["Param[1]"])
    assert found("json", body, body[:-1], "{" + body) == [(0, path, None, None)]
    assert found("xml", xml) == [(0, path, None, None)]


def test_names_given_twice_escapes_and_values_as_written():
    twice = '{"T": {"CTF": {"Param": [1, 2]}, "CTF": {"Param": {"@attributes": {"Name": "a", "Name": "\\u00e9\\"x", "Value": 2.50}}}}}'
    assert found("json", twice) == [(0, "CTF[1]/Param[1]", 'é"x', "2.50")]
    assert found("json", '{"T": {"C\\u0054F": {"Param": {"@attributes": {"Value": [1, {"a": "]"}]}}}}}') == [(0, "CTF[1]/Param[1]", None, '[1, {"a": "]"}]')]
    for wrong in ('{"T": {"CTF": {"Param": 01}}}', '{"T": {"CTF": {"Param": "\\x"}}}', '{"T": {"CTF": {"Param": "\t"}}}', '{"T": {"CTF": {"Param": 1,}}}', '{"T": {}} 1', '{"T": {"CTF": {"Param": [1 2]}}}', '{"T": {}, "U": {}}', '{"T" {"CTF": 1}}', '{"T": {"CTF": {"Param": 1]}}', '"\\', '{"T": {"CTF": {"Param": "\\u12g4"}}}'):
        assert found("json", wrong, twice)[0][0] == 1, wrong


def test_types_with_entities_and_marks_within_values():
    body = """<!DOCTYPE T [<!ENTITY p "<Param Name='e'/>"><!ATTLIST Param Value CDATA "d">]><T><CTF>&p;<Param Name="a &gt; b" Value='x="1"'/></CTF></T>"""
    assert found("xml", body) == [(0, "CTF[1]/Param[1]", "e", "d"), (0, "CTF[1]/Param[2]", "a > b", 'x="1"')]
    assert found("xml", """<T><CTF><Param Name="y Value='3'" Value = "a\nb"
    /><!-- <Param/> --><?x <Param/> ?><![CDATA[<Param/>]]></CTF></T>""") == [(0, "CTF[1]/Param[1]", "y Value='3'", "a b")]
    assert found("xml", "<T><CTF><Param></CTF></T>", "<T><CTF><Param/></CTF></T>", "<T/><T/>") == [(1, "CTF[1]/Param[1]", None, None)]


def test_empty_table(spark):
    assert nested.flatten_documents(spark.createDataFrame([], "ctf_id bigint, file_kind string, body string")).count() == 0
