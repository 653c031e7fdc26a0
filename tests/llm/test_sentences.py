from __future__ import annotations

import random

from rotogrid.llm import sentences as S

CELL = "cells array<struct<cell_no: int, cell_kind: string, exec_no: int, mime: string, begin_at: int, n_chars: int>>"
SCHEMA = f"doc_id bigint, text string, {CELL}, begin int, begin_at int"


def document(i, *cells):
    """cells: (kind, body); a marker line stands before each."""
    text, spans = "", []
    for n, (kind, body) in enumerate(cells):
        text += "# %% cell\n"
        spans.append((n, kind, None, None, len(text), len(body)))
        text += body + "\n\n"
    return (i, text, spans, 7, 7)


def parts(cell):
    return [(h, cell[a:b]) for h, a, b in S.blocks(cell)]


def test_blocks():
    cell = (
        "# 1. One. Two\nplain\nwrapped  \n\n\n- item one\n  goes on\n* two\n12. three\n> quote\n> again\n```\ncode. More.\n```\n| a | b |\n|---|---|\n![x. y](z)\n---\n"
        "after![x](y) it\n####### no heading\n#no heading\n> - nested\n-no item\n\n```\nnever closed\n"
    )
    assert parts(cell) == [
        (True, "1. One. Two"), (False, "plain\nwrapped  "), (False, "item one\n  goes on"), (False, "two"), (False, "three"), (False, "quote"), (False, "again"),
        (False, "after![x](y) it\n####### no heading\n#no heading"), (False, "nested\n-no item"),
    ]
    assert parts("") == [] and parts(" \n​\n\t") == [] and parts("#\n# \n-  \n") == [(False, "")]


def test_enclosed():
    for s, spans in {
        "a (b [c] d) e": {"(b [c] d)", "[c]"}, "unmatched ( here. And": set(), "„So?“ er": {"„So?“"}, "“A.” ‘b’": {"“A.”", "‘b’"}, "”بس۔“ x": {"”بس۔“"},
        "it's 'Enough.' don't": {"'Enough.'"}, '"Why?" and "b"': {'"Why?"', '"b"'}, "`a(` b": {"`a(`"}, "« Oui ? » dit": {"« Oui ? »"},
    }.items():
        assert {s[a : b + 1] for a, b in S.enclosed(s)} == spans, s


def test_lookback_reaches_any_distance_in_linear_time():
    s = "Ω" + "1" * 100 + ";" + "-" * 5000 + ";"
    letters = S.Lookback(s, 0, str.isalpha)
    assert [letters(i) for i in (0, 1, 101, len(s) - 1)] == [-1, 0, 0, 0]
    stops = S.Lookback(s, 0, S.STOPS.__contains__)
    assert [stops(i) for i in (101, 102, len(s) - 1)] == [-1, 101, 101]
    # a Greek question mark far behind its last letter, and an ASCII semicolon behind a Latin one
    assert len(S.scan("Ω" + " 1" * 200 + "; b", [{"cell_kind": "text", "begin_at": 0, "n_chars": 404}])[2]) == 1
    assert not S.scan("a" + " 1" * 200 + "; b", [{"cell_kind": "text", "begin_at": 0, "n_chars": 404}])[2]


SUBJECTS = ["The mask", "Our filter", "Every map", "numtile", "A second pass", "This cell"]
VERBS = ["keeps", "hides", "smooths", "replaces"]
OBJECTS = ["the border", "two boxes", "half of the picks", "the signal", "all cells"]
SPECIAL = ["Dr. Vofai hides the border", "See Fig. 21 for two boxes", "We compare e.g. the signal with all cells", "“Is that all?” asked Dr. Lumo", "Ask J. K. Vofai about 3.5 boxes", "The scan (cf. Sec. 3.6) hides all cells", "Set `x.y.` and wait", "Mr. Lumo wrote vol. 12 for us", "The scan opened at 4 p.m."]
OTHER = ["这个单元去掉了盒子。", "备注写着“停。检查。”之后没有内容。", "每个候选峰替换了楔形！", "数值从8.8降到2.28。"]
THAI = ["เซลล์นี้เก็บกล่อง", "ไฟล์ run_2.csv ถูกลบ", "รอบที่สองซ่อนขอบ"]


def corpus(n, seed):
    rng = random.Random(seed)
    docs, truth = [], set()
    for i in range(n):
        cells = []
        for _ in range(rng.randint(1, 4)):
            pieces, at = [], 0
            body = ""
            for _ in range(rng.randint(1, 3)):
                style = rng.choice(["en", "en", "en", "zh", "th"])
                marker = rng.choice(["", "- ", "> ", "3. "])
                body += marker
                count = rng.randint(1, 4)
                for k in range(count):
                    if style == "en":
                        s = rng.choice(SPECIAL) if rng.random() < 0.4 else f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(OBJECTS)}"
                        s += "" if s.endswith(".") else rng.choice([".", ".", ".", "!", "?!", "..."])
                        gap = rng.choice([" ", " ", "  ", "\n", " ​"])
                    elif style == "zh":
                        s, gap = rng.choice(OTHER), ""
                    else:
                        s, gap = rng.choice(THAI), " "
                    pieces.append((len(body), len(body) + len(s)))
                    body += s + (gap if k < count - 1 else "")
                body += "\n\n"
            cells.append(("text", body, pieces))
        doc = document(i, *[c[:2] for c in cells])
        docs.append(doc)
        for (_, _, _, _, base, _), (_, _, pieces) in zip(doc[2], cells):
            truth |= {(i, base + a, base + b) for a, b in pieces}
    return docs, truth


def test_accuracy_on_held_out_text(spark):
    docs, truth = corpus(400, 3)
    got = {tuple(r) for r in S.sentences(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert len(got & truth) > 0.985 * max(len(got), len(truth))


def test_defined_cases(spark):
    docs = [
        (1, None, None, 0, 0), (2, "", [], 0, 0), (3, "abc. Def", None, 0, 0), document(4, ("code", "x. Y"), ("output", "A. B")), document(5, ("text", " \n​ ")),
        document(6, ("text", "no mark at all")), document(6, ("text", "no mark at all")), (7, "short", [(0, "text", None, None, 2, 500), None, (1, "text", None, None, None, 4), (2, "text", None, None, -3, 4), (3, "text", None, None, 1, None)], 0, 0), document(None, ("text", "# Head. Line!")),
        document(8, ("text", "word " * 60000 + "end")),
    ]
    rows = sorted(((-1 if r.doc_id is None else r.doc_id), r.begin_at, r.stop_at) for r in S.sentences(spark.createDataFrame(docs, SCHEMA)).collect())
    assert rows == [(-1, 12, 23), (6, 10, 24), (6, 10, 24), (7, 2, 5), (8, 10, 10 + 300003)]
    assert S.sentences(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_blocks_take_linear_time():
    import time

    for text in ("(" * 200_000, "((a. B) “c.” " * 20_000, "« Oui ? » D. " * 20_000, "; " * 100_000 + "α;", "- " * 50_000, "'a' " * 50_000, "[x](" * 50_000, "![" * 100_000):
        began = time.time()
        spans, _, _ = S.scan(text, [{"cell_kind": "text", "begin_at": 0, "n_chars": len(text)}])
        assert time.time() - began < 8 and len(spans) <= 1


def test_scan_positions_are_code_points():
    text = "🎉🎉 Ja. Nein"
    spans, forced, found = S.scan(text, [{"cell_kind": "text", "begin_at": 0, "n_chars": len(text)}])
    assert [(a, b) for a, b, _ in spans] == [(0, len(text))] and [(f[0], f[1]) for f in found] == [(6, 7)]


def test_rare_tokens_keep_their_counts(spark, monkeypatch):
    """However few tokens are broadcast, levels are those of the exact counts and sentences stay the same."""
    docs, _ = corpus(150, 5)
    table = spark.createDataFrame(docs, SCHEMA)
    got = []
    for most in (10**9, 8):
        monkeypatch.setattr(S, "COUNTED_TOKENS", most)
        got.append(sorted(map(tuple, S.sentences(table).collect())))
    assert got[0] == got[1]


def test_partners_at_any_depth():
    for n in (10, 63, 64, 5000):
        s = "[" + "(" * n + " A. B ] c"
        assert S.enclosed(s) == [(0, s.index("]"))]
