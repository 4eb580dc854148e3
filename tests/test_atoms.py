"""Atoms against a plain reading of the rules, and segments of bounded size."""

import re

import pytest

from sievegate.operators import atoms, segments

BLOCKS = [
    ("a", "b0", 0, "text", "  one two\n \nthree\n\n\nfour  "),
    ("a", "b1", 1, "text", "before ```code``` after\n~~~ open"),
    ("b", "b0", 0, "text", "x|y\n1|2\n"),
    ("b", "b1", 1, "csv", "x,y\n\n1,2"),
    ("b", "b2", 2, "text", "x,y\n1,2"),
    ("b", "b3", 3, "text", "x||y\n1|2|3"),
    ("c", "b0", 0, "ocr", "a line\n\nanother"),
    ("d", "b0", 0, "text", None),
    ("d", "b1", 1, "text", " 　\n"),
    ("e", "b0", 0, "text", "word " * 50 + "end. " + "x" * 700 + "\U0001f600" * 600 + "\n" + "tail"),
    ("f", "b0", 0, "text", "line one\n" * 90),
]


def sized(text, most):
    out = []
    while len(text) > most:
        head = text[:most]
        at = next((k for test in (lambda c: c == "\n", lambda c: c in ".!?。！？", str.isspace) if (k := max((i for i in range(1, most) if test(head[i])), default=0))), most - 1)
        out.append(text[: at + 1])
        text = text[at + 1 :]
    return [*out, text]


def test_structure(spark):
    df = atoms.atoms(spark.createDataFrame(BLOCKS, "input_id string, block_id string, block_order int, source_type string, text string"))
    rows = df.orderBy("input_id", "ordinal").collect()
    found = lambda i: [(r.ordinal, r.atom_type, r.atom) for r in rows if r.input_id == i]
    assert found("a") == [(0, "paragraph", "one two"), (1, "paragraph", "three"), (2, "paragraph", "four"), (3, "paragraph", "before "), (4, "code_block", "```code```"), (5, "paragraph", " after\n"), (6, "code_block", "~~~ open")]
    assert found("b") == [(0, "table_row", "x|y"), (1, "table_row", "1|2"), (2, "table_row", "x,y"), (3, "table_row", "1,2"), (4, "paragraph", "x,y\n1,2"), (5, "paragraph", "x||y\n1|2|3")]
    assert found("c") == [(0, "ocr_line", "a line\n\nanother")] and not found("d")
    texts = {(i, b): t for i, b, _, _, t in BLOCKS}
    assert all(texts[r.input_id, r.block_id][r.start : r.end] == r.atom and len(r.atom) <= 512 for r in rows)
    assert [a for *_, a in found("e")] == sized(texts["e", "b0"].strip(), 512)
    assert len({r.atom_id for r in rows}) == len(rows)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    df = atoms.atoms(docs.selectExpr("doc_id AS input_id", "'b' AS block_id", "0 AS block_order", "'text' AS source_type", "text"), 100)
    got = {}
    for r in df.where("atom_type = 'paragraph'").orderBy("input_id", "ordinal").collect():
        got.setdefault(r.input_id, []).append(r.atom)
    checked = 0
    for r in docs.collect():
        content = r.text.strip()
        if "```" in content or "~~~" in content or "|" in content or "\t" in content:
            continue
        want = [x for p in re.split(r"\n[ \t\r\f\v]*\n+", content) if p.strip() for x in sized(p.strip(), 100)]
        assert got.get(r.doc_id, []) == want
        checked += 1
    assert checked > 100


@pytest.mark.parametrize("sizes", [[10, 20, 30], [100, 100, 100, 1], [250, 1, 1], [60, 60, 60, 60, 60]])
def test_refill(spark, sizes):
    rows = [(1, k, 0, n) for k, n in enumerate(sizes)]
    got = segments.refill(spark.createDataFrame(rows, "input_id int, ordinal int, segment int, n_chars int"), 200).orderBy("segment").collect()
    want, now = [], []
    for n in sizes:
        if now and sum(now) + n > 200:
            want.append(now)
            now = []
        now.append(n)
    want.append(now)
    assert [(r.n_atoms, r.n_chars) for r in got] == [(len(g), sum(g)) for g in want]
    assert {r.segment_type for r in got} == {"size_fallback" if sum(sizes) > 200 else "semantic"}


def test_split_large(spark):
    rows = [(1, k, 0, False, c, n) for k, (c, n) in enumerate([(None, 900), (0.9, 900), (0.8, 900), (0.8, 10)])]
    got = segments.split_large(spark.createDataFrame(rows, "input_id int, ordinal int, segment int, breaks boolean, cosine double, n_chars int"))
    assert [r.segment for r in got.orderBy("ordinal").collect()] == [0, 0, 1, 1]
