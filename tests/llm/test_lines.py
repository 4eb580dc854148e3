import hashlib
import random
import re
from collections import defaultdict

from sievegate.llm import lines
from tests.llm import cases


def brute(rows, run=3, long=20):
    marks = []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    places = defaultdict(list)
    for k in order:
        full = [x for line in (rows[k][1] or "").split("\n") if (x := line.strip(lines.SPACES))]
        for s in range(len(full) - run + 1):
            places[tuple(full[s : s + run])].append((k, s))
        for s, line in enumerate(full):
            if len(re.findall(r"[^\x20\x09-\x0D]+", line)) >= long:
                places[(line,)].append((k, s))
    gone = defaultdict(set)
    for what, found in places.items():
        for k, s in found[1:]:
            if rows[k] != rows[found[0][0]] or s != found[0][1]:
                gone[k].update(range(s, s + len(what)))
    for k, (doc_id, text) in enumerate(rows):
        keep, n = [], 0
        for line in (text or "").split("\n"):
            full = bool(line.strip(lines.SPACES))
            if not full or n not in gone[k]:
                keep.append(line)
            n += full
        marks.append((doc_id, n, len(gone[k]), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(marks, key=repr)


def result(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert result(lines.op4_line_dedup(spark, sf_dir)) == brute(rows)


def test_odd_rows(spark):
    data = cases.rows(5)
    assert result(lines.report(cases.frame(spark, data))) == brute([r[:2] for r in data])


def test_texts(spark):
    text = "a\nb\n\nc\nd"
    rows = [(1, text, None, None, None), (2, "new\na\nb\nc\nd\nlast", None, None, None), (3, "a\nb", None, None, None), (4, None, None, None, None)]
    df = cases.frame(spark, rows)
    out = lines.line_dedup(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: text, 2: "new\nlast", 3: "a\nb", 4: None}
    assert lines.line_dedup(cases.frame(spark, [])).count() == 0
    assert lines.report(cases.frame(spark, [])).count() == 0


def test_many_contexts_of_few_lines(spark):
    """Few different lines: fingerprints whose first place has other neighbours, runs that overlap, repeats within a text."""
    rng = random.Random(4)
    rows = [(k, "\n".join(rng.choice("abcd") for _ in range(rng.randrange(14)))) for k in range(120)]
    assert result(lines.report(cases.frame(spark, [(*r, None, None, None) for r in rows]))) == brute(rows)


def test_long_lines(spark):
    long = " ".join(f"w{k}" for k in range(20))
    rows = [(1, f"first\n{long}"), (2, long), (3, f"x\n  {long} \ny"), (4, long[3:]), (5, f"{long}\n{long}")]
    got = {r["doc_id"]: r["text"] for r in lines.line_dedup(cases.frame(spark, [(*r, None, None, None) for r in rows])).collect()}
    assert got == {1: rows[0][1], 2: "", 3: "x\ny", 4: long[3:], 5: ""}
    assert result(lines.report(cases.frame(spark, [(*r, None, None, None) for r in rows]))) == brute(rows)
