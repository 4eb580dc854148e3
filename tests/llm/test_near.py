import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from sievegate.llm import near
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            by[x].append(k)
    common = Counter(p for ks in by.values() for p in combinations(ks, 2))
    for (i, j), c in common.items():
        if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c) and rows[i][0] is not None and rows[j][0] is not None:
            a, b = sorted((find(rows[i][0]), find(rows[j][0])))
            parent[b] = a
    return [(d, len(s), None if d is None else find(d), d is None or find(d) == d) for (d, _), s in zip(rows, sets, strict=True)]


def result(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()], key=repr)


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(near.op8_minhash_near_dedup(spark, sf_dir)) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("rounds", [0, 2])
def test_odd_rows(spark, monkeypatch, rounds):
    monkeypatch.setattr(near, "LARGE", 1)
    monkeypatch.setattr(near, "BLOCK", 3)
    monkeypatch.setattr(near, "HUB_ROUNDS", rounds)  # 0: what the first hubs leave open is for blocks alone
    data = [r for r in cases.rows() if r[:2] != (3, "another text of a repeated doc_id")]
    assert result(near.near_duplicates(cases.frame(spark, data))) == sorted(brute([r[:2] for r in data]), key=repr)


def test_chain_without_centre(spark):
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(words[k : k + 120]) for k in range(0, 160, 4)] * 3  # each is near its neighbours only
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    got = result(near.near_duplicates(cases.frame(spark, rows, False)))
    assert got == sorted(brute([r[:2] for r in rows]), key=repr)
    assert {r[2] for r in got} == {0}


def test_repeated_doc_id_and_empty_table(spark):
    x, y, z = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyz")
    rows = [(5, x), (5, y), (9, x + " more"), (3, y + " more"), (7, z), (8, z + " more")]
    got = near.near_duplicates(cases.frame(spark, [(k, t, None, None, None) for k, t in rows], False)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == [(3, 57, 3, True), (5, 56, 3, False), (5, 56, 3, False), (7, 56, 7, True), (8, 57, 7, False), (9, 57, 3, False)]
    assert near.near_duplicates(cases.frame(spark, [])).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 130), (130, 115), (200, 201)]
    got = {r["node"]: r["component"] for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 130: 100, 115: 100, 200: 200, 201: 200}


def test_steps_end_with_stars(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(near, "materialize", lambda df, tag, of=near.materialize: steps.append(tag) or of(df, tag))
    path = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert sorted((r["u"], r["v"]) for r in near.stars(path)[0].collect()) == [(2, 1), (3, 1)]
    assert steps == ["star", "star"]  # one step, and none more to see that it was the last
    star = spark.createDataFrame([(1, 2), (1, 3), (9, 8)], "a long, b long")
    assert sorted((r["u"], r["v"]) for r in near.stars(star)[0].collect()) == [(2, 1), (3, 1), (9, 8)]
    assert steps == ["star", "star"]
    more = near._extended(near.stars(star)[0], spark.createDataFrame([(3, 8), (20, 21)], "a long, b long"))
    assert sorted((r["u"], r["v"]) for r in more.collect()) == [(2, 1), (3, 1), (8, 1), (9, 1), (21, 20)]
