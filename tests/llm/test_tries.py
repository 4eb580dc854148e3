"""Operator 13 against a plain trie, with hot conversations, deep ones, ties, and turnless members; intervals hold subtrees."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sievegate.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def remainder(c):
    return abs(c) % 100 * (1 if c >= 0 else -1)  # as in SQL


def plain(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - remainder(c), [])[:h]) + tuple(v[h:])
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    out = []
    for p, of in members.items():
        below = [q for q in members if q[: len(p)] == p]
        inner = {q[:-1] for q in members if q}
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in of if len(paths[c]) == len(p))
        out.append((of[0], len(p), members[p[:-1]][0] if p else None, len(of), sum(len(q) == len(p) + 1 for q in below), sum(q not in inner for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def some(seed, convs=60, deep=0):
    rng = random.Random(seed)
    said = [(rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "héllo 🙂", "a b", "long " * 20])) for _ in range(6)]
    rows = []
    for c in [*range(0, convs), 100, 103, 250, 251, 300, -5, -100, 7]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9, 18])):
            rows.append((c, rng.choice([t, t, t, None, 2]), *rng.choice(said)))
    for c in range(400, 440):  # a hot conversation
        rows += [(c, t, "user", f"same {t}") for t in range(6)]
    for t in range(deep):
        rows.append((500, t, "user", f"turn {t % 3}"))
        rows.append((501, t, "user", f"turn {t % 3}" if t != deep - 1 else "other"))
    return [*rows, rows[3], rows[3], (None, 1, "user", "nobody"), (777, None, None, None)]


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("extra").alias(c) for c in ("depth", "h1", "place", "rank", "_n", "length")]).repartition(5)
    return tries.trie(df)


@pytest.mark.parametrize(("seed", "deep"), [(1, 0), (2, 300)])
def test_equals_plain_trie(spark, seed, deep):
    rows = some(seed, deep=deep)
    got = run(spark, rows)
    data = [r.asDict() for r in got.collect()]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in data), key=repr) == plain(rows)
    # an interval holds its subtree: as many leaves as its node says, and intervals nest
    assert sorted(r["preorder"] for r in data) == list(range(len(data)))
    leaf = {r["preorder"]: r["n_children"] == 0 for r in data}
    for r in data:
        assert sum(leaf[k] for k in range(r["preorder"], r["subtree_end"] + 1)) == r["n_leaves"]
    open_ends = []
    for r in sorted(data, key=lambda r: r["preorder"]):
        while open_ends and open_ends[-1] < r["preorder"]:
            open_ends.pop()
        assert len(open_ends) == r["depth"] and (not open_ends or r["subtree_end"] <= open_ends[-1])
        open_ends.append(r["subtree_end"])


def test_small_tables(spark):
    assert run(spark, []).collect() == [] and run(spark, [(None, 1, "u", "x")]).collect() == []
    turnless = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(turnless, 0, "u", "x")]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in run(spark, rows).collect()), key=repr) == plain(rows)


def test_digest_of_many_members_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(tries, "LISTED", 7)
    members = spark.range(1000).selectExpr("if(id % 3 = 0, 1, id % 5) as node", "id as conv_id")
    want = defaultdict(list)
    for k in range(1000):
        want[1 if k % 3 == 0 else k % 5].append(str(k))
    got = {r["node"]: r["ends_sha256"] for r in tries.digests(members, ["node"]).collect()}
    assert got == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}
