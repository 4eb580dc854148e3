"""Operator 13: conversation prefix trie by preorder intervals.

A node is a distinct sequence of first turns of rebuilt conversations; its key is its depth and two 64-bit sums (exclusive or) of
hashes of (place, role, text). Distinct conversations are ranked lexicographically: blocks of up to 16 turns get dense ranks from a
range sort, then blocks of up to 16 of these ranks, and so on, so each level has a sixteenth of the rows. A node is met first in
one ranked conversation and last in another, and in all between them. Sorted by (first, depth) the nodes are in preorder, and the
subtree of a node ends with the last node that is new in its last conversation. Leaves and savings of subtrees are differences of
distributed prefix sums: sums within the partitions of a range sort, to which those of the partitions before are added.

No conversation, node or list of members is gathered in one row or task: turns are numbered within ranges, blocks hold 16 rows,
frequent keys are salted in joins. A digest of members runs over one row for each ``LISTED`` members, in order, in bounded memory.

Nulls: null turns come first, null role or text is empty; rows without conv_id belong to no conversation and are left out. Ties of
turn go by role, then text. conv_id - conv_id % 100 and the remainder of the checksum are as in SQL. Rows that repeat are turns of
their own. Turnless conversations are members of the root alone. An empty table gives an empty one. Very long texts count by their
characters and are hashed whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievegate.llm.common import join_counted, materialize, partitions, tuned

BASE, SHARED = 100, 6  # conversations of one hundred share up to 5 turns with its first
BLOCK = 16
LISTED = 4096
NODE = ["depth", "h1", "h2"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def _ordered(df: DataFrame, keys: list[str], tag: str, columns: list[Column] | None = None) -> DataFrame:
    """df (or columns of it) as a written table in ranges of keys: _range and _at give the place of a row, in order. Rows with equal
    keys are split too."""
    split = df.withColumn("_tie", F.monotonically_increasing_id())
    ranges = split.repartitionByRange(partitions(df.sparkSession), *keys, "_tie").sortWithinPartitions(*keys, "_tie")
    at = ranges.withColumn("_at", F.monotonically_increasing_id())
    return materialize(at.select(*(columns or df.columns), "_at", F.shiftright("_at", 33).alias("_range")), tag)[0]


def _running(df: DataFrame, sums: dict[str, Column | str], group: list[str], add: str = "sum") -> DataFrame:
    """Running totals (this row included) over each group of an ordered table: within its ranges, then over the ranges."""
    add_up = {"sum": F.sum, "bit_xor": F.bit_xor}[add]
    join = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}[add]
    inner = Window.partitionBy("_range", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    parts = df.groupBy("_range", *group).agg(*[add_up(v).alias(f"_{k}") for k, v in sums.items()], F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1) if group else None
    if group:
        carried = parts.select("_range", *group, "_n", *[F.coalesce(add_up(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
        carried = materialize(carried, "carried")[0]
        return df.withColumns({k: add_up(v).over(inner) for k, v in sums.items()}).join(carried.drop("_n"), ["_range", *group]).withColumns({k: join(F.col(k), F.col(f"_{k}")) for k in sums}).drop(*[f"_{k}" for k in sums])
    totals, at = {}, dict.fromkeys(sums, 0)
    for r in sorted(parts.collect(), key=lambda r: r["_range"]):  # a row for each range
        totals[r["_range"]] = dict(at)
        at = {k: at[k] + r[f"_{k}"] for k in sums}
    spark = df.sparkSession
    if not totals:
        return df.withColumns({k: F.lit(0).cast("long") for k in sums})
    carried = spark.createDataFrame([(r, *[int(x[k]) for k in sums]) for r, x in totals.items()], "_range long, " + ", ".join(f"_{k} long" for k in sums))
    return df.withColumns({k: add_up(v).over(inner) for k, v in sums.items()}).join(F.broadcast(carried), "_range").withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop(*[f"_{k}" for k in sums])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), t1, t2 (hashes of the turn), chars of every turn, in order. Texts are sorted, but not written."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)
    hashed = [F.col("conv_id"), F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit("second"), "text", "role").alias("t2"), F.length("text").cast("long").alias("chars")]
    kept = _ordered(rows, ["conv_id", "turn", "role", "text"], "turns", hashed)
    return _running(kept, {"place": F.lit(1).cast("long")}, ["conv_id"]).select("conv_id", (F.col("place") - 1).alias("place"), "t1", "t2", "chars")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations (conv_id, depth from 1, t1, t2, chars), and all conversations (conv_id, length)."""
    length = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("long")
    convs = length.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % BASE).alias("base"))
    first = own.where(F.col("place") < SHARED - 1).withColumnRenamed("conv_id", "base")
    taken = convs.join(length.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    convs = materialize(taken.select("conv_id", "n", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("shared")), "conversations")[0]
    of_base = convs.select("conv_id", "base", "h").join(first, "base").where("place < h").select("conv_id", (F.col("place") + 1).alias("depth"), "t1", "t2", "chars")
    kept = join_counted(own, convs.select("conv_id", "h", "shared", F.col("n").alias("_n")), "conv_id").where("place >= h")
    rows = of_base.unionByName(kept.select("conv_id", (F.col("place") - F.col("h") + F.col("shared") + 1).alias("depth"), "t1", "t2", "chars"))
    return rows, convs.select("conv_id", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def keyed(rows: DataFrame) -> DataFrame:
    """Adds h1, h2 (of the first turns up to this one) and p1, p2 (up to the one before)."""
    of = [F.xxhash64(F.lit(seed), "depth", "t1", "t2") for seed in (1, 2)]
    ordered = _ordered(rows.withColumns({"g1": of[0], "g2": of[1]}), ["conv_id", "depth"], "rebuilt")
    out = _running(ordered, {"h1": "g1", "h2": "g2"}, ["conv_id"], "bit_xor")
    return out.select("conv_id", "depth", "t1", "t2", "chars", "h1", "h2", F.col("h1").bitwiseXOR(F.col("g1")).alias("p1"), F.col("h2").bitwiseXOR(F.col("g2")).alias("p2"))


def ranks(rows: DataFrame, longest: int) -> DataFrame:
    """rank (from 0) of each of the distinct conversations of rows (conv_id, place, t1, t2) in lexicographic order of turns."""
    at = rows.select("conv_id", F.col("place").alias("j"), F.struct("t1", "t2").alias("v"))
    while True:
        block = F.transform(F.array_sort(F.collect_list(F.struct((F.col("j") % BLOCK).alias("o"), "v"))), lambda x: x["v"])  # BLOCK at most
        blocks = at.groupBy("conv_id", F.floor(F.col("j") / BLOCK).alias("k")).agg(block.alias("b"))
        blocks = materialize(blocks.select("conv_id", F.col("k").alias("j"), "b", F.xxhash64("b").alias("k1"), F.xxhash64(F.lit(1), "b").alias("k2")), "blocks")[0]
        distinct = blocks.groupBy("k1", "k2").agg(F.first("b").alias("b"), F.count("*").alias("_n"))
        numbered = _running(_ordered(distinct, ["b"], "ranges"), {"rank": F.lit(1).cast("long")}, [])
        small = materialize(numbered.select("k1", "k2", "_n", "rank"), "ranked")[0]
        at = join_counted(blocks.select("conv_id", "j", "k1", "k2"), small, ["k1", "k2"]).select("conv_id", "j", F.col("rank").alias("v"))
        longest = -(-longest // BLOCK)
        if longest <= 1:
            return at.select("conv_id", (F.col("v") - 1).alias("rank"))


def digests(members: DataFrame, key: list[str]) -> DataFrame:
    """ends_sha256 of the ids of each key, ascending, joined by commas. Ids are joined by LISTED in ranges of (key, id), so the task
    of a key reads one row for each LISTED of its members, and holds one."""
    names = members.select(*key).dtypes
    schema = ", ".join(f"{n} {t}" for n, t in names)
    arrow = [(n, pa.int64()) for n, _ in names]
    chunk, digest = pa.schema([*arrow, ("least", pa.int64()), ("ids", pa.string())]), pa.schema([*arrow, ("ends_sha256", pa.string())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []
        out: list[tuple] = []
        for batch in batches:
            for *k, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now or len(ids) == LISTED:
                    if ids:
                        out.append((*now, ids[0], ",".join(map(str, ids))))
                    now, ids = k, []
                ids.append(i)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), chunk, strict=True)], schema=chunk)
                out = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*now, ids[0], ",".join(map(str, ids))), chunk, strict=True)], schema=chunk)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for *k, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), digest, strict=True)], schema=digest)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*now, state.hexdigest()), digest, strict=True)], schema=digest)

    n = partitions(members.sparkSession)
    listed = members.select(*key, "conv_id").repartitionByRange(n, *key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(chunks, f"{schema}, least long, ids string")
    return listed.repartition(n, *key).sortWithinPartitions(*key, "least").mapInArrow(streamed, f"{schema}, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and its
    interval: preorder (the root: 0) and subtree_end, the preorder of the last node of its subtree."""
    tuned(conversations.sparkSession)
    own = materialize(turns(conversations), "own-turns")[0]
    rows, convs = rebuilt(own)
    rows = materialize(keyed(rows), "prefixes")[0]
    convs = materialize(convs, "lengths")[0]
    longest, members, root_id = convs.agg(F.max("length"), F.count("*"), F.min("conv_id")).first()
    if not members:
        return _empty(conversations.sparkSession)
    # the last turn of a conversation is where its node ends; of conversations that end alike the least stands for all
    last = join_counted(rows.select("conv_id", *NODE), convs.select("conv_id", "length", F.col("length").alias("_n")), "conv_id").where("depth = length")
    ends = materialize(last.select("conv_id", *NODE), "ends")[0]
    shown = ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"))
    shown = materialize(shown.select("conv_id", F.col("depth").alias("_n")), "shown")[0]
    if longest:
        ranked = ranks(join_counted(rows.select("conv_id", (F.col("depth") - 1).alias("place"), "t1", "t2"), shown, "conv_id", "left_semi"), longest)
        ranked = materialize(ranked.join(shown, "conv_id"), "conversation-ranks")[0]
    else:
        ranked = shown.withColumn("rank", F.lit(0).cast("long"))
    of_rank = join_counted(rows, ranked, "conv_id", "left")
    nodes = of_rank.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("rank").alias("first"), F.max("rank").alias("last"))
    nodes = materialize(nodes, "nodes")[0]
    parent = nodes.select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2"))
    kids = parent.groupBy(*NODE).agg(F.count("*").alias("n_children"))
    n_children = F.coalesce("n_children", F.lit(0))
    nodes = nodes.join(kids, NODE, "left").withColumn("n_children", n_children).withColumn("saves", (F.col("n_convs") - 1) * F.col("chars"))
    order = _ordered(nodes, ["first", "depth"], "preorder")
    one = F.lit(1).cast("long")
    leaf = (F.col("n_children") == 0).cast("long")
    summed = materialize(_running(order, {"pos": one, "leaves": leaf, "saved": "saves"}, []).drop("_at", "_range"), "prefix-sums")[0]
    at_end = summed.groupBy(F.col("first").alias("last")).agg(F.max_by(F.struct("pos", "leaves", "saved"), "pos").alias("e"))
    used = summed.groupBy("last").agg(F.count("*").alias("_n"))
    at_end = materialize(at_end.join(used, "last").select("last", "_n", "e.*").toDF("last", "_n", "e_pos", "e_leaves", "e_saved"), "subtree-ends")[0]
    parents = materialize(kids.where("depth > 0").withColumnRenamed("n_children", "_n").join(summed.select(*NODE, F.col("conv_id").alias("parent_conv_id")), NODE), "parents")[0]
    whole = join_counted(summed.withColumn("leaf", leaf), at_end, "last")
    up = [F.col("depth") - 1, F.col("p1"), F.col("p2")]
    whole = whole.select("conv_id", *NODE, *[c.alias(f"q{k}") for k, c in enumerate(up)], "n_convs", "n_children", (F.col("e_leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"), (F.col("e_saved") - F.col("saved") + F.col("saves")).alias("saved_tokens"), F.col("pos").alias("preorder"), F.col("e_pos").alias("subtree_end"))
    below = join_counted(whole, parents.toDF("q0", "q1", "q2", "_n", "parent_conv_id"), ["q0", "q1", "q2"], "left")
    below = below.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root_id)).otherwise(F.col("parent_conv_id")))
    listed = below.join(digests(ends, NODE), NODE, "left")
    total = summed.agg(F.count("*").alias("n"), F.sum(leaf).alias("leaves"), F.sum("saves").alias("saved"), F.count_if(F.col("depth") == 1).alias("children"))
    # the root: turnless conversations end there
    zero = F.lit(0).cast("long")
    none = digests(convs.where("length = 0").select(zero.alias("depth"), "conv_id"), ["depth"])
    root = total.select(F.lit(root_id).cast("long").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(members).cast("long").alias("n_convs"), F.col("children").alias("n_children"), F.greatest(F.coalesce("leaves", zero), one).alias("n_leaves"), F.coalesce("saved", zero).alias("saved_tokens"), zero.alias("preorder"), F.col("n").alias("subtree_end"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "preorder", "subtree_end", "ends_sha256"]
    out = listed.select(*columns).unionByName(root.join(F.broadcast(none), "depth", "left").select(*columns))
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))


def _empty(spark: SparkSession) -> DataFrame:
    longs = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "preorder", "subtree_end"]
    return spark.createDataFrame([], ", ".join(f"{c} long" for c in longs) + ", ends_sha256 string")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(tuned(spark).read.parquet(f"{sf_dir}/conversations.parquet")).drop("preorder", "subtree_end")


#: The plain way: every node of every conversation by its list of turns, subtrees by joining nodes with their prefixes. The checksum
#: is worked out bit by bit.
ORACLE = f"""WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, r, x) AS l FROM t GROUP BY c),
s AS (SELECT c, l, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) for i in range(8)]), lambda y, z: xor(y >> 1, CASE WHEN y & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END))), CAST(4294967295 AS BIGINT)) % {SHARED} AS h FROM o),
b AS (SELECT s.c, list_concat(coalesce(b.l[1:s.h], []), s.l[s.h + 1:]) AS l FROM s LEFT JOIN o b ON b.c = s.c - s.c % {BASE}),
m AS (SELECT c, len(l) AS n, d, l[1:d] AS p FROM b, LATERAL (SELECT unnest(generate_series(0, len(l))) AS d)),
g AS MATERIALIZED (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(length(p[d].x), 0) AS saves, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM m GROUP BY p, d),
k AS (SELECT p[1:d-1] AS p, count(*) AS n FROM g WHERE d > 0 GROUP BY 1),
w AS MATERIALIZED (SELECT g.*, coalesce(k.n, 0) AS n_children FROM g LEFT JOIN k USING (p)),
u AS (SELECT p[1:a] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saves) AS saved FROM w, LATERAL (SELECT unnest(generate_series(0, d)) AS a) GROUP BY 1)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, w.ends AS ends_sha256
FROM w JOIN u USING (p) LEFT JOIN g q ON w.d > 0 AND q.p = w.p[1:w.d-1]"""
