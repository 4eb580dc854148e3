"""Operator 8: near-duplicates by MinHash, with exact verification and connected components.

A document's set holds the hashes of its distinct word shingles. Rows with equal sets form a class, whose smallest doc_id stands
for it, so copies never meet one by one. Each class has the minima of MINIMA universal hashes over its set; classes that agree in
a whole band of ROWS minima share a bucket. With 32 bands of 6, two sets at the threshold of 0.85 miss all buckets with
probability 3e-7, two sets at 0.80 with 6e-5.

In a bucket, every member is compared with one hub, the member that meets most others over all of its buckets; so candidates grow
with the members, not with their square. Pairs pass a check of sizes and signatures, then of the full sets. Links become
components by alternating large-star and small-star. Buckets that still hold several components are looked at again: large ones
with further hubs, then all in blocks, for pairs between different components that sizes and signatures do not rule out.

Defined results: a text without words, or a null one, has an empty set and no link. Rows that repeat a doc_id
are one document as to links: what is near one of them is in the component of all; n_shingles is that of the row. A row without doc_id has no link; its component_id is null and it is kept. Of equal sets the
smallest doc_id is kept. An empty table gives an empty one. Very long texts are read whole; blocks hold a bounded number of hashes.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegate.llm.common import Prefix, documents, join_counted, materialize, mix, partitions, remove, scratch, tuned

SHINGLE, PERCENT = 5, 85
BANDS, ROWS = 32, 6
MINIMA = BANDS * ROWS
LARGE = 64  # members of a bucket from which more hubs are tried
HUB_ROUNDS = 4
BLOCK, BLOCK_ITEMS = 512, 1 << 20  # sets and hashes of sets in a block, on average

_RNG = np.random.Generator(np.random.PCG64(8_191))
_A = _RNG.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
_MULTIPLIERS = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_agreement(percent: int) -> float:
    """Signatures keep a byte of each minimum; agreement below this is six standard deviations off a pair at the threshold."""
    p = percent / 100
    return p - 6 * (p * (1 - p) / MINIMA) ** 0.5


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of a text, A-Z lower-cased."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = np.concatenate([[False], ~((data == 32) | ((data >= 9) & (data <= 13))), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return Prefix(data).spans(edges[::2], edges[1::2])


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text of fewer words has one."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.full(n, min(len(words), size), np.uint64)
    for k in range(min(len(words), size)):
        out = mix(out + words[k : k + n] * _MULTIPLIERS[k])
    return np.unique(out)


def minima(values: np.ndarray) -> np.ndarray:
    """The least value of each universal hash a * x + b (multiply-shift) over a set."""
    low = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    x = values >> np.uint64(32)
    for at in range(0, len(x), 1024):
        block = _A[:, None] * x[None, at : at + 1024]
        block += _B[:, None]
        np.minimum(low, block.min(1), out=low)
    return low >> np.uint64(32)


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out * _MULTIPLIERS[16 + k] + rows[:, k])
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (a digest of the set, null for an empty one), signature, bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = shingle_set(text)
                if not len(found):
                    rows.append((doc_id, 0, None, None, None, None))
                    continue
                low = minima(found)
                d = [int(np.sum(mix(found ^ np.uint64(salt)), dtype=np.uint64).view(np.int64)) for salt in (0x1234567, 0x89ABCDEF01)]
                rows.append((doc_id, len(found), *d, low.astype(np.uint8).tobytes(), band_keys(low).view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema=schema)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, signature binary, bands array<long>")


def _similar_signatures(pairs: DataFrame, percent: int) -> DataFrame:
    """Of rows (a, b, na, nb, sa, sb), the pairs whose sizes and signatures allow a link."""
    sized = pairs.where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    least = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, MINIMA) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array((x == y).mean(1) >= least))

    return sized.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    """Of rows (a, b, xa, xb), the pairs whose sets (sorted hashes, as bytes) are a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for xa, xb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(xa, np.uint64), np.frombuffer(xb, np.uint64)
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


class Verifier:
    """Confirms candidate pairs of class representatives, by signatures and then by full sets."""

    def __init__(self, classes: DataFrame, sets: DataFrame, percent: int):
        self.classes, self.sets, self.percent = classes, sets, percent

    def __call__(self, pairs: DataFrame) -> DataFrame:
        c, s = self.classes, self.sets
        one = c.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("signature").alias("sa"))
        two = c.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("signature").alias("sb"))
        close, close_path = materialize(_similar_signatures(pairs.select("a", "b").distinct().join(one, "a").join(two, "b"), self.percent).distinct(), "near-close")
        full = close.join(s.select(F.col("rep").alias("b"), F.col("items").alias("xb")), "b").join(s.select(F.col("rep").alias("a"), F.col("items").alias("xa")), "a")
        links, _ = materialize(_linked(full.select("a", "b", "xa", "xb"), self.percent).distinct(), "near-links")
        remove(pairs.sparkSession, close_path)
        return links


def stars(edges: DataFrame) -> tuple[DataFrame, str | None]:
    """u, v (the smallest node reachable) of every node u of edges (a, b) but the smallest ones, and the folder they are in (None:
    edges are read as they are), by alternating large-star and small-star. Each half step is written to the shared folder. It ends
    when each node has one parent and no parent has one, which is looked up before each step: what is stars already takes none.
    edges are a written table, or a union of some."""
    spark, path = edges.sparkSession, None
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")  # u > v
    while True:
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("parents"), F.lit(0).alias("children")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("parents"), F.lit(1).alias("children")))
        ends = ends.groupBy("node").agg(F.sum("parents").alias("parents"), F.max("children").alias("children"))
        if not ends.where("parents > 1 OR parents + children > 1").count():
            return now, path
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large-star: larger neighbours of u go to the least of u and its neighbours; no more edges than before
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large, large_path = materialize(large, "star")
        # small-star: smaller neighbours of u, and u, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        now, after_path = materialize(small, "star")
        remove(spark, large_path, *[path] * (path is not None))
        path = after_path


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of edges (a, b)."""
    found, _ = stars(edges)
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(found.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """The stars of found and of further links: what is known goes on from where it is."""
    return stars(found.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(links))[0]


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members (key, rep, n_shingles, c, hub) of buckets that hold more than one component of the stars found, with their component."""
    comp = found.select(F.col("u").alias("rep"), F.col("v").alias("component"))
    with_comp = members.join(comp, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    with_comp, path = materialize(with_comp, "near-components")
    some, some_path = materialize(with_comp.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("_n")).where("lo != hi").select("key", "_n"), "near-some")
    out, _ = materialize(join_counted(with_comp, some, "key", "left_semi"), "near-open")
    remove(members.sparkSession, path, some_path)
    return out


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all sets of a block, by products of their indicator matrices, a slice of values at a time."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    column = place[at]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, len(shared), 2048):
        x, y = np.searchsorted(column, [lo, lo + 2048])
        part = np.zeros((len(sets), 2048), np.float32)
        part[row[x:y], column[x:y] - lo] = 1
        out += part @ part.T
    return out


def _blocked(rows: DataFrame, percent: int, payload: DataFrame) -> DataFrame:
    """The members of open buckets by classes of sizes, each with its own and the next larger one; groups over BLOCK are cut into
    blocks, and every two blocks meet in a task of their own (key, size, i, j)."""
    import math

    step = math.log(100 / percent)
    size = F.floor(F.log(F.col("n_shingles").cast("double")) / step + 1e-9).cast("int")
    sides = F.explode(F.array(F.struct(size.alias("size"), F.lit(True).alias("own")), F.struct((size + 1).alias("size"), F.lit(False).alias("own"))))
    sized = rows.select("key", "rep", "component", "n_shingles", sides.alias("x")).select("key", "rep", "component", "n_shingles", "x.*")
    stats = sized.groupBy("key", "size").agg(F.count("*").alias("m"), F.count_if("own").alias("owners"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum("n_shingles").alias("items"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("items") / BLOCK_ITEMS)).cast("int")
    stats, _ = materialize(stats.where("m > 1 AND owners > 0 AND lo != hi").select("key", "size", F.col("m").alias("_n"), blocks.alias("blocks")), "near-sizes")
    met = join_counted(sized, stats, ["key", "size"])
    cut = met.withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = cut.select("key", "size", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "own", "rep", "component", "n_shingles").join(payload, "rep")
    met = met.select("key", "size", "i", "j", "blk", "own", "rep", "component", "n_shingles", payload.columns[-1])
    return met.repartition(partitions(rows.sparkSession), "key", "size", "i", "j")  # few bytes, much work: not to be coalesced


def _meeting(rows: list[tuple], percent: int) -> np.ndarray:
    """Which rows of two blocks are to be compared: from different components and of fitting sizes, in different blocks if there are two."""
    i, j = rows[0][2:4]
    blk, own, comp, n = (np.array([r[k] for r in rows]) for k in (4, 5, 7, 8))
    ok = (comp[:, None] != comp[None, :]) & (own[:, None] | own[None, :]) & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))
    return ok & (blk[:, None] != blk[None, :]) if i != j else ok


def _each_meeting(rows: DataFrame, fn, ddl: str, schema: pa.Schema) -> DataFrame:
    """fn of the rows of each two blocks, at most 2 * BLOCK or so. They lie side by side: most are a few rows, too many for a
    call of their own."""
    order = ["key", "size", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True))
        held: list[tuple] = []
        for _, group in groupby(every, key=lambda r: r[:4]):
            held += fn(list(group))
            if len(held) >= 5000:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*held, strict=True)), strict=True)), schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*held, strict=True)), strict=True)), schema=schema)

    return rows.sortWithinPartitions(*order).mapInArrow(run, ddl)


def _open_links(rows: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components of open buckets. A first pass over blocks of signatures finds the members that any other
    could be linked to; a second one compares the full sets of these, block by block, and no pair leaves its task unless it is a link."""
    least = least_agreement(percent)

    def active(group: list[tuple]) -> list[tuple]:
        ok = _meeting(group, percent)
        signatures = np.frombuffer(b"".join(r[9] for r in group), np.uint8).reshape(-1, MINIMA)
        out = []
        for k in np.flatnonzero(ok.any(1)).tolist():
            at = np.flatnonzero(ok[k])
            if any(((signatures[x] == signatures[k]).mean(1) >= least).any() for x in (at[:32], at[32:]) if len(x)):
                out.append((group[k][0], *group[k][6:9]))
        return out

    def links(group: list[tuple]) -> list[tuple]:
        ok = _meeting(group, percent)
        if not ok.any():
            return []
        common = _intersections([np.frombuffer(r[9], np.uint64) for r in group])
        rep, n = (np.array([r[k] for r in group]) for k in (6, 8))
        a, b = np.nonzero(np.triu(ok, 1) & (100 * common >= percent * (n[:, None] + n[None, :] - common)))
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        out = []
        for x, y in zip(rep[a].tolist(), rep[b].tolist(), strict=True):
            u, v = find(x), find(y)
            if u != v:
                parent[max(u, v)] = min(u, v)
                out.append((min(x, y), max(x, y)))
        return out

    names = ["key", "rep", "component", "n_shingles"]
    found, path = materialize(_each_meeting(_blocked(rows, percent, classes.select("rep", "signature")), active, ", ".join(f"{c} long" for c in names), pa.schema([(c, pa.int64()) for c in names])).distinct(), "near-active")
    done, _ = materialize(_each_meeting(_blocked(found, percent, sets), links, "a long, b long", pa.schema([("a", pa.int64()), ("b", pa.int64())])).distinct(), "near-links")
    remove(rows.sparkSession, path)
    return done


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text)."""
    spark = tuned(docs.sparkSession)
    with scratch(spark) as keep:
        sketched, sketched_path = materialize(sketches(docs), "near-sketches")
        grouped = sketched.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n_shingles", "signature", "bands"), "doc_id").alias("x"))
        banded, banded_path = materialize(grouped.select("d1", "d2", "rep", "x.*"), "near-banded")
        rows, rows_path = materialize(sketched.select("doc_id", "n_shingles", "d1", "d2"), "near-rows")
        remove(spark, sketched_path)
        exploded = banded.select("rep", "n_shingles", F.explode("bands").alias("key"))
        sizes, sizes_path = materialize(exploded.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1"), "near-sizes")
        shared, shared_path = materialize(join_counted(exploded, sizes, "key").withColumnRenamed("_n", "c"), "near-buckets")
        classes, classes_path = materialize(banded.drop("bands"), "near-classes")
        remove(spark, banded_path, sizes_path)
        ranked = shared.join(shared.groupBy("rep").agg(F.sum("c").alias("degree")), "rep")
        hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("r"))).alias("x"), F.count("*").alias("_n"))
        hubs, hubs_path = materialize(hubs.select("key", "_n", "x.degree", (-F.col("x.r")).alias("hub")), "near-hubs")
        members, _ = materialize(join_counted(shared, hubs, "key").drop("_n"), "near-members")
        remove(spark, shared_path, hubs_path)
        wanted = members.select(F.col("rep").alias("doc_id")).distinct()
        sets, _ = materialize(_sets(docs.join(wanted.hint("merge"), "doc_id", "left_semi")), "near-sets")
        verify = Verifier(classes, sets, percent)
        # one hub for each member first, the one that meets most others; then the hubs of buckets that this left open
        first = members.where("rep != hub").groupBy("rep").agg(F.max_by("hub", F.struct("degree", (-F.col("hub")).alias("r"))).alias("hub"))
        found, _ = stars(verify(first.select(*_ordered("rep", "hub"))))
        rest = _open(members, found)
        of_hub, _ = materialize(rest.groupBy("key").agg(F.max(F.when(F.col("rep") == F.col("hub"), F.col("component"))).alias("of_hub"), F.count("*").alias("_n")), "near-hubs")
        more = verify(join_counted(rest, of_hub, "key").where("component != of_hub").select(*_ordered("rep", "hub")))
        for k in range(HUB_ROUNDS + 1):  # further hubs for large buckets that are still open, as long as they find links
            if not more.isEmpty():
                found = _extended(found, more)
                rest = _open(rest.drop("component"), found)
            elif k:
                break
            if k == HUB_ROUNDS:
                break
            large = rest.where(F.col("c") > LARGE)
            named = large.groupBy("key", "component").agg(F.count("*").alias("m"), F.max_by("rep", F.xxhash64("rep", F.lit(k))).alias("hub2"))
            new = named.groupBy("key").agg(F.max_by(F.struct("hub2", F.col("component").alias("c2")), F.struct("m", F.xxhash64("hub2", F.lit(k)))).alias("x"), F.sum("m").alias("_n"))
            new, new_path = materialize(new.select("key", "_n", "x.*"), "near-hubs")
            more = verify(join_counted(large, new, "key").where("component != c2").select(*_ordered("rep", "hub2")))
            remove(spark, new_path)
        more = _open_links(rest, classes, sets, percent)
        found = found if more.isEmpty() else _extended(found, more)
        component, component_path = materialize(found.select(F.col("u").alias("rep"), F.col("v").alias("component")), "near-component")
        keep += [rows_path, classes_path, component_path]
    of_class = classes.select("d1", "d2", "rep").join(component, "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("found"))
    out = rows.join(of_class, ["d1", "d2"], "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _sets(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("rep", pa.int64()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t).tobytes() for t in batch.column(1).to_pylist()]
            if found:
                out = pa.RecordBatch.from_pydict({"rep": batch.column(0), "items": found}, schema=schema)
                yield out.filter(pa.array([len(x) > 0 for x in found]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "rep long, items binary")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
