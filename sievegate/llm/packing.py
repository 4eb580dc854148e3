"""Operator 5: best-fit packing of documents into sequences of CAPACITY tokens, in bulk-synchronous rounds.

A document longer than CAPACITY is cut into pieces of CAPACITY tokens, and a last one. Pieces and open gaps are tables with a row
each. Pieces of over half the capacity open sequences of their own. Then, until no piece is left, a round

* range-sorts pieces and gaps together by size, the longest first;
* sweeps each range: a gap goes on a stack, a piece takes the gap on top, the smallest so far that it fits into (its successor);
* resolves what is left between ranges: a range passes on how many gaps and pieces it could not match, and the first pieces of a
  later range take the last gaps of earlier ones, by rank. So the result is that of one sweep, whatever the ranges are;
* updates the gaps. When nothing fits, the longest pieces open as many new sequences as the tokens left need at least.

A gap of FILL times the longest piece left or more takes as many pieces at once as surely fit. Nothing but four numbers a range
passes through the driver: how many gaps and pieces are left, how many were matched, and the sum of the lengths left; and of the
round the least and the greatest length left.

Defined results: a null text is empty and holds the end id alone. Repeated rows are documents of their own, in any order. A null
doc_id sorts first. Ties of length go by doc_id, piece and start. An empty table gives an empty one. Very long texts are encoded
whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievegate.llm.bpe import encoder
from sievegate.llm.common import documents, materialize, partitions, remove, scratch, tuned

CAPACITY, END = 4096, 1
FILL = 4
ROWS_OF_RANGE = 20_000


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all pieces of docs (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder("word", vocabulary)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _sweep(events: DataFrame, width: int) -> DataFrame:
    """Of events (gap, size, id, slot, room), range-sorted: a row for each gap with the piece it takes, and one for each piece that
    found none. open is the rank, in the range, of gaps and of pieces without a partner; part is the range. A row without gap has the
    numbers of its range: id gaps and pid pieces are left over, of open tokens, and slot pieces are matched."""
    schema = pa.schema([("part", pa.int32()), ("gap", pa.bool_()), ("id", pa.int64()), ("slot", pa.int32()), ("room", pa.int32()), ("pid", pa.int64()), ("length", pa.int32()), ("open", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack, missed, tokens, matched = TaskContext.get().partitionId(), [], 0, 0, 0
        for batch in batches:
            rows = []
            for gap, size, id_, slot, room in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if gap:
                    stack.append((id_, slot, room))
                elif stack:
                    rows.append((part, True, *stack.pop(), id_, size, None))
                    matched += 1
                else:
                    rows.append((part, False, None, None, None, id_, size, missed))
                    missed, tokens = missed + 1, tokens + size
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema=schema)
        for at in range(0, len(stack), 50_000):
            rows = [(part, True, *x, None, None, at + k) for k, x in enumerate(stack[at : at + 50_000])]
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema=schema)
        if stack or missed or matched:
            total = (part, None, len(stack), matched, None, missed, None, tokens)
            yield pa.RecordBatch.from_pydict({name: [x] for name, x in zip(schema.names, total, strict=True)}, schema=schema)

    order = [F.col("size").desc(), F.col("gap").desc(), "id", "slot"]
    ranged = events.repartitionByRange(width, *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(run, "part int, gap boolean, id long, slot int, room int, pid long, length int, open long")


def _carried(totals: list) -> list[tuple[int, int, int, int, int, int]]:
    """Blocks (range of the pieces, their first rank, range of the gaps, their last rank, number, first pair) from rows (part,
    gaps, pieces): what each range left over, the longest first. The first pieces of a range take the last gaps before it."""
    stack: list[list[int]] = []
    blocks, pairs = [], 0
    for t in sorted(totals, key=lambda t: t["part"]):
        rank = 0
        while rank < t["pieces"] and stack:
            part, n = stack[-1]
            took = min(n, t["pieces"] - rank)
            blocks.append((t["part"], rank, part, n - 1, took, pairs))
            rank, pairs = rank + took, pairs + took
            if took == n:
                stack.pop()
            else:
                stack[-1][1] = n - took
        if t["gaps"]:
            stack.append([t["part"], t["gaps"]])
    return blocks


def place(pieces: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, str]:
    """pid, sequence_id (the pid of a piece in it), offset of each row of pieces (pid, length), and their folder; pid is unique."""
    spark = pieces.sparkSession
    columns = "sequence_id long, slot int, pid long, length int, offset int, after int"
    length = F.col("length").cast("int").alias("length")
    opened = [F.col("pid").alias("sequence_id"), F.lit(0).alias("slot"), "pid", length, F.lit(0).alias("offset"), (capacity - F.col("length")).cast("int").alias("after")]
    placed = gaps = pieces.where(2 * F.col("length") > capacity).select(*opened)
    left = pieces.where(2 * F.col("length") <= capacity).select("pid", length)
    sizes = pieces.agg(F.count("*").alias("n"), F.count_if(2 * F.col("length") <= capacity).alias("left"), F.min("length").alias("least")).first()
    rows, remaining, least, longest = sizes["n"], sizes["left"], sizes["least"], capacity // 2
    written: list[str] = []
    while remaining:
        width = max(1, min(partitions(spark), rows // ROWS_OF_RANGE + 1))
        slots = F.when(F.col("after") >= FILL * longest, F.floor(F.col("after") / longest)).otherwise(1).cast("int")
        offered = gaps.where((F.col("slot") == 0) & (F.col("after") >= least)).select("sequence_id", F.col("after").alias("room"), F.posexplode(F.array_repeat(F.lit(0), slots)).alias("slot", "_"))
        events = offered.select(F.lit(True).alias("gap"), (F.col("room") - F.col("slot") * longest).alias("size"), F.col("sequence_id").alias("id"), "slot", "room")
        events = events.unionByName(left.select(F.lit(False).alias("gap"), F.col("length").alias("size"), F.col("pid").alias("id"), F.lit(0).alias("slot"), F.lit(0).alias("room")))
        swept, path = materialize(_sweep(events, width), "packing-swept")
        written.append(path)
        open_piece, open_gap = "NOT gap", "gap AND pid IS NULL"
        totals = swept.where("gap IS NULL").select("part", F.col("id").alias("gaps"), F.col("pid").alias("pieces"), F.col("slot").alias("matched"), F.col("open").alias("tokens")).collect()
        blocks = _carried(totals)
        matched = sum(t["matched"] for t in totals) + sum(b[4] for b in blocks)
        waiting = [t for t in totals if t["pieces"]]
        before, need = {}, 0
        if matched:  # in each range the first pieces go
            for part, rank, _, _, n, _ in blocks:
                before[part] = rank + n
        else:  # nothing fits: the longest pieces open new sequences
            need = -(-sum(t["tokens"] for t in waiting) // capacity)
            for t in sorted(waiting, key=lambda t: t["part"]):
                before[t["part"]] = min(need, t["pieces"])
                need -= before[t["part"]]
        taken = spark.createDataFrame(list(before.items()) or [(-1, 0)], "part int, n long")  # a row for each range
        stays = swept.where(open_piece).join(F.broadcast(taken), "part", "left")
        went = F.col("open") < F.coalesce("n", F.lit(0))
        left = stays.where(~went).select("pid", "length")
        if matched:
            block = F.broadcast(spark.createDataFrame(blocks or [(-1, 0, -1, 0, 0, 0)], "piece_part int, piece_rank long, gap_part int, gap_rank long, n long, pair long"))
            one, two = swept.where(open_piece), swept.where(open_gap)
            one = one.join(block, (F.col("part") == F.col("piece_part")) & F.col("open").between(F.col("piece_rank"), F.col("piece_rank") + F.col("n") - 1)).select((F.col("pair") + F.col("open") - F.col("piece_rank")).alias("pair"), "pid", "length")
            two = two.join(block, (F.col("part") == F.col("gap_part")) & F.col("open").between(F.col("gap_rank") - F.col("n") + 1, F.col("gap_rank")), "left").select("id", "slot", "room", (F.col("pair") + F.col("gap_rank") - F.col("open")).alias("pair"))
            across = two.join(one, "pair", "left").select("id", "slot", "room", "pid", "length")
            every = swept.where("gap AND pid IS NOT NULL").select("id", "slot", "room", "pid", "length").unionByName(across)
            gap = Window.partitionBy("id")  # at most capacity slots
            fill = F.coalesce("length", F.lit(0))
            now = every.select(F.col("id").alias("sequence_id"), "slot", "pid", "length", (capacity - F.col("room") + F.sum(fill).over(gap.orderBy("slot")) - fill).cast("int").alias("offset"), (F.col("room") - F.sum(fill).over(gap)).cast("int").alias("after"))
        else:
            now = stays.where(went).select(*opened)
        gaps, path = materialize(now, "packing-placed")
        placed = placed.unionByName(gaps.where("pid IS NOT NULL"))
        remaining = sum(t["pieces"] for t in waiting) - sum(before.values())
        rows = remaining + sum(t["gaps"] for t in totals) + matched
        if remaining:
            least, longest = left.agg(F.min("length"), F.max("length")).first()
        remove(spark, *written[:-1])  # pieces are still read from the last one
        written = written[-1:]
    return materialize(spark.createDataFrame([], columns).unionByName(placed).select("pid", "sequence_id", "offset"), "packing-sequences")


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows of pieces()."""
    spark = cut.sparkSession
    order = [F.col("length").desc(), "doc_id", "piece", "start", "ids_crc32"]
    ranged = cut.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    numbered, _ = materialize(ranged.withColumn("pid", F.monotonically_increasing_id()), "packing-sorted")
    with scratch(spark) as keep:
        placed, path = place(numbered.select("pid", "length"), capacity)
        keep.append(path)
    return numbered.join(placed.hint("merge"), "pid").select(*cut.columns, "sequence_id", F.col("offset").cast("long").alias("offset"))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text)."""
    tuned(docs.sparkSession)
    cut, path = materialize(pieces(docs, vocabulary or default_vocabulary(), capacity, end_id), "packing-pieces")  # a range sort reads its input twice
    out = assign(cut, capacity)
    remove(docs.sparkSession, path)
    return out


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
