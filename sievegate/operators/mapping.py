"""Segments with their checks and fallback, and the signals that fall into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegate.functions.scalars import SEVERITIES, cosine, rank_of

WIDTH = 1024


def checked_segments(atoms: DataFrame, threshold: float = 0.72, min_atoms: int = 1) -> DataFrame:
    """input_id, segment, segment_id, segment_type, n_atoms, start, end, text, failed of the segments of atoms (input_id, ordinal,
    atom_id, block, vector, start, end, text). An input with a missing, empty, zero or not finite vector, or vectors of several
    lengths, fails: it is cut where the block changes. An accepted break leaves at least min_atoms atoms on either side. The atoms
    of one input are gathered in one row, as its breaks depend on those before."""
    order, whole = Window.partitionBy("input_id").orderBy("ordinal"), Window.partitionBy("input_id")
    usable = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & F.exists("vector", lambda x: x != 0)
    sizes = F.size("vector")
    marked = atoms.withColumns({"_ok": F.coalesce(usable, F.lit(False)), "_size": sizes})
    failed = ~(F.min("_ok").over(whole) & (F.min("_size").over(whole) == F.max("_size").over(whole)))
    moved = F.coalesce(F.lead("block").over(order) != F.col("block"), F.lit(False))
    wants = F.coalesce(cosine(F.col("vector"), F.lead("vector").over(order)) < threshold, F.lit(False))
    cuts = marked.withColumns({"failed": failed, "_moved": moved, "_wants": wants}).withColumn("_cut", F.col("_moved") | (~F.col("failed") & F.col("_wants")))
    row = F.struct("ordinal", "_cut", "atom_id", "start", "end", "text")
    per = cuts.groupBy("input_id", "failed").agg(F.sort_array(F.collect_list(row)).alias("atoms"))
    n = F.size("atoms")
    least = F.when(F.col("failed"), 1).otherwise(min_atoms)
    first = F.array(F.lit(-1))

    def step(done: Column, i: Column) -> Column:
        fits = (i - F.element_at(done, -1) >= least) & (n - i - 1 >= least)
        return F.when(F.col("atoms")[i]["_cut"] & fits, F.array_append(done, i)).otherwise(done)

    ends = F.concat(F.aggregate(F.sequence(F.lit(0), n - 1), first, step), F.array(n - 1))
    rows = per.withColumn("_ends", ends).select("input_id", "failed", "atoms", "_ends", F.explode(F.sequence(F.lit(0), F.size("_ends") - 2)).alias("segment"))
    lo, hi = F.col("_ends")[F.col("segment")] + 1, F.col("_ends")[F.col("segment") + 1]
    cut = rows.select("input_id", "failed", "segment", F.slice("atoms", lo + 1, hi - lo + 1).alias("a"))
    kind = F.when(F.size("a") == 1, "single_atom").when(F.col("failed"), "structure").otherwise("semantic")
    name = F.sha2(F.concat_ws(":", "input_id", F.col("a")[0]["atom_id"], F.element_at("a", -1)["atom_id"], "segment"), 256)
    each = lambda c: F.transform("a", lambda x: x[c])
    return cut.select("input_id", "segment", F.concat(F.lit("seg_"), F.substring(name, 1, 16)).alias("segment_id"), kind.alias("segment_type"), F.size("a").alias("n_atoms"), F.array_min(each("start")).alias("start"), F.array_max(each("end")).alias("end"), F.array_join(each("text"), "").alias("text"), "failed")


def mapped_signals(signals: DataFrame, atoms: DataFrame, several: bool = False) -> DataFrame:
    """input_id, signal_id, severity, segment, n_atoms, basis of each signal (input_id, signal_id, block_id, start, end, severity) that
    overlaps an atom (input_id, segment, atom_id, block_id, start, end) of its block; only in its first segment unless several. Of
    signals with one id the first counts. Ranges meet in buckets of 1,024 characters, each pair in one of them."""
    buckets = F.explode(F.sequence(F.floor(F.col("start") / WIDTH), F.floor((F.col("end") - 1) / WIDTH)))
    first = signals.where("start < end").groupBy("input_id", "signal_id").agg(F.min(F.struct("start", "end", "block_id", "severity")).alias("s")).select("input_id", "signal_id", "s.*")
    s = first.withColumn("_bucket", buckets)
    a = atoms.where("start < end").withColumn("_bucket", buckets).select("input_id", "block_id", "_bucket", "segment", "atom_id", F.col("start").alias("_lo"), F.col("end").alias("_hi"))
    once = F.col("_bucket") == F.floor(F.greatest("start", "_lo") / WIDTH)
    met = s.join(a, ["input_id", "block_id", "_bucket"]).where((F.col("start") < F.col("_hi")) & (F.col("_lo") < F.col("end")) & once)
    pairs = met.groupBy("input_id", "signal_id", "block_id", "severity", "segment").agg(F.count("*").alias("n_atoms"))
    if not several:
        best = F.min(F.struct("segment", "n_atoms"))
        pairs = pairs.groupBy("input_id", "signal_id", "block_id", "severity").agg(best.alias("b")).select("input_id", "signal_id", "block_id", "severity", "b.*")
    blocks = atoms.groupBy("input_id", "segment").agg((F.min("block_id") == F.max("block_id")).alias("_one"))
    basis = F.when(F.col("_one"), "offset_overlap").otherwise("atom_membership")
    return pairs.join(blocks, ["input_id", "segment"]).select("input_id", "signal_id", "severity", "segment", "n_atoms", basis.alias("basis"))


def signal_sets(mapped: DataFrame) -> DataFrame:
    """Of each segment with signals their number and highest severity."""
    return mapped.groupBy("input_id", "segment").agg(F.count("*").alias("signal_count"), F.max_by("severity", rank_of(F.col("severity"), SEVERITIES)).alias("max_severity"))
