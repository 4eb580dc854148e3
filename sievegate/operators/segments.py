"""Atoms and segments: cosine breaks between neighbours, segment vectors, linear scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegate.functions.scalars import cosine

BREAK = 0.72


def with_breaks(atoms: DataFrame, threshold: float = BREAK) -> DataFrame:
    """atoms (input_id, ordinal, block, vector) with cosine to the atom before, breaks and the number of the segment."""
    w = Window.partitionBy("input_id").orderBy("ordinal")
    scored = atoms.withColumns({"cosine": cosine(F.lag("vector").over(w), F.col("vector")), "moved": F.lag("block").over(w) != F.col("block")})
    broken = scored.withColumn("breaks", F.coalesce((F.col("cosine") < threshold) | F.col("moved"), F.lit(False)))
    return broken.withColumn("segment", F.sum(F.col("breaks").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("moved")


def segments(broken: DataFrame) -> DataFrame:
    return broken.groupBy("input_id", "segment").agg(F.count("*").alias("n_atoms"), F.min("ordinal").alias("first_atom"), F.max("ordinal").alias("last_atom"), F.when(F.count("*") == 1, "single_atom").otherwise("semantic").alias("segment_type"))


def segment_vectors(broken: DataFrame) -> DataFrame:
    """Mean of the atoms' vectors, of length one: a row for each place."""
    mean = broken.select("input_id", "segment", F.posexplode("vector").alias("place", "x")).groupBy("input_id", "segment", "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    norm = mean.groupBy("input_id", "segment").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return mean.join(norm, ["input_id", "segment"]).select("input_id", "segment", "place", (F.col("x") / F.col("norm")).alias("x"))


def linear_scores(vectors: DataFrame, weights: dict[str, list[float]], key: str = "id", threshold: float = 0.02) -> DataFrame:
    """One-vs-rest logistic scores of an array column vector; label, score, bucket of candidates."""
    rows = F.array(*[F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, w)).alias("w")) for label, w in weights.items()])
    dot = F.aggregate(F.zip_with("vector", "w", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    scored = vectors.withColumn("x", F.explode(rows)).select(key, "vector", "x.label", "x.w").select(key, "label", (1 / (1 + F.exp(-dot))).alias("score"))
    return scored.where(F.col("score") >= threshold).withColumn("bucket", F.when(F.col("score") >= 0.9, "very_high").when(F.col("score") >= 0.75, "high").otherwise("candidate"))


def paragraphs(blocks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Atoms of blank-line paragraphs, trimmed: key, ordinal, length."""
    cut = F.filter(F.transform(F.split(text, r"\n[ \t]*\n"), lambda p: F.trim(p, F.lit(" \t\n"))), lambda p: p != "")
    return blocks.select(key, F.posexplode(cut).alias("ordinal", "atom")).select(key, "ordinal", F.length("atom").alias("n_chars"))


def split_large(broken: DataFrame, target: int = 1800) -> DataFrame:
    """One more break in each segment over target characters (column n_chars): at its weakest neighbours, then the first. As every
    segment may hold a single atom, a break needs no look at those before it."""
    inside, order = Window.partitionBy("input_id", "segment"), Window.partitionBy("input_id").orderBy("ordinal")
    first = F.min("ordinal").over(inside)
    marked = broken.withColumns({"_first": first, "_chars": F.sum("n_chars").over(inside)})
    weakest = F.min(F.when(F.col("ordinal") > F.col("_first"), F.struct("cosine", "ordinal"))).over(inside)
    more = F.coalesce((F.col("_chars") > target) & (weakest["ordinal"] == F.col("ordinal")), F.lit(False))
    out = marked.withColumn("breaks", F.col("breaks") | more).drop("_first", "_chars")
    return out.withColumn("segment", F.sum(F.col("breaks").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))


def refill(broken: DataFrame, most: int = 3200) -> DataFrame:
    """Segments over most characters are filled again, atom by atom: input_id, segment, segment_type, n_atoms, n_chars, first_atom."""
    per = broken.groupBy("input_id", "segment").agg(F.sort_array(F.collect_list(F.struct("ordinal", "n_chars"))).alias("atoms"), F.sum("n_chars").alias("chars"))
    start = F.array().cast("array<struct<first_atom:int,n_atoms:int,n_chars:bigint>>")

    def group(ordinal: Column, n: Column, chars: Column) -> Column:
        return F.struct(ordinal.cast("int").alias("first_atom"), n.cast("int").alias("n_atoms"), chars.cast("long").alias("n_chars"))

    def step(done: Column, atom: Column) -> Column:
        last = F.element_at(done, -1)
        fits = (F.size(done) > 0) & (F.coalesce(last["n_chars"], F.lit(0)) + atom["n_chars"] <= most)
        grown = F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), group(last["first_atom"], last["n_atoms"] + 1, last["n_chars"] + atom["n_chars"]))
        return F.when(fits, grown).otherwise(F.array_append(done, group(atom["ordinal"], F.lit(1), atom["n_chars"])))

    whole = F.array(group(F.col("atoms")[0]["ordinal"], F.size("atoms"), F.col("chars")))
    groups = F.when(F.col("chars") > most, F.aggregate("atoms", start, step)).otherwise(whole)
    kind = F.when(F.col("chars") > most, "size_fallback").when(F.size("atoms") == 1, "single_atom").otherwise("semantic")
    rows = per.select("input_id", kind.alias("segment_type"), F.explode(groups).alias("g"))
    nth = F.row_number().over(Window.partitionBy("input_id").orderBy("g.first_atom")) - 1
    return rows.select("input_id", nth.cast("int").alias("segment"), "segment_type", "g.n_atoms", "g.n_chars", "g.first_atom")
