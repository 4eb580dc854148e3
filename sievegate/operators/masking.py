"""Masking: longest spans first without overlap, numbered placeholders, spliced text. Column expressions over one input's spans."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegate.functions.spans import at, overlap


def disjoint(detections: Column) -> Column:
    """Of (start, end, detector_key), the longest first, then the earliest; in order of their places."""
    keyed = F.sort_array(F.transform(detections, lambda d: F.struct((d["start"] - d["end"]).alias("l"), d["start"].alias("start"), d["end"].alias("end"), d["detector_key"].alias("detector_key"))))
    empty = F.array().cast("array<struct<l:int,start:int,end:int,detector_key:string>>")
    chosen = F.aggregate(keyed, empty, lambda acc, d: F.when(F.exists(acc, lambda x: overlap(x, d)), acc).otherwise(F.array_append(acc, d)))
    return F.sort_array(F.transform(chosen, lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), d["detector_key"].alias("detector_key"))))


def masked(df: DataFrame, text: str = "text", detections: str = "detections") -> DataFrame:
    """Adds masked_text and n_masked. Equal values of one detector share a placeholder; numbers go by first appearance."""
    t = F.col(text)
    out = df.withColumn("_d", disjoint(F.col(detections)))
    value = lambda d: F.concat_ws("|", d["detector_key"], F.trim(F.regexp_replace(at(t, d), r"\s+", " ")))
    out = out.withColumn("_distinct", F.array_distinct(F.transform("_d", value)))

    def name(d: Column) -> Column:
        of_key = F.filter("_distinct", lambda v: F.startswith(v, F.concat(d["detector_key"], F.lit("|"))))
        return F.concat(F.lit("["), d["detector_key"], F.lit("_"), F.array_position(of_key, value(d)).cast("string"), F.lit("]"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("s"))
    spliced = F.aggregate("_d", start, lambda a, d: F.struct(d["end"].alias("at"), F.concat(a["s"], F.substring(t, a["at"] + 1, d["start"] - a["at"]), name(d)).alias("s")), lambda a: F.concat(a["s"], F.substring(t, a["at"] + 1, F.length(t))))
    return out.withColumn("masked_text", F.when(F.size("_d") > 0, spliced).otherwise(t)).withColumn("n_masked", F.size("_d")).drop("_d", "_distinct")


def spliced(text: str, spans: list[tuple[int, int, str]]) -> tuple[str, dict[str, int]]:
    """The text with placeholders for spans (start, end, name), and how often each stands there. Of spans that overlap the longest stays,
    then the earliest, then the first name; equal values of one name, white space aside, share a number."""
    kept: list[tuple[int, int, str]] = []
    for s in sorted({(a, b, n) for a, b, n in spans if 0 <= a < b}, key=lambda s: (s[0] - s[1], s[0], s[2])):
        k = bisect_left(kept, s)
        if (k == 0 or kept[k - 1][1] <= s[0]) and (k == len(kept) or s[1] <= kept[k][0]):
            insort(kept, s)
    names, numbers, counts, out, at = {}, {}, {}, [], 0
    for a, b, name in kept:
        key = (name, " ".join(text[a:b].split()))
        if key not in names:
            numbers[name] = numbers.get(name, 0) + 1
            names[key] = f"[{name}_{numbers[name]}]"
        counts[names[key]] = counts.get(names[key], 0) + 1
        out += [text[at:a], names[key]]
        at = b
    return "".join([*out, text[at:]]), counts


def placeholders(text: Column, spans: Column) -> Column:
    """Of a text and its array of (start, end, detector_key): struct (masked_text, counts by placeholder). What is chosen depends on all
    spans chosen before, so each text is spliced in one pass of its own, in Arrow batches. Null text: null."""

    def batch(rows: pd.DataFrame) -> pd.DataFrame:
        got = [("", {}) if t is None else spliced(t, [(s["start"], s["end"], s["detector_key"]) for s in ([] if x is None else x)]) for t, x in zip(rows["text"], rows["spans"], strict=True)]
        return pd.DataFrame({"masked_text": [g[0] for g in got], "counts": [g[1] for g in got]})

    of = F.pandas_udf(batch, "masked_text string, counts map<string,int>")(F.struct(text.alias("text"), spans.alias("spans")))
    return F.when(text.isNotNull(), of)
