"""All places where a pattern matches, as column expressions: the gaps and the matches of one Java regex give the offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run of one punctuation mark or symbol.
REPEATED = r"([\p{P}\p{S}])\1+"


def spans(text: Column, pattern: Column | str) -> Column:
    """Array of (start, end), half-open code point offsets. The pattern must not match the empty string."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    matches = F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda x: F.length(x))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"), matches.alias("len"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        lo = acc["at"] + x["gap"]
        hi = lo + x["len"]
        return F.struct(hi.alias("at"), F.array_append(acc["found"], F.struct(lo.alias("start"), hi.alias("end"))).alias("found"))

    return F.when(F.size(matches) > 0, F.aggregate(pairs, start, step, lambda a: a["found"])).otherwise(empty)


def each(df: DataFrame, keys: list[str], array: Column | str, name: str, place: str | None = None) -> DataFrame:
    """keys, place (from 0, if it is asked for), name: a row for each entry of an array of structs. An outer explode with a test after
    it: for a plain one a filter on the array's size is put below, which works the whole array out again."""
    column = F.col(array) if isinstance(array, str) else array
    entries = F.posexplode_outer(column).alias(place, name) if place else F.explode_outer(column).alias(name)
    return df.select(*keys, entries).where(F.col(name).isNotNull())


def at(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def restored(runs: Column, n_chars: Column, span: Column) -> Column:
    """Of a span (start, end) of the normalised text, the span of the text itself; null where it is empty or out of bounds. A run of
    one mark is one character of the normalised text: it is within a span as a whole or not at all. runs: spans(text, REPEATED), made
    once a text; n_chars: the text's length. For many spans of a text use ``lexical.scan``, which looks places up."""
    back = lambda o: F.aggregate(runs, o, lambda a, r: F.when(r["start"] < a, a + r["end"] - r["start"] - 1).otherwise(a))
    lo, hi = back(span["start"]), back(span["end"])
    return F.when((span["start"] >= 0) & (span["start"] < span["end"]) & (hi <= n_chars), F.struct(lo.alias("start"), hi.alias("end")))
