"""Atoms of blocks: code fences, table rows, text read by OCR or paragraphs, cut into pieces of bounded size.

Column expressions throughout. One regex with ordered alternatives cuts a range: what is left if it is short enough, else up to the
last line end, sentence mark or white space within the bound, else at the bound. The pieces of a range joined are the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegate.functions.spans import spans

# Patterns, sentence marks and source types that the results depend on.
FENCE = r"(?s)(```|~~~).*?(?:\1|\z)"
BLANK_LINES = r"\n[ \t\r\f\x0B]*\n+"
LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"
MARKS = ".!?。！？"
TABLE_SOURCES = ["csv", "table", "spreadsheet", "xls", "xlsx", "tsv"]
MAX_CHARS = 512

SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_SPACE = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"
_RANGES = "array<struct<start:int,end:int,atom_type:string>>"


def size_pattern(most: int = MAX_CHARS) -> str:
    ends = "|".join(f".{{1,{most - 1}}}{mark}" for mark in ("\\n", f"[{MARKS}]", _SPACE))
    return rf"(?s).{{1,{most}}}\z|{ends}|.{{{most}}}"


def _range(start: Column, end: Column, kind: str) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(kind).alias("atom_type"))


def _cut(text: Column, r: Column) -> Column:
    return F.substring(text, r["start"] + 1, r["end"] - r["start"])


def _trimmed(text: Column, ranges: Column, kind: str) -> Column:
    """The ranges without white space at their ends; blank ones go."""

    def trim(r: Column) -> Column:
        part = _cut(text, r)
        start = r["start"] + F.length(part) - F.length(F.ltrim(part, F.lit(SPACES)))
        return _range(start, start + F.length(F.trim(part, F.lit(SPACES))), kind)

    return F.filter(F.transform(ranges, trim), lambda r: r["start"] < r["end"])


def _gaps(found: Column, n: Column) -> Column:
    """What lies before, between and after spans of a text of n characters."""
    starts = F.concat(F.array(F.lit(0)), F.transform(found, lambda s: s["end"]))
    ends = F.concat(F.transform(found, lambda s: s["start"]), F.array(n))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def is_table(content: Column, source_type: Column) -> Column:
    """Every line has as many cells, two at least and none empty, between tabs, bars or (table sources only) commas."""
    lines = F.filter(F.split(content, LINE_ENDS), lambda x: F.trim(x, F.lit(SPACES)) != "")

    def malformed(line: Column) -> Column:
        cells = F.split(line, r"[|,\t]")
        return (F.size(cells) > 1) & F.exists(cells, lambda c: F.trim(c, F.lit(SPACES)) == "")

    def even(mark: str) -> Column:
        widths = F.transform(lines, lambda x: F.size(F.split(x, mark)))
        return (F.array_min(widths) > 1) & (F.array_min(widths) == F.array_max(widths))

    barred = F.exists(lines, lambda x: x.rlike(r"[|\t]"))
    commas = F.lower(F.coalesce(source_type, F.lit(""))).isin(TABLE_SOURCES) & even(",")
    return (F.size(lines) > 0) & ~F.exists(lines, malformed) & F.when(barred, even(r"\t") | even(r"[|]")).otherwise(commas)


def atoms(blocks: DataFrame, most: int = MAX_CHARS, id_length: int = 16) -> DataFrame:
    """blocks (input_id, block_id, block_order, source_type, text) to input_id, block_id, ordinal, atom_id, atom_type, start, end,
    atom. Ordinals run on across an input's blocks; ranges are of the block's text. Null and blank texts have no atoms."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lead = F.length(text) - F.length(F.ltrim(text, F.lit(SPACES)))
    out = blocks.withColumns({"_lead": lead, "_c": F.trim(text, F.lit(SPACES))}).where("_c <> ''")
    c, n = F.col("_c"), F.length("_c")
    out = out.withColumn("_fences", spans(c, FENCE))
    prose = F.filter(F.transform(_gaps(F.col("_fences"), n), lambda r: _range(r["start"], r["end"], "paragraph")), lambda r: F.trim(_cut(c, r), F.lit(SPACES)) != "")
    code = F.transform("_fences", lambda s: _range(s["start"], s["end"], "code_block"))
    structure = (
        F.when(F.lower("source_type") == "ocr", F.array(_range(F.lit(0), n, "ocr_line")))
        .when(F.size("_fences") > 0, F.sort_array(F.concat(prose, code)))
        .when(is_table(c, F.col("source_type")), _trimmed(c, spans(c, r"[^\n]+"), "table_row"))
        .otherwise(_trimmed(c, _gaps(spans(c, BLANK_LINES), n), "paragraph"))
    )
    out = out.withColumn("_ranges", structure)

    def pieces(r: Column) -> Column:
        lengths = F.transform(F.regexp_extract_all(_cut(c, r), F.lit(size_pattern(most)), F.lit(0)), lambda x: F.length(x))
        start = F.struct(r["start"].alias("at"), F.array().cast(_RANGES).alias("found"))

        def step(a: Column, size: Column) -> Column:
            piece = F.struct(a["at"].alias("start"), (a["at"] + size).alias("end"), r["atom_type"].alias("atom_type"))
            return F.struct((a["at"] + size).alias("at"), F.array_append(a["found"], piece).alias("found"))

        return F.aggregate(lengths, start, step, lambda a: a["found"])

    out = out.withColumn("_pieces", F.flatten(F.transform("_ranges", pieces)))
    earlier = Window.partitionBy("input_id").orderBy("block_order", "block_id").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("_before", F.coalesce(F.sum(F.size("_pieces")).over(earlier), F.lit(0)))
    rows = out.select("input_id", "block_id", "_before", "_lead", "_c", F.posexplode("_pieces").alias("_nth", "r"))
    ordinal = (F.col("_before") + F.col("_nth")).cast("int")
    atom_id = F.concat(F.lit("atom_"), F.substring(F.sha2(F.concat_ws(":", "input_id", "block_id", ordinal), 256), 1, id_length))
    return rows.select("input_id", "block_id", ordinal.alias("ordinal"), atom_id.alias("atom_id"), "r.atom_type", (F.col("r.start") + F.col("_lead")).alias("start"), (F.col("r.end") + F.col("_lead")).alias("end"), _cut(c, F.col("r")).alias("atom"))
