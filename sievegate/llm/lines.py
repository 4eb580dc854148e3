"""Operator 4: line dedup by winnowing.

Lines are cut at \\n and compared without the white space around them; lines without a character of a word are blank, never
counted and never deleted. A run is RUN lines or more that follow each other, blank lines aside, or one line of LONG words or
more. Whatever run also occurs earlier (in a smaller doc_id, or further up in the same document) is deleted in the later place;
the first place keeps it.

* Of every RUN lines in a row the one with the least hash is a fingerprint, and so is each long line. Equal runs have equal
  fingerprints in equal places, which is the guarantee of winnowing: two in a run are never more than RUN lines apart.
* Fingerprints of equal hash are joined with their first place, and the match is extended both ways, line by line, as far as a
  run around the fingerprint can reach. Longer runs are chains of such matches.
* Where the first place of a fingerprint has other neighbours, the run may still have an earlier place: the runs that the match
  did not reach meet once more, by hash and surroundings, and are joined with the first place of these.

Equal runs meet in one first place, found by partial minima; no pairs of places are made.

Defined results: null and empty texts have no lines; a null text stays null. Rows that repeat doc_id and text are one place.
Rows with a null doc_id come first in the order. Rows that repeat a doc_id with other texts are ordered by a hash of the text.
An empty table gives an empty one. Very long texts are read whole, and their fingerprints leave in batches. Other columns stay
as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegate.llm.common import documents, join_counted, keyed, materialize, mix, remove, same_row, tuned

RUN, LONG = 3, 20
SPACES = " \t\n\x0b\x0c\r"
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def line_hashes(text: str | None, long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines that are not blank, and whether each is long."""
    import xxhash

    full = [x for line in (text or "").split("\n") if (x := line.strip(SPACES))]
    hashes = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in full], np.uint64)
    return hashes, np.array([len(x) >= 2 * long - 1 and len(_WORDS(x)) >= long for x in full], bool)


def fingerprints(lines: np.ndarray, long: np.ndarray, run: int = RUN) -> tuple[np.ndarray, ...]:
    """hash, place, first and last run that chose it (none for a long line), and the lines around it with a mask of those that
    there are: run - 1 before, itself, run - 1 after."""
    n = len(lines) - run + 1
    at = first = last = np.zeros(0, np.int64)
    if n > 0:
        chosen = np.arange(n) + np.lib.stride_tricks.sliding_window_view(lines, run).argmin(1)
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        last = np.concatenate([first[1:], [n]]) - 1
        at = chosen[first]
    lone = np.flatnonzero(long)
    hashes = np.concatenate([lines[at], mix(lines[lone] ^ np.uint64(0x5DEECE66D))])
    at, first, last = np.concatenate([at, lone]), np.concatenate([first, lone]), np.concatenate([last, lone - 1])
    around = at[:, None] + np.arange(1 - run, run)
    there = (around >= 0) & (around < len(lines))
    return hashes.view(np.int64), at, first, last, lines[np.clip(around, 0, max(len(lines) - 1, 0))].view(np.int64) if len(lines) else around, there


def _reach(side: str, run: int) -> Column:
    """How many lines before (or after) the fingerprint equal those of its first place."""
    steps = range(run - 2, -1, -1) if side == "before" else range(run, 2 * run - 1)
    out = F.lit(0)
    for k in reversed(list(steps)):
        same = F.coalesce(F.get("around", F.lit(k)) == F.get("first.around", F.lit(k)), F.lit(False))
        out = F.when(same, 1 + out).otherwise(0)
    return out


def repeated_runs(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """doc_id, text_key, runs (array of (lo, hi), half-open places among the lines that are not blank, of runs that occur earlier
    too) of rows of keyed()."""
    spark = tuned(docs.sparkSession)
    width = 2 * run - 1

    names = ["doc_id", "text_key", "line", "at", "lo", "hi", "around"]

    def together(ids: list, keys: list, found: list[tuple]) -> pa.RecordBatch:
        sizes = [len(x[0]) for x in found]
        line, at, lo, hi, around, there = (np.concatenate(x) for x in zip(*found, strict=True))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(line) * width + 1, width), pa.int32()), pa.array(around.ravel(), mask=~there.ravel()))
        which = np.repeat(np.arange(len(ids)), sizes)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(which)), pa.array(np.repeat(np.array(keys, np.int64), sizes)), *map(pa.array, (line, at, lo, hi)), lists], names)

    def winnow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, held, n = [], [], [], 0
        for batch in batches:
            for doc_id, key, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = fingerprints(*line_hashes(text, long), run)
                for k in range(0, len(found[0]), 20_000):
                    ids.append(doc_id)
                    keys.append(key)
                    held.append(tuple(x[k : k + 20_000] for x in found))
                    n += len(held[-1][0])
                    if n >= 20_000:
                        yield together(ids, keys, held)
                        ids, keys, held, n = [], [], [], 0
        if held:
            yield together(ids, keys, held)

    place = ["doc_id", "text_key", "at"]
    rows, rows_path = materialize(docs.select("doc_id", "text_key", "text").mapInArrow(winnow, "doc_id long, text_key long, line long, at long, lo long, hi long, around array<long>"), "lines-fingerprints")
    firsts, firsts_path = materialize(rows.groupBy("line").agg(F.count("*").alias("_n"), F.min(F.struct(*place, "around")).alias("first")).where("_n > 1"), "lines-first")
    later = ~F.struct(*place).eqNullSafe(F.struct(*[F.col(f"first.{c}").alias(c) for c in place]))
    before, after = _reach("before", run), _reach("after", run)
    met, met_path = materialize(join_counted(rows, firsts, "line").withColumns({"before": before, "after": after, "later": later}).drop("first", "_n"), "lines-met")
    extended = met.where(F.col("later") & ((F.col("before") + F.col("after") + 1 >= run) | (F.col("lo") > F.col("hi"))))
    whole = F.col("lo") <= F.col("hi")
    runs = extended.select("doc_id", "text_key", F.when(whole, F.col("at") - F.col("before")).otherwise(F.col("at")).alias("lo"), F.when(whole, F.col("at") + F.col("after") + 1).otherwise(F.col("at") + 1).alias("hi"))
    # runs out of reach of the match: from lo, or after the last that the match holds
    start = F.explode(F.filter(F.sequence("lo", "hi"), lambda s: (s < F.col("at") - F.col("before")) | (s + run - 1 > F.col("at") + F.col("after"))))
    rest = met.where(whole).select("doc_id", "text_key", "line", "at", "around", start.alias("lo"))
    rest = rest.select("doc_id", "text_key", "lo", F.xxhash64("line", F.slice("around", (F.col("lo") - F.col("at") + run).cast("int"), F.lit(run)), F.col("at") - F.col("lo")).alias("surroundings"))
    rest, rest_path = materialize(rest, "lines-rest")
    again, again_path = materialize(rest.groupBy("surroundings").agg(F.count("*").alias("_n"), F.min(F.struct("doc_id", "text_key", "lo")).alias("first")).where("_n > 1"), "lines-again")
    others = join_counted(rest, again, "surroundings").where(~F.struct("doc_id", "text_key", "lo").eqNullSafe(F.col("first")))
    runs = runs.unionByName(others.select("doc_id", "text_key", "lo", (F.col("lo") + run).alias("hi")))
    found, _ = materialize(runs.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")), "lines-runs")
    remove(spark, rows_path, firsts_path, met_path, rest_path, again_path)
    return found.hint("merge")  # it grows with the corpus: never broadcast


def cut(text: str, runs: list) -> tuple[str, int, int]:
    """The text without the lines of the runs, the number of its lines that are not blank, and how many of them went."""
    gone = {k for r in runs for k in range(r["lo"], r["hi"])}
    keep, n = [], 0
    for line in text.split("\n"):
        blank = not line.strip(SPACES)
        if blank or n not in gone:
            keep.append(line)
        n += not blank
    return "\n".join(keep), n, len(gone)


def line_dedup(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """docs, all columns, with the lines of later repeated runs deleted from text."""

    @F.pandas_udf("string")
    def kept(texts, runs):
        import pandas as pd

        return pd.Series([t if r is None else cut(t, r)[0] for t, r in zip(texts, runs, strict=True)], dtype=object)

    rows = keyed(docs, F.struct(*docs.columns).alias("_row"))
    runs = repeated_runs(rows.drop("_row"), run, long)
    found = rows.join(runs, same_row(rows, runs), "left").select(rows["text"], rows["_row"], runs["runs"]).withColumn("_text", kept("text", "runs"))
    return found.select(*[F.when(F.col("_row.text").isNotNull(), F.col("_text")).alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def report(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """doc_id, n_lines (not blank), n_removed, kept_sha256 of the text that is left (null: empty)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, found in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                left, n, gone = cut(text, found or [])
                out.append((doc_id, n, gone, hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest()))
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)), schema=schema)

    rows = keyed(docs)
    runs = repeated_runs(rows, run, long)
    found = rows.join(runs, same_row(rows, runs), "left").select(rows["doc_id"], rows["text"], runs["runs"])
    return found.mapInArrow(digest, "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))


ORACLE = f"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, t, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM cut),
trimmed AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM lines),
full_lines AS (SELECT doc_id, t, i, s, row_number() OVER (PARTITION BY doc_id, t ORDER BY i) AS p FROM trimmed WHERE s <> ''),
runs AS (SELECT doc_id, t, p, {" || chr(10) || ".join(["s", *[f"lead(s, {k}) OVER w" for k in range(1, RUN)]])} AS r FROM full_lines WINDOW w AS (PARTITION BY doc_id, t ORDER BY p)),
later AS (SELECT doc_id, t, p, {RUN} AS n FROM (SELECT *, rank() OVER (PARTITION BY r ORDER BY doc_id, p) AS k FROM runs WHERE r IS NOT NULL) WHERE k > 1
    UNION ALL SELECT doc_id, t, p, 1 AS n FROM (SELECT *, rank() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM full_lines WHERE len(regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+')) >= {LONG}) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, t, unnest(range(p, p + n)) AS p FROM later),
removed AS (SELECT f.doc_id, f.t, f.i FROM full_lines f JOIN gone g ON f.doc_id = g.doc_id AND f.t = g.t AND f.p = g.p),
per_line AS (SELECT x.doc_id, x.t, x.i, x.line, x.s <> '' AS counts, r.i IS NOT NULL AS went FROM trimmed x LEFT JOIN removed r ON x.doc_id = r.doc_id AND x.t = r.t AND x.i = r.i)
SELECT doc_id, count_if(counts) :: BIGINT AS n_lines, count_if(went) :: BIGINT AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT went), '')) AS kept_sha256
FROM per_line GROUP BY doc_id, t
"""
