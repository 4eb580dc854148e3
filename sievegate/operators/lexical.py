"""Keyword and regex rules over normalised blocks, any number of rules in one pass.

Rules are a table (pattern_id, kind, expression, signal_type, case_sensitive). Each rule has literals of which any match of it must
hold one: the keyword, or plain runs of a regex. An automaton over all literals finds in one reading of a text which rules can match,
and where: a rule whose literals stand at a fixed distance from the start of a match is tried at these places only, so the work
follows the text and what is found in it and not rules times texts. Other rules with a literal are tried on the texts that hold one,
rules without on every text. What is tried is Python's ``re``, whose syntax and case rules the patterns are written for, in Arrow
batches; each worker builds the automaton once. Rules are sent to all workers: they are settings, ``RULE_BYTES`` at most, more is an
error.

A rule whose expression does not compile gives a warning, the others go on. A match of the empty string has no range in the text
itself: it is a failure, and the signal is dropped. Null texts are empty; rules with a null or empty expression are left out.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from re import _constants as _c
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievegate.functions.tables import bounded

RULE_BYTES = 64 << 20
ROWS = 4096  # of one batch that a worker gives back
CHOICES, SURE = 16, 3  # literals that a class may be spelled out to; shorter ones are too frequent to be tried place by place


#: Runs of one character that is no letter, number or white space; those of a mark or symbol among them are cut (``_mark``).
_RUNS = re.compile(r"([^\w\s]|_)\1+")


def _mark(c: str) -> bool:
    return unicodedata.category(c)[0] in "PS"


@functools.cache
def _plain() -> dict[int, str]:
    """The characters whose plain form is not their lower case."""
    plain = {}
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        low = c.lower()[0]
        up = low.upper()
        form = up.lower() if len(up) == 1 and len(up.lower()) == 1 else low
        if form != c.lower():
            plain[code] = form
    return plain | {0x3A3: "\u03c3", 0x1FD3: "\u0390", 0x1FE3: "\u03b0", 0xFB05: "\ufb06"}  # a sigma is lowered by its place; one letter to re


def folded(text: str) -> str:
    """A form, of the same length, in which texts that are alike without regard to case are alike."""
    if not text.isascii():
        plain = _plain()
        for c in set(text):
            if (form := plain.get(ord(c))) is not None:
                text = text.replace(c, form)
    return text.lower()


def normalised(text: str) -> tuple[str, list[int], list[int]]:
    """The text with every run of one mark cut to one; the places of these in it, and how many characters went up to each."""
    out, places, gone, at, lost = [], [], [], 0, 0
    for run in _RUNS.finditer(text):
        if not _mark(run[1]):
            continue
        out.append(text[at : run.start() + 1])
        places.append(run.start() - lost)
        lost += run.end() - run.start() - 1
        gone.append(lost)
        at = run.end()
    out.append(text[at:])
    return "".join(out), places, gone


def original(place: int, places: list[int], gone: list[int]) -> int:
    k = bisect_left(places, place)
    return place + (gone[k - 1] if k else 0)


def _better(a: list, b: list) -> list:
    """Fixed places before longer runs, of runs that are long enough."""
    least = lambda x: min((len(text) for text, _ in x), default=0)
    return max(a, b, key=lambda x: (min(least(x), SURE), all(at is not None for _, at in x), least(x), -len(x)))


def _chars(op, arg) -> list[int]:
    """The characters of a literal or of a small class, [] for anything else."""
    if op is _c.LITERAL:
        return [arg]
    if op is not _c.IN:
        return []
    out: list[int] = []
    for kind, of in arg:
        if kind is _c.LITERAL:
            out.append(of)
        elif kind is _c.RANGE and of[1] - of[0] < CHOICES:
            out += range(of[0], of[1] + 1)
        else:
            return []
    return out


def _held(items, at: int | None) -> list[tuple[str, int | None]]:
    """literals of a parsed expression that begins at a place of its match."""
    best: list = []
    runs, begin = {""}, at
    for n, (op, arg) in enumerate(items):
        if op is _c.AT:
            continue
        chars, low_high = {folded(chr(c)) for c in _chars(op, arg)}, items[n : n + 1].getwidth()
        if chars and len(runs) * len(chars) <= CHOICES:
            runs = {run + c for run in runs for c in chars}
        else:
            best = _better(best, [(run, begin) for run in sorted(runs) if run])
            inner: list = []
            if op is _c.BRANCH:
                parts = [_held(part, at) for part in arg[1]]
                inner = [x for part in parts for x in part] if all(parts) else []
            elif op is _c.SUBPATTERN:
                inner = _held(arg[3], at)
            elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT, _c.POSSESSIVE_REPEAT) and arg[0] > 0:
                inner = _held(arg[2], at)
            best = _better(best, inner)
            runs, begin = (chars, at) if 0 < len(chars) <= CHOICES else ({""}, None)
        at = at + low_high[0] if at is not None and low_high[0] == low_high[1] else None
        if runs == {""}:
            begin = at
    return _better(best, [(run, begin) for run in sorted(runs) if run])


def literals(kind: str, expression: str) -> list[tuple[str, int | None]]:
    """Plain runs, folded, of which every match holds one, and how far each stands behind the start of the match (None: not fixed); []
    if none is sure."""
    if kind == "keyword":
        return [(folded(expression), 0)]
    try:
        return _held(_parser.parse(expression, re.IGNORECASE), 0)
    except (re.error, OverflowError, RecursionError):
        return []


def literal(kind: str, expression: str) -> str:
    """A plain run that every match holds, '' if no single one is sure."""
    found = literals(kind, expression)
    return found[0][0] if len(found) == 1 else ""


class Scanner:
    """Rules (pattern_id, kind, expression, signal_type, case_sensitive), compiled when they are first needed."""

    def __init__(self, rules: list[tuple]):
        import ahocorasick

        self.rules, self.compiled, self.always = rules, {}, []
        self.columns = [pa.array([r[k] for r in rules], pa.string()) for k in (0, 3, 1)]  # pattern_id, signal_type, kind
        by_literal: dict[str, list[tuple[int, int | None]]] = {}
        for n, (_, kind, expression, _, _) in enumerate(rules):
            held = literals(kind, expression)
            placed = kind == "keyword" or min((len(text) for text, _ in held), default=0) >= SURE
            for text, at in held:
                by_literal.setdefault(text, []).append((n, len(text) - 1 + at if placed and at is not None else None))
            if not held:
                self.always.append(n)
        self.automaton = ahocorasick.Automaton() if by_literal else None
        for text, of in by_literal.items():
            self.automaton.add_word(text, of)
        if self.automaton:
            self.automaton.make_automaton()

    def pattern(self, n: int) -> re.Pattern | None:
        if n not in self.compiled:
            _, kind, expression, _, exact = self.rules[n]
            try:
                self.compiled[n] = re.compile(re.escape(expression) if kind == "keyword" else expression, 0 if exact else re.IGNORECASE)
            except (re.error, OverflowError, RecursionError):
                self.compiled[n] = None
        return self.compiled[n]

    def candidates(self, text: str) -> dict[int, set[int] | None]:
        """The rules that can match, in order, each with the places where its matches can start; None: anywhere."""
        found: dict[int, set[int] | None] = dict.fromkeys(self.always)
        if self.automaton:
            for end, of in self.automaton.iter(folded(text)):
                for n, back in of:
                    if back is None:
                        found[n] = None
                    elif (places := found.setdefault(n, set())) is not None and end >= back:
                        places.add(end - back)
        return dict(sorted(found.items(), key=lambda x: x[0]))

    def matches(self, text: str) -> Iterator[tuple]:
        """(rule, start, end, start and end in the text itself or None) by rule, in order."""
        norm, places, gone = normalised(text)
        for n, starts in self.candidates(norm).items():
            if (pattern := self.pattern(n)) is None:
                continue
            for m in pattern.finditer(norm) if starts is None else _at(pattern, norm, starts):
                a, b = m.span()
                yield (n, a, b, original(a, places, gone), original(b, places, gone)) if a < b else (n, a, b, None, None)


def _at(pattern: re.Pattern, text: str, starts: set[int]) -> Iterator[re.Match]:
    """What finditer gives where every match starts at one of these places and is not empty."""
    end = 0
    for k in sorted(starts):
        if k >= end and (m := pattern.match(text, k)):
            end = m.end()
            yield m


_SCANNERS: dict[tuple, Scanner] = {}


def _scanner(rules: tuple) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[rules] = Scanner(list(rules))
    return _SCANNERS[rules]


def collected(rules: DataFrame) -> list[tuple]:
    """The rules in order of pattern_id."""
    rules = rules.where("coalesce(expression, '') <> ''")
    if (rules.agg(F.sum(F.octet_length("expression"))).first()[0] or 0) > RULE_BYTES:
        raise ValueError(f"rules hold more than {RULE_BYTES} bytes")
    rows = rules.select("pattern_id", "kind", "expression", "signal_type", F.coalesce("case_sensitive", F.lit(False)).alias("case_sensitive")).collect()
    return sorted(tuple(r) for r in rows)


def warnings(rules: DataFrame) -> DataFrame:
    """pattern_id, warning of the rules that do not compile."""
    scanner = Scanner(kept := collected(rules))
    bad = [(r[0], f"INVALID_REGEX:{r[0]}") for n, r in enumerate(kept) if scanner.pattern(n) is None]
    return rules.sparkSession.createDataFrame(bad, "pattern_id string, warning string")


def scan(blocks: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pattern_id, signal_type, match_basis, n_start, n_end (in the normalised text), start, end (in the text; null: a failure
    OFFSET_MAPPING_FAILED) of every match in blocks (keys, text)."""
    sent = bounded(blocks.sparkSession).sparkContext.broadcast(tuple(collected(rules)))  # RULE_BYTES at most
    blocks = blocks.select(*keys, F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType(blocks.schema.fields[:-1])
    for name in ("pattern_id", "signal_type", "match_basis"):
        schema = schema.add(name, T.StringType())
    for name in ("n_start", "n_end", "start", "end"):
        schema = schema.add(name, T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, ints = _scanner(sent.value), pa.int32()
        for batch in batches:
            rows, found = [], []

            def out() -> pa.RecordBatch:
                own = [batch.column(k).take(pa.array(rows, pa.int64())) for k in range(len(keys))]
                of = [column.take(pa.array([f[0] for f in found], pa.int64())) for column in scanner.columns]
                places = [pa.array([f[k] for f in found], ints) for k in (1, 2, 3, 4)]
                return pa.RecordBatch.from_arrays([*own, *of, *places], names=schema.names)

            for row, text in enumerate(batch.column(len(keys))):
                for match in scanner.matches(text.as_py()):
                    rows.append(row)
                    found.append(match)
                    if len(rows) >= ROWS:
                        yield out()
                        rows, found = [], []
            if rows:
                yield out()

    return blocks.mapInArrow(run, schema)


def with_signal_id(signals: DataFrame, input_id: str, block_id: str) -> DataFrame:
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in (input_id, block_id, "pattern_id", "n_start", "n_end")])
    return signals.withColumn("signal_id", F.concat(F.lit("sig_"), F.substring(F.sha2(text, 256), 1, 20)))


def scan_status(blocks: DataFrame, signals: DataFrame, warned: DataFrame, input_id: str) -> DataFrame:
    """input_id, n_signals, n_failures, scanner_status of every input: partial if a rule was warned of or a range failed."""
    per = signals.groupBy(input_id).agg(F.count("start").alias("s"), F.count_if(F.col("start").isNull()).alias("f"))
    any_ = F.lit(not warned.isEmpty())
    out = blocks.select(input_id).distinct().join(per, input_id, "left")
    n_failures = F.coalesce("f", F.lit(0))
    return out.select(input_id, F.coalesce("s", F.lit(0)).cast("long").alias("n_signals"), n_failures.cast("long").alias("n_failures"), F.when(any_ | (n_failures > 0), "partial").otherwise("completed").alias("scanner_status"))
