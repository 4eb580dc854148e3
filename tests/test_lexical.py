"""The scanner against plain runs of every rule, and its index against the case rules of ``re``."""

import random
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from sievegate.operators import lexical

RULES = "pattern_id string, kind string, expression string, signal_type string, case_sensitive boolean"


def plain_normalised(text):
    out, at, k = [], [], 0
    while k < len(text):
        end = k + 1
        if unicodedata.category(text[k])[0] in "PS":
            while end < len(text) and text[end] == text[k]:
                end += 1
        out.append(text[k])
        at.append(k)
        k = end
    return "".join(out), [*at, len(text)]


@given(st.text(alphabet="ab!!..--$ é€", max_size=40))
@settings(max_examples=200, deadline=None)
def test_normalised_places(text):
    norm, places, gone = lexical.normalised(text)
    want, at = plain_normalised(text)
    assert norm == want
    assert [lexical.original(k, places, gone) for k in range(len(norm) + 1)] == at


def test_fold_is_alike_wherever_re_is():
    letters = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L" and (chr(c).lower() != chr(c) or chr(c).upper() != chr(c))]
    for c in letters:
        for other in {*c.lower(), *c.upper(), *c.title(), *c.swapcase()}:
            if re.fullmatch(re.escape(c), other, re.IGNORECASE):
                assert lexical.folded(c) == lexical.folded(other), (c, other)
    for a, b in (("i", "ı"), ("s", "ſ"), ("k", "K"), ("İ", "i"), ("σ", "ς"), ("ß", "ẞ"), ("µ", "μ")):
        assert not re.fullmatch(a, b, re.IGNORECASE) or lexical.folded(a) == lexical.folded(b)


EXPRESSIONS = ["foo!bar", "a+b", "ab?c", "x{2,3}yz", "(ab)+cd", "[a-c]xyz", r"\d\d", r"a\.b", "^start", "a|b", "(?i)tok", "c*", r"\bword\b", "w[]a]rd", "w[^]]rd", "é.t", "((a)b)c", "lo+ng", "x{0}tail", r"\(par\)", "z{,2}q"]


def test_a_literal_is_in_every_match():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdxyz!.()wr][012 éttoknlgqstarp") for _ in range(60)) for _ in range(3000)]
    texts += ["FOO!bar", "aab", "ac abc", "xxyz xxxyz", "ababcd", "start", "word", "w]rd ward", "wxrd", "é t", "abc", "looong long", "tail", "(par)", "zq q zzq"]
    for expression in EXPRESSIONS:
        need = lexical.literal("regex", expression)
        for text in texts:
            for m in re.finditer(expression, text, re.IGNORECASE):
                assert lexical.folded(need) in lexical.folded(m.group()), (expression, need, m.group())


def test_scan_against_every_rule_on_every_text(spark):
    rng = random.Random(3)
    words = ["Foo!!bar", "foo!bar", "ſtop", "STOP", "a.b", "aab", "10", "İx", "ix", "...", "word", "--", "ß", "ẞ"]
    texts = [(k, "b", " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for k in range(60)] + [(60, "b", None), (61, "b", "")]
    rules = [(f"k{n}", "keyword", w, "T", n % 4 == 0) for n, w in enumerate(["foo!bar", "stop", "a.b", "10", "ix", ".", "ß", "STOP"])]
    rules += [(f"r{n}", "regex", e, "T", n % 3 == 0) for n, e in enumerate(EXPRESSIONS)]
    bad = [("b1", "regex", "(", "T", False), ("b2", "regex", "*", "T", False), ("none", "keyword", None, "T", False), ("empty", "regex", "", "T", False)]
    df = spark.createDataFrame(texts, "i int, b string, text string").repartition(3)
    table = spark.createDataFrame(rules + bad, RULES)
    got = sorted((r["i"], r["pattern_id"], r["n_start"], r["n_end"], r["start"], r["end"]) if r["start"] is not None else (r["i"], r["pattern_id"], r["n_start"], r["n_end"], -1, -1) for r in lexical.scan(df, table, ["i", "b"]).collect())
    want = []
    for i, _, text in texts:
        norm, at = plain_normalised(text or "")
        for p, kind, e, _, exact in rules:
            for m in re.finditer(re.escape(e) if kind == "keyword" else e, norm, 0 if exact else re.IGNORECASE):
                a, b = m.span()
                want.append((i, p, a, b, at[a], at[b]) if a < b else (i, p, a, b, -1, -1))
    assert got == sorted(want)
    warned = lexical.warnings(table)
    assert sorted(r["warning"] for r in warned.collect()) == ["INVALID_REGEX:b1", "INVALID_REGEX:b2"]
    status = {r["i"]: (r["n_signals"], r["n_failures"], r["scanner_status"]) for r in lexical.scan_status(df, lexical.scan(df, table, ["i"]), warned, "i").collect()}
    assert len(status) == 62 and all(s[2] == "partial" for s in status.values())
    assert {i: s[1] for i, s in status.items()} == {i: sum(w[0] == i and w[4] < 0 for w in want) for i, *_ in texts}


def test_only_candidates_are_compiled():
    scanner = lexical.Scanner([(f"k{n}", "keyword", f"word{n:04d}", "T", False) for n in range(1000)])
    assert [m[0] for m in scanner.matches("a WORD0007 and word0009")] == [7, 9]
    assert len(scanner.compiled) == 2


def test_rules_are_tried_where_their_literals_stand():
    from sievegate.functions.detectors import SECRET

    held = lexical.literals("regex", SECRET)
    assert held and all(at == 0 and len(text) >= 3 for text, at in held)
    scanner = lexical.Scanner([("s", "regex", SECRET, "T", False), ("k", "keyword", "word", "T", False), ("r", "regex", "word[.,]", "T", False), ("g", "keyword", "σας", "T", False)])
    assert scanner.always == []
    plain = "other text " * 1000
    assert scanner.candidates(plain) == {}
    assert scanner.candidates(plain + "a Word, WORD") == {1: {11002, 11008}, 2: {11002}}
    assert [m[:3] for m in scanner.matches("wordword, ghp_" + "a" * 20 + " ΣΑΣ")] == [(0, 10, 34), (1, 0, 4), (1, 4, 8), (2, 4, 9), (3, 35, 38)]


def test_places_give_what_finditer_gives():
    rng = random.Random(5)
    more = ["abab", "aba[xy]", "(?:abc|xyz)+", r"x\wabc", "ab(?:cd|xy)z?", r"(?<=z)abcd", "abc(?=d)", "(abc|abd)[d-f]{1,2}", "(?i:ABC)d*", "abc|"]
    texts = ["".join(rng.choice(["ab", "abc", "abd", "aba", "x", "xyz", "y", "d", "z", "ABC", " "]) for _ in range(30)) for _ in range(400)]
    rules = [(f"r{n}", "regex", e, "T", n % 2 == 0) for n, e in enumerate([*EXPRESSIONS, *more])]
    scanner = lexical.Scanner(rules)
    for text in texts:
        got = [m[:3] for m in scanner.matches(text)]
        assert got == [(n, *m.span()) for n, (_, _, e, _, exact) in enumerate(rules) for m in re.finditer(e, text, 0 if exact else re.IGNORECASE)], text
