import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from sievegate.llm import packing
from tests.llm import cases


def direct(texts):
    tok = Tokenizer.from_file(packing.default_vocabulary())
    return [np.array([*e.ids, 1], "<u4") for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(got, rows, capacity=4096):
    want = Counter()
    for (doc_id, _), ids in zip(rows, direct([t for _, t in rows]), strict=True):
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    ends = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values(), default=0) <= capacity
    return len(ends), -(-sum(ends.values()) // capacity)


def test_against_direct_encoding(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    used, least = check(packing.op5_best_fit_packing(spark, sf_dir).collect(), rows)
    assert used <= 1.05 * least + 1


def test_odd_rows(spark):
    data = cases.rows(8)
    check(packing.pack(cases.frame(spark, data)).collect(), [r[:2] for r in data])
    assert packing.pack(cases.frame(spark, [])).count() == 0


def test_added_tokens(spark):
    texts = ["hello <|endoftext|> world", "<|startoftext|>", "a<|endoftext|><|endoftext|>b", "<|EndOfText|> <|endoftext |>", "Über<|startoftext|>, 's <|endoftext|>."]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    check(packing.pack(cases.frame(spark, rows)).collect(), [r[:2] for r in rows])


def best_fit(lengths, capacity):
    gaps = []  # one piece after the other
    for length in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - length)
    return len(gaps)


@pytest.mark.parametrize(("low", "high", "n"), [(1, 64, 900), (1, 6, 2000), (20, 40, 500), (1, 1, 70)])
def test_rounds(spark, monkeypatch, low, high, n):
    """Rounds over several ranges give what rounds over a single one give, and hardly more sequences than best fit one by one."""
    rng = random.Random(n)
    rows = [(k, rng.randint(low, high)) for k in range(n)]
    df = spark.createDataFrame(rows, "pid long, length int")
    found = {}
    for width in (1, 7):
        monkeypatch.setattr(packing, "ROWS_OF_RANGE", 10**9 if width == 1 else n // 7 + 1)
        got = packing.place(df, 64)[0].collect()
        assert sorted(r.pid for r in got) == [r[0] for r in rows]
        fill = Counter()
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == fill[r.sequence_id]
            fill[r.sequence_id] += rows[r.pid][1]
        assert max(fill.values()) <= 64
        found[width] = sorted((r.pid, r.sequence_id, r.offset) for r in got)
        assert len(fill) <= 1.1 * best_fit([x for _, x in rows], 64) + 1
    assert found[1] == found[7]


def test_carried_totals():
    totals = [{"part": 0, "gaps": 5, "pieces": 2}, {"part": 1, "gaps": 1, "pieces": 3}, {"part": 2, "gaps": 0, "pieces": 9}]
    assert packing._carried(totals) == [(1, 0, 0, 4, 3, 0), (2, 0, 1, 0, 1, 3), (2, 1, 0, 1, 2, 4)]


def test_sweep_counts_its_ranges(spark):
    gaps, sizes = [(k, 100 + 40 * k) for k in range(40)], [30 + 7 * k for k in range(90)]
    rows = [(True, room, k, 0, room) for k, room in gaps] + [(False, n, 1000 + k, 0, 0) for k, n in enumerate(sizes)]
    swept = packing._sweep(spark.createDataFrame(rows, "gap boolean, size int, id long, slot int, room int"), 3).collect()
    totals = {r["part"]: (r["id"], r["pid"], r["slot"], r["open"]) for r in swept if r["gap"] is None}
    assert len(totals) == sum(r["gap"] is None for r in swept) > 1
    for part, found in totals.items():
        own = [r for r in swept if r["part"] == part]
        alone = [r["length"] for r in own if r["gap"] is False]
        assert found == (sum(r["gap"] is True and r["pid"] is None for r in own), len(alone), sum(r["gap"] is True and r["pid"] is not None for r in own), sum(alone))
    assert {r["part"] for r in swept} == set(totals)
