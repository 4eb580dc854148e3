import hashlib

import numpy as np

from sievegate.llm import digests
from tests.llm import cases


def test_documents(spark, sf_dir):
    texts = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: r for r in digests.op9_fingerprints(spark, sf_dir).collect()}
    by_text = {}
    for k, (doc_id, text) in enumerate(texts):
        r, edited = got[doc_id], digests.edit(text, texts[(k + 1) % len(texts)][1])
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = [r for r in got.values() if r.n_chars >= 400]
    assert np.mean([r.near_edited for r in long]) > 0.35 > 0.2 > np.median([r.near_next for r in long])


def test_odd_rows(spark):
    data = cases.rows(6)
    got = digests.with_next(cases.frame(spark, data)).collect()
    assert sorted(repr((r.doc_id, r.n_chars)) for r in got) == sorted(repr((r[0], len(r[1] or ""))) for r in data)
    assert digests.with_next(cases.frame(spark, [])).count() == 0
    (alone,) = digests.with_next(cases.frame(spark, [(1, "text " * 50, None, None, None)])).collect()
    assert alone.near_next == 1


def test_levels_by_pieces(monkeypatch):
    data = np.random.default_rng(1).integers(0, 9, 3000).astype(np.uint8)
    slow = [int(1000 * (384 - sum(c * np.log2(c) for c in np.unique(data[k : k + 64], return_counts=True)[1])) / 384) for k in range(0, 2900, 97)]
    whole = digests.levels(data)
    assert np.abs(whole[0:2900:97].astype(int) - slow).max() <= 1
    monkeypatch.setattr(digests, "PIECE", 100)
    assert (digests.levels(data) == whole).all()


def test_strings():
    ranks = np.arange(digests.LEVELS)
    chain = digests.filters("some text that is long enough to have a few features, " * 9, ranks)
    assert (digests.from_string(digests.to_string(chain)) == chain).all() and digests.likeness(chain, chain) == 1
    none = digests.filters(None, ranks)
    assert digests.from_string(digests.to_string(none)).shape == none.shape and digests.likeness(none, none) == 1 and digests.likeness(none, chain) == 0


def plain_filters(text, ranks):
    """The same features window by window, byte by byte."""
    data = (text or "").encode()
    mask = (1 << 64) - 1

    def mixed(x):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * m & mask
        return x ^ x >> 33

    def wide(window):
        words = [mixed(int.from_bytes(window[8 * k : 8 * k + 8], "little") + (k + 1) * 0x9E3779B97F4A7C15 & mask) for k in range(8)]
        h = words[0]
        for w in words[1:]:
            h = mixed(h * 0xD6E8FEB86659FD93 + w & mask)
        return h

    level = []
    for k in range(len(data) - 63):
        counts = [data[k : k + 64].count(b) for b in set(data[k : k + 64])]
        level.append((384 * (1 << 20) - sum(round(c * np.log2(c) * (1 << 20)) for c in counts)) * 1000 // (384 * (1 << 20)))
    rank, found = [int(ranks[x]) for x in level], []
    if rank:
        popular = [0] * len(rank)
        for k in range(len(rank) - 63):
            popular[min(range(k, k + 64), key=lambda j: (rank[j], j))] += 1
        picked = [k for k, n in enumerate(popular) if n >= 16] or [rank.index(min(rank))]
        found = [wide(data[k : k + 64]) for k in picked]
    if 8 <= len(data) < 1024:
        found += [mixed(int.from_bytes(data[k : k + 8], "little") + 0x632BE59BD9B4E019 & mask) for k in range(len(data) - 7)]
    if len(data) < 64:
        found += [mixed((k << 8 | b) + 0xE220A8397B1DCDAF & mask) for k, b in enumerate(data)]
    found = list(dict.fromkeys(found))
    out = np.zeros((-(-len(found) // 160), 2048), np.uint8)
    for k, h in enumerate(found):
        for j in range(5):
            out[k // 160, h >> 11 * j & 2047] = 1
    return out


def plain_likeness(a, b):
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = sorted((a, b), key=len) if len(a) != len(b) else (a, b)
    best = []
    for x in a:
        each = []
        for y in b:
            top, chance = min(int(x.sum()), int(y.sum())), int(x.sum()) * int(y.sum()) / 2048
            floor = chance + 0.3 * (top - chance)
            each.append(max(0.0, int((x & y).sum()) - floor) / max(top - floor, 1e-9))
        best.append(max(each))
    return min(1.0, sum(best) / len(best))


def test_against_a_plain_version():
    ranks = np.random.default_rng(5).permutation(digests.LEVELS).astype(np.uint16)
    texts = [t for _, t, *_ in cases.rows(11)] + ["a", "ab", "abcdefg", "abcdefgh", "x" * 63, "x" * 64, "y" * 1023, "y" * 1024]
    texts = [t for t in texts if len(t or "") < 4000]
    chains = [digests.filters(t, ranks) for t in texts]
    for t, chain in zip(texts, chains, strict=True):
        want = plain_filters(t, ranks)
        assert chain.shape == want.shape and (chain == want).all()
    for k in range(len(texts)):
        a, b = chains[k], chains[(k * 7 + 3) % len(texts)]
        assert abs(digests.likeness(a, b) - plain_likeness(a, b)) < 1e-5


def test_short_texts_stay_alike():
    ranks = np.arange(digests.LEVELS)
    rng = np.random.default_rng(8)
    for n in (2, 3, 5, 8, 15, 16, 17, 40, 63, 64, 90, 127, 128, 199):
        text, other = ("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 400)) for _ in range(2))
        text = text[:n]
        for following in (other, other[: n // 4]):
            assert digests.likeness(digests.filters(text, ranks), digests.filters(digests.edit(text, following), ranks)) > 0
        if n >= 15:  # a shared letter is much of a shorter text
            assert digests.likeness(digests.filters(text, ranks), digests.filters(other[:n], ranks)) < 0.2


def test_ranges_meet_and_no_table_is_written(spark):
    """Every document meets the next one whatever the ranges, also with repeated, null and far ids; only a shuffle is on disk."""
    from sievegate.llm import common

    ids = [None, None, -(2**62), 5, 5, 5, *range(10, 90, 3), 2**62]
    texts = [f"document {k} of several, " * (1 + k % 7) for k in range(len(ids))]
    order = sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    before = len(common._WRITTEN)
    got = digests.with_next(cases.frame(spark, [(i, t, None, None, None) for i, t in zip(ids, texts, strict=True)])).collect()
    assert len(common._WRITTEN) == before
    want = [(i, hashlib.sha256(digests.edit(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order)]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted([(r["doc_id"], r["edited_sha256"]) for r in got], key=key) == sorted(want, key=key)
