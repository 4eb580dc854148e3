import binascii
import math

import numpy as np

from sievegate.llm import langid
from tests.llm import cases


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: r for r in langid.op1_language_id(spark, d).collect()}
    assert set(got) == set(truth)
    for k, r in got.items():
        assert r.held_out == (binascii.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in truth[k][1] or ""))
    held = [(truth[k][0], r.lang_pred) for k, r in got.items() if r.held_out and truth[k][0] and r.lang_pred != "und" and len(truth[k][1]) >= 40]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_odd_rows(spark):
    df = langid.with_split(cases.frame(spark))
    model = langid.fit(df.where("NOT held_out AND lang IS NOT NULL").select("doc_id", "text", "lang"))
    rows = langid.predict(df, model).collect()
    assert len(rows) == df.count() and {r.lang_pred for r in rows} <= {"en", "de", "und"}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    empty = langid.with_split(cases.frame(spark, []))
    model = langid.fit(empty.select("doc_id", "text", "lang"))
    assert langid.predict(empty, model).count() == 0 and {r.lang_pred for r in langid.predict(df, model).collect()} == {"und"}


def test_pieces_count_the_same(monkeypatch):
    text = "Ein Satz, über viele Stücke; und noch 1 mehr! " * 20
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "PIECE", 64)
    assert (langid.counts(text) == whole).all()


def plain_ftrl(rows, classes, size, alpha=0.5, beta=1.0, l1=0.02, l2=0.02, epochs=4, seed=7):
    """One weight at a time."""
    z, n = {}, {}

    def weight(k):
        x = z.get(k, 0.0)
        return 0.0 if abs(x) <= l1 else -(x - math.copysign(l1, x)) / ((beta + math.sqrt(n.get(k, 0.0))) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            at, x, y = rows[r]
            pairs = [*zip(at.tolist(), x.tolist(), strict=True), (size, 1.0)]
            w = {(i, c): weight((i, c)) for i, _ in pairs for c in range(classes)}
            scores = [sum(v * w[i, c] for i, v in pairs) for c in range(classes)]
            e = [math.exp(s - max(scores)) for s in scores]
            for i, v in pairs:
                for c in range(classes):
                    g = v * (e[c] / sum(e) - (c == y))
                    before = n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * w[i, c]
                    n[i, c] = before + g * g
    return np.array([[weight((i, c)) for c in range(classes)] for i in range(size + 1)])


def test_ftrl_against_a_plain_version(monkeypatch):
    monkeypatch.setattr(langid, "SIZE", 12)
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(60):
        at = np.sort(rng.choice(12, 4, replace=False))
        rows.append((at, rng.random(4), int(at[0] % 3)))
    zeros = []
    for l1 in (0.0, 0.3, 2.0):
        got = langid.ftrl(rows, 3, l1=l1)
        assert np.allclose(got, plain_ftrl(rows, 3, 12, l1=l1))
        zeros.append(int((got == 0).sum()))
    assert zeros[0] < zeros[1] < zeros[2]  # l1 makes it sparse
    assert np.abs(langid.ftrl(rows, 3, l2=5.0)).sum() < np.abs(langid.ftrl(rows, 3, l2=0.0)).sum()


def test_temperature_is_of_least_loss():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 400)
    logits = rng.normal(0, 4, (400, 3))
    logits[np.arange(400), y] += 3
    loss = lambda t: -np.log(langid.softmax(logits / t)[np.arange(400), y]).mean()
    t = langid.temperature(logits, y)
    assert loss(t) <= min(loss(x) for x in np.geomspace(0.05, 20, 300)) + 1e-9


def test_most_frequent_languages_are_learned(spark):
    data = [(k, f"text of number {k} in words", f"lang{k % 7 if k % 3 else 0}", "s", None) for k in range(200)]
    train = cases.frame(spark, data).select("doc_id", "text", "lang")
    model = langid.fit(train, per_class=5, max_classes=3)
    assert len(model["langs"]) == 3 and "lang0" in model["langs"]
