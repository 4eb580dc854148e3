import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievegate.llm import bpe, packing
from tests.llm import cases

TEXT = st.text(st.sampled_from(list("aB.,'s \n\t  é日́İß1½-_🙂​Σ <|>")), max_size=40)


def tik():
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_round_trip(spark, sf_dir):
    enc = tik()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = []
    for doc_id, text in rows:
        ids = enc.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = [tuple(r) for r in bpe.op7_bpe_round_trip(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)


def test_odd_rows(spark):
    df = cases.frame(spark)
    enc = tik()
    out = bpe.decode(bpe.encode(df, *bpe.default_vocabulary(), offsets=True), bpe.default_vocabulary()[0])
    for r in out.collect():
        text = r["text"] or ""
        assert r["decoded"] == text and r["ids"] == enc.encode_ordinary(text)
        raw = text.encode()
        assert [raw[a:b] for a, b in r["byte_offsets"]] == [enc.decode_single_token_bytes(i) for i in r["ids"]]
        assert all(0 <= a <= b <= len(text) for a, b in r["char_offsets"])
    assert set(df.columns) <= set(out.columns)
    assert bpe.round_trip(cases.frame(spark, []), *bpe.default_vocabulary()).count() == 0


@pytest.mark.parametrize("kind", ["byte", "word", "ranks"])
def test_pieces_are_safe(kind):
    import public_tokenizers as P

    path = {"byte": P.path("byte_bpe_50k.json"), "word": packing.default_vocabulary(), "ranks": P.path("byte_bpe_50k.tiktoken")}[kind]
    enc = bpe.encoder(kind, path, P.PATTERN if kind == "ranks" else "")

    @settings(max_examples=400, deadline=None)
    @given(TEXT)
    def run(text):
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == enc.tok.encode(text, add_special_tokens=False).ids

    run()


def test_memory_of_pieces_is_bounded():
    import public_tokenizers as P

    enc = bpe.PieceEncoder(bpe.tokenizer_from_json(P.path("byte_bpe_50k.json")), bpe.spaced_pieces, keep=10)
    texts = [f"word{k} other{k}" for k in range(50)]
    first = [enc.encode([t])[0] for t in texts]
    assert first == [enc.encode([t])[0] for t in texts] and len(enc.known) <= 12
