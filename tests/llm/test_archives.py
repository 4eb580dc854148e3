import base64
import gzip
import hashlib
import json

from pyspark.sql import functions as F

from sievegate.llm import warc, wavelet
from sievegate.llm.common import materialize, shared_path
from tests.llm import cases


def brute(rows, least=0):
    first, payloads = {}, [(h or "").encode() for _, h in rows]
    for (page, _), p in zip(rows, payloads, strict=True):
        if len(p) >= least and page is not None:
            first[p] = min(first.get(p, page), page)
    out = []
    for (page, _), p in zip(rows, payloads, strict=True):
        f = first.get(p)
        revisit = f is not None and f != page
        out.append((page, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=repr)


def round_trip(pages, folder, **more):
    one, _ = materialize(warc.write_monolithic(pages, f"{folder}/one", **more), "files")
    two, _ = materialize(warc.normalise(one, f"{folder}/two"), "files")
    return one, two, sorted([tuple(r) for r in warc.read_pages(two).collect()], key=repr)


def test_pages(spark, sf_dir):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted([tuple(r) for r in warc.op2_warc_normaliser(spark, sf_dir).collect()], key=repr) == brute(rows)


def test_odd_pages(spark):
    rows = [(3, "u", "same"), (1, None, "same"), (2, "u\r\nX: y", None), (9, "u", ""), (None, "u", "only"), (7, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (8, "ü", "é" * 5000), (8, "ü", "é" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(1)).withColumn("key", F.lit("x"))
    one, two, got = round_trip(pages, shared_path(spark, "test"), file_bytes=100)
    assert got == brute([(r[0], r[2]) for r in rows])
    for path in [r.path.removeprefix("file://") for r in two.collect()]:
        with open(path, "rb") as data, open(path + ".idx") as index:
            raw = data.read()
            for x in map(json.loads, index):
                headers, _ = warc.parse(gzip.decompress(raw[x["offset"] : x["offset"] + x["length"]]))
                assert headers["warc-record-id"] == x["id"]
    assert round_trip(spark.createDataFrame([], "page_id long, url string, html string"), shared_path(spark, "test"))[2] == []
    assert round_trip(pages, shared_path(spark, "test"), revisit_bytes=1000)[2] == brute([(r[0], r[2]) for r in rows], 1000)


def test_wavelet_matrix():
    import numpy as np

    rng = np.random.default_rng(4)
    for n, top in ((1, 1), (5, 2), (3000, 50_257), (2000, 7), (1025, 200_000)):
        ids = rng.integers(0, top, n)
        m = wavelet.WaveletMatrix(wavelet.pack(ids, {}))
        assert (m.tokens() == ids).all()
        for k in rng.integers(0, n, 20).tolist():
            t = int(ids[k])
            places = np.flatnonzero(ids == t)
            assert m.access(k) == t and m.count(t) == len(places) and m.count(t, 0, k) == (places < k).sum()
            assert [m.select(t, j) for j in (0, len(places) - 1, len(places))] == [places[0], places[-1], -1]
        assert m.count(top + 3_000_000) == 0


def test_token_files(spark, sf_dir):
    import zlib

    import numpy as np
    import public_tokenizers as P

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))

    def want(rows):
        out, start = [], 0
        for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
            ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
            out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        return sorted(out, key=repr)

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted([tuple(r) for r in wavelet.op3_wavelet_matrix(spark, sf_dir).collect()], key=repr) == want(rows)
    data = cases.rows(2)
    shards, _ = materialize(wavelet.write(cases.frame(spark, data), shared_path(spark, "test"), P.path("byte_bpe_50k.json"), shard_tokens=500), "shards")
    assert sorted([tuple(r) for r in wavelet.read(shards).collect()], key=repr) == want([r[:2] for r in data])
    empty, _ = materialize(wavelet.write(cases.frame(spark, []), shared_path(spark, "test"), P.path("byte_bpe_50k.json")), "shards")
    assert wavelet.read(empty).count() == 0


def test_a_stream_that_is_cut_short_is_an_error():
    import io

    import pytest

    record = lambda k: f"WARC/1.0\r\nContent-Length: {k}\r\n\r\n".encode() + b"x" * k + b"\r\n\r\n"
    all_ = [record(k) for k in (5, 0, 70_000, 12)]
    members = b"".join(gzip.compress(r) for r in all_)
    for whole in (gzip.compress(b"".join(all_)), members):
        assert list(warc.records(io.BytesIO(whole).read)) == all_
        for cut in {1, 5, 30, len(whole) // 2, len(whole) - 9, len(whole) - 8, len(whole) - 1}:
            with pytest.raises((EOFError, StopIteration, RuntimeError)):
                list(warc.records(io.BytesIO(whole[:cut]).read))
    short = gzip.compress(b"".join(all_) + b"WARC/1.0\r\nContent-Le")
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(short).read))
    raw = b"".join(all_[:2])
    z = __import__("zlib").compressobj(9, 8, 31)
    unended = z.compress(raw) + z.flush(__import__("zlib").Z_SYNC_FLUSH)  # ends at a record, without a trailer
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(unended).read))
    assert list(warc.records(io.BytesIO(b"").read)) == []
