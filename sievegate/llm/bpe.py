"""Operator 7: byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is cut where a non-space is followed by white space and where a letter is followed by a stop or comma: no match of the
byte-level pattern spans such a place, so the pieces encode independently. A worker remembers the ids of pieces, those it met
first, up to a bound; the others are handed to the library again. Nulls encode like the empty text; repeated rows give repeated results; other columns pass through untouched.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievegate.llm.common import documents, map_arrow, tuned

_SPACED = re.compile(r"\s*+[^\s.,]++(?<=[A-Za-z])(?=[.,])|\s*+\S++|\s++").findall
_STOP = re.compile(rb"(?<=[a-z])([.,])").sub


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def tokenizer_from_ranks(path: str, pattern: str):
    """A tokenizers.Tokenizer that merges by rank: every split of a token into two tokens is a merge of the token's rank."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    chars, ranks = byte_characters(), read_ranks(path)
    names = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = [(names[t[:k]], names[t[k:]]) for t in sorted(ranks, key=ranks.get) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    tok = Tokenizer(models.BPE(vocab={names[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tok.decoder = decoders.ByteLevel()
    return tok


def tokenizer_from_json(path: str):
    """A tokenizers.Tokenizer from its file. A string of an added token in a text becomes that token's id, as the library does."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def spaced_pieces(text: str) -> list[str]:
    """White space and the non-spaces after it, cut before a stop or comma after a letter: safe to encode one by one for
    byte-level patterns, which take letters, digits, other characters and white space in turn."""
    return _SPACED(text)


def folded_pieces(text: str) -> list[bytes]:
    """For tokenizers that fold case, drop white space and split letters from other characters: pieces between white space, A-Z
    folded, cut before a full stop or comma that follows a letter. They encode one by one."""
    return _STOP(rb" \1", text.encode("utf-8", "surrogatepass").lower()).split()


class _Added(tuple):
    """An added token among pieces: never equal to a piece of text."""

    def __new__(cls, content: str):
        return super().__new__(cls, (content,))


class PieceEncoder:
    """Encodes texts by way of their pieces into little-endian unsigned 32-bit ids. Texts are cut at the tokenizer's added tokens
    first: these are found in the raw text, before anything else happens to it, and what lies between encodes by itself."""

    def __init__(self, tok, pieces: Callable[[str], list], keep: int = 1_000_000, longest: int = 48):
        self.tok, self.keep, self.longest, self.known = tok, keep, longest, {}
        tok.encode_special_tokens = True  # a piece whose case was folded may look like an added token, which it is not
        self.cut = pieces
        added = {t.content: k for k, t in tok.get_added_tokens_decoder().items()}
        self.added = {k: array("I", [v]).tobytes() for k, v in added.items()}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def pieces(self, text: str) -> list:
        if self.at_added is None or not any(x in text for x in self.added):
            return self.cut(text)
        out = []
        for k, part in enumerate(self.at_added.split(text)):
            out += [_Added(part)] if k % 2 else self.cut(part)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        known = self.known
        cut = [self.pieces(t) if t else [] for t in texts]
        new = list(set().union(*cut).difference(known))
        plain = [p for p in new if not isinstance(p, _Added)]
        known.update((p, self.added[p[0]]) for p in new if isinstance(p, _Added))
        if plain:
            texts_ = [p.decode("utf-8", "surrogatepass") for p in plain] if isinstance(plain[0], bytes) else plain
            for p, e in zip(plain, self.tok.encode_batch_fast(texts_, add_special_tokens=False), strict=True):
                known[p] = array("I", e.ids).tobytes()
        out = [b"".join(map(known.__getitem__, row)) for row in cut]
        full = len(known) > self.keep
        for p in new:
            if full or len(p) > self.longest:
                del known[p]
        return out


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(kind: str, path: str, pattern: str = "") -> PieceEncoder:
    """One encoder a worker process and vocabulary. kind: ranks, byte (tokenizers file, byte-level) or word (tokenizers file that drops white space)."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (kind, path, pattern) not in _ENCODERS:
        tok = tokenizer_from_ranks(path, pattern) if kind == "ranks" else tokenizer_from_json(path)
        _ENCODERS[kind, path, pattern] = PieceEncoder(tok, folded_pieces if kind == "word" else spaced_pieces)
    return _ENCODERS[kind, path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", offsets: bool = False) -> DataFrame:
    """Adds ids, an array of token ids; with offsets, also byte_offsets and char_offsets, arrays of the (start, end) of each
    token in the text's UTF-8 bytes and in its characters. A character split over tokens belongs to each of them."""
    tuned(df.sparkSession)
    pair = "array<struct<start:int,end:int>>"
    fields = [x for x in df.schema.fields if x.name not in {ids, "byte_offsets", "char_offsets"}]
    out = T.StructType(list(fields))
    out.add(ids, T.ArrayType(T.IntegerType()))
    if offsets:
        for name in ("byte_offsets", "char_offsets"):
            out.add(name, T._parse_datatype_string(pair))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder("ranks", vocabulary, pattern)
        lengths = token_lengths(vocabulary) if offsets else None
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            rows = [np.frombuffer(x, "<u4").astype(np.int32) for x in enc.encode(texts)]
            cols = {f.name: batch.column(batch.schema.get_field_index(f.name)) for f in fields}
            cols[ids] = pa.array(rows, pa.list_(pa.int32()))
            if offsets:
                found = [token_offsets(t or "", r, lengths) for t, r in zip(texts, rows, strict=True)]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                for k, name in enumerate(("byte_offsets", "char_offsets")):
                    cols[name] = pa.array([[{"start": int(a), "end": int(b)} for a, b in x[k]] for x in found], kind)
            yield pa.RecordBatch.from_pydict(cols)

    return df.select(*[f.name for f in fields]).mapInArrow(run, out)


_TABLES: dict[str, list[bytes]] = {}


def token_table(path: str) -> list[bytes]:
    """The bytes of each id, by reversing the table of byte characters that the vocabulary is named with."""
    if path not in _TABLES:
        ranks = read_ranks(path)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _TABLES[path] = table
    return _TABLES[path]


def token_lengths(path: str) -> np.ndarray:
    return np.array([len(x) for x in token_table(path)], np.int64)


def token_offsets(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each token in bytes and in characters."""
    ends = np.cumsum(lengths[ids]) if len(ids) else np.zeros(0, np.int64)
    starts = ends - lengths[ids] if len(ids) else ends
    lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(lead)])  # characters begun before each byte
    return np.stack([starts, ends], 1), np.stack([before[np.minimum(starts + 1, len(lead))] - 1, before[ends]], 1) if len(ids) else np.zeros((0, 2), np.int64)


def decode_bytes(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in ids.tolist()])


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text of the ids. Tokens are joined as bytes first, so characters split over tokens come back whole; bytes that
    are not UTF-8 become U+FFFD. Null ids give null."""
    tuned(df.sparkSession)
    fields = [x for x in df.schema.fields if x.name != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(vocabulary)
        for batch in batches:
            cols = {f.name: batch.column(batch.schema.get_field_index(f.name)) for f in fields}
            rows = cols[ids].to_pylist()
            cols[to] = pa.array([None if x is None else b"".join([table[i] for i in x]).decode("utf-8", "replace") for x in rows], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    return df.select(*[f.name for f in fields]).mapInArrow(run, T.StructType(list(fields)).add(to, T.StringType()))


def round_trip(df: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, decode and digest in one pass over the texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def digest(batch: pa.RecordBatch) -> dict:
        rows = encoder("ranks", vocabulary, pattern).encode(batch.column(1).to_pylist())
        table = token_table(vocabulary)
        return {
            "doc_id": batch.column(0),
            "n_tokens": [len(x) // 4 for x in rows],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in rows],
            "decoded_sha256": [hashlib.sha256(decode_bytes(np.frombuffer(x, "<u4"), table)).hexdigest() for x in rows],
        }

    return map_arrow(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", schema)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), *default_vocabulary())
