"""Byte-level BPE encoding and decoding with the tokenizers library (operator 9).

The rank file is turned into a ``tokenizers`` BPE model: every token's bytes
are written with the printable byte alphabet, and every split of a token into
two known tokens is a merge, in rank order.  Texts travel in Arrow batches.

Null and odd input: a null text is the empty text; the empty text has no ids
and decodes to no bytes.  Rows are independent, so repeated rows, repeated or
null ``doc_id`` and extra columns of any name change nothing: each input row
gives one output row.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PIECE, slices
from .pieces import PieceEncoder, packed, worker_encoder


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def _tokenizer(path: str, pattern: str):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, alphabet = read_ranks(path), byte_alphabet()
    shown = {token: "".join(alphabet[b] for b in token) for token in ranks}
    merges = [(shown[token[:i]], shown[token[i:]])
              for token in sorted(ranks, key=ranks.get)
              for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    tokenizer = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


@lru_cache(maxsize=4)
def _token_bytes(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def _encoder(path: str, pattern: str):
    return worker_encoder(("ranks", path, pattern), lambda: PieceEncoder(_tokenizer(path, pattern), packed))


def encode_texts(texts: list[str], path: str, pattern: str) -> list[np.ndarray]:
    """Ids of each whole text, as unsigned 32-bit arrays."""
    return [np.frombuffer(b"".join(parts), "<u4") for parts in _encoder(path, pattern).encode(texts)]


def decode_ids(ids, path: str) -> bytes:
    """The bytes of the tokens, one after the other; characters split between tokens come together again."""
    return b"".join(map(_token_bytes(path).__getitem__, ids))


def char_offsets(text: str, ids, path: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of each token; a token with part of a character covers all of it."""
    table = _token_bytes(path)
    ends = np.cumsum([len(table[i]) for i in ids], dtype=np.int64)
    begins = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
    # characters begun up to and including each byte
    begun = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
    return (begun[begins] - 1, begun[ends - 1]) if len(ends) else (ends, ends)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """Add ``ids`` (and ``starts``, ``ends`` in characters) to every row of ``df``.

    New columns replace columns of the same name.
    """
    added = ["ids"] + ["starts", "ends"] * offsets
    kept = df.drop(*added)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
                       + [f"{c} array<{'int' if c == 'ids' else 'bigint'}>" for c in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, PIECE):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            ids = encode_texts(texts, path, pattern)
            new = [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))]
            if offsets:
                both = [char_offsets(t, x.tolist(), path) for t, x in zip(texts, ids)]
                new += [pa.array([b[k] for b in both], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(batch.columns + new, batch.schema.names + added)

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary) and ``decoded_text`` (UTF-8, broken sequences replaced) to rows with ids."""
    kept = df.drop("decoded", "decoded_text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
                       + ["decoded binary", "decoded_text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [decode_ids(x or (), path) for x in batch.column(ids).to_pylist()]
            new = [pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())]
            yield pa.RecordBatch.from_arrays(batch.columns + new, batch.schema.names + ["decoded", "decoded_text"])

    return kept.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``ids`` and ``round_trip``, whether they decode to the row's text, in one pass over its Arrow batches.

    New columns replace columns of the same name.
    """
    kept = df.drop("ids", "round_trip")
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, PIECE):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            ids = encode_texts(texts, path, pattern)
            same = [decode_ids(x.tolist(), path) == t.encode("utf-8", "surrogatepass") for t, x in zip(texts, ids)]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate(ids).view(np.int32) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(bounds), flat), pa.array(same, pa.bool_())],
                                             [*batch.schema.names, "ids", "round_trip"])

    return kept.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode and digest every document in one pass over its Arrow batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            counts, id_digests, byte_digests = [], [], []
            for ids in encode_texts([t or "" for t in batch.column("text").to_pylist()], path, pattern):
                ids = ids.tolist()
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                byte_digests.append(hashlib.sha256(decode_ids(ids, path)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()),
                 pa.array(byte_digests, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
