import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from llm_fixtures import SF_SMALL, no_docs, odd_docs, shipped  # noqa: F401
from dealflow.llm.byte_bpe import char_offsets, decode, decode_ids, encode, encode_texts, round_trip, round_trip_digests
from dealflow.llm.token_counts import count_tokens, read_cache, tokenizer_digest
from dealflow.llm.token_orc import encode_to_orc, read_token_orc, write_token_orc

RANKS, BYTE, WORD = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _texts(n=400):
    rng = random.Random(5)
    pieces = ["a", "B", "é", "漢", "🙂", " ", "  ", "\n", "\t", "\x1c", " ", "　", "'s", "'ll", "1", "23", "!!", "<|endoftext|>",
              "<|startoftext|>", "the", "and", "́", "ß", "İ", "aaa", "...", "\r\n", "x" * 40]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", " ", "a", " a ", "\n", "x" * 5000]


def test_ids_are_the_rank_files(reference):
    for text, ids in zip(_texts(), encode_texts(_texts(), RANKS, P.PATTERN)):
        assert ids.tolist() == reference.encode_ordinary(text)
        assert decode_ids(ids.tolist(), RANKS) == text.encode()


def test_offsets_cover_the_text(reference):
    for text in _texts(100):
        ids = reference.encode_ordinary(text)
        starts, ends = char_offsets(text, ids, RANKS)
        for i, s, e in zip(ids, starts, ends):
            part = reference.decode_single_token_bytes(i)
            assert part in text[s:e].encode()
        assert not ids or (starts[0] == 0 and ends[-1] == len(text) and (starts[1:] <= ends[:-1]).all())


def test_counts_match_library(spark, tmp_path):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, None), (0, texts[0])], "doc_id bigint, text string")
    library = Tokenizer.from_file(BYTE)
    got = count_tokens(docs, BYTE).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "" if r.doc_id is None else texts[r.doc_id]
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512)


def test_cache_encodes_only_misses(spark, tmp_path):
    cache, version = str(tmp_path / "cache"), tokenizer_digest(BYTE)
    docs = spark.createDataFrame([(1, "one text"), (2, "one text"), (3, "two texts")], "doc_id bigint, text string")
    first = {r.doc_id: r.n_tokens for r in count_tokens(docs, BYTE, cache).collect()}
    assert read_cache(spark, cache, version).count() == 2
    more = docs.unionByName(spark.createDataFrame([(4, "three")], "doc_id bigint, text string"))
    second = {r.doc_id: r.n_tokens for r in count_tokens(more, BYTE, cache).collect()}
    assert read_cache(spark, cache, version).count() == 3  # one miss was appended
    assert first.items() <= second.items()
    assert read_cache(spark, cache, "another version").count() == 0


def test_orc_files_round_trip(spark, tmp_path):
    texts = _texts(150)
    docs = spark.createDataFrame([(7 * i % 151, t) for i, t in enumerate(texts[:151])] + [(151, None)], "doc_id bigint, text string")
    library, path = Tokenizer.from_file(WORD), str(tmp_path / "orc")
    by_id = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in encode_to_orc(docs.repartition(5), WORD, 2, path).collect()}
    start = 0
    for i in sorted(by_id):
        ids = library.encode(by_id[i], add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    one = read_token_orc(spark, path, [3]).collect()
    assert [r.doc_id for r in one] == [3]
    assert one[0].ids == library.encode(by_id[3], add_special_tokens=False).ids + [2]
    assert "PushedFilters: [In(doc_id" in read_token_orc(spark, path, [3, 5])._jdf.queryExecution().toString()


def test_odd_rows(spark, odd_docs, no_docs, tmp_path, reference):
    rows = round_trip_digests(odd_docs, RANKS, P.PATTERN).collect()
    want = sorted((r.doc_id or -1, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd_docs.collect())
    assert sorted((r.doc_id or -1, r.decoded_sha256) for r in rows) == want
    coded = decode(encode(odd_docs, RANKS, P.PATTERN, offsets=True), RANKS).collect()
    assert all(r.ids == reference.encode_ordinary(r.text or "") and r.decoded_text == (r.text or "") for r in coded)
    assert sum(r.n_bytes for r in count_tokens(odd_docs, BYTE).collect()) == sum(len((r.text or "").encode()) for r in odd_docs.collect())
    index = sorted(encode_to_orc(odd_docs, WORD, 2).collect(), key=lambda r: r.start)
    assert len(index) == odd_docs.count() and [r.start for r in index][1:] == np.cumsum([r.n_tokens for r in index])[:-1].tolist()
    ids = [r.doc_id for r in index]
    assert ids == sorted((i for i in ids if i is not None)) + [None] * ids.count(None)
    assert round_trip_digests(no_docs, RANKS, P.PATTERN).count() == 0
    assert count_tokens(no_docs, BYTE).count() == 0
    write_token_orc(no_docs, str(tmp_path / "none"), WORD, 2)
    assert encode_to_orc(no_docs, WORD, 2).count() == 0


def test_decode_joins_split_characters(spark, reference):
    ids = reference.encode_ordinary("🙂漢")
    assert len(ids) > 2
    df = spark.createDataFrame([(ids,), (ids[:1],), ([],), (None,)], "ids array<int>")
    got = decode(df, RANKS).collect()
    assert got[0].decoded_text == "🙂漢" and "�" in got[1].decoded_text and bytes(got[2].decoded) == bytes(got[3].decoded) == b""


def test_queries_read_whole_tables(spark):
    from dealflow.llm.queries import QUERIES

    n = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    for name in ("op3_token_counts", "op7_token_orc", "op9_byte_bpe"):
        assert QUERIES[name](spark, SF_SMALL).count() == n


def test_round_trip_column(spark, odd_docs, no_docs, reference):
    rows = [(i, t) for i, t in enumerate(_texts(100))] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = round_trip(df, RANKS, P.PATTERN)
    assert out.columns == ["doc_id", "text", "ids", "round_trip"]
    for r in out.collect():
        assert r.round_trip and r.ids == reference.encode_ordinary(r.text or "")
    assert round_trip(odd_docs, RANKS, P.PATTERN).filter("round_trip").count() == odd_docs.count()
    assert round_trip(no_docs, RANKS, P.PATTERN).count() == 0


def test_stored_pieces_are_bounded_by_bytes(monkeypatch):
    from dealflow.llm import pieces

    monkeypatch.setattr(pieces, "CAPACITY", 40_000)
    encoder = pieces.PieceEncoder(Tokenizer.from_file(BYTE), pieces.packed)
    plain = Tokenizer.from_file(BYTE)
    rng = random.Random(2)
    for _ in range(60):
        text = " ".join("".join(rng.choice("abcdef") for _ in range(rng.choice((2, 3, 90)))) for _ in range(40))
        assert np.frombuffer(b"".join(encoder.encode([text])[0]), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        for store in (encoder.first, encoder.rest):
            # two generations, the younger one filled by a single text at most beyond its half
            assert sum(len(p) for p in (*store, *store.old)) * 4 <= 40_000 + 40 * (pieces.OVERHEAD + 4 * 91)


def test_a_workers_store_is_small():
    """A worker keeps its store while other stages run, so it is bounded well below a worker's share of an executor."""
    from dealflow.llm import pieces

    store = pieces.Store()
    for k in range(0, 800_000, 20_000):
        for p in store.missing({f"piece{i:08d}" for i in range(k, k + 20_000)}):
            store[p] = p
    assert "piece00799999" in store and (len(store) + len(store.old)) * (pieces.OVERHEAD + 13 * 4) <= 72 << 20


def test_round_trip_codes_few_texts_at_a_time(spark, monkeypatch):
    """Pieces of texts are objects many times their size, so only about half a MB of text is cut at a time."""
    from dealflow.llm import byte_bpe

    seen, plain = [], byte_bpe.encode_texts
    monkeypatch.setattr(byte_bpe, "encode_texts", lambda texts, *a: seen.append(sum(map(len, texts))) or plain(texts, *a))

    class Rows:
        schema = spark.createDataFrame([], "doc_id bigint, text string").schema
        drop = lambda self, *c: self
        mapInArrow = lambda self, run, schema: run

    batch = pa.record_batch([pa.array(range(400)), pa.array(["some words of text " * 500] * 400)], ["doc_id", "text"])
    out = list(byte_bpe.round_trip(Rows(), RANKS, P.PATTERN)(iter([batch])))
    assert sum(map(len, out)) == 400 and all(b.column("round_trip").to_pylist() == [True] * len(b) for b in out)
    assert max(seen) <= 600_000
