"""Token files, SentencePiece and packing: round trips and the libraries' own results."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import packing, sentencepiece_codec, token_files, token_ids


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(token_ids.default_vocabulary())
    t.encode_special_tokens = True
    return t


ODD = ["", " ", "a", " a", "a ", "a  b", "x\x1cy z", "a b\x85 c", "<|endoftext|> hi", "é è 日本 語 x", "​a​ b",
       "1 2 3 ,, ' s 's", "a﻿ b", "a\x00 b \x1f c", "　 x y", "tab\t end", "line\n next", "a b c"]


def test_cached_chunks_equal_the_library(docs, tokenizer):
    texts = [r.text for r in docs.collect()] + ODD
    encoder = token_ids.Encoder(token_ids.default_vocabulary())
    got = [np.frombuffer(x, "<u4").tolist() for x in token_ids.encoded(iter(texts), encoder, 5000)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_a_small_cache_changes_nothing(docs, tokenizer, monkeypatch):
    monkeypatch.setattr(token_ids, "CACHE_BYTES", 20_000)
    monkeypatch.setattr(token_ids, "LONGEST", 6)
    texts = [r.text for r in docs.limit(20).collect()] + ODD
    encoder = token_ids.Encoder(token_ids.default_vocabulary())
    got = [np.frombuffer(x, "<u4").tolist() for x in token_ids.encoded(iter(texts), encoder, 1000)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]


@pytest.mark.parametrize("bits", [1, 8])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(0)
    for ids in ([], [0], [1], [65535, 0, 2**32 - 1], rng.integers(0, 50257, 1001), rng.integers(0, 2**20, 64)):
        ids = np.array(ids, "<u4")
        planes = token_files.to_planes(ids, bits)
        assert (token_files.from_planes(planes, len(ids), bits) == ids).all()


@pytest.mark.parametrize("bits", [1, 8])
def test_file_round_trip(bits):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50257, n).astype("<u4").tobytes() for n in (0, 1, 5, 200_000, 65536, 65535, 1, 3)]
    sink = pa.BufferOutputStream()
    total, blocks, lengths = token_files.write_file(sink, iter(docs), bits)
    data = sink.getvalue()
    assert total == sum(lengths) == sum(map(len, docs)) // 4 and blocks == -(-total // token_files.BLOCK_IDS)
    assert [x.tobytes() for x in token_files.read_documents(pa.BufferReader(data))] == docs
    broken = data.to_pybytes()[:-1] + b"?"
    with pytest.raises(ValueError):
        token_files.read_index(pa.BufferReader(broken))


def test_token_digests(spark, docs, tokenizer):
    want, start = {}, 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [0], "<u4")
        want[r.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = token_files.token_digests(docs.repartition(7), spark).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_token_files_in_byte_planes(spark, docs):
    folder = token_files.scratch_path(spark, "byte-planes")
    manifest = token_files.write_token_files(docs, folder, planes="byte")
    assert token_files.read_token_files(manifest, folder).count() == docs.count()


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(sentencepiece_codec.default_model())


def _pieces(codec, texts):
    ids, ends = codec.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_pieces_equal_the_library(docs, codec):
    texts = [r.text for r in docs.collect()] + ODD + ["▁", "▁▁x", "a▁b", "<s> </s> <unk> <0x0A>", "a" * 3000, "        deep"]
    got = _pieces(codec, texts)
    want = codec.library.encode(texts)
    assert got == want


def test_piece_tables(docs, codec):
    texts = {r.doc_id: r.text for r in docs.collect()}
    one = {r.doc_id: (r.ids, r.text) for r in sentencepiece_codec.piece_round_trip(docs).collect()}
    two = {r.doc_id: (r.ids, r.text) for r in sentencepiece_codec.piece_texts(sentencepiece_codec.piece_ids(docs)).collect()}
    assert one == two == {i: (codec.library.encode(t), t) for i, t in texts.items()}
    nothing = docs.limit(2).selectExpr("doc_id", "CAST(NULL AS array<int>) AS ids")
    assert [r.text for r in sentencepiece_codec.piece_texts(nothing).collect()] == ["", ""]


def test_random_pieces_equal_the_library(codec):
    rng = random.Random(3)
    alphabet = "ab ▁th.,'\n(){}<s>0xétion\U0001F600日"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(5000)]
    got = _pieces(codec, texts)
    want = codec.library.encode(texts)
    assert got == want
    # ids that no text encodes to
    lists = [[rng.randrange(32000) for _ in range(rng.randrange(6))] for _ in range(500)]
    ends = np.cumsum([0, *map(len, lists)])
    texts = sentencepiece_codec._decoded(codec, np.array(sum(lists, [])), ends).to_pylist()
    assert texts == [codec.library.decode(x) for x in lists]


def test_every_text_with_runs_of_spaces_is_checked(codec, monkeypatch):
    codec.encode(["a b c"])
    merge = codec._word
    monkeypatch.setattr(codec, "_word", lambda run: merge(run[1:]) if run.startswith("▁▁") else merge(run))
    with pytest.raises(AssertionError):
        codec.encode(["fine", "a  b"])


def test_a_difference_from_the_library_is_an_error(codec, monkeypatch):
    monkeypatch.setattr(codec, "merge", lambda symbols: [5])
    monkeypatch.setattr(codec, "_cuts", {})
    monkeypatch.setattr(codec, "_words", {})
    with pytest.raises(AssertionError):
        codec.encode(["something new"])


def test_level_is_the_least_sum_of_squares():
    rng = random.Random(8)
    for _ in range(300):
        window = rng.choice([4, 16, 64])
        levels = packing.SumOfSquares(window)
        levels.count[1:window] = [rng.randrange(4) for _ in range(window - 1)]
        size = rng.randrange(1, window)
        got = levels.level_for(size)

        def squares(level):
            c = levels.count.copy()
            if level:
                c[level] -= 1
            if level + size < window:
                c[level + size] += 1
            return int((c[1:window] ** 2).sum())

        able = [0] + [h for h in range(1, window - size + 1) if levels.count[h]]
        assert got in able and squares(got) == min(map(squares, able))


@pytest.mark.parametrize("sizes", [[], [1], [1024], [1025], [5000], [1] * 3000, [600] * 50, [1023, 2, 512, 512, 513]])
def test_every_id_lies_in_one_piece(sizes):
    docs = [(k, np.arange(n, dtype="<u4").tobytes()) for k, n in enumerate(sizes)]
    windows = list(packing.pack(iter(docs)))
    parts = {}
    for pieces in windows:
        assert 0 < sum(map(len, pieces)) <= 1024
        for p in pieces:
            parts.setdefault(p.doc, []).append((p.start, p.ids))
    assert {k: b"".join(x for _, x in sorted(v)) for k, v in parts.items()} == dict(docs)
    assert sum(sum(map(len, p)) < 1024 for p in windows) <= 1


def test_packed_table(docs, tokenizer):
    want = {r.doc_id: np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [0], "<u4") for r in docs.collect()}
    fill, seen = {}, {}
    for p in packing.packed_sequences(docs.repartition(4)).orderBy("sequence_id", "offset").collect():
        assert p.offset == fill.get(p.sequence_id, 0)
        fill[p.sequence_id] = p.offset + p.length
        ids = want[p.doc_id][p.start:p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(ids.tobytes()) and bytes(p.ids) == ids.tobytes() and p.doc_tokens == len(want[p.doc_id])
        seen.setdefault(p.doc_id, []).append((p.start, p.length))
    for doc, spans in seen.items():
        spans.sort()
        assert [s for s, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) == len(want[doc])
    assert set(seen) == set(want)
    # at most one unfilled window for each of four splits
    assert sum(n < 1024 for n in fill.values()) <= 4


ADDED = ["a <|endoftext|> hi", "<|endoftext|>", " <|endoftext|>", "x<|endoftext|>y z", "a b <|endoftext|>", "plain words here",
         "<|endoftext|><|endoftext|> b", "a <|endoftext| > hi", "a  b <|endoftext|>  c", ""]


def test_added_tokens_as_the_untouched_library_reads_them(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(token_ids.default_vocabulary())
    want = [np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4") for t in ADDED]
    assert want[0].tolist() == [64, 220, 50256, 23105, 0]
    got = token_ids.encoded(iter(ADDED), token_ids.encoder(token_ids.default_vocabulary()), 40)
    assert list(got) == [x.tobytes() for x in want]
    docs = spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_digests(docs, spark).collect()}
    starts = np.cumsum([0] + [len(x) for x in want]).tolist()
    assert rows == {k: (starts[k], len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(want)}
    lengths = {r.doc_id: r.doc_tokens for r in packing.packed_sequences(docs).collect()}
    assert lengths == {k: len(x) for k, x in enumerate(want)}


def test_what_an_encoder_keeps_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(token_ids, "CACHE_BYTES", 1 << 20)
    rng = random.Random(5)
    han = [chr(c) for c in range(0x4E00, 0x9FA5)]
    encoder = token_ids.Encoder(token_ids.default_vocabulary())
    for _ in range(40):
        texts = ["".join(rng.choices(han, k=2000)) for _ in range(10)] + [
            " ".join("".join(rng.choices("abcdef", k=8)) for _ in range(1000))]
        encoder.encode(texts)
    for chunks in (encoder._chunks, encoder._old):
        assert chunks.bytes < 1 << 20 and all(len(c) <= token_ids.LONGEST for c in chunks.number)


def test_long_documents_are_cut_without_copies():
    ids = np.arange(300_000, dtype="<u4").tobytes()
    got = [p for pieces in packing.pack(iter([(1, ids), (2, ids[:4 * 2048]), (3, b"")]), 1024) for p in pieces]
    assert b"".join(bytes(p.ids) for p in got if p.doc == 1) == ids and sum(len(p) for p in got if p.doc == 2) == 2048
    assert [p.start for p in got if p.doc == 1] == list(range(0, 300_000, 1024)) and all(p.doc != 3 for p in got)
    views = [p for p in got if isinstance(p.ids, memoryview)]
    assert all(p.ids.obj is ids for p in views if p.doc == 1) and len(views) == 292 + 2


def test_what_a_codec_keeps_is_bounded_in_bytes(codec, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "CACHE_BYTES", 1 << 18)
    rng = random.Random(6)
    for _ in range(12):
        codec.encode([" ".join("".join(rng.choices("abcdef", k=rng.choice([8, 200]))) for _ in range(400))])
        assert all(len(w) <= sentencepiece_codec.LONGEST for w in codec._words)
        assert codec._held["words"] < (1 << 18) + 400 * 700
