import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evidence_lake.llm import tokens
from evidence_lake.llm.op2_packing import pack
from evidence_lake.llm.op10_token_file import pack_words, read_back, unpack_words, written

PATH = tokens.default_path()
TEXTS = [
    None, "", " ", "Hello world", "it's WE'LL don't\tstop\n\nnow 2024", "naïve Café élève H̱ İstanbul ΣΑΣ ß",
    "a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|>", "nb sp em\x1cfs\x85nel​zw", "日本語 テキスト 한국어 ١٢٣", "#$%&*** a--b !!! @@x 's",
    "\x00\x01ctl\x7f", "word " * 5000, "x" * 3000, "🙂👍🏽 ok", "Hello world",
]


TOK = Tokenizer.from_file(PATH)
ENC = tokens.TextEncoder(PATH)


def reference(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def flat(texts, path=PATH):
    ids, size = (ENC if path == PATH else tokens.TextEncoder(path)).encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]


def test_word_path_equals_library():
    assert tokens.TextEncoder(PATH).word_level
    assert flat(TEXTS) == [reference(x) for x in TEXTS]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
def test_word_path_equals_library_on_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert flat(texts) == [reference(x) for x in texts]


def test_other_tokenizer_encodes_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not tokens.TextEncoder(path).word_level
    tok = Tokenizer.from_file(path)
    assert flat(["a  b\nc", "d"], path) == [tok.encode(x, add_special_tokens=False).ids for x in ("a  b\nc", "d")]


def test_cache_that_overflows_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    enc = tokens.TextEncoder(PATH)
    for _ in range(2):
        ids, size = enc.encode(pa.array(TEXTS, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [reference(x) for x in TEXTS]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 49407), st.integers(0, 1), st.integers(0, 2**64 - 1), st.just((1 << 60) - 1)), max_size=3000))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, offsets, escapes = pack_words(v)
    assert unpack_words(words, offsets, escapes, len(v)).tolist() == values


def test_simple8b_runs_and_density():
    v = np.concatenate([np.zeros(5000, np.uint64), np.arange(49408, dtype=np.uint64), np.ones(999, np.uint64)])
    words, offsets, escapes = pack_words(v)
    assert (unpack_words(words, offsets, escapes, len(v)) == v).all()
    assert len(words) * 8 < len(v) * 2.2


def table(spark):
    rows = [(i * 3 % 7 if i % 5 else None, t, f"s{i}", i) for i, t in enumerate(TEXTS * 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, part long").repartition(4)


def test_packing_against_brute_force(spark):
    length = 64
    got = pack(table(spark), PATH, length=length, with_ids=True).toPandas()
    want = sorted((x[0] if x[0] is not None else -1, zlib.crc32(np.array(reference(x[1]) + [1], "<u4").tobytes())) for x in table(spark).collect())
    got = got.sort_values(["sequence_id", "offset"])
    # gapless windows, all full but the last
    for s, g in got.groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.concatenate([[0], g["length"].cumsum().to_numpy()[:-1]])).all()
        assert g["length"].sum() == length or s == got["sequence_id"].max()
    assert all(zlib.crc32(bytes(b)) == c for b, c in zip(got["ids"], got["ids_crc32"]))
    docs, buf = [], b""
    for r in got.itertuples():
        assert r.start == len(buf) // 4
        buf += bytes(r.ids)
        if len(buf) == 4 * r.doc_tokens:
            docs.append((r.doc_id if r.doc_id == r.doc_id else -1, zlib.crc32(buf)))
            buf = b""
    assert sorted((int(a), b) for a, b in docs) == want


@pytest.mark.parametrize("block", [10, 1 << 18])
def test_token_file_against_brute_force(spark, block):
    got = read_back(written(table(spark), PATH, block=block)).toPandas().sort_values("start")
    assert got["start"].tolist() == [0, *got["n_tokens"].cumsum().tolist()[:-1]]
    order = got["doc_id"].fillna(-1).tolist()
    assert order == sorted(order)
    want = sorted((x[0] if x[0] is not None else -1, zlib.crc32(np.array(reference(x[1]) + [1], "<u4").tobytes())) for x in table(spark).collect())
    assert sorted((int(a), int(b)) for a, b in zip(got["doc_id"].fillna(-1), got["ids_crc32"])) == want


def test_empty_tables(spark):
    empty = table(spark).limit(0)
    assert pack(empty, PATH).count() == 0
    assert read_back(written(empty, PATH)).count() == 0
