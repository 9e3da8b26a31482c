import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from revlens.llm import bpe, token_files
from revlens.llm.common import shared_folder
from revlens.llm.queries import BYTE_BPE, QUERIES, WORD_BPE

ODD = "\x1c\x85\xa0\x0bab A.,'s't \n\t  é日１2<|>  ́ßΣİ'l€🤖"


def odd_texts(k, seed):
    rng = random.Random(seed)
    parts = [*ODD, "<|endoftext|>", "<|startoftext|>", "'re", "the", " The"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(k)]


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORD_BPE)


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTE_BPE)


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_bpe_query_equals_library(spark, sf, sf_rows, word_library):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op9_bpe"](spark, sf).collect()}
    assert got == {i: digests(word_library, t) for i, t, _, _ in sf_rows}


def test_bpe_on_odd_texts(word_library):
    texts = odd_texts(3_000, 3)
    ours = bpe.RankArrayBPE(WORD_BPE)
    for t, d in zip(texts, ours.digests(texts), strict=True):
        assert d == digests(word_library, t), repr(t)


def test_bpe_long_words_equal_short_ones(word_library, monkeypatch):
    ours = bpe.RankArrayBPE(WORD_BPE)
    word = "".join(random.Random(1).choice("abcdeé") for _ in range(3_000))
    assert ours.encode(word) == word_library.encode(word, add_special_tokens=False).ids
    short = word[:150].encode()
    assert ours._long(short) == ours.words([short])[0]


def test_bpe_memo_is_bounded(monkeypatch, word_library):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 50)
    monkeypatch.setattr(bpe, "STEP_CHARS", 100)
    texts = [f"w{k} v{k * 7} the end" for k in range(200)]
    ours = bpe.RankArrayBPE(WORD_BPE)
    assert list(ours.digests(texts)) == [digests(word_library, t) for t in texts]


def test_bpe_edges(edge_docs, no_docs, word_library):
    want = sorted((str(r["doc_id"]), *digests(word_library, r["text"])) for r in edge_docs.collect())
    got = sorted((str(r[0]), *tuple(r)[1:]) for r in bpe.encode_documents(edge_docs, WORD_BPE).collect())
    assert got == want
    assert bpe.encode_documents(no_docs, WORD_BPE).count() == 0


def test_ids_round_trip(edge_docs, word_library):
    ids = bpe.token_ids(edge_docs.where("doc_id in (4, 7, 14)"), WORD_BPE)
    for r in bpe.decode_ids(ids, WORD_BPE).join(edge_docs.select("doc_id", "text").withColumnRenamed(
            "text", "original"), "doc_id").collect():
        want = word_library.encode(r["original"], add_special_tokens=False).ids
        assert r["text"] == word_library.decode(want, skip_special_tokens=False)


def byte_rows(library, rows):
    start, out = 0, []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_file_query(spark, sf, sf_rows, byte_library):
    got = sorted(map(tuple, QUERIES["op2_token_files"](spark, sf).collect()))
    assert got == byte_rows(byte_library, [(i, t) for i, t, _, _ in sf_rows])


def test_run_encoder_on_odd_texts(byte_library):
    enc = token_files.RunEncoder(BYTE_BPE)
    texts = odd_texts(5_000, 4) + ["", " ", "\n", " a", "a "]
    for t, blob in zip(texts, enc.texts(texts, 0), strict=True):
        want = byte_library.encode(t, add_special_tokens=False).ids + [0]
        assert np.frombuffer(blob, enc.kind).tolist() == want, repr(t)


def test_token_file_edges(spark, edge_docs, no_docs, byte_library):
    rows = sorted(((r["doc_id"], r["text"]) for r in edge_docs.collect()),
                  key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(map(tuple, token_files.token_file_table(edge_docs, BYTE_BPE).collect()),
                 key=lambda r: r[1])
    assert got == byte_rows(byte_library, rows)
    assert token_files.token_file_table(no_docs, BYTE_BPE).count() == 0


def test_files_and_manifest(spark, edge_docs):
    folder = shared_folder(spark, "tokens-test")
    manifest = token_files.write_token_files(edge_docs, BYTE_BPE, folder, end_id=0)
    bases = [s["base"] for s in manifest["segments"]]
    assert bases == [sum(s["n_tokens"] for s in manifest["segments"][:k]) for k in range(len(bases))]
    s = manifest["segments"][0]
    tokens = token_files.mapped(folder, s["name"] + ".bin", "<u2")
    index = token_files.mapped(folder, s["name"] + ".idx", "<i8")
    assert len(tokens) == s["n_tokens"] and len(index) == 2 * s["n_docs"] + 1
    assert (tokens[index[1:s["n_docs"] + 1] - 1] == 0).all()


def test_wide_vocabularies_get_32_bits(tmp_path, monkeypatch):
    enc = token_files.RunEncoder(BYTE_BPE)
    enc.kind = np.dtype("<u4")
    assert len(enc.texts(["a b"], 0)[0]) % 4 == 0
    assert public_tokenizers.path("byte_bpe_50k.json") == BYTE_BPE


def test_long_texts_in_parts_and_a_small_memo(byte_library, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["word", "é", "two  gaps", "a\n", "<|endoftext|>", "x" * 40]) for _ in range(400))
             for _ in range(6)] + odd_texts(50, 9)
    steps = token_files.pieces
    monkeypatch.setattr(token_files, "pieces", lambda c, t, cut: steps(c, t, step=300, cut=cut))
    monkeypatch.setattr(token_files, "MEMO_RUNS", 20)
    enc = token_files.RunEncoder(BYTE_BPE)
    for t, blob in zip(texts, enc.texts(texts, 0), strict=True):
        assert np.frombuffer(blob, enc.kind).tolist() == byte_library.encode(t, add_special_tokens=False).ids + [0]
