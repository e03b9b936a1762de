"""BPE by pair occurrence index and token files, against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from covenantry.llm import dac
from covenantry.llm.bpe import Bpe, decode, encode, encode_digests
from tests.llm.brute import awkward, empty

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def noise(seed: int, n: int = 1500) -> list[str]:
    rng = random.Random(seed)
    signs = list("ab'SstrvemldΣσ  \n\t1é日🙂! ,.\x1c\xa0İHǺ̱")
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def ids_of(codec, texts):
    return [ids[a:b].tolist() for _, ids, bounds in codec.encode(pa.array(texts, pa.string()))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_ids_equal_the_library():
    texts = noise(1) + ["aaaa" * 300, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endof text|>", "x's 'they've"]
    library = Tokenizer.from_file(BYTES)
    assert ids_of(Bpe(BYTES), texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_decoding_replaces_what_is_no_text():
    codec = Bpe(BYTES)
    cut = codec.encode(pa.array(["é"]))
    assert codec.decode_text(next(cut)[1]) == "é"
    half = [i for i, p in enumerate(codec.pieces) if p == b"\xc3"]
    assert codec.decode_text(half) == "�" == Tokenizer.from_file(BYTES).decode(half, skip_special_tokens=False)


def test_bpe_of_awkward_rows(spark):
    docs, rows = awkward(spark)
    library = Tokenizer.from_file(BYTES)
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows), key=str)
    encoded = encode(docs, BYTES)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=str) == want
    assert sorted(map(str, ((r.doc_id, r.text) for r in decode(encoded, BYTES).collect()))) == sorted(
        str((i, t or "")) for i, t in rows)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_digests(docs, BYTES).collect()}
    assert got == {(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256((t or "").encode()).hexdigest())
                   for i, t in rows for ids in [library.encode(t or "", add_special_tokens=False).ids]}
    assert encode(empty(spark), BYTES).count() == 0


def test_any_token_of_a_file_is_addressed():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 1 << k, 700) for k in (3, 8, 9, 16, 17, 25, 32)])
    reader = dac.Reader(dac.pack(np.array([5, 6]), np.array([0, 10, len(ids)]), ids))
    assert [reader.token(i) for i in range(0, len(ids), 7)] == ids[::7].tolist()
    for a, b in ((0, len(ids)), (5, 5), (511, 513), (1000, 4000)):
        assert reader.tokens(a, b).tolist() == ids[a:b].tolist()
    assert reader.document(0).tolist() == ids[:10].tolist()
    with pytest.raises(ValueError):
        dac.Reader(b"something else")


def test_pieces_give_the_ids_of_texts():
    texts = noise(2) + ["", None, "<|endoftext|>", "a <|startoftext|>b\n<|startoftext|>", "H̱ Å"]
    library = Tokenizer.from_file(WORDS)
    assert ids_of(dac.PieceEncoder(WORDS, 2), texts) == [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_files_in_order_of_ids(spark, monkeypatch):
    monkeypatch.setattr(dac, "FILE_TOKENS", 500)
    docs, rows = awkward(spark)
    docs, rows = docs.unionByName(docs.filter("doc_id is null")), rows + [r for r in rows if r[0] is None]
    library = Tokenizer.from_file(WORDS)
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [2])
    folder, files = dac.write_ids(docs, WORDS, 2)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in dac.read_digests(spark, folder, files).collect()), key=lambda r: r[0])
    # rows without an id come first
    assert [r[1] for r in got] == [None, None] + sorted(i for i, _ in rows if i is not None)
    place = 0
    for start, doc, n, crc in got:
        assert start == place and (n, crc) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids[doc]]
        place += n
    assert sorted(map(str, dac.read_ids(spark, folder, files).select("doc_id", "ids").collect()))
    folder, files = dac.write_ids(empty(spark), WORDS, 2)
    assert dac.read_digests(spark, folder, files).count() == 0
