"""Encoding holds arrays of one chunk of a batch, not of the whole batch."""

import tracemalloc

import pyarrow as pa
import public_tokenizers

from covenantry.llm import bpe


def test_encoding_memory_does_not_follow_the_batch():
    codec = bpe.loaded(public_tokenizers.path("byte_bpe_50k.json"))
    bpe.code_point_classes()

    def peak(n):
        column = pa.array([f"row {i} holds a few plain words, and some more of them {i % 97}. " * 20 for i in range(n)])
        tracemalloc.start()
        tokens = sum(len(ids) for _, ids, _ in codec.encode(column))
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return tokens, top

    (few, low), (many, high) = peak(2_500), peak(10_000)
    assert many > 3.9 * few and high < 1.5 * low
