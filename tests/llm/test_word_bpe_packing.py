"""Packed numbers of the word table."""

import numpy as np
import pyarrow as pa

from scorelens.llm import word_bpe


def test_packed_numbers_come_back_and_low_bytes_lie_apart():
    rng = np.random.default_rng(2)
    cases = [[], [0], [255, 256], [0, 255, 256, 65_535, 65_536, (1 << 31) - 1], rng.zipf(1.2, 50_000) % 400_000]
    for numbers in cases:
        numbers = np.array(numbers, np.int32)
        assert word_bpe._unpack(word_bpe._pack(numbers)).tolist() == numbers.tolist()
    together = np.ascontiguousarray(cases[-1].astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()
    assert len(word_bpe._pack(cases[-1])) < 0.97 * len(pa.compress(together, codec="zstd", asbytes=True))
