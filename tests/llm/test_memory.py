"""What a worker holds while it encodes, and after a batch."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest


def test_pieces_are_merged_in_bounded_groups():
    """2 MB of distinct words: the rounds' arrays are those of one group, and the ids are those of word by word."""
    import public_tokenizers as T

    from faintdip.llm.bpe import FOLD, Encoder, merge_with_heap, read_ranks

    encoder = Encoder(read_ranks(T.path("byte_bpe_multi_50k.tiktoken")), T.PATTERN)
    rng = np.random.default_rng(0)
    words = [bytes(rng.integers(97, 123, n, np.uint8)) for n in [*rng.integers(1, 16, 250_000), *rng.integers(FOLD - 1, FOLD + 9, 500)]]
    tracemalloc.start()
    try:
        ids, count = encoder.pieces_of(words)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    want = [merge_with_heap(w, encoder.rank) for w in words]
    assert count.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]
    assert peak < 110e6


@pytest.mark.parametrize("words", [[], [b"a"], [b"a" * 64], [b"a" * 65], [b"ab"] * 70_000, [b"a" * 64] * 2048 + [b"b"], [b"a" * 65, b"b", b"a" * 65]])
def test_groups_of_any_number_of_pieces(words):
    import public_tokenizers as T

    from faintdip.llm.bpe import Encoder, merge_with_heap, read_ranks

    encoder = Encoder(read_ranks(T.path("byte_bpe_multi_50k.tiktoken")), T.PATTERN)
    ids, count = encoder.pieces_of(words)
    want = {w: merge_with_heap(w, encoder.rank) for w in set(words)}
    assert ids.tolist() == [x for w in words for x in want[w]] and count.tolist() == [len(want[w]) for w in words]


def test_freed_arrays_are_given_back_after_a_batch():
    from faintdip.llm.flat import slices

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"Anonymous:\s+(\d+)", f.read())[1]) / 1024

    rows = [np.ones(8192) for _ in range(2000)]  # 64 KB each, in malloc's heap, whose top stays in use
    top = rows.pop()
    del rows
    before = held()
    assert [i for i, _, _ in slices(pa.array(["a"]))] == [0]
    assert before - held() > 80 and top[0] == 1
