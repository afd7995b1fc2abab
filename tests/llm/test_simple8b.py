import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tagledger.llm import simple8b, tokens


@pytest.mark.parametrize("ids", [[], [0], [1 << 63, 5, 0, 0], list(range(10_000)), [0] * 9000, [(1 << 64) - 1] * 5000, [1, 1 << 60] * 3000])
def test_round_trip(ids):
    ids = np.array(ids, np.uint64)
    words, offsets = simple8b.encode(ids)
    assert (simple8b.decode(words, offsets, len(ids)) == ids).all()


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 63).flatmap(lambda b: st.integers(0, (1 << b))), max_size=300))
def test_any_widths(ids):
    ids = np.array(ids, np.uint64)
    words, offsets = simple8b.encode(ids)
    assert (simple8b.decode(words, offsets, len(ids)) == ids).all()


def test_words_hold_what_their_width_allows():
    words, _ = simple8b.encode(np.full(simple8b.BLOCK, 1000, np.uint64))
    assert len(words) == -(-simple8b.BLOCK // 6)


def test_files_keep_ids_and_refuse_others():
    content = tokens.file_bytes(7, [1, None, -3], [np.array([5, 0], "<u4").tobytes(), b"", np.array([9], "<u4").tobytes()])
    before, docs, lengths, ids = tokens.parse(content)
    assert (before, docs, lengths.tolist(), ids.tolist()) == (7, [1, None, -3], [2, 0, 1], [5, 0, 9])
    with pytest.raises(ValueError):
        tokens.parse(b"something else")
