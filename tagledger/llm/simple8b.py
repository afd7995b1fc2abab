"""Simple-8b: whole numbers packed into 64-bit words, vectorised over blocks.

The top 4 bits of a word are a selector, which says how many ids share the other
60 bits. Ids of more than 60 bits follow an escape as a raw word. A block holds
a fixed count of ids (the last one fewer) and starts on a word of its own, so blocks
decode side by side from their offsets. Within a block the longest run that fits
is packed first; what a word has room for beyond the block's end is zero.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the format: ids per word and bits per id, by selector.
COUNTS = np.array([120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64], np.int64)
ESCAPE = 15
BLOCK = 4096
PAD = int(COUNTS.max())


_SMALL = np.array([x.bit_length() for x in range(1 << 16)], np.uint8)


def bit_widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, 0 for 0."""
    if ids.size and ids.max() < len(_SMALL):
        return _SMALL[ids]
    high, rest = np.zeros(ids.shape, np.uint8), ids.astype(np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        over = rest >= (np.uint64(1) << np.uint64(step))
        high += over.astype(np.uint8) * np.uint8(step)
        rest = np.where(over, rest >> np.uint64(step), rest)
    return high + (rest > 0).astype(np.uint8)


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For each place of a row, the first selector whose run fits there."""
    choice = np.full(bits.shape, ESCAPE, np.uint8)
    spans = {1: bits}
    size = 1
    while size * 2 <= PAD:  # maxima over runs of 2, 4, 8 and so on
        wide = spans[size].copy()
        wide[:, :-size] = np.maximum(wide[:, :-size], spans[size][:, size:])
        size *= 2
        spans[size] = wide
    for selector in reversed(range(ESCAPE)):  # longer runs overrule shorter ones
        count, width = int(COUNTS[selector]), int(WIDTHS[selector])
        part = 1 << (count.bit_length() - 1)
        top = spans[part]
        if count > part:
            top = top.copy()
            np.maximum(top[:, : part - count], spans[part][:, count - part:], out=top[:, : part - count])
        np.copyto(choice, np.uint8(selector), where=top <= width)
    return choice


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): a word offset for each block, and the end."""
    ids = ids.astype(np.uint64)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    padded = np.zeros((blocks, BLOCK + PAD), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[: len(ids)] = ids
    padded[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    length = np.full(blocks, BLOCK)
    length[-1] = len(ids) - (blocks - 1) * BLOCK
    choice, padded = _selectors(bit_widths(padded)).ravel(), padded.ravel()
    # where the next word begins, from every place; a block that is through stays where it is
    begin, step = np.arange(blocks) * (BLOCK + PAD), COUNTS[choice].reshape(blocks, -1)
    for row, stop in zip(step, length.tolist()):
        row[stop:] = 0
    onward, end = np.arange(len(choice)) + step.ravel(), begin + length
    steps = [begin]
    while len(steps) % 64 or (steps[-1] < end).any():
        steps.append(onward[steps[-1]])
    heads = np.array(steps).T
    heads = heads[heads < end[:, None]]  # block by block, in order of place
    block, selector = heads // (BLOCK + PAD), choice[heads].astype(np.int64)
    long = selector == ESCAPE
    word_at = np.arange(len(heads)) + np.cumsum(long) - long
    words = np.zeros(len(heads) + int(long.sum()), np.uint64)
    for s in np.unique(selector).tolist():
        mine = np.flatnonzero(selector == s)
        at = heads[mine]
        value = np.full(len(at), np.uint64(s) << np.uint64(60))
        if s == ESCAPE:
            words[word_at[mine] + 1] = padded[at]
        else:
            for k in range(int(COUNTS[s]) if WIDTHS[s] else 0):
                value |= padded[at + k] << np.uint64(k * int(WIDTHS[s]))
        words[word_at[mine]] = value
    offsets = np.append(word_at[np.searchsorted(block, np.arange(blocks))], len(words))
    return words, offsets


def decode(words: np.ndarray, offsets: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of all blocks."""
    blocks = len(offsets) - 1
    if not blocks:
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == ESCAPE).tolist():
        if not raw[i]:
            raw[i + 1] = True
    heads = np.flatnonzero(~raw)
    block = np.searchsorted(offsets, heads, side="right") - 1
    count = COUNTS[selector[heads]]
    before = np.cumsum(count) - count
    first = np.searchsorted(block, np.arange(blocks))
    place = before - before[first][block] + block * (BLOCK + PAD)
    out = np.zeros(blocks * (BLOCK + PAD), np.uint64)
    for s in np.unique(selector[heads]).tolist():
        mine = np.flatnonzero(selector[heads] == s)
        at, value = place[mine], words[heads[mine]]
        if s == ESCAPE:
            out[at] = words[heads[mine] + 1]
            continue
        width = int(WIDTHS[s])
        mask = np.uint64((1 << width) - 1)
        for k in range(int(COUNTS[s]) if width else 0):
            out[at + k] = (value >> np.uint64(k * width)) & mask
    return out.reshape(blocks, -1)[:, :BLOCK].reshape(-1)[:n_ids]
