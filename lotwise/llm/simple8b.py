"""Simple-8b word-aligned coding of token ids, vectorised over fixed blocks of ids (numpy only).

A 64-bit word holds a selector in its top 4 bits and 60 payload bits. Selector s < 14 packs COUNTS[s] ids of BITS[s]
bits each, lowest first; selector 14 is an escape: the next word holds one raw 64-bit id. Blocks of BLOCK ids are coded
on their own, padded with zeros, and their first words' places are stored, so any block decodes alone.
"""

from __future__ import annotations

import numpy as np

BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
COUNTS = np.append(60 // BITS, 1)
ESCAPE, BLOCK, PAD = 14, 128, 60
_LIMITS = np.array([1 << int(b) for b in BITS], dtype=np.uint64)

_SMALL = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def _picks(kind: np.ndarray) -> np.ndarray:
    """The selector that packs most ids from each place on; kind: bits class of each id, rows end in PAD zeros."""
    flat = kind.ravel()
    pick = np.where(flat >= ESCAPE, ESCAPE, 13).astype(np.uint8)
    most, size = flat.copy(), 1  # most[i]: largest class of the next ``size`` ids
    for s in range(12, -1, -1):
        n = int(COUNTS[s])
        while size < n:  # widen by at most doubling: overlapping windows are fine for a maximum
            step = min(size, n - size)
            most[:-step] = np.maximum(most[:-step], most[step:])
            size += step
        fits = most <= s
        if not fits.any() and not (flat[: -PAD or None] <= s).any():
            break
        np.putmask(pick, fits, s)
    return pick.reshape(kind.shape)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, place of each block's first word) of ids; no ids give no words."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    blocks = -(-n // BLOCK)
    grid = np.zeros((blocks, BLOCK + PAD), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = ids
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    if flat.max() < len(_SMALL):
        kind = _SMALL[grid]
    else:
        kind = np.searchsorted(_LIMITS, grid.ravel(), side="right").astype(np.uint8).reshape(grid.shape)
    pick = _picks(kind)
    at, rows, steps, places = np.zeros(blocks, np.int64), np.arange(blocks), [], []
    ends = np.full(blocks, BLOCK)
    ends[-1] = n - (blocks - 1) * BLOCK
    while (live := at < ends).any():
        s = pick[rows, np.minimum(at, BLOCK - 1)]
        steps.append(np.where(live, s, 255))
        places.append(at.copy())
        at = np.where(live, at + COUNTS[np.minimum(s, ESCAPE)], at)
    selector, place = np.stack(steps, 1), np.stack(places, 1)
    used = selector != 255
    block = np.broadcast_to(rows[:, None], used.shape)[used]
    selector, place = selector[used].astype(np.int64), place[used]
    words, cells = selector.astype(np.uint64) << np.uint64(60), grid.ravel()
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        if s == ESCAPE:
            continue
        base, packed = block[mine] * (BLOCK + PAD) + place[mine], np.zeros(len(mine), np.uint64)
        for j in range(int(COUNTS[s])):
            part = cells[base + j] << np.uint64(j * int(BITS[s]))
            packed |= part
        words[mine] |= packed
    sizes = np.bincount(block, minlength=blocks)
    if (raw := np.flatnonzero(selector == ESCAPE)).size:
        words = np.insert(words, raw + 1, grid[block[raw], place[raw]])
        sizes = sizes + np.bincount(block[raw], minlength=blocks)
    return words, (np.cumsum(sizes) - sizes).astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids of encode()'s words and block offsets."""
    blocks = len(offsets)
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    head = np.ones(len(words), bool)
    escapes, last = [], -2
    for i in np.flatnonzero(selector == ESCAPE):  # rare; a raw word may look like an escape itself
        if i != last + 1 or not head[last]:
            escapes.append(i)
            head[i + 1] = False
            last = i
    block = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    raw = words[np.array(escapes, dtype=np.int64) + 1] if escapes else None
    words, selector, block = words[head], selector[head], block[head]
    counts = COUNTS[selector]
    before = np.cumsum(counts) - counts
    first = np.searchsorted(block, np.arange(blocks))
    place = before - before[first][block]
    grid = np.zeros((blocks, BLOCK + PAD), np.uint64)
    cells = grid.ravel()
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        base, own = block[mine] * (BLOCK + PAD) + place[mine], words[mine]
        if s == ESCAPE:
            cells[base] = raw
            continue
        bits = int(BITS[s])
        mask = np.uint64((1 << bits) - 1)
        for j in range(int(COUNTS[s])):
            cells[base + j] = (own >> np.uint64(j * bits)) & mask
    return grid[:, :BLOCK].reshape(-1)[:n]
