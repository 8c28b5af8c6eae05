"""MD5 of many short texts at once, for seeded draws in Arrow functions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# fixed values of RFC 1321
ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
TURNED = (7, 12, 17, 22) * 4 + (5, 9, 14, 20) * 4 + (4, 11, 16, 23) * 4 + (6, 10, 15, 21) * 4
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Texts that are hashed at once: what is at work then stays in the cache.
TEXTS_AT_ONCE = 16_384


def _block(state: list[np.ndarray], words: list[np.ndarray | int]) -> list[np.ndarray]:
    """The state after one block of 16 words; a word that is the same in all texts is a number."""
    a, b, c, d = (s.copy() for s in state)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            at = 7 * i % 16
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word = words[at]
        f += a
        if isinstance(word, int):
            f += np.uint32((word + ADDED[i]) % 2**32)
        else:
            f += word
            f += np.uint32(ADDED[i])
        np.left_shift(f, np.uint32(TURNED[i]), out=g), np.right_shift(f, np.uint32(32 - TURNED[i]), out=f)
        f |= g
        f += b
        # the array of the oldest word is written to next
        a, b, c, d, f = d, f, b, c, a
    return [s + x for s, x in zip(state, (a, b, c, d))]


def _halves(words: np.ndarray, used: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last 64 bits, in the order of the hash text, per column of padded words; beyond ``used`` only the bit count is not 0."""
    n = words.shape[1]
    first, last = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for at in range(0, n, TEXTS_AT_ONCE):
        rows = words[:, at : at + TEXTS_AT_ONCE]
        state = [np.full(rows.shape[1], s, np.uint32) for s in START]
        for k in range(0, len(rows), 16):
            state = _block(state, [rows[i] if i < used or i == len(rows) - 2 else 0 for i in range(k, k + 16)])
        a, b, c, d = (s.byteswap().astype(np.uint64) for s in state)
        first[at : at + TEXTS_AT_ONCE], last[at : at + TEXTS_AT_ONCE] = a << np.uint64(32) | b, c << np.uint64(32) | d
    return first, last


def seeded_draws(seed: int, ids: pa.Array, tails: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """MD5 of ``seed|id|tail`` as two numbers of 64 bits, whose order is that of the hash texts: a row per tail, a column per id.

    A null id is left out with its separator, as ``concat_ws`` does.
    """
    ends = [f"|{t}".encode() for t in tails]
    longs = {long: np.array([k for k, e in enumerate(ends) if len(e) == long]) for long in {len(e) for e in ends}}
    first, last = (np.empty((len(ends), len(ids)), np.uint64) for _ in range(2))
    sizes = pc.fill_null(pc.binary_length(ids), -1).to_numpy(zero_copy_only=False)
    # texts of one number of blocks are hashed together, whatever their lengths
    alike: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]] = {}
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        head = np.frombuffer(f"{seed}|".encode() if size >= 0 else str(seed).encode(), np.uint8)
        if size > 0:
            own = np.frombuffer(b"".join(pc.take(ids, pa.array(rows)).cast(pa.binary()).to_pylist()), np.uint8).reshape(len(rows), size)
            head = np.concatenate([np.broadcast_to(head, (len(rows), len(head))), own], axis=1)
        for long, which in longs.items():
            start, whole = head.shape[-1], head.shape[-1] + long
            text = np.zeros((len(which), len(rows), whole // 4 * 4 + 4), np.uint8)
            text[:, :, :start] = head
            text[:, :, start:whole] = np.array([list(ends[k]) for k in which], np.uint8)[:, None]
            text[:, :, whole] = 0x80
            alike.setdefault((whole + 8) // 64 + 1, []).append((which, rows, text.reshape(-1, text.shape[2]).view("<u4"), whole))
    for blocks, parts in alike.items():
        words = np.zeros((16 * blocks, sum(len(t) for _, _, t, _ in parts)), np.uint32)
        at = 0
        for _, _, text, whole in parts:
            words[: text.shape[1], at : at + len(text)] = text.T
            words[-2, at : at + len(text)] = 8 * whole
            at += len(text)
        one, two = _halves(words, max(t.shape[1] for _, _, t, _ in parts))
        at = 0
        for which, rows, text, _ in parts:
            place, here = np.ix_(which, rows), slice(at, at + len(text))
            first[place], last[place] = one[here].reshape(len(which), -1), two[here].reshape(len(which), -1)
            at += len(text)
    return first, last
