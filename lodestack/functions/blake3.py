"""BLAKE3 of binary columns, many chunks of 1,024 bytes at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the published algorithm.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
ORDER = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
COLUMNS_AND_DIAGONALS = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]
START, END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64
AT_ONCE = 4096  # chunks


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compressed(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Chaining values (8, n) after a block of 16 words each (16, n)."""
    n = cv.shape[1]
    low, high = (counter & np.uint64(0xFFFFFFFF)).astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32)
    v = [*cv, *(np.full(n, x, np.uint32) for x in IV[:4]), low, high, length.astype(np.uint32), flags.astype(np.uint32)]
    m = list(words)
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(COLUMNS_AND_DIAGONALS):
            for word, s, t in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = v[a] + v[b] + word
                v[d] = _turned(v[d] ^ v[a], s)
                v[c] = v[c] + v[d]
                v[b] = _turned(v[b] ^ v[c], t)
        m = [m[k] for k in ORDER]
    return np.array([v[k] ^ v[k + 8] for k in range(8)])


def _chunks(data: np.ndarray, lengths: np.ndarray, counters: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Chaining values (8, n) of chunks, rows of 1,024 bytes filled up with zeros."""
    n = len(lengths)
    cv = np.repeat(IV[:, None], n, 1)
    words = data.view("<u4").reshape(n, 16, 16)
    blocks = np.maximum(-(-lengths // BLOCK), 1)
    for b in range(int(blocks.max())):
        own = np.flatnonzero(blocks > b)
        last = blocks[own] == b + 1
        flags = (b == 0) * START + last * END + (last & single[own]) * ROOT
        size = np.where(last, lengths[own] - b * BLOCK, BLOCK)
        cv[:, own] = compressed(cv[:, own], words[own, b].T, counters[own], size, flags)
    return cv


def digest(contents: list[bytes]) -> list[bytes]:
    """The 32 bytes of each content."""
    counts = [max(-(-len(c) // CHUNK), 1) for c in contents]
    values: list[list[np.ndarray]] = [[] for _ in contents]
    held: list[tuple[int, int]] = []

    def run() -> None:
        data, lengths = np.zeros((len(held), CHUNK), np.uint8), np.zeros(len(held), np.int64)
        for row, (i, k) in enumerate(held):
            piece = contents[i][k * CHUNK : (k + 1) * CHUNK]
            lengths[row] = len(piece)
            data[row, : len(piece)] = np.frombuffer(piece, np.uint8)
        cv = _chunks(data, lengths, np.array([k for _, k in held], np.uint64), np.array([counts[i] == 1 for i, _ in held]))
        for row, (i, _) in enumerate(held):
            values[i].append(cv[:, row])
        held.clear()

    for i, n in enumerate(counts):
        for k in range(n):
            held.append((i, k))
            if len(held) == AT_ONCE:
                run()
    if held:
        run()
    out = []
    for own in values:
        level = np.array(own).T
        while level.shape[1] > 1:
            pairs = level.shape[1] // 2
            words = np.concatenate([level[:, 0 : 2 * pairs : 2], level[:, 1 : 2 * pairs : 2]])
            flags = np.full(pairs, PARENT | (ROOT if level.shape[1] == 2 else 0))
            up = compressed(np.repeat(IV[:, None], pairs, 1), words, np.zeros(pairs, np.uint64), np.full(pairs, BLOCK), flags)
            level = np.concatenate([up, level[:, 2 * pairs :]], 1)
        out.append(np.ascontiguousarray(level[:, 0]).astype("<u4").tobytes())
    return out


@F.pandas_udf(StringType())
def blake3(contents: pd.Series) -> pd.Series:
    """Lower-case hexadecimal BLAKE3 of a binary column; null for null."""
    there = contents.notna()
    out = pd.Series([None] * len(contents), contents.index, dtype=object)
    out[there] = [d.hex() for d in digest([bytes(c) for c in contents[there]])]
    return out
