"""CRC-32C of many byte strings at once, in numpy."""

from __future__ import annotations

from functools import cache

import numpy as np

POLYNOMIAL = 0x82F63B78  # Castagnoli, reflected
MASK_DELTA = 0xA282EAD8  # of the masked checksum that record files carry
BLOCK = 512  # bytes; every lane is one block


@cache
def _two_bytes() -> np.ndarray:
    """State after two bytes, by the low 16 bits of the state xor the bytes."""
    c = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1)
    return c


def _run(state: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    step = _two_bytes()
    for column in lanes.T:
        state = (state >> 16) ^ step[(state ^ column) & 0xFFFF]
    return state


@cache
def _past_block() -> np.ndarray:
    """What a block of zeros makes of a state, for each of its four bytes."""
    states = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    return _run(states, np.zeros((1024, BLOCK // 2), np.uint16)).reshape(4, 256)


def crc32c(data: list[bytes]) -> np.ndarray:
    """The CRC-32C of each string; each has four bytes at least and an even number of them.

    The initial state is the same as flipping the first 32 bits, after which zeros may stand in
    front. So each string is filled up in front to whole blocks, all blocks go side by side, and
    a string's blocks are then chained by the table for a block of zeros.
    """
    if not data:
        return np.empty(0, np.uint32)
    sizes = np.array([len(x) for x in data])
    blocks = -(-sizes // BLOCK)
    ends = np.cumsum(blocks) * BLOCK
    lanes = np.zeros(int(ends[-1]), np.uint8)
    for x, end, size in zip(data, ends, sizes, strict=True):
        lanes[end - size : end] = np.frombuffer(x, np.uint8)
    heads = (ends - sizes)[:, None] + np.arange(4)
    lanes[heads] ^= 0xFF
    states = _run(np.zeros(len(lanes) // BLOCK, np.uint32), lanes.view("<u2").reshape(-1, BLOCK // 2).astype(np.uint32))
    first, shift = np.cumsum(blocks) - blocks, _past_block()
    crc = states[first]
    for k in range(1, int(blocks.max())):
        on = np.flatnonzero(blocks > k)
        c = crc[on]
        crc[on] = shift[0][c & 255] ^ shift[1][c >> 8 & 255] ^ shift[2][c >> 16 & 255] ^ shift[3][c >> 24] ^ states[first[on] + k]
    return crc ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)
