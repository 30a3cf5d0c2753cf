"""SHA-256 of many messages at once, as states that can be kept, sent and resumed.

A message is a run of digests as hex text. Such a text has 64 bytes, just one block of SHA-256, so the state before each
digest of a run is eight 32-bit words, and a row can keep it.
"""

from __future__ import annotations

import numpy as np

U32 = np.uint32


def _root_bits(n: int, power: int) -> int:
    """The first 32 bits of the fraction of n ** (1 / power), exactly."""
    low, high, scaled = 0, 1 << 40, n << 32 * power
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if middle**power <= scaled else (low, middle)
    return low & 0xFFFFFFFF


_PRIMES = [n for n in range(2, 312) if all(n % d for d in range(2, int(n**0.5) + 1))]
#: the standard's start, from square roots, and its round constants, from cube roots of primes
START = np.array([_root_bits(p, 2) for p in _PRIMES[:8]], U32)
ROUNDS = [U32(_root_bits(p, 3)) for p in _PRIMES[:64]]
_HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint8).reshape(256, 2)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> U32(n)) | (x << U32(32 - n))


def compress(states: np.ndarray, words: np.ndarray) -> np.ndarray:
    """States (n, 8) after one more block each (n, 16)."""
    w = list(np.ascontiguousarray(words.T))
    a, b, c, d, e, f, g, h = np.ascontiguousarray(states.T)
    for i, constant in enumerate(ROUNDS):
        if i > 15:
            x, y = w[i - 15], w[i - 2]
            w.append(w[i - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> U32(3))) + w[i - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> U32(10))))
        new = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + w[i] + constant
        h, g, f, e = g, f, e, d + new
        d, c, b, a = c, b, a, new + (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
    return states + np.stack([a, b, c, d, e, f, g, h], 1)


def fresh(n: int) -> np.ndarray:
    return np.repeat(START[None], n, 0)


def hex_words(digests: np.ndarray) -> np.ndarray:
    """The blocks (n, 16) that digests (n, 32 bytes) are as hex text."""
    return _HEX[digests].reshape(len(digests), 64).view(">u4").astype(U32)


def finish(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 32 bytes) of messages that end here, after so many blocks each."""
    last = np.zeros((len(states), 16), U32)
    bits = np.asarray(blocks).astype(np.uint64) * np.uint64(512)
    last[:, 0], last[:, 14], last[:, 15] = 0x80000000, bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return compress(states, last).astype(">u4").view(np.uint8).reshape(len(states), 32)


def as_bytes(states: np.ndarray) -> bytes:
    return states.astype(">u4").tobytes()


def as_states(kept: bytes) -> np.ndarray:
    return np.frombuffer(kept, ">u4").astype(U32).reshape(-1, 8)
