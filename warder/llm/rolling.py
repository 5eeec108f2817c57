"""Rolling hashes of k-grams and sliding minima, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FINISH = np.uint64(0xD6E8FEB86659FD93)
#: A hash keeps its top bits; the low ones hold a position while minima are taken.
LOW_BITS = 24
LOW = np.uint64((1 << LOW_BITS) - 1)
SEGMENT = 1 << (LOW_BITS - 1)


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * FINISH
    return h ^ (h >> np.uint64(29))


def gram_hashes(codes: np.ndarray, k: int, multiplier: np.uint64 = MULTIPLIER) -> np.ndarray:
    """64-bit hash of every run of k codes, by doubling: polynomial in the multiplier mod 2**64.
    Runs of bytes begin with whole words of eight."""
    n = len(codes)
    if n < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if codes.dtype == np.uint8 and k % 8 == 0:
            words, data = np.empty(n - 7, np.uint64), np.ascontiguousarray(codes)
            for i in range(min(8, n - 7)):
                words[i::8] = np.frombuffer(data, "<u8", (n - i) // 8, i)
            power, size, block = multiplier, 8, finish(words)
        else:
            power, size, block = multiplier, 1, finish(codes.astype(np.uint64) + np.uint64(1))
        done, total = 0, np.zeros(n - k + 1, np.uint64)
        while True:
            if k & size:  # append this block to what is hashed so far
                total = total * power + block[done : done + n - k + 1]
                done += size
            if done == k:
                return finish(total)
            block = block[:-size] * power + block[size:]
            power, size = power * power, size * 2


def window_minima(hashes: np.ndarray, w: int) -> np.ndarray:
    """Position of the least hash (by its top 40 bits, rightmost among equals) of each window
    of w; one window of all if there are fewer."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    w = min(w, n)
    out = []
    for start in range(0, n - w + 1, SEGMENT):
        part = hashes[start : start + SEGMENT + w - 1]
        low = (part & ~LOW) | (LOW - np.arange(len(part), dtype=np.uint64))
        size = 1
        while size * 2 <= w:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < w:
            low = np.minimum(low[: len(low) - (w - size)], low[w - size :])
        out.append((LOW - (low & LOW)).astype(np.int64) + start)
    return np.concatenate(out)


#: Bytes that are hashed at a time; a longer word is hashed on its own.
WORD_BYTES = 1 << 16
STEP = 0x9E6C_63D0_876A_68EB
LETTERS = finish(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E37_79B9_7F4A_7C15))
#: Powers of STEP and of its inverse, modulo 2**64.
POWERS, BACK = (np.cumprod(np.append(np.uint64(1), np.full(WORD_BYTES, x, np.uint64)), dtype=np.uint64) for x in (STEP, pow(STEP, -1, 2**64)))


def word_hashes(body: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, which single spaces separate.

    A word's letters are summed with growing powers: sums over all of the text, from which
    those before the word are taken away."""
    out, at = [], 0
    while at < len(body):
        end = len(body) if len(body) - at <= WORD_BYTES else body.rfind(b" ", at, at + WORD_BYTES + 1)
        if end >= 0:
            letters = np.frombuffer(body, np.uint8, end - at, at)
            total = np.zeros(len(letters) + 1, np.uint64)
            np.cumsum(LETTERS[letters] * POWERS[: len(letters)], out=total[1:])
            ends = np.append(np.flatnonzero(letters == 32), len(letters))
            starts = np.append(0, ends[:-1] + 1)
            out.append(finish((total[ends] - total[starts]) * BACK[starts]))
        else:
            end = body.find(b" ", at)
            end = end if end >= 0 else len(body)
            out.append(np.array([xxhash.xxh3_64_intdigest(body[at:end])], np.uint64))
        at = end + 1
    return out[0] if len(out) == 1 else np.concatenate([*out, np.zeros(0, np.uint64)])
