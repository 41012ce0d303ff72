"""Fingerprints of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

BLOCK = 1 << 15


def shingle_hashes(text: str | None, width: int, seed: int):
    """XXH64 of each run of ``width`` words, A-Z lower-cased, space-joined; in blocks of at most ``BLOCK``.

    A text with fewer words gives the hash of its whole sequence, one without words none. Words are what
    bytes.split() finds: runs without the bytes 0x20 and 0x09-0x0D.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        yield np.array([digest(joined, seed)], np.uint64)
        return
    last = ends[width - 1 :]
    for at in range(0, len(last), BLOCK):
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], last[at : at + BLOCK])], np.uint64)


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64 bits, each set if set in over half of the shingles' hashes, repeats counted. No words: 0."""
    total, ones = 0, np.zeros(64, np.int64)
    for block in shingle_hashes(text, width, seed):
        total += len(block)
        ones += np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * ones > total).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")
