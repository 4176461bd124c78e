"""Golomb-Rice codes for sorted lists of 64-bit fingerprints."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QBQ")


def encode(values: np.ndarray) -> bytes:
    """Bytes for strictly ascending uint64 values: the first one, then each gap as a unary quotient and a k-bit rest."""
    n = len(values)
    if n == 0:
        return b""
    gaps = np.diff(values)
    mean = float(gaps.astype(np.float64).mean()) if n > 1 else 1.0
    k = min(63, max(0, int(np.floor(np.log2(max(mean * 0.6931, 1.0))))))
    head = _HEAD.pack(int(values[0]), k, n)
    if n == 1:
        return head
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, dtype=np.uint8)
    unary[ends] = 1
    packed = np.packbits(unary).tobytes()
    rest = (gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
    return head + struct.pack("<Q", len(packed)) + packed + np.packbits(rest.astype(np.uint8).ravel()).tobytes()


def decode(blob: bytes) -> np.ndarray:
    """The values that encode() was given."""
    if not blob:
        return np.empty(0, dtype=np.uint64)
    first, k, n = _HEAD.unpack_from(blob)
    out = np.empty(n, dtype=np.uint64)
    out[0] = first
    if n == 1:
        return out
    (size,) = struct.unpack_from("<Q", blob, _HEAD.size)
    at = _HEAD.size + 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size, at)))[: n - 1]
    gaps = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    if k:
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, -1, at + size))[: (n - 1) * k].reshape(n - 1, k).astype(np.uint64)
        gaps = (gaps << np.uint64(k)) | (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    out[1:] = np.uint64(first) + np.cumsum(gaps, dtype=np.uint64)
    return out
