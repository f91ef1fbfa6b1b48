"""Numpy arrays as compressed values, for tasks that send each other sorted keys."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value. Bytes of one significance stand together; int64 and uint64 arrays are stored as steps."""
    squeeze = zstandard.ZstdCompressor(level=1)
    out = []
    for x in arrays:
        step = np.diff(x, prepend=x.dtype.type(0)) if x.dtype in (np.uint64, np.int64) else x
        planes = np.ascontiguousarray(step.view(np.uint8).reshape(len(x), x.dtype.itemsize).T)
        body = squeeze.compress(planes.tobytes())
        out += [x.dtype.str.encode().ljust(4), len(x).to_bytes(8, "little"), len(body).to_bytes(8, "little"), body]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    at, out = 0, []
    while at < len(data):
        kind = np.dtype(data[at : at + 4].decode().strip())
        n, size = (int.from_bytes(data[at + k : at + k + 8], "little") for k in (4, 12))
        body = data[at + 20 : at + 20 + size]
        raw = zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, n * kind.itemsize)) if n else b""
        x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n)
        out.append(np.cumsum(x, dtype=kind) if kind in (np.uint64, np.int64) else x)
        at += 20 + size
    return out


def ranges(sorted_keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each of ``shards`` equal ranges of 64-bit keys begins in sorted keys (one more entry: the end)."""
    home = ((sorted_keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    return np.searchsorted(home, np.arange(shards + 1))
