"""Text columns of Arrow batches as numpy code points, without a call per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string column and the offsets (rows + 1) at which its rows begin. Nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    buffers = column.buffers()
    n = len(column)
    starts = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    first, last = int(starts[0]), int(starts[-1])
    raw = np.frombuffer(buffers[2], np.uint8, last - first, first) if buffers[2] is not None and last > first else np.empty(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    return points, lead[starts - first]


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 21):
    """Slices of ``batch`` whose ``column`` has at most ``most`` bytes each, or one row, so that memory stays bounded."""
    texts = batch.column(column)
    ends = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64)) if len(texts) else np.empty(0, np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def strings(points: np.ndarray, offsets: np.ndarray, nulls: np.ndarray | None = None) -> pa.Array:
    """The inverse of ``code_points``."""
    raw = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
    width = np.zeros(len(points) + 1, np.int64)
    np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=width[1:])
    starts = width[offsets]
    validity = None
    if nulls is not None and nulls.any():
        validity = pa.py_buffer(np.packbits(~nulls, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [validity, pa.py_buffer(starts.tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.string())


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def row_of(offsets: np.ndarray) -> np.ndarray:
    """For each code point the row that it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


class Rolling:
    """Hashes of all windows of ``width`` code points, by prefix sums of a polynomial modulo 2^64."""

    def __init__(self, width: int, base: int = 0x9E3779B97F4A7C15 | 1, seed: int = 1):
        self.width, self.base, self.seed = width, base, seed
        self.down = np.ones(1, np.uint64)
        self.up = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) >= n:
            return
        n = max(n, 2 * len(self.up))
        inverse = pow(self.base, -1, 1 << 64)
        self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.base, np.uint64)])
        self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, inverse, np.uint64)])

    def __call__(self, points: np.ndarray) -> np.ndarray:
        """Entry i is the hash of points[i : i + width]; empty if there are fewer points."""
        n = len(points)
        if n < self.width:
            return np.empty(0, np.uint64)
        self._powers(n + 1)
        value = mix(points.astype(np.uint64) + np.uint64(self.seed * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(value * self.down[:n], out=prefix[1:])
        k = n - self.width + 1
        return mix((prefix[self.width :] - prefix[:k]) * self.up[:k])
