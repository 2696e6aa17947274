"""Words of Arrow batches of whole texts, found and hashed over their bytes with numpy.

A word is a longest run of bytes of a class; A-Z are lower-cased first. Bytes of non-ASCII characters
are all of one kind, so classes that tell only ASCII characters apart cut UTF-8 as they cut characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` once A-Z are lower-cased: digits, letters, everything beyond ASCII.
WORD_BYTES = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes of text that are worked on at once; rows longer than that are worked on alone.
SLICE_BYTES = 1 << 21
#: Words are hashed in runs of this many bytes; longer words by BLAKE2.
RUN_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


_POWER, _INVERSE = _powers(_BASE, RUN_BYTES + 1), _powers(pow(_BASE, -1, 1 << 64), RUN_BYTES + 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of some rows: bytes, and of each word its span in them, its row and its hash."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hashes: np.ndarray

    def text(self, i: int, n: int) -> str:
        """``n`` words from the ``i``-th on, joined by single spaces."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[i : i + n].tolist(), self.ends[i : i + n].tolist())).decode("utf-8")


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + RUN_BYTES, "right"))
        if j <= i:  # one word longer than a run
            out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        low = starts[i]
        run = data[low : ends[j - 1]]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(run * _POWER[: len(run)], dtype=np.uint64)])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mixed((sums[b] - sums[a]) * _INVERSE[a])
        i = j
    return out


def words_of(texts: pa.Array) -> Words:
    """The words of an array of texts; null and empty ones have none."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    data = _LOWER[np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]]] if whole is not None and len(texts) else np.empty(0, np.uint8)
    if not len(data):
        none = np.empty(0, np.int64)
        return Words(data, none, none, none, np.empty(0, np.uint64))
    offsets = offsets - offsets[0]
    inside = WORD_BYTES[data]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]  # words end with their row
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:], before[cuts] = False, inside[:-1], False
    after[-1], after[:-1], after[cuts - 1] = False, inside[1:], False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(offsets[1:], starts, "right"), _hashes(data, starts, ends))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end
