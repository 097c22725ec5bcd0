"""Words of whole batches of texts as hashes, straight from Arrow's buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes that are hashed at once: what that needs stays in a core's own cache.
BLOCK = 1 << 14
_MULTIPLIER = 0x9E3779B97F4A7C15
_POWER = np.cumprod(np.full(BLOCK + 1, _MULTIPLIER, np.uint64))
_INVERSE = np.cumprod(np.full(BLOCK + 1, pow(_MULTIPLIER, -1, 1 << 64), np.uint64))
#: Letters, digits and all of UTF-8's higher bytes make words; A-Z count as a-z.
_IN_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_CODE = np.array([ord(chr(c).lower()) + 1 if c < 128 else c + 1 for c in range(256)], np.uint64)


def hashed_words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and for each text the number of words before it (and the total).

    A null text has no words.
    """
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    bounds = (offsets - offsets[0]).astype(np.int64)
    inside = _IN_WORD[raw]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    fresh[inner] = inside[inner]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    return _hashes(raw, starts, ends), np.searchsorted(starts, bounds)


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        to = np.searchsorted(starts, base + BLOCK // 2)
        part = raw[base : base + BLOCK]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODE[part] * _POWER[: len(part)])))
        first, end = starts[at:to] - base, np.minimum(ends[at:to] - base, len(part))
        out[at:to] = (sums[end] - sums[first]) * _INVERSE[first]
        at = to
    for i in np.flatnonzero(ends - starts > BLOCK // 2):
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].tobytes().lower())
    out ^= (ends - starts).astype(np.uint64) << np.uint64(48)
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))
