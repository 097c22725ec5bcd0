"""Token ids of whole texts by a public tokenizer, each distinct piece encoded once in a worker."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial
from itertools import chain

import numpy as np

from ledgerwise.llm.common import worker_memory

TOKENIZER = "word_bpe_49k.json"
#: Distinct pieces that a worker remembers; beyond it the memory is emptied and filled anew.
REMEMBERED = 800_000
#: Bytes of text that are cut into pieces at once.
BLOCK = 1 << 19

#: Characters for which lower case and composition are the same in Python and in the tokenizer, all others of the Latin
#: blocks being letters.  Texts with others, with special tokens or with contractions are encoded as a whole.
_UNUSUAL = re.compile(r"[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-įĲ-ňŊ-ž]|<\||'[dlmrstvDLMRSTV]")
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[97:123] = _LETTER
_KIND[128:] = _LETTER
_CODE = np.arange(1, 257, dtype=np.uint64)
SHORT = 7
_LONG = np.uint64(255 << 56)
_LOW = [np.uint64((1 << 8 * n) - 1) for n in range(SHORT + 1)]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


class Encoder:
    """``ids`` of a text are those of ``Tokenizer.encode(text, add_special_tokens=False)``.

    Made for a byte-level tokenizer that lower-cases, drops white space and cuts a text into runs of letters, single
    digits and runs of other signs (``word_bpe_49k.json``).  Each distinct piece is given to the tokenizer once.  Pieces of up
    to ``SHORT`` bytes are known by these bytes; longer ones are looked up by a hash and then compared byte by byte with the one
    that is remembered, so two pieces with one hash cannot take each other's ids: their block goes to the tokenizer.

    What is remembered lies in arrays, some 80 bytes a piece: the keys in order, and by a piece's number where its ids and, of a
    long one, its bytes end.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.power = np.cumprod(np.full(BLOCK + 2, 0x9E3779B97F4A7C15 | 1, np.uint64))
        inverse = pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
        self.inverse = np.cumprod(np.full(BLOCK + 2, inverse, np.uint64))
        self._forget()

    def _forget(self) -> None:
        self.keys, self.numbers = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ids, self.id_ends = Growing("<u4"), Growing(np.int64, [0])
        self.bytes, self.byte_ends = Growing(np.uint8), Growing(np.int64, [0])

    def encode(self, texts: list) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null: none."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting, size = [], 0
        for row, text in enumerate(texts):
            if not text:
                continue
            plain = text.isascii() and not ("'" in text or "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"))
            parts = _parts(text.lower().encode()) if plain or not _UNUSUAL.search(text) else None
            if parts is None:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out[row].append(np.array(ids, "<u4").tobytes())
                continue
            for part in parts:
                if size + len(part) + 1 > BLOCK:
                    self._block(waiting, out)
                    waiting, size = [], 0
                waiting.append((row, part))
                size += len(part) + 1
        self._block(waiting, out)
        return [b"".join(x) for x in out]

    def _block(self, waiting: list[tuple[int, bytes]], out: list[list[bytes]]) -> None:
        if not waiting:
            return
        joined = b"\n".join(part for _, part in waiting) + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        kind = _KIND[raw]
        fresh = np.empty(len(raw), bool)
        fresh[0] = True
        fresh[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        edges = np.flatnonzero(fresh)
        ends = np.append(edges[1:], len(raw))
        real = kind[edges] != _SPACE
        starts, ends = edges[real], ends[real]
        if not len(starts):
            return
        keys = self._keys(raw, starts, ends)
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > REMEMBERED:
            self._forget()
        places = np.searchsorted(self.keys, distinct)
        known = np.append(self.keys, np.uint64(0))[places] == distinct  # no key is zero
        numbers = np.append(self.numbers, 0)[places]
        if not self._same_bytes(raw, starts, ends, distinct, first, which, known, numbers):
            for row, part in waiting:
                ids = self.tokenizer.encode(part.decode(), add_special_tokens=False).ids
                out[row].append(np.array(ids, "<u4").tobytes())
            return
        if not known.all():
            new = ~known
            bounds = zip(starts[first[new]].tolist(), ends[first[new]].tolist())
            numbers[new] = self._learn([joined[a:b] for a, b in bounds], distinct[new] >= _LONG)
            self.keys = np.insert(self.keys, places[new], distinct[new])
            self.numbers = np.insert(self.numbers, places[new], numbers[new])
        numbers = numbers[which]
        first_ids, last_ids = (self.id_ends.held[numbers + i] for i in (0, 1))
        before = np.concatenate(([0], np.cumsum(last_ids - first_ids)))
        ids = self.ids.held[_ranges(first_ids, last_ids)].tobytes()
        limits = np.cumsum([len(part) + 1 for _, part in waiting])
        cuts = 4 * before[np.searchsorted(starts, limits)]
        for (row, _), a, b in zip(waiting, [0, *cuts[:-1].tolist()], cuts.tolist()):
            out[row].append(ids[a:b])

    def _keys(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The bytes of short pieces with their number in the highest byte; of long ones a hash, that byte being 255."""
        lengths = ends - starts
        padded = np.concatenate((raw, np.zeros(8, np.uint8)))
        words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[starts]).view("<u8")[:, 0]
        short = np.minimum(lengths, SHORT)
        keys = (words & np.array(_LOW)[short]) | (short.astype(np.uint64) << np.uint64(56))
        long = np.flatnonzero(lengths > SHORT)
        if len(long):
            sums = np.concatenate(([np.uint64(0)], np.cumsum(_CODE[raw] * self.power[: len(raw)])))
            hashes = (sums[ends[long]] - sums[starts[long]]) * self.inverse[starts[long]]
            hashes ^= (hashes >> np.uint64(29)) ^ (lengths[long].astype(np.uint64) << np.uint64(40))
            keys[long] = hashes | _LONG
        return keys

    def _same_bytes(self, raw, starts, ends, distinct, first, which, known, numbers) -> bool:
        """Do all long pieces of a key have the bytes of the first one here, and of the one that is remembered?"""
        of_long = np.flatnonzero(distinct >= _LONG)
        if not len(of_long):
            return True
        long = np.flatnonzero(which >= of_long[0])  # sorted: the long ones come last
        model = first[which[long]]
        if not np.array_equal(ends[long] - starts[long], ends[model] - starts[model]):
            return False
        again = model != long
        here, there = (_ranges(starts[x[again]], ends[x[again]]) for x in (long, model))
        if not np.array_equal(raw[here], raw[there]):
            return False
        held = of_long[known[of_long]]
        once, begin, end = first[held], *(self.byte_ends.held[numbers[held] + i] for i in (0, 1))
        if not np.array_equal(ends[once] - starts[once], end - begin):
            return False
        return np.array_equal(raw[_ranges(starts[once], ends[once])], self.bytes.held[_ranges(begin, end)])

    def _learn(self, pieces: list[bytes], long: np.ndarray) -> np.ndarray:
        """Numbers of pieces that were not known; the bytes of ``long`` ones are kept."""
        tokenize, letter = self.tokenizer.model.tokenize, self.letters.__getitem__
        spelled = [p.decode() if p.isalpha() else "".join(map(letter, p)) for p in pieces]
        ids = [[t.id for t in tokenize(s)] for s in spelled]
        kept = [p if keep else b"" for p, keep in zip(pieces, long.tolist())]
        first = self.id_ends.size - 1
        self.id_ends.add(self.ids.size + np.cumsum([len(x) for x in ids]))
        self.ids.add(np.fromiter(chain.from_iterable(ids), "<u4"))
        self.byte_ends.add(self.bytes.size + np.cumsum([len(p) for p in kept]))
        self.bytes.add(np.frombuffer(b"".join(kept), np.uint8))
        return np.arange(first, first + len(pieces))


class Growing:
    """An array that is added to; ``held`` has room for more than the ``size`` it holds."""

    def __init__(self, kind, values=()):
        self.held, self.size = np.array(values, kind), len(values)

    def add(self, values: np.ndarray) -> None:
        size = self.size + len(values)
        if size > len(self.held):
            self.held = np.concatenate((self.held[: self.size], np.zeros(size + size // 4 - self.size, self.held.dtype)))
        self.held[self.size : size] = values
        self.size = size


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places from each start up to its end, one range after the other."""
    lengths = ends - starts
    before = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(starts - before, lengths)


def _parts(raw: bytes) -> list[bytes] | None:
    """A text in parts of less than ``BLOCK`` bytes, cut at blanks; None if a word is longer than that."""
    parts, at = [], 0
    while len(raw) - at >= BLOCK:
        cut = max(raw.rfind(b" ", at, at + BLOCK - 1), raw.rfind(b"\n", at, at + BLOCK - 1))
        if cut <= at:
            return None
        parts.append(raw[at:cut])
        at = cut
    return [*parts, raw[at:]]


def encoder(path: str | None = None) -> Callable[[], Encoder]:
    """What gives the encoder inside a task; tasks of one worker share it and what it remembers."""
    path = path or tokenizer_path()
    return lambda: worker_memory(f"encoder {path}", partial(Encoder, path))
