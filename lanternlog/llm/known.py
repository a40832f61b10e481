"""A table of stretches of text already seen, looked up for whole slices of text at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lanternlog.llm.common import offsets_of, ragged

#: Entries and bytes that a worker keeps before it starts anew, and bytes that are hashed at once.
ENTRIES, BYTES, BLOCK = 1_000_000, 32 << 20, 1 << 20


class Table:
    """Map from uint64 to int32 that answers for arrays: open addressing, -1 for unknown keys."""

    def __init__(self, size: int):
        bits = max(8, int(np.ceil(np.log2(max(size, 1)))) + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> Table:
        """Put in new, different keys."""
        rest, slot = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            free = np.flatnonzero(self.values[slot] < 0)
            self.values[slot[free]] = rest[free]  # the last one stays
            won = np.zeros(len(rest), bool)
            won[free] = self.values[slot[free]] == rest[free]
            self.keys[slot[won]], self.values[slot[won]] = keys[rest[won]], values[rest[won]]
            rest, slot = rest[~won], (slot[~won] + 1) & self.mask
        return self

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.values[slot]
        other = (self.keys[slot] != keys) & (found >= 0)
        found[other] = -1
        open_ = np.flatnonzero(other)
        slot, wanted = slot[open_], keys[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            value, hit = self.values[slot], self.keys[slot] == wanted
            hit &= value >= 0
            found[open_[hit]] = value[hit]
            more = ~hit & (value >= 0)
            open_, slot, wanted = open_[more], slot[more], wanted[more]
        return found


class Growing:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.room, self.size = np.zeros(1 << 12, kind), 0

    def extend(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.room):
            room = np.zeros(max(end, 2 * len(self.room)), self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : end] = values
        self.size = end

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.size]


class Runs:
    """Runs of values, one per entry."""

    def __init__(self, kind: type):
        self.values, self.ends = Growing(kind), Growing(np.int64)
        self.ends.extend(np.zeros(1, np.int64))

    def extend(self, values: np.ndarray, lengths: np.ndarray) -> None:
        self.ends.extend(self.ends.all[-1] + offsets_of(lengths)[1:])
        self.values.extend(values)

    def lengths(self, at: np.ndarray) -> np.ndarray:
        ends = self.ends.all
        return ends[at + 1] - ends[at]

    def take(self, at: np.ndarray) -> np.ndarray:
        """The runs of entries ``at``, one after the other."""
        return self.values.all[ragged(self.ends.all[at], self.lengths(at))]


@lru_cache(1)
def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240131))
    return rng.integers(0, 2**64, 256, np.uint64) | np.uint64(1), rng.integers(0, 2**64, 4096, np.uint64) | np.uint64(1)


class Known:
    """Numbers stretches of bytes; ``learn`` is called with the bytes of new ones, in the order of their numbers.

    Stretches are found by a 64-bit hash and then compared byte by byte.
    """

    def learn(self, parts: list[bytes]) -> None:
        raise NotImplementedError

    def forget(self) -> None:
        """Start anew; subclasses drop what they have learned too."""
        self.table, self.own = Table(ENTRIES), Runs(np.uint8)

    def number(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each stretch ``data[starts[i]:ends[i]]``; none may be empty."""
        if len(self.own.ends.all) > ENTRIES or self.own.values.size > BYTES:
            self.forget()
        lengths = ends - starts
        out = np.empty(len(starts), np.int64)
        part = (np.cumsum(lengths) - lengths) // BLOCK
        cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(starts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                out[a:b] = self._number(data, starts[a:b], lengths[a:b])
        return out

    def _number(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        flat = data[ragged(starts, lengths)]
        begins = offsets_of(lengths)[:-1]
        by_byte, by_place = _mixers()
        place = ragged(np.zeros(len(starts), np.int64), lengths)
        np.bitwise_and(place, 4095, out=place)
        keys = np.add.reduceat(by_byte[flat] * by_place[place], begins) * np.uint64(0xD6E8FEB86659FD93) + lengths.astype(np.uint64)
        keys ^= keys >> np.uint64(32)
        at = self.table[keys].astype(np.int64)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            fresh, first, where = np.unique(keys[unknown], return_index=True, return_inverse=True)
            at[unknown] = self._add(flat, begins, lengths, unknown[first]) + where
            self.table.add(fresh, (at[unknown[first]]).astype(np.int32))
        # Two stretches with one hash: the later ones get numbers of their own.
        same = self.own.lengths(at) == lengths
        checked = np.flatnonzero(same)
        whole = len(checked) == len(at)
        differs = self.own.take(at[checked]) != (flat if whole else flat[ragged(begins[checked], lengths[checked])])
        if not whole or differs.any():
            same[checked] = ~np.logical_or.reduceat(differs, offsets_of(lengths[checked])[:-1]) if len(checked) else False
            odd = np.flatnonzero(~same)
            at[odd] = self._add(flat, begins, lengths, odd) + np.arange(len(odd))
        return at

    def _add(self, flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> int:
        known, sizes = len(self.own.ends.all) - 1, lengths[which]
        values = flat[ragged(begins[which], sizes)]
        self.own.extend(values, sizes)
        raw, bounds = values.tobytes(), offsets_of(sizes).tolist()
        self.learn([raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)])
        return known


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts of a column, and where each begins (and the last ends); null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or bounds[0] == bounds[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


@lru_cache(1)
def _byte_kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    may_be_space = np.zeros(256, bool)
    may_be_space[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True
    white = np.zeros(256, bool)
    white[[9, 10, 13, 32]] = True
    plain = white.copy()
    plain[[*range(33, 127), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = True
    return may_be_space, white, plain


def _whole_texts(data: np.ndarray, bounds: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Which texts hold a special token."""
    out, raw = np.zeros(len(bounds) - 1, bool), data.tobytes()
    for token in special:
        at = raw.find(token)
        while at >= 0:
            i = int(np.searchsorted(bounds, at, side="right")) - 1
            out[i] |= at + len(token) <= bounds[i + 1]
            at = raw.find(token, at + 1)
    return out


def cut_at_spaces(data: np.ndarray, bounds: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches that byte-level vocabularies encode independently: starts, ends, and how many each text has.

    These libraries cut a text before every space that a non-space character follows, whatever stands before it. Bytes that
    may begin a wider space do not count as such a character. Texts that hold a special token stay whole.
    """
    may_be_space, _, _ = _byte_kinds()
    filled = np.diff(bounds) > 0
    mask = np.zeros(len(data), bool)
    if len(data):
        mask[:-1] = (data[:-1] == 32) & ~may_be_space[data[1:]]
        mask[bounds[1:][filled] - 1] = False
        for i in np.flatnonzero(_whole_texts(data, bounds, special)):
            mask[bounds[i] : bounds[i + 1]] = False
        mask[bounds[:-1][filled]] = True
    starts = np.flatnonzero(mask)
    return starts, np.append(starts, len(data))[1:], np.searchsorted(starts, bounds[1:]) - np.searchsorted(starts, bounds[:-1])


def cut_at_white(data: np.ndarray, bounds: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches without white space: starts, ends, and how many each text has.

    Texts with special tokens, or with characters other than those on which all tables of letters and spaces agree, stay whole.
    """
    _, white, plain = _byte_kinds()
    odd = offsets_of(~plain[data])
    whole = np.flatnonzero((odd[bounds[1:]] > odd[bounds[:-1]]) | _whole_texts(data, bounds, special))
    solid = ~white[data]
    for i in whole:
        solid[bounds[i] : bounds[i + 1]] = True
    begin, end = solid.copy(), solid.copy()
    if len(data):
        inner = np.ones(len(data), bool)
        inner[bounds[:-1][bounds[:-1] < len(data)]] = False  # the first byte of each text
        begin[1:] &= ~(solid[:-1] & inner[1:])
        end[:-1] &= ~(solid[1:] & inner[1:])
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, bounds[1:]) - np.searchsorted(starts, bounds[:-1])
