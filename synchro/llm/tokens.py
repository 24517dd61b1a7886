"""Token ids of texts by the tokenizers library, with each distinct piece encoded once.

Both tokenizers cut a text by a pattern and encode every cut by itself.  In a text of plain Latin
letters the ends of runs of letters and digits, of other marks and of white space are always cuts,
so a text's ids are its pieces' ids one after the other, and pieces repeat.  Pieces are found and
looked up by a 64-bit hash with numpy, for a chunk of texts at once; new ones go to the library.  What is found is
compared by length and bytes (those of over 16 bytes all, others by a second, independent mark), so equal hashes of unequal
pieces do no harm: such a text goes to the library whole.

Any other text goes to the library whole: with characters beyond U+024F (marks, other scripts, wide
spaces), in U+0080-U+00BF, U+00D7, U+00F7 or U+0130, controls \\x1c-\\x1f, apostrophes (contractions)
or a special token's opening `<|`.
"""

from __future__ import annotations

import numpy as np

from . import common as C
from .suffixes import words_at

#: Pieces that a worker remembers (under half of 2**SLOT_BITS); those of a full memory are looked up anew.
REMEMBERED, SLOT_BITS = 1_800_000, 22

_U64 = np.uint64
#: 0 white space, 1 letters and digits, 2 other marks; bytes that send a text to the library.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[0x80:] = 1
_ODD = np.zeros(256, bool)
_ODD[0x1C:0x20] = _ODD[39] = _ODD[0xC2] = True
_ODD[0xCA:] = True


def odd_rows(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows whose texts the library encodes whole."""
    odd = _ODD[data]
    if len(data) > 1:
        for a, b in ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0), (60, 124)):
            odd[:-1] |= (data[:-1] == a) & (data[1:] == b)
    total = np.concatenate(([0], np.cumsum(odd)))
    return total[at[1:]] > total[at[:-1]]


def pieces(data: np.ndarray, at: np.ndarray, keeps_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of all rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[data]
    begin = np.zeros(n + 1, bool)
    begin[at] = True
    edge = begin.copy()
    begin[1:n] |= kind[1:] != kind[:-1]
    if not keeps_space:
        s = np.flatnonzero(begin[:n])
        e = np.concatenate((s[1:], [n]))
        keep = kind[s] > 0
        return s[keep], e[keep]
    # the last of white space before a piece: a blank joins the piece, any other stands alone
    b = np.flatnonzero(begin[1:n] & ~edge[1:n]) + 1
    b = b[(kind[b] > 0) & (kind[b - 1] == 0)]
    begin[b - 1] = True
    begin[b[data[b - 1] == 32]] = False
    s = np.flatnonzero(begin[:n])
    return s, np.concatenate((s[1:], [n]))


class Memory:
    """Open-addressing table from piece hashes to ids, in arrays: a slot has 32 bits of the hash, and a piece's other mark tells whether it is the one."""

    def __init__(self):
        self.slots, self.values = np.zeros(1 << SLOT_BITS, np.uint32), np.zeros(1 << SLOT_BITS, np.int32)
        self.first, self.ids, self.n, self.used = np.zeros(1024, np.int64), np.zeros(4096, np.uint16), 0, 0
        # what the pieces look like, and those of over 16 bytes by place
        self.looks, self.long = np.zeros(1024, _U64), {}

    def _make_room(self, n: int, *names: str) -> None:
        """Lengthen arrays to n or more in place, by a quarter at least; nothing outside holds them."""
        for name in names:
            old = getattr(self, name)
            if n > len(old):
                old.resize(max(n, len(old) * 5 // 4), refcheck=False)

    @staticmethod
    def _start(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of each hash that its slot holds (never 0), and where to look for it first."""
        return (h & _U64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1), (h >> _U64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 if unknown."""
        out = np.full(len(h), -1, np.int64)
        tag, slot = self._start(h)
        left = np.arange(len(h))
        while len(left):
            there = self.slots[slot]
            hit = there == tag[left]
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << SLOT_BITS) - 1)
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, sizes: np.ndarray, looks: np.ndarray, raw: list[bytes]) -> None:
        """New distinct hashes and their ids, one after the other, and what the pieces look like."""
        self._make_room(self.n + len(h) + 1, "first", "looks")
        self.looks[self.n : self.n + len(h)] = looks
        self.long.update((self.n + i, x) for i, x in enumerate(raw) if len(x) > 16)
        if len(ids) and ids.max() > np.iinfo(self.ids.dtype).max:  # ids take two bytes as long as all of them fit
            self.ids = self.ids.astype(np.uint32)
        self._make_room(self.used + len(ids), "ids")
        self.ids[self.used : self.used + len(ids)] = ids
        self.first[self.n + 1 : self.n + 1 + len(h)] = self.used + np.cumsum(sizes)
        value = np.arange(self.n, self.n + len(h), dtype=np.int32)
        tag, slot = self._start(h)
        left = np.arange(len(h))
        while len(left):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = tag[left[free]]
            won = free & (self.slots[slot] == tag[left])
            self.values[slot[won]] = value[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & ((1 << SLOT_BITS) - 1)
        self.n, self.used = self.n + len(h), self.used + len(ids)

    def unlike(self, places: np.ndarray, looks: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Whether the piece at each place is another one than was looked up."""
        bad = self.looks[places] != looks
        for i in np.flatnonzero((e - s > 16) & ~bad):
            bad[i] = self.long.get(int(places[i])) != data[s[i] : e[i]].tobytes()
        return bad

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the places one after the other, and how many each has."""
        ids, sizes = ragged(self.ids, self.first[places], self.first[places + 1] - self.first[places])
        return ids.astype(np.uint32), sizes


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], _U64)


def appearance(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64 bits of each range's length, first and last eight bytes, apart from its hash: one to one for up to eight bytes of one length."""
    word, size = words_at(data), e - s
    if not len(s):
        return np.zeros(0, _U64)
    mask = _MASKS[np.minimum(size, 8)]
    first, last = word[s] & mask, np.where(size > 8, word[np.maximum(e - 8, s)] & mask, 0)
    return C.mix(C.mix(first + size.astype(_U64) * _U64(0x9FB21C651E98DF25)) + last * _U64(0xD6E8FEB86659FD93))


def ragged(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[first:first + size] of all rows one after the other."""
    at = np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    return values[at], sizes


class Encoder:
    """Ids of texts; one for each worker and file."""

    _known: dict[tuple, Encoder] = {}

    def __init__(self, path: str, keeps_space: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.keeps_space, self.memory = Tokenizer.from_file(path), keeps_space, Memory()
        # stands between pieces that are encoded together: its id is no piece's
        self.between = "\n" if keeps_space else " — "
        self.mark = np.array(self.whole(self.between), np.uint32)

    @classmethod
    def of(cls, path: str, keeps_space: bool) -> Encoder:
        key = (path, keeps_space)
        if key not in cls._known:
            cls._known[key] = cls(path, keeps_space)
        return cls._known[key]

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learned(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after the other, and how many each has."""
        ids, sizes = [], []
        for k in range(0, len(raw), 8192):
            part = raw[k : k + 8192]
            if any(p.isspace() for p in part) or len(self.mark) > 1:
                got = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in part], add_special_tokens=False)]
                ids += got
                sizes += [len(x) for x in got]
                continue
            all_ids = np.array(self.whole(self.between.join(p.decode() for p in part)), np.uint32)
            marks = np.flatnonzero(all_ids == self.mark[0])
            ids.append(np.delete(all_ids, marks))
            sizes += np.diff(np.concatenate(([-1], marks, [len(all_ids)]))) .tolist()
            sizes[-len(part) :] = [x - 1 for x in sizes[-len(part) :]]
        flat = np.concatenate([np.asarray(x, np.uint32) for x in ids]) if ids else np.zeros(0, np.uint32)
        return flat, np.array(sizes, np.int64)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and each row's first."""
        odd = odd_rows(data, at)
        s, e = pieces(data, at, self.keeps_space)
        row = np.searchsorted(at, s, "right") - 1
        ok = ~odd[row]
        s, e, row = s[ok], e[ok], row[ok]
        h = C.span_hashes(data, s, e)
        h[h == 0] = 1
        looks = appearance(data, s, e)
        memory = self.memory
        place = memory.find(h)
        new = np.flatnonzero(place < 0)
        if len(new):
            if memory.n + len(new) > REMEMBERED:
                self.memory = memory = Memory()
                place[:] = -1
                new = np.arange(len(h))
            fresh, example, back = np.unique(h[new], return_index=True, return_inverse=True)
            raw = data.tobytes()
            spans = [raw[a:b] for a, b in zip(s[new[example]].tolist(), e[new[example]].tolist(), strict=True)]
            blank = np.array([p.isspace() for p in spans])
            for part in (np.flatnonzero(blank), np.flatnonzero(~blank)):
                ids, sizes = self._learned([spans[k] for k in part])
                memory.add(fresh[part], ids, sizes, looks[new[example[part]]], [spans[k] for k in part])
            place[new] = memory.find(fresh)[back]
        bad = memory.unlike(place, looks, data, s, e)
        if bad.any():
            odd = odd.copy()
            odd[row[bad]] = True
        ids, sizes = memory.gather(place)
        count = np.bincount(row, weights=sizes, minlength=len(at) - 1).astype(np.int64)
        if odd.any():
            own = np.split(ids, np.cumsum(count)[:-1])
            for r in np.flatnonzero(odd):
                own[r] = np.array(self.whole(data[at[r] : at[r + 1]].tobytes().decode()), np.uint32)
                count[r] = len(own[r])
            ids = np.concatenate(own)
        return ids, np.concatenate(([0], np.cumsum(count)))
