"""Token ids of many texts at once, with a bounded cache of the ids of short runs.

Texts are cut where the tokenizers themselves never join: before a space between two characters that are no white
space and, in pieces of Latin letters, digits and ASCII signs, between runs of each kind. Cutting, hashing, looking up
and putting ids together are array operations over a whole batch; only runs not met before go to the tokenizer.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .near_dedup import _mix

PIECE_CHARS, LONGEST, TOGETHER, MOST_RUNS = 1 << 20, 64, 4096, 1 << 19
_SEP, _SPACE, _LINE, _LETTER, _DIGIT, _SIGN, _ODD, _BLANK = range(8)  # _ODD: a piece with it is not cut; _BLANK: odd white space
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _SIGN
_KIND[ord("'")] = _ODD
_KIND[[*range(65, 91), *range(97, 123), 0xC3, 0xC5, *range(0x80, 0xC0)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[9, 11, 12, 13]] = _BLANK
_KIND[32], _KIND[10] = _SPACE, _LINE
_IS_WHITE = np.isin(np.arange(8), (_SEP, _SPACE, _LINE, _BLANK))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.random.default_rng(6151).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿŒœ]+").fullmatch
_powers: list[np.ndarray] = []
_encoders: dict[tuple, "Encoder"] = {}


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.full(max(n, 2 * PIECE_CHARS), r, np.uint64) for r in (_BASE, pow(_BASE, -1, 1 << 64))]
        for p in _powers:
            p[0] = 1
            np.cumprod(p, out=p)
    return _powers


class Runs:
    """64-bit hashes of runs and their ids: open addressing in arrays. When full, the half longest unused goes.

    With a million runs two share a hash with a probability of 3e-8.
    """

    def __init__(self, most: int):
        self.most, self.bits = most, max(4, (2 * most - 1).bit_length())
        self.keys, self.slots = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.n, self.used, self.now = 0, 0, 0
        self.at, self.lens, self.hashes, self.seen = np.zeros(most, np.int64), np.zeros(most, np.int32), np.zeros(most, np.uint64), np.zeros(most, np.int32)
        self.pool = np.zeros(4 * most, np.uint32)

    def _first(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of every hash, or -1."""
        out, todo, place = np.full(len(h), -1, np.int64), None, self._first(h)
        want = h
        while len(place):
            k = self.keys[place]
            hit, go = k == want, k != 0
            at = np.flatnonzero(hit)
            out[at if todo is None else todo[at]] = self.slots[place[at]]
            go &= ~hit
            at = np.flatnonzero(go)
            todo = at if todo is None else todo[at]
            want, place = want[at], (place[at] + 1) & (len(self.keys) - 1)
        return out

    def _place(self, h: np.ndarray, entry: np.ndarray) -> None:
        place = self._first(h)
        while len(h):
            free = self.keys[place] == 0
            self.keys[place[free]] = h[free]  # where several want a place the last has it
            own = free & (self.keys[place] == h)
            self.slots[place[own]] = entry[own]
            h, entry, place = h[~own], entry[~own], (place[~own] + 1) & (len(self.keys) - 1)

    def add(self, h: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        """Distinct hashes that find() did not find, with their ids one after the other."""
        if len(h) > self.most:
            raise ValueError("more runs than the table holds")
        if self.n + len(h) > self.most:
            self._shrink(self.most - max(len(h), self.most // 2))
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(self.used + len(ids), np.uint32)))
        z = slice(self.n, self.n + len(h))
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[z], self.lens[z], self.hashes[z], self.seen[z] = self.used + np.cumsum(lens) - lens, lens, h, self.now
        self._place(h, np.arange(z.start, z.stop, dtype=np.int32))
        self.n, self.used = z.stop, self.used + len(ids)

    def _shrink(self, keep: int) -> None:
        rows = np.sort(np.argsort(self.seen[: self.n], kind="stable")[self.n - min(keep, self.n) :])
        ids, h, lens, seen = self.ids(rows), self.hashes[rows], self.lens[rows], self.seen[rows]
        self.keys[:] = 0
        self.n = self.used = 0
        if len(rows):
            self.add(h, ids, lens)
            self.seen[: self.n] = seen

    def ids(self, entries: np.ndarray) -> np.ndarray:
        """The ids of entries one after the other."""
        lens = self.lens[entries].astype(np.int64)
        ends = np.cumsum(lens)
        return self.pool[np.repeat(self.at[entries] - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Encoder:
    """A tokenizers file with a cache of runs. Control strings inside a text are ordinary text.

    byte_level: a space belongs to the run that follows it; else texts are lower-cased and white space is dropped.
    """

    def __init__(self, path: str, byte_level: bool, most: int = MOST_RUNS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.byte_level = byte_level
        self.part = "\n" if byte_level else " 7 "
        (self.part_id,) = self.tok.encode(self.part, add_special_tokens=False).ids
        self.runs = Runs(most)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _letter_ids(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of runs of letters, many encoded together between tokens of their own."""
        ids, lens = [], []
        for a in range(0, len(runs), TOGETHER):
            got = np.array(self.tok.encode_batch_fast([self.part.join(runs[a : a + TOGETHER])], add_special_tokens=False)[0].ids, np.uint32)
            cut = got == self.part_id
            ends = np.append(np.flatnonzero(cut), len(got))
            lens.append(np.diff(ends, prepend=-1) - 1)
            ids.append(got[~cut])
        lens = np.concatenate(lens)
        if len(lens) != len(runs):
            raise ValueError("the vocabulary joins runs of letters over what parts them")
        return np.concatenate(ids), lens

    def _ids(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids one after the other, and how many each run has."""
        letters = np.array([bool(_LETTERS(x)) for x in runs], bool)
        lens = np.zeros(len(runs), np.int64)
        parts = []
        if letters.any():
            got, lens[letters] = self._letter_ids([x for x, y in zip(runs, letters, strict=True) if y])
            parts.append(got)
        if not letters.all():
            rest = self._plain([x for x, y in zip(runs, letters, strict=True) if not y])
            lens[~letters] = [len(x) for x in rest]
            parts.append(np.array([i for x in rest for i in x], np.uint32))
        if len(parts) == 1:
            return parts[0], lens
        ids, own = np.zeros(int(lens.sum()), np.uint32), np.repeat(letters, lens)
        ids[own], ids[~own] = parts
        return ids, lens

    def _cut(self, data: np.ndarray, seps: np.ndarray):
        """(begin, end, whether its piece is odd) of all runs between separators."""
        kind = _KIND[data]
        kind[seps] = _SEP
        white = _IS_WHITE[kind]
        odd = kind >= _ODD
        odd[:-1] |= white[:-1] & white[1:] & (kind[:-1] != _SEP) & (kind[1:] != _SEP)
        lead = np.flatnonzero(data >= 0xC0)
        after = data[np.minimum(lead + 1, len(data) - 1)]
        odd[lead] |= ~((data[lead] == 0xC3) & (after != 0x97) & (after != 0xB7) | (data[lead] == 0xC5) & ((after == 0x92) | (after == 0x93)))
        start = kind != np.concatenate(([_SEP], kind[:-1]))
        start &= np.concatenate(([_SEP], kind[:-1])) != _SPACE
        start |= (kind == _SPACE) | (kind == _LINE) | (kind == _SEP)
        start[0] = True
        after_sep = seps[seps + 1 < len(data)] + 1
        start[after_sep] = True
        if odd.any():
            piece = np.zeros(len(data), bool)
            piece[1:-1] = (kind[1:-1] == _SPACE) & ~white[:-2] & ~white[2:]
            piece[seps] = piece[after_sep] = piece[0] = True
            number = np.cumsum(piece) - 1
            whole = np.zeros(int(number[-1]) + 1, bool)
            whole[number[odd]] = True
            whole = whole[number]
            start = np.where(whole, piece, start)
            begin = np.flatnonzero(start)
            odd_run = whole[begin]
        else:
            begin = np.flatnonzero(start)
            odd_run = np.zeros(len(begin), bool)
        end = np.append(begin[1:], len(data))
        keep = kind[begin] != _SEP
        return begin[keep], end[keep], odd_run[keep]

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, and how many each has."""
        raw = [c.encode("utf-8", "surrogatepass") for c in chunks]
        joined = b"\n".join([*raw, b""])
        seps = np.cumsum([len(x) + 1 for x in raw]) - 1
        data = np.frombuffer(joined, np.uint8)
        begin, end, odd = self._cut(data, seps)
        if not self.byte_level:
            low = _LOWER[data]
            two = np.flatnonzero(data == 0xC3) + 1
            low[two] += np.where((data[two] >= 0x80) & (data[two] <= 0x9E), 32, 0).astype(np.uint8)
            low[np.flatnonzero(data == 0xC5) + 1] |= 1  # the one pair of letters under it that is cut
            begin = begin + (data[begin] == 32)
        else:
            low = data
        up, down = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[low] * up[: len(data)], out=sums[1:])
        h = _mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
        if odd.any():  # not lower-cased: hashed as they are
            k = np.flatnonzero(odd)
            if low is not data:
                np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
            h[k] = _mix(_mix((sums[end[k]] - sums[begin[k]]) * down[begin[k]] + (end[k] - begin[k]).astype(np.uint64)) ^ np.uint64(0x5851F42D4C957F2D))
        h[h == 0] = 1
        runs = self.runs
        runs.now += 1
        found = runs.find(h)
        long = end - begin > LONGEST
        new = np.flatnonzero((found < 0) & ~long)
        fresh_ids, fresh_lens = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        text_of = lambda i: joined[begin[i] : end[i]].decode("utf-8", "surrogatepass")
        if len(new):
            _, first = np.unique(h[new], return_index=True)
            one = new[first]
            small = low.tobytes() if low is not data else joined
            names = [(joined if o else small)[a:z].decode("utf-8", "surrogatepass") for a, z, o in zip(begin[one].tolist(), end[one].tolist(), odd[one].tolist(), strict=True)]
            for a in range(0, len(one), runs.most // 4):
                z = slice(a, a + runs.most // 4)
                ids, lens = self._ids(names[z])
                if len(one) > runs.most // 4:
                    fresh_ids, fresh_lens = np.concatenate((fresh_ids, ids)), np.concatenate((fresh_lens, lens))
                else:
                    fresh_ids, fresh_lens = ids, lens
        lens = np.zeros(len(h), np.int64)
        known = found >= 0
        lens[known] = runs.lens[found[known]]
        runs.seen[found[known]] = runs.now
        parts = []
        if len(new):
            place = np.searchsorted(h[one], h[new])
            lens[new] = fresh_lens[place]
        longs = np.flatnonzero(long)
        own = self._plain([text_of(i) for i in longs]) if len(longs) else []
        lens[longs] = [len(x) for x in own]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        out = np.zeros(total, np.uint32)
        known &= ~long
        starts = ends - lens

        def fill(rows, pool, at):
            n = lens[rows]
            e = np.cumsum(n)
            k = np.arange(int(e[-1]) if len(e) else 0)
            out[np.repeat(starts[rows] - (e - n), n) + k] = pool[np.repeat(at - (e - n), n) + k]

        if known.all():
            out = runs.ids(found)
        else:
            rows = np.flatnonzero(known)
            fill(rows, runs.pool, runs.at[found[rows]])
            if len(new):
                fill(new, fresh_ids, (np.cumsum(fresh_lens) - fresh_lens)[place])
            for i, x in zip(longs, own, strict=True):
                out[starts[i] : ends[i]] = x
        if len(new):
            few = min(len(one), runs.most // 4)  # a batch holds far fewer
            runs.add(h[one][:few], fresh_ids[: int(fresh_lens[:few].sum())], fresh_lens[:few])
        upto = np.concatenate(([0], ends))[np.searchsorted(begin, seps, "left")]
        return out, np.diff(upto, prepend=0)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has. A long text is taken in pieces, all of it."""
        chunks, owner = [], []
        for i, t in enumerate(texts):
            at = 0
            while len(t) - at > PIECE_CHARS:
                m = _CUT.search(t, at + PIECE_CHARS)
                if not m:
                    break
                chunks.append(t[at : m.start()])
                owner.append(i)
                at = m.start()
            chunks.append(t[at:] if at else t)
            owner.append(i)
        ids, counts, a, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0, 0
        for z, c in enumerate(chunks):
            size += len(c)
            if size >= PIECE_CHARS or z + 1 == len(chunks):
                x, n = self._encode(chunks[a : z + 1])
                ids.append(x)
                counts.append(n)
                a, size = z + 1, 0
        return np.concatenate(ids) if len(ids) != 2 else ids[1], np.bincount(np.array(owner, np.int64), np.concatenate(counts), len(texts)).astype(np.int64) if texts else np.zeros(0, np.int64)


def encoder(path: str, byte_level: bool) -> Encoder:
    """This worker's encoder for a file."""
    if (path, byte_level) not in _encoders:
        _encoders[path, byte_level] = Encoder(path, byte_level)
    return _encoders[path, byte_level]
