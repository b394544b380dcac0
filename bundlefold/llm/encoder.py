"""Token ids of whole texts by a public tokenizer, each distinct stretch of text encoded once.

A text is cut before single spaces that stand between two characters that aren't white space. Neither pre-tokenizer
lets a token or a merge cross such a place, so the ids of the pieces, joined, are the ids of the text. Texts with any
other space go to the library whole, as do, to be safe, those that hold what might be other white space or, where the
tokenizer drops case, what might be a special token.

Pieces are found and looked up with numpy over a batch's bytes: a table from a piece's hash, length and first bytes to
its ids. New pieces go to the library many at a time, a special token between them, at which it parts texts. Of letters
with one mark after them both parts are encoded apart, but only where the tokenizer itself parts the last letter from
each mark: a letter that its normaliser turns into a letter and a combining mark (a capital I with a dot, composition
exclusions) draws the mark into its token. The table is bounded and keeps what came first.
"""

from __future__ import annotations

import os

import numpy as np

from . import common
from .textscan import U, span_hashes

#: Pieces kept in a worker.
ENTRIES = 1 << 21
#: Bytes above which a text is cut into rows of its own, at safe places.
SPAN = 1 << 22
#: Marks that stand alone after letters, in either tokenizer.
MARKS = tuple(".,;:!?|\"")


def encoder(path: str) -> "Encoder":
    """The encoder of this process for a tokenizer file."""
    return common.held(("encoder", path), lambda: Encoder(path))


class Table:
    """Pieces by hash, open addressing: for each the place and number of its ids in a pool. Grows with the pieces kept."""

    def __init__(self, most: int):
        self.most, self.kept = most, 0
        self._slots(min(most, 1 << 16))
        self.check, self.at, self.n = np.zeros(1024, U), np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.pool, self.count, self.used = np.zeros(4096, np.uint32), 0, 0

    def _slots(self, pieces: int) -> None:
        """Empty slots, at least two for each piece."""
        self.mask = (1 << (2 * pieces - 1).bit_length()) - 1
        self.key, self.entry = np.zeros(self.mask + 1, U), np.full(self.mask + 1, -1, np.int32)

    def find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Entries of pieces, -1 for unknown ones."""
        out = np.full(len(h), -1, np.int32)
        slot, rows = (h & U(self.mask)).astype(np.int64), np.arange(len(h))
        while len(rows):
            e = self.entry[slot]
            same = self.key[slot] == h[rows]
            same &= e >= 0
            hit = rows[same]
            out[hit] = np.where(self.check[e[same]] == check[hit], e[same], -1)
            go = ~same & (e >= 0)
            rows, slot = rows[go], (slot[go] + 1) & self.mask
        return out

    def add(self, check: np.ndarray, ids: list[bytes]) -> np.ndarray:
        """Puts ids at the end of the pool; entries for them."""
        flat = np.frombuffer(b"".join(ids), np.uint32)
        sizes = np.array([len(x) // 4 for x in ids], np.int32)
        first, need = self.count, self.count + len(ids)
        for name, n in (("check", need), ("at", need), ("n", need), ("pool", self.used + len(flat))):
            old = getattr(self, name)
            if n > len(old):
                new = np.zeros(max(n, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.check[first:need], self.n[first:need] = check, sizes
        self.at[first:need] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + len(flat)] = flat
        self.count, self.used = need, self.used + len(flat)
        return np.arange(first, need, dtype=np.int32)

    def keep(self, h: np.ndarray, entries: np.ndarray) -> None:
        """Makes new entries findable. Hashes have to differ, and be unknown."""
        self.kept += len(h)
        if 2 * self.kept > self.mask + 1:
            there = self.entry >= 0
            known = self.key[there], self.entry[there]
            self._slots(self.kept)
            self._put(*known)
        self._put(h, entries)

    def _put(self, h: np.ndarray, entries: np.ndarray) -> None:
        slot, rows = (h & U(self.mask)).astype(np.int64), np.arange(len(h))
        while len(rows):
            free = np.flatnonzero(self.entry[slot] < 0)
            take = free[np.unique(slot[free], return_index=True)[1]]
            self.key[slot[take]], self.entry[slot[take]] = h[rows[take]], entries[rows[take]]
            left = np.ones(len(rows), bool)
            left[take] = False
            # who found its slot taken tries the next one
            rows, slot = rows[left], (slot[left] + 1) & self.mask

    def forget(self, count: int, used: int) -> None:
        self.count, self.used = count, used


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        made = json.loads(self.tok.to_str())
        #: Whether white space is dropped between tokens, and case with it; else a space leads its word.
        self.drops = (made.get("pre_tokenizer") or {}).get("type") != "ByteLevel"
        if self.drops and "Lowercase" not in json.dumps(made.get("normalizer")):
            raise ValueError("a tokenizer that drops white space but keeps case isn't known here")
        added = [(t.content, i) for i, t in self.tok.get_added_tokens_decoder().items() if t.special and not t.lstrip and not t.rstrip and t.content.isascii()]
        #: A special token to part pieces by, and its id.
        self.apart = added[0] if added else None
        self.table = Table(ENTRIES)
        self.marks = dict(zip(MARKS, self.whole(list(MARKS)), strict=True))
        self.is_mark = np.zeros(256, bool)
        self.is_mark[[ord(m) for m in MARKS]] = True
        self.low = np.arange(256, dtype=np.uint8)
        if self.drops:
            self.low[65:91] += 32
        self.apart_after: dict[str, bool] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def many(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of many short pieces."""
        if not self.apart:
            return self.whole(pieces)
        mark, number = self.apart
        out: list[bytes | None] = [None] * len(pieces)
        odd = [k for k, p in enumerate(pieces) if mark in p]
        for k, x in zip(odd, self.whole([pieces[k] for k in odd]), strict=True):
            out[k] = x
        rest = [k for k, x in enumerate(out) if x is None]
        groups = [rest[k : k + 128] for k in range(0, len(rest), 128)]
        for group, e in zip(groups, self.tok.encode_batch_fast([mark.join([pieces[k] for k in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(ids == number).tolist()
            raw = ids.tobytes()
            for k, a, b in zip(group, [-1, *cuts], [*cuts, len(ids)], strict=True):
                out[k] = raw[4 * a + 4 : 4 * b]
        return out

    def parts_after(self, letter: str) -> bool:
        """Whether each mark after this letter is cut off by the tokenizer; asked of its own normaliser and pre-tokenizer,
        once for each letter."""
        if letter not in self.apart_after:
            normal, cut = self.tok.normalizer, self.tok.pre_tokenizer.pre_tokenize_str
            pieces = [cut(normal.normalize_str(letter + m) if normal else letter + m) for m in MARKS]
            self.apart_after[letter] = all(len(p) > 1 and p[-1][0] == m for p, m in zip(pieces, MARKS, strict=True))
        return self.apart_after[letter]

    def learn(self, pieces: list[bytes], stems: list[bytes | None]) -> list[bytes]:
        """The ids of new pieces; what they have in common is encoded once. stems: the ids of each piece without its last
        byte, if that is a mark and they are known."""
        ask: dict[str, int] = {}
        parts = []
        for raw, stem in zip(pieces, stems, strict=True):
            p = raw.decode()
            body = p[1:] if not self.drops and p[0] == " " else p
            if body[-1:] in MARKS and body[:-1].isalpha() and self.parts_after(body[-2]):
                parts.append((stem if stem is not None else ask.setdefault(p[:-1], len(ask)), body[-1]))
            else:
                parts.append((ask.setdefault(p, len(ask)), None))
        ids = self.many(list(ask))
        marks = self.marks
        return [(k if isinstance(k, bytes) else ids[k]) + marks[m] if m else ids[k] for k, m in parts]

    def _check(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A second look at pieces: their lengths and their first and last bytes."""
        check = (ends - starts).astype(U) << U(40) | low[ends - 1].astype(U) << U(32)
        for k in range(4):
            check |= low[np.minimum(starts + k, ends - 1)].astype(U) << U(8 * k)
        return check

    def _stems(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes | None]:
        """Of pieces that end with a mark, the ids of what is before it, where the table has that."""
        out: list[bytes | None] = [None] * len(starts)
        rows = np.flatnonzero(self.is_mark[low[ends - 1]] & (ends - starts > 1))
        rows = rows[np.argsort(starts[rows], kind="stable")]
        if len(rows):
            s, e = starts[rows], ends[rows] - 1
            entry = self.table.find(span_hashes(low, s, e), self._check(low, s, e))
            for k, at in zip(rows[entry >= 0].tolist(), entry[entry >= 0].tolist(), strict=True):
                a = int(self.table.at[at])
                out[k] = self.table.pool[a : a + int(self.table.n[at])].tobytes()
        return out

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of pieces, offsets of each text's pieces, and which texts can't be cut so."""
        n = len(data)
        odd = np.zeros(len(offsets) - 1, bool)
        nonempty = np.diff(offsets) > 0
        flag = lambda where: odd.__setitem__(np.searchsorted(offsets, where, "right") - 1, True)
        begins = offsets[:-1][nonempty]
        if self.drops:
            space = (data == 32) | (data == 10)
            flag(np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)))
            edge = np.zeros(n + 1, bool)
            edge[offsets] = True
            inside = ~space
            before = np.zeros(n, bool)
            before[1:] = inside[:-1]
            before[begins] = False
            starts = np.flatnonzero(inside & ~before)
            after = np.zeros(n, bool)
            after[:-1] = inside[1:]
            after[offsets[1:][offsets[1:] > 0] - 1] = False
            ends = np.flatnonzero(inside & ~after) + 1
        else:
            space = data == 32
            idle = data <= 32  # white space and, to be safe, all control characters
            near = np.zeros(n, bool)
            near[1:] |= idle[:-1]
            near[begins] = False
            near[:-1] |= idle[1:]
            ends_at = offsets[1:][nonempty] - 1
            near[ends_at] = True  # a space that ends a text
            flag(np.flatnonzero(space & near))
            flag(np.flatnonzero((data >= 0xE1) & (data <= 0xE3)))
            flag(np.flatnonzero((data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))))
            cut = space.copy()
            cut[begins] = True
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], n)
        return starts, ends, np.searchsorted(starts, offsets), odd

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a batch's bytes, and n + 1 offsets of each text's ids."""
        if len(offsets) > 1 and np.diff(offsets).max() > SPAN:
            return self._long(data, offsets)
        starts, ends, first, odd = self._pieces(data, offsets)
        if not len(starts):
            return self._with_whole(data, offsets, odd, np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)) if odd.any() else (np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64))
        t = self.table
        count, used = t.count, t.used
        low = self.low[data] if self.drops else data
        h = span_hashes(low, starts, ends)
        check = self._check(low, starts, ends)
        entry = t.find(h, check)
        usable = np.ones(len(h), bool)
        for r in np.flatnonzero(odd):
            usable[first[r] : first[r + 1]] = False
        miss = np.flatnonzero((entry < 0) & usable)
        if len(miss):
            order = miss[np.lexsort((check[miss], h[miss]))]
            fresh = np.ones(len(order), bool)  # pieces that share a hash differ in their check
            fresh[1:] = (h[order[1:]] != h[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
            where, new = order[fresh], h[order[fresh]]
            raw, s, e = low.tobytes(), starts[where], ends[where]
            got = t.add(check[where], self.learn([raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)], self._stems(low, s, e)))
            entry[order] = got[np.cumsum(fresh) - 1]
        entry[~usable] = -1
        n = np.where(entry >= 0, t.n[entry], 0)
        begin = np.cumsum(n) - n
        ids = t.pool[np.repeat(t.at[entry] - begin, n) + np.arange(n.sum())]
        total = np.concatenate([[0], np.cumsum(n)])
        offs = total[first]
        if len(miss):
            if t.count <= t.most:
                free = t.key[(new & U(t.mask)).astype(np.int64)] != new  # a hash that another piece has stays that piece's
                free[1:] &= new[1:] != new[:-1]
                t.keep(new[free], got[free])
            else:
                t.forget(count, used)
        if odd.any():
            return self._with_whole(data, offsets, odd, ids, offs)
        return ids, offs

    def _with_whole(self, data, offsets, odd, ids, offs):
        """Puts the ids of texts that went to the library whole in their places."""
        rows = np.flatnonzero(odd)
        found = self.whole([data[offsets[r] : offsets[r + 1]].tobytes().decode() for r in rows])
        parts = {int(r): np.frombuffer(x, np.uint32) for r, x in zip(rows, found, strict=True)}
        every = [parts[k] if k in parts else ids[offs[k] : offs[k + 1]] for k in range(len(odd))]
        return np.concatenate(every), np.concatenate([[0], np.cumsum([len(x) for x in every])])

    def _long(self, data, offsets):
        """Cuts long texts before spaces between characters that surely aren't white space, and joins what comes of it."""
        cuts, owner = [0], []
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            at = a
            while b - at > SPAN:
                part = data[at + SPAN // 2 : b]
                plain = (part > 32) & (part < 128)
                safe = np.flatnonzero((part[1:-1] == 32) & plain[:-2] & plain[2:]) if len(part) > 2 else part[:0]
                if not len(safe):
                    break
                at += SPAN // 2 + int(safe[0]) + 1
                cuts.append(at)
                owner.append(k)
            cuts.append(b)
            owner.append(k)
        found, sizes = [], np.zeros(len(offsets) - 1, np.int64)
        for a, b, k in zip(cuts[:-1], cuts[1:], owner, strict=True):
            starts_at = np.array([0, b - a])
            if b - a > SPAN:  # nowhere to cut
                ids = np.frombuffer(self.whole([data[a:b].tobytes().decode()])[0], np.uint32)
            else:
                ids = self.encode(data[a:b], starts_at)[0]
            found.append(ids)
            sizes[k] += len(ids)
        return np.concatenate(found) if found else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(sizes)])
