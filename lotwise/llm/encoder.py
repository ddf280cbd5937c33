"""Ids of the tokenizers library for many texts, put together from units that are encoded once (no Spark)."""

from __future__ import annotations

import os
import re

import numpy as np

from .textvec import Words, mix

_TIGHT = re.compile(r"(?<=\S) (?=\S)")
_ODD = ("  ", "\n ", " \n", "\t ", " \t", "\r ", " \r", *"\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0     　", *map(chr, range(0x2000, 0x200B)))
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_MARK_BYTES = np.isin(np.arange(256), [ord(c) for c in _MARKS])


def _visible() -> dict[int, str]:
    """The byte-level alphabet: a byte that prints in Latin-1 stands for itself, the others take 256, 257, ... in turn."""
    prints = [b for b in range(33, 256) if b < 127 or b > 160 and b != 173]
    rest = (b for b in range(256) if b not in set(prints))
    return {b: chr(256 + i) for i, b in enumerate(rest)}


_VISIBLE = _visible()  # a blank reads as U+0120


class UnitEncoder(dict):
    """The library's ids of a text, put together from remembered units of text between single blanks.

    Byte-level pre-tokenization never joins anything over a blank with other characters on both sides but the blank
    itself to the word after it, so units encode alone; so do the two sides of a single line end. A word with trailing
    marks is two pre-tokens, and the library's BPE model is asked for each. Texts with the special token's string or with
    START go to the library whole. Keys are the unit's text after its blank, or START and the text of a unit without blank. At most
    ``memory`` units and ``words`` words are remembered; others are encoded again when met again.
    """

    START = "\0"

    def __init__(self, path: str, memory: int = 100_000, words: int = 400_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.raw = [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size())]
        self.words: dict[str, bytes] = {}
        self.memory, self.most_words = memory, words

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def pre_token(self, word: str) -> bytes:
        """Ids of one pre-token."""
        ids = self.words.get(word)
        if ids is None:
            if not word.isascii():
                shown = word.encode().decode("latin-1").translate(_VISIBLE)
            else:
                shown = "\u0120" + word[1:] if word[0] == " " else word.translate(_VISIBLE)
            raw = self.raw
            ids = b"".join([raw[t.id] for t in self.model.tokenize(shown)])
            if len(self.words) < self.most_words:
                self.words[word] = ids
        return ids

    def __missing__(self, key: str) -> bytes:
        ids = self.unit(key)
        if len(self) < self.memory:
            self[key] = ids
        return ids

    def unit(self, key: str) -> bytes:
        """Ids of a unit, which is not remembered itself."""
        core = key.rstrip(_MARKS)
        if core.isalpha() and (core.isascii() or max(core) < "\u0250"):  # so it has no START and no line end
            ids = self.pre_token(" " + core)
            if len(core) != len(key):
                ids += self.pre_token(key[len(core) :])
            return ids
        return self._other(key)

    def _other(self, key: str) -> bytes:
        """Ids of a unit that isn't a word after a blank."""
        lead = key[:1] != self.START
        body = key if lead else key[1:]
        left, end, right = body.partition("\n")
        if end and left and right and "\n" not in right and not left[-1].isspace() and not right[0].isspace():
            return self[left if lead else self.START + left] + self.pre_token("\n") + self[self.START + right]
        core = left.rstrip(_MARKS)
        if not lead and not end and core.isalpha() and core.isascii():
            return self.pre_token(core) + (self.pre_token(left[len(core) :]) if len(core) != len(left) else b"")
        return self.whole(" " + body if lead else body)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if self.START in text or any(s in text for s in self.special):
            return self.whole(text)
        pieces = _TIGHT.split(text) if any(x in text for x in _ODD) else text.split(" ")
        pieces[0] = self.START + pieces[0]
        return b"".join(map(self.__getitem__, pieces))


def _odd_rows(data: np.ndarray, offsets: np.ndarray, special: list[str]) -> np.ndarray:
    """Rows whose blanks don't part units that encode alone: with runs of white space, blanks at an end, rare white space,
    NUL or the special token's string."""
    blank, space = data == 32, (data == 32) | ((data >= 9) & (data <= 13))
    odd = (data == 0) | (data == 11) | (data == 12) | ((data >= 28) & (data <= 31))
    after = np.zeros(len(data) + 2, np.uint8)
    after[: len(data)] = data
    second, third = after[1:-1], after[2:]
    odd |= (blank & ((second == 32) | ((second >= 9) & (second <= 13)))) | (space & (second == 32))
    odd |= ((data == 0xC2) & ((second == 0x85) | (second == 0xA0))) | ((data == 0xE1) & (second == 0x9A) & (third == 0x80))
    odd |= (data == 0xE2) & (second == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))
    odd |= ((data == 0xE2) & (second == 0x81) & (third == 0x9F)) | ((data == 0xE3) & (second == 0x80) & (third == 0x80))
    row = lambda places: np.searchsorted(offsets, places, side="right") - 1
    out = np.bincount(row(np.flatnonzero(odd)), minlength=len(offsets) - 1) > 0
    full = np.flatnonzero(np.diff(offsets))
    out[full] |= blank[offsets[full]] | blank[offsets[full + 1] - 1]
    whole = data.tobytes()
    for word in (s.encode() for s in special):
        place = whole.find(word)
        while place >= 0:
            out[row(place)] = True
            place = whole.find(word, place + 1)
    return out


class _Units(Words):
    """Runs of bytes between single blanks or between single line ends; ASCII marks at such a run's end are a unit of their
    own if a Latin letter stands before them. kind: 0 at a text's start, 1 after a blank, 2 after a line end, 3 marks."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        space = (data == 32) | ((data >= 9) & (data <= 13))
        line = data == 10
        line[1:] &= ~space[:-1]
        line[:-1] &= ~space[1:]
        edge = np.append(offsets[:-1], offsets[1:] - 1)
        line[edge[(edge >= 0) & (edge < len(data))]] = False
        word = (data != 32) & ~line
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        begin[cut] = word[cut]
        end[cut - 1] = word[cut - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        other = np.flatnonzero(~_MARK_BYTES[data])  # the last byte of a run that is no mark, if there is one
        last = np.searchsorted(other, ends) - 1
        last = other[np.maximum(last, 0)] if len(other) else np.full(len(ends), -1)
        here = last >= starts
        byte, before = data[np.maximum(last, 0)] if len(data) else last, data[np.maximum(last - 1, 0)] if len(data) else last
        latin = (byte >= 0x80) & (before >= 0xC3) & (before <= 0xC8) & ~((before == 0xC3) & ((byte == 0x97) | (byte == 0xB7))) & (last > starts)
        apart = here & (last + 1 < ends) & (latin | (((byte | 0x20) >= 97) & ((byte | 0x20) <= 122) & (byte < 0x80)))
        row = np.searchsorted(offsets, starts, side="right") - 1
        lead = line[np.maximum(starts, 1) - 1] if len(data) else np.zeros(0, bool)
        kind = np.where(starts == offsets[row], 0, np.where(lead, 2, 1))
        marks = last[apart] + 1
        order = np.argsort(np.append(starts, marks), kind="stable")
        self.kind = np.append(kind, np.full(len(marks), 3))[order]
        self.starts = np.append(starts, marks)[order]
        self.ends = np.append(np.where(apart, last + 1, ends), ends[apart])[order]
        self.data, self._word = data, word
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.rows = np.repeat(np.arange(len(offsets) - 1), self.counts)


class ChunkEncoder:
    """Ids of many texts at a time: units are found and looked up by their 64-bit hashes in arrays; those met for the first
    time, and texts with odd white space, go to a UnitEncoder. At most ``memory`` units are remembered."""

    def __init__(self, path: str, end_id: int, memory: int = 2_000_000):
        self.units = UnitEncoder(path)
        self.line = self.units.whole("\n")
        self.memory, self.known = memory, 0
        self.mask = (1 << (2 * memory).bit_length()) - 1
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.first = np.zeros(self.mask + 1, np.int64)
        self.size = np.zeros(self.mask + 1, np.int32)
        self.pool = np.zeros(1 << 20, np.uint32)
        self.pool[0], self.used = end_id, 1  # the pool starts with a document's end

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        out = np.full(len(keys), -1)
        left, slot = np.arange(len(keys)), (keys & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = slot[hit]
            more = ~hit & (there != 0)
            left, slot = left[more], (slot[more] + 1) & self.mask
        return out

    def _add(self, keys: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """Remember distinct new keys."""
        left, slot = np.arange(len(keys)), (keys & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[left[free]]
            mine = self.keys[slot] == keys[left]
            self.first[slot[mine]], self.size[slot[mine]] = first[left[mine]], size[left[mine]]
            left, slot = left[~mine], (slot[~mine] + 1) & self.mask
        self.known += len(keys)

    def _append(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Put ids in the pool: (first place, count) of each part."""
        ids = np.frombuffer(b"".join(parts), "<u4")
        while self.used + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.pool[self.used : self.used + len(ids)] = ids
        size = np.array([len(p) // 4 for p in parts], np.int64)
        first = self.used + np.cumsum(size) - size
        self.used += len(ids)
        return first, size

    def _ids(self, body: bytes, kind: int) -> bytes:
        units = self.units
        if kind == 1 and body.isalpha():  # ASCII letters after a blank: one pre-token
            return b"".join([units.raw[t.id] for t in units.model.tokenize("\u0120" + body.decode())])
        text = body.decode()
        if kind == 3:
            return units.pre_token(text)
        return units.unit(text) if kind == 1 else units.unit(units.START + text) if kind == 0 else self.line + units.unit(units.START + text)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text) of the texts data[offsets[i]:offsets[i + 1]], an end id after each."""
        n, raw = len(offsets) - 1, data.tobytes()
        odd = _odd_rows(data, offsets, self.units.special) if len(data) else np.zeros(n, bool)
        u = _Units(data, offsets)
        mine = ~odd[u.rows]
        starts, ends, kind, rows = u.starts[mine], u.ends[mine], u.kind[mine], u.rows[mine]
        keys = mix(u.hashes()[mine] + kind.astype(np.uint64), 51) | np.uint64(1)  # never 0, which marks a free slot
        slot = self._find(keys)
        first, size = self.first[slot], self.size[slot].astype(np.int64)
        keep = self.used
        if len(new := np.flatnonzero(slot < 0)):
            fresh, one, which = np.unique(keys[new], return_index=True, return_inverse=True)
            parts = [self._ids(raw[a:b], k) for a, b, k in zip(starts[new[one]].tolist(), ends[new[one]].tolist(), kind[new[one]].tolist(), strict=True)]
            at, count = self._append(parts)
            first[new], size[new] = at[which], count[which]
            room = min(max(self.memory - self.known, 0), len(fresh))
            self._add(fresh[:room], at[:room], count[:room])
            keep += int(count[:room].sum())
        strange = np.flatnonzero(odd)
        at, count = self._append([self.units.encode(raw[offsets[i] : offsets[i + 1]].decode()) for i in strange])
        all_rows = np.concatenate([rows, strange, np.arange(n)])
        order = np.argsort(all_rows, kind="stable")
        first = np.concatenate([first, at, np.zeros(n, np.int64)])[order]
        size = np.concatenate([size, count, np.ones(n, np.int64)])[order]
        total = np.cumsum(size)
        ids = self.pool[np.repeat(first - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        self.used = keep
        return ids, np.bincount(all_rows[order], size, n).astype(np.int64)
