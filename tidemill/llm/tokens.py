"""Token ids by the tokenizers library, with the ids of pieces of text remembered per Python worker.

Both kinds of vocabulary used here cut a text into pieces before anything else: at white space, and between
letters and other characters. A text's ids are those of its pieces in turn, so each distinct piece is encoded
by the library once and remembered. Pieces of plain texts (ASCII and Latin-1 letters, single spaces and line
ends) are found and looked up for a whole chunk at a time with numpy; other texts are cut at white space
only, or, if they hold characters about which libraries may differ, encoded whole.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa

from .common import Texts, _mixed, byte_set, text_chunks

#: Characters that are white space to some libraries only, or outside ASCII (fixed values).
ODD_RANGES = ((0x1C, 0x1F), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x2060), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
_ODD = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ODD_RANGES) + "]")
#: Pieces as byte-level BPE makes them: a word with the one space before it, or a run of white space.
_SPACED = re.compile(r" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
#: Pieces remembered before the memory is emptied; an entry takes about 60 bytes.
MEMORY = 2_000_000

_LETTER = byte_set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", upper_half=True)
_SPACE = byte_set(" \n")
#: Bytes that a plain text may hold: printable ASCII but the apostrophe, spaces and line ends, Latin-1 letters after 0xC3.
_PLAIN = byte_set("".join(map(chr, range(32, 127))) + "\n") & ~byte_set("'")
_PLAIN[0xC3] = _PLAIN[0x80:0xC0] = True
_ASCII_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def plain_rows(texts: Texts) -> np.ndarray:
    """Which texts of a chunk are plain."""
    data = texts.bytes
    if not len(data):
        return np.ones(texts.n, bool)
    bad = ~_PLAIN[data]
    space = _SPACE[data]
    bad[1:] |= space[1:] & space[:-1]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    high = (data >= 0x80) & (data < 0xC0)
    # a continuation byte stands after 0xC3 and nowhere else; the signs for times and division are no letters
    bad |= high != after
    bad |= after & ((data == 0x97) | (data == 0xB7))
    count = np.concatenate([[0], np.cumsum(bad)])
    last = np.maximum(texts.ends - 1, 0)
    ends_in_space = (texts.ends > texts.starts) & space[np.minimum(last, len(data) - 1)]
    return (count[texts.ends] == count[texts.starts]) & ~ends_in_space


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def piece_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each piece, from eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    word = eight[start] & _MASKS[np.minimum(size, 8)]
    key, check = _mixed(word + size.astype(np.uint64) * np.uint64(0x94D049BB133111EB)), word * np.uint64(0xD6E8FEB86659FD93)
    rows, at = np.flatnonzero(size > 8), 8
    while len(rows):
        word = eight[start[rows] + at] & _MASKS[np.minimum(size[rows] - at, 8)]
        key[rows] = _mixed(key[rows] * np.uint64(0x9E3779B97F4A7C15) + word)
        check[rows] = check[rows] * np.uint64(0x2545F4914F6CDD1D) + word
        at += 8
        rows = rows[size[rows] > at]
    return key, check


class _Table:
    """A hash table from 64-bit keys to entry numbers, probed for many keys at once."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.bits) - 1)
        slot = (keys & mask).astype(np.int64)
        found = np.full(len(keys), -1, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            s = slot[todo]
            value = self.values[s]
            hit = (self.keys[s] == keys[todo]) & (value >= 0)
            found[todo[hit]] = value[hit]
            todo = todo[~hit & (value >= 0)]
            slot[todo] = (slot[todo] + 1) & int(mask)
        return found

    def add(self, keys: np.ndarray) -> None:
        """Add distinct keys that are absent; they get the next numbers."""
        while (self.n + len(keys)) * 2 > len(self.keys):
            held = self.values >= 0
            old, numbers = self.keys[held], self.values[held]
            self.bits += 1
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            self._put(old, numbers)
        self._put(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (keys & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            s = slot[todo]
            free = self.values[s] < 0
            # of the keys that want a free slot, the one written last gets it
            self.values[s[free]] = numbers[todo[free]]
            self.keys[s[free]] = keys[todo[free]]
            lost = self.values[s] != numbers[todo]
            todo = todo[lost]
            slot[todo] = (slot[todo] + 1) & mask


class Encoder:
    """Encodes string columns; ``path`` is a tokenizers JSON file.

    ``white_space`` says what the vocabulary does with it: 'dropped', or 'kept' with the word that follows.
    """

    def __init__(self, path: str, white_space: str):
        from tokenizers import Tokenizer

        if white_space not in ("dropped", "kept"):
            raise ValueError(f"white space is dropped or kept, not {white_space}")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: Added tokens (e.g. an end mark) stand for one id wherever a text spells them; such texts are encoded whole.
        self.added = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.kept = white_space == "kept"
        #: Vocabularies that lower-case texts see fewer distinct pieces if that is done first.
        self.fold = _ASCII_LOWER if "Lowercase" in str(self.tokenizer.normalizer) else None
        #: Bytes by the kind of piece they belong to; spaces belong to none, line ends where white space is kept.
        self.kinds = np.where(_SPACE, 0, np.where(_LETTER, 1, 2)).astype(np.uint8)
        self.kinds[10] = 3 if self.kept else 0
        self._forget()

    def _forget(self) -> None:
        self.table = _Table()
        self.check = np.empty(0, np.uint64)
        self.start = np.zeros(1, np.int64)
        self.flat = np.empty(0, np.uint32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _remember(self, keys: np.ndarray, check: np.ndarray, pieces: list[str]) -> None:
        starts, flat = [self.start], [self.flat]
        for at in range(0, len(pieces), 5000):
            ids = self._ids(pieces[at : at + 5000])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            starts.append(starts[-1][-1] + np.cumsum(sizes))
            flat.append(np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())))
        self.start, self.flat = np.concatenate(starts), np.concatenate(flat)
        self.table.add(keys)
        self.check = np.concatenate([self.check, check])

    def _plain(self, texts: Texts) -> list[np.ndarray]:
        """Ids of plain texts."""
        data = texts.bytes if self.fold is None else self.fold[texts.bytes]
        kind = self.kinds[data]
        change = np.ones(len(data), bool)
        change[1:] = kind[1:] != kind[:-1]
        edge = np.zeros(len(data) + 1, bool)
        edge[texts.starts] = True
        start = np.flatnonzero(change | edge[:-1])
        end = np.append(start[1:], len(data))
        held = kind[start] > 0
        start, end = start[held], end[held]
        key, check = piece_keys(data, start, end)
        if self.kept:
            lead = (data[np.maximum(start - 1, 0)] == 32) & ~edge[start]
            key, check = np.where(lead, _mixed(key + np.uint64(0x5851F42D4C957F2D)), key), check + lead
            start = start - lead
        entry = self.table.find(key)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, at = np.unique(key[missing], return_index=True)
            at = missing[at]
            data = texts.bytes.tobytes()
            self._remember(new, check[at], [data[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            entry[missing] = self.table.find(key[missing])
        if (self.check[entry] != check).any():  # two pieces share a 64-bit hash: these texts do without the memory
            return [self._other(texts.text(r)) for r in range(texts.n)]
        size = self.start[entry + 1] - self.start[entry]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.flat[np.repeat(self.start[entry] - (stop - size), size) + np.arange(total)]
        # pieces of each text, then ids of each text
        cuts = np.searchsorted(start, np.append(texts.starts, len(texts.bytes)))
        bounds = np.concatenate([[0], stop])[cuts]
        return np.split(ids, bounds[1:-1])

    def _may_spell_added(self, texts: Texts) -> np.ndarray:
        """Which texts hold the first two bytes of an added token."""
        found = np.zeros(texts.n, bool)
        data = _ASCII_LOWER[texts.bytes]
        for a, b in {tuple(t.encode()[:2].ljust(2)) for t in self.added}:
            at = np.flatnonzero((data[:-1] == a) & (data[1:] == b)) if len(data) > 1 else np.empty(0, np.int64)
            found[np.searchsorted(texts.starts, at, "right") - 1] = True
        return found

    def _other(self, text: str) -> np.ndarray:
        """Ids of a text that is not plain: white-space pieces, or the text as a whole."""
        low = text.lower()
        if any(t in low for t in self.added) or any(c in text for c in "\x1c\x1d\x1e\x1f") or not text.isascii() and _ODD.search(text):
            return np.array(self._ids([text])[0], np.uint32)
        pieces = _SPACED.findall(text) if self.kept else text.split()
        return np.array([i for ids in self._ids(pieces) for i in ids], np.uint32)

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string column, as unsigned 32-bit arrays; nulls are empty texts."""
        if self.table.n > MEMORY:
            self._forget()
        out: list[np.ndarray] = []
        column = column.fill_null("")
        for texts in text_chunks(column):
            plain = plain_rows(texts) & ~self._may_spell_added(texts)
            found: list[np.ndarray] = [np.empty(0, np.uint32)] * texts.n
            if plain.any():
                rows = np.flatnonzero(plain)
                part = texts if plain.all() else next(iter(text_chunks(column.slice(texts.first, texts.n).filter(pa.array(plain)), 1 << 40)))
                for r, ids in zip(rows.tolist(), self._plain(part), strict=True):
                    found[r] = ids
            for r in np.flatnonzero(~plain).tolist():
                found[r] = self._other(texts.text(r))
            out += found
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, white_space: str) -> Encoder:
    """The worker's encoder for a vocabulary file, kept from task to task."""
    key = (path, white_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, white_space)
    return _ENCODERS[key]


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
