"""Token ids of the tokenizers library, with a bounded memory of the chunks already seen.

A text is cut only where the tokenizer's own splitting always cuts, so the ids of the chunks, joined, are the ids of the
text. The word vocabulary drops white space, so it cuts at every space and line end; the byte vocabulary cuts where a
character that is not white space is followed by one that is. Chunks of common letters and ASCII punctuation go to the
library's model pretoken by pretoken; every other chunk goes through the whole tokenizer. Added tokens of the vocabulary
are found before any splitting, so a text that holds one is not cut at all.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters that are their own NFC form and \p{L} in every Unicode version; U+0130 changes its length in lower case.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_PUNCT = r"!-&(-/:-@\[-`{-~"
_SIMPLE = rf"^(?P<lead>\n?)(?P<letters>[{_LETTERS}]*)(?P<marks>[{_PUNCT}]*)$"
_CUT_BYTES = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
#: Texts whose white space is single spaces and line ends within; the others are cut by _CUT_BYTES.
_ODD = r"^\s|\s$|\s\s|[^\S \n]|[\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LONGEST = 64
MOST = 250_000
MOST_BYTES = 24 << 20
SHORT = 23  # bytes of a string that three numbers hold with its length
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _byte_letters() -> dict[int, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


def _listed(values: pa.Array) -> list:
    """to_pylist() makes a scalar object of each value first; this doesn't."""
    return values.to_numpy(zero_copy_only=False).tolist()


def _gathered(sizes: np.ndarray, starts: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at starts, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of a word's first bytes


def _keys(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of strings of at most SHORT bytes, their bytes and length as three numbers; and which strings these are."""
    _, offsets, data = values.buffers()
    edges = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    first, size = edges[:-1], np.diff(edges)
    own = np.flatnonzero(size <= SHORT)
    first, size = first[own] - edges[0], size[own]
    raw = (bytes(data[edges[0] : edges[-1]]) if data else b"") + bytes(32)
    words = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    keys = np.stack([words[np.minimum(first + 8 * i, len(words) - 1)] & _KEPT[np.clip(size - 8 * i, 0, 8)] for i in range(3)], axis=1)
    keys[:, 2] |= size.astype(np.uint64) << np.uint64(56)
    return keys, own


class _Memory:
    """Strings and their ids in a few arrays, without an object for each. All go when there are too many.

    Short strings are found by a hash table that stays from call to call; its keys are the whole strings.
    make: distinct strings -> how many ids each has, and all ids one after the other.
    """

    def __init__(self, make, most: int, most_bytes: int = MOST_BYTES):
        self.make, self.most, self.most_bytes, self.bits = make, most, most_bytes, max(10, (2 * most).bit_length())
        self.forget()

    def forget(self) -> None:
        self.seen, self.flat = pa.array([], pa.large_string()), np.zeros(0, np.uint16)
        self.sizes, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.keys, self.table = np.zeros((0, 3), np.uint64), np.full(1 << self.bits, -1, np.int32)
        self.of_long, self.of_short = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the number of each of seen, of each key

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys[:, 0] * _MIX[0] ^ keys[:, 1]) * _MIX[1] ^ keys[:, 2]
        mixed = (mixed ^ mixed >> np.uint64(32)) * _MIX[2]
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _look(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys held each is, or -1."""
        at, slots, left = np.full(len(keys), -1, np.int64), self._slots(keys), np.arange(len(keys))
        while len(left):
            here = self.table[slots[left]]
            left, here = left[here >= 0], here[here >= 0]
            same = (self.keys[here] == keys[left]).all(1)
            at[left[same]] = here[same]
            left = left[~same]
            slots[left] = slots[left] + 1 & len(self.table) - 1
        return at

    def _hold(self, keys: np.ndarray) -> None:
        """Add keys that aren't held, each once."""
        number, slots, left = np.arange(len(keys)) + len(self.keys), self._slots(keys), np.arange(len(keys))
        self.keys = np.concatenate([self.keys, keys])
        while 2 * len(self.keys) > len(self.table):  # one call may bring more than there should be
            self.bits += 1
            self.table = np.full(1 << self.bits, -1, np.int32)
            number, slots, left = np.arange(len(self.keys)), self._slots(self.keys), np.arange(len(self.keys))
        while len(left):
            free = left[self.table[slots[left]] < 0]
            self.table[slots[free]] = number[free]
            left = left[self.table[slots[left]] != number[left]]
            slots[left] = slots[left] + 1 & len(self.table) - 1

    def find(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many ids each distinct string has, where they begin, and all ids; those that aren't known are made together."""
        if len(self.sizes) > self.most or self.seen.nbytes + self.keys.nbytes + self.flat.nbytes > self.most_bytes:
            self.forget()
        keys, short = _keys(distinct)
        at, held = np.full(len(distinct), -1, np.int64), self._look(keys)
        at[short[held >= 0]] = self.of_short[held[held >= 0]]
        long = np.ones(len(distinct), bool)
        long[short] = False
        long = np.flatnonzero(long)
        if len(long):
            held = pc.fill_null(pc.index_in(distinct.take(pa.array(long)), self.seen), -1).to_numpy(zero_copy_only=False)
            at[long[held >= 0]] = self.of_long[held[held >= 0]]
        new = np.flatnonzero(at < 0)
        if len(new):
            sizes, flat = self.make(distinct.take(pa.array(new)))
            at[new] = np.arange(len(new)) + len(self.sizes)
            self.starts = np.concatenate([self.starts, np.cumsum(sizes) - sizes + len(self.flat)])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, flat])
            fresh = np.zeros(len(distinct), bool)
            fresh[new] = True
            self._hold(keys[fresh[short]])
            self.of_short = np.concatenate([self.of_short, at[short[fresh[short]]]])
            long = long[fresh[long]]
            self.seen = pa.concat_arrays([self.seen, distinct.take(pa.array(long, pa.int64()))])
            self.of_long = np.concatenate([self.of_long, at[long]])
        return self.sizes[at], self.starts[at], self.flat


def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each has, and all of them."""
    return np.fromiter(map(len, ids), np.int64, len(ids)) // 2, np.frombuffer(b"".join(ids), "<u2")


class Encoder:
    """batch(texts) -> for each, bytes of little-endian uint16 ids, as Tokenizer.encode(text, add_special_tokens=False) gives them."""

    def __init__(self, path: str, most: int = MOST, most_bytes: int = MOST_BYTES):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary don't fit 16 bits")
        self.model, self.table = self.tokenizer.model, _byte_letters()
        self.model._resize_cache(0)  # pieces remembers more
        self.by_word = self.tokenizer.normalizer is not None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(t.normalized for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that are looked for in normalised text aren't supported")
        self.pieces = _Memory(self._pieces, 3 * most, most_bytes)  # these cost most to make
        self.chunks = _Memory(self._chunks, most, most_bytes)

    def _whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of distinct pieces; none holds the zero character that parts them while they are mapped."""
        mapped = "\0".join(_listed(pieces)).encode().decode("latin-1").translate(self.table).split(chr(self.table[0]))
        tokenize = self.model.tokenize
        each = [[t.id for t in tokenize(x)] if x else [] for x in mapped]
        return np.fromiter(map(len, each), np.int64, len(each)), np.fromiter(chain.from_iterable(each), np.uint16)

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks; in byte mode a space goes before each that doesn't begin with a line end."""
        parts = pc.extract_regex(chunks, _SIMPLE)
        simple = pc.and_(parts.is_valid(), pc.less(pc.utf8_length(chunks), LONGEST)).to_numpy(zero_copy_only=False)
        own = np.flatnonzero(simple)
        lead, letters, marks = (parts.field(i).take(pa.array(own)) for i in range(3))
        if self.by_word:
            pieces = [pc.utf8_lower(letters), marks]
        else:
            no, none = pc.equal(lead, ""), pc.equal(letters, "")
            spaced = lambda x: pc.binary_join_element_wise(pa.scalar(" ", x.type), x, pa.scalar("", x.type))
            pieces = [lead, pc.if_else(no, pc.if_else(none, spaced(marks), spaced(letters)), letters), pc.if_else(pc.and_(no, none), pa.scalar("", marks.type), marks)]
        held = pa.concat_arrays([x.cast(pa.large_string()) for x in pieces]).dictionary_encode()
        n, begin, flat = self.pieces.find(held.dictionary)
        index = held.indices.to_numpy(zero_copy_only=False).reshape(len(pieces), -1).T
        sizes, starts = np.zeros((len(chunks), len(pieces)), np.int64), np.zeros((len(chunks), len(pieces)), np.int64)
        sizes[own], starts[own] = n[index], begin[index]
        rest = np.flatnonzero(~simple)
        whole = [self._whole(c if self.by_word or c[:1] == "\n" else " " + c) for c in _listed(chunks.take(pa.array(rest)))]
        more, ids = _joined(whole)
        sizes[rest, 0], starts[rest, 0] = more, np.cumsum(more) - more + len(flat)
        return sizes.sum(1), _gathered(sizes.ravel(), starts.ravel(), np.concatenate([flat, ids]))

    def _cut(self, texts: pa.Array) -> list[bytes]:
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten().dictionary_encode()
        sizes, starts, known = self.chunks.find(words.dictionary)
        index = words.indices.to_numpy()
        each = sizes[index]
        ends = np.concatenate([[0], np.cumsum(each)])
        flat = _gathered(each, starts[index], known).tobytes()
        at = (2 * ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]).tolist()
        return [flat[i:j] for i, j in zip(at, at[1:])]

    def batch(self, texts: list[str]) -> list[bytes]:
        """Of each text, its ids as bytes of little-endian uint16."""
        held = [any(x in t for x in self.added) for t in texts]
        if not any(held):
            return self._batch(texts)
        rest = iter(self._batch([t for t, x in zip(texts, held) if not x]))
        return [self._whole(t) if x else next(rest) for t, x in zip(texts, held)]

    def _batch(self, texts: list[str]) -> list[bytes]:
        """batch() of texts without added tokens."""
        if not texts:
            return []
        array_ = pa.array(texts, pa.large_string())
        if self.by_word:
            return self._cut(pc.replace_substring(array_, "\n", " "))
        odd = _listed(pc.match_substring_regex(array_, _ODD))
        plain = [t for t, x in zip(texts, odd) if t and not x]
        heads = [re.match(r"[^ \n]+", t)[0] for t in plain]
        rest = pa.array([t[len(h) :].replace("\n", " \n")[1:] for t, h in zip(plain, heads)], pa.large_string())
        tails = iter(self._cut(rest) if plain else [])
        heads = iter(heads)
        out = []
        for t, x in zip(texts, odd):
            if t and not x:
                head, tail = next(heads), next(tails)
                out.append(self._whole(head) + (tail if len(head) < len(t) else b""))
            else:
                out.append(b"".join(map(self._whole, _CUT_BYTES.findall(t))))
        return out


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, most: int = MOST, most_bytes: int = MOST_BYTES) -> Encoder:
    """This Python worker's encoder of a vocabulary file, with memories of this size."""
    key = path, most, most_bytes
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def as_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2")
