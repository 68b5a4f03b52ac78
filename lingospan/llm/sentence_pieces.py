"""Sentence pieces with their places in the original text, and back.

A text is normalised from left to right by the longest prefix that the compiled character map of
the model knows (a double-array trie over UTF-8 bytes); whatever it does not know stays as it is.
All places of a batch walk the trie side by side. Every normalised byte keeps the place of the
original prefix it came from, through white-space rules and the leading mark, so each piece is
projected to the bytes of the original text that it stands for.

Pieces are merged by score, the best pair first and the leftmost of equal ones. No piece of a
model joins a character to a following space mark unless the model says so, so merging works on
words; a task merges each distinct word once, many words at a time, one merge of each per step.
A word is further cut between characters that no piece holds side by side, which bounds long
runs; a stretch without such a cut is merged with a heap.

Models: BPE with the space mark as prefix, with or without byte fallback. Others raise ValueError.

Defined results: a null text is an empty one, which has no pieces and decodes to an empty text;
every row is encoded by itself, also without doc_id or with a repeated one; null ids decode to an
empty text.
"""

from __future__ import annotations

import re
import struct
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lingospan.llm import words as wd
from lingospan.llm.tables import ids_and_texts

SPACE, MARK = 0x20, "▁"
#: Words kept between batches, bytes of the longest one kept, symbols of a stretch merged beside others.
KEPT_WORDS, KEPT_BYTES, ABREAST = 500_000, 256, 64
#: Bytes of text that are encoded at a time.
BLOCK_TEXT = 1 << 20

# Fixed values of the model format: kinds of pieces and of models, numbers of fields.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
PIECES, TRAINER, NORMALIZER, DENORMALIZER = 1, 2, 3, 5
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
MODEL_TYPE, SUFFIX_MARK, BYTE_FALLBACK, UNKNOWN_SURFACE = 3, 24, 35, 44
CHARACTER_MAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 2, 3, 4, 5


def _fields(data: bytes):
    """Field number and value of every field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield number, data[at : at + size]
        at += size


class Model:
    """The parts of a model file that encoding and decoding need."""

    def __init__(self, data: bytes):
        self.texts, self.scores, self.kinds = [], [], []
        parts = {TRAINER: {}, NORMALIZER: {}, DENORMALIZER: {}}
        for number, value in _fields(data):
            if number == PIECES:
                piece = dict(_fields(value))
                self.texts.append(piece.get(PIECE_TEXT, b"").decode())
                self.scores.append(struct.unpack("<f", piece.get(PIECE_SCORE, bytes(4)))[0])
                self.kinds.append(piece.get(PIECE_KIND, NORMAL))
            elif number in parts:
                parts[number] = dict(_fields(value))
        trainer, normalizer = parts[TRAINER], parts[NORMALIZER]
        if trainer.get(MODEL_TYPE, 1) != BPE or trainer.get(SUFFIX_MARK) or not normalizer.get(ESCAPE_SPACES, 1):
            raise ValueError("only BPE models with the space mark as prefix are supported")
        if UNUSED in self.kinds or parts[DENORMALIZER].get(CHARACTER_MAP):
            raise ValueError("models with unused pieces or a map for decoded texts are not supported")
        self.symbols = [t for t, k in zip(self.texts, self.kinds, strict=True) if k == USER_DEFINED]
        if any(MARK in s or " " in s for s in self.symbols):
            raise ValueError("user-defined pieces with spaces are not supported")
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_fallback = bool(trainer.get(BYTE_FALLBACK))
        self.unknown_surface = trainer.get(UNKNOWN_SURFACE, " ⁇ ".encode())
        self.dummy_prefix = bool(normalizer.get(DUMMY_PREFIX, 1))
        self.trim = bool(normalizer.get(EXTRA_SPACES, 1))
        self.character_map = normalizer.get(CHARACTER_MAP, b"")

    @classmethod
    def at(cls, path: str) -> Model:
        with open(path, "rb") as file:
            return cls(file.read())


class PairTable:
    """Values of 64-bit keys in an open-addressed table, looked up many at a time."""

    def __init__(self, entries: dict[int, int]):
        size = 1 << max(4, (4 * len(entries)).bit_length())
        self.shift = np.uint64(65 - size.bit_length())
        self.keys, self.values = np.full(size, -1), np.full(size, -1)
        keys = np.fromiter(entries, np.int64, len(entries))
        for key, value, at in zip(keys.tolist(), entries.values(), self._place(keys).tolist(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) % size
            self.keys[at], self.values[at] = key, value

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The value of every key, -1 for keys without one."""
        at = self._place(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[at[open_]]
            same = held == keys[open_]
            out[open_[same]] = self.values[at[open_[same]]]
            open_ = open_[~same & (held >= 0)]
        return out


class WordTable:
    """Numbers of words, found many at a time and by their exact bytes.

    A word of up to 15 bytes is two 64-bit numbers, its bytes and its length, in an open-addressed
    table that is never more than half full; longer words are keys of a dictionary.
    """

    def __init__(self, kept: int):
        self.kept, size = kept, 1 << (2 * kept).bit_length()
        self.shift = np.uint64(65 - size.bit_length())
        self.low, self.high = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.number = np.full(size, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.total = 0

    def _place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low ^ (low >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _found(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        at = self._place(low, high)
        out = self.number[at]
        open_ = np.flatnonzero((out >= 0) & ((self.low[at] != low) | (self.high[at] != high)))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.number) - 1)
            held = at[open_]
            out[open_] = self.number[held]
            open_ = open_[(out[open_] >= 0) & ((self.low[held] != low[open_]) | (self.high[held] != high[open_]))]
        return out

    def _add(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Give new, distinct words the next numbers."""
        numbers = np.arange(self.total, self.total + len(low), dtype=np.int32)
        at, open_ = self._place(low, high), np.arange(len(low))
        while len(open_):
            slots, first = np.unique(at[open_], return_index=True)
            free = self.number[slots] < 0
            slots, mine = slots[free], open_[first[free]]
            self.low[slots], self.high[slots], self.number[slots] = low[mine], high[mine], numbers[mine]
            left = np.ones(len(open_), bool)
            left[first[free]] = False
            open_ = open_[left]
            at[open_] = (at[open_] + 1) & (len(self.number) - 1)
        self.total += len(low)
        return numbers

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """The number of every word, and the places of one example of each new one, in the order of their numbers.

        ``data`` has 16 bytes more than the words.
        """
        eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        size = ends - starts
        low = eights[starts] & wd.FIRST_BYTES[np.minimum(size, 8)]
        high = (eights[starts + 8] & wd.FIRST_BYTES[np.clip(size - 8, 0, 7)]) | (size.astype(np.uint64) << np.uint64(56))
        short = size < 16
        out = np.full(len(starts), -1, np.int32)
        out[short] = self._found(low[short], high[short])
        unknown = np.flatnonzero(short & (out < 0))
        order = unknown[np.lexsort((high[unknown], low[unknown]))]
        change = np.ones(len(order), bool)
        change[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
        examples = order[change]
        out[order] = self._add(low[examples], high[examples])[np.cumsum(change) - 1]
        new = [examples]
        for i in np.flatnonzero(~short).tolist():
            word = data[starts[i] : ends[i]].tobytes()
            number = self.long.get(word)
            if number is None:
                number = self.long[word] = self.total
                self.total += 1
                new.append([i])
            out[i] = number
        return out, np.concatenate(new).astype(np.int64)


class CharacterMap:
    """Longest prefixes and their replacements, from a compiled map."""

    def __init__(self, compiled: bytes):
        size = struct.unpack("<I", compiled[:4])[0]
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").astype(np.int64)
        self.pool = np.frombuffer(compiled[4 + size :], np.uint8)
        ends = np.flatnonzero(self.pool == 0)
        self.end = ends[np.searchsorted(ends, np.arange(len(self.pool)))] if len(ends) else ends
        self.root = int(self._offset(self.units[:1])[0])
        first = self.root ^ np.arange(256)
        self.leads = self._label(self.units[first]) == np.arange(256)

    @staticmethod
    def _offset(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    @staticmethod
    def _label(unit: np.ndarray) -> np.ndarray:
        return unit & 0x800000FF

    def longest(self, data: np.ndarray, at: np.ndarray, stop: np.ndarray):
        """Bytes of the longest known prefix at each place (0: none) and its replacement's place."""
        length, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        alive = np.flatnonzero(self.leads[data[at]])
        node, step = np.full(len(alive), self.root), 0
        while len(alive):
            place = at[alive] + step
            inside = place < stop[alive]
            alive, node, place = alive[inside], node[inside], place[inside]
            key = data[place].astype(np.int64)
            node = node ^ key
            unit = self.units[node]
            known = self._label(unit) == key
            alive, node, unit = alive[known], node[known], unit[known]
            node = node ^ self._offset(unit)
            step += 1
            leaf = (unit >> 8) & 1 == 1
            length[alive[leaf]] = step
            value[alive[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF
        return length, value


class Normalizer:
    """Texts of a batch in normal form, a space mark as one byte, with the origin of every byte."""

    def __init__(self, model: Model):
        self.model = model
        self.map = CharacterMap(model.character_map) if model.character_map else None
        longest_first = sorted((s.encode() for s in model.symbols), key=len, reverse=True)
        self.symbols = re.compile(b"(?=(" + b"|".join(map(re.escape, longest_first)) + b"))") if longest_first else None

    def _units(self, data: np.ndarray, offsets: np.ndarray):
        """Start and length of every source unit, and where its replacement lies in data + pool."""
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        length = np.diff(starts, append=len(data))
        own = length.copy()
        value = starts.copy()
        size = length.copy()
        if self.map:
            stop = offsets[np.searchsorted(offsets, starts, side="right")]
            found, at = self.map.longest(data, starts, stop)
            known = found > 0
            length[known] = found[known]
            value[known] = at[known] + len(data)
            size[known] = self.map.end[at[known]] - at[known]
        if self.symbols:
            for match in self.symbols.finditer(data.tobytes()):
                i = np.searchsorted(starts, match.start())
                end = match.end(1)
                if i < len(starts) and starts[i] == match.start() and end <= offsets[np.searchsorted(offsets, match.start(), side="right")]:
                    length[i], value[i], size[i] = end - match.start(), match.start(), end - match.start()
        keep = np.ones(len(starts), bool)
        reached = 0
        for i in np.flatnonzero(length > own).tolist():
            if starts[i] >= reached:
                reached = int(starts[i] + length[i])
                keep[i + 1 : np.searchsorted(starts, reached)] = False
        return starts[keep], value[keep], size[keep]

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """Normal bytes, their borders by text, and the origin of each byte and of each text's end.

        Origins are places in the batch; text i has one origin more than bytes, from
        ``borders[i] + i`` on.
        """
        rows = len(offsets) - 1
        if self.map or self.symbols:
            starts, value, size = self._units(data, offsets)
            unit_at = np.cumsum(size) - size
            index = np.arange(size.sum()) + np.repeat(value - unit_at, size)
            out = np.concatenate([data, self.map.pool if self.map else data[:0]])[index]
            origin = np.repeat(starts, size)
            unit = np.repeat(unit_at, size)
            borders = np.append(unit_at, len(out))[np.searchsorted(starts, offsets)]
            spaces = np.concatenate([[0], np.cumsum(out != SPACE)])
            leading = (out == SPACE) & (spaces[1:] == spaces[unit])
            bare = (size == 1) & (np.append(out, 0)[unit_at] == SPACE)
        else:
            out, origin, unit, borders = data, np.arange(len(data)), np.arange(len(data)), offsets
            leading = bare = data == SPACE
            starts = origin
        keep = np.ones(len(out), bool)
        # Where the part of each text begins that is not skipped as leading white space.
        begin = offsets[:-1].copy()
        if self.model.trim:
            after_space = np.concatenate([[True], out == SPACE])[unit]
            after_space[unit == borders[np.searchsorted(borders, unit, side="right") - 1]] = True
            keep &= ~(leading & after_space)
            solid = np.flatnonzero(~bare)
            place = np.searchsorted(solid, np.searchsorted(starts, offsets[:-1]))
            begin = np.minimum(np.append(starts[solid], len(data))[place], offsets[1:])
        # A space mark in the text is a space mark of the model; its first byte stays.
        mark = np.flatnonzero((out[:-2] == 0xE2) & (out[1:-1] == 0x96) & (out[2:] == 0x81)) if len(out) > 2 else np.zeros(0, np.int64)
        if len(mark):
            out = out.copy()
            out[mark] = SPACE
            keep[mark + 1] = keep[mark + 2] = False
        end_origin = offsets[1:].copy()
        kept = np.concatenate([[0], np.cumsum(keep)])
        out, origin, borders = out[keep], origin[keep], kept[borders]
        prefixed = (offsets[1:] > begin) & self.model.dummy_prefix
        if self.model.trim:
            solid = np.concatenate([[0], np.flatnonzero(out != SPACE) + 1])
            last = solid[np.searchsorted(solid, borders[1:], side="right") - 1]
            last = np.maximum(last, borders[:-1])
            end_origin = np.where(last < borders[1:], np.append(origin, 0)[np.minimum(last, len(origin))], end_origin)
            keep = np.zeros(len(out) + 1, np.int64)
            np.add.at(keep, borders[:-1], 1)
            np.add.at(keep, last, -1)
            keep = np.cumsum(keep)[:-1] > 0
            prefixed &= last > borders[:-1]
            kept = np.concatenate([[0], np.cumsum(keep)])
            out, origin, borders = out[keep], origin[keep], kept[borders]
        at = borders[:-1][prefixed]
        out = np.insert(out, at, SPACE)
        origin = np.insert(origin, at, begin[prefixed])
        borders = borders + np.concatenate([[0], np.cumsum(prefixed)])
        return out, borders, np.insert(origin, borders[1:], end_origin), rows


class Encoder:
    """Piece ids and places of the texts of a batch."""

    def __init__(self, model: Model):
        self.model, self.normal = model, Normalizer(model)
        n = len(model.texts)
        usable = [i for i, k in enumerate(model.kinds) if k in (NORMAL, USER_DEFINED)]
        #: Numbers of symbols: pieces, then characters without a piece, then user-defined pieces, which never merge.
        self.n, self.frozen, self.width = n, n + 0x110000, 2 * n + 0x110000
        self.piece = {model.texts[i].replace(MARK, " "): i for i in usable}
        self.byte_id = {model.texts[i]: i for i, k in enumerate(model.kinds) if k == BYTE}
        self.byte_ids = np.array([self.byte_id.get(f"<0x{b:02X}>", model.unknown) for b in range(256)])
        order = {s: r for r, s in enumerate(sorted({model.scores[i] for i in usable}, reverse=True))}
        self.rank = np.zeros(n, np.int64)
        self.size = np.zeros(n, np.int64)
        pairs, beside = {}, set()
        for text, i in self.piece.items():
            self.rank[i], self.size[i] = order[model.scores[i]], len(text.encode())
            beside.update(zip(text, text[1:], strict=False))
            for cut in range(1, len(text)):
                left, right = self._number(text[:cut]), self._number(text[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = i
        self.pairs = PairTable(pairs)
        self.single = np.arange(0x110000, dtype=np.int64) + n
        self.sign = np.zeros(n, np.int64)
        for text, i in self.piece.items():
            if len(text) == 1:
                self.single[ord(text)], self.sign[i] = i, ord(text)
        self.beside = PairTable({(ord(a) << 21) | ord(b): 1 for a, b in beside})
        self.apart = not any(b == " " and a != " " for a, b in beside)
        symbols = "|".join(map(re.escape, sorted(model.symbols, key=len, reverse=True)))
        self.symbols = re.compile(f"({symbols})") if symbols else None
        self.forget()

    def _number(self, text: str) -> int | None:
        found = self.piece.get(text)
        return found if found is not None else self.n + ord(text) if len(text) == 1 else None

    def forget(self) -> None:
        self.known = WordTable(KEPT_WORDS)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _symbols(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of words that lie behind each other, and the word of each."""
        if self.symbols is None:
            characters = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
            first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            return self.single[characters], np.repeat(np.arange(len(ends)), np.diff(first[ends], prepend=0))
        out, word, at = [], [], 0
        for i, end in enumerate(ends.tolist()):
            for k, part in enumerate(self.symbols.split(data[at:end].tobytes().decode())):
                numbers = [self.frozen + self.piece[part]] if k % 2 else self.single[list(map(ord, part))].tolist()
                out += numbers
                word += [i] * len(numbers)
            at = end
        return np.array(out, np.int64), np.array(word, np.int64)

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair of symbols, -1 where there is none."""
        return self.pairs(left * self.width + right)

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """One stretch, merged with a heap."""
        after = [*range(1, len(symbols)), -1]
        before = [-1, *range(len(symbols) - 1)]
        first = self._join(np.array(symbols[:-1]), np.array(symbols[1:]))
        heap = [(int(self.rank[p]), i, p, symbols[i], symbols[i + 1]) for i, p in enumerate(first.tolist()) if p >= 0]
        heapify(heap)
        look: dict[int, int] = {}

        def push(i: int, j: int) -> None:
            key = symbols[i] * self.width + symbols[j]
            if key not in look:
                look[key] = int(self.pairs(np.array([key]))[0])
            p = look[key]
            if p >= 0:
                heappush(heap, (int(self.rank[p]), i, p, symbols[i], symbols[j]))

        while heap:
            _, i, p, left, right = heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], symbols[j] = p, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                push(i, after[j])
            after[j] = -1
            if before[i] >= 0:
                push(before[i], i)
        return [s for s in symbols if s >= 0]

    def _merge(self, symbols: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Many short stretches side by side: the best pair of each is merged in every step."""
        done = []
        pair = np.full(len(symbols), -1)
        same = np.flatnonzero(group[1:] == group[:-1])
        pair[same] = self._join(symbols[same], symbols[same + 1])
        never = np.int64(1) << 62
        while len(symbols):
            n = len(symbols)
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            best = np.minimum.reduceat(np.where(pair >= 0, self.rank[pair] * n + np.arange(n), never), first)
            open_ = best < never
            part = np.repeat(open_, np.diff(first, append=n))
            done.append((group[~part], symbols[~part]))
            at = best[open_] % n
            symbols[at] = pair[at]
            part[at + 1] = False
            shift = np.cumsum(part) - 1
            symbols, group, pair, at = symbols[part], group[part], pair[part], shift[at]
            pair[at] = -1
            right = at[at + 1 < len(symbols)]
            right = right[group[right] == group[right + 1]]
            pair[right] = self._join(symbols[right], symbols[right + 1])
            left = at[at > 0] - 1
            left = left[group[left] == group[left + 1]]
            pair[left] = self._join(symbols[left], symbols[left + 1])
        group = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
        symbols = np.concatenate([d[1] for d in done]) if done else symbols
        order = np.argsort(group, kind="stable")
        return symbols[order], group[order]

    def _encode_words(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and bytes of the pieces of some words, and the number of pieces of each."""
        symbols, word = self._symbols(data, ends)
        # Characters on both sides of a border that no piece spans; user-defined pieces stand alone.
        sign = np.where(symbols < self.n, self.sign[np.minimum(symbols, self.n - 1)], np.where(symbols < self.frozen, symbols - self.n, 0))
        key = (sign[:-1] << 21) | sign[1:]
        cut = np.concatenate([[True], (self.beside(key) < 0) | (word[1:] != word[:-1])])[: len(symbols)]
        stretch = np.cumsum(cut) - 1
        size = np.bincount(stretch) if len(stretch) else np.zeros(0, np.int64)
        word_of = word[cut]
        short = size[stretch] <= ABREAST
        out, group = self._merge(symbols[short], stretch[short])
        for k in np.flatnonzero(size > ABREAST).tolist():
            long = np.array(self._merge_long(symbols[stretch == k].tolist()), np.int64)
            out, group = np.concatenate([out, long]), np.concatenate([group, np.full(len(long), k)])
        order = np.argsort(group, kind="stable")
        out, group = out[order], group[order]
        ids, counts, sizes = self._ids(out)
        return ids, sizes, np.bincount(np.repeat(word_of[group], counts), minlength=len(ends))

    def _ids(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of symbols, how many each has, and the normal bytes of each id."""
        ids = np.where(symbols >= self.frozen, symbols - self.frozen, symbols)
        counts = np.ones(len(ids), np.int64)
        odd = np.flatnonzero((symbols >= self.n) & (symbols < self.frozen))
        sizes = self.size[np.where((symbols >= self.n) & (symbols < self.frozen), 0, ids)]
        texts = [chr(s - self.n).encode(errors="replace") for s in symbols[odd].tolist()]
        sizes[odd] = [len(t) for t in texts]
        ids[odd] = self.model.unknown
        if self.model.byte_fallback:
            counts[odd] = sizes[odd]
            last = np.cumsum(counts) - 1
            whole = sizes
            ids, sizes = np.repeat(ids, counts), np.zeros(counts.sum(), np.int64)
            # The last byte of a character stands for all of it.
            sizes[last] = whole
            for i, text in zip(odd.tolist(), texts, strict=True):
                ids[last[i] - len(text) + 1 : last[i] + 1] = self.byte_ids[list(text)]
        return ids.astype(np.int32), counts, sizes.astype(np.int32)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        size = ends - starts
        stop = np.cumsum(size)
        ids, sizes, counts = self._encode_words(data[np.arange(size.sum()) + np.repeat(starts - stop + size, size)], stop)
        start = np.cumsum(counts) - counts + len(self.ids)
        self.start, self.count = np.concatenate([self.start, start]), np.concatenate([self.count, counts])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])

    def __call__(self, column):
        """Ids, first and last byte of each piece in its text, and the borders of the texts."""
        data, offsets = wd.text_bytes(column)
        normal, borders, origin, rows = self.normal(data, offsets)
        if self.known.total > KEPT_WORDS:
            self.forget()
        begins = np.zeros(len(normal), bool)
        if self.apart:
            begins[1:] = (normal[1:] == SPACE) & (normal[:-1] != SPACE)
        begins[borders[:-1][borders[:-1] < len(normal)]] = True
        starts = np.flatnonzero(begins)
        stops = np.append(starts[1:], len(normal))[: len(starts)]
        padded = np.concatenate([normal, np.zeros(16, np.uint8)])
        which, new = self.known(padded, starts, stops)
        long = False
        if len(new):
            long = int((stops[new] - starts[new]).max()) > KEPT_BYTES
            self._learn(padded, starts[new], stops[new])
        per_text = np.searchsorted(starts, borders)
        counts = self.count[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        index = np.arange(ends[-1]) + np.repeat(self.start[which] - ends[:-1], counts)
        ids, texts = self.ids[index], ends[per_text]
        # Places of the normal text have one entry more for each text before them.
        row = np.repeat(np.arange(rows), np.diff(texts))
        sizes = self.sizes[index]
        high = origin[np.cumsum(sizes) + row] - offsets[row]
        low = np.empty_like(high)
        low[1:] = high[:-1]
        first = texts[:-1][np.diff(texts) > 0]
        low[first] = origin[borders[row[first]] + row[first]] - offsets[row[first]]
        if long:
            self.forget()
        if not self.model.byte_fallback and len(ids):
            first = np.concatenate([[True], (ids[1:] != self.model.unknown) | (ids[:-1] != self.model.unknown) | (row[1:] != row[:-1])])
            last = np.append(first[1:], True)
            texts = np.concatenate([[0], np.cumsum(first)])[texts]
            ids, low, high = ids[first], low[first], high[last]
        return ids, low, high, texts


class Decoder:
    """Texts of lists of piece ids."""

    def __init__(self, model: Model):
        self.model = model
        surfaces = []
        for text, kind in zip(model.texts, model.kinds, strict=True):
            if kind == BYTE:
                surfaces.append(bytes([int(text[1:-1], 16)]))
            elif kind == CONTROL:
                surfaces.append(b"")
            else:
                surfaces.append(model.unknown_surface if kind == UNKNOWN else text.replace(MARK, " ").encode())
        self.size = np.array([len(s) for s in surfaces])
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(surfaces), np.uint8)
        kinds = np.array(model.kinds)
        self.byte = kinds == BYTE
        self.marked = np.array([t.startswith(MARK) for t in model.texts]) & np.isin(kinds, (NORMAL, USER_DEFINED))
        self.breaks = self.size == 0
        self.strips = model.dummy_prefix or model.trim

    def _skipped(self, ids: np.ndarray) -> np.ndarray:
        """Which pieces at the beginning of a text lose their space mark."""
        out = []
        for k, i in enumerate(ids.tolist()):
            if self.byte[i]:
                break
            if self.marked[i]:
                out.append(k)
                if not self.model.trim:
                    break
            if self.size[i] > (1 if self.marked[i] else 0):
                break
        return np.array(out, np.int64)

    def _mended(self, data: bytes, byte: np.ndarray, stop: np.ndarray) -> bytes:
        """The text with every byte of byte pieces that is no part of a character replaced."""
        try:
            data.decode()
            if not stop.any():
                return data
        except UnicodeDecodeError:
            pass
        out, at = bytearray(), 0
        while at < len(data):
            if not byte[at]:
                out.append(data[at])
                at += 1
                continue
            for size in (1, 2, 3, 4):
                part = data[at : at + size]
                if byte[at : at + size].all() and len(part) == size and not stop[at + 1 : at + size].any():
                    try:
                        part.decode()
                    except UnicodeDecodeError:
                        continue
                    out += part
                    at += size
                    break
            else:
                out += b"\xef\xbf\xbd"
                at += 1
        return bytes(out)

    def __call__(self, ids: np.ndarray, borders: np.ndarray) -> tuple[bytearray, list[int]]:
        """The bytes of all texts and where each ends."""
        size, start = self.size[ids], self.start[ids]
        if self.strips:
            for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                skipped = self._skipped(ids[a : min(b, a + 64)]) + a
                if len(skipped) == 64:
                    skipped = self._skipped(ids[a:b]) + a
                size[skipped] -= 1
                start[skipped] += 1
        # Bytes on both sides of a piece without text are no parts of one character.
        apart = np.flatnonzero(self.breaks[ids[1:]] & self.byte[ids[:-1]]) if len(ids) else ids
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.pool[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)]
        byte = np.repeat(self.byte[ids], size)
        raw, stop = data.tobytes(), np.isin(np.arange(len(data) + 1), ends[apart + 1])
        ends = ends[borders].tolist()
        try:
            if not len(apart):
                raw.decode()
                return bytearray(raw), ends[1:]
        except UnicodeDecodeError:
            pass
        out, stops = bytearray(), []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            out += self._mended(raw[a:b], byte[a:b], stop[a : b + 1])
            stops.append(len(out))
        return out, stops


def _lists(values: np.ndarray, borders: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(values, pa.int32()))


_encoders: dict[str, Encoder] = {}


def encoder_at(path: str) -> Encoder:
    """The encoder of a model; a process that runs several tasks keeps it and the words it knows."""
    if path not in _encoders:
        _encoders[path] = Encoder(Model.at(path))
    return _encoders[path]


def _encode(path: str):
    def run(batches):
        encoder = encoder_at(path)
        for block in wd.blocks(batches, limit=BLOCK_TEXT):
            ids, low, high, borders = encoder(block.column(1))
            columns = [block.column(0), *(_lists(v, borders) for v in (ids, low, high))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "begins", "ends"])

    return run


def _decode(path: str, names: list[str], column: str):
    def run(batches):
        decoder = Decoder(Model.at(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                block = batch.slice(at, 256)
                lists = block.column(block.schema.get_field_index(column))
                sizes = np.array([len(x) if x.is_valid else 0 for x in lists])
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                out, ends = decoder(ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
                offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64))
                text = pa.LargeStringArray.from_buffers(len(ends), offsets, pa.py_buffer(out)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*block.columns, text], [*names, "decoded"])

    return run


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids, begins, ends``: the pieces of every text and the bytes each stands for."""
    schema = "doc_id long, ids array<int>, begins array<int>, ends array<int>"
    return ids_and_texts(docs).mapInArrow(_encode(model_path), schema)


def decoded(rows: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with the column ``decoded``: the text of its ids."""
    schema = StructType([*rows.schema.fields, StructField("decoded", StringType())])
    return rows.mapInArrow(_decode(model_path, rows.columns, ids), schema)


def digest(rows: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded rows."""
    joined = F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary")
    rows = rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), "ids")
    text = F.col("decoded").cast("binary")
    return decoded(rows, model_path).select("doc_id", "n_tokens", "ids_sha256", F.sha2(text, 256).alias("decoded_sha256"))
