"""Words and hashes of many texts at once, on the bytes of an Arrow column.

Separators are ASCII bytes, so words never cut a UTF-8 sequence. A word hash sums mixed numbers of
eight bytes each, every one keyed by its place in the word; equal words have equal hashes in
every task and every run, and words of a pattern that a polynomial maps to one value do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers, the same in every process."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)


#: Words of more bytes are hashed one by one.
LONG = 256
#: The first bytes of a 64-bit number.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _grown(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def powers(kind: str, n: int) -> np.ndarray:
    """The first powers of the base of the polynomials ("up") or of its inverse ("down")."""
    return _grown(kind, _BASE if kind == "up" else _INVERSE, n)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches, text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray):
    """Start, end and text number of every word, and the first word of each text."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separator[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    # A word that runs over the border between two texts is two words.
    cut = inner[(inside[inner + 1] == 1) & (inside[inner] == 1)]
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    first = np.searchsorted(starts, offsets)
    return starts, ends, first


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the words between ``starts`` and ``ends``; other seeds give unrelated ones."""
    size = ends - starts
    out = size.astype(np.uint64) * _BASE
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    keys = mix(np.arange(1, LONG // 8 + 1, dtype=np.uint64) + np.uint64(seed << 40))
    left = np.flatnonzero((size > 0) & (size <= LONG))
    for part, key in enumerate(keys):
        if not len(left):
            break
        rest = size[left] - 8 * part
        out[left] += mix((eights[starts[left] + 8 * part] & FIRST_BYTES[np.minimum(rest, 8)]) ^ key)
        left = left[rest > 8]
    for i in np.flatnonzero(size > LONG).tolist():
        n = -(-int(size[i]) // 8)
        word = np.zeros(8 * n, np.uint8)
        word[: size[i]] = data[starts[i] : ends[i]]
        out[i : i + 1] += mix(word.view("<u8") ^ mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 40))).sum(dtype=np.uint64)
    return mix(out)
