"""Fill-in-middle texts by rotating blocks in place.

A text is cut at two of its token borders into prefix, middle and suffix; the tokens are runs of
ASCII letters and single other characters. The texts of a batch are copied to one bytearray with
the sentinels in their first places, ``<P>prefix<M>middle<S>suffix``, and the blocks change
places there: a rotation is three reversals, the two parts first and then both together.
``psm`` rotates middle and suffix, ``spm`` the suffix before all else. Restoring finds the
sentinels, runs the inverse rotation and takes the sentinels out, so the text comes back
from the output and its form alone.

The cuts and the form follow from the hash of ``seed:doc_id``, so they are the same in every run.

Defined results: a null text is an empty one; an empty text and one that holds a sentinel stay
plain, which is their own output, and have no cuts. Rows without doc_id hash as ``seed:``;
rows that share an id share its draws, each over its own text. Rows are never joined, grouped or
shuffled; other columns of the table are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lingospan.llm import words as wd
from lingospan.llm.tables import ids_and_texts

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
PLAIN_FROM, SPM_BELOW = 90, 20
#: Bytes that a reversal holds beside the text.
SWAP = 1 << 16

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def token_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each token of a batch of texts begins, and the first token of each text."""
    letter = _LETTER[data]
    start = ~letter & ((data & 0xC0) != 0x80)
    start[1:] |= letter[1:] & ~letter[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    start[inner] = True
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(starts, offsets)


def draws(seed: int, doc_id) -> list[int]:
    """Four numbers below 2**32 from the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def reverse(view: np.ndarray, a: int, b: int) -> None:
    """Reverse the bytes from a to b, a bounded piece of both ends at a time."""
    while b - a > 1:
        step = min(SWAP, (b - a) // 2)
        head = view[a : a + step].copy()
        view[a : a + step] = view[b - step : b][::-1]
        view[b - step : b] = head[::-1]
        a, b = a + step, b - step


def rotate(view: np.ndarray, a: int, m: int, b: int) -> None:
    """Exchange the neighbouring blocks a..m and m..b in place."""
    reverse(view, a, m)
    reverse(view, m, b)
    reverse(view, a, b)


def _holds_sentinel(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold one of the sentinels."""
    at = np.flatnonzero(data[:-2] == ord("<")) if len(data) > 2 else np.zeros(0, np.int64)
    at = at[(data[at + 2] == ord(">")) & np.isin(data[at + 1], [s[1] for s in (PREFIX, SUFFIX, MIDDLE)])]
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at + 3 <= offsets[row + 1]
    return np.isin(np.arange(len(offsets) - 1), row[inside])


def _string_column(buffer: bytearray, ends: list[int]) -> pa.Array:
    """A string column over the bytes of a batch."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    column = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(buffer))
    return column.cast(pa.string())


def _transform(seed: int):
    def run(batches):
        for block in wd.blocks(batches):
            data, offsets = wd.text_bytes(block.column(1))
            starts, first = token_starts(data, offsets)
            characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            holds, source = _holds_sentinel(data, offsets), memoryview(data)
            out, ends = bytearray(), []
            counts, forms, lengths = [], [], []
            turns = []
            for i, doc_id in enumerate(block.column(0).to_pylist()):
                a, b, n = int(offsets[i]), int(offsets[i + 1]), int(first[i + 1] - first[i])
                one, two, three, four = draws(seed, doc_id)
                counts.append(n)
                if not n or holds[i] or three % 100 >= PLAIN_FROM:
                    out += source[a:b]
                    forms.append(PLAIN)
                    lengths.append((None, None))
                else:
                    cuts = sorted((one % (n + 1), two % (n + 1)))
                    x, y = (int(starts[first[i] + c]) if c < n else b for c in cuts)
                    at = len(out)
                    out += PREFIX
                    out += source[a:x]
                    middle = len(out)
                    out += MIDDLE
                    out += source[x:y]
                    suffix = len(out)
                    out += SUFFIX
                    out += source[y:b]
                    forms.append(SPM if four % 100 < SPM_BELOW else PSM)
                    turns.append((at if forms[-1] == SPM else middle, suffix, len(out)))
                    lengths.append((int(characters[x] - characters[a]), int(characters[y] - characters[x])))
                ends.append(len(out))
            view = np.frombuffer(out, np.uint8)
            for turn in turns:
                rotate(view, *turn)
            prefix, middle = zip(*lengths, strict=True)
            columns = [block.column(0), pa.array(counts, pa.int64()), pa.array(forms, pa.string())]
            columns += [pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), _string_column(out, ends)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def _back(buffer: bytearray, a: int, b: int, form: str) -> list[tuple[int, int]]:
    """Undo the rotation of one text of the buffer; the parts of it that are no sentinels."""
    view = np.frombuffer(buffer, np.uint8)
    if form == SPM:
        border = buffer.index(PREFIX, a, b)
        rotate(view, a, border, b)
    elif form == PSM:
        suffix = buffer.index(SUFFIX, a, b)
        rotate(view, suffix, buffer.index(MIDDLE, suffix, b), b)
    else:
        return [(a, b)]
    middle = buffer.index(MIDDLE, a, b)
    suffix = buffer.index(SUFFIX, middle, b)
    return [(a + len(PREFIX), middle), (middle + len(MIDDLE), suffix), (suffix + len(SUFFIX), b)]


def _restore(names: list[str], output: str, form: str, restored: str):
    def run(batches):
        for block in wd.blocks(batches, output):
            data, offsets = wd.text_bytes(block.column(block.schema.get_field_index(output)))
            buffer = bytearray(data)
            forms = block.column(block.schema.get_field_index(form)).to_pylist()
            out, ends, source = bytearray(), [], memoryview(buffer)
            for i, kind in enumerate(forms):
                for x, y in _back(buffer, int(offsets[i]), int(offsets[i + 1]), kind):
                    out += source[x:y]
                ends.append(len(out))
            yield pa.RecordBatch.from_arrays([*block.columns, _string_column(out, ends)], [*names, restored])

    return run


def transformed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs``."""
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return ids_and_texts(docs).mapInArrow(_transform(seed), schema)


def restored(outputs: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``outputs`` with the column ``restored``: the text before the transformation."""
    names = outputs.columns
    schema = StructType([*outputs.schema.fields, StructField("restored", StringType())])
    return outputs.mapInArrow(_restore(names, output, form, "restored"), schema)


def digest(rows: DataFrame) -> DataFrame:
    """Hashes in place of the texts of ``restored``."""
    hashes = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


def oracle() -> str:
    """The digest in SQL."""
    tokens = "regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]')"
    group = "('0x' || substr(h, {}, 8))::BIGINT".format
    return f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, {tokens} AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT *, len(t)::BIGINT AS n, {group(1)} % (len(t) + 1) AS one, {group(9)} % (len(t) + 1) AS two,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR {group(17)} % 100 >= 90 THEN 'plain'
              WHEN {group(25)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT doc_id, n, form, text, array_to_string(t[1:least(one, two)], '') AS prefix,
         array_to_string(t[least(one, two) + 1:greatest(one, two)], '') AS middle,
         array_to_string(t[greatest(one, two) + 1:], '') AS suffix
  FROM drawn
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
