"""Operator 11: fill-in-middle by rotations of blocks in place.

A text is cut into lines, and two cuts, drawn from the document's id, part it into prefix, middle and
suffix. The text lies in a bytearray; a sentinel is put before each part. Blocks then change places by
rotation: the whole stretch and its two blocks are reversed, all in place. ``psm`` exchanges middle and
suffix, ``spm`` brings the suffix to the front. Restoring scans for the sentinels, rotates back and takes
the sentinels out, from output and form alone. A text that holds a sentinel already stays plain, so a
sentinel of the output is never one of the text.

Null and empty texts are plain and give an empty output. A very long text is one bytearray. Each row is
worked off by itself: repeated rows and repeated ids get the same cuts, an empty table gives no rows. A
null id draws its cuts from ``seed:`` with nothing behind it. Extra columns pass through; columns of the
names that are added are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .common import ship_code

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
_ADDED = "n long, form string, prefix_chars long, middle_chars long, output string"


def reverse(block: np.ndarray) -> None:
    """Turn a block of bytes round in place, half of it at a time."""
    half = len(block) // 2
    head = block[:half].copy()
    block[:half] = block[len(block) - half :][::-1]
    block[len(block) - half :] = head[::-1]


def rotate(data: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange the neighbouring blocks start..cut and cut..end by three reversals."""
    view = np.frombuffer(data, np.uint8)[start:end]
    reverse(view)
    reverse(view[: end - cut])
    reverse(view[end - cut :])


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def line_ends(data: bytes | bytearray) -> np.ndarray:
    """The byte after every line; text behind the last newline is a line too."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return np.append(ends, len(data)) if len(data) and data[-1] != 10 else ends


def characters(data: bytearray, start: int, end: int) -> int:
    """Code points of a stretch: bytes that don't continue one."""
    return int(((np.frombuffer(data, np.uint8)[start:end] & 0xC0) != 0x80).sum())


def transform(data: bytearray, drawn: list[int], percent: int, percent_spm: int) -> tuple[int, str, int | None, int | None]:
    """Bring a text into its form, in place: (lines, form, characters of the prefix, of the middle)."""
    ends = line_ends(data)
    n = len(ends)
    if not data or any(s in data for s in SENTINELS) or drawn[2] % 100 >= percent:
        return n, "plain", None, None
    first, second = sorted((drawn[0] % (n + 1), drawn[1] % (n + 1)))
    a, b = (int(ends[u - 1]) if u else 0 for u in (first, second))
    sizes = characters(data, 0, a), characters(data, a, b)
    for at, sentinel in ((b, SUFFIX), (a, MIDDLE), (0, PREFIX)):
        data[at:at] = sentinel
    middle, suffix = a + len(PREFIX), b + len(PREFIX) + len(MIDDLE)
    if drawn[3] % 100 < percent_spm:
        rotate(data, 0, suffix, len(data))
        return n, "spm", *sizes
    rotate(data, middle, suffix, len(data))
    return n, "psm", *sizes


def restore(data: bytearray, form: str) -> None:
    """Turn an output into its text again, in place."""
    if form == "plain":
        return
    if form == "psm":
        start, cut = data.index(SUFFIX), data.index(MIDDLE)
    elif form == "spm":
        start, cut = 0, data.index(PREFIX)
    else:
        raise ValueError(f"no such form: {form}")
    rotate(data, start, cut, len(data))  # now prefix, middle and suffix, each behind its sentinel
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = data.rindex(sentinel)
        del data[at : at + len(sentinel)]


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary()):
        yield value.as_py()


def _kept(docs: DataFrame, names: list[str]) -> list[str]:
    """Columns of ``docs`` that the added ``names`` don't replace."""
    return [c for c in docs.columns if c.lower() not in names]


def _schema(rows: DataFrame, added: str) -> str:
    """The columns behind the first two, which the worker passes on, and the added ones."""
    return ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[2:]), added])


def fill_in_middle(docs: DataFrame, seed: str = "7", percent: int = 100, percent_spm: int = 50) -> DataFrame:
    """``docs`` with n (lines), form, prefix_chars, middle_chars and output; ``percent`` of the texts are cut."""
    ship_code(docs.sparkSession)
    new = [x.split()[0] for x in _ADDED.split(", ")]
    kept = _kept(docs, new)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"), *(F.col(f"`{c}`").alias(f"held{i}") for i, c in enumerate(kept)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in k.row_slices(whole, 1):
                found = []
                for doc_id, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                    data = bytearray(text)
                    found.append((*transform(data, draws(doc_id, seed), percent, percent_spm), data.decode()))
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                made = [pa.array(values, t) for values, t in zip(zip(*found, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], *made], names=[*batch.schema.names[2:], *new])

    return rows.mapInArrow(run, _schema(rows, _ADDED)).select(*(F.col(f"held{i}").alias(c) for i, c in enumerate(kept)), *new)


def restored(outputs: DataFrame) -> DataFrame:
    """``outputs`` with ``restored``, the text that each output and its form stand for."""
    ship_code(outputs.sparkSession)
    kept = _kept(outputs, ["restored"])
    rows = outputs.select(F.col("form").alias("_form"), F.col("output").alias("_output"), *(F.col(f"`{c}`").alias(f"held{i}") for i, c in enumerate(kept)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in k.row_slices(whole, 1):
                texts = []
                for form, output in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                    data = bytearray(output)
                    restore(data, form)
                    texts.append(data.decode())
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(texts, pa.string())], names=[*batch.schema.names[2:], "restored"])

    return rows.mapInArrow(run, _schema(rows, "restored string")).select(*(F.col(f"held{i}").alias(c) for i, c in enumerate(kept)), "restored")


ORACLE = r"""
with t as (select doc_id, coalesce(text, '') t, sha256('7:' || coalesce(doc_id::varchar, '')) s from documents),
h as (select *, [list_sum([(strpos('0123456789abcdef', s[8 * g + i]) - 1) * (1::bigint << (4 * (8 - i))) for i in range(1, 9)])::bigint for g in range(0, 4)] h,
  regexp_extract_all(t, '[^\n]*\n|[^\n]+') u from t),
c as (select *, len(u) n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 100 then 'plain' when h[4] % 100 < 50 then 'spm' else 'psm' end form from h),
p as (select *, coalesce(array_to_string(u[1:a], ''), '') p, coalesce(array_to_string(u[a + 1:b], ''), '') m, coalesce(array_to_string(u[b + 1:n], ''), '') s3 from c)
select doc_id, n::bigint n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s3 || '<M>' || m else '<S>' || s3 || '<P>' || p || '<M>' || m end) output_sha256, sha256(t) restored_sha256
from p"""
