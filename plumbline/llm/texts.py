"""Helpers of the operators that read whole texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Words that a task works on at a time, unless one text is longer.
TOGETHER = 1_500_000


def grouped(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of some TOGETHER words at most (six bytes each)."""
    for batch in batches:
        if batch.num_rows:
            sizes = np.cumsum(pa.compute.binary_length(batch.column(text_at)).fill_null(0).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(sizes // (6 * TOGETHER))) + 1).tolist(), batch.num_rows]
            yield from (batch.slice(i, j - i) for i, j in zip(cuts, cuts[1:], strict=False))


def runs(*breaks: np.ndarray) -> np.ndarray:
    """Where runs start, from arrays that say of each row but the first whether it breaks with the one before."""
    broken = np.logical_or.reduce(breaks)
    return np.concatenate([[0], np.flatnonzero(broken) + 1])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def whole_groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.RecordBatch]:
    """The same rows, in batches that do not tear apart neighbours with equal numbers in column by."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(by).to_numpy()
        if held and held[0].column(by)[0].as_py() != names[0]:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        others = np.flatnonzero(names != names[-1])
        last = int(others[-1]) + 1 if len(others) else 0
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

#: Fixed value: A-Z lower-cased, digits, a-z and all beyond ASCII kept, any other byte a space.
TERM_BYTES = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The runs of digits, letters a-z and signs beyond ASCII in the UTF-8 text, A-Z lower-cased; null has none."""
    return text.translate(TERM_BYTES).split() if text else []


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()
