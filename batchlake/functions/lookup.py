"""Texts and their words' numbers as Arrow arrays, a block of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20  # of a block's texts or ids, for which there are words, masks and places at a time
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in " \t\n\r\f"]] = True


def one(column: pa.ChunkedArray) -> pa.Array:
    """A column in one piece."""
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def release() -> None:
    """Gives memory back that the pool keeps, as a worker lives on beside others."""
    pa.default_memory_pool().release_unused()


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """The column in slices of about SLICE_BYTES, at least one."""
    rows = max(1, len(column) * SLICE_BYTES // max(column.nbytes, 1))
    for k in range(0, max(len(column), 1), rows):
        yield column.slice(k, rows)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, where each text's begin and the last one's end); a null text has none. As vocab.tokens() splits."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = ~_SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    first[heads] |= inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts = np.flatnonzero(first)
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - starts)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return words, np.searchsorted(starts, at)


def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(__block, word) of rows (__block, __text), each once a batch."""
    for b in batches:
        block, texts = b.column("__block").to_numpy(), b.column("__text")
        for k in np.unique(block):
            words = pc.unique(pa.concat_arrays([pc.unique(split(x)[0]) for x in slices(texts.filter(pa.array(block == k)))]))
            yield pa.record_batch([pa.array(np.full(len(words), k, np.int64)), words.cast(pa.string())], ["__block", "word"])
        del b, texts
        release()


def distinct_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(__block, id) of rows (__block, __ids), each once a batch."""
    for b in batches:
        block, lists = b.column("__block").to_numpy(), b.column("__ids")
        for k in np.unique(block):
            ids = pc.unique(pc.list_flatten(lists.filter(pa.array(block == k)))).drop_null()
            yield pa.record_batch([pa.array(np.full(len(ids), k, np.int64)), ids], ["__block", "id"])
        del b, lists
        release()


def _lists(at: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)


def text_ids(texts: pa.Array, known: pa.Table, limit: int | None = None) -> pa.Array:
    """The ids of each text's (first `limit`) words, which must all be among `known` (word, id)."""
    words, ids = (one(known.column("word")).cast(pa.large_string()), one(known.column("id"))) if known.num_rows else (pa.array([], pa.large_string()), pa.array([], pa.int64()))
    return pa.concat_arrays([_text_ids(x, words, ids, limit) for x in slices(texts)])


def _text_ids(texts: pa.Array, known: pa.Array, ids: pa.Array, limit: int | None) -> pa.Array:
    words, at = split(texts)
    if limit is not None:
        n = np.diff(at)
        words = words.filter(pa.array(np.arange(len(words)) - np.repeat(at[:-1], n) < limit))
        at = np.concatenate([[0], np.cumsum(np.minimum(n, limit))])
    got = pc.take(ids, pc.index_in(words, value_set=known))
    assert not got.null_count, "a word of the block was not looked up"
    return _lists(at, got)


def id_texts(lists: pa.Array, known: pa.Table) -> pa.Array:
    """The words of each list's ids, joined by blanks; ids that are not among `known` (word, id) are left out."""
    if not known.num_rows:
        return pa.array([""] * len(lists), pa.string())
    words, ids = one(known.column("word")), one(known.column("id"))
    return pa.concat_arrays([_id_texts(x, words, ids) for x in slices(lists)])


def _id_texts(lists: pa.Array, known: pa.Array, ids: pa.Array) -> pa.Array:
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    words = pc.take(known, pc.index_in(pc.list_flatten(lists), value_set=ids))
    there = np.concatenate([[0], np.cumsum(pc.is_valid(words).to_numpy(zero_copy_only=False))])
    return pc.binary_join(_lists(there[np.concatenate([[0], np.cumsum(n)])], words.drop_null()), " ")


def pair_counts(before: np.ndarray, lists: pa.Array, columns: int, steps: int) -> pa.Table:
    """(cur, next, freq) of neighbours within lists whose first value is the before-th (from 0) of a sequence that is folded into columns of `steps`.

    A list's last value has no next one there: it is the first one of a later list, or the last of all. Ids are below 2^31.
    """
    flat, n = pc.list_flatten(lists).to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    if len(flat) and flat.max() >= 1 << 31:
        raise ValueError("ids beyond 2^31")
    ends = np.cumsum(n, dtype=np.int64)
    p = np.repeat(before - (ends - n), n)
    p += np.arange(len(flat))
    keep = (p < steps * columns) & (p % max(steps, 1) < steps - 1)
    keep[ends[n > 0] - 1] = False  # there is no next value in the list
    del p
    pairs = (flat[:-1] << 32 | flat[1:])[keep[:-1]]
    pairs.sort()
    heads = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    freq, pairs = np.diff(np.append(heads, len(pairs))), pairs[heads]
    return pa.table({"cur": pairs >> 32, "next": pairs & 0xFFFFFFFF, "freq": freq.astype(np.int64)})
