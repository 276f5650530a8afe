"""Word and shingle hashing over the byte buffers of Arrow string columns.

Everything here works on whole texts. A batch is cut into blocks of whole documents of
about ``BLOCK`` bytes so that a task's memory depends on the block and on the longest
single text, never on the number of rows in a batch.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
BLANK = re.compile(rb"[\x20\x09-\x0D]")

# Bytes of words cut at [\x20\x09-\x0D]; A-Z become a-z.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
# Bytes of words of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x):
    """Finalise 64-bit hashes so that every bit depends on every input bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_KEYS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
# Odd multipliers, one for each place within a shingle.
PLACES = mix(np.arange(1001, 1065, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def _powers(base, n):
    table = np.full(n, base, np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


_POWERS = _powers(_BASE, BLOCK)
_INVERSES = _powers(_BASE_INVERSE, BLOCK)


def strings(column):
    """An Arrow string column as (bytes, offsets); nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column, limit=BLOCK):
    """Yield (first row, row after the last, bytes, offsets from 0) of whole texts."""
    if not len(column):
        return
    data, offsets = strings(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end
    pa.default_memory_pool().release_unused()  # else a worker keeps the largest batch it has met


def raw_texts(column):
    """The bytes of each text of an Arrow string column; nulls are empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def pieces(raw, size=BLOCK):
    """``raw`` in slices of about ``size`` bytes, each but the first beginning with a blank."""
    at = 0
    while at < len(raw):
        cut = BLANK.search(raw, at + size) if len(raw) - at > size else None
        end = cut.start() if cut else len(raw)
        yield raw[at:end]
        at = end


def word_bounds(data, offsets, word_byte):
    """Starts, ends and text numbers of the words in a block."""
    inside = word_byte[data]
    if not inside.any():
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing
    filled = offsets[:-1][np.diff(offsets) > 0]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[filled] = inside[filled]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def hash_spans(data, starts, ends):
    """64-bit hashes of byte spans that do not overlap, in order."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    keys = _BYTE_KEYS[data]
    if n <= BLOCK:
        keys *= _POWERS[:n]
        back = _INVERSES[starts]
    else:
        # one long text: count powers from each span's own start
        place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))[:n] if starts[0] == 0 else None
        if place is None:
            place = np.arange(n) - np.concatenate(
                [np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, n)))])
        keys *= _powers(_BASE, int(place.max()) + 1)[place]
        back = np.uint64(1)
    outside = np.zeros(n + 1, np.int8)
    outside[starts] += 1
    outside[ends] -= 1
    keys[np.cumsum(outside[:n]) == 0] = 0
    return mix(np.add.reduceat(keys, starts) * back + (ends - starts).astype(np.uint64))


def word_hashes(data, offsets, word_byte=NOT_SPACE, lower=True):
    """(hash, text number, start, end) of each word of a block; A-Z count as a-z."""
    if lower:
        data = LOWER[data]
    starts, ends, doc = word_bounds(data, offsets, word_byte)
    return hash_spans(data, starts, ends), doc, starts, ends


def shingle_hashes(words, doc, n_docs, width=5):
    """(hash, text number) of the word shingles, in text order.

    A text with fewer than ``width`` words, but not none, has its whole sequence as one.
    """
    n = len(words)
    counts = np.bincount(doc, minlength=n_docs)
    whole, whole_doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= width:
        total = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            total += words[j:n - width + 1 + j] * PLACES[j]
        same = doc[:n - width + 1] == doc[width - 1:]
        whole, whole_doc = mix(total[same]), doc[:n - width + 1][same]
    short = (counts > 0) & (counts < width)
    if not short.any():
        return whole, whole_doc
    picked = np.flatnonzero(short[doc])
    begin = np.concatenate([[0], np.cumsum(counts)])[doc[picked]]
    terms = words[picked] * PLACES[picked - begin]
    heads = np.flatnonzero(picked == begin)
    short_doc = doc[picked[heads]]
    sums = np.add.reduceat(terms, heads) + counts[short_doc].astype(np.uint64) * PLACES[-1]
    every, every_doc = np.concatenate([whole, mix(sums)]), np.concatenate([whole_doc, short_doc])
    order = np.argsort(every_doc, kind="stable")
    return every[order], every_doc[order]


def sets_of(hashes, doc, n_docs):
    """The sorted distinct hashes of each text, and their bounds."""
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    return sets
