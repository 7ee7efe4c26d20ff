"""Words of whole Arrow text batches as 64-bit hashes, by numpy over the UTF-8 bytes.

A word is a run of bytes that are no separators; all separators are ASCII, so a run never splits a character. Its
hash is a polynomial over its bytes modulo 2**64, mixed; equal hashes stand for equal words from here on.
"""

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD64 = 1 << 64


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits (one to one for a given seed)."""
    h = h + np.uint64(seed)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def byte_table(separators: bytes | range | list, fold_case: bool = True) -> np.ndarray:
    """A 64-bit value for each byte: 0 for separators, the same for both cases of A-Z."""
    values = mix(np.arange(1, 257, dtype=np.uint64), 0x5851F42D4C957F2D) | np.uint64(1)
    if fold_case:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    values[list(separators)] = 0
    return values


#: Words are what stands between ASCII white space.
SPACES = [0x20, *range(0x09, 0x0E)]
#: Words are runs of a-z, 0-9 and everything beyond ASCII.
PUNCTUATION = [b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)]


@dataclass
class Block:
    """Consecutive rows. Word i of the block has hashes[i] and covers bytes starts[i] to ends[i]; row r has the words
    bounds[r] to bounds[r + 1] and the bytes offsets[r] to offsets[r + 1]."""

    first_row: int
    data: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows in them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        offsets = np.zeros(1, np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes each; a longer row stands alone."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, min(end, rows)
        row = end


SLICE_BYTES = 1 << 22

#: What operators keep in a worker between batches: a name and a function that drops it.
_kept: dict = {}


def keep(name: str, drop) -> None:
    """Register what the operator `name` keeps; it is dropped when the worker serves another operator."""
    for other in [k for k in _kept if k != name]:
        _kept.pop(other)()
    _kept[name] = drop


def give_back() -> None:
    """Return freed pages to the system: several workers share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _find_trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not every system has it
        return None


_trim = _find_trim()


def in_slices(of, texts: pa.Array, most: int = SLICE_BYTES, name: str = "") -> pa.Array:
    """of(texts), worked out for a few rows at a time: what a task holds besides the batch does not grow with it. `name`: the
    operator, if it keeps something between batches."""
    keep(name, lambda: None) if name not in _kept else None
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    parts = [of(texts.slice(low, high - low)) for low, high in row_blocks(offsets, most)]
    out = pa.concat_arrays(parts) if parts else of(texts)
    give_back()
    return out


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse; those of a text longer than a block are not kept."""
    if len(_powers[0]) >= n:
        return _powers
    made = []
    for base in (_BASE, pow(_BASE, -1, _WORD64)):
        steps = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if n <= BLOCK_BYTES + 1:
        _powers[:] = made
    return made


_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARKS = np.zeros(256, bool)
_MARKS[[b for b in PUNCTUATION if b not in SPACES]] = True
#: Code points from 0xC0 to 0x17F that stay letters in lower case: all but the two signs and the dotted I.
_LATIN = np.zeros(0x180, bool)
_LATIN[0xC0:] = True
_LATIN[[0xD7, 0xF7, 0x130]] = False


def _marks_after_letters(data: np.ndarray) -> np.ndarray:
    """Where an ASCII mark follows an ASCII letter or one of _LATIN, which have two bytes from 0xC3 to 0xC5 on."""
    at = np.flatnonzero(_MARKS[data])
    at = at[at > 0]
    last, lead = data[at - 1], data[np.maximum(at - 2, 0)]
    latin = (lead >= 0xC3) & (lead <= 0xC5) & (last >= 0x80)
    points = ((lead & 0x1F).astype(np.int64) << 6) | (last & 0x3F)
    latin[latin] = _LATIN[points[latin]]
    return at[_LETTERS[last] | latin]


def word_blocks(texts: pa.Array, table: np.ndarray, most: int = BLOCK_BYTES, cut_marks: bool = False) -> Iterator[Block]:
    """The words of all rows. With `cut_marks` a word also ends where an ASCII mark follows a Latin letter."""
    data, offsets = text_bytes(texts)
    for first, end in row_blocks(offsets, most):
        own = data[offsets[first] : offsets[end]]
        at = offsets[first : end + 1] - offsets[first]
        values = table[own]
        inside = values != 0
        n = len(own)
        breaks = np.zeros(n + 1, bool)
        breaks[at] = True
        if cut_marks:
            breaks[_marks_after_letters(own)] = True
        before = np.concatenate(([False], inside[:-1])) & ~breaks[:-1] if n else inside
        after = np.concatenate((inside[1:], [False])) & ~breaks[1:] if n else inside
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        if len(starts):
            powers, inverse = _power_tables(n)
            hashes = mix(np.add.reduceat(values * powers[:n], starts) * inverse[starts])
        else:
            hashes = np.zeros(0, np.uint64)
        yield Block(first, own, at, hashes, starts, ends, np.searchsorted(starts, at))


def shingle_hashes(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words of each row, and the bounds of the rows in them. A row with fewer words has
    one, for all of them; a row without words has none."""
    counts = np.diff(block.bounds)
    n = len(block.hashes)
    factors = mix(np.arange(size, dtype=np.uint64), 0xD1342543DE82EF95) | np.uint64(1)
    found = np.zeros(max(n - size + 1, 0), np.uint64)
    for j in range(size):
        found += block.hashes[j : j + len(found)] * factors[j]
    found = mix(found, size)
    shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate(([0], np.cumsum(shingles)))
    out = np.empty(bounds[-1], np.uint64)
    long_rows = np.where(counts >= size, shingles, 0)
    shift = np.repeat(block.bounds[:-1] - bounds[:-1], long_rows)
    places = np.repeat(bounds[:-1], long_rows) + count_up(long_rows)
    out[places] = found[places + shift]
    for row in np.flatnonzero((counts > 0) & (counts < size)):
        words = block.hashes[block.bounds[row] : block.bounds[row + 1]]
        out[bounds[row]] = mix((words * factors[: len(words)]).sum(keepdims=True), len(words))[0]
    return out, bounds


def count_up(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
