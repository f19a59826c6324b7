"""Words, shingles and hashes of many texts at once, as numpy arrays over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Places in a word that have a random number for each byte; bytes beyond are scrambled with their place.
PLACES = 64
STEP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, start: int = 1) -> np.ndarray:
    return mix(np.arange(start, start + n, dtype=U) * U(0xD1342543DE82EF95))


def letters(fold: bool) -> np.ndarray:
    """A random number for each place and byte, one after the other; with ``fold``, A-Z share those of a-z."""
    table = seeds(PLACES * 256, 1000).reshape(PLACES, 256)
    if fold:
        table[:, 65:91] = table[:, 97:123]
    return table.ravel()


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))


def slices(column: pa.Array, most: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``most`` bytes: first and last row, bytes, and offsets into them. NULL is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def portions(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 * STEP) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, for work that makes Python objects of them."""
    for batch in batches:
        texts = batch.column(column).cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first = 0
        while first < len(batch):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
            yield batch.slice(first, min(last, len(batch)) - first)
            first = last


def spans(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, in bytes, and for each text the number of words before it (one more entry than texts)."""
    word = np.zeros(len(buf) + 1, bool)
    np.logical_not(separator[buf], out=word[:-1])
    begins = word[:-1].copy()
    begins[1:] &= ~word[:-2]
    edges = offsets[1:-1]
    edges = edges[edges < len(buf)]
    begins[edges] = word[edges]
    ends = word[:-1] & ~word[1:]
    cut = edges[edges > 0] - 1
    ends[cut] = word[cut]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    return range_hashes(buf, starts, ends, [ends], table)[0]


def _place_values(buf: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each byte, the random number of its place in its word and of itself; ``starts`` count from the first byte."""
    place = np.arange(len(buf)) - np.repeat(starts, np.diff(np.append(starts, len(buf))))
    values = table[((place & (PLACES - 1)) << 8) | buf]
    far = np.flatnonzero(place >= PLACES)
    if len(far):
        values[far] = mix(values[far] ^ ((place[far] // PLACES).astype(U) * U(0xD6E8FEB86659FD93)))
    return values


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, stops: list[np.ndarray], table: np.ndarray) -> list[np.ndarray]:
    """For each list of stops, hashes of the bytes of words from their start to there; summed up a megabyte at a time.

    The numbers of the bytes' places are random and not powers of one base, so no family of words shares a hash by its build.
    """
    out = [np.empty(len(starts), U) for _ in stops]
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, low + STEP)))
        high = int(ends[j - 1])
        sums = np.zeros(high - low + 1, U)
        at = starts[i:j] - low
        np.cumsum(_place_values(buf[low:high], at, table), out=sums[1:])
        for made, stop in zip(out, stops, strict=True):
            made[i:j] = sums[stop[i:j] - low] - sums[at]
        i = j
    return [mix(made + (stop - starts).astype(U)) for made, stop in zip(out, stops, strict=True)]


def shingle_hashes(words: np.ndarray, before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words, and per text the number before it. A text with fewer words is one run."""
    factor = seeds(size, 77) | U(1)
    counts = np.diff(before)
    n = len(words)
    full = np.zeros(max(n - size + 1, 0), U)
    for i in range(size if len(full) else 0):
        full += words[i : i + len(full)] * factor[i]
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    after = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(after[-1], U)
    long = np.flatnonzero(counts >= size)
    if len(long):  # positions of all full runs, text after text
        run = np.arange(made[long].sum()) - np.repeat(np.cumsum(made[long]) - made[long], made[long])
        out[np.repeat(after[:-1][long], made[long]) + run] = full[np.repeat(before[:-1][long], made[long]) + run]
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        part = words[before[d] : before[d + 1]]
        out[after[d]] = np.sum(np.append(part * factor[: len(part)], seeds(1, 500 + len(part))), dtype=U)
    return mix(out), after


def text_shingles(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per text, its row and the sorted distinct hashes of its shingles; words end at white space, A-Z is lower-cased."""
    table = letters(True)
    for first, last, buf, offsets in slices(column):
        starts, ends, before = spans(buf, offsets)
        made, after = shingle_hashes(word_hashes(buf, starts, ends, table), before, size)
        for d in range(last - first):
            yield first + d, np.unique(made[after[d] : after[d + 1]])


def shared_shingles(texts: tuple[bytes, bytes], size: int) -> tuple[int, int, int]:
    """Of two texts, how many distinct shingles each has and how many both have; compared word by word, not by hashes."""
    seen: dict[bytes, int] = {}
    words = [t.lower().split() for t in texts]  # bytes: only A-Z is lower-cased, and white space is as in SPACE
    ids = [np.fromiter(map(seen.setdefault, w, range(k, k + len(w))), np.int64, len(w)) for k, w in ((0, words[0]), (len(words[0]), words[1]))]
    length = min(size, *map(len, ids))
    if min(map(len, ids)) < size and len(ids[0]) != len(ids[1]):
        # A short text is one shingle of its own length, which a text of another length can't have.
        return *(min(len(i), 1) if len(i) < size else len(_distinct(i, size)) for i in ids), 0
    both = np.concatenate(ids)
    starts = [len(i) - length + 1 if len(i) else 0 for i in ids]
    code = _codes(both, length)
    left, right = np.unique(code[: starts[0]]), np.unique(code[len(ids[0]) : len(ids[0]) + starts[1]])
    return len(left), len(right), len(np.intersect1d(left, right, assume_unique=True))


def _codes(ids: np.ndarray, length: int) -> np.ndarray:
    """A number for each run of ``length`` numbers, the same for the same run only."""
    n = max(len(ids) - length + 1, 0)
    code = ids[:n] if length else np.zeros(n, np.int64)
    for k in range(1, length):
        code = np.unique(code * (int(ids.max(initial=0)) + 1) + ids[k : k + n], return_inverse=True)[1]
    return code


def _distinct(ids: np.ndarray, size: int) -> np.ndarray:
    return np.unique(_codes(ids, size))
