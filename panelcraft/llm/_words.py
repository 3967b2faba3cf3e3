"""Vectorised word splitting for Arrow batches (used inside ``mapInArrow`` tasks).

Texts are handled as UTF-8 bytes: a 256-entry byte table lower-cases A-Z and
turns separators into spaces, Arrow splits and dictionary-encodes the words,
and everything after that is integer work in numpy. A null text has no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACES = bytes([0x20, *range(0x09, 0x0E)])


def byte_table(lower: bool = True, separators: bytes = SPACES) -> np.ndarray:
    """Byte map: separators become a space, A-Z become a-z when ``lower``."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[ord("A") : ord("Z") + 1] += 32
    table[np.frombuffer(separators, np.uint8)] = 0x20
    return table


#: words are runs of anything but ASCII white space, A-Z lower-cased
SPACE_WORDS = byte_table()
#: words are runs of 0-9, a-z and non-ASCII characters, A-Z lower-cased
ALNUM_WORDS = byte_table(
    separators=bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
)
#: words are runs of anything but ASCII white space, case kept
CASED_WORDS = byte_table(lower=False)


def _give_back() -> None:
    """Free memory goes back to the system: workers live on between stages, and a container counts what they hold."""
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


#: of glibc; other C libraries have none
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def slices(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts in a column have about ``max_bytes``, or are a single text."""
    _give_back()  # what the worker still holds of an earlier stage
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield batch.slice(a, b - a)
                _give_back()


@dataclass
class Words:
    """Words of a batch of texts: text ``i`` has ``codes[starts[i]:starts[i + 1]]``."""

    codes: np.ndarray  # index into vocabulary, one per word
    starts: np.ndarray  # one more than texts
    vocabulary: pa.Array  # distinct words of the batch

    def __len__(self) -> int:
        return len(self.starts) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def owners(self) -> np.ndarray:
        """For each word, the index of its text."""
        return np.repeat(np.arange(len(self)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word, in vocabulary order."""
        return np.fromiter(
            (xxhash.xxh3_64_intdigest(w) for w in self.vocabulary.cast(pa.binary()).to_pylist()),
            np.uint64,
            len(self.vocabulary),
        )


def letters(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z lower-cased and a space for all but letters A-Z, a-z and U+00C0 to U+00FF.

    These code points above ASCII are the byte C3, which begins no other, and one more.
    """
    high = data == 0xC3
    high[1:] |= data[:-1] == 0xC3
    return np.where(high | ALPHABETIC[data], SPACE_WORDS[data], np.uint8(0x20))


ALPHABETIC = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B)])


def split_words(texts: pa.Array, table: np.ndarray | Callable[[np.ndarray], np.ndarray]) -> Words:
    """Split every text of a string column into words under a byte table or another function of the bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0 or offsets[-1] == offsets[0]:
        return Words(np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64), pa.array([], pa.large_string()))
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    data = table(data) if callable(table) else table[data]
    clean = pa.LargeStringArray.from_buffers(
        len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data)
    )
    lists = pc.ascii_split_whitespace(clean)
    flat = lists.flatten()
    kept = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(kept)])
    starts = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    del lists, clean, data  # the texts again, as large as the words: not needed beside them
    if not kept.all():
        flat = flat.filter(pa.array(kept))
    coded = flat.dictionary_encode()
    return Words(coded.indices.to_numpy().astype(np.int64), starts.astype(np.int64), coded.dictionary)


MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer on unsigned 64-bit integers (wraps on purpose)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all n-word windows, text by text, and where each text's begin.

    A text of fewer than ``n`` words, but not none, is one window by itself.
    """
    counts = words.counts
    windows = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    cuts = np.concatenate([[0], np.cumsum(windows)])
    if not len(words.codes):
        return np.zeros(0, np.uint64), cuts
    h = words.hashes()
    acc = np.zeros(len(words.codes) + n, np.uint64)
    for k in range(n):  # window at i: sum of position-dependent hashes of words i to i + n - 1
        acc[: max(0, len(words.codes) - k)] += mix64(h + np.uint64((k + 1) * 0x632BE59BD9B4E019 & MASK))[words.codes[k:]]
    first = np.repeat(words.starts[:-1] - cuts[:-1], windows) + np.arange(cuts[-1])
    out = mix64(acc[first] + np.uint64(n * 0x9E3779B97F4A7C15 & MASK))
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        size = int(counts[i])
        own = h[words.codes[words.starts[i] : words.starts[i + 1]]]
        total = sum(int(x) for x in mix64(own + np.arange(1, size + 1).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)))
        out[cuts[i]] = mix64(np.array([(total + size * 0x9E3779B97F4A7C15) & MASK], np.uint64))[0]
    return out, cuts
