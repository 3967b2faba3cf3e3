"""CRC-32 of substrings from running CRCs, on numpy arrays.

The CRC register without its two inversions is linear over GF(2): reading a
string moves the register by as many bytes and adds the string's own part. So
one scan that keeps the register after every byte gives the CRC of any
substring: move the register at its start by the substring's length and cancel
it from the register at its end.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: reflected polynomial of CRC-32 (fixed value)
POLYNOMIAL = 0xEDB88320
ONES = np.uint32(0xFFFFFFFF)
BYTE, LOW = np.uint32(8), np.uint32(0xFF)


def _byte_steps() -> np.ndarray:
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), steps >> np.uint32(1))
    return steps


STEPS = _byte_steps()


def _read(register: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    """The register after one more byte."""
    return STEPS[(register ^ byte) & LOW] ^ (register >> BYTE)


@lru_cache(maxsize=64)
def _moves(power: int) -> np.ndarray:
    """Lookup tables (one for each byte of the register) for a move by ``2 ** power`` bytes."""
    places = np.arange(256, dtype=np.uint32)
    tables = np.stack([places << np.uint32(8 * k) for k in range(4)])
    if power == 0:
        return _read(tables, np.uint32(0))
    half = _moves(power - 1)
    return _through(half, _through(half, tables))


def _through(tables: np.ndarray, register: np.ndarray) -> np.ndarray:
    out = tables[0][register & LOW]
    for k in range(1, 4):
        out = out ^ tables[k][(register >> np.uint32(8 * k)) & LOW]
    return out


def moved(register: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each register moved on by so many zero bytes."""
    register = np.array(register, np.uint32)
    n_bytes = np.broadcast_to(np.asarray(n_bytes, np.int64), register.shape)
    for power in range(int(n_bytes.max(initial=0)).bit_length()):
        far = np.flatnonzero((n_bytes >> power) & 1)
        register[far] = _through(_moves(power), register[far])
    return register


#: bytes of a lane, as a power of two
LANE = 10


def running(data: np.ndarray) -> np.ndarray:
    """The register before the first byte (0) and after each byte of ``data``.

    Lanes of ``2 ** LANE`` bytes are read side by side: once from 0 for what each
    lane adds, then from the register that all lanes before it leave.
    """
    width = 1 << LANE
    lanes = -(-len(data) // width)
    columns = np.zeros(lanes * width, np.uint8)
    columns[: len(data)] = data
    columns = np.ascontiguousarray(columns.reshape(lanes, width).T)
    register = np.zeros(lanes, np.uint32)
    for byte in columns:
        register = _read(register, byte)
    a, b, c, d = _moves(LANE).tolist()
    starts, over = [], 0
    for own in register.tolist():
        starts.append(over)
        over = a[over & 255] ^ b[over >> 8 & 255] ^ c[over >> 16 & 255] ^ d[over >> 24] ^ own
    out = np.empty((width, lanes), np.uint32)
    register = np.array(starts, np.uint32)
    for k, byte in enumerate(columns):
        register = _read(register, byte)
        out[k] = register
    return np.concatenate([np.zeros(1, np.uint32), out.T.reshape(-1)[: len(data)]])


def substring_crcs(registers: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start:end]`` for arrays of bounds, from ``running(data)``."""
    return registers[end] ^ moved(registers[start] ^ ONES, end - start) ^ ONES


def text_crcs(texts: list[bytes]) -> np.ndarray:
    """Registers left by each text alone, from 0 (no inversions): ``raw(a + b) = moved(raw(a), len(b)) ^ raw(b)``."""
    ends = np.cumsum([0, *map(len, texts)])
    registers = running(np.frombuffer(b"".join(texts), np.uint8))
    return registers[ends[1:]] ^ moved(registers[ends[:-1]], np.diff(ends))
