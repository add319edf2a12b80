"""Checksums, AES-128 and the two-level password scheme, on numpy and as Arrow UDFs.

SHA-256 is Spark's own sha2(); the polynomial of the checksum and unpadded ECB are not
in Spark, so these two are UDFs over whole batches.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from tidegrid.model import FormatError

#: The reversed Koopman polynomial and the start value; there is no final xor.
POLYNOMIAL, CRC_START = 0xEB31D82E, 0xFFFFFFFF
KEY_BYTES = 16
_AT_ONCE = 1 << 18  # bytes ciphered together


@cache
def crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


@cache
def _after_zeros(n: int) -> np.ndarray:
    """By byte place and value: the checksum state after n zero bytes. A state is the xor of its bytes' entries."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    table = crc_table()
    for _ in range(n):
        state = (state >> 8) ^ table[state & 0xFF]
    return state


def crc(data: bytes, start: int = CRC_START) -> int:
    """Resumable: start is the state left by what came before. Long data run as 1 KiB rows in lockstep, then are chained."""
    raw, width = np.frombuffer(data, np.uint8), 1024
    whole = len(raw) // width
    table = crc_table()
    state = start
    if whole > 1:
        rows = np.ascontiguousarray(raw[: whole * width].reshape(whole, width).T)
        sums = np.zeros(whole, np.uint32)
        for column in rows:
            sums = (sums >> 8) ^ table[(sums ^ column) & 0xFF]
        shift = _after_zeros(width).tolist()
        for s in sums.tolist():
            state = shift[0][state & 255] ^ shift[1][state >> 8 & 255] ^ shift[2][state >> 16 & 255] ^ shift[3][state >> 24] ^ s
        raw = raw[whole * width :]
    steps = table.tolist()
    for b in raw.tolist():
        state = (state >> 8) ^ steps[(state ^ b) & 0xFF]
    return state


def crc_rows(rows: list[bytes]) -> np.ndarray:
    """Checksums of many byte strings, side by side."""
    lengths = np.array([len(r) for r in rows], np.int64)
    order = np.argsort(-lengths, kind="stable")
    width = int(lengths.max(initial=0))
    grid = np.zeros((width, len(rows)), np.uint8)
    for place, i in enumerate(order.tolist()):
        grid[: lengths[i], place] = np.frombuffer(rows[i], np.uint8)
    live = len(rows) - np.searchsorted(np.sort(lengths), np.arange(width), "right")
    state, table = np.full(len(rows), CRC_START, np.uint32), crc_table()
    for row, n in zip(grid, live.tolist(), strict=True):
        state[:n] = (state[:n] >> 8) ^ table[(state[:n] ^ row[:n]) & 0xFF]
    out = np.empty(len(rows), np.uint32)
    out[order] = state
    return out


def _double(x: np.ndarray) -> np.ndarray:
    """Times two in the field of AES."""
    return ((x << 1) ^ np.where(x & 0x80, 0x1B, 0)).astype(np.uint8)


def _times(x: np.ndarray, k: int) -> np.ndarray:
    out, power = np.zeros_like(x), x
    while k:
        if k & 1:
            out = out ^ power
        power, k = _double(power), k >> 1
    return out


@cache
def _boxes() -> tuple[np.ndarray, np.ndarray]:
    """The substitution of AES from its rule - inverse in the field, then the affine map - and its reverse."""
    every = np.arange(256, dtype=np.uint8)
    inverse = np.zeros(256, np.uint8)
    for a in range(1, 256):
        inverse[a] = int(np.flatnonzero(_times(every, a) == 1)[0])
    turned = [((inverse.astype(np.uint16) << k | inverse.astype(np.uint16) >> (8 - k)) & 0xFF).astype(np.uint8) for k in range(5)]
    box = np.bitwise_xor.reduce(turned) ^ np.uint8(0x63)
    back = np.zeros(256, np.uint8)
    back[box] = every
    return box, back


@cache
def _round_keys(key: bytes) -> np.ndarray:
    box, _ = _boxes()
    words, rcon = [np.frombuffer(key, np.uint8)[4 * i : 4 * i + 4] for i in range(4)], np.uint8(1)
    for i in range(4, 44):
        w = words[-1]
        if i % 4 == 0:
            w = box[np.roll(w, -1)].copy()
            w[0] ^= rcon
            rcon = _double(np.array([rcon], np.uint8))[0]
        words.append(words[-4] ^ w)
    return np.concatenate(words).reshape(11, 16)


_ROWS = np.array([(4 * ((c + r) % 4)) + r for c in range(4) for r in range(4)])
_ROWS_BACK = np.argsort(_ROWS)


@cache
def _columns(factors: tuple[int, ...], substituted: bool) -> np.ndarray:
    """By place in a column and byte: the column that byte adds once mixed by factors, as one 32-bit number."""
    every = _boxes()[0] if substituted else np.arange(256, dtype=np.uint8)
    parts = np.stack([np.stack([_times(every, factors[(j - r) % 4]) for r in range(4)], axis=1) for j in range(4)])
    return parts.view(np.uint32)[:, :, 0]


def _mixed(state: np.ndarray, columns: np.ndarray) -> np.ndarray:
    s = state.reshape(-1, 4, 4)
    return np.bitwise_xor.reduce([columns[j][s[:, :, j]] for j in range(4)]).view(np.uint8)


def aes_ecb(data: bytes, key: bytes, encrypt: bool) -> bytes:
    """AES-128, every block by itself, no padding."""
    if len(data) % 16 or len(key) != KEY_BYTES:
        raise FormatError("AES-128 takes a key of 16 bytes and whole blocks of 16")
    keys, run = _round_keys(bytes(key)), _encrypted if encrypt else _decrypted
    return b"".join(run(np.frombuffer(data, np.uint8)[at : at + _AT_ONCE].reshape(-1, 16), keys).tobytes() for at in range(0, len(data), _AT_ONCE))


def _encrypted(s: np.ndarray, keys: np.ndarray) -> np.ndarray:
    box, mixing = _boxes()[0], _columns((2, 3, 1, 1), True)
    s = s ^ keys[0]
    for k in range(1, 10):
        s = _mixed(s[:, _ROWS], mixing) ^ keys[k]
    return box[s][:, _ROWS] ^ keys[10]


def _decrypted(s: np.ndarray, keys: np.ndarray) -> np.ndarray:
    back, mixing = _boxes()[1], _columns((14, 11, 13, 9), False)
    s = s ^ keys[10]
    for k in range(9, 0, -1):
        s = _mixed(back[s[:, _ROWS_BACK]] ^ keys[k], mixing)
    return back[s[:, _ROWS_BACK]] ^ keys[0]


def aes_ecb_rows(rows: list[bytes], key: bytes, encrypt: bool) -> list[bytes]:
    """Many byte strings, each of whole blocks, side by side."""
    if any(len(r) % 16 for r in rows):
        raise FormatError("AES-128 takes a key of 16 bytes and whole blocks of 16")
    whole, ends = aes_ecb(b"".join(rows), key, encrypt), list(accumulate(map(len, rows)))
    return [whole[e - len(r) : e] for r, e in zip(rows, ends, strict=True)]


def password_bytes(password: str) -> bytes:
    """The last byte of each character's UTF-8, sixteen at most, zeros after."""
    return bytes(c.encode()[-1] for c in password[:KEY_BYTES]).ljust(KEY_BYTES, b"\0")


def _head(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:KEY_BYTES]


def _xor(a: bytes, b: bytes) -> bytes:
    return bytes(x ^ y for x, y in zip(a, b, strict=True))


@dataclass(frozen=True)
class Access:
    """What a password opens: 0 nothing, 1 the technical section, 2 the subject section too."""

    level: int = 0
    key1: bytes | None = None
    key2: bytes | None = None

    def key(self, level: int) -> bytes | None:
        return {1: self.key1, 2: self.key2}.get(level)


def validation_fields(password1: str, password2: str) -> tuple[bytes, bytes]:
    if not password1:
        return bytes(KEY_BYTES), bytes(KEY_BYTES)
    one = password_bytes(password1)
    return _head(one), _xor(_head(password_bytes(password2)), one) if password2 else bytes(KEY_BYTES)


def access(password: str, field1: bytes, field2: bytes) -> Access:
    if not password:
        return Access()
    key = password_bytes(password)
    if _head(key) == field1:
        return Access(1, key)
    first = _xor(_head(key), field2)
    return Access(2, first, key) if _head(first) == field1 else Access()


@F.arrow_udf(LongType())
def crc32k(data: pa.Array) -> pa.Array:
    """The checksum of a binary column, as a long; null stays null."""
    sums = crc_rows([x or b"" for x in data.to_pylist()])
    return pa.array(sums.astype(np.int64), mask=np.asarray(data.is_null()))


def aes_ecb_column(key: bytes, encrypt: bool):
    """A column function over binary columns of whole blocks; null stays null."""

    @F.arrow_udf(BinaryType())
    def run(data: pa.Array) -> pa.Array:
        done = iter(aes_ecb_rows(data.drop_null().to_pylist(), key, encrypt))
        return pa.array([next(done) if there else None for there in data.is_valid().to_pylist()], pa.binary())

    return run
