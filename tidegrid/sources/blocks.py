"""The block codec: differences, range-coded by a table of byte frequencies per block.

Range coding is serial inside a block, so blocks are coded side by side: every step
codes one symbol of each, as array arithmetic. Carries are not chased while encoding:
each emitted digit keeps its carry bit, and one pass at the end adds carries up.
A last digit that could fall outside the last symbol's interval is followed by a finer one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidegrid.functions.crypto import Access, aes_ecb, crc_rows
from tidegrid.model import SAMPLE_NONE, CrcError, FormatError, PasswordError

#: The header of a block (field, type, offset), flags, padding, and the coder's constants.
HEADER = np.dtype(
    {
        "names": ["crc", "flags", "slope", "intercept", "scale", "difference_bytes", "samples", "block_bytes", "start_time", "statistics"],
        "formats": ["<u4", "u1", "<f4", "<f4", "<f4", "<u4", "<u4", "<u4", "<i8", ("u1", 256)],
        "offsets": [0, 4, 16, 20, 24, 28, 32, 36, 40, 48],
        "itemsize": 304,
    }
)
DISCONTINUITY, LEVEL_1, LEVEL_2 = 1, 2, 4
PAD = 0x7E
_TOP, _BOTTOM, _SHIFT, _EXTRA = 1 << 31, 1 << 23, 23, 7
_AFTER = 1 << 15  # more than padding adds to a code after its last digit and a zero byte
_FEW = 24


@dataclass
class Block:
    samples: np.ndarray
    start_time: int
    discontinuity: bool


def differences(samples: np.ndarray) -> np.ndarray:
    """The symbol stream: the first sample's four bytes, then a step's byte, or 128 and four bytes where it leaves -127..127."""
    raw = samples.astype("<i4").view(np.uint8).reshape(-1, 4)
    step = np.diff(samples.astype(np.int64))
    keyed = np.abs(step) > 127
    size = np.where(keyed, 5, 1)
    at = 4 + np.cumsum(size) - size
    out = np.zeros(4 + int(size.sum()), np.uint8)
    out[:4] = raw[0]
    out[at] = np.where(keyed, 128, step & 255).astype(np.uint8)
    for k in range(4):
        out[at[keyed] + 1 + k] = raw[1:][keyed, k]
    return out


def _integrated(symbols: np.ndarray, n: int) -> np.ndarray:
    """n samples of a stream that begins with its marker 128. Markers are told from payload by hopping from one to the next."""
    marks, at = [], 0
    candidates = np.flatnonzero(symbols == 128)
    while at < len(candidates):
        marks.append(int(candidates[at]))
        at = int(np.searchsorted(candidates, marks[-1] + 5))
    if marks[-1] + 5 > len(symbols):  # the stored length may count one symbol past the end
        symbols = symbols[: marks.pop()]
    marks = np.array(marks, np.int64)
    if not len(marks):
        raise FormatError("a block's difference stream is cut off")
    payload = np.zeros(len(symbols), bool)
    for k in range(1, 5):
        payload[marks + k] = True
    heads = np.flatnonzero(~payload)[:n]
    if len(heads) < n:
        raise FormatError("a block's difference stream ends before its samples")
    keyed = symbols[heads] == 128
    full = np.stack([symbols[heads[keyed] + k] for k in range(1, 5)], axis=1).copy().view("<i4").ravel().astype(np.int64)
    steps = symbols[heads].view(np.int8).astype(np.int64)
    steps[keyed] = 0
    total = np.cumsum(steps)
    of = np.cumsum(keyed) - 1
    return (full[of] + total - total[np.flatnonzero(keyed)][of]).astype(np.int32)


def frequencies(symbols: np.ndarray) -> np.ndarray:
    counts = np.bincount(symbols, minlength=256)
    most = counts.max()
    return (np.ceil(counts * (254.999999999 / most)) if most > 255 else counts).astype(np.uint8)


def _lockstep(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of blocks from the longest down, and how many of them are as long as each step needs."""
    width = int(lengths.max(initial=0))
    return np.argsort(-lengths, kind="stable"), len(lengths) - np.searchsorted(np.sort(lengths), np.arange(width), "right")


def _flat_ahead(tables: np.ndarray) -> np.ndarray:
    """Frequencies of the symbols before each, 256 a block, end to end."""
    return (np.cumsum(tables, axis=1, dtype=np.uint32) - tables).ravel()


def _range_encode(streams: list[np.ndarray], tables: np.ndarray) -> list[bytes]:
    b = len(streams)
    order, live_at = _lockstep(np.array([len(s) for s in streams]))
    tables = tables[order].astype(np.uint32)
    width = len(live_at)
    grid = np.zeros((width, b), np.uint8)
    for place, i in enumerate(order.tolist()):
        grid[: len(streams[i]), place] = streams[i]
    total, ahead, counts = tables.sum(axis=1, dtype=np.uint32), _flat_ahead(tables), tables.ravel()
    digits = np.zeros((b, width * 2 + 16), np.uint16)
    used = np.zeros(b, np.int64)
    low, span = np.zeros(b, np.uint32), np.full(b, _TOP, np.uint32)
    base, rows = np.arange(b) * 256, np.arange(b)

    def renormalised(n: int) -> None:
        nonlocal digits
        live = np.flatnonzero(span[:n] <= _BOTTOM)
        while len(live):
            if used.max() + 4 >= digits.shape[1]:
                digits = np.concatenate([digits, np.zeros_like(digits)], axis=1)
            digits[live, used[live]] = low[live] >> _SHIFT  # with its carry bit
            used[live] += 1
            low[live] = (low[live] << 8) & (_TOP - 1)
            span[live] <<= 8
            live = live[span[live] <= _BOTTOM]

    for t, n in enumerate(live_at.tolist()):
        renormalised(n)
        symbol = grid[t, :n]
        at = base[:n] + symbol
        unit = span[:n] // total[:n]
        below = unit * ahead[at]
        low[:n] += below
        span[:n] = np.where(symbol < 255, unit * counts[at], span[:n] - below)
    renormalised(b)
    # One digit more than low ends the code; where the interval is so narrow that this and what is stored after it could lie beyond, a second digit is finer.
    past = _BOTTOM - (low & (_BOTTOM - 1)) + _AFTER
    fine = np.flatnonzero(past >= span)
    digits[rows, used] = (low >> _SHIFT) + 1
    digits[fine, used[fine]] -= 1
    used[fine] += 1
    digits[fine, used[fine]] = (low[fine] >> (_SHIFT - 8) & 255) + 1
    out: list[bytes] = [b""] * b
    for place, i in enumerate(order.tolist()):
        d = digits[place, : used[place] + 1].copy()
        while (over := np.flatnonzero(d > 255)).size:
            np.add.at(d, over[over > 0] - 1, d[over[over > 0]] >> 8)
            d[over] &= 255
        out[i] = d.astype(np.uint8).tobytes() + b"\0"
    return out


def _range_decode_one(payload: bytes, table: np.ndarray, n: int) -> np.ndarray:
    """One block by itself: quicker than array steps where blocks are few."""
    counts = table.tolist()
    ahead, total = (np.cumsum(table, dtype=np.int64) - table).tolist(), int(table.sum(dtype=np.int64))
    if not total:
        raise FormatError("a block's frequency table is empty")
    symbol_of = np.repeat(np.arange(256, dtype=np.uint8), table).tobytes()
    code = payload + bytes(8 + 3 * n)
    byte, at, span, out = code[0], 1, 1 << _EXTRA, bytearray(n)
    low = byte >> (8 - _EXTRA)
    for t in range(n):
        while span <= _BOTTOM:
            low = (low << 8 | (byte << _EXTRA) & 255) & 0xFFFFFFFF
            byte = code[at]
            at += 1
            low |= byte >> (8 - _EXTRA)
            span <<= 8
        unit = span // total
        if not unit or low < 0:
            raise FormatError("a block's code leaves its range")
        q = low // unit
        s = symbol_of[q if q < total else total - 1]
        below = unit * ahead[s]
        low -= below
        span = unit * counts[s] if s < 255 else span - below
        if span <= 0:
            raise FormatError("a block's code names a symbol that its table lacks")
        out[t] = s
    return np.frombuffer(bytes(out), np.uint8)


def _range_decode(payloads: list[bytes], tables: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    b = len(payloads)
    if b < _FEW:
        return [_range_decode_one(p, t, n) for p, t, n in zip(payloads, tables, lengths.tolist(), strict=True)]
    order, live_at = _lockstep(lengths)
    tables = tables[order].astype(np.uint32)
    width, longest = len(live_at), max(map(len, payloads), default=0) + 8
    code = np.zeros((b, longest), np.uint8)
    for place, i in enumerate(order.tolist()):
        code[place, : len(payloads[i])] = np.frombuffer(payloads[i], np.uint8)
    total, ahead, counts = tables.sum(axis=1, dtype=np.uint32), _flat_ahead(tables), tables.ravel()
    if (total == 0).any():
        raise FormatError("a block's frequency table is empty")
    symbols = np.zeros((width, b), np.uint8)
    # For each block, the symbol of each cumulative count, in one flat table.
    base, first = np.arange(b) * 256, np.cumsum(total, dtype=np.int64) - total
    symbol_of = np.repeat(np.tile(np.arange(256, dtype=np.uint8), b), counts)
    byte, at = code[:, 0].astype(np.uint32), np.ones(b, np.int64)
    low, span = byte >> (8 - _EXTRA), np.full(b, 1 << _EXTRA, np.uint32)
    for t, n in enumerate(live_at.tolist()):
        need = np.flatnonzero(span[:n] <= _BOTTOM)
        while len(need):
            low[need] = (low[need] << 8) | ((byte[need] << _EXTRA) & 255)
            byte[need] = code[need, np.minimum(at[need], longest - 1)]
            at[need] += 1
            low[need] |= byte[need] >> (8 - _EXTRA)
            span[need] <<= 8
            need = need[span[need] <= _BOTTOM]
        unit = span[:n] // total[:n]
        if not unit.all():
            raise FormatError("a block's code leaves its range")
        s = symbol_of[first[:n] + np.minimum(low[:n] // unit, total[:n] - 1)]
        place = base[:n] + s
        below = unit * ahead[place]
        low[:n] -= below
        span[:n] = np.where(s < 255, unit * counts[place], span[:n] - below)
        if not span[:n].all():
            raise FormatError("a block's code names a symbol that its table lacks")
        symbols[t, :n] = s
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * b
    for place, i in enumerate(order.tolist()):
        out[i] = symbols[: lengths[i], place]
    return out


def encode(blocks: list[Block], level: int = 0, keys: Access = Access()) -> list[bytes]:
    """Each block in its stored form, padded to eight bytes and checksummed."""
    if level and keys.key(level) is None:
        raise PasswordError(f"a level {level} key is needed to encrypt blocks")
    heads = np.zeros(len(blocks), HEADER)
    heads["scale"] = 1
    heads["start_time"] = [b.start_time for b in blocks]
    heads["samples"] = [len(b.samples) for b in blocks]
    heads["flags"] = [DISCONTINUITY if b.discontinuity else 0 for b in blocks]
    some = [i for i, b in enumerate(blocks) if len(b.samples)]
    streams = [differences(np.asarray(blocks[i].samples, np.int32)) for i in some]
    tables = np.array([frequencies(s) for s in streams], np.uint8).reshape(-1, 256)
    payloads = dict(zip(some, _range_encode(streams, tables), strict=True)) if some else {}
    out = []
    for i, s, t in zip(some, streams, tables, strict=True):
        heads["difference_bytes"][i] = len(s) + 1
        heads["statistics"][i] = np.frombuffer(aes_ecb(t.tobytes(), keys.key(level), True), np.uint8) if level else t
        heads["flags"][i] |= (0, LEVEL_1, LEVEL_2)[level]
    for i in range(len(blocks)):
        payload = payloads.get(i, b"")
        payload += bytes([PAD]) * (-len(payload) % 8)
        heads["block_bytes"][i] = HEADER.itemsize + len(payload)
        out.append(heads[i].tobytes() + payload)
    sums = crc_rows([x[4:] for x in out])
    return [int(c).to_bytes(4, "little") + x[4:] for c, x in zip(sums, out, strict=True)]


def decode(raw: list[bytes], keys: Access = Access(), check: bool = True) -> list[Block]:
    """The samples of stored blocks. Counters that contradict one another, and checksums that fail, raise."""
    if any(len(x) < HEADER.itemsize for x in raw):
        raise FormatError("a block is smaller than its header")
    heads = np.concatenate([np.frombuffer(x, HEADER, 1) for x in raw]) if raw else np.zeros(0, HEADER)
    size, n, symbols = (heads[c].astype(np.int64) for c in ("block_bytes", "samples", "difference_bytes"))
    if (size < HEADER.itemsize).any() or (size > [len(x) for x in raw]).any():
        raise FormatError("a block's size does not fit its bytes")
    if (n > symbols + 1).any() or (symbols > 5 * n + 5).any():
        raise FormatError("a block's counters contradict one another")
    if check and (crc_rows([x[4:s] for x, s in zip(raw, size.tolist(), strict=True)]) != heads["crc"]).any():
        raise CrcError("a block's checksum fails")
    tables = heads["statistics"].copy()
    for flag, level in ((LEVEL_1, 1), (LEVEL_2, 2)):
        for i in np.flatnonzero(heads["flags"] & flag):
            if keys.key(level) is None:
                raise PasswordError(f"a block is encrypted at level {level}")
            tables[i] = np.frombuffer(aes_ecb(tables[i].tobytes(), keys.key(level), False), np.uint8)
    some = np.flatnonzero(n)
    streams = _range_decode([raw[i][HEADER.itemsize : size[i]] for i in some], tables[some], symbols[some]) if len(some) else []
    out = [Block(np.zeros(0, np.int32), int(h["start_time"]), bool(h["flags"] & DISCONTINUITY)) for h in heads]
    for i, s in zip(some.tolist(), streams, strict=True):
        x = _integrated(np.concatenate([np.array([128], np.uint8), s]), int(n[i]))
        h = heads[i]
        if h["scale"] > 1:
            x = _rounded(x * np.float64(h["scale"]))
        if h["slope"] or h["intercept"]:
            x = _rounded(x + np.float64(h["slope"]) * np.arange(1, len(x) + 1) + np.float64(h["intercept"]))
        out[i].samples = x
    return out


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.clip(np.trunc(x + np.copysign(0.5, x)), -(2**31) + 1, 2**31 - 1).astype(np.int32)


def extrema(samples: np.ndarray) -> tuple[int, int]:
    return (int(samples.min()), int(samples.max())) if len(samples) else (SAMPLE_NONE, SAMPLE_NONE)
