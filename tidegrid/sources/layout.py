"""Byte layouts of the native session files, as numpy record types.

Fixed values: field names, types and offsets as the format has them.
"""

from __future__ import annotations

import numpy as np

from tidegrid.functions.crypto import CRC_START, crc
from tidegrid.model import GMT_NONE, INT_NONE, LONG_NONE, SAMPLE_NONE, UUTC_NONE, FormatError


def _record(size: int, fields: str) -> np.dtype:
    names, formats, offsets = zip(*(f.split() for f in fields.split(",")), strict=True)
    return np.dtype({"names": names, "formats": formats, "offsets": [int(o) for o in offsets], "itemsize": size})


HEADER = _record(
    1024,
    "header_crc <u4 0, body_crc <u4 4, file_type S5 8, major u1 13, minor u1 14, little u1 15, start_time <i8 16, end_time <i8 24, entries <i8 32, "
    "largest_entry <i8 40, segment <i4 48, channel S256 52, session S256 308, anonymized S256 564, level_uuid V16 820, file_uuid V16 836, provenance_uuid V16 852, "
    "field1 V16 868, field2 V16 884",
)
ENCRYPTION = _record(1536, "section2 i1 0, section3 i1 1")
TECHNICAL = _record(
    10752,
    "channel_description S2048 0, session_description S2048 2048, recording_duration <i8 4096, reference_description S2048 4104, acquisition_channel_number <i8 6152, "
    "sampling_frequency <f8 6160, low_frequency_filter <f8 6168, high_frequency_filter <f8 6176, notch_filter <f8 6184, line_frequency <f8 6192, "
    "units_conversion_factor <f8 6200, units_description S128 6208, maximum_native <f8 6336, minimum_native <f8 6344, start_sample <i8 6352, number_of_samples <i8 6360, "
    "number_of_blocks <i8 6368, maximum_block_bytes <i8 6376, maximum_block_samples <u4 6384, maximum_difference_bytes <u4 6388, block_interval <i8 6392, "
    "number_of_discontinuities <i8 6400, maximum_contiguous_blocks <i8 6408, maximum_contiguous_block_bytes <i8 6416, maximum_contiguous_samples <i8 6424",
)
SUBJECT = _record(
    3072,
    "recording_time_offset <i8 0, dst_start <i8 8, dst_end <i8 16, gmt_offset <i4 24, subject_name_1 S128 28, subject_name_2 S128 156, subject_id S128 284, recording_location S512 412",
)
INDEX = _record(56, "file_offset <i8 0, start_time <i8 8, start_sample <i8 16, samples <u4 24, block_bytes <u4 28, maximum <i4 32, minimum <i4 36, flags u1 44")
RECORD = _record(24, "crc <u4 0, type S4 4, major u1 9, minor u1 10, encryption i1 11, body_bytes <u4 12, time <i8 16")
RECORD_INDEX = _record(24, "type S4 0, major u1 5, minor u1 6, encryption i1 7, file_offset <i8 8, time <i8 16")
SECTION2_AT, SECTION3_AT = 2560, 13312
METADATA_BYTES = SECTION3_AT + SUBJECT.itemsize


def one(kind: np.dtype, data: bytes, at: int = 0) -> np.void:
    if len(data) < at + kind.itemsize:
        raise FormatError("a file is shorter than its layout")
    return np.frombuffer(data, kind, 1, at)[0]


def blank(kind: np.dtype) -> np.ndarray:
    """One record of zeros with the format's not-given values."""
    r = np.zeros(1, kind)
    for name, value in _NOT_GIVEN.get(kind, {}).items():
        r[name] = value
    return r


_NOT_GIVEN = {
    HEADER: {"major": 3, "minor": 0, "little": 1, "start_time": UUTC_NONE, "end_time": UUTC_NONE, "entries": LONG_NONE, "largest_entry": LONG_NONE, "segment": INT_NONE},
    TECHNICAL: {"recording_duration": LONG_NONE, "acquisition_channel_number": LONG_NONE, "sampling_frequency": -1.0, "low_frequency_filter": -1.0, "high_frequency_filter": -1.0, "notch_filter": -1.0, "line_frequency": -1.0},
    SUBJECT: {"recording_time_offset": UUTC_NONE, "dst_start": UUTC_NONE, "dst_end": UUTC_NONE, "gmt_offset": GMT_NONE},
    INDEX: {"maximum": SAMPLE_NONE, "minimum": SAMPLE_NONE},
}


def joined(kind: np.dtype, parts: list[np.ndarray]) -> np.ndarray:
    """Records of one type end to end, their layout kept (numpy's concatenate would pack them)."""
    return np.frombuffer(b"".join(p.astype(kind, copy=False).tobytes() for p in parts), kind)


def text(value: bytes) -> str:
    return bytes(value).split(b"\0", 1)[0].decode("utf-8", "replace")


def field(value: str, kind: np.dtype, name: str) -> bytes:
    """Text cut to its field, whole characters only."""
    return value.encode()[: kind[name].itemsize].decode("utf-8", "ignore").encode()


def sealed(header: np.ndarray, body: bytes, body_sum: int | None = None) -> bytes:
    """A file's header with both checksums set."""
    header = header.copy()
    header["body_crc"] = crc(body) if body_sum is None else body_sum
    header["header_crc"] = crc(header.tobytes()[4:])
    return header.tobytes()


def header_holds(data: bytes) -> bool:
    return crc(data[4 : HEADER.itemsize]) == int(one(HEADER, data)["header_crc"])


def body_holds(data: bytes) -> bool:
    """True too where the writer left the sum out."""
    stored = int(one(HEADER, data)["body_crc"])
    return stored == CRC_START or crc(data[HEADER.itemsize :]) == stored
