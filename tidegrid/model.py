"""Schemas, sentinels and errors."""

from __future__ import annotations

from pyspark.sql import types as T

UUTC_NONE = -(1 << 63)
LONG_NONE, INT_NONE, UINT_NONE = -1, -1, 0xFFFFFFFF
GMT_NONE = -86401
SAMPLE_NONE = -(1 << 31)
FILTER_NONE = -1.0


class SessionError(Exception):
    """Anything this library refuses."""


class FormatError(SessionError):
    pass


class CrcError(SessionError):
    pass


class PasswordError(SessionError):
    pass


class SessionIOError(SessionError, OSError):
    pass


class WriteConflictError(SessionError):
    pass


def _schema(ddl: str) -> T.StructType:
    """DDL of simple names and types, without a session."""
    kinds = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "ints": T.ArrayType(T.IntegerType()), "binary": T.BinaryType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])


CHANNELS = _schema(
    "session string, name string, sampling_frequency double, units_conversion_factor double, units_description string, start_time long, end_time long, "
    "number_of_samples long, recording_time_offset long, n_segments int, session_description string, channel_description string, reference_description string, "
    "acquisition_channel_number long, low_frequency_filter double, high_frequency_filter double, notch_filter double, line_frequency double, "
    "section3_available boolean, gmt_offset int, subject_name_1 string, subject_name_2 string, subject_id string, recording_location string"
)
SEGMENTS = _schema("session string, channel string, segment int, path string, start_time long, end_time long, start_sample long, number_of_samples long, number_of_blocks long")
BLOCKS = _schema(
    "session string, channel string, segment int, block_no int, start_uutc long, end_uutc long, start_sample long, number_of_samples long, "
    "maximum_sample_value int, minimum_sample_value int, discontinuity boolean, samples ints"
)
RECORDS = _schema("session string, channel string, type string, time long, text string, duration long, earliest_onset long, latest_offset long, version_major int, version_minor int")
