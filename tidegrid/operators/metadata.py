"""Acquisition and subject metadata: nesting, defaults, masking and older key names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import timegrid as tg
from tidegrid.model import FILTER_NONE

#: Names, order, types and defaults of the acquisition and subject fields.
ACQUISITION = {
    "session_description": ("string", ""), "channel_description": ("string", ""), "reference_description": ("string", ""), "acquisition_channel_number": ("long", 1),
    "low_frequency_filter": ("double", FILTER_NONE), "high_frequency_filter": ("double", FILTER_NONE), "notch_filter": ("double", FILTER_NONE), "line_frequency": ("double", FILTER_NONE),
}
SUBJECT = {
    "name_1": ("string", ""), "name_2": ("string", ""), "id": ("string", ""), "recording_location": ("string", ""), "gmt_offset": ("int", 0),
}
#: The flat column of each subject field.
SUBJECT_COLUMNS = {"name_1": "subject_name_1", "name_2": "subject_name_2", "id": "subject_id", "recording_location": "recording_location", "gmt_offset": "gmt_offset"}
#: Key names of older writers.
OLDER_KEYS = {
    "session_description": "session_description", "channel_description": "channel_description", "reference_description": "reference_description",
    "acquisition_channel_number": "acquisition_channel_number", "low_frequency_filter_setting": "low_frequency_filter",
    "high_frequency_filter_setting": "high_frequency_filter", "notch_filter_frequency_setting": "notch_filter", "AC_line_frequency": "line_frequency",
    "subject_name_1": "subject_name_1", "subject_name_2": "subject_name_2", "subject_ID": "subject_id", "subject_id": "subject_id",
    "recording_location": "recording_location", "GMT_offset": "gmt_offset", "gmt_offset": "gmt_offset",
}


def _with_default(name: str, kind: str, default) -> Column:
    return F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind))


def nested(info: DataFrame) -> DataFrame:
    """info with two structs, acquisition and subject, nulls as defaults."""
    a = F.struct(*(_with_default(n, k, d).alias(n) for n, (k, d) in ACQUISITION.items()))
    s = F.struct(*(_with_default(SUBJECT_COLUMNS[n], k, d).alias(n) for n, (k, d) in SUBJECT.items()))
    return info.withColumns({"acquisition": a, "subject": s})


def flattened(meta: DataFrame) -> DataFrame:
    """The reverse of nested(): one column per field."""
    others = [c for c in meta.columns if c not in ("acquisition", "subject")]
    a = [F.col(f"acquisition.{n}").alias(n) for n in ACQUISITION]
    return meta.select(*others, *a, *(F.col(f"subject.{n}").alias(SUBJECT_COLUMNS[n]) for n in SUBJECT))


def masked(info: DataFrame, available: str = "section3_available") -> DataFrame:
    """Subject columns are null where the subject section is not accessible."""
    return info.withColumns({c: F.when(F.col(available), F.col(c)) for c in SUBJECT_COLUMNS.values() if c in info.columns})


def described(info: DataFrame, session: str, channel: str) -> DataFrame:
    """Empty descriptions fall back to the session's and the channel's name."""
    return info.withColumns({"session_description": tg.described("session_description", session), "channel_description": tg.described("channel_description", channel)})


def renamed(df: DataFrame, names: dict[str, str] = OLDER_KEYS) -> DataFrame:
    """Columns under older names get the current ones; unknown columns go."""
    known = {k: v for k, v in names.items() if k in df.columns}
    return df.select(*(F.col(k).alias(v) for k, v in known.items()))


def overlaid(layers: list[dict]) -> dict:
    """Later layers win; bytes become text, unknown keys go."""
    known = {*OLDER_KEYS.values()}
    out = {}
    for layer in layers:
        for k, v in layer.items():
            name = OLDER_KEYS.get(k, k)
            if name in known and v is not None:
                out[name] = v.decode("utf-8", "replace").rstrip("\0") if isinstance(v, bytes) else v
    return out


def property_names(df: DataFrame) -> list[str]:
    return sorted(df.columns)


def picked(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Rows of the named keys, in the order asked for, each name once; unknown names are skipped."""
    wanted = list(dict.fromkeys(names))
    return df.where(F.col(key).isin(wanted)).orderBy(F.array_position(F.array(*map(F.lit, wanted)), F.col(key)))
