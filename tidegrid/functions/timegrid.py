"""The arithmetic of times, grids and counts, as Column functions: the one place that rounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.model import UUTC_NONE

INT_MAX = (1 << 31) - 1


def col(x: Column | str | int | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def llround(x: Column) -> Column:
    """Half away from zero, as a long."""
    return F.round(x).cast("long")


def grid_index(t, t0, fs) -> Column:
    """The grid position of time t: multiplied before divided, so exact as long as doubles are."""
    return llround((col(t) - col(t0)).cast("double") * col(fs) / F.lit(1e6))


def grid_length(t0, t1, fs) -> Column:
    return F.greatest(grid_index(t1, t0, fs), F.lit(0).cast("long"))


def span(n, fs) -> Column:
    """Microseconds that n samples take."""
    return llround(col(n).cast("double") * F.lit(1e6) / col(fs))


def block_end(start, n, fs) -> Column:
    return col(start) + span(n, fs)


def block_start(start, pos, fs) -> Column:
    """From the write's start and a position in it, never accumulated."""
    return col(start) + llround(col(pos).cast("double") / col(fs) * F.lit(1e6))


def overlaps(start, end, t0, t1) -> Column:
    """A block [start, end) against the half-open window [t0, t1)."""
    return (col(end) > col(t0)) & (col(start) < col(t1))


def block_length(fs, override=0) -> Column:
    """Samples of a full block: the override if positive, one second from 5 kHz on, else ten."""
    o, f = col(override), col(fs)
    return F.when(o > 0, o.cast("long")).when(f >= 5000, F.floor(f)).otherwise(F.floor(f * 10)).cast("long")


def factor(precision) -> Column:
    """Units per count at a decimal precision."""
    return F.pow(F.lit(10.0), -col(precision).cast("double"))


def precision_of(ufact) -> Column:
    return llround(-F.log10(col(ufact))).cast("int")


def is_valid(x) -> Column:
    return col(x).isNotNull() & ~F.isnan(col(x))


def quantize(x, precision) -> Column:
    """Counts at a decimal precision, null at gaps; a count outside 32 bits raises (ANSI cast)."""
    return F.when(is_valid(x), F.round(col(x) * F.pow(F.lit(10.0), col(precision).cast("double"))).cast("int"))


def scale(count, ufact, valid=None) -> Column:
    value = col(count).cast("double") * col(ufact)
    return value if valid is None else F.when(col(valid), value)


def round_to_int(x) -> Column:
    """Half away from zero, held within 32 bits and off the smallest value."""
    return F.greatest(F.least(F.round(col(x)), F.lit(float(INT_MAX))), F.lit(float(-INT_MAX))).cast("int")


def absolute_time(stored, rto) -> Column:
    """Stored times are negated and relative to the recording-time offset; the sentinel is null."""
    s = col(stored)
    return F.when(s == UUTC_NONE, F.lit(None).cast("long")).when(s >= 0, s).otherwise(-s + col(rto))


def disk_time(t, rto) -> Column:
    return F.coalesce(col(rto) - col(t), F.lit(UUTC_NONE))


def segment_name(channel, number) -> Column:
    return F.format_string("%s-%06d", col(channel), col(number))


def segment_number(name) -> Column:
    """The digits after the last dash, 0 without any."""
    tail = F.regexp_extract(col(name), r"-([0-9]{1,9})$", 1)
    return F.when(tail != "", tail.cast("int")).otherwise(0)


def has_flag(flags, mask: int) -> Column:
    return col(flags).bitwiseAND(mask) != 0


def fixed_text(text, width: int) -> Column:
    """What a zero-padded field of so many bytes gives back: cut at the first zero, then at width bytes."""
    return F.decode(F.substring(F.encode(F.substring_index(col(text), "\0", 1), "utf-8"), 1, width), "utf-8")


def described(text, name) -> Column:
    """An empty description falls back to the name."""
    return F.coalesce(F.nullif(col(text), F.lit("")), col(name))


def member_name(path) -> Column:
    """An archive member's name without leading ./ and outer slashes."""
    return F.trim(F.regexp_replace(col(path), r"^(\./)+", ""), F.lit("/"))
