"""Scalar column functions.

Every function returns a ``Column`` built from built-in Spark expressions so that
plans stay inside whole-stage codegen; no Python UDF is involved.  ANSI mode is
assumed, so coercions use ``try_cast`` / ``try_to_timestamp`` (junk -> null).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def col_or(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(c, F.lit(C.WHITE_SPACE))


# --- F1: timestamps --------------------------------------------------------
def parse_text_datetime(c: str | Column, fmt: str = C.DATETIME_TEXT_FORMAT) -> Column:
    """Parse text with the dispatch format, months, days and hours of one or two
    digits; failures become null (NTZ result)."""
    return F.try_to_timestamp(trimmed(col_or(c).cast("string")), F.lit(fmt)).cast("timestamp_ntz")


def parse_generic_datetime(c: str | Column) -> Column:
    """Fallback parse used only when no value of an input matches the format:
    ISO text, then the usual variants, the first that fits."""
    text = trimmed(col_or(c).cast("string"))
    return F.coalesce(text.try_cast("timestamp_ntz"),
                      *(F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in C.GENERIC_DATETIME_FORMATS))


def minutes_between(start: str | Column, end: str | Column) -> Column:
    """Exact elapsed minutes (microsecond precision) between two timestamps."""
    return F.timestamp_diff("MICROSECOND", col_or(start), col_or(end)) / F.lit(60_000_000.0)


# --- F3: calendar parts ----------------------------------------------------
def hour_of(c: str | Column) -> Column:
    return F.hour(col_or(c))


def weekday_of(c: str | Column) -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(col_or(c))


def month_of(c: str | Column) -> Column:
    return F.month(col_or(c))


# --- F4–F7: coercion -------------------------------------------------------
def to_number(c: str | Column) -> Column:
    """Numeric coercion, junk -> null (F6); NaN, as text or as a number, is missing too.

    Spark reads suffixed text such as ``1d`` as a number, so text has to look like one.
    ``typeof`` is a constant, so numeric columns pay for no text.
    """
    value = col_or(c)
    text = trimmed(value.cast("string"))
    read = F.when(F.typeof(value) == "string", F.when(text.rlike(C.NUMBER_PATTERN), text.try_cast("double"))).otherwise(value.try_cast("double"))
    return F.nullif(read, F.lit(math.nan))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def dispatch_seconds(c: str | Column) -> Column:
    """coerce, null -> 0, clip to [0, 600]."""
    return clip(F.coalesce(to_number(c), F.lit(0.0)), C.DISPATCH_CLIP_LOW, C.DISPATCH_CLIP_HIGH)


def yes_flag(c: str | Column) -> Column:
    """trimmed, upper-cased text equal to 'Y' -> 1, anything else (null too) -> 0."""
    return F.coalesce((F.upper(trimmed(col_or(c).cast("string"))) == F.lit("Y")).cast("int"), F.lit(0))


def as_text(c: str | Column) -> Column:
    """value as trimmed text; a missing value becomes the text 'nan'."""
    return trimmed(F.coalesce(col_or(c).cast("string"), F.lit("nan")))


# --- F8–F9: derived features ----------------------------------------------
def cyclical(c: str | Column, period: int, offset: int = 0) -> tuple[Column, Column]:
    angle = F.lit(2.0 * math.pi) * (col_or(c) - F.lit(offset)) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def is_weekend(day_of_week: str | Column) -> Column:
    return (col_or(day_of_week) >= F.lit(C.WEEKEND_FIRST_DAY)).cast("int")


def is_night(hour: str | Column) -> Column:
    h = col_or(hour)
    return ((h >= F.lit(C.NIGHT_START_HOUR)) | (h <= F.lit(C.NIGHT_END_HOUR))).cast("int")


def is_rush_hour(hour: str | Column) -> Column:
    return col_or(hour).isin(C.RUSH_HOURS).cast("int")


# --- F11–F14: report helpers ----------------------------------------------
def clip_lower_zero(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def priority_label(mean: Column, slow_share: Column, global_mean: Column) -> Column:
    """first matching rule wins."""
    return (
        F.when((mean >= global_mean + F.lit(C.PRIORITY_HIGH_MARGIN))
               & (slow_share >= F.lit(C.PRIORITY_HIGH_SLOW_SHARE)), F.lit(C.PRIORITY_LABELS[0]))
        .when(mean >= global_mean + F.lit(C.PRIORITY_MEDIUM_MARGIN), F.lit(C.PRIORITY_LABELS[1]))
        .otherwise(F.lit(C.PRIORITY_LABELS[2]))
    )


def priority_rank(label: Column) -> Column:
    """Sort key for priority labels: high=1, medium=2, watch=3."""
    expr = None
    for rank, name in enumerate(C.PRIORITY_LABELS, start=1):
        expr = (F.when(label == F.lit(name), F.lit(rank)) if expr is None
                else expr.when(label == F.lit(name), F.lit(rank)))
    return expr


def day_period(hour: str | Column) -> Column:
    """bins closed on the right, [0, 6] (6, 12] (12, 18] (18, 24]."""
    h = col_or(hour)
    expr = None
    for upper, name in C.DAY_PERIODS:
        expr = (F.when(h <= F.lit(upper), F.lit(name)) if expr is None
                else expr.when(h <= F.lit(upper), F.lit(name)))
    return expr


def round_half_up(c: Column, digits: int) -> Column:
    """Rounding written the same way in Spark and in the SQL oracle.

    ``floor(v + 0.5 + |v| * 1e-9) / 10^d`` with ``v = x * 10^d``.  The formula is
    bit-identical in both engines for the same input, unlike the engines' own
    ``round``.  The tiny relative nudge moves the rounding boundary off exact
    binary halves (a mean such as 14.46875 is common for small groups), where
    last-bit noise from a different summation order would otherwise decide
    the direction.
    """
    scale = float(10 ** digits)
    v = c * F.lit(scale)
    return F.floor(v + F.lit(0.5) + F.abs(v) * F.lit(1e-9)) / F.lit(scale)


def percent(c: Column, digits: int = 1) -> Column:
    """Ratio -> percent with ``digits`` decimals."""
    return round_half_up(c * F.lit(100.0), digits)


def slugify(c: str | Column) -> Column:
    """F16: lower case; spaces and hyphens -> underscores."""
    return F.translate(F.lower(col_or(c)), " -", "__")


def slugify_text(value: str) -> str:
    """F16 for one name outside a table (paths of saved models)."""
    return value.lower().translate(str.maketrans(" -", "__"))


def signed_error(predicted: Column, actual: Column) -> Column:
    """prediction minus actual."""
    return predicted - actual


# --- deterministic hashing for splits and samples -------------------------
# Odd multipliers below 2^32 and the moduli.  A factor is cut to 31
# bits before each product, so no product leaves the signed 64-bit range and the
# same steps can be written in SQL.
KEY_MULTIPLIER, SEED_MULTIPLIER = 2654435761, 668265263
ROUND_MULTIPLIERS = ((2246822519, 15), (3266489917, 13))
HASH_MODULUS = 4294967296
KEY_MODULUS = 2147483648


def key_hash(key: str | Column, seed: int = 0) -> Column:
    """A 32-bit hash of an integer key and a seed, reproducible in plain SQL.

    The seed enters before two rounds of xor-shift and multiplication, which are
    not linear together, so that two seeds order the keys independently.
    """
    k = F.pmod(col_or(key).cast("long"), F.lit(KEY_MODULUS))
    x = F.pmod(k * F.lit(KEY_MULTIPLIER) + F.lit(seed * SEED_MULTIPLIER % HASH_MODULUS), F.lit(HASH_MODULUS))
    for multiplier, shift in ROUND_MULTIPLIERS:
        low = x.bitwiseXOR(F.shiftright(x, shift)).bitwiseAND(F.lit(KEY_MODULUS - 1))
        x = F.pmod(low * F.lit(multiplier), F.lit(HASH_MODULUS))
    return x.bitwiseXOR(F.shiftright(x, 16))


def split_bucket(key: str | Column, seed: int = 0) -> Column:
    """Bucket 0..99 of a key; ``< 80`` is the training side of an 80/20 split."""
    return F.pmod(F.floor(key_hash(key, seed) / F.lit(65536)), F.lit(100))
