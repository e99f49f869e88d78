"""Missing values, truth tests, rounding and lenient numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that count as "no value given".
NA_EXACT = (
    "na", "n/a", "n.a.", "n / a", "none", "tbc", "tbd", "—", "-", "null", "undefined", "not applicable",
    "does not apply", "all", "shortlisted", "no", "nil", "n/a (non-selective admissions)",
    "n/a (faith priority criteria)", "none (supplementary information form [sif] required)",
    "none (statutory admissions code)",
)
NA_PREFIXES = ("n/a", "na ", "none", "tbc", "tbd", "not app", "does not")

# Every character a browser engine treats as white space.
_WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_all(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col(c), f"^{_WS}+|{_WS}+$", "")


def text(c: Column | str) -> Column:
    """The text, or '' where it is missing."""
    return F.coalesce(col(c), F.lit(""))


def filled(c: Column | str) -> Column:
    """Not null and not the empty text; never null itself."""
    return text(c) != ""


def present(c: Column | str) -> Column:
    """Holds something besides white space."""
    return trim_all(text(c)) != ""


def nonzero(c: Column | str) -> Column:
    """A number that is neither missing nor zero."""
    return F.coalesce(col(c) != 0, F.lit(False))


def or_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def first_filled(*cols: Column | str) -> Column:
    """First text that is neither missing nor empty."""
    return F.coalesce(*[or_null(c) for c in cols])


def is_na(c: Column | str) -> Column:
    s = F.lower(trim_all(col(c)))
    starts = s.startswith(NA_PREFIXES[0])
    for p in NA_PREFIXES[1:]:
        starts = starts | s.startswith(p)
    return F.coalesce((s == "") | s.isin(*NA_EXACT) | starts, F.lit(True))


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, lo, hi) -> Column:
    """Within the bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))


def bind(value: Column, fn) -> Column:
    """Name a value inside an expression so that it is computed once, not once per use."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def lenient_int(c: Column | str) -> Column:
    """Leading whole number of a text; null where it starts with none."""
    return F.regexp_extract(col(c).cast("string"), r"^\s*([-+]?\d+)", 1).try_cast("bigint")


def lenient_float(c: Column | str) -> Column:
    return F.regexp_extract(col(c).cast("string"), r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double")


def any_of(conds: list[Column]) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def contains_any(c: Column, words) -> Column:
    return any_of([c.contains(w) for w in words])


def up_to(df: DataFrame, limit: int | None) -> DataFrame:
    """The first rows of an ordered result; all of it without a limit."""
    return df if limit is None else df.limit(limit)


def spread_blank(key: Column, by: Column) -> Column:
    """A join key for left joins whose blank values, of which there may be many, meet nothing and lie evenly over all tasks."""
    return F.when(F.coalesce(key, F.lit("")) != "", key).otherwise(F.concat(F.lit("\u0000"), F.xxhash64(by).cast("string")))
