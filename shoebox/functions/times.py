"""Time recovery and calendar columns.  All times are naive local times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The two textual forms of capture times, the patterns of file names, and the years
#: that a date in a name may have.
EXIF_FORMAT, PLAIN_FORMAT = "yyyy:M:d H:m:s", "yyyy-M-d H:m:s"
_COMPACT = r"(?<!\d)(\d{4})(\d{2})(\d{2})[_\- ]?(\d{2})(\d{2})(\d{2})(?!\d)"
_DASHED = r"(\d{4})[-_](\d{2})[-_](\d{2})[ _.\-](\d{2})[.\-_](\d{2})[.\-_](\d{2})"
_DAY = r"(?<!\d)(\d{4})[-_]?(\d{2})[-_]?(\d{2})(?!\d)"
_STRATUM = r"^.*?(\d{4})(\d{2})(\d{2})[_\-]"
_EIGHT = r"(?<!\d)(\d{4})(\d{2})(\d{2})(?!\d)"
FIRST_YEAR, LAST_YEAR = 1990, 2030


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _instant(name: Column, pattern: str, clock: bool) -> Column:
    part = lambda i: F.regexp_extract(name, pattern, i)
    day = F.concat_ws("-", part(1), part(2), part(3))
    time = F.concat_ws(":", part(4), part(5), part(6)) if clock else F.lit("12:00:00")
    return F.try_to_timestamp(F.concat_ws(" ", day, time), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def filename_time(path: Column) -> Column:
    """Capture time from a file name; date-only names mean noon, invalid dates are null.

    The first pattern found decides, even when its date is invalid.
    """
    name = basename(path)
    return (
        F.when(name.rlike(_COMPACT), _instant(name, _COMPACT, True))
        .when(name.rlike(_DASHED), _instant(name, _DASHED, True))
        .when(name.rlike(_DAY), _instant(name, _DAY, False))
    )


def stratum_date(path: Column) -> Column:
    """Day of a path for stratified sampling: ``yyyy-mm-dd``, else a year folder, else ``unknown``."""
    years = F.filter(F.split(path, "/"), lambda s: s.rlike(r"^\d{4}$") & F.when(s.rlike(r"^\d{4}$"), s.cast("int")).between(FIRST_YEAR, LAST_YEAR))
    return F.coalesce(_sound_day(basename(path), _STRATUM), F.try_element_at(years, F.lit(1)), F.lit("unknown"))


def _sound_day(name: Column, pattern: str) -> Column:
    """``yyyy-mm-dd`` of a pattern's three groups if year, month and day are in range, else null."""
    y, m, d = (F.regexp_extract(name, pattern, i) for i in (1, 2, 3))
    inside = name.rlike(pattern) & F.try_to_number(y, F.lit("9999")).between(FIRST_YEAR, LAST_YEAR) & F.try_to_number(m, F.lit("99")).between(1, 12) & F.try_to_number(d, F.lit("99")).between(1, 31)
    return F.when(inside, F.concat_ws("-", y, m, d))


def compact_date(path: Column) -> Column:
    """``yyyy-mm-dd`` of the first eight-digit run in the file name if it can be a date, else null."""
    return _sound_day(basename(path), _EIGHT)


def exif_time(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text, F.lit(EXIF_FORMAT)), F.try_to_timestamp(text, F.lit(PLAIN_FORMAT))).cast("timestamp_ntz")


def resolved_time(exif: Column, path: Column, modified: Column) -> Column:
    """Struct (time, source): EXIF, then file name, then modification time."""
    from_exif, from_name = exif_time(exif), filename_time(path)
    source = F.when(from_exif.isNotNull(), "exif").when(from_name.isNotNull(), "filename").when(modified.isNotNull(), "mtime")
    return F.struct(F.coalesce(from_exif, from_name, modified.cast("timestamp_ntz")).alias("time"), source.alias("source"))


def season(month: Column) -> Column:
    return F.when(month.between(3, 5), "春").when(month.between(6, 8), "夏").when(month.between(9, 11), "秋").when(month.isin(12, 1, 2), "冬")


def season_year(year: Column, month: Column) -> Column:
    """January and February belong to the winter that began the year before."""
    return F.when(month.isin(1, 2), year - 1).otherwise(year)


def on_weekend(time: Column) -> Column:
    return F.weekday(time) >= 5
