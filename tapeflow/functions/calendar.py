"""Jalali (Persian solar) calendar as pure Column arithmetic.

No Python UDF: every conversion is integer arithmetic on Columns, so it
stays inside whole-stage codegen.  All divisions and remainders below are
taken on non-negative operands, so floor division and remainder agree.

The day count uses the 33-year arithmetic cycle.  Fixed values (they must
stay as they are for correct dates): the Jalali year is shifted by 1595;
a 33-year cycle has 12053 days and a 4-year cycle 1461; the epoch offsets
are 355668 (forward) / 355667 (inverse) and 719528 (days from 0000-03-01
proleptic to 1970-01-01); months 1–6 have 31 days, 7–11 have 30, and 12
has 29 or 30; the leap years are those with year % 33 in
{1, 5, 9, 13, 17, 22, 26, 30}.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.functions.columns import as_col, idiv

LEAP_REMAINDERS = (1, 5, 9, 13, 17, 22, 26, 30)


def jalali_leap(jy) -> Column:
    return F.pmod(as_col(jy), F.lit(33)).isin(*LEAP_REMAINDERS)


def jalali_valid(jy, jm, jd) -> Column:
    jy, jm, jd = as_col(jy), as_col(jm), as_col(jd)
    month_len = (F.when(jm <= 6, F.lit(31))
                 .when(jm <= 11, F.lit(30))
                 .when(jalali_leap(jy), F.lit(30))
                 .otherwise(F.lit(29)))
    return ((jy > -1595) & jm.between(1, 12) & (jd >= 1) & (jd <= month_len))


def jalali_epoch_day(jy, jm, jd) -> Column:
    """Days since 1970-01-01 of a Jalali date; NULL when the date is invalid."""
    jy, jm, jd = (as_col(c).cast("long") for c in (jy, jm, jd))
    y = jy + 1595
    month_days = F.when(jm < 7, (jm - 1) * 31).otherwise((jm - 7) * 30 + 186)
    days = (F.lit(-355668) + y * 365 + idiv(y, 33) * 8
            + idiv(F.pmod(y, F.lit(33)) + 3, 4) + jd + month_days - 719528)
    return F.when(jalali_valid(jy, jm, jd), days)


def jalali_to_date(jy, jm, jd) -> Column:
    """Jalali (y, m, d) → Gregorian DATE (NULL if invalid)."""
    return F.date_from_unix_date(jalali_epoch_day(jy, jm, jd).cast("int"))


def _jalali_steps(d, p: str) -> list[tuple[str, Column]]:
    """C3 as a chain of small named steps (each refers to the previous ones
    by ``p`` + name).

    ``D`` counts days from the start of the 33-year cycle era; ``s`` is the
    day inside the 4-year group, ``yo`` the year inside it (0–3) and
    ``sy`` the day of the Jalali year (0-based).
    """
    def c(name: str) -> Column:
        return F.col(p + name)
    return [
        ("D", F.unix_date(as_col(d)).cast("long") + (719528 + 355667)),
        ("r", F.pmod(c("D"), F.lit(12053))),
        ("s", F.pmod(c("r"), F.lit(1461))),
        ("yo", idiv(F.greatest(c("s") - 1, F.lit(0)), 365)),
        ("y", idiv(c("D"), 12053) * 33 + idiv(c("r"), 1461) * 4 + c("yo") - 1595),
        ("sy", c("s") - c("yo") * 365 - F.least(c("yo"), F.lit(1))),
        ("late", (c("sy") - 186)),
    ]


def _jalali_fields(p: str) -> dict[str, Column]:
    late, sy = F.col(p + "late"), F.col(p + "sy")
    return {
        "j_year": F.col(p + "y").cast("int"),
        "j_month": F.when(late < 0, idiv(sy, 31) + 1).otherwise(idiv(late, 30) + 7).cast("int"),
        "j_day": F.when(late < 0, F.pmod(sy, F.lit(31)) + 1)
                  .otherwise(F.pmod(late, F.lit(30)) + 1).cast("int"),
    }


def with_jalali_fields(df: DataFrame, date_col: str = "date", prefix: str = "") -> DataFrame:
    """C3 in DataFrame form: add ``j_year, j_month, j_day`` (with ``prefix``).

    Each intermediate is its own projected column, so it is computed once
    per row and the generated code stays small enough to be JIT-compiled.
    """
    tmp = f"_c3_{prefix}"
    steps = _jalali_steps(date_col, tmp)
    out = df
    for name, expr in steps:
        out = out.withColumn(tmp + name, expr)
    known = F.col(date_col).isNotNull()
    out = out.withColumns({prefix + k: F.when(known, v)
                           for k, v in _jalali_fields(tmp).items()})
    return out.drop(*[tmp + n for n, _ in steps])


def date_to_jalali(d) -> Column:
    """Gregorian DATE → struct(j_year, j_month, j_day) as one Column.

    Prefer ``with_jalali_fields`` on large inputs (no repeated sub-trees).
    """
    day = F.unix_date(as_col(d)).cast("long") + (719528 + 355667)
    r = F.pmod(day, F.lit(12053))
    s = F.pmod(r, F.lit(1461))
    yo = idiv(F.greatest(s - 1, F.lit(0)), 365)
    y = idiv(day, 12053) * 33 + idiv(r, 1461) * 4 + yo - 1595
    sy = s - yo * 365 - F.least(yo, F.lit(1))
    late = sy - 186
    month = F.when(late < 0, idiv(sy, 31) + 1).otherwise(idiv(late, 30) + 7)
    dom = F.when(late < 0, F.pmod(sy, F.lit(31)) + 1).otherwise(F.pmod(late, F.lit(30)) + 1)
    return F.when(as_col(d).isNotNull(), F.struct(
        y.cast("int").alias("j_year"),
        month.cast("int").alias("j_month"),
        dom.cast("int").alias("j_day")))


def jalali_text(j) -> Column:
    """Format a struct(j_year, j_month, j_day) as ``yyyy-MM-dd``."""
    j = as_col(j)
    return F.concat_ws(
        "-",
        F.lpad(j["j_year"].cast("string"), 4, "0"),
        F.lpad(j["j_month"].cast("string"), 2, "0"),
        F.lpad(j["j_day"].cast("string"), 2, "0"))


# A Jalali date with an optional time of day, fraction included; anything else
# is no date.
_DATE_TIME = (r"^\d{1,4}[-/]\d{1,2}[-/]\d{1,2}"
              r"(?:[ T]+\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d{1,6})?)?)?$")


def _parts(text) -> Column:
    t = F.trim(as_col(text))
    return F.when(t.rlike(_DATE_TIME), F.split(t, r"[- :/T]+"))


def _part(parts: Column, i: int, kind: str = "int") -> Column:
    return F.try_element_at(parts, F.lit(i + 1)).try_cast(kind)


def _time_interval(h: Column, mi: Column, s: Column) -> Column:
    """A time of day as an interval; NULL unless 00:00:00 ≤ it < 24:00:00."""
    h, mi, s = (F.coalesce(x, F.lit(0)) for x in (h, mi, s))
    return F.when((h < 24) & (mi < 60) & (s < 60),
                  F.make_dt_interval(F.lit(0), h, mi, s.cast("decimal(8,6)")))


def parse_jalali_date(text) -> Column:
    """``yyyy-MM-dd`` (or ``/``-separated) Jalali text → Gregorian DATE."""
    p = _parts(text)
    return jalali_to_date(_part(p, 0), _part(p, 1), _part(p, 2))


def _time_of_day(p: Column, with_seconds: bool) -> Column:
    t = _time_interval(_part(p, 3), _part(p, 4), _part(p, 5, "decimal(8,6)"))
    return t if with_seconds else F.when(
        t.isNotNull(), _time_interval(_part(p, 3), _part(p, 4), F.lit(0)))


def parse_download(text) -> Column:
    """Jalali capture text ``yyyy-MM-dd HH:mm:ss`` → Gregorian TIMESTAMP_NTZ.

    Fractions of a second are kept.  An impossible date (e.g. 1400-12-30) or
    time (25:61:00) gives NULL, to be quarantined.
    """
    p = _parts(text)
    d = jalali_to_date(_part(p, 0), _part(p, 1), _part(p, 2))
    return d.cast("timestamp_ntz") + _time_of_day(p, with_seconds=True)


def jalali_to_minute(text) -> Column:
    """Jalali ``yyyy-MM-dd HH:mm[:ss]`` → Gregorian TIMESTAMP_NTZ, seconds dropped."""
    p = _parts(text)
    d = jalali_to_date(_part(p, 0), _part(p, 1), _part(p, 2))
    return d.cast("timestamp_ntz") + _time_of_day(p, with_seconds=False)


def with_jalali_parsed(df: DataFrame, text: str, out: str, kind: str = "date") -> DataFrame:
    """Parse Jalali text once per row into ``out`` (DataFrame form of C1/C2/C6).

    ``kind``: ``"date"`` (C1 on ``yyyy-MM-dd``), ``"timestamp"`` (C6, keeps
    seconds) or ``"minute"`` (C2, drops seconds).  The text is split once
    into integer columns, then converted — the Column forms above repeat
    the split inside every branch of the validity test.
    """
    parts = "_jp_" + out
    names = [f"_j{i}_{out}" for i in range(6)]
    ep = f"_je_{out}"
    step = df.withColumn(parts, _parts(text))
    step = step.withColumns({n: _part(F.col(parts), i, "decimal(8,6)" if i == 5 else "int")
                             for i, n in enumerate(names)})
    step = step.withColumn(ep, jalali_epoch_day(*[F.col(n) for n in names[:3]]).cast("int"))
    d = F.date_from_unix_date(F.col(ep))
    if kind == "date":
        value = d
    else:
        h, mi, sec = (F.col(n) for n in names[3:])
        value = d.cast("timestamp_ntz") + _time_interval(h, mi, sec)
        if kind == "minute":
            value = F.date_trunc("minute", value).cast("timestamp_ntz")
    return step.withColumn(out, value).drop(parts, ep, *names)


def session_date(ts) -> Column:
    """Timestamp → session date."""
    return F.to_date(as_col(ts))


def to_minute(ts) -> Column:
    """C2 on an already Gregorian timestamp: truncate to the minute."""
    return F.date_trunc("minute", as_col(ts)).cast("timestamp_ntz")


def normalise_time(text) -> Column:
    """``H:m:s`` text → fixed-width ``HH:mm:ss`` (orders as a string); text
    that is no time of day gives NULL."""
    t = F.trim(as_col(text))
    p = F.split(t, ":")
    parts = [F.coalesce(F.try_element_at(p, F.lit(i)), F.lit("0")) for i in (1, 2, 3)]
    valid = t.rlike(r"^(?:[01]?\d|2[0-3])(?::[0-5]?\d){0,2}$")
    return F.when(valid, F.concat_ws(":", *(F.lpad(x, 2, "0") for x in parts)))
