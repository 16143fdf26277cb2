"""Timestamps of many notations and zones to one UTC instant.

``parse_notation`` reads a text into wall-clock parts with built-in
expressions only: every notation is one anchored pattern whose groups are
rewritten to one canonical part list, so a value costs one match per notation
tried. ``zone_intervals`` explodes the offset history of each zone into
intervals of *local* time, bucketed by local year; ``normalise_instants``
looks each parsed local time up in the intervals of its zone and year (an
as-of join on the equi-key (zone, year)):

* two intervals hold it  -> the wall clock shows it twice; the first is meant,
* none holds it          -> the wall clock skips it; the offset before counts,
* one holds it           -> its offset counts.

The interval table has one row per zone and year (at most about 600 zones by
201 years), a bound that does not depend on the data, so it is broadcast and
the values never shuffle.

Edge cases: null, empty and unreadable texts, impossible dates (month 13,
30 February, 25:00, second 60) and relative wording give no row; a source
without a clock row is read as UTC with day before month; a repeated
``article_id`` gives one row per input row. Extra columns are dropped.
"""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_side, staged

#: First and last local year with intervals of its own; other years use the nearest.
YEARS = (1900, 2100)

WEEK_S = 7 * 86400

# Month names of en, de, fr, es (first letters suffice where they are unique).
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene",
    2: "february feb februar février févr fevrier febrero",
    3: "march mar märz maerz mrz mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre setiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre decembre diciembre dic déc",
}

_CLOCK = r"(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d{1,9})\d*)?)?"
_AMPM = r"(?: ?([ap])\.? ?m\.?)?"
_ZONE = r"(?: ?(z|[a-z]{2,5}|(?:utc|gmt|ut)? ?[+-]\d{1,2}(?::?\d{2})?))?"
_NAME = r"(\p{L}{3,10})\.?"
_DAYNAME = r"(?:\p{L}{2,10}\.?,? )?"
_BETWEEN = r"(?:,? (?:at |um |à |a las )?)"

# Each notation: pattern, canonical parts "year|month|day|hour|minute|second|fraction|half|zone|swap".
# ``swap`` marks dates whose day and month follow the order of the source.
NOTATIONS = [
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:(?:t| t?){_CLOCK}{_AMPM}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:t?(\d{{2}})(\d{{2}})(\d{{2}}){_ZONE})?$", "$1|$2|$3|$4|$5|$6|||$7|"),
    (rf"^{_DAYNAME}(\d{{1,2}})(?:st|nd|rd|th|er|\.)?(?: de(?= )|-)? ?{_NAME}(?: de(?= )|-|,)? ?(\d{{4}}|\d{{2}})(?:{_BETWEEN}{_CLOCK}{_AMPM}(?: uhr)?{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|"),
    (rf"^{_DAYNAME}{_NAME} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?:{_BETWEEN}{_CLOCK}{_AMPM}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:{_BETWEEN}{_CLOCK}{_AMPM}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|swap"),
    (rf"^(\d{{1,2}})[.-](\d{{1,2}})[.-](\d{{4}})(?:{_BETWEEN}{_CLOCK}{_AMPM}(?: uhr)?{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|"),
    (r"^(\d{4})年(\d{1,2})月(\d{1,2})日(?: ?(?:(上|下)午)? ?(\d{1,2})[:时時点](\d{2})分?(?::?(\d{2})秒?)?)?$", "$1|$2|$3|$5|$6|$7||$4||"),
]
_FULLWIDTH = ("０１２３４５６７８９：／－，．＋　", "0123456789:/-,.+ ")


def fold_text(value: Column) -> Column:
    """Lower case, ordinary digits and blanks, no invisible characters, trimmed."""
    plain = F.lower(F.trim(value))
    v = F.translate(value, *_FULLWIDTH)
    v = F.regexp_replace(v, r"[\p{Cf}]", "")
    v = F.regexp_replace(v, r"[\s\p{Z}]+", " ")
    return F.when(value.rlike(r"[^ -~]|  "), F.lower(F.trim(v))).otherwise(plain)


def parse_notation(df: DataFrame, text_col: str, month_first_col: str) -> DataFrame:
    """``df`` with ``_local_ms`` and ``_offset_s`` of the text; null ``_local_ms`` where it names no instant.

    ``_local_ms``: wall-clock milliseconds as if in UTC; ``_offset_s``: the
    offset the text states, null where the zone of the source is to be used;
    epoch texts carry offset 0. Each step is a projection of its own, so a
    shared part is computed once and the generated code stays small.
    """
    month_map = F.create_map(*[F.lit(x) for n, names in MONTHS.items() for name in names.split() for x in (name, str(n))])
    df = staged(df, _v=fold_text(F.col(text_col)))
    v = F.col("_v")
    digits_only = v.rlike(r"^(\d{10}(\.\d+)?|\d{13}|\d{16})$")
    parts = F.lit(None).cast("string")
    for pattern, groups in reversed(NOTATIONS):
        parts = F.when(v.rlike(pattern), F.regexp_replace(v, pattern, groups)).otherwise(parts)
    df = staged(df, _p=F.split(F.when(digits_only, F.concat(F.lit("epoch|"), v)).otherwise(parts), r"\|")).filter("_p is not null")

    def part(i: int) -> Column:
        return F.get("_p", F.lit(i))

    def num(i: int) -> Column:
        return part(i).try_cast("long")

    # Epoch texts: ten digits are seconds (with decimals), 13 milli-, 16 microseconds.
    whole, decimals = F.substring_index(part(1), ".", 1), F.when(part(1).contains("."), F.substring_index(part(1), ".", -1)).otherwise("")
    n_digits = F.length(whole)
    epoch = F.when(n_digits == 10, whole.try_cast("long") * 1000 + F.substring(F.rpad(decimals, 3, "0"), 1, 3).try_cast("long")).when(n_digits == 13, whole.try_cast("long")).otherwise(F.floor(whole.try_cast("long") / 1000))
    swap = (part(9) == "swap") & ~F.col(month_first_col)
    named = F.coalesce(num(1), F.try_element_at(month_map, part(1)).try_cast("long"))
    df = staged(df, **{
        "_epoch": F.when(part(0) == "epoch", epoch).cast("long"),
        "_y": F.when(F.length(part(0)) == 2, num(0) + F.when(num(0) < 70, 2000).otherwise(1900)).otherwise(num(0)),
        "_m": F.when(swap, num(2)).otherwise(named),
        "_d": F.when(swap, named).otherwise(num(2)),
        "_h": F.coalesce(num(3), F.lit(0)),
        "_mi": F.coalesce(num(4), F.lit(0)),
        "_s": F.coalesce(num(5), F.lit(0)),
        "_ms": F.coalesce(F.substring(F.rpad(part(6), 3, "0"), 1, 3).try_cast("long"), F.lit(0)),
        "_half": F.nullif(part(7), F.lit("")),
        "_zone": F.coalesce(part(8), F.lit("")),
    })
    df = staged(df, **{
        "_oh": F.regexp_extract("_zone", r"[+-](\d{1,2})(?::?\d{2})?$", 1).try_cast("long"),
        "_om": F.coalesce(F.regexp_extract("_zone", r"[+-]\d{1,2}:?(\d{2})$", 1).try_cast("long"), F.lit(0)),
        "_leap": F.expr("(_y % 4 = 0) and (_y % 100 <> 0 or _y % 400 = 0)"),
        "_yy": F.expr("_y - if(_m <= 2, 1, 0)"),
    })
    # Days since 1970-01-01 of a Gregorian date, in integer arithmetic.
    days = "(_yy - pmod(_yy, 400)) div 400 * 146097 + pmod(_yy, 400) * 365 + pmod(_yy, 400) div 4 - pmod(_yy, 400) div 100 + (153 * (_m + if(_m > 2, -3, 9)) + 2) div 5 + _d - 1 - 719468"
    df = staged(df, **{
        "_days": days,
        "_hour": F.expr("case when _half in ('p', '下') then _h % 12 + 12 when _half in ('a', '上') then _h % 12 else _h end"),
        "_possible": F.expr(
            "coalesce(_m between 1 and 12 and _y >= 1 and _d >= 1 and _d <= case when _m in (4, 6, 9, 11) then 30 when _m = 2 then if(_leap, 29, 28) else 31 end"
            " and _h <= 23 and _mi <= 59 and _s <= 59 and (_half is null or _h between 1 and 12) and (_oh is null or (_oh <= 18 and _om <= 59)), false)"),
        "_stated": F.expr("case when _zone in ('z', 'utc', 'gmt', 'ut') then 0L when _oh is not null then if(_zone like '%-%', -1L, 1L) * (_oh * 3600 + _om * 60) end"),
    })
    scratch = ["_v", "_p", "_epoch", "_y", "_m", "_d", "_h", "_mi", "_s", "_ms", "_half", "_zone", "_oh", "_om", "_leap", "_yy", "_days", "_hour", "_possible", "_stated"]
    return staged(df, **{
        "_local_ms": "case when _epoch is not null then _epoch when _possible then (_days * 86400 + _hour * 3600 + _mi * 60 + _s) * 1000 + _ms end",
        "_offset_s": "if(_epoch is not null, 0L, _stated)",
    }).drop(*scratch)


def _offset(zone: ZoneInfo, utc_s: int) -> int:
    at = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=utc_s)
    return int(at.astimezone(zone).utcoffset().total_seconds())


def offset_history(tz_name: str, years: tuple[int, int] = YEARS) -> list[tuple[int, int]]:
    """(first UTC second, offset) of each period of constant offset, in order.

    Weeks are scanned and each change is found by bisection to the second; no
    zone leaves an offset and returns to it within one week.
    """
    zone = ZoneInfo(tz_name)
    start = int((dt.datetime(years[0], 1, 1) - dt.datetime(1970, 1, 1)).total_seconds()) - 2 * 86400
    end = int((dt.datetime(years[1] + 1, 1, 1) - dt.datetime(1970, 1, 1)).total_seconds()) + 2 * 86400
    history = [(-(2**53), _offset(zone, start))]
    for t in range(start + WEEK_S, end, WEEK_S):
        if (now := _offset(zone, t)) != history[-1][1]:
            lo, hi = t - WEEK_S, t
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if _offset(zone, mid) == history[-1][1] else (lo, mid)
            history.append((hi, now))
    return history


_INTERVALS = T.StructType([
    T.StructField("tz_name", T.StringType()),
    T.StructField("local_year", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("off", T.LongType()),
    ]))),
])


def zone_intervals(spark: SparkSession, tz_names: list[str], years: tuple[int, int] = YEARS) -> DataFrame:
    """Local-time intervals [lo, hi) of constant offset by zone and local year, oldest first.

    Names that are no zone are left out; their sources are then read as UTC.
    """
    def year_start(y: int) -> int:
        return int((dt.datetime(y, 1, 1) - dt.datetime(1970, 1, 1)).total_seconds())

    rows = []
    for name in sorted(set(tz_names)):
        try:
            history = offset_history(name, years)
        except (ZoneInfoNotFoundError, ValueError, OSError):
            continue
        ends = [u for u, _ in history[1:]] + [2**53]
        spans = [(u + off, end + off, off) for (u, off), end in zip(history, ends)]
        i = 0
        for y in range(years[0], years[1] + 1):
            lo, hi = year_start(y) if y > years[0] else -(2**52), year_start(y + 1) if y < years[1] else 2**52
            while spans[i][1] <= lo - 2 * 86400:
                i += 1
            j, here = i, []
            while j < len(spans) and spans[j][0] < hi:
                here.append(spans[j])
                j += 1
            rows.append((name, y, here))
    return spark.createDataFrame(rows, _INTERVALS)


def normalise_instants(articles: DataFrame, clocks: DataFrame, fields: list[str], id_col: str = "article_id", source_col: str = "source_code") -> DataFrame:
    """One row (id, field, utc_ms, local_time_kind) per readable value of ``fields``.

    ``local_time_kind``: 'stated' (offset or epoch in the text), 'unique',
    'ambiguous' (first occurrence taken) or 'skipped' (offset before the change).
    """
    spark = articles.sparkSession
    clock_rows = clocks.select(F.lower(F.trim("source_code")).alias("_src"), "tz_name", (F.upper("date_order") == "MDY").alias("_mdy")).filter("_src is not null").dropDuplicates(["_src"])
    zones = [r[0] for r in clocks.select("tz_name").filter("tz_name is not null").distinct().collect()]  # at most the IANA zones, about 600
    intervals = zone_intervals(spark, zones)

    values = (
        articles.select(F.col(id_col), F.lower(F.trim(source_col)).alias("_src"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])).alias("_e"))
        .filter("_e.text is not null and _e.text <> ''")
        .join(small_side(clock_rows), "_src", "left")
        .select(id_col, "_e.field", "_e.text", F.coalesce("tz_name", F.lit("UTC")).alias("tz_name"), F.coalesce("_mdy", F.lit(False)).alias("_mdy"))
    )
    parsed = parse_notation(values, "text", "_mdy").filter("_local_ms is not null")
    parsed = staged(parsed, _local_s="cast(floor(_local_ms / 1000) as bigint)")
    year = F.year(F.date_add(F.lit(dt.date(1970, 1, 1)), F.expr("cast(floor(_local_s / 86400) as int)"))).cast("long")
    parsed = parsed.withColumn("local_year", F.least(F.greatest(year, F.lit(YEARS[0])), F.lit(YEARS[1])).cast("long"))
    # The interval table is bounded by zones times years, whatever the data holds.
    joined = parsed.join(F.broadcast(intervals), ["tz_name", "local_year"], "left")
    joined = staged(joined, _hits="filter(spans, x -> x.lo <= _local_s and _local_s < x.hi)")
    joined = staged(joined, _past="case when size(_hits) = 0 then filter(spans, x -> x.hi <= _local_s) end")
    stated = "(_offset_s is not null or spans is null)"
    offset = "coalesce(_offset_s, get(_hits, 0).off, get(_past, size(_past) - 1).off, 0L)"
    kind = f"case when {stated} then 'stated' when size(_hits) >= 2 then 'ambiguous' when size(_hits) = 0 then 'skipped' else 'unique' end"
    return joined.select(id_col, "field", F.expr(f"_local_ms - {offset} * 1000").cast("long").alias("utc_ms"), F.expr(kind).alias("local_time_kind"))
