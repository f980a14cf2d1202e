"""Mixed timestamp notations and zones to one UTC moment.

An ordered cascade of anchored patterns rewrites each notation into one canonical spelling; what no pattern takes
stays unread. The canonical spelling is then parsed strictly (no such day, hour or month: no moment). Everything is
made of JVM expressions. A text's own zone goes before that of its calendar. Local times that occur twice or not at
all take the offset in force before the change.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {"UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540,
                 "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}
#: Lookup of the zones of calendars by name: an offset or a named zone; null has an entry of its own. Any ``gregorian+hh:mm`` or ``gregorian[Area/City]`` tells its zone itself.
ZONES: dict[str | None, str] = {None: "+09:00", "gregorian": "+00:00"}
# Month names by their first letters, English and German.
MONTHS = [("jan", 1), ("feb", 2), ("mar|mär|mrz", 3), ("apr", 4), ("may|mai", 5), ("jun", 6), ("jul", 7), ("aug", 8), ("sep", 9), ("o[ck]t", 10), ("nov", 11), ("de[cz]", 12)]
# The year before the first of each era.
ERAS = {"令和": 2018, "平成": 1988, "昭和": 1925, "大正": 1911, "明治": 1867}

_MONTH = r"(Jan(?:uary?)?|Januar|Feb(?:ruary?)?|Februar|Mar(?:ch)?|März|Mrz|Apr(?:il)?|May|Mai|June?|Juni|July?|Juli|Aug(?:ust)?|Sept?(?:ember)?|O[ck]t(?:ober)?|Nov(?:ember)?|De[cz](?:ember)?)\.?"
_DOW = r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\.?,?\s+)?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_JA_CLOCK = r"\s*(午前|午後)?\s*(\d{1,2})時(?:(\d{1,2})分(?:(\d{1,2})秒)?)?"
#: Pattern -> canonical ``date|hour|minute|second|fraction|half|zone``; the first that fits the whole text is taken.
CASCADE = [
    (rf"^(\d{{4}}-\d{{2}}-\d{{2}}|\d{{4}}-W\d{{2}}-\d|\d{{4}}-\d{{3}})$", r"$1|0|0|0|||"),
    (rf"^(\d{{4}}-\d{{2}}-\d{{2}}|\d{{4}}-W\d{{2}}-\d|\d{{4}}-\d{{3}})[Tt ]{_CLOCK}\s*(\S*)$", r"$1|$2|$3|$4|$5||$6"),
    (r"^(\d{4})(\d{2})(\d{2})$", r"$1-$2-$3|0|0|0|||"),
    (r"^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?(Z|[+-]\d{2}:?\d{2})?$", r"$1-$2-$3|$4|$5|$6|$7||$8"),
    (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})$", r"$1-$2-$3|0|0|0|||"),
    (rf"^(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}})\s+{_CLOCK}\s*(\S*)$", r"$1-$2-$3|$4|$5|$6|$7||$8"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", r"$3-$2-$1|0|0|0|||"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?\s+{_CLOCK}\s*(\S*)$", r"$3-$2-$1|$4|$5|$6|$7||$8"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"$3-$1-$2|0|0|0|||"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),?\s+{_CLOCK}\s*([AaPp]\.?[Mm]\.?)?\s*(\S*)$", r"$3-$1-$2|$4|$5|$6|$7|$8|$9"),
    (rf"^{_DOW}(\d{{1,2}})\.?(?:st|nd|rd|th)?\s+{_MONTH},?\s+(\d{{4}})$", r"$3-$2-$1|0|0|0|||"),
    (rf"^{_DOW}(\d{{1,2}})\.?(?:st|nd|rd|th)?\s+{_MONTH},?\s+(\d{{4}}),?\s+{_CLOCK}\s*([AaPp]\.?[Mm]\.?)?\s*(\S*)$", r"$3-$2-$1|$4|$5|$6|$7|$8|$9"),
    (rf"^{_DOW}{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})$", r"$3-$1-$2|0|0|0|||"),
    (rf"^{_DOW}{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}),?\s+{_CLOCK}\s*([AaPp]\.?[Mm]\.?)?\s*(\S*)$", r"$3-$1-$2|$4|$5|$6|$7|$8|$9"),
    (r"^((?:令和|平成|昭和|大正|明治)?(?:\d{1,4}|元))年(\d{1,2})月(\d{1,2})日$", r"$1-$2-$3|0|0|0|||"),
    (rf"^((?:令和|平成|昭和|大正|明治)?(?:\d{{1,4}}|元))年(\d{{1,2}})月(\d{{1,2}})日{_JA_CLOCK}$", r"$1-$2-$3|$5|$6|$7||$4|"),
]
_READ = r"^((?:令和|平成|昭和|大正|明治)?(?:\d{1,4}|元))-([^|]*?)(?:-(\d{1,2}))?\|(\d{0,2})\|(\d{0,2})\|(\d{0,2})\|(\d*)\|([^|]*)\|(.*)$"
_ZONES = sorted(z for z in zoneinfo.available_timezones() if "/" in z or z == "UTC")


def _offset(z: Column) -> Column:
    """Microseconds east of UTC of ``+hh:mm``, ``+hhmm`` or ``+hh`` (at most 18 hours), else null."""
    sign = F.when(z.startswith("-"), -1).otherwise(1)
    h, m = F.regexp_extract(z, r"^[+-](\d{2})", 1).cast("bigint"), F.regexp_extract(z, r"^[+-]\d{2}:?(\d{2})$", 1)
    mins = h * 60 + F.when(m == "", F.lit(0)).otherwise(m.try_cast("bigint"))
    return F.when(z.rlike(r"^[+-](0\d|1[0-7])(:?[0-5]\d)?$"), sign * mins * 60_000_000)


def _num(c: Column) -> Column:
    return F.when(c == "", F.lit(0)).otherwise(c.try_cast("int"))


def _cascade(day_first: bool) -> list[tuple[str, str]]:
    """CASCADE, with the first of two figures before a year after slashes as the day instead of the month."""
    swap = {"$3-$1-$2": "$3-$2-$1"}
    return [(p, to.replace("$3-$1-$2", swap["$3-$1-$2"]) if day_first and "/(\\d{1,2})/" in p else to) for p, to in CASCADE]


def with_utc_micros(df: DataFrame, text: str, calendar: str, out: str, *, zones: dict[str | None, str] | None = None, day_first: bool = False) -> DataFrame:
    """``df`` with ``out``: microseconds since 1970-01-01T00:00Z of the texts that name one day or a more precise moment, else null.

    ``calendar`` gives the zone of texts without one, by the lookup ``zones`` (``ZONES``), ``gregorian+hh:mm`` that
    offset, ``gregorian[Area/City]`` the civil time there; in any other calendar only texts with their own zone are
    read. ``day_first`` reads 3/4/2020 as the third of April. A day means its first moment; digits finer than
    microseconds are cut off. Texts may be of any length, blanks in them too; null and empty ones, years, months,
    intervals and days that do not exist give null. Hours of 24 to 47 count on into the next day. No row is added, lost or reordered.
    """
    names = df.columns

    def stage(d: DataFrame, **cols: Column) -> DataFrame:
        """One projection per stage, so that no field is computed twice."""
        return d.select("*", *[v.alias(f"_m_{k}") for k, v in cols.items()])

    m = lambda k: F.col(f"_m_{k}")
    # fullwidth forms (fixed values) to ASCII
    s = F.trim(F.translate(F.col(f"`{text}`"), "０１２３４５６７８９：／－．，＋　", "0123456789:/-.,+ "))
    d = stage(df, s=F.regexp_replace(s, r"\s+", " "))
    c = F.lit(None).cast("string")
    for pattern, to in reversed(_cascade(day_first)):
        c = F.when(m("s").rlike("(?i)" + pattern), F.regexp_replace(m("s"), "(?i)" + pattern, to)).otherwise(c)
    d = stage(d, c=c, n=F.regexp_replace(m("s"), r"^/Date\((-?\d{10,16})([+-]\d{4})?\)/$", "$1ms"))
    one = "\u0001"
    d = stage(
        d,
        g=F.split(F.regexp_replace(m("c"), _READ, one.join(f"${i}" for i in range(1, 10))), one),
        scale=F.when(m("n").endswith("ms"), 1000).when(m("n").rlike(r"^-?\d{9,10}(\.\d+)?$"), 1_000_000).when(m("n").rlike(r"^\d{12,13}$"), 1000).when(m("n").rlike(r"^\d{16}$"), 1).when(m("n").rlike(r"^\d{19}$"), 0),
    )
    digits = F.regexp_extract(m("n"), r"^(-?\d+)", 1).try_cast("bigint")
    frac = F.rpad(F.substring(F.regexp_extract(m("n"), r"\.(\d+)$", 1), 1, 6), 6, "0").try_cast("bigint")
    y, mo, day, h, mi, sec, fr, half, zone = (F.try_element_at(m("g"), F.lit(i)) for i in range(1, 10))
    era = F.regexp_extract(y, r"^(\D\D)", 1)
    base = F.lit(0)
    for name, before in ERAS.items():
        base = F.when(era == name, before).otherwise(base)
    year = base + F.when(y.endswith("元"), 1).otherwise(F.regexp_extract(y, r"(\d+)$", 1).try_cast("int"))
    month = mo.try_cast("int")
    for start, n in MONTHS:
        month = F.when(mo.rlike(f"(?i)^({start})"), n).otherwise(month)
    cal = F.col(f"`{calendar}`")
    cal_zone = F.regexp_extract(cal, r"^gregorian(?:\[(?=.+\]$))?([^\]]+)\]?$", 1)
    for name, at in (ZONES if zones is None else zones).items():
        cal_zone = F.when(cal.isNull() if name is None else cal == name, F.lit(at)).otherwise(cal_zone)
    own = F.regexp_replace(zone, r"^\[(.+)\]$", "$1")
    d = stage(
        d,
        epoch=F.when(m("scale") == 0, F.floor(digits / 1000).cast("bigint")).when(m("scale") == 1_000_000, digits * 1_000_000 + frac).when(m("scale").isNotNull(), digits * m("scale")),
        year=F.when((era != "") | (F.length(y) == 4), F.when(year.between(1, 9998), year)), month=month, mo=mo, day=day.try_cast("int"), nod=day == "", hour=_num(h), minute=_num(mi), second=_num(sec),
        frac=F.coalesce(F.rpad(F.substring(fr, 1, 6), 6, "0").try_cast("bigint"), F.lit(0)), half=F.regexp_replace(F.lower(half), r"\.", ""), own=own, cz=cal_zone,
    )
    leap = ((m("year") % 4 == 0) & (m("year") % 100 != 0)) | (m("year") % 400 == 0)
    length = F.when(m("month") == 2, F.when(leap, 29).otherwise(28)).when(m("month").isin(4, 6, 9, 11), 30).when(m("month").between(1, 12), 31)
    week = F.regexp_extract(m("mo"), r"^W(\d{2})$", 1).try_cast("int")
    monday = F.date_trunc("week", F.make_date(m("year"), F.lit(1), F.lit(4))).cast("date")
    by_week = F.when(week.between(1, 53) & m("day").between(1, 7), F.date_add(monday, (week - 1) * 7 + m("day") - 1))
    nth = F.when(m("mo").rlike(r"^\d{3}$"), m("mo").try_cast("int"))
    by_nth = F.when(nth.between(1, F.when(leap, 366).otherwise(365)), F.date_add(F.make_date(m("year"), F.lit(1), F.lit(1)), nth - 1))
    by_day = F.make_date(m("year"), m("month"), F.when(m("day").between(1, length), m("day")))
    hour, half_ = m("hour"), m("half")
    fits = F.when(half_ == "", hour.between(0, 47)).when(half_.isin("am", "pm"), hour.between(1, 12)).otherwise(hour.between(0, 12))
    fits = fits & m("minute").between(0, 59) & m("second").between(0, 59)
    hour = F.when(half_.isin("am", "午前"), hour % 12).when(half_.isin("pm", "午後"), hour % 12 + 12).otherwise(hour)
    abbr = F.lit(None).cast("bigint")
    for name, minutes in ABBREVIATIONS.items():
        abbr = F.when(F.upper(m("own")) == name, F.lit(minutes * 60_000_000)).otherwise(abbr)
    d = stage(
        d,
        date=F.when(m("mo").startswith("W"), F.when(F.weekofyear(by_week) == week, by_week)).when(m("nod"), by_nth).otherwise(by_day), fits=fits,
        clock=(hour * 3600 + m("minute") * 60 + m("second")).cast("bigint") * 1_000_000 + m("frac"),
        offset=F.when(m("own") == "", _offset(m("cz"))).otherwise(F.coalesce(_offset(m("own")), abbr)),
        region=F.when(m("own") == "", m("cz")).otherwise(m("own")),
    )
    d = stage(d, local=F.when(m("fits"), F.unix_date(m("date")).cast("bigint") * 86_400_000_000 + m("clock")), zone=F.when(m("offset").isNull() & m("region").isin(_ZONES), m("region")))
    # a zone's own rules: gaps and overlaps take the offset before the change
    ntz = F.timestamp_add("MICROSECOND", m("local"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    civil = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.convert_timezone(m("zone"), F.lit("UTC"), ntz))
    # a generator, as filters on the moment would otherwise be pushed down with all stages copied into them again and again
    return d.select(*[F.col(f"`{x}`") for x in names if x != out], F.explode(F.array(F.coalesce(m("epoch"), m("local") - m("offset"), civil))).alias(out))


def moments(df: DataFrame, record_id: str, fields: list[str], calendar: str = "calendar") -> DataFrame:
    """(record_id string, field, text, utc_ms): the texts of several fields of one table as moments; utc_ms is null where a text names none.

    Repeated (record, field, text, calendar) rows count once. Digits finer than milliseconds are cut off.
    """
    long = df.select(
        F.col(record_id).cast("string").alias("record_id"), F.col(calendar).cast("string").alias("_cal"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("text")) for f in fields])).alias("_f"),
    ).select("record_id", "_cal", "_f.field", "_f.text").filter("text is not null and record_id is not null")
    read = with_utc_micros(long, "text", "_cal", "_us")
    return read.select("record_id", "field", "text", F.floor(F.col("_us") / 1000).cast("bigint").alias("utc_ms")).distinct()
