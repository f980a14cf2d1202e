"""Time expressions in English, Japanese and ISO notation to four-point ranges.

A text is normalised and tried against kinds of expressions in a fixed order: words for no time, bounds between
events, intervals, approximations, recurrences, decades and centuries, offsets, and dates. A date is a partial record
of fields; completing it against the reference gives a half-open span, and the span a range that lies within it.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000, "month": 2_629_746_000, "year": 31_556_952_000}
NEG, POS = -(2**63), 2**63 - 1
# Fixed values.
ERAS = {"令和": 2018, "平成": 1988, "昭和": 1925, "大正": 1911, "明治": 1867}
MONTHS = {m: i + 1 for i, names in enumerate("jan january|feb february|mar march|apr april|may|jun june|jul july|aug august|sep sept september|oct october|nov november|dec december".split("|")) for m in names.split()}
DAYS = {d: i for i, names in enumerate("mon monday 月|tue tuesday tues 火|wed wednesday 水|thu thursday thurs 木|fri friday 金|sat saturday 土|sun sunday 日".split("|")) for d in names.split()}
PARTS = {"未明": (0, 5), "早朝": (5, 8), "朝": (5, 10), "午前": (0, 12), "正午": (11, 14), "昼": (11, 14), "午後": (12, 24), "夕方": (16, 19), "夕": (16, 19), "深夜": (22, 27), "夜": (18, 24), "morning": (5, 10), "noon": (11, 14), "afternoon": (12, 24), "evening": (16, 19), "late night": (22, 27), "night": (18, 24), "predawn": (0, 5)}
UNITS = {"秒": "second", "分": "minute", "時間": "hour", "日": "day", "週間": "week", "週": "week", "か月": "month", "ヶ月": "month", "カ月": "month", "ヵ月": "month", "月": "month", "年": "year"}
UNKNOWN = {"", "unknown", "n.d.", "n/a", "tbd", "-", "?", "不明", "未詳", "年代不詳", "いつか", "undated", "soon"}
_KANJI = {c: i for i, c in enumerate("〇一二三四五六七八九")}
_SCALE = {"十": 10, "百": 100, "千": 1000}
_MON = "|".join(sorted(MONTHS, key=len, reverse=True))
_DOW = "monday|tuesday|wednesday|thursday|friday|saturday|sunday|mon|tues|tue|wed|thurs|thu|fri|sat|sun"


def days_from_civil(y: int, m: int, d: int) -> int:
    """Days since 1970-01-01 in the proleptic Gregorian calendar; months beyond 1..12 carry over."""
    y, m = y + (m - 1) // 12, (m - 1) % 12 + 1
    before = y - 1
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    year_days = before * 365 + before // 4 - before // 100 + before // 400
    return year_days + sum((31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[: m - 1]) + d - 719163


def civil(day: int) -> tuple[int, int, int]:
    y = day * 400 // 146097 + 1970
    while days_from_civil(y, 1, 1) > day:
        y -= 1
    while days_from_civil(y + 1, 1, 1) <= day:
        y += 1
    m = next(k for k in range(12, 0, -1) if days_from_civil(y, k, 1) <= day)
    return y, m, day - days_from_civil(y, m, 1) + 1


def month_length(y: int, m: int) -> int:
    return days_from_civil(y, m + 1, 1) - days_from_civil(y, m, 1)


@dataclass(frozen=True)
class Date:
    year: int | None = None
    month: int | None = None
    day: int | None = None
    third: int | None = None  # of a month
    hours: tuple[float, float] | None = None  # part of day or clock with its precision, in hours
    offset_min: int | None = None


@dataclass(frozen=True)
class Range:
    es: int = NEG
    ls: int = POS
    ee: int = NEG
    le: int = POS

    @staticmethod
    def within(a: int, b: int) -> Range:
        return Range(a, b, a, b)


@dataclass(frozen=True)
class Parsed:
    """kind with the range where it could be resolved, else the reason; anchors are names of events it hangs on."""

    kind: str
    range: Range | None = None
    reason: str | None = None
    anchors: tuple[str, ...] = ()
    rule: str | None = None
    needs_reference: bool = False
    extra: dict = field(default_factory=dict)


def number(text: str) -> tuple[int, int] | None:
    """(least, most) of a number in digits, kanji up to thousands, or a vague word."""
    t = text.strip()
    vague = {"数": (2, 5), "several": (3, 7), "a few": (2, 4), "few": (2, 4), "a": (1, 1), "an": (1, 1), "one": (1, 1), "two": (2, 2), "three": (3, 3), "four": (4, 4), "five": (5, 5), "six": (6, 6), "seven": (7, 7), "eight": (8, 8), "nine": (9, 9), "ten": (10, 10)}
    if t in vague:
        return vague[t]
    if t.isdigit():
        return int(t), int(t)
    total, digit = 0, 0
    for c in t:
        if c in _KANJI:
            digit = digit * 10 + _KANJI[c]
        elif c in _SCALE:
            total, digit = total + (digit or 1) * _SCALE[c], 0
        else:
            return None
    return (total + digit, total + digit) if t else None


class Parser:
    def __init__(self, reference_ms: int | None = None, offset_min: int = 0) -> None:
        self.ref, self.offset, self.used = reference_ms, offset_min, False

    # -- reference

    def today(self) -> int | None:
        self.used = True
        return None if self.ref is None else (self.ref + self.offset * 60_000) // MS["day"]

    def span(self, d: Date) -> tuple[int, int] | str:
        """Half-open milliseconds of a partial date, or why it has none."""
        y, m, day = d.year, d.month, d.day
        if y is None and (m is not None or day is not None):
            t = self.today()
            if t is None:
                return "needs_reference"
            ty, tm, _ = civil(t)
            if m is not None:  # the year that brings it nearest to the reference
                y = min((ty - 1, ty, ty + 1), key=lambda c: abs(days_from_civil(c, m, day or 15) - t))
            else:
                best = min((tm - 1, tm, tm + 1), key=lambda c: abs(days_from_civil(ty, c, day) - t))
                y, m = ty + (best - 1) // 12, (best - 1) % 12 + 1
        if y is None:
            if d.hours is None:
                return "unparsed"
            t = self.today()
            if t is None:
                return "needs_reference"
            y, m, day = civil(t)
        if m is not None and not 1 <= m <= 12 or day is not None and not 1 <= day <= month_length(y, m or 1):
            return "invalid"
        if m is None:
            a, b = days_from_civil(y, 1, 1), days_from_civil(y + 1, 1, 1)
        elif d.third is not None:
            a = days_from_civil(y, m, 1 + 10 * d.third)
            b = days_from_civil(y, m, 11 + 10 * d.third) if d.third < 2 else days_from_civil(y, m + 1, 1)
        elif day is None:
            a, b = days_from_civil(y, m, 1), days_from_civil(y, m + 1, 1)
        else:
            a = days_from_civil(y, m, day)
            b = a + 1
        shift = (d.offset_min if d.offset_min is not None else self.offset) * 60_000
        if d.hours is not None and day is not None:
            return a * MS["day"] + round(d.hours[0] * MS["hour"]) - shift, a * MS["day"] + round(d.hours[1] * MS["hour"]) - shift
        return a * MS["day"] - shift, b * MS["day"] - shift

    # -- dates

    def clock(self, s: str) -> tuple[str, tuple[float, float] | None, int | None]:
        """The text without its clock or part of day, the hours, and the zone of its own."""
        zone = None
        if m := re.search(r"\s*(?:(utc|gmt|z)|(jst)|([+-])(\d{2}):?(\d{2}))$", s):
            before = s[: m.start()]
            if re.search(r"\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?$|\d{1,2}時(?:\d{1,2}分)?$", before):
                zone = 0 if m[1] else 540 if m[2] else (1 if m[3] == "+" else -1) * (int(m[4]) * 60 + int(m[5]))
                s = before
        half = re.search(r"(午前|午後|夜|朝)?\s*(\d{1,2})時(?:(\d{1,2})分(?:(\d{1,2})秒)?|(半))?$", s)
        if half:
            h = int(half[2]) + (12 if half[1] in ("午後", "夜") and int(half[2]) < 12 else 0)
            mi = 30 if half[5] else int(half[3] or 0)
            step = 1 / 3600 if half[4] else 1 / 60 if half[3] or half[5] else 1
            at = h + mi / 60 + int(half[4] or 0) / 3600
            return s[: half.start()].rstrip(" のt"), (at, at + step), zone
        m = re.search(r"(?:^|[\st日])(?:at )?(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?\s*(am|pm|a\.m\.|p\.m\.)?$", s) or re.search(r"(?:^|\s)(?:at )?(\d{1,2})()()()\s*(am|pm|a\.m\.|p\.m\.)$", s)
        if m and int(m[1]) < 48:
            h = int(m[1])
            if m[5]:
                h = h % 12 + (12 if m[5][0] == "p" else 0)
            at = h + int(m[2] or 0) / 60 + int(m[3] or 0) / 3600 + (float("0." + m[4]) / 3600 if m[4] else 0)
            step = 1 / 3_600_000 if m[4] else 1 / 3600 if m[3] else 1 / 60 if m[2] else 1
            return s[: m.start() + (s[m.start()] == "日")].rstrip(" t,"), (at, at + step), zone
        for name in sorted(PARTS, key=len, reverse=True):
            if s.endswith(name):
                rest = re.sub(r"(?:の|\s+in the|\s+at|\s+in|,)?\s*$", "", s[: -len(name)])
                return rest, PARTS[name], zone
        return s, None, zone

    def date(self, s: str) -> Date | None:
        s, hours, zone = self.clock(s)
        s = re.sub(rf"^(?:{_DOW})\.?,?\s+|\s*[(（][月火水木金土日](?:曜日?)?[)）]$|^(?:on|in|at)\s+", "", s.strip())
        d = self._day(s) if s else Date()
        return replace(d, hours=hours, offset_min=zone) if d is not None and (s or hours) else None

    def _day(self, s: str) -> Date | None:
        full = lambda p: re.fullmatch(p, s)
        if m := full(r"([+-]?\d{4,6})(?:-(\d{1,2})(?:-(\d{1,2}))?)?|(\d{4})/(\d{1,2})(?:/(\d{1,2}))?|(\d{4})\.(\d{1,2})\.(\d{1,2})"):
            y, mo, d = (m[1], m[2], m[3]) if m[1] else (m[4], m[5], m[6]) if m[4] else (m[7], m[8], m[9])
            return Date(int(y), int(mo) if mo else None, int(d) if d else None)
        if m := full(r"(?:(紀元前|前)|(西暦|紀元))?(令和|平成|昭和|大正|明治)?(元|[\d〇一二三四五六七八九十百千]+)年(?:の?(\d{1,2}|[一二三四五六七八九十]+)月(?:(上旬|中旬|下旬)|(\d{1,2}|[一二三四五六七八九十]+)日)?)?"):
            n = 1 if m[4] == "元" else (number(m[4]) or (None,))[0]
            if n is None:
                return None
            y = 1 - n if m[1] else n + ERAS.get(m[3], 0)
            mo, d = (number(x)[0] if x else None for x in (m[5], m[7]))
            return Date(y, mo, d, ("上旬", "中旬", "下旬").index(m[6]) if m[6] else None)
        if m := full(r"(\d{1,2}|[一二三四五六七八九十]+)月(?:(上旬|中旬|下旬)|(\d{1,2}|[一二三四五六七八九十]+)日)?"):
            return Date(None, number(m[1])[0], number(m[3])[0] if m[3] else None, ("上旬", "中旬", "下旬").index(m[2]) if m[2] else None)
        if m := full(r"(\d{1,2})日"):
            return Date(None, None, int(m[1]))
        if m := full(rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?({_MON})\.?(?:,?\s+(\d{{3,4}}))?|({_MON})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(\d{{3,4}}))?"):
            d, mo, y = (m[1], m[2], m[3]) if m[1] else (m[5], m[4], m[6])
            return Date(int(y) if y else None, MONTHS[mo], int(d))
        if m := full(rf"(?:(early|mid|late)[\s-]+)?({_MON})\.?,?(?:\s+(\d{{3,4}}))?"):
            return Date(int(m[3]) if m[3] else None, MONTHS[m[2]], None, ("early", "mid", "late").index(m[1]) if m[1] else None)
        if m := full(r"(?:ad\s*)?(\d{1,4})(?:\s*(bc|bce|b\.c\.|ad|ce))?"):
            if m[2] or len(m[1]) >= 3 or s.startswith("ad"):
                return Date(1 - int(m[1]) if m[2] and m[2].startswith("b") else int(m[1]))
        if m := full(r"(\d{1,2})/(\d{1,2})"):
            return Date(None, int(m[1]), int(m[2]))
        return None

    # -- expressions

    def parse(self, text: str | None) -> Parsed:
        if text is None:
            return Parsed("unknown", reason="unknown")
        s = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).strip().lower()).rstrip("。")
        if s in UNKNOWN:
            return Parsed("unknown", reason="unknown")
        if len(s) > 300:
            return Parsed("unparsed", reason="unparsed")
        got = self._interval(s) or self._between(s) or self._simple(s)
        if got is None:
            return Parsed("unparsed", reason="unparsed")
        return replace(got, needs_reference=self.used)

    def _between(self, s: str) -> Parsed | None:
        m = re.fullmatch(r"(?:(?P<a>.+?)(?:より後|の後|より後ろ))、?(?:(?P<b>.+?)(?:より前|の前))?|(?P<b2>.+?)より前|after (?P<a3>.+?)(?: and| but|,)? before (?P<b3>.+)|after (?P<a4>.+)|before (?P<b4>.+)|(?P<a5>.+?)以降|since (?P<a6>.+)|(?P<b5>.+?)以前|until (?P<b6>.+)|(?P<b7>.+?)まで|(?P<a7>.+?)から", s)
        if not m:
            return None
        g = m.groupdict()
        after, before = next((g[k] for k in ("a", "a3", "a4", "a5", "a6", "a7") if g.get(k)), None), next((g[k] for k in ("b", "b2", "b3", "b4", "b5", "b6", "b7") if g.get(k)), None)
        inclusive = bool(g.get("a5") or g.get("a6") or g.get("a7")), bool(g.get("b5") or g.get("b6") or g.get("b7"))
        lo, hi, anchors = NEG, POS, []
        for side, name in (("a", after), ("b", before)):
            if name is None:
                continue
            sub = self._simple(name)
            if sub is None or sub.range is None:
                if sub is not None and sub.reason == "needs_reference":
                    return Parsed("between", reason="needs_reference")
                anchors.append(name)
            elif side == "a":
                lo = sub.range.es if inclusive[0] else sub.range.le
            else:
                hi = sub.range.le if inclusive[1] else sub.range.es
        if anchors:
            return Parsed("between", reason="anchor", anchors=tuple(anchors))
        return Parsed("between", Range.within(lo, hi)) if lo < hi else Parsed("between", reason="invalid")

    def _interval(self, s: str) -> Parsed | None:
        for pattern in (r"^(.+?)から(.+?)まで(?:の間)?$", r"^from (.+?) (?:to|until) (.+)$", r"^between (.+?) and (.+)$", r"^(.+?)\s*[〜～~–—]\s*(.+)$", r"^(\S*\d{4}\S*)/(\S*\d{4}\S*)$", r"^(.+?) (?:-|to|until) (.+)$", r"^(\d{4})-(\d{4})$"):
            m = re.match(pattern, s)
            if not m:
                continue
            a = self._simple(m[1].strip())
            if a is None or a.range is None:
                continue
            b = self._simple(m[2].strip())
            head = re.match(r"(.*?\d+年)(?:.*月)?|(\d{4})-", m[1])
            if (b is None or b.range is None or b.range.le <= a.range.es) and head:  # the end takes over what the start says
                for prefix in (re.match(r".*月", m[1]), re.match(r".*年", m[1])):
                    if prefix and (c := self._simple(prefix[0] + m[2].strip())) and c.range is not None:
                        b = c
                        break
            if b is not None and b.range is not None and b.range.le > a.range.es:
                return Parsed("interval", Range(a.range.es, a.range.le, b.range.es, b.range.le))
        return None

    def _simple(self, s: str) -> Parsed | None:
        m = re.fullmatch(r"(?:(?:約|およそ|about |around |approximately |approx\.? |circa |ca?\. ?)(?P<x>.+))|(?P<y>.+?)\s*(?:ごろ|頃|前後|くらい|ぐらい|あたり)", s)
        if m and (inner := self._simple((m["x"] or m["y"]).strip())) and inner.range is not None:
            r = inner.range
            fuzz = r.le - r.es if r.le - r.es > MS["hour"] else 30 * MS["minute"]
            return Parsed("approx", Range.within(r.es - fuzz, r.le + fuzz))
        return self._recurring(s) or self._long(s) or self._relative(s) or self._dated(s) or self._anchored(s)

    def _dated(self, s: str) -> Parsed | None:
        d = self.date(s)
        if d is None:
            return None
        got = self.span(d)
        return Parsed("date", reason=got) if isinstance(got, str) else Parsed("date", Range.within(*got))

    def _recurring(self, s: str) -> Parsed | None:
        m = re.fullmatch(rf"(?:every |each )({_DOW})s?(.*)|毎週([月火水木金土日])曜日?(?:の)?(.*)", s)
        if m:
            day = DAYS[m[1] or m[3]]
            _, hours, _ = self.clock((m[2] or m[4] or "").strip())
            return Parsed("recurring", rule="weekly", reason="recurring", extra={"weekday": day, "hours": hours})
        m = re.fullmatch(r"(?:every ?day|daily|毎日)(.*)", s)
        if m:
            return Parsed("recurring", rule="daily", reason="recurring", extra={"hours": self.clock(m[1].strip())[1]})
        m = re.fullmatch(r"(?:every month on the |毎月)(\d{1,2})(?:st|nd|rd|th|日)", s)
        if m:
            return Parsed("recurring", rule="monthly", reason="recurring", extra={"day": int(m[1])})
        m = re.fullmatch(rf"(?:every year on |annually on |毎年)(?:(\d{{1,2}})月(\d{{1,2}})日|(\d{{1,2}}) ({_MON})|({_MON}) (\d{{1,2}}))", s)
        if m:
            month, day = (int(m[1]), int(m[2])) if m[1] else (MONTHS[m[4]], int(m[3])) if m[3] else (MONTHS[m[5]], int(m[6]))
            return Parsed("recurring", rule="yearly", reason="recurring", extra={"month": month, "day": day})
        return None

    def _long(self, s: str) -> Parsed | None:
        if m := re.fullmatch(r"(early |mid[- ]|late )?(?:the )?(\d{3,4})s|(\d{3,4})年代(前半|半ば|後半)?", s):
            y = int(m[2] or m[3])
            wide = 100 if y % 100 == 0 and m[2] and y < 1900 else 10
            part = {"early ": 0, "前半": 0, "mid-": 1, "mid ": 1, "半ば": 1, "late ": 2, "後半": 2}.get(m[1] or m[4] or "")
            return self._years(y, y + wide, part)
        if m := re.fullmatch(r"(紀元前)?(\d{1,2})世紀(初頭|前半|半ば|後半|末)?|(early |mid[- ]|late )?(?:the )?(\d{1,2})(?:st|nd|rd|th) century( bc)?", s):
            n = int(m[2] or m[5])
            bc = bool(m[1] or m[6])
            a = (1 - n * 100) if bc else (n - 1) * 100 + 1
            part = {"early ": 0, "前半": 0, "初頭": 0, "mid-": 1, "mid ": 1, "半ば": 1, "late ": 2, "後半": 2, "末": 2}.get(m[3] or m[4] or "")
            return self._years(a, a + 100, part)
        return None

    def _years(self, a: int, b: int, part: int | None) -> Parsed:
        lo, hi = days_from_civil(a, 1, 1) * MS["day"], days_from_civil(b, 1, 1) * MS["day"]
        if part is not None:
            third = (hi - lo) // 3
            lo, hi = lo + part * third, hi if part == 2 else lo + (part + 1) * third
        return Parsed("period", Range.within(lo - self.offset * 60_000, hi - self.offset * 60_000))

    def _relative(self, s: str) -> Parsed | None:
        bare, hours, zone = self.clock(s)
        shift = (zone if zone is not None else self.offset) * 60_000

        def days(a: int, b: int) -> Parsed:
            lo, hi = a * MS["day"] - shift, b * MS["day"] - shift
            if hours is not None and b == a + 1:
                lo, hi = lo + round(hours[0] * MS["hour"]), lo + round(hours[1] * MS["hour"])
            return Parsed("relative", Range.within(lo, hi))

        bare = bare.rstrip("の") or s
        named = {"today": 0, "今日": 0, "本日": 0, "yesterday": -1, "昨日": -1, "tomorrow": 1, "明日": 1, "一昨日": -2, "おととい": -2, "明後日": 2, "あさって": 2, "the day before yesterday": -2, "the day after tomorrow": 2}
        when = {"last ": -1, "先": -1, "this ": 0, "今": 0, "next ": 1, "来": 1, "先々": -2, "再来": 2}
        m_day = re.fullmatch(rf"(?:(last|this|next) )?({_DOW})|(先々|先|今|来|再来)?週?の?([月火水木金土日])曜日?", bare)
        m_unit = re.fullmatch(r"(last |this |next )(week|month|year)|(先々|先|今|来|再来)(週|月|年)|(昨年|去年|一昨年)", bare)
        m_off = re.fullmatch(r"(?:in )?(several|a few|an?|one|two|three|four|five|six|seven|eight|nine|ten|\d+) (second|minute|hour|day|week|month|year)s?(?: (ago|later|from now|before|after))?|([\d一二三四五六七八九十百千数]+)(秒|分|時間|日|週間|か月|ヶ月|カ月|ヵ月|年)(前|後)", s)
        if not (bare in named or m_day or m_unit or m_off):
            return None
        t = self.today()
        if t is None:
            return Parsed("relative", reason="needs_reference")
        if bare in named:
            return days(t + named[bare], t + named[bare] + 1)
        if m_day:
            day, word = DAYS[m_day[2] or m_day[4]], m_day[1] or m_day[3]
            if word is None:  # the last one on or before the reference
                at = t - (t + 3 - day) % 7
            else:
                at = t - (t + 3) % 7 + 7 * (when.get(word + " ", when.get(word, 0))) + day
            return days(at, at + 1)
        if m_unit:
            k, unit = (when[m_unit[1]], m_unit[2]) if m_unit[1] else (when[m_unit[3]], {"週": "week", "月": "month", "年": "year"}[m_unit[4]]) if m_unit[3] else ({"昨年": -1, "去年": -1, "一昨年": -2}[m_unit[5]], "year")
            y, mo, _ = civil(t)
            if unit == "week":
                a = t - (t + 3) % 7 + 7 * k
                return days(a, a + 7)
            return days(days_from_civil(y, mo + k, 1), days_from_civil(y, mo + k + 1, 1)) if unit == "month" else days(days_from_civil(y + k, 1, 1), days_from_civil(y + k + 1, 1, 1))
        n, unit = number(m_off[1] or m_off[4]), m_off[2] or UNITS[m_off[5]]
        word = m_off[3] or m_off[6]
        if n is None or word is None and not s.startswith("in "):
            return None
        lo, hi = sorted((-x if word in ("ago", "before", "前") else x) for x in n)
        y, mo, d = civil(t)
        if unit == "day":
            return days(t + lo, t + hi + 1)
        if unit == "week":
            return days(t + 7 * lo, t + 7 * hi + 1)
        if unit == "month":
            return days(days_from_civil(y, mo + lo, 1), days_from_civil(y, mo + hi + 1, 1))
        if unit == "year":
            return days(days_from_civil(y + lo, 1, 1), days_from_civil(y + hi + 1, 1, 1))
        return Parsed("relative", Range.within(self.ref + lo * MS[unit], self.ref + (hi + 1) * MS[unit] if lo != hi else self.ref + lo * MS[unit] + MS["minute"]))

    def _anchored(self, s: str) -> Parsed | None:
        m = re.fullmatch(r"(.+?)の([\d一二三四五六七八九十数]+)(秒|分|時間|日|週間|か月|ヶ月|年)(前|後)|([\w ]+?) (second|minute|hour|day|week|month|year)s? (before|after) (.+)", s)
        if not m:
            return None
        n = number(m[2] or m[5])
        if n is None:
            return None
        unit, back = (UNITS[m[3]], m[4] == "前") if m[1] else (m[6], m[7] == "before")
        lo, hi = sorted((-x if back else x) * MS[unit] for x in n)
        return Parsed("event_relative", reason="anchor", anchors=(m[1] or m[8],), extra={"least_ms": lo, "most_ms": hi})


def parse(text: str | None, reference_ms: int | None = None, offset_min: int = 0) -> Parsed:
    return Parser(reference_ms, offset_min).parse(text)


SCHEMA = "kind string, es bigint, ls bigint, ee bigint, le bigint, reason string, anchors array<string>, rule string, needs_reference boolean"


def resolve_temporal(text: Column, reference_ms: Column, offset_min: Column) -> Column:
    """Struct of SCHEMA for each text; parse distinct texts and join back where texts repeat."""

    @F.pandas_udf(SCHEMA)
    def run(t: pd.Series, ref: pd.Series, off: pd.Series) -> pd.DataFrame:
        rows = []
        for x, r, o in zip(t, ref, off, strict=True):
            p = parse(x, None if pd.isna(r) else int(r), 0 if pd.isna(o) else int(o))
            g = p.range
            rows.append((p.kind, *((g.es, g.ls, g.ee, g.le) if g else (None,) * 4), p.reason, list(p.anchors), p.rule, p.needs_reference))
        out = pd.DataFrame(rows, columns=["kind", "es", "ls", "ee", "le", "reason", "anchors", "rule", "needs_reference"])
        return out.astype({c: "Int64" for c in ("es", "ls", "ee", "le")})

    return run(text, reference_ms, offset_min)
