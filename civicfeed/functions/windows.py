"""Time windows in Russian notices (D10, D11): ordered patterns, the first that applies decides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months by their first letters, words of relative days, and words that notices of works have or lack.
MONTHS = {"янв": 1, "фев": 2, "мар": 3, "апр": 4, "мая": 5, "май": 5, "июн": 6, "июл": 7, "авг": 8, "сен": 9, "окт": 10, "ноя": 11, "дек": 12}
MONTH = r"январ[яь]?|феврал[яь]?|марта?|апрел[яь]?|ма[йя]|июн[яь]?|июл[яь]?|августа?|сентябр[яь]?|октябр[яь]?|ноябр[яь]?|декабр[яь]?"
DAYS = ["сегодня", "завтра", "послезавтра"]
WEEKDAY = r"понедельник|вторник|сред[уа]|четверг|пятниц[уа]|суббот[уа]|воскресенье"
EVENT_HINT = (
    r"(?iU)отключ|опрессов|перекрыт|авари|ремонт|водоснаб|гвс|хвс|отоплен|горяч\w*\s+вод|холодн\w*\s+вод|ограничен|работ\w+\s+на\s+|"
    r"трактор|чистк\w*\s+снег|лифт|электричеств|гроза|ветер|ливн|мероприят|перекроют|закроют\s+движен"
)
NON_EVENT = (
    r"(?iU)показан\w*\s+сч[её]т|квитанц|оплат|коммунальн\w*\s+услуг|госуслуги\s+дом|мошенничеств|клади\s+трубку|с\s+дн[её]м\s+рожден|"
    r"тариф\w*\s+на\s+коммуналь|кадастров|конкурс\s+|обучение\s+в\s+учебн|тор\s+«?моя\s+школа|электросамокат"
)
NOISE = ["показания", "квитанц", "оплат", "госуслуги дом", "поздравля", "с днём рождения", "с днем рождения", "мошенничеств", "клади трубку", "голосование за благоустройство", "передать показания"]
TIME_MARKERS = rf"(?iU)\d{{1,2}}[./]\d{{1,2}}|\d{{1,2}}[:.\-]\d{{2}}|завтра|сегодня|послезавтра|{MONTH}|\bс\s+\d|\bдо\s+\d|\bпо\s+\d"

#: Pieces of patterns. A date in digits has six groups (day, month, year, hour, minute, second), a named one three, a time two.
CLOCK = r"(\d{1,2})[:.\-](\d{2})"
DATE = r"(\d{1,2})[./](\d{1,2})(?:[./](\d{2,4}))?"
DMY = rf"{DATE}(?:\s+{CLOCK}(?::(\d{{2}}))?)?"
NAMED = rf"(\d{{1,2}})\s+({MONTH})(?:\s+(\d{{4}}))?"
DAY = rf"\b({'|'.join(DAYS)})\b"
#: A date without a year lies within so many seconds of the text, or else in another year.
NEAR = 400 * 3600


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


class Match:
    """The first match of a pattern in a text: its groups as numbers or words, null where it has none."""

    def __init__(self, text: Column, pattern: str, flags: str = "(?iU)") -> None:
        self.text, self.pattern = text, flags + pattern

    def found(self) -> Column:
        return self.text.rlike(self.pattern)

    def word(self, group: int) -> Column:
        return F.nullif(F.regexp_extract(self.text, self.pattern, group), F.lit(""))

    def number(self, group: int) -> Column:
        return self.word(group).cast("int")

    def month(self, group: int) -> Column:
        pairs = [x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))]
        return F.try_element_at(F.create_map(*pairs), F.left(F.lower(self.word(group)), F.lit(3)))


def _moment(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    return F.try_make_timestamp_ntz(year, month, day, hour, minute, second.cast("decimal(8,6)"))


def _clock(day: Column, hour: Column, minute: Column) -> Column:
    """A time on a day; null if there is no such time."""
    return _moment(F.year(day), F.month(day), F.day(day), hour, minute, F.lit(0))


def _in_year(t: Column, year: Column) -> Column:
    """The same moment of another year, unchanged where that year lacks the day."""
    return F.coalesce(_moment(year, F.month(t), F.day(t), F.hour(t), F.minute(t), F.second(t)), t)


def _dated(ref: Column, day: Column, month: Column, year: Column, hour: Column, minute: Column, second: Column) -> Column:
    """A moment; days that a month lacks are its 28th at most. Without a year that of ``ref`` counts.

    If that is NEAR or more after it, the year before is tried, and if the outcome is NEAR or more before it, the year after.
    """
    own = F.coalesce(year, F.year(ref))
    first = F.coalesce(_moment(own, month, day, hour, minute, second), _moment(own, month, F.least(day, F.lit(28)), hour, minute, second))
    gap = lambda t: F.timestamp_diff("SECOND", ref, t)
    back = let(first, lambda t: F.when(year.isNull() & (gap(t) > NEAR), _in_year(t, own - 1)).otherwise(t))
    return let(back, lambda t: F.when(year.isNull() & (gap(t) < -NEAR), _in_year(t, own + 1)).otherwise(t))


def _digits(m: Match, first: int, ref: Column, timed: bool = True) -> Column:
    """The date in digits whose groups begin with ``first``."""
    zero = F.lit(0)
    day, month, year = (m.number(first + i) for i in range(3))
    clock = [F.coalesce(m.number(first + i), zero) for i in (3, 4, 5)] if timed else [zero] * 3
    fits = day.between(1, 31) & month.between(1, 12) & (clock[0] <= 23) & (clock[1] <= 59)
    return F.when(fits, _dated(ref, day, month, F.when(year < 100, year + 2000).otherwise(year), *clock))


def _named(m: Match, first: int, ref: Column, hour: int = 0, minute: int = 0) -> Column:
    """The day and month whose groups begin with ``first``, at a time."""
    return _dated(ref, m.number(first), m.month(first + 1), m.number(first + 2), F.lit(hour), F.lit(minute), F.lit(0))


def _day_end(t: Column) -> Column:
    """A midnight as the last minute of its day."""
    return let(t, lambda x: F.when((F.hour(x) == 0) & (F.minute(x) == 0), _clock(x, F.lit(23), F.lit(59))).otherwise(x))


def _relative(m: Match, group: int, ref: Column) -> Column:
    after = F.array_position(F.array(*[F.lit(d) for d in DAYS]), F.lower(m.word(group))) - 1
    return F.date_add(F.to_date(ref), after.cast("int"))


def _hours(t: Column, n: int) -> Column:
    return t + F.expr(f"interval {n} hour")


def window(text: Column, ref: Column) -> Column:
    """(active_from, active_to, confidence, pattern) of the first pattern that gives a window, null if none does.

    ``ref`` is when the text was written. Texts on bills, tariffs and the like, without a word of works, have none.
    """
    dashes = F.regexp_replace(F.translate(text, "  –—−", "  ---"), r"[ \t]+", " ")
    return let(dashes, lambda raw: F.when(~(raw.rlike(NON_EVENT) & ~raw.rlike(EVENT_HINT)), _first(raw, ref)))


def _first(raw: Column, ref: Column) -> Column:
    none = F.lit(None).cast("timestamp_ntz")
    event = raw.rlike(EVENT_HINT)
    lacks = lambda pattern: ~raw.rlike("(?iU)" + pattern)

    def label(name: str, sure: float, start: Column, end: Column, ordered: bool = False, given: Column | None = None) -> Column:
        def judged(x: Column) -> Column:
            fits = (x["a"] <= x["b"]) if ordered else (x["a"].isNotNull() | x["b"].isNotNull())
            value = F.struct(x["a"].alias("active_from"), x["b"].alias("active_to"), F.lit(sure).alias("confidence"), F.lit(name).alias("pattern"))
            return F.when(fits, value)

        out = let(F.struct(start.alias("a"), end.alias("b")), judged)
        return out if given is None else F.when(given, out)

    def span(name: str, sure: float, start: Column, end: Column, given: Column | None = None) -> Column:
        """Both ends or nothing."""
        both = start.isNotNull() & end.isNotNull()
        return label(name, sure, start, end, given=both if given is None else both & given)

    m1 = Match(raw, rf"с\s+{DMY}.{{0,120}}?(?:по|до|планируемое\s+время\s+включения|время\s+включения|включения?)\s*{DMY}", "(?isU)")
    m2 = Match(raw, rf"с\s+{NAMED}.{{0,60}}?(?:по|до)\s+{NAMED}", "(?isU)")
    m3 = Match(raw, rf"(\d{{1,2}})\s*-\s*(\d{{1,2}})\s+({MONTH})(?:\s+(\d{{4}}))?")
    m4 = Match(raw, rf"{DATE}\s*-\s*{DATE}")
    m5 = Match(raw, rf"{DAY}.{{0,40}}?(?:с\s+)?{CLOCK}\s*(?:до|-)\s*{CLOCK}")
    m6a = Match(raw, rf"{DAY}\s+(\d{{1,2}})/(\d{{1,2}})\b")
    m6b = Match(raw, rf"{DAY}(?:\s+\d{{1,2}}/\d{{1,2}})?\s+(?:в\s+|с\s+)?{CLOCK}\b")
    m6c = Match(raw, rf"{DAY}.{{0,30}}?с\s+(\d{{1,2}})\s*часов?")
    m6d = Match(raw, rf"(?:в\s+)?(?:{WEEKDAY}),?\s+(\d{{1,2}})\s+({MONTH})")
    m7 = Match(raw, r"до\s+завтра(?:\s+до\s+(\d{1,2})(?:[:.\-]?(\d{2})|часов?)?)?")
    m8 = Match(raw, rf"(?:до|по)\s+({DMY})")
    m8b = Match(raw, rf"(?:до|по)\s+{NAMED}")
    m9 = Match(raw, rf"\bс\s+{DMY}(?!\s*-\s*\d)")
    m10 = Match(raw, rf"\bс\s+{NAMED}(?!\s*(?:по|до)\s+\d)")
    m11 = Match(raw, rf"(?:^|[^\d])с\s+{CLOCK}\s*(?:до|-)\s*{CLOCK}")
    m12 = Match(raw, rf"дн[её]м\s+(\d{{1,2}})(?:,\s*ночью\s+и\s+дн[её]м\s+(\d{{1,2}}))?\s+({MONTH})")

    zero, n = F.lit(0), F.lit(None).cast("int")
    dash_day = lambda g, h, x: _dated(ref, m3.number(g), m3.month(3), m3.number(4), F.lit(h), F.lit(x), zero)
    d5 = _relative(m5, 1, ref)
    start5, end5 = _clock(d5, m5.number(2), m5.number(3)), _clock(d5, m5.number(4), m5.number(5))
    d6a = _relative(m6a, 1, ref)
    d6a = F.coalesce(F.to_date(_moment(F.year(d6a), m6a.number(3), m6a.number(2), zero, zero, zero)), d6a)
    start6b = _clock(_relative(m6b, 1, ref), m6b.number(2), m6b.number(3))
    after6b = F.substr(raw, F.regexp_instr(raw, F.lit(m6b.pattern)), F.lit(80))
    start6c = _clock(_relative(m6c, 1, ref), m6c.number(2), zero)
    weekday = lambda h: _dated(ref, m6d.number(1), m6d.month(2), n, zero, zero, zero) + F.expr(f"interval {h} hour")
    tomorrow = F.date_add(F.to_date(ref), 1)
    end7 = F.when(m7.number(1).isNotNull(), _clock(tomorrow, F.least(m7.number(1), F.lit(23)), F.coalesce(m7.number(2), zero))).otherwise(_clock(tomorrow, F.lit(23), F.lit(59)))
    end8 = _digits(m8, 2, ref)
    end8 = F.when(m8.word(1).rlike(r"\d{1,2}[:.\-]\d{2}"), end8).otherwise(_clock(end8, F.lit(23), F.lit(59)))
    start11, end11 = _clock(ref, m11.number(1), m11.number(2)), _clock(ref, m11.number(3), m11.number(4))
    end11 = F.when(end11 <= start11, _hours(end11, 24)).otherwise(end11)
    late = ref > _hours(end11, 1)
    start12 = _dated(ref, m12.number(1), m12.month(3), n, zero, zero, zero)
    end12 = _dated(ref, F.coalesce(m12.number(2), m12.number(1)), m12.month(3), n, F.lit(23), F.lit(59), zero)
    return F.coalesce(
        label("dmy_range_s_po", 0.95, _digits(m1, 1, ref), _digits(m1, 7, ref), ordered=True),
        label("day_month_range", 0.93, _named(m2, 1, ref), _day_end(_named(m2, 4, ref)), ordered=True),
        label("day_dash_day_month", 0.92, dash_day(1, 0, 0), dash_day(2, 23, 59), ordered=True),
        label("dmy_dash_dmy", 0.90, _digits(m4, 1, ref, False), _day_end(_digits(m4, 4, ref, False)), ordered=True),
        span("rel_day_time_range", 0.94, start5, F.when(end5 < start5, _hours(end5, 24)).otherwise(end5)),
        span("rel_day_slash_date", 0.84, _clock(d6a, F.lit(8), zero), _clock(d6a, F.lit(14), zero)),
        span("rel_day_time_start", 0.85, start6b, _hours(start6b, 4), ~after6b.rlike(r"(?iU)\bдо\s+\d{1,2}[:.\-]\d{2}")),
        span("rel_day_from_hour", 0.83, start6c, _hours(start6c, 7)),
        span("weekday_day_month", 0.87, weekday(8), weekday(20)),
        label("until_tomorrow", 0.88, none, end7, given=m7.found()),
        label("until_dmy", 0.86, none, end8, given=event & lacks(r"\bс\s+\d{1,2}[./]\d{1,2}")),
        label("until_day_month", 0.86, none, _named(m8b, 1, ref, 23, 59), given=event & lacks(rf"\bс\s+\d{{1,2}}\s+(?:{MONTH})")),
        label("from_dmy_only", 0.80, _digits(m9, 1, ref), none, given=event & lacks(r"(?:по|до|включения?)\s+\d{1,2}[./]\d{1,2}")),
        label("from_day_month_only", 0.80, _named(m10, 1, ref), none, given=event & lacks(rf"(?:по|до)\s+\d{{1,2}}\s+(?:{MONTH})")),
        span(
            "same_day_time_range", 0.75, F.when(late, _hours(start11, 24)).otherwise(start11), F.when(late, _hours(end11, 24)).otherwise(end11),
            lacks(rf"\b(сегодня|завтра|послезавтра|\d{{1,2}}[./]\d{{1,2}}|\d{{1,2}}\s+(?:{MONTH}))"),
        ),
        span("weather_day_span", 0.82, start12, end12),
    )


def without_window(text: Column) -> Column:
    """Whether a text has no window and nothing that looks like a time, or is about something else."""
    low = F.lower(F.coalesce(text, F.lit("")))
    ref = F.lit("2026-06-01 12:00:00").cast("timestamp_ntz")
    return window(F.coalesce(text, F.lit("")), ref).isNull() & (low.rlike("|".join(NOISE)) | ~low.rlike(TIME_MARKERS))
