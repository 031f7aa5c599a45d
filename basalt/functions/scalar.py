"""Scalar functions whose semantics differ from the built-in of the same name, or that have none."""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import ROUND_HALF_EVEN, Context, Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

_SPECIAL = set(".^$|()[]{}*+?\\")


def similar_pattern(pattern: str, escape: str | None = None) -> str:
    """A SIMILAR TO pattern as a regular expression for a whole match."""
    out, i, in_class = [], 0, False
    classes = {"ALPHA": "a-zA-Z", "UPPER": "A-Z", "LOWER": "a-z", "DIGIT": "0-9", "ALNUM": "a-zA-Z0-9", "SPACE": " ", "WHITESPACE": "\\s"}
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape:
            i += 1
            out.append(re.escape(pattern[i]))
        elif in_class:
            m = re.compile(r"\[:(\w+):\]").match(pattern, i)
            if m:
                out.append(classes[m[1].upper()])
                i = m.end() - 1
            else:
                in_class = c != "]"
                out.append("\\" + c if c in "[\\&" else c)
        elif c == "[":
            in_class = True
            out.append(c)
        elif c in "%_":
            out.append("[\\s\\S]*" if c == "%" else "[\\s\\S]")
        elif c in "|*+?(){}":
            out.append("(?:" if c == "(" else c)
        else:
            out.append("\\" + c if c in _SPECIAL else c)
        i += 1
    return "".join(out)


def similar_to(text: Column, pattern: str, escape: str | None = None) -> Column:
    return text.rlike(rf"\A(?:{similar_pattern(pattern, escape)})\z")


def substring_similar(text: Column, pattern: str, escape: str) -> Column:
    """SUBSTRING(text SIMILAR a#"b#"c ESCAPE #): what the middle part matches."""
    first, middle, last = pattern.split(escape + '"')
    regex = rf"\A({similar_pattern(first, escape)})({similar_pattern(middle, escape)})({similar_pattern(last, escape)})\z".replace("[\\s\\S]*)", "[\\s\\S]*?)", 1)
    return F.when(text.rlike(regex), F.regexp_extract(text, regex, 2))


def containing(text: Column, part: Column, any_case: bool = True) -> Column:
    return F.lower(text).contains(F.lower(part)) if any_case else text.contains(part)


def trim_text(text: Column, part: str = " ", side: str = "both") -> Column:
    """TRIM removes whole repeats of a text, not a set of characters."""
    q = re.escape(part)
    if side in ("both", "leading"):
        text = F.regexp_replace(text, rf"\A(?:{q})+", "")
    return F.regexp_replace(text, rf"(?:{q})+\z", "") if side in ("both", "trailing") else text


def trim_set(text: Column, chars: str = " ", side: str = "both") -> Column:
    """BTRIM, LTRIM, RTRIM: characters of a set."""
    q = "[" + "".join(re.escape(c) if c not in "^]" else "\\" + c for c in chars) + "]+"
    if side in ("both", "leading"):
        text = F.regexp_replace(text, r"\A" + q, "")
    return F.regexp_replace(text, q + r"\z", "") if side in ("both", "trailing") else text


def decode(value: Column, *pairs, default=None) -> Column:
    """DECODE compares as = does: null matches nothing."""
    out = F.lit(default)
    for search, result in reversed(list(zip(pairs[::2], pairs[1::2], strict=True))):
        out = F.when(value == F.lit(search), F.lit(result)).otherwise(out)
    return out


def iif(condition: Column, then: Column, otherwise: Column) -> Column:
    """IIF: an unknown condition takes the second value."""
    return F.when(condition, then).otherwise(otherwise)


def max_value(*cols: Column) -> Column:
    """Null if any argument is; greatest() skips nulls."""
    return F.when(_any_null(cols), None).otherwise(F.greatest(*cols))


def min_value(*cols: Column) -> Column:
    return F.when(_any_null(cols), None).otherwise(F.least(*cols))


def _any_null(cols) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | c.isNull()
    return out


def trunc_number(x: Column, scale: int = 0, kind: str = "double") -> Column:
    """Towards zero at a decimal place, in the type ``kind`` of x.

    A double is cut as the decimal number that it is written as; from 1e18 on it
    has no fraction, and is cut by a remainder.
    """
    d = x if kind.startswith("decimal") else F.abs(x).try_cast("decimal(38,18)")
    down = F.when(x < 0, -F.floor(F.abs(d), F.lit(scale))).otherwise(F.floor(F.abs(d), F.lit(scale))).cast(kind)
    if kind.startswith("decimal"):
        return down
    return F.when(F.abs(x) < 1e18, down).otherwise(x - x % (10.0**-scale) if scale < 0 else x)


def log(base: Column, x: Column) -> Column:
    """LOG(b, x)."""
    return F.ln(x) / F.ln(base)


def rand() -> Column:
    """RAND(): from 0 to below 1."""
    return F.rand()


def current_timestamp(digits: int = 3, local: bool = False) -> Column:
    """CURRENT_TIMESTAMP(p), or LOCALTIMESTAMP(p) without a zone: the same moment in all rows of a query, cut to p digits."""
    cut = F.timestamp_micros(F.floor(F.unix_micros(F.current_timestamp()) / F.lit(10 ** (6 - digits))).cast("bigint") * 10 ** (6 - digits))
    return cut.cast("timestamp_ntz") if local else cut


def current_time(digits: int = 0) -> Column:
    """CURRENT_TIME(p) and LOCALTIME(p), as hh:mm:ss with p digits."""
    return F.date_format(current_timestamp(digits), "HH:mm:ss" + ("." + "S" * digits if digits else ""))


def int_div(a: Column, b: Column) -> Column:
    """Integer division, towards zero."""
    return ((a - a % b) / b).cast("bigint")


def unicode_char(code: Column) -> Column:
    """The character of a code point, beyond 255 too."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32")


def unicode_val(text: Column) -> Column:
    return F.ascii(text)


def blob_append(*parts: Column) -> Column:
    """Nulls are skipped; null if all are."""
    return F.when(F.coalesce(*parts).isNotNull(), F.concat_ws("", *parts))


def datediff(unit: str, a: Column, b: Column) -> Column:
    """Unit boundaries between two times, not complete units."""
    unit = unit.lower()
    months = (F.year(b) * 12 + F.month(b)) - (F.year(a) * 12 + F.month(a))
    if unit == "month":
        return months.cast("bigint")
    if unit == "year":
        return (F.year(b) - F.year(a)).cast("bigint")
    if unit == "quarter":
        return ((F.year(b) * 4 + F.quarter(b)) - (F.year(a) * 4 + F.quarter(a))).cast("bigint")
    if unit in ("day", "week"):
        days = F.datediff(F.date_trunc(unit, b), F.date_trunc(unit, a))
        return (days if unit == "day" else (days / 7)).cast("bigint")
    seconds = {"hour": 3600, "minute": 60, "second": 1}
    if unit == "millisecond":
        return F.timestamp_diff("MILLISECOND", F.date_trunc("millisecond", a), F.date_trunc("millisecond", b))
    return (F.timestamp_diff("SECOND", F.date_trunc(unit, a), F.date_trunc(unit, b)) / seconds[unit]).cast("bigint")


def in_zone(x: Column, zone: str) -> Column:
    """The wall time in a zone of a moment given in UTC (TIMESTAMP WITH TIME ZONE is kept as a moment and a zone)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), x.cast("timestamp_ntz"))


def zone_minutes(x: Column, zone: str) -> Column:
    """Minutes that a zone is ahead of UTC at a moment."""
    return F.timestamp_diff("MINUTE", x.cast("timestamp_ntz"), in_zone(x, zone))


def extract(part: str, x: Column, weekday_base: int = 0, yearday_base: int = 0, zone: str = "UTC") -> Column:
    """WEEKDAY counts from Sunday and YEARDAY from the first of January, both from 0 unless said; x is in UTC where a zone is asked for."""
    part = part.upper()
    if part == "WEEKDAY":
        return F.dayofweek(x) - 1 + weekday_base
    if part == "YEARDAY":
        return F.dayofyear(x) - 1 + yearday_base
    if part == "MILLISECOND":
        return (F.date_part(F.lit("SECOND"), x).cast("decimal(18,6)") * 1000 % 1000).cast("int")
    if part == "SECOND":
        return F.second(x)
    if part in ("TIMEZONE_HOUR", "TIMEZONE_MINUTE"):
        minutes = zone_minutes(x, zone)
        return (F.signum(minutes) * F.floor(F.abs(minutes) / 60) if part == "TIMEZONE_HOUR" else minutes % 60).cast("int")
    if part == "TIMEZONE_NAME":
        return F.lit(zone)
    return F.date_part(F.lit(part), x).cast("int")


def first_day(unit: str, x: Column) -> Column:
    """FIRST_DAY(OF unit FROM x); a week starts on Sunday."""
    if unit.lower() == "week":
        return F.date_sub(x.cast("date"), F.dayofweek(x) - 1)
    return F.trunc(x, unit)


def last_day(unit: str, x: Column) -> Column:
    if unit.lower() == "week":
        return F.date_add(x.cast("date"), 7 - F.dayofweek(x))
    months = {"month": 1, "quarter": 3, "year": 12}[unit.lower()]
    return F.date_sub(F.add_months(F.trunc(x, unit), months), 1)


# The format patterns, and names of months.
_PATTERNS = "YEAR YYYYY YYYY YYY YY Y Q MONTH MON MM RM WW W DAY DY DDD DD D J HH24 HH12 HH MI SSSSS SS FF1 FF2 FF3 FF4 FF5 FF6 FF7 FF8 FF9 TZH TZM TZR A.M. P.M. AM PM".split()
_PARSED = "YEAR YYYY YYY YY Y RRRR RR MONTH MON MM RM DD J HH24 HH12 HH MI SSSSS SS FF1 FF2 FF3 FF4 TZH TZM TZR A.M. P.M. AM PM".split()
_ROMAN = "I II III IV V VI VII VIII IX X XI XII".split()
_MONTHS = "JANUARY FEBRUARY MARCH APRIL MAY JUNE JULY AUGUST SEPTEMBER OCTOBER NOVEMBER DECEMBER".split()


def format_tokens(pattern: str, known: list[str] = _PATTERNS) -> list[tuple[str, str]]:
    """('raw', text) and ('p', pattern) parts; the longest pattern wins, quoted text is raw and may hold \\" and \\\\."""
    out, i, ordered = [], 0, sorted(known, key=len, reverse=True)
    while i < len(pattern):
        if pattern[i] == '"':
            m = re.compile(r'"((?:[^"\\]|\\.)*)"', re.DOTALL).match(pattern, i)
            if not m:
                raise ValueError(f"an open quote in {pattern!r}")
            out.append(("raw", re.sub(r"\\(.)", r"\1", m[1])))
            i = m.end()
            continue
        found = next((p for p in ordered if pattern[i : i + len(p)].upper() == p), None)
        out.append(("p", found) if found else ("raw", pattern[i]))
        i += len(found) if found else 1
    return out


def _of(texts: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, texts)), number)


def format_datetime(x: Column, pattern: str, zone: str | None = None) -> Column:
    """CAST(x AS VARCHAR FORMAT pattern); with a zone, x is a moment in UTC that is shown in it."""
    ahead = zone_minutes(x, zone) if zone else F.lit(0)
    x = in_zone(x, zone) if zone else x
    d = lambda f: F.date_format(x, f)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    fraction = F.rpad(F.date_format(x, "SSSSSS"), 9, "0")
    half = F.when(F.hour(x) < 12, "A.M.").otherwise("P.M.")
    known = {
        "YEAR": F.year(x).cast("string"), "YYYYY": d("yyyyy"), "YYYY": d("yyyy"), "YYY": F.right(d("yyyy"), F.lit(3)), "YY": d("yy"), "Y": F.right(d("yyyy"), F.lit(1)),
        "Q": F.quarter(x).cast("string"), "MM": d("MM"), "MON": d("MMM"), "MONTH": F.upper(d("MMMM")), "RM": _of(_ROMAN, F.month(x)),
        "WW": two(F.floor((F.dayofyear(x) - 1) / 7) + 1), "W": (F.floor((F.dayofmonth(x) - 1) / 7) + 1).cast("string"),
        "D": F.dayofweek(x).cast("string"), "DAY": F.upper(d("EEEE")), "DY": d("EEE"), "DD": d("dd"), "DDD": d("DDD"),
        "J": (F.datediff(x, F.lit("1970-01-01").cast("date")) + 2440588).cast("string"),
        "HH": d("hh"), "HH12": d("hh"), "HH24": d("HH"), "MI": d("mm"), "SS": d("ss"), "SSSSS": (F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x)).cast("string"),
        "AM": F.replace(half, F.lit("."), F.lit("")), "A.M.": half,
        "TZH": F.concat(F.when(ahead < 0, "-").otherwise("+"), two(F.floor(F.abs(ahead) / 60))), "TZM": two(F.abs(ahead) % 60), "TZR": F.lit(zone or "UTC"),
    }
    known |= {"PM": known["AM"], "P.M.": half} | {f"FF{n}": F.substring(fraction, 1, n) for n in range(1, 10)}
    return F.concat(*(F.lit(v) if k == "raw" else known[v] for k, v in format_tokens(pattern)), F.lit(""))


def parse_datetime(text: Column, pattern: str, today: Column | None = None) -> Column:
    """CAST(text AS TIMESTAMP FORMAT pattern); null if the text doesn't fit it or names no real time.

    Years, months and days that the pattern lacks are today's; short years take
    their first digits from it, and RR the century within fifty years of it.  With
    TZH, TZM or TZR the result is the moment in UTC.
    """
    today = F.current_date() if today is None else today
    digits = {"YEAR": r"(\d{1,4})", "YYYY": r"(\d{1,4})", "YYY": r"(\d{1,3})", "YY": r"(\d{1,2})", "Y": r"(\d)", "RR": r"(\d{1,2})", "RRRR": r"(\d{4}|\d{1,2})", "J": r"(\d{1,7})", "SSSSS": r"(\d{1,5})", "TZH": r"([+-]?\d{1,2})"}
    words = {"MON": "(" + "|".join(m[:3] for m in _MONTHS) + ")", "MONTH": "(" + "|".join(_MONTHS) + ")", "RM": "(" + "|".join(sorted(_ROMAN, key=len, reverse=True)) + ")", "TZR": r"([A-Za-z][A-Za-z0-9_/+-]*|[+-]\d{1,2}:\d{2})"}
    words |= {p: r"([AP]\.?M\.?)" for p in ("AM", "PM", "A.M.", "P.M.")} | {f"FF{n}": rf"(\d{{1,{n}}})" for n in range(1, 5)}
    regex, at = r"(?i)\A\s*", {}
    for kind, v in format_tokens(pattern, _PARSED):
        if kind == "raw":
            regex += re.escape(v)
            continue
        regex += (digits | words).get(v, r"(\d{1,2})")
        at["half" if v.strip("AP.") == "M" or v in ("A.M.", "P.M.") else "FF" if v.startswith("FF") else v] = len(at) + 1
    regex += r"\s*\z"
    # one match for all parts, each a lambda variable: every regexp_extract would match the whole text again
    parts = F.when(text.rlike(regex), F.split(F.regexp_replace(text, regex, "\x01".join(f"${n}" for n in range(1, max(at.values(), default=0) + 1))), "\x01"))
    return F.element_at(F.transform(F.array(parts), lambda found: F.when(found.isNotNull(), _moment(found, at, today))), 1)


def _moment(found: Column, at: dict[str, int], today: Column) -> Column:
    """The time that the parts of a text name; ``at`` has the place of each."""
    raw = lambda p: F.element_at(found, at[p])
    number = lambda p: raw(p).try_cast("int")
    now, year = F.year(today), F.year(today)
    for name, size in (("YEAR", 10_000), ("YYYY", 10_000), ("YYY", 1000), ("YY", 100), ("Y", 10)):
        if name in at:
            year = now - now % size + number(name)
    for name in ("RR", "RRRR"):
        if name in at:
            century = now - now % 100 + F.when((number(name) < 50) & (now % 100 >= 50), 100).when((number(name) >= 50) & (now % 100 < 50), -100).otherwise(0)
            year = F.when(F.length(raw(name)) > 2, number(name)).otherwise(century + number(name))
    month, day = F.month(today), number("DD") if "DD" in at else F.dayofmonth(today)
    if "MM" in at:
        month = number("MM")
    for name, texts in (("MON", [m[:3] for m in _MONTHS]), ("MONTH", _MONTHS), ("RM", _ROMAN)):
        if name in at:
            month = F.array_position(F.array(*map(F.lit, texts)), F.upper(raw(name))).cast("int")
    if "J" in at:
        date = F.date_add(F.lit("1970-01-01").cast("date"), number("J") - 2440588)
        year, month, day = F.year(date), F.month(date), F.dayofmonth(date)
    hour, minute, second = (number(p) if p in at else F.lit(0) for p in ("HH24", "MI", "SS"))
    for name in ("HH", "HH12"):
        if name in at:
            hour = number(name) % 12 + (F.when(F.upper(raw("half")).startswith("P"), 12).otherwise(0) if "half" in at else F.lit(0))
    if "SSSSS" in at:
        hour, minute, second = (F.floor(number("SSSSS") / 3600).cast("int"), (F.floor(number("SSSSS") / 60) % 60).cast("int"), number("SSSSS") % 60)
    micros = F.rpad(raw("FF"), 6, "0").try_cast("int") if "FF" in at else F.lit(0)
    out = F.try_make_timestamp_ntz(year, month, day, hour, minute, second.cast("decimal(16,6)") + micros.cast("decimal(16,6)") / 1_000_000)
    if "TZR" in at:
        return F.convert_timezone(raw("TZR"), F.lit("UTC"), out)
    if "TZH" in at:
        minutes = number("TZH") * 60 + (F.when(raw("TZH").startswith("-"), -1).otherwise(1) * number("TZM") if "TZM" in at else F.lit(0))
        out = out - F.make_dt_interval(mins=minutes)
    return out


def _without(entries: Column, others: Column) -> Column:
    return F.map_filter(entries, lambda k, v: ~F.map_contains_key(others, k))


_ENTRIES = "map<string,variant>"


def json_value(value: Column) -> Column:
    """A column as a JSON value of its own type; null as JSON null."""
    return F.from_json(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}), _ENTRIES)["v"]


def json_object(**values: Column) -> Column:
    """JSON_OBJECT(KEY k VALUE v, ...); null values are kept as JSON null."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in values.items())), {"ignoreNullFields": "false"})


def json_array(*values: Column) -> Column:
    """JSON_ARRAY(v, ...): values of any types, nulls as JSON null."""
    return F.to_json(F.array(*map(json_value, values)))


def json_extract(doc: Column, path: str) -> Column:
    """JSON_EXTRACT: the value at a path as text, null if it isn't there."""
    return F.get_json_object(doc, path)


def json_merge(*docs: Column) -> Column:
    """JSON_MERGE: one object with the keys of all, later ones win whole; values keep their JSON types."""
    out = F.from_json(docs[0], _ENTRIES)
    for d in docs[1:]:
        late = F.from_json(d, _ENTRIES)
        out = F.map_concat(_without(out, late), late)
    return F.to_json(out, {"ignoreNullFields": "false"})


def json_set(doc: Column, path: str, value: Column, *more) -> Column:
    """JSON_SET(doc, path, value, ...): sets keys at paths ``$.a.b``; objects on the way are made where they are missing."""
    keys = [k for k in path.removeprefix("$").split(".") if k]
    out = F.to_json(_entries_with(F.from_json(doc, _ENTRIES), keys, json_value(value)), {"ignoreNullFields": "false"})
    return json_set(out, *more) if more else out


def _entries_with(entries: Column, keys: list[str], value: Column) -> Column:
    if len(keys) > 1:
        inner = F.coalesce(F.try_element_at(entries, F.lit(keys[0])).try_cast(_ENTRIES), F.map_from_arrays(F.array().cast("array<string>"), F.from_json(F.lit("[]"), "array<variant>")))
        value = F.parse_json(F.to_json(_entries_with(inner, keys[1:], value), {"ignoreNullFields": "false"}))
    return F.map_concat(F.map_filter(entries, lambda k, _: k != keys[0]), F.create_map(F.lit(keys[0]), value))


def json_valid(text: Column) -> Column:
    """Whether a text is one JSON value and nothing more; null for null."""
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).try_cast("array<variant>")
    return F.when(text.isNotNull(), F.try_parse_json(text).isNotNull() & F.coalesce(F.size(alone) == 1, F.lit(False)))


def hex_decode(text: Column) -> Column:
    return F.unhex(text)


def base64_decode(text: Column) -> Column:
    return F.unbase64(text)


def char_to_uuid(text: Column) -> Column:
    return F.unhex(F.replace(text, F.lit("-"), F.lit("")))


def uuid_to_char(value: Column) -> Column:
    h = F.hex(value)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


# Decimal floating point has no type of its own here: texts, 34 digits, computed a batch at a time.  What is no number gives null.
_DIGITS = Context(prec=34, rounding=ROUND_HALF_EVEN)


def _each(f: Callable, *columns: pd.Series) -> pd.Series:
    def one(*texts):
        try:
            return f(*map(Decimal, texts)) if all(isinstance(t, str) for t in texts) else None
        except InvalidOperation:
            return None

    return pd.Series(list(map(one, *columns)), dtype=object)


@F.pandas_udf(StringType())
def quantize(value: pd.Series, like: pd.Series) -> pd.Series:
    """QUANTIZE: ``value`` with the exponent of ``like``."""
    return _each(lambda x, y: str(x.quantize(y, context=_DIGITS)), value, like)


@F.pandas_udf(StringType())
def normalize_decfloat(value: pd.Series) -> pd.Series:
    return _each(lambda x: str(x.normalize(_DIGITS)), value)


@F.pandas_udf(IntegerType())
def compare_decfloat(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 equal, 1 less, 2 greater, 3 unordered."""
    return _each(lambda x, y: 3 if x.is_nan() or y.is_nan() else 0 if x == y else 1 if x < y else 2, a, b).astype("Int32")


@F.pandas_udf(IntegerType())
def total_order(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(lambda x, y: int(x.compare_total(y)), a, b).astype("Int32")
