"""Dates: instants in UTC, calendar work in a given zone. Queries run with UTC as the session's zone."""

from __future__ import annotations

import re
import zoneinfo
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.errors import InvalidArgument
from docweave.functions.arrays import bind
from docweave.functions.base import Scope, compile_expression, guard, operator, options, reject, unwrap, whole
from docweave.values import DATE, INT, LONG, STRING, Val, is_stamp, null

UNITS = ("millisecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year")
#: Microseconds of the units of fixed length.
MICROS = {"millisecond": 1000, "second": 10**6, "minute": 6 * 10**7, "hour": 36 * 10**8, "day": 864 * 10**8, "week": 6048 * 10**8}
MONTHS = {"month": 1, "quarter": 3, "year": 12}
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


class Zone:
    """What shifts instants to local time and back. utc: no shift; none: a zone that evaluates to null."""

    def __init__(self, col: Column | None, utc: bool = False):
        self.col, self.utc = col, utc

    def local(self, at: Column) -> Column:
        return at if self.utc else F.from_utc_timestamp(at, self.col)

    def instant(self, name: str, local: Column, scope: Scope) -> Column:
        """The instant of a local time: the earlier of two, an error in a gap."""
        if self.utc:
            return local
        at = F.to_utc_timestamp(local, self.col)
        return guard(scope, local.isNotNull() & (F.from_utc_timestamp(at, self.col) != local), f"{name}: no such local time", at)

    def offset_minutes(self, at: Column) -> Column:
        return F.lit(0) if self.utc else ((F.unix_seconds(self.local(at)) - F.unix_seconds(at)) / 60).cast("int")


def zone_name(text: str) -> str | None:
    """A zone as Spark takes it; None is UTC."""
    if text in ("UTC", "GMT", "Z"):
        return None
    if m := re.fullmatch(r"([+-])(\d\d)(?::?(\d\d))?", text):
        if int(m[2]) > 23 or int(m[3] or 0) > 59:
            raise InvalidArgument(f"unknown time zone '{text}'")
        return f"{m[1]}{m[2]}:{m[3] or '00'}"
    try:
        zoneinfo.ZoneInfo(text)
    except (KeyError, ValueError, OSError):
        raise InvalidArgument(f"unknown time zone '{text}'") from None
    return text


def zone(e: Any, scope: Scope) -> Zone | None:
    """The zone that an expression gives; None where it is null."""
    if e is None:
        return None
    v = compile_expression(e, scope)
    if v.null:
        return None
    if not isinstance(v.type, T.StringType):
        raise InvalidArgument("timezone must be a string")
    if v.literal:
        name = zone_name(v.const)
        return Zone(None, True) if name is None else Zone(F.lit(name))
    fixed = F.regexp_replace(v.col, r"^([+-]\d\d)(\d\d)$", "$1:$2")
    return Zone(F.regexp_replace(fixed, r"^([+-]\d\d)$", "$1:00"))


UTC = Zone(None, True)


def instant(name: str, v: Val, scope: Scope) -> Column:
    """A date operand in whole milliseconds."""
    if v.null:
        return F.lit(None).cast("timestamp")
    if v.date:
        return F.timestamp_millis(F.unix_millis(v.col.cast("timestamp")))
    if is_stamp(v.type):
        return F.timestamp_seconds(v.col["time"])
    reject(scope, InvalidArgument(f"{name} takes a date"))
    return F.lit(None).cast("timestamp")


def unit_of(name: str, e: Any, scope: Scope) -> str:
    v = compile_expression(e, scope)
    if not v.literal or v.const not in UNITS:
        raise InvalidArgument(f"{name}: unknown unit")
    return v.const


def week_start(name: str, e: Any, scope: Scope) -> int:
    """Days from Monday."""
    v = compile_expression(e, scope)
    if not v.literal or not isinstance(v.const, str):
        raise InvalidArgument(f"{name}: startOfWeek must be a constant")
    found = [i for i, d in enumerate(WEEKDAYS) if v.const.lower() in (d, d[:3])]
    if not found:
        raise InvalidArgument(f"{name}: unknown startOfWeek")
    return found[0]


def add_units(local: Column, unit: str, amount: Column) -> Column:
    """Local time moved by some units; the day of a month is cut to its length."""
    if unit in MICROS:
        return F.timestamp_micros(F.unix_micros(local) + amount.cast("long") * MICROS[unit])
    return F.timestamp_add("MONTH", (amount * MONTHS[unit]).cast("int"), local)


def _div(a: Column, b: Column | int) -> Column:
    """A quotient toward zero."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.try_divide(a.cast("long") - F.try_mod(a.cast("long"), b.cast("long")), b.cast("long")).cast("long")


def _week(local: Column, start: int) -> Column:
    """The date at which the week of a local time starts."""
    return F.date_sub(local.cast("date"), F.pmod(F.weekday(local) - start, F.lit(7)))


def _parts(local: Column) -> dict[str, Column]:
    return {
        "year": F.year(local), "month": F.month(local), "dayOfMonth": F.dayofmonth(local), "hour": F.hour(local), "minute": F.minute(local), "second": F.second(local),
        "millisecond": F.pmod(F.unix_millis(local), F.lit(1000)).cast("int"), "dayOfWeek": F.dayofweek(local), "dayOfYear": F.dayofyear(local),
        "week": F.floor((F.dayofyear(local) + 6 - (F.dayofweek(local) - 1)) / 7).cast("int"), "isoDayOfWeek": F.weekday(local) + 1,
        "isoWeek": F.weekofyear(local), "isoWeekYear": F.extract(F.lit("YEAROFWEEK"), local),
    }


_PARTS = ("year", "month", "dayOfMonth", "hour", "minute", "second", "millisecond", "dayOfWeek", "dayOfYear", "week", "isoDayOfWeek", "isoWeek", "isoWeekYear")


@operator(*("$" + p for p in _PARTS))
def _part(name: str, e: Any, scope: Scope) -> Val:
    place: Zone | None = UTC
    if isinstance(e, dict) and not any(k.startswith("$") for k in e):
        options(name, e, ("date", "timezone"), ("date",))
        if "timezone" in e:
            place = zone(e["timezone"], scope)
        e = e["date"]
    if place is None:
        return null()
    at = instant(name, compile_expression(unwrap(e), scope), scope)
    part = _parts(place.local(at))[name[1:]]
    wide = name in ("$isoWeekYear",)
    return Val(part.cast("long" if wide else "int"), LONG if wide else INT)


@operator("$dateAdd", "$dateSubtract")
def _add(name: str, e: Any, scope: Scope) -> Val:
    options(name, e, ("startDate", "unit", "amount", "timezone"), ("startDate", "unit", "amount"))
    place = zone(e["timezone"], scope) if "timezone" in e else UTC
    amount = compile_expression(e["amount"], scope)
    start = compile_expression(e["startDate"], scope)
    if place is None or amount.null or start.null:
        return null()
    if not amount.numeric:
        return reject(scope, InvalidArgument(f"{name}: amount must be an integer"))
    real = amount.col.cast("double")
    n = amount.col.cast("long") if amount.integral else guard(scope, real != F.rint(real), f"{name}: amount must be an integer", real.try_cast("long"))
    made = add_units(place.local(instant(name, start, scope)), unit_of(name, e["unit"], scope), n if name == "$dateAdd" else -n)
    return Val(place.instant(name, made, scope), DATE)


@operator("$dateDiff")
def _diff(name: str, e: Any, scope: Scope) -> Val:
    options(name, e, ("startDate", "endDate", "unit", "timezone", "startOfWeek"), ("startDate", "endDate", "unit"))
    place = zone(e["timezone"], scope) if "timezone" in e else UTC
    unit = unit_of(name, e["unit"], scope)
    first = week_start(name, e["startOfWeek"], scope) if "startOfWeek" in e else 6
    if place is None:
        return null()
    a, b = (place.local(instant(name, compile_expression(e[k], scope), scope)) for k in ("startDate", "endDate"))
    if unit == "day":
        made = F.date_diff(b.cast("date"), a.cast("date"))
    elif unit == "week":
        made = (F.date_diff(_week(b, first), _week(a, first)) / 7).cast("long")
    elif unit in MICROS:
        made = _div(F.unix_millis(b) - F.unix_millis(a), MICROS[unit] // 1000)
    else:
        months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
        # a month counts once the start, moved by so many, is not past the end
        moved = lambda m: F.timestamp_add("MONTH", m, a)
        months = bind(months, lambda m: F.when((m > 0) & (moved(m) > b), m - 1).when((m < 0) & (moved(m) < b), m + 1).otherwise(m))
        made = _div(months, MONTHS[unit])
    return Val(made.cast("long"), LONG)


@operator("$dateTrunc")
def _trunc(name: str, e: Any, scope: Scope) -> Val:
    options(name, e, ("date", "unit", "binSize", "timezone", "startOfWeek"), ("date", "unit"))
    place = zone(e["timezone"], scope) if "timezone" in e else UTC
    unit = unit_of(name, e["unit"], scope)
    first = week_start(name, e["startOfWeek"], scope) if "startOfWeek" in e else 6
    size = whole(name, "binSize", compile_expression(e["binSize"], scope), scope, 1) if "binSize" in e else F.lit(1)
    if place is None:
        return null()
    made = truncate(place.local(instant(name, compile_expression(e["date"], scope), scope)), unit, size, first)
    return Val(place.instant(name, made, scope), DATE)


def truncate(local: Column, unit: str, size: Column, first: int) -> Column:
    """The start of the bin of a local time. Bins below a day restart in the next larger unit, days in the month, weeks run from 1970, others from year 1."""
    floored = lambda x: _div(x, size) * size
    if unit in ("millisecond", "second", "minute", "hour"):
        part = {"millisecond": F.pmod(F.unix_millis(local), F.lit(1000)), "second": F.second(local), "minute": F.minute(local), "hour": F.hour(local)}[unit]
        above = {"millisecond": "SECOND", "second": "MINUTE", "minute": "HOUR", "hour": "DAY"}[unit]
        return F.timestamp_micros(F.unix_micros(F.date_trunc(above, local)) + floored(part) * MICROS[unit])
    if unit == "day":
        return F.date_add(F.trunc(local, "MM"), floored(F.dayofmonth(local) - 1).cast("int")).cast("timestamp")
    if unit == "week":
        anchor = _week(F.lit("1970-01-04").cast("timestamp"), first)
        weeks = (F.date_diff(_week(local, first), anchor) / 7).cast("int")
        return F.date_add(anchor, ((weeks - F.pmod(weeks, size)) * 7).cast("int")).cast("timestamp")
    if unit == "year":
        year = F.year(local) - 1
        return F.make_date((year - F.pmod(year, size) + 1).cast("int"), F.lit(1), F.lit(1)).cast("timestamp")
    months = (F.year(local) - 1) * 12 + F.month(local) - 1
    bins = size * MONTHS[unit]
    start = months - F.pmod(months, bins)
    return F.make_date((_div(start, 12) + 1).cast("int"), (F.pmod(start, F.lit(12)) + 1).cast("int"), F.lit(1)).cast("timestamp")


#: Parts of a date with their least, greatest and default.
_RANGES = {
    "year": (1, 9999, None), "month": (1, 12, 1), "day": (1, 31, 1), "hour": (0, 23, 0), "minute": (0, 59, 0), "second": (0, 59, 0), "millisecond": (0, 999, 0),
    "isoWeekYear": (1, 9999, None), "isoWeek": (1, 53, 1), "isoDayOfWeek": (1, 7, 1),
}


@operator("$dateFromParts")
def _from_parts(name: str, e: Any, scope: Scope) -> Val:
    options(name, e, (*_RANGES, "timezone"))
    iso = "isoWeekYear" in e
    if iso == ("year" in e) or any(k in e for k in (("month", "day") if iso else ("isoWeek", "isoDayOfWeek"))):
        raise InvalidArgument("$dateFromParts takes either year or isoWeekYear, with parts of its kind")
    place = zone(e["timezone"], scope) if "timezone" in e else UTC
    used = [k for k in _RANGES if k in (("isoWeekYear", "isoWeek", "isoDayOfWeek") if iso else ("year", "month", "day")) or k in ("hour", "minute", "second", "millisecond")]
    parts, none = {}, F.lit(False)
    for k in used:
        low, high, default = _RANGES[k]
        if k not in e:
            parts[k] = F.lit(default)
            continue
        v = compile_expression(e[k], scope)
        if v.null:
            return null()
        if not v.numeric:
            return reject(scope, InvalidArgument(f"$dateFromParts: {k} must be an integer"))
        real = v.col.cast("double")
        none = none | real.isNull()
        good = (real == F.rint(real)) & (real >= low) & (real <= high)
        parts[k] = guard(scope, real.isNotNull() & ~good, f"$dateFromParts: {k} out of range", F.when(good, real).cast("int"))
    if place is None:
        return null()
    if iso:
        monday = F.date_trunc("WEEK", F.make_date(parts["isoWeekYear"], F.lit(1), F.lit(4)).cast("timestamp")).cast("date")
        day = F.date_add(monday, (parts["isoWeek"] - 1) * 7 + parts["isoDayOfWeek"] - 1)
    else:
        day = F.to_date(F.try_make_timestamp(parts["year"], parts["month"], parts["day"], F.lit(0), F.lit(0), F.lit(0)))
        day = guard(scope, ~none & day.isNull(), "$dateFromParts: no such day", day)
    millis = ((parts["hour"] * 60 + parts["minute"]) * 60 + parts["second"]).cast("long") * 1000 + parts["millisecond"]
    local = F.timestamp_millis(F.unix_millis(day.cast("timestamp")) + millis)
    return Val(F.when(~none, place.instant(name, local, scope)), DATE)


#: Directives of formats: pattern of a part, and what it is called.
_DIRECTIVES = {
    "Y": (r"(\d{4})", "year"), "m": (r"(\d{1,2})", "month"), "d": (r"(\d{1,2})", "day"), "H": (r"(\d{1,2})", "hour"), "M": (r"(\d{1,2})", "minute"), "S": (r"(\d{1,2})", "second"),
    "L": (r"(\d{3})", "millisecond"), "z": (r"([+-]\d\d:?\d\d)", "offset"), "G": (r"(\d{4})", "isoWeekYear"), "V": (r"(\d{1,2})", "isoWeek"), "u": (r"([1-7])", "isoDayOfWeek"),
    "j": (r"(\d{1,3})", "dayOfYear"), "b": (r"([A-Za-z]{3})", "monthName"), "B": (r"([A-Za-z]{3,9})", "monthName"),
}
_DEFAULTS = ("%Y-%m-%dT%H:%M:%S.%L%z", "%Y-%m-%dT%H:%M:%S%z")


def _read(text: Column, format_: str) -> tuple[Column, bool]:
    """The time that a text gives by a format (NULL where it does not fit), and whether it is an instant, as the format has an offset, or a local time.

    Text and pattern are evaluated once: the parts are bound as an array.
    """
    rule, groups, i = "", [], 0
    while i < len(format_):
        c = format_[i]
        if c != "%":
            rule += re.escape(c)
            i += 1
            continue
        if i + 1 == len(format_):
            raise InvalidArgument("a format ends in %")
        d = format_[i + 1]
        i += 2
        if d == "%":
            rule += "%"
        elif d in _DIRECTIVES:
            rule += _DIRECTIVES[d][0]
            groups.append(_DIRECTIVES[d][1])
        else:
            raise InvalidArgument(f"unknown directive %{d}")
    rule = rf"^{rule}\z"
    # no part holds a comma
    found = lambda t: F.when(F.regexp_like(t, F.lit(rule)), F.split(F.regexp_replace(t, F.lit(rule), F.lit(",".join(f"${k + 1}" for k in range(len(groups))))), ","))
    return bind(text, lambda t: bind(found(t), lambda p: _assembled(p, groups))), "offset" in groups


def _assembled(p: Column, groups: list[str]) -> Column:
    """The time that parts give, NULL where p is."""
    part = lambda k: p[groups.index(k)]
    number = lambda k, default: part(k).try_cast("int") if k in groups else F.lit(default)
    within = lambda k, low, high: F.when(number(k, 0).between(low, high), number(k, 0)) if k in groups else F.lit(low)
    if "isoWeekYear" in groups:
        monday = F.date_trunc("WEEK", F.make_date(number("isoWeekYear", 1), F.lit(1), F.lit(4)).cast("timestamp")).cast("date")
        day = F.date_add(monday, (within("isoWeek", 1, 53) - 1) * 7 + within("isoDayOfWeek", 1, 7) - 1)
    elif "dayOfYear" in groups:
        day = F.date_add(F.make_date(number("year", 1970), F.lit(1), F.lit(1)), within("dayOfYear", 1, 366) - 1)
    else:
        month = within("month", 1, 12)
        if "monthName" in groups:
            month = F.array_position(F.array(*[F.lit(m[:3].lower()) for m in _NAMES]), F.lower(F.substring(part("monthName"), 1, 3))).cast("int")
        day = F.to_date(F.try_make_timestamp(number("year", 1970), month, number("day", 1), F.lit(0), F.lit(0), F.lit(0)))
    millis = ((within("hour", 0, 23) * 60 + within("minute", 0, 59)) * 60 + within("second", 0, 59)).cast("long") * 1000 + number("millisecond", 0)
    if "offset" in groups:
        o = F.regexp_replace(part("offset"), ":", "")
        seconds = (F.substring(o, 2, 2).try_cast("int") * 60 + F.substring(o, 4, 2).try_cast("int")) * 60 * F.when(o.startswith("-"), -1).otherwise(1)
        millis = millis - seconds.cast("long") * 1000
    return F.when(p.isNotNull(), F.timestamp_millis(F.unix_millis(day.cast("timestamp")) + millis))


def rfc3339(text: Column) -> Column:
    """The instant of a text with date, time and zone; NULL where it is none."""
    m = r"^(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"
    part = lambda g: F.regexp_extract(text, m, g)
    return F.when(F.regexp_like(text, F.lit(m)), F.try_to_timestamp(F.concat(part(1), F.lit("T"), part(2), F.substring(F.concat(part(3), F.when(part(3) == "", ".").otherwise(""), F.lit("000")), 1, 4), F.upper(part(4))), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX")))


def _given(scope: Scope, text: Column, made: Column) -> Column:
    """made, an error where a text gives no date; read once where errors are raised at once."""
    message = "$dateFromString: the text is no date"
    if scope.errors is not None:
        return guard(scope, text.isNotNull() & made.isNull(), message, made)
    return F.coalesce(made, F.when(text.isNotNull(), F.raise_error(F.lit(message))).cast("timestamp"))


@operator("$dateFromString")
def _from_string(name: str, e: Any, scope: Scope) -> Val:
    options(name, e, ("dateString", "format", "timezone", "onError", "onNull"), ("dateString",))
    v = compile_expression(e["dateString"], scope)
    other = {k: compile_expression(e[k], scope) for k in ("onError", "onNull") if k in e}
    for k, o in other.items():
        if not o.null and not o.date:
            raise InvalidArgument(f"$dateFromString: {k} must give a date in a typed column")
    place = zone(e["timezone"], scope) if "timezone" in e else UTC
    if place is None:
        return null()
    on_null = other["onNull"].col.cast("timestamp") if "onNull" in other else F.lit(None).cast("timestamp")
    if v.null:
        return Val(on_null, DATE)
    if not isinstance(v.type, T.StringType):
        if "onError" not in other:
            return reject(scope, InvalidArgument("$dateFromString takes a string"))
        return Val(F.when(v.col.isNull(), on_null).otherwise(other["onError"].col.cast("timestamp")), DATE)
    text = v.col
    if e.get("format") is not None:
        rule = compile_expression(e["format"], scope)
        if not rule.literal or not isinstance(rule.const, str):
            raise InvalidArgument("$dateFromString: format must be a constant")
        read, zoned = _read(text, rule.const)
        if zoned and "timezone" in e:
            raise InvalidArgument("$dateFromString: both the format and the call name a time zone")
        made = read if zoned else place.instant(name, read, scope)
    else:
        zoned = rfc3339(text)
        if "timezone" in e:
            zoned = guard(scope, zoned.isNotNull(), "$dateFromString: both the text and the call name a time zone", zoned)
        m = r"^(\d{4}-\d\d-\d\d)(?:[T ](\d\d:\d\d:\d\d)(\.\d+)?)?$"
        part = lambda g: F.regexp_extract(text, m, g)
        bare = F.when(F.regexp_like(text, F.lit(m)), F.try_to_timestamp(F.concat(part(1), F.lit(" "), F.when(part(2) == "", "00:00:00").otherwise(part(2)), F.substring(F.concat(part(3), F.when(part(3) == "", ".").otherwise(""), F.lit("000")), 1, 4)), F.lit("yyyy-MM-dd HH:mm:ss.SSS")))
        made = F.coalesce(zoned, place.instant(name, bare, scope))
    if "onError" in other:
        made = F.coalesce(made, other["onError"].col.cast("timestamp"))
    else:
        made = _given(scope, text, made)
    return Val(F.when(text.isNull(), on_null).otherwise(made), DATE)


@operator("$dateToString")
def _to_string(name: str, e: Any, scope: Scope) -> Val:
    options(name, e, ("date", "format", "timezone", "onNull"), ("date",))
    place = zone(e["timezone"], scope) if "timezone" in e else UTC
    at = instant(name, compile_expression(e["date"], scope), scope)
    on_null = compile_expression(e["onNull"], scope) if "onNull" in e else null()
    if place is None:
        return null()
    if e.get("format") is not None:
        rule = compile_expression(e["format"], scope)
        if not rule.literal or not isinstance(rule.const, str):
            raise InvalidArgument("$dateToString: format must be a constant")
        rule = rule.const
    else:
        rule = "%Y-%m-%dT%H:%M:%S.%LZ" if place.utc else "%Y-%m-%dT%H:%M:%S.%L"
    made = _written(at, place, rule)
    return Val(F.when(at.isNull(), on_null.col.cast("string")).otherwise(made), STRING)


def _written(at: Column, place: Zone, rule: str) -> Column:
    p = _parts(place.local(at))
    offset = place.offset_minutes(at)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    month = lambda short: F.element_at(F.array(*[F.lit(m[:3] if short else m) for m in _NAMES]), p["month"])
    written = {
        "%": F.lit("%"), "Y": pad(p["year"], 4), "m": pad(p["month"], 2), "d": pad(p["dayOfMonth"], 2), "H": pad(p["hour"], 2), "M": pad(p["minute"], 2), "S": pad(p["second"], 2),
        "L": pad(p["millisecond"], 3), "G": pad(p["isoWeekYear"], 4), "V": pad(p["isoWeek"], 2), "u": p["isoDayOfWeek"].cast("string"), "U": pad(p["week"], 2), "w": p["dayOfWeek"].cast("string"),
        "j": pad(p["dayOfYear"], 3), "Z": offset.cast("string"), "b": month(True), "B": month(False),
        "z": F.concat(F.when(offset < 0, "-").otherwise("+"), pad(F.floor(F.abs(offset) / 60), 2), pad(F.pmod(F.abs(offset), F.lit(60)), 2)),
    }
    parts, i = [], 0
    while i < len(rule):
        if rule[i] != "%":
            end = rule.find("%", i)
            end = len(rule) if end < 0 else end
            parts.append(F.lit(rule[i:end]))
            i = end
            continue
        if i + 1 == len(rule):
            raise InvalidArgument("a format ends in %")
        if rule[i + 1] not in written:
            raise InvalidArgument(f"unknown directive %{rule[i + 1]}")
        parts.append(written[rule[i + 1]])
        i += 2
    return F.concat(*parts) if parts else F.lit("")


@operator("$dateToParts")
def _to_parts(name: str, e: Any, scope: Scope) -> Val:
    options(name, e, ("date", "timezone", "iso8601"), ("date",))
    iso = e.get("iso8601", False)
    if not isinstance(iso, bool):
        raise InvalidArgument("$dateToParts: iso8601 must be a constant")
    place = zone(e["timezone"], scope) if "timezone" in e else UTC
    if place is None:
        return null()
    at = instant(name, compile_expression(e["date"], scope), scope)
    p = _parts(place.local(at))
    kept = {"isoWeekYear": "isoWeekYear", "isoWeek": "isoWeek", "isoDayOfWeek": "isoDayOfWeek"} if iso else {"year": "year", "month": "month", "day": "dayOfMonth"}
    kept |= {k: k for k in ("hour", "minute", "second", "millisecond")}
    return Val(F.when(at.isNotNull(), F.struct(*[p[v].cast("int").alias(k) for k, v in kept.items()])), T.StructType([T.StructField(k, INT) for k in kept]))


@operator("$tsSecond", "$tsIncrement")
def _stamp(name: str, e: Any, scope: Scope) -> Val:
    v = compile_expression(unwrap(e), scope)
    if v.null:
        return null()
    if not is_stamp(v.type):
        return reject(scope, InvalidArgument(f"{name} takes a timestamp"))
    return Val(v.col["time" if name == "$tsSecond" else "increment"], LONG)
