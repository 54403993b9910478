"""Strings and patterns."""

from __future__ import annotations

import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.errors import InvalidArgument
from docweave.functions.base import Scope, arguments, compile_expression, guard, operator, options, reject, single, text_of, unwrap, variadic, whole
from docweave.values import BOOL, INT, LONG, STRING, Val, null

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def number_text(x: Column) -> Column:
    """A double as text: integral ones without a fraction."""
    small = F.abs(x) < 1e18
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").when(small & (x == F.rint(x)), F.when(small, x).cast("long").cast("string")).otherwise(x.cast("string"))


def date_text(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def scalar_text(name: str, v: Val, scope: Scope) -> Column:
    """Strings, numbers and dates as text; null as ''."""
    if v.null:
        return F.lit("")
    if isinstance(v.type, T.StringType):
        made = v.col
    elif isinstance(v.type, T.DoubleType | T.FloatType):
        made = number_text(v.col.cast("double"))
    elif v.numeric:
        made = v.col.cast("string")
    elif v.date:
        made = date_text(v.col)
    elif v.dynamic:
        made = F.try_variant_get(v.col, "$", "string")
    else:
        reject(scope, InvalidArgument(f"{name} takes strings, numbers or dates"))
        return F.lit("")
    return F.coalesce(made, F.lit(""))


@operator("$concat")
def _concat(name: str, e: Any, scope: Scope) -> Val:
    parts = [text_of(name, compile_expression(x, scope), scope) for x in variadic(e)]
    return Val(F.concat(*parts) if parts else F.lit(""), STRING)


@operator("$toLower", "$toUpper")
def _case(name: str, e: Any, scope: Scope) -> Val:
    text = scalar_text(name, compile_expression(single(name, e), scope), scope)
    return Val(F.translate(text, *((_UPPER, _LOWER) if name == "$toLower" else (_LOWER, _UPPER))), STRING)


@operator("$strcasecmp")
def _casecmp(name: str, e: Any, scope: Scope) -> Val:
    a, b = (F.translate(scalar_text(name, compile_expression(x, scope), scope), _UPPER, _LOWER) for x in arguments(name, e, 2))
    return Val(F.when(a < b, -1).when(a > b, 1).otherwise(0).cast("int"), INT)


@operator("$strLenBytes", "$strLenCP", "$binarySize")
def _length(name: str, e: Any, scope: Scope) -> Val:
    v = compile_expression(single(name, e) if name == "$binarySize" else unwrap(e), scope)
    if name == "$binarySize":
        if v.null:
            return null()
        if not isinstance(v.type, T.StringType | T.BinaryType):
            return reject(scope, InvalidArgument("$binarySize takes a string or binary data"))
        return Val(F.octet_length(v.col), INT)
    text = text_of(name, v, scope)
    measured = F.octet_length(text) if name == "$strLenBytes" else F.char_length(text)
    return Val(guard(scope, text.isNull(), f"{name} expects a string", measured).cast("long"), LONG)


@operator("$substrCP")
def _substr_cp(name: str, e: Any, scope: Scope) -> Val:
    args = [compile_expression(x, scope) for x in arguments(name, e, 3)]
    start, n = whole(name, "start", args[1], scope, 0), whole(name, "length", args[2], scope, 0)
    return Val(F.substring(scalar_text(name, args[0], scope), start + 1, n), STRING)


@operator("$substr", "$substrBytes")
def _substr_bytes(name: str, e: Any, scope: Scope) -> Val:
    args = [compile_expression(x, scope) for x in arguments(name, e, 3)]
    data = F.encode(scalar_text(name, args[0], scope), "utf-8")
    for v in args[1:]:
        if not v.numeric:
            return reject(scope, InvalidArgument(f"{name} takes numeric bounds"))
    start, n = args[1].col.cast("int"), args[2].col.cast("int")
    size = F.octet_length(data)
    first = F.least(start, size)
    length = F.when(n < 0, size - first).otherwise(F.least(n, size - first))
    # a cut inside a character leaves a byte 10xxxxxx at its start or right after its end
    inner = lambda at: (at < size) & (F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("int").bitwiseAND(0xC0) == 0x80)
    bad = (start < 0) | inner(first) | inner(first + length)
    return Val(guard(scope, bad, f"{name}: bounds inside a character", F.decode(F.substring(data, first + 1, length), "utf-8")), STRING)


@operator("$indexOfCP", "$indexOfBytes")
def _index_of(name: str, e: Any, scope: Scope) -> Val:
    args = [compile_expression(x, scope) for x in arguments(name, e, 2, 4)]
    text = text_of(name, args[0], scope)
    part = text_of(name, args[1], scope)
    part = guard(scope, part.isNull() & text.isNotNull(), f"{name}: what to find must be a string", part)
    in_bytes = name == "$indexOfBytes"
    length = (lambda s: F.octet_length(s)) if in_bytes else (lambda s: F.char_length(s))
    start = whole(name, "start", args[2], scope, 0) if len(args) > 2 else F.lit(0)
    end = whole(name, "end", args[3], scope, 0) if len(args) > 3 else length(text)
    if not in_bytes:
        at = F.when(part == "", F.when(start <= F.char_length(text), start + 1).otherwise(0)).otherwise(F.position(part, text, start + 1)) - 1
        found = F.when((at >= 0) & (at + F.char_length(part) <= end), at).otherwise(-1)
    else:
        # hexadecimal digits stand for bytes: a hit counts where it begins at an even digit
        digits, sought = F.hex(F.encode(text, "utf-8")), F.hex(F.encode(part, "utf-8"))
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.octet_length(text) - F.octet_length(part), F.lit(0))), lambda i: (i >= start) & (i + F.octet_length(part) <= F.least(end, F.octet_length(text))) & (F.substring(digits, i * 2 + 1, F.char_length(sought)) == sought))
        found = F.coalesce(F.get(places, F.lit(0)), F.lit(-1))
    return Val(F.when(text.isNotNull(), found).cast("long"), LONG)


@operator("$split")
def _split(name: str, e: Any, scope: Scope) -> Val:
    a, b = (compile_expression(x, scope) for x in arguments(name, e, 2))
    if a.null or b.null:
        return null()
    text, by = text_of(name, a, scope), text_of(name, b, scope)
    made = F.split(text, F.lit(re.escape(b.const)) if b.literal and b.const else F.concat(F.lit("\\Q"), by, F.lit("\\E")), -1)
    return Val(guard(scope, by == "", "$split: empty separator", made), T.ArrayType(STRING))


@operator("$replaceOne", "$replaceAll")
def _replace(name: str, e: Any, scope: Scope) -> Val:
    options(name, e, ("input", "find", "replacement"), ("input", "find", "replacement"))
    text, find, by = (text_of(name, compile_expression(e[k], scope), scope) for k in ("input", "find", "replacement"))
    none = text.isNull() | find.isNull() | by.isNull()
    at = F.instr(text, find)
    once = F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), by, F.substring(text, at + F.char_length(find), F.char_length(text)))).otherwise(text)
    # an empty find stands between all characters, and before the first
    between = F.concat(by, F.array_join(F.transform(F.split(text, ""), lambda c: F.concat(c, by)), ""))
    made = F.when(find == "", F.concat(by, text) if name == "$replaceOne" else F.when(text == "", by).otherwise(between)).otherwise(once if name == "$replaceOne" else F.replace(text, find, by))
    return Val(F.when(~none, made), STRING)


@operator("$trim", "$ltrim", "$rtrim")
def _trim(name: str, e: Any, scope: Scope) -> Val:
    options(name, e, ("input", "chars"), ("input",))
    text = text_of(name, compile_expression(e["input"], scope), scope)
    if "chars" not in e:
        left, right = (F.regexp_replace(text, p, "") for p in ("(?U)^[\\s\\x00]+", "(?U)[\\s\\x00]+$"))
        both = F.regexp_replace(left, "(?U)[\\s\\x00]+$", "")
        return Val({"$trim": both, "$ltrim": left, "$rtrim": right}[name], STRING)
    chars = text_of(name, compile_expression(e["chars"], scope), scope)
    made = {"$trim": F.btrim, "$ltrim": F.ltrim, "$rtrim": F.rtrim}[name](text, chars)
    return Val(F.when(chars == "", text).otherwise(made), STRING)


# patterns

_OUTSIDE = re.compile(r"(?<!\\)(?:\\\\)*(?:\(\?(?:=|!|<=|<!)|\\[1-9])")


def pattern(name: str, text: str, flags: str = "") -> str:
    """A pattern with its options in front; look-around and back references are not part of the language."""
    if _OUTSIDE.search(text):
        raise InvalidArgument(f"{name}: look-around and back references are not supported")
    for f in flags:
        if f not in "imsxu":
            raise InvalidArgument(f"{name}: unknown option '{f}'")
    kept = "".join(dict.fromkeys(f for f in flags if f != "u"))
    try:
        re.compile(text)
    except re.error:
        if text.count("(") != text.count("\\(") + text.count(")") - text.count("\\)"):
            raise InvalidArgument(f"{name}: broken pattern") from None
    return f"(?{kept}){text}" if kept else text


MATCH = T.StructType([T.StructField("match", STRING), T.StructField("idx", INT), T.StructField("captures", T.ArrayType(STRING))])


@operator("$regexMatch", "$regexFind", "$regexFindAll")
def _regex(name: str, e: Any, scope: Scope) -> Val:
    options(name, e, ("input", "regex", "options"), ("input", "regex"))
    text = text_of(name, compile_expression(e["input"], scope), scope)
    if isinstance(e["regex"], re.Pattern):
        flags = "".join(c for c, f in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if e["regex"].flags & f)
        rule: str | None = e["regex"].pattern
    else:
        v = compile_expression(e["regex"], scope)
        flags, rule = "", v.const if v.literal else None
        if v.null:
            rule = ""
    if "options" in e:
        given = compile_expression(e["options"], scope)
        if not given.null:
            if not given.literal or not isinstance(given.const, str) or flags:
                raise InvalidArgument(f"{name}: options must be one constant string")
            flags = given.const
    if not isinstance(e["regex"], re.Pattern) and v.null:
        return {"$regexMatch": Val(F.lit(False), BOOL), "$regexFind": null(), "$regexFindAll": Val(F.array().cast(T.ArrayType(MATCH)), T.ArrayType(MATCH))}[name]
    dynamic = rule is None
    made = F.concat(F.lit(f"(?{flags})" if flags else ""), text_of(name, v, scope)) if dynamic else F.lit(pattern(name, rule, flags))
    if name == "$regexMatch":
        return Val(F.coalesce(F.regexp_like(text, made), F.lit(False)), BOOL)
    if name == "$regexFind" and not dynamic:
        groups = re.compile(rule).groups if _compiles(rule) else 0
        at = F.regexp_instr(text, made)
        match = F.regexp_substr(text, made)
        captures = F.array(*[F.regexp_extract(text, pattern(name, rule, flags), g) for g in range(1, groups + 1)]) if groups else F.array(match)
        return Val(F.when(at > 0, F.struct(match.alias("match"), (at - 1).cast("int").alias("idx"), captures.alias("captures"))), MATCH)
    found = _find_all(text, made)
    return Val(F.get(found, F.lit(0)), MATCH) if name == "$regexFind" else Val(F.coalesce(found, F.array().cast(T.ArrayType(MATCH))), T.ArrayType(MATCH))


def _compiles(rule: str) -> bool:
    try:
        re.compile(rule)
    except re.error:
        return False
    return True


def _find_all(text: Column, rule: Column) -> Column:
    """All matches with places and groups; no built-in gives places beyond the first, so this is an Arrow UDF."""
    import regex

    @F.pandas_udf(T.ArrayType(MATCH))
    def find(texts: pd.Series, rules: pd.Series) -> pd.Series:
        def one(t, r):
            if t is None or r is None:
                return None
            out = []
            for m in regex.finditer(r, t):
                groups = [g if g is not None else "" for g in m.groups()] or [m.group()]
                out.append({"match": m.group(), "idx": m.start(), "captures": groups})
            # a match of nothing at the very end is none
            return out[:-1] if out and out[-1]["match"] == "" and out[-1]["idx"] == len(t) and t else out

        return pd.Series([one(t, r) for t, r in zip(texts, rules, strict=True)])

    return find(text, rule)
