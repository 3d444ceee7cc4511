"""The SQL dialect's scalar functions as Spark SQL text.

Each entry takes its arguments as SQL text and gives SQL text over built-in functions, so a call stays inside
whole-stage code generation. Where the dialect's result differs from Spark's function of the same name, the text says
how: NULL instead of an error or NaN outside a function's domain, bytes instead of characters, an empty string for
position 0, and so on. ``TYPED`` entries also get a function that tells an argument's Spark type.
"""

from __future__ import annotations

from collections.abc import Callable

from ..errors import ARGUMENTS, EngineError

FUNCTIONS: dict[str, Callable[..., str]] = {}
TYPED: set[str] = set()


def _def(*names: str, typed: bool = False):
    def add(f):
        for n in names:
            FUNCTIONS[n] = f
            if typed:
                TYPED.add(n)
        return f

    return add


def _same(*names: str) -> None:
    for n in names:
        FUNCTIONS[n] = lambda *a, _n=n: f"{_n}({', '.join(a)})"


def _nan_null(x: str) -> str:
    return f"nanvl({x}, cast(null as double))"


def _any_null(a) -> str:
    return " or ".join(f"{x} is null" for x in a)


# -- comparison and null ----------------------------------------------------------------------------------------------
_same("coalesce", "nullif", "concat", "concat_ws", "abs", "ceil", "ceiling", "floor", "cos", "sin", "tan", "exp", "degrees", "radians", "pi", "pow", "power")
_same("year", "month", "hour", "minute", "crc32", "bin", "instr", "lower", "lcase", "upper", "ucase", "ltrim", "rtrim", "replace", "reverse", "substring_index", "bit_length", "char_length", "character_length")
_def("isnull")(lambda x: f"cast({x} is null as int)")
_def("greatest")(lambda *a: f"case when {_any_null(a)} then null else greatest({', '.join(a)}) end")
_def("least")(lambda *a: f"case when {_any_null(a)} then null else least({', '.join(a)}) end")


@_def("interval")
def _interval(n, *steps):
    return f"case when {n} is null then -1 " + " ".join(f"when {n} < {s} then {i}" for i, s in enumerate(steps)) + f" else {len(steps)} end"


_def("if")(lambda c, a, b: f"if(coalesce(cast({c} as boolean), false), {a}, {b})")
_def("ifnull")(lambda a, b: f"coalesce({a}, {b})")

# -- numbers ----------------------------------------------------------------------------------------------------------
_def("acos")(lambda x: _nan_null(f"acos({x})"))
_def("asin")(lambda x: _nan_null(f"asin({x})"))
_def("atan", "atan2")(lambda y, x=None: f"atan({y})" if x is None else f"atan2({y}, {x})")
_def("conv")(lambda n, a, b: f"conv(cast({n} as string), {a}, {b})")
_def("cot")(lambda x: f"case when {x} = 0 then raise_error('cot: value out of range') else cot({x}) end")
_def("ln")(lambda x: f"ln({x})")
_def("log")(lambda a, b=None: f"ln({a})" if b is None else f"case when {a} = 1 then null else log({a}, {b}) end")
_def("log2")(lambda x: f"log2({x})")
_def("log10")(lambda x: f"log10({x})")
_def("rand")(lambda seed="": f"rand({seed})")
_def("sign")(lambda x: f"cast(signum({x}) as int)")
_def("sqrt")(lambda x: _nan_null(f"sqrt({x})"))
_def("mod")(lambda a, b: f"try_mod({a}, {b})")


@_def("round", typed=True)
def _round(x, d="0", kind=None):
    return f"{'bround' if kind and kind(x) in ('double', 'float') else 'round'}({x}, {d})"


@_def("truncate", typed=True)
def _truncate(x, d, kind=None):
    if kind and kind(x) in ("double", "float"):
        step = f"pow(10.0D, {d})"
        return f"(case when {x} >= 0 then floor({x} * {step}) else ceil({x} * {step}) end / {step})"
    return f"(case when {x} >= 0 then floor({x}, {d}) else ceil({x}, {d}) end)"


# -- time -------------------------------------------------------------------------------------------------------------
_def("day", "dayofmonth")(lambda t: f"dayofmonth({t})")
_def("second")(lambda t: f"second({t})")
_def("microsecond")(lambda t: f"cast(pmod(unix_micros(cast({t} as timestamp)), 1000000) as int)")

# The dialect's format letters and Java's.
FORMAT_LETTERS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h",
    "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS", "p": "a", "j": "DDD", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "E", "T": "HH:mm:ss", "r": "hh:mm:ss a",
}
#: Letters that stand for a week (or its year) and the mode in which weeks count: (mode, whether the year).
WEEK_LETTERS = {"U": (0, False), "u": (1, False), "V": (2, False), "v": (3, False), "X": (2, True), "x": (3, True)}


def _format_parts(pattern: str) -> list[tuple[str, str]]:
    """("java", pattern) and ("letter", letter that Java lacks) in order."""
    out: list[tuple[str, str]] = []
    plain, i = "", 0

    def java(text: str):
        if out and out[-1][0] == "java":
            out[-1] = ("java", out[-1][1] + text)
        else:
            out.append(("java", text))

    def close():
        nonlocal plain
        if plain:
            java("'" + plain.replace("'", "''") + "'" if any(c.isalpha() or c in "'[]{}#" for c in plain) else plain)
            plain = ""

    while i < len(pattern):
        if pattern[i] == "%" and i + 1 < len(pattern):
            i += 1
            if pattern[i] in FORMAT_LETTERS:
                close()
                java(FORMAT_LETTERS[pattern[i]])
            elif pattern[i] in WEEK_LETTERS or pattern[i] in "Dw":
                close()
                out.append(("letter", pattern[i]))
            else:
                plain += pattern[i]
        else:
            plain += pattern[i]
        i += 1
    close()
    return out


def java_format(pattern: str) -> str:
    parts = _format_parts(pattern)
    if any(kind == "letter" for kind, _ in parts):
        raise EngineError(ARGUMENTS, f"format {pattern!r}: week numbers and ordinals can't be read back")
    return "".join(text for _, text in parts)


def _literal(text: str, what: str) -> str:
    if not (len(text) >= 2 and text[0] == text[-1] == "'"):
        raise EngineError(ARGUMENTS, f"{what}: the format must be a string literal")
    return text[1:-1].replace("''", "'").replace("\\'", "'")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _stamp(t: str) -> str:
    return f"cast({t} as timestamp)"


def _week(t: str, mode: int) -> tuple[str, str]:
    """(year, week) of a date, as SQL. Bits of the mode: weeks start on Monday; they count from 1, so that days before
    the first week belong to the year before; and, if that differs from the first bit, the first week has four days of
    the year at least, else it starts in it."""
    d = f"cast({t} as date)"
    monday, from_one = bool(mode & 1), bool(mode & 2)
    four = monday != bool(mode & 4)

    def start(jan: str) -> str:  # the first day of week 1, counted from January 1
        w = f"weekday({jan})" if monday else f"(dayofweek({jan}) - 1)"
        return f"(case when {w} <= 3 then - {w} else 7 - {w} end)" if four else f"pmod(7 - {w}, 7)"

    jan = f"trunc({d}, 'YEAR')"
    n = f"(dayofyear({d}) - 1)"
    week = f"cast(floor(({n} - {start(jan)}) / 7.0D) + 1 as int)"
    if not from_one:
        return f"year({d})", week
    before, after = f"add_months({jan}, -12)", f"add_months({jan}, 12)"
    last = f"cast(floor((datediff({jan}, {before}) - 1 - {start(before)}) / 7.0D) + 1 as int)"
    over = f"{n} >= datediff({after}, {jan}) + {start(after)}"
    year = f"(case when {week} = 0 then year({d}) - 1 when {over} then year({d}) + 1 else year({d}) end)"
    return year, f"(case when {week} = 0 then {last} when {over} then 1 else {week} end)"


@_def("date_format")
def _date_format(t, p):
    out = []
    for kind, text in _format_parts(_literal(p, "date_format")):
        if kind == "java":
            out.append(f"date_format({t}, {_quoted(text)})")
        elif text == "w":
            out.append(f"cast(dayofweek({t}) - 1 as string)")
        elif text == "D":
            d = f"day({t})"
            out.append(f"concat({d}, case when {d} between 11 and 13 then 'th' when {d} % 10 = 1 then 'st' when {d} % 10 = 2 then 'nd' when {d} % 10 = 3 then 'rd' else 'th' end)")
        else:
            mode, of_year = WEEK_LETTERS[text]
            out.append(f"lpad(cast({_week(t, mode)[0 if of_year else 1]} as string), {4 if of_year else 2}, '0')")
    if not out:
        return f"if({t} is null, null, '')"
    return out[0] if len(out) == 1 else f"concat({', '.join(out)})"


_def("unix_timestamp")(lambda t="current_timestamp()": f"cast(unix_micros({_stamp(t)}) / 1000000BD as decimal(20, 6))")


@_def("from_unixtime")
def _from_unixtime(n, p=None):
    t = f"timestamp_micros(cast({n} * 1000000 as bigint))"
    return t if p is None else FUNCTIONS["date_format"](t, p)


def _seconds(time: str) -> str:
    """Seconds of a time of day as text (hours, minutes, seconds; a sign before them counts for all)."""
    part = lambda i: f"cast(split_part(ltrim('-', {time}), ':', {i}) as double)"
    return f"(if(startswith({time}, '-'), -1, 1) * ({part(1)} * 3600 + {part(2)} * 60 + {part(3)}))"


def _shifted(t: str, seconds: str) -> str:
    return f"timestamp_micros(unix_micros({_stamp(t)}) + cast(round({seconds} * 1000000) as bigint))"


def _time_of(seconds: str) -> str:
    """A number of seconds as a time of day or span, text of hours, minutes and seconds; hours have two digits or more."""
    s = f"cast(abs({seconds}) as bigint)"
    hours = f"cast({s} div 3600 as string)"
    return f"concat(if({seconds} < 0, '-', ''), lpad({hours}, greatest(2, length({hours})), '0'), ':', lpad(cast({s} div 60 % 60 as string), 2, '0'), ':', lpad(cast({s} % 60 as string), 2, '0'))"


_def("timestamp")(lambda t, time=None: _stamp(t) if time is None else _shifted(t, _seconds(time)))
_def("addtime")(lambda t, time: _shifted(t, _seconds(time)))
_def("subtime")(lambda t, time: _shifted(t, f"- {_seconds(time)}"))
_def("sec_to_time")(_time_of)
_def("time_to_sec")(lambda t: f"cast({_seconds(t)} as bigint)")
_def("maketime")(lambda h, m, s: f"if({m} between 0 and 59 and {s} between 0 and 59, {_time_of(f'({h} * 3600 + {m} * 60 + {s})')}, null)")
_def("timediff")(lambda a, b: _time_of(f"((unix_micros({_stamp(a)}) - unix_micros({_stamp(b)})) div 1000000)"))
_def("time")(lambda t: f"date_format({t}, 'HH:mm:ss')")
_def("curtime", "current_time")(lambda: "date_format(current_timestamp(), 'HH:mm:ss')")
_def("utc_time")(lambda: "date_format(to_utc_timestamp(current_timestamp(), current_timezone()), 'HH:mm:ss')")
_def("utc_date")(lambda: "cast(to_utc_timestamp(current_timestamp(), current_timezone()) as date)")
_def("utc_timestamp")(lambda: "to_utc_timestamp(current_timestamp(), current_timezone())")
_def("now", "sysdate", "current_timestamp", "localtime", "localtimestamp")(lambda: "current_timestamp()")
_def("curdate", "current_date")(lambda: "current_date()")
_def("date")(lambda t: f"cast({t} as date)")
_def("dayname")(lambda t: f"date_format({t}, 'EEEE')")
_def("monthname")(lambda t: f"date_format({t}, 'MMMM')")
_def("dayofweek")(lambda t: f"dayofweek({t})")
_def("dayofyear")(lambda t: f"dayofyear({t})")
_def("weekday")(lambda t: f"weekday({t})")
_def("weekofyear")(lambda t: f"weekofyear({t})")
_def("quarter")(lambda t: f"quarter({t})")
_def("last_day")(lambda t: f"last_day({t})")
_def("datediff")(lambda a, b: f"datediff({a}, {b})")
_def("to_days")(lambda t: f"(datediff({t}, date'1970-01-01') + 719528)")
_def("from_days")(lambda n: f"date_add(date'1970-01-01', cast({n} - 719528 as int))")
_def("to_seconds")(lambda t: f"(unix_micros({_stamp(t)}) div 1000000 + 62167219200)")
_def("makedate")(lambda y, d: f"if({d} < 1, null, date_add(make_date({y}, 1, 1), cast({d} - 1 as int)))")
_def("convert_tz")(lambda t, a, b: f"cast(convert_timezone({a}, {b}, cast({t} as timestamp_ntz)) as timestamp)")
_def("str_to_date")(lambda s, p: f"try_to_timestamp({s}, {_quoted(java_format(_literal(p, 'str_to_date')))})")


def _mode(text: str) -> int:
    if not text.isdigit() or int(text) > 7:
        raise EngineError(ARGUMENTS, f"week: the mode is a number from 0 to 7, not {text}")
    return int(text)


_def("week")(lambda t, mode="0": _week(t, _mode(mode))[1])


@_def("yearweek")
def _yearweek(t, mode="0"):
    year, week = _week(t, _mode(mode) | 2)
    return f"({year} * 100 + {week})"


def _months(p: str) -> str:
    """Months of a period YYYYMM or YYMM, years below 70 being 20YY."""
    y = f"({p} div 100)"
    return f"((case when {y} < 70 then {y} + 2000 when {y} < 100 then {y} + 1900 else {y} end) * 12 + {p} % 100 - 1)"


_def("period_add")(lambda p, n: f"(({_months(p)} + {n}) div 12 * 100 + ({_months(p)} + {n}) % 12 + 1)")
_def("period_diff")(lambda a, b: f"({_months(a)} - {_months(b)})")

# Units of intervals, as months or seconds.
MONTHS = {"month": 1, "quarter": 3, "year": 12}
SECONDS = {"microsecond": 1e-6, "second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def interval(n: str, unit: str) -> str:
    if unit in MONTHS:
        return f"make_ym_interval(0, cast(round({n}) as int) * {MONTHS[unit]})"
    if unit not in SECONDS:
        raise EngineError(ARGUMENTS, f"unknown unit {unit!r}")
    number = n if unit == "second" else f"round({n})"  # only seconds have fractions
    return f"make_dt_interval(0, 0, 0, cast({number} * {SECONDS[unit]:.6f}BD as decimal(18, 6)))"


_def("timestampadd")(lambda unit, n, t: f"({_stamp(t)} + {interval(n, unit.strip('()').lower())})")
_def("timestampdiff")(lambda unit, a, b: f"timestampdiff({unit}, {a}, {b})")


@_def("date_add", "adddate")
def _date_add(t, step):
    return f"({_stamp(t)} + {step if step.startswith('make_') else interval(step, 'day')})"


@_def("date_sub", "subdate")
def _date_sub(t, step):
    return f"({_stamp(t)} - {step if step.startswith('make_') else interval(step, 'day')})"


# -- JSON -------------------------------------------------------------------------------------------------------------
def _at_path(j: str, path: str) -> str:
    return f"try_variant_get(try_parse_json({j}), {path}, 'variant')"


def _json(x: str) -> str:
    """A value as JSON text."""
    return f"regexp_extract(to_json(array({x})), '(?s)^.(.*).$', 1)"


_def("json_extract")(lambda j, path: f"to_json({_at_path(j, path)})")
_def("json_unquote")(lambda j: f"if(startswith({j}, '\"'), try_variant_get(try_parse_json({j}), '$', 'string'), {j})")
_def("json_valid")(lambda j: f"if({j} is null, null, cast(try_parse_json({j}) is not null as int))")
_def("json_quote")(_json)
_def("json_array")(lambda *a: "concat('[', " + ", ',', ".join(_json(x) for x in a) + ("" if not a else ", ") + "']')")
_def("json_length")(lambda j, path="'$'": f"coalesce(json_array_length(to_json({_at_path(j, path)})), size(json_object_keys(to_json({_at_path(j, path)}))), if({_at_path(j, path)} is null, null, 1))")
_def("json_keys")(lambda j: f"to_json(json_object_keys({j}))")


@_def("json_object")
def _json_object(*a):
    if len(a) % 2:
        raise EngineError(ARGUMENTS, "json_object wants keys and values in turn")
    return "to_json(named_struct(" + ", ".join(a) + "), map('ignoreNullFields', 'false'))"


# -- text -------------------------------------------------------------------------------------------------------------
def _bytes(x: str) -> str:
    return f"hex(encode(cast({x} as string), 'UTF-8'))"


_def("ascii")(lambda x: f"case when cast({x} as string) = '' then 0 else cast(conv(left({_bytes(x)}, 2), 16, 10) as int) end")
_def("ord")(lambda x: f"case when cast({x} as string) = '' then 0 else cast(conv({_bytes(f'left(cast({x} as string), 1)')}, 16, 10) as bigint) end")
_def("length", "octet_length")(lambda x: f"octet_length(cast({x} as string))")
_def("elt")(lambda n, *a: f"case cast(round({n}) as bigint) " + " ".join(f"when {i} then {x}" for i, x in enumerate(a, 1)) + " end")
_def("field")(lambda x, *a: "case " + " ".join(f"when {x} = {y} then {i}" for i, y in enumerate(a, 1)) + " else 0 end")
_def("find_in_set")(lambda x, y: f"find_in_set({x}, {y})")


@_def("format")
def _format(x, d, locale=None):
    """Halves away from zero, as in ``round``, before the digits are cut."""
    if d.isdigit():
        return f"format_number(round({x}, {d}), {d})"
    n = f"cast(greatest({d}, 0) as int)"
    return f"format_number(signum({x}) * floor(abs({x}) * pow(10, {n}) + 0.5D) / pow(10, {n}), {n})"


# Bytes that are no UTF-8 stay as they are in the text; what is no number in that base gives NULL.
_def("from_base64")(lambda x: f"cast(try_to_binary(regexp_replace({x}, '[ \\\\t\\\\r\\\\n]', ''), 'base64') as string)")
_def("to_base64")(lambda x: f"regexp_replace(base64(encode(cast({x} as string), 'UTF-8')), '\\\\r\\\\n', '\\n')")
_def("hex", typed=True)(lambda x, kind=None: f"hex({x})")
_def("unhex")(lambda x: f"cast(try_to_binary(case when length({x}) % 2 = 1 then concat('0', {x}) else {x} end, 'hex') as string)")
_def("insert")(lambda s, p, n, r: f"case when {_any_null((s, p, n, r))} then null when {p} < 1 or {p} > char_length({s}) then {s} when {n} < 0 or {p} + {n} > char_length({s}) then concat(left({s}, {p} - 1), {r}) else concat(left({s}, {p} - 1), {r}, substring({s}, {p} + {n})) end")
_def("left")(lambda s, n: f"left({s}, greatest(cast({n} as int), 0))")
_def("right")(lambda s, n: f"right({s}, greatest(cast({n} as int), 0))")


@_def("locate")
def _locate(x, s, p=None):
    if p is None:
        return f"locate({x}, {s})"
    return f"case when {_any_null((x, s, p))} then null when {p} < 1 or {p} > char_length({s}) + 1 then 0 else locate({x}, {s}, {p}) end"


_def("position")(lambda x, s: f"locate({x}, {s})")


def _pad(name):
    def pad(s, n, p):
        return f"case when {n} < 0 or ({p} = '' and {n} > char_length({s})) then null when {n} <= char_length({s}) then left({s}, {n}) else {name}({s}, {n}, {p}) end"

    return pad


_def("lpad")(_pad("lpad"))
_def("rpad")(_pad("rpad"))
_def("make_set")(lambda bits, *a: f"case when {bits} is null then null else concat_ws(',', " + ", ".join(f"if(({bits} & {1 << i}L) <> 0, {x}, null)" for i, x in enumerate(a)) + ") end")


@_def("export_set")
def _export_set(bits, on, off, sep="','", n="64"):
    n = f"if({n} between 0 and 64, cast({n} as int), 64)"
    return f"case when {n} = 0 then '' else array_join(transform(sequence(0, greatest({n}, 1) - 1), i -> if((shiftrightunsigned(cast({bits} as bigint), i) & 1L) = 1, {on}, {off})), {sep}) end"


_def("oct")(lambda x: f"conv(cast({x} as string), 10, 8)")
_def("quote")(lambda x: f"case when {x} is null then 'NULL' else concat('\\'', replace(replace({x}, '\\\\', '\\\\\\\\'), '\\'', '\\\\\\''), '\\'') end")
_def("repeat")(lambda s, n: f"repeat({s}, greatest(cast({n} as int), 0))")
_def("space")(lambda n: f"repeat(' ', greatest(cast({n} as int), 0))")
_def("strcmp")(lambda a, b: f"case when {a} < {b} then -1 when {a} > {b} then 1 when {a} = {b} then 0 end")


@_def("substring", "substr", "mid")
def _substring(s, p, n=None):
    inside = f"{p} <> 0 and abs({p}) <= char_length({s})"
    if n is None:
        return f"case when {_any_null((s, p))} then null when {inside} then substring({s}, {p}) else '' end"
    return f"case when {_any_null((s, p, n))} then null when {inside} and {n} > 0 then substring({s}, {p}, {n}) else '' end"


@_def("trim")
def _trim(s, what=None, side="BOTH"):
    if what is None:
        return {"BOTH": f"trim({s})", "LEADING": f"ltrim({s})", "TRAILING": f"rtrim({s})"}[side]
    w = f"regexp_replace({what}, '([^A-Za-z0-9])', '\\\\\\\\$1')"  # whole copies of the text, not its letters
    head, tail = f"regexp_replace(%s, concat('^(?:', {w}, ')+'), '')", f"regexp_replace(%s, concat('(?:', {w}, ')+$'), '')"
    return {"BOTH": tail % (head % s), "LEADING": head % s, "TRAILING": tail % s}[side]




@_def("char")
def _char(*numbers):
    """Each number's bytes, the highest first; NULL arguments are left out."""
    digits = [f"hex(cast(round({x}) as bigint) & 4294967295)" for x in numbers]
    return "cast(unhex(concat_ws('', " + ", ".join(f"if(length({h}) % 2 = 1, concat('0', {h}), {h})" for h in digits) + ")) as string)"


_def("weight_string")(lambda x, *_: f"encode({x}, 'UTF-8')")
_def("convert")(lambda x, charset=None: f"cast({x} as string)")


@_def("load_file")
def _load_file(*_):
    raise EngineError(ARGUMENTS, "load_file is not available")


# -- operators --------------------------------------------------------------------------------------------------------
UNSIGNED = "case when {0} < 0 then cast({0} as decimal(20, 0)) + 18446744073709551616BD else cast({0} as decimal(20, 0)) end"


def call(name: str, args: list[str], kind=None) -> str | None:
    """SQL text of a call, or None if the dialect has no such function (Spark's own then serves)."""
    f = FUNCTIONS.get(name.lower())
    if f is None:
        return None
    try:
        return "(" + (f(*args, kind=kind) if name.lower() in TYPED else f(*args)) + ")"
    except TypeError:
        raise EngineError(ARGUMENTS, f"{name}: wrong number of arguments ({len(args)})") from None
