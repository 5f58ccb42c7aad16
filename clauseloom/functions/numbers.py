"""Numbers and dates that arrive as text (SQL expression text in and out)."""

from __future__ import annotations

from clauseloom.functions.text import chars, regex, strip

_NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"

# Formal Chinese numerals and their unit multipliers.
DIGITS = {"零": 0, "壹": 1, "贰": 2, "叁": 3, "肆": 4, "伍": 5, "陆": 6, "柒": 7, "捌": 8, "玖": 9}
SMALL_UNITS = {"拾": 10, "佰": 100, "仟": 1000}
BIG_UNITS = {"万": 10000, "亿": 100000000}


def ascii_digits(e: str) -> str:
    return f"translate({e}, '０１２３４５６７８９', '0123456789')"


def text_to_double(e: str) -> str:
    """Lenient decimal parsing: edges stripped, ``1_000``, full-width digits, inf and nan.

    The guard keeps Spark-only spellings such as ``1d`` out.
    """
    t = ascii_digits(strip(e))
    return (
        f"CASE WHEN {t} RLIKE {regex(_NUMBER)} THEN try_cast(replace({t}, '_', '') AS DOUBLE) "
        f"WHEN {t} RLIKE '(?i)^[+-]?nan$' THEN double('NaN') "
        f"WHEN {t} RLIKE '(?i)^[+]?inf(inity)?$' THEN double('Infinity') "
        f"WHEN {t} RLIKE '(?i)^-inf(inity)?$' THEN double('-Infinity') END"
    )


def double_to_text(e: str) -> str:
    """Shortest decimal text with at least one fraction digit, e.g. ``30.0``.

    Plain notation is kept between 1e-4 and 1e16, unlike Spark's own cast
    which turns to exponents at 1e7 and 1e-3.
    """
    text = f"CAST({e} AS STRING)"
    plain = (
        f"regexp_replace(regexp_replace(CAST(try_cast({text} AS DECIMAL(38,21)) AS STRING), '0+$', ''), "
        f"{regex(r'[.]$')}, '.0')"
    )
    exponent = f"replace({text}, '.0E', 'E')"
    exponent = f"regexp_replace({exponent}, {regex(r'E(\d)')}, 'E+$1')"
    exponent = f"regexp_replace({exponent}, {regex(r'E([+-])(\d)$')}, 'E$10$2')"
    return (
        f"CASE WHEN isnan({e}) THEN 'nan' WHEN {e} = double('Infinity') THEN 'inf' "
        f"WHEN {e} = double('-Infinity') THEN '-inf' "
        f"WHEN {e} = 0 OR (abs({e}) >= 1e-3 AND abs({e}) < 1e7) THEN {text} "
        f"WHEN abs({e}) >= 1e-4 AND abs({e}) < 1e16 THEN {plain} ELSE lower({exponent}) END"
    )


def norm_date(e: str, strict: bool = False) -> str:
    """Comparable text of a date, NULL when the form is not recognised.

    ISO-like text is returned as written, without padding, so comparison
    follows the text; a ``Y年M月D日`` prefix is padded. ``strict`` pads and
    checks both forms as calendar dates.
    """
    t = strip(e)
    cn = regex(r"(?U)^(\d{4})年(\d{1,2})月(\d{1,2})")
    pad = lambda i: f"lpad({ascii_digits(f'regexp_extract({t}, {cn}, {i})')}, 2, '0')"
    loose = (
        f"CASE WHEN {t} RLIKE {regex(r'(?U)^\d{4}-\d{1,2}-\d{1,2}$')} THEN {t} "
        f"WHEN {t} RLIKE {cn} THEN concat_ws('-', regexp_extract({t}, {cn}, 1), {pad(2)}, {pad(3)}) END"
    )
    if not strict:
        return loose
    part = lambda i: f"lpad(split_part({ascii_digits(loose)}, '-', {i}), 2, '0')"
    whole = f"concat_ws('-', split_part({ascii_digits(loose)}, '-', 1), {part(2)}, {part(3)})"
    return f"CASE WHEN ({loose}) IS NOT NULL THEN date_format(try_to_date({whole}, 'yyyy-MM-dd'), 'yyyy-MM-dd') END"


def formal_amount(e: str) -> str:
    """Value of an amount in formal Chinese numerals.

    Units inside a section multiply the digit before them (one when absent);
    万 and 亿 close a section (an empty one counts as one). Characters that
    are neither digit nor unit are skipped. NULL for nothing to read.
    """
    t = f"regexp_replace(regexp_replace({e}, '[，、 ]', ''), '[元整圆]+$', '')"
    table = {**DIGITS, **SMALL_UNITS, **BIG_UNITS}
    values = "map(" + ", ".join(f"'{k}', {v}D" for k, v in table.items()) + ")"
    state = lambda a, b, c: f"named_struct('total', {a}, 'section', {b}, 'digit', {c})"
    known = f"filter(transform({chars(t)}, ch -> {values}[ch]), v -> v IS NOT NULL)"
    closed = "CASE WHEN s.section + s.digit = 0 THEN 1D ELSE s.section + s.digit END"
    implied = "CASE WHEN s.digit = 0 THEN 1D ELSE s.digit END"
    step = (
        f"CASE WHEN v >= 10000 THEN {state(f's.total + ({closed}) * v', '0D', '0D')} "
        f"WHEN v >= 10 THEN {state('s.total', f's.section + ({implied}) * v', '0D')} "
        f"ELSE {state('s.total', 's.section', 'v')} END"
    )
    return (
        f"CASE WHEN length({t}) > 0 THEN aggregate({known}, {state('0D', '0D', '0D')}, "
        f"(s, v) -> {step}, s -> s.total + s.section + s.digit) END"
    )
