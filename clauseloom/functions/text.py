"""Text expressions as Spark SQL.

Every helper takes and returns SQL expression text, to be used with
``selectExpr`` or ``F.expr``: a long expression is then parsed once in the JVM
instead of being assembled call by call from Python.

Whitespace means Unicode whitespace plus the U+001C..U+001F separators, in
stripping, splitting and matching alike; Spark's plain ``trim`` only knows
U+0020. The characters are listed, not looked up by property, which keeps the
patterns cheap; stripping needs no regex at all.
"""

from __future__ import annotations

# Whitespace as a regex class and as the characters themselves.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NOT_WS = WS.replace("[", "[^", 1)
SPACES = "".join(
    f"\\u{c:04x}"
    for c in [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def quote(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def regex(pattern: str) -> str:
    """SQL raw string literal of a pattern (without single quotes)."""
    return f"r'{pattern}'"


def strip(e: str) -> str:
    """Remove leading and trailing whitespace."""
    return f"btrim({e}, '{SPACES}')"


def has_content(e: str) -> str:
    """True when something other than whitespace is there; cheap to push down."""
    return f"{e} RLIKE {regex(NOT_WS)}"


def squash(e: str) -> str:
    """Collapse every whitespace run to one space and drop the edges."""
    return f"regexp_replace({strip(e)}, {regex(f'{WS}+')}, ' ')"


def match_norm(e: str) -> str:
    """Remove all whitespace; NULL becomes the empty string."""
    return f"coalesce(translate({e}, '{SPACES}', ''), '')"


def snippet(e: str, limit: int = 200) -> str:
    """Squashed text cut to ``limit`` characters with an ellipsis when longer."""
    t = squash(e)
    return f"CASE WHEN length({t}) <= {limit} THEN {t} ELSE concat(left({t}, {limit}), '...') END"


def blank_to_null(e: str) -> str:
    """Stripped text, NULL when nothing is left."""
    return f"nullif({strip(e)}, '')"


def effective_value(reviewed: str, value: str) -> str:
    """The reviewer's value unless absent or empty, else the extracted one."""
    return f"coalesce(nullif({reviewed}, ''), {value})"


def chars(e: str) -> str:
    """The text as an array of code points, in one linear pass."""
    return f"regexp_extract_all({e}, '(?s).', 0)"


def bigrams(e: str) -> str:
    """Distinct character pairs; a single character stands for itself.

    One linear regex pass: each match takes one code point and looks at two.
    """
    return (
        f"CASE WHEN length({e}) >= 2 THEN array_distinct(regexp_extract_all({e}, '(?s)(?=(..)).', 1)) "
        f"WHEN length({e}) = 1 THEN array({e}) ELSE CAST(array() AS ARRAY<STRING>) END"
    )


# On-disk extension per detected file type.
EXTENSIONS = {
    "pdf": ".pdf", "png": ".png", "jpg": ".jpg", "jpeg": ".jpg",
    "gif": ".gif", "bmp": ".bmp", "tiff": ".tiff", "tif": ".tiff",
}


def safe_filename(name: str, file_type: str) -> str:
    """Storage-safe base name with the extension of the detected type."""
    ext = f"coalesce({lookup(file_type, EXTENSIONS)}, '.bin')"
    base = f"regexp_extract(regexp_replace({name}, '/+$', ''), '[^/]*$', 0)"
    kept = f"regexp_replace({base}, {regex(r'[^\p{L}\p{N}\-_.]')}, '')"
    stem = f"coalesce(nullif(regexp_replace({kept}, {regex(r'^\.+')}, ''), ''), 'upload')"
    return f"CASE WHEN endswith(lower({stem}), {ext}) THEN {stem} ELSE concat({stem}, {ext}) END"


def lookup(e: str, table: dict[str, str], default: str | None = None) -> str:
    """Fixed translation table; NULL or ``default`` for anything else."""
    pairs = ", ".join(f"{quote(k)}, {quote(v)}" for k, v in table.items())
    found = f"map({pairs})[{e}]"
    return found if default is None else f"coalesce({found}, {quote(default)})"
