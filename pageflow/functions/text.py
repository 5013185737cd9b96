"""Text expressions; everything stays a JVM-side Column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pageflow.rules import GLYPH_WIDTHS, OTHER_GLYPH_WIDTH, WHITESPACE

_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def strip(col: Column) -> Column:
    """Trim every Unicode space, not only U+0020."""
    return F.btrim(col, F.lit(WHITESPACE))


def word_count(col: Column) -> Column:
    """Number of whitespace-separated words; 0 for blank or null text."""
    stripped = strip(col)
    return F.when(
        F.length(stripped) > 0, F.size(F.split(stripped, _SPACE_RUN))
    ).otherwise(F.lit(0))


def natural_width(col: Column) -> Column:
    """Width of a line of Helvetica at size 1000: the sum of its characters' advances."""
    known = {ord(c): width for width, characters in GLYPH_WIDTHS.items() for c in characters}
    latin = F.array(*[F.lit(known.get(code, OTHER_GLYPH_WIDTH)) for code in range(256)])
    further = F.create_map(*[F.lit(x) for code in sorted(known) if code > 255 for x in (code, known[code])])
    code = lambda c: F.ascii(c)
    width = lambda c: F.when(code(c) < 256, F.get(latin, code(c))).otherwise(F.coalesce(further[code(c)], F.lit(OTHER_GLYPH_WIDTH)))
    return F.aggregate(F.split(col, ""), F.lit(0).cast("long"), lambda total, c: total + F.when(c == "", 0).otherwise(width(c)))


def base_name(col: Column) -> Column:
    """Last path component with either slash, trimmed."""
    return strip(F.regexp_extract(F.translate(F.coalesce(col, F.lit("")), "\\", "/"), r"(?s)([^/]*)\z", 1))


def file_key(col: Column) -> Column:
    """Directory key of a file name: the first 20 hex digits of its SHA-1."""
    return F.substring(F.sha1(col), 1, 20)


def is_pdf(col: Column) -> Column:
    return F.lower(col).endswith(".pdf")


def md_escape(col: Column) -> Column:
    return strip(F.replace(F.replace(col, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def underscored(col: Column) -> Column:
    return F.replace(col, F.lit(" "), F.lit("_"))


def plural(n: Column, word: str) -> Column:
    """``1 file`` / ``1,234 files``."""
    return F.concat(F.format_number(n, 0), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def format_duration(seconds: Column) -> Column:
    """``42s``, ``3m 5s``, ``2h 10m``; null stays null. Halves round up, as in a browser."""
    half_up = lambda c: F.floor(c + F.lit(0.5)).cast("long")
    mins = F.floor(seconds / 60).cast("long")
    secs = half_up(seconds - mins * 60)
    return (
        F.when(seconds < 60, F.concat(F.greatest(half_up(seconds), F.lit(1)).cast("string"), F.lit("s")))
        .when(
            mins < 60,
            F.concat(
                mins.cast("string"),
                F.lit("m"),
                F.when(secs != 0, F.concat(F.lit(" "), secs.cast("string"), F.lit("s"))).otherwise(""),
            ),
        )
        .when(
            seconds.isNotNull(),
            F.concat(
                F.floor(mins / 60).cast("string"), F.lit("h "), F.pmod(mins, F.lit(60)).cast("string"), F.lit("m")
            ),
        )
    )


def format_bytes(size: Column) -> Column:
    """``512 B``, ``1.5 KB``, ``200 MB``: one decimal below 100, none from 100 on."""
    kb, mb, gb = size / 1024.0, size / float(1024**2), size / float(1024**3)

    def shown(value: Column, unit: str) -> Column:
        # format_string rounds the exact binary value half up.
        return F.when(value >= 100, F.format_string("%.0f " + unit, value)).otherwise(
            F.format_string("%.1f " + unit, value)
        )

    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(kb < 1024, shown(kb, "KB"))
        .when(mb < 1024, shown(mb, "MB"))
        .otherwise(shown(gb, "GB"))
    )
