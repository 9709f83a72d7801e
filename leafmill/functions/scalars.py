"""Scalar expressions used by the operators; all are native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roman digits of each decimal place (fixed values).
ROMAN = (
    ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"),
    ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"),
    ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"),
)
#: Colours by name: red, green and blue from 0 to 1 (fixed values).
COLOURS = {"black": (0, 0, 0), "white": (1, 1, 1), "red": (1, 0, 0), "green": (0, 0.5, 0), "blue": (0, 0, 1), "yellow": (1, 1, 0), "orange": (1, 0.5, 0), "purple": (0.5, 0, 0.5), "gray": (0.5, 0.5, 0.5), "grey": (0.5, 0.5, 0.5)}
#: What a file name may not hold (fixed values).
CLIMBING = ("..", "~", "./", "//", "\\", "\0")


def to_roman(n: Column) -> Column:
    """Roman numeral; empty for numbers below 1."""
    digits = [F.element_at(F.array(*map(F.lit, row)), (F.floor(F.pmod(n, F.lit(10 * unit)) / unit) + 1).cast("int")) for row, unit in zip(ROMAN, (100, 10, 1), strict=True)]
    return F.when(n > 0, F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), *digits)).otherwise(F.lit(""))


def to_letter(n: Column) -> Column:
    """A to Z, then A again."""
    return F.char((F.lit(65) + F.pmod(n - 1, F.lit(26))).cast("long"))


def number_label(n: Column, style: str) -> Column:
    """A page number in a style: arabic, roman, roman_lower, letter or letter_lower."""
    styles = {"arabic": lambda: n.cast("string"), "roman": lambda: to_roman(n), "roman_lower": lambda: F.lower(to_roman(n)), "letter": lambda: to_letter(n), "letter_lower": lambda: F.lower(to_letter(n))}
    if style not in styles:
        raise ValueError(f"unknown number format: {style}")
    return styles[style]()


def decode_flags(flags: Column, italic_bit: int = 64) -> list[Column]:
    """is_bold, is_italic, is_serif and is_mono of a font's bit flags."""
    return [(flags.bitwiseAND(F.lit(bit)) > 0).alias(name) for name, bit in (("is_bold", 16), ("is_italic", italic_bit), ("is_serif", 1), ("is_mono", 8))]


def hex_to_rgb(text: Column, named: bool = False) -> Column:
    """r, g, b from 0 to 1 of six hex digits, else null; named: of a colour's name, or of three or six digits after #, else black."""
    digits = F.lower(F.regexp_replace(F.trim(text), "^#", ""))
    if named:
        name = F.replace(F.lower(text), F.lit(" "), F.lit(""))
        digits = F.when(text.startswith("#"), F.lower(F.substring(text, 2, 100)))
        three = F.concat(*[F.repeat(F.substring(digits, i, 1), F.lit(2)) for i in (1, 2, 3)])
        digits = F.when(F.length(digits) == 3, three).otherwise(digits)
    good = F.rlike(digits, F.lit("^[0-9a-f]{6}$"))
    part = lambda i: F.conv(F.substring(digits, i, 2), 16, 10).cast("double") / 255
    rgb = F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))
    if not named:
        return F.when(good, rgb)
    value = lambda v: F.struct(*[F.lit(float(x)).alias(c) for c, x in zip("rgb", v, strict=True)])
    table = F.create_map(*[x for k, v in COLOURS.items() for x in (F.lit(k), value(v))])
    return F.coalesce(F.try_element_at(table, name), F.when(good, rgb), value((0, 0, 0)))


def safe_filename(name: Column, session: Column) -> Column:
    """<session>_<base name>.pdf, or null for empty or path-climbing names and base names of over 255 characters; any other extension goes."""
    base = F.regexp_extract(name, r"([^/]*)/?$", 1)
    bad = name.isNull() | (name == "") | (F.length(base) > 255)
    for part in CLIMBING:
        bad = bad | name.contains(part)
    return F.when(~bad, F.concat(session, F.lit("_"), F.regexp_replace(base, r"(?s)\.[^.]*$", ""), F.lit(".pdf")))


def parse_rect(text: Column) -> Column:
    """x0, y0, x1, y1 of four comma-separated numbers with x1 > x0 and y1 > y0, else null."""
    v = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    good = (F.size(v) == 4) & ~F.exists(v, lambda x: x.isNull()) & (F.get(v, F.lit(2)) > F.get(v, F.lit(0))) & (F.get(v, F.lit(3)) > F.get(v, F.lit(1)))
    return F.when(good, F.struct(*[F.get(v, F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]))


def cell_text(text: Column, limit: int = 20) -> Column:
    """The first limit characters and dots, of longer texts."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def heading_level(size: Column, thresholds: tuple[float, float, float] = (18, 14, 12)) -> Column:
    """1, 2 or 3 for sizes that reach a threshold, else null."""
    a, b, c = thresholds
    return F.when(size >= a, 1).when(size >= b, 2).when(size >= c, 3)


def markdown_mark(size: Column) -> Column:
    return F.when(size > 18, F.lit("# ")).when(size > 16, F.lit("## ")).when(size > 14, F.lit("### ")).otherwise(F.lit(""))
