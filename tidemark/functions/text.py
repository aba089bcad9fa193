"""Text, keys and numbers written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The text that a missing value has in comparisons as text.
MISSING = "nan"


def to_text(c: Column) -> Column:
    """A cell as text: whole doubles lose nothing but are written as they are; missing values are ``nan``."""
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any script."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c.cast("string")) == "")


def squeezed(c: Column) -> Column:
    """Lower case, with runs of white space as one blank: the form under which spellings of a value are one."""
    return F.regexp_replace(strip(F.lower(c)), r"(?U)\s+", " ")


def key_text(c: Column) -> Column:
    """A key as trimmed text, so that 1, 1.0 and '1' meet; null stays null."""
    number = c.cast("string").try_cast("double")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15) & c.cast("string").rlike(r"^\s*-?\d+\.0+\s*$")
    return F.when(whole, number.cast("bigint").cast("string")).otherwise(F.trim(c.cast("string")))


def as_number(c: Column) -> Column:
    """Number in a cell, null where there is none."""
    return c.cast("string").try_cast("double")


def local_number(c: Column) -> Column:
    """``1.234,5``, ``1234.5`` and ``1234,5``: with both marks, the dot groups thousands and the comma is decimal."""
    t = strip(c)
    both = t.contains(".") & t.contains(",")
    return F.when(both, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit("."))).try_cast("double")


# Spanish number words.
UNITS = ["cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez", "once", "doce", "trece", "catorce", "quince", "dieciseis", "diecisiete", "dieciocho", "diecinueve", "veinte", "veintiuno", "veintidos", "veintitres", "veinticuatro", "veinticinco", "veintiseis", "veintisiete", "veintiocho", "veintinueve"]
TENS = {"treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "setenta": 70, "ochenta": 80, "noventa": 90, "cien": 100}


def number_words() -> dict[str, int]:
    out = {w: k for k, w in enumerate(UNITS)} | TENS
    for ten, n in TENS.items():
        if n < 100:
            out |= {f"{ten} y {UNITS[k]}": n + k for k in range(1, 10)}
    return out


def number_in_text(c: Column) -> Column:
    """Number that a text stands for: digits with a decimal comma or dot, number words up to 100, either with a unit after it."""
    words = F.create_map(*[F.lit(x) for w, n in number_words().items() for x in (w, float(n))])
    t = F.translate(squeezed(c), "áéíóúü", "aeiouu")
    plain = F.replace(t, F.lit(","), F.lit(".")).try_cast("double")
    unit = F.regexp_extract(t, r"^(\d+(?:[.,]\d+)?)\s*[a-zñ%$]+\.?$", 1)
    word_unit = F.regexp_extract(t, r"^(.+?)\s+[a-zñ]+\.?$", 1)
    return F.coalesce(plain, F.try_element_at(words, t), F.when(unit != "", F.replace(unit, F.lit(","), F.lit(".")).try_cast("double")), F.try_element_at(words, word_unit))
