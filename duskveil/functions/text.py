"""Text expressions used by the masks and by the chart data.

Every function takes and returns a ``Column`` and stays inside the JVM.
Null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAR = "*"
SUPPRESSED = "***"

# Share of characters hidden per sensitivity level, in percent.
LEVELS = {"light": 25, "medium": 50, "heavy": 75, "sensitive": 100}

# A decimal literal as a user types it: sign, digits with optional
# underscores between them, fraction, exponent, blanks around.
NUMBER_TEXT = (
    r"\A\s*[+-]?(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)"
    r"(?:[eE][+-]?\d(?:_?\d)*)?\s*\z"
)

def chars(text: Column) -> Column:
    """Characters of a text as an array; the empty text gives an empty array."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(
        F.split(text, "")
    )


def fold(char: Column) -> Column:
    """Case folding of one character (upper then lower also joins ß/SS and ſ/s).

    The empty concat keeps Catalyst from reducing lower(upper(x)) to lower(x).
    """
    return F.when(char == "ı", char).otherwise(F.lower(F.concat(F.upper(char), F.lit(""))))


def fold_text(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, ""), fold), "")


def stars(count: Column) -> Column:
    return F.repeat(F.lit(STAR), count.cast("int"))


def hide_tail(text: Column, count: Column) -> Column:
    """Replace the last ``count`` characters by stars; the whole text if shorter."""
    hidden = F.greatest(F.least(F.length(text), count), F.lit(0))
    return F.concat(F.left(text, F.length(text) - hidden), stars(hidden))


def hide_share(text: Column, percent: int) -> Column:
    """Hide a percentage from the right, at least one character, half to even."""
    size = F.length(text)
    if percent >= 100:
        return F.when(text.isNotNull(), stars(size))
    hidden = F.greatest(F.bround(size * F.lit(percent) / 100.0).cast("int"), F.lit(1))
    return F.concat(F.left(text, F.greatest(size - hidden, F.lit(0))), stars(hidden))


def hide_tail_per_word(text: Column, count: int) -> Column:
    words = F.split(text, " ", -1)
    return F.array_join(F.transform(words, lambda w: hide_tail(w, F.lit(count))), " ")


def suppress(value: Column) -> Column:
    return F.when(value.isNotNull(), F.lit(SUPPRESSED))


def comparable(text: Column) -> Column:
    """Same length as the text: letters, digits and stars stay, the rest is blank."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}*]", " ")


def plain_text(value: Column, data_type: T.DataType) -> Column:
    """Cast to text; doubles keep positional digits from 1e-4 up to 1e16."""
    text = value.cast("string")
    if not isinstance(data_type, (T.DoubleType, T.FloatType)):
        return text
    size = F.abs(value)
    positional = F.regexp_replace(
        F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), r"0+\z", ""),
        r"\.\z",
        ".0",
    )
    scientific = text.contains("E") & (size >= 1e-4) & (size < 1e16)
    return F.when(scientific, positional).otherwise(text)


def spelled_number(text: Column) -> Column:
    """The number a text spells (infinite if out of range), else null."""
    clean = F.regexp_replace(text, r"[\s_]", "")
    return F.when(text.rlike(NUMBER_TEXT), clean.try_cast("double"))


def finite(number: Column) -> Column:
    return F.when(F.abs(number) < float("inf"), number)


def number_in(text: Column) -> Column:
    """The finite number a text spells, else null."""
    return finite(spelled_number(text))


def chart_number(value: Column, data_type: T.DataType) -> Column:
    """Number behind a cell for plotting; ranges give their midpoint.

    A cell is a number with a decimal point or comma, or two such numbers with a
    dash, an en dash or the word "to" between them. It is split where such a
    separator follows a digit; one or two pieces that read as plain numbers count.
    """
    if isinstance(data_type, T.NumericType):
        return finite(value.cast("double"))
    if not isinstance(data_type, T.StringType):
        return F.lit(None).cast("double")
    cell = F.regexp_replace(value, r"\A\s+|\s+\z", "")
    pieces = F.split(cell, r"(?i)(?<=[0-9])\s*(?:[-–]|\sto\s)\s*", 3)
    numbers = F.transform(
        pieces,
        lambda p: F.when(
            p.rlike(r"\A-?[0-9]+(?:[.,][0-9]+)?\z"), F.replace(p, F.lit(","), F.lit("."))
        ).try_cast("double"),
    )
    low, high = F.get(numbers, F.lit(0)), F.get(numbers, F.size(numbers) - 1)
    size = F.size(numbers)
    return finite(F.when(size == 1, low).when(size == 2, (low + high) / 2))
