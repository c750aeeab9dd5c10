"""Date reading and date parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskveil.functions.names import ref

ISO = "iso"
_CLOCK = "[ H:mm[:ss]]"

#: The spellings of a date that are tried, the earlier first. ``ISO`` is what a cast
#: to a timestamp reads; the others are Spark datetime patterns.
FORMATS = (
    ISO,
    f"M/d/yyyy{_CLOCK}",
    f"d/M/yyyy{_CLOCK}",
    f"yyyy/M/d{_CLOCK}",
    f"d.M.yyyy{_CLOCK}",
    f"M-d-yyyy{_CLOCK}",
    f"d-M-yyyy{_CLOCK}",
    "M/d/yyyy h:mm[:ss] a",
    "d/M/yyyy h:mm[:ss] a",
    f"d MMM yyyy{_CLOCK}",
    f"MMM d, yyyy{_CLOCK}",
    f"d MMMM yyyy{_CLOCK}",
    f"MMMM d, yyyy{_CLOCK}",
)


def as_moment(value: Column, data_type: T.DataType, spelling: str = ISO) -> Column:
    """Timestamp without zone; text that does not spell a date that way becomes null."""
    if not isinstance(data_type, T.StringType):
        return value.cast("timestamp_ntz")
    text = F.trim(value)
    if spelling == ISO:
        return text.try_cast("timestamp_ntz")
    # the shape is looked at first: most cells fail that cheaply
    month = r"[A-Za-z]{3,}" if "MMM" in spelling else r"[0-9]{1,2}"
    shape = {"d": r"[0-9]{1,2}", "M": month, "y": r"[0-9]{4}"}
    day = spelling.split("[")[0].split(" h")[0]
    pattern, last = "", ""
    for c in day:
        if c != last:
            pattern += shape.get(c, "[.]" if c == "." else c)
        last = c
    return F.when(text.rlike(rf"\A{pattern}(?: .*)?\z"), F.try_to_timestamp(text, F.lit(spelling))).cast(
        "timestamp_ntz"
    )


def spellings(
    df: DataFrame, names: Sequence[str], formats: Sequence[str] = FORMATS
) -> dict[str, tuple[str, int, int]]:
    """For each text column the format that reads most of its values (the earlier
    of equal ones), how many it reads, and how many are known. One aggregate."""
    if not names:
        return {}
    checks = []
    for i, name in enumerate(names):
        checks.append(F.count(ref(name)).alias(f"n{i}"))
        checks += [
            F.count(as_moment(ref(name), T.StringType(), f)).alias(f"f{i}_{j}")
            for j, f in enumerate(formats)
        ]
    seen = df.agg(*checks).first()
    best = {}
    for i, name in enumerate(names):
        reads = [seen[f"f{i}_{j}"] for j in range(len(formats))]
        best[name] = (formats[reads.index(max(reads))], max(reads), seen[f"n{i}"])
    return best


def ordinal(moment: Column) -> Column:
    """Days counted from 0001-01-01 as day 1."""
    return F.datediff(moment, F.lit("0001-01-01").cast("date")) + 1


def date_parts(name: str, moment: Column) -> dict[str, Column]:
    return {
        f"{name}_year": F.year(moment),
        f"{name}_month": F.month(moment),
        f"{name}_day": F.dayofmonth(moment),
    }
