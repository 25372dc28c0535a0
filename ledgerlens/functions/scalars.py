"""Scalar expressions with one rounding rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(x: Column, digits: int) -> Column:
    """Half-even rounding after scaling in binary."""
    return F.rint(x * F.lit(float(10**digits))) / F.lit(float(10**digits))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is not positive."""
    return F.when(b > 0, a / b)


def ramp(x: Column, lo: float, hi: float) -> Column:
    """Share of the way from lo to hi, within 0..1."""
    return F.lit(1.0) if hi <= lo else F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - lo) / F.lit(float(hi - lo))))


def score(*strengths: Column) -> Column:
    total = strengths[0]
    for s in strengths[1:]:
        total = total + s
    return rnd(F.lit(0.5) + F.lit(0.5) * (total / F.lit(float(len(strengths)))), 3)


def number(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", rnd(x, digits))


def money(x: Column) -> Column:
    """Millions with two decimals, else thousands."""
    return F.when(F.abs(x) >= 1e6, F.concat(F.translate(number(x / 1e6, 2), ".", ","), F.lit(" млн ₸"))).otherwise(F.concat(number(x / 1e3, 0), F.lit(" тыс ₸")))


def percent(x: Column) -> Column:
    return F.concat(number(x * 100, 0), F.lit("%"))


def times(x: Column) -> Column:
    return F.concat(F.translate(number(x, 1), ".", ","), F.lit("×"))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """Russian noun form for a count."""
    tens, units = F.pmod(n, F.lit(100)), F.pmod(n, F.lit(10))
    return F.when((units == 1) & (tens != 11), one).when(units.between(2, 4) & ~tens.between(12, 14), few).otherwise(many)


def counted(n: Column, one: str, few: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), plural(n, one, few, many))


def clip_text(text: Column, most: int = 200) -> Column:
    """Whole parts, split at "; ", as long as they fit; else a hard cut with an ellipsis."""
    part = F.aggregate(
        F.split(text, "; "),
        F.struct(F.lit("").alias("text"), F.lit(False).alias("full")),
        lambda acc, s: F.when(
            acc["full"] | (F.length(acc["text"]) + F.when(acc["text"] == "", 0).otherwise(2) + F.length(s) > most), F.struct(acc["text"].alias("text"), F.lit(True).alias("full"))
        ).otherwise(F.struct(F.when(acc["text"] == "", s).otherwise(F.concat(acc["text"], F.lit("; "), s)).alias("text"), F.lit(False).alias("full"))),
        lambda acc: acc["text"],
    )
    return F.when(F.length(text) <= most, text).otherwise(F.when(part != "", part).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…"))))


def short_id(gid: Column) -> Column:
    return F.concat(F.lit("…"), F.right(gid.cast("string"), F.lit(10)))
