"""Closed genomic intervals as ``STRUCT<chrom STRING, left BIGINT, right BIGINT>`` and text loci."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels of the two strands.
PLUS = ["+", "1", "f", "F"]
MINUS = ["-", "-1", "0", "r", "R"]
#: Characters that count as blanks inside a locus text.
BLANKS = " \t\r\n\v\f" + chr(0xA0)
def loc(chrom: Column, left: Column, right: Column) -> Column:
    return F.struct(chrom.alias("chrom"), left.cast("bigint").alias("left"), right.cast("bigint").alias("right"))


def normal_chrom(text: Column) -> Column:
    """``chr`` + upper-case rest, without blanks; null for null, blank and bare ``chr``."""
    bare = F.regexp_replace(F.lower(F.translate(text, BLANKS, "")), "^chr", "")
    return F.when(F.length(bare) > 0, F.concat(F.lit("chr"), F.upper(bare)))


def with_locus(df: DataFrame, text: str, chrom: str = "chrom", left: str = "left", right: str = "right") -> DataFrame:
    """Add the columns of the locus ``chrom:left-right`` in ``text``; case, blanks and thousands commas don't matter.

    The prefix ``chr`` is optional. Columns of these names are replaced. All three are null for null and for text that is no locus (other
    shape, no chromosome, left > right, more than 18 digits). The parts are made once per row: the
    generator keeps the optimizer from copying the parsing into every use of its result.
    """
    bare = F.lower(F.regexp_replace(F.col(text), f"[\\s,{chr(0xA0)}]+", ""))
    name, lo, hi = (F.get("_parts", F.lit(i)) for i in range(3))
    name = F.when(name.startswith("chr"), F.substring(name, 4, 1 << 30)).otherwise(name)

    def number(part: Column) -> Column:
        return F.when((F.length(part) <= 18) & F.substring(part, 1, 1).between("0", "9"), part.try_cast("bigint"))

    whole = (F.size("_parts") == 3) & (F.length(name) > 0) & (number(lo) <= number(hi))
    parsed = F.when(whole, F.struct(F.concat(F.lit("chr"), F.upper(name)), number(lo), number(hi)))
    split = df.withColumn("_parts", F.split(bare, ":|-(?=[0-9]+$)")).drop(*[c for c in (chrom, left, right) if c != "_parts"])
    return split.select("*", F.inline(F.array(parsed)).alias(chrom, left, right)).drop("_parts")


def overlaps(a: Column, b: Column, slack: int = 0) -> Column:
    """Closed/closed overlap on the same chromosome, each side widened by ``slack``."""
    return (a["chrom"] == b["chrom"]) & (a["right"] + slack >= b["left"] - slack) & (a["left"] - slack <= b["right"] + slack)


def midpoint(a: Column) -> Column:
    return F.shiftright(a["left"] + a["right"], 1)


def length(a: Column) -> Column:
    """Length as right - left, never below 0."""
    return F.greatest(F.lit(0).cast("bigint"), a["right"] - a["left"])


def distance(a: Column, b: Column) -> Column:
    """Signed distance of the midpoints, a - b."""
    return midpoint(a) - midpoint(b)


def pointify(a: Column) -> Column:
    return loc(a["chrom"], midpoint(a), midpoint(a))


def point_left(a: Column) -> Column:
    return loc(a["chrom"], a["left"], a["left"])


def point_right(a: Column) -> Column:
    return loc(a["chrom"], a["right"], a["right"])


def expand(a: Column, bases: int, side: str = "both") -> Column:
    """Widen by ``bases`` on ``both`` sides, ``left`` or ``right``; no clamp at 0."""
    if side not in ("both", "left", "right"):
        raise ValueError(f"side must be both, left or right, not {side!r}")
    return loc(
        a["chrom"],
        a["left"] - (bases if side != "right" else 0),
        a["right"] + (bases if side != "left" else 0),
    )


def shrink(a: Column, bases: int, side: str = "both") -> Column:
    return expand(a, -bases, side)


def to_text(a: Column) -> Column:
    return F.concat(a["chrom"], F.lit(":"), a["left"].cast("string"), F.lit("-"), a["right"].cast("string"))


def tss(a: Column, strand: Column, end: bool = False) -> Column:
    """Start point by strand (the end point if ``end``); the midpoint for an unknown strand."""
    plus, minus = strand.isin(*PLUS), strand.isin(*MINUS)
    first, last = (point_right(a), point_left(a)) if end else (point_left(a), point_right(a))
    return F.when(plus, first).when(minus, last).otherwise(pointify(a))
