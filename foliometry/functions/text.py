"""Names, numbers and cells as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token patterns of region and line names, free of lookaround.
WORD = r"(^|[^\p{{L}}\p{{Nd}}]){}($|[^\p{{L}}\p{{Nd}}])"
FISSURE = r"fissure|(^|[^\p{L}\p{Nd}])fl($|[^\p{L}])"
GRANULAR = r"granular|gl\+wm|glwm|gl_wm|gl-wm|gl wm"
#: A token of two letters with no letter before it; for Spark only. Digits may precede, as those that a name begins with are left out.
TOKEN_BEGINS = r"[fpgwc][lmb](?<!\p{L}..)"
OUTPUT_NAME = r"(?i)^(\[\d+\] .*|(\d+(/\d+)?Cb|Section \d+)_(Granular|Molecular|Purkinje))$"
STANDARD_LABELS = ("2Cb", "3Cb", "4/5Cb", "6Cb", "7Cb", "8Cb", "9Cb", "10Cb")
DEFAULT_FILE = "Output"


def word(token: str) -> str:
    return WORD.format(token)


def fixed4(x: Column) -> Column:
    """Four decimals, halves away from zero; null if not finite."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.format_string("%.4f", x))


def short_number(x: Column) -> Column:
    """Six decimals without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), "0+$", ""), r"\.$", "")


def csv_cell(x: Column) -> Column:
    """Quoted if it holds a comma, quote or line end; null is empty."""
    quoted = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(x.isNull(), F.lit("")).when(x.rlike('[,"\n\r]'), quoted).otherwise(x)


def file_base(requested: Column) -> Column:
    """A typed name as the base of result files."""
    base = F.trim(F.coalesce(requested, F.lit("")), F.lit("".join(map(chr, range(33)))))
    base = F.regexp_replace(base, r"(?i)\.(csv|xlsx)$", "")
    base = F.regexp_replace(base, r'[\\/:*?"<>|\x00-\x1f\x7f]', "_")
    base = F.regexp_replace(base, r"^[.\s]+|[.\s]+$", "")
    return F.when(base == "", F.lit(DEFAULT_FILE)).otherwise(base)


def section_labels(count: Column, number: Column, joined: Column) -> Column:
    """Standard names for exactly eight unjoined sections, else ``Section n``; number from 1."""
    standard = F.array(*map(F.lit, STANDARD_LABELS))
    return F.when((count == len(STANDARD_LABELS)) & ~joined, F.get(standard, (number - 1).cast("int"))).otherwise(F.concat(F.lit("Section "), number.cast("string")))


def area_unit(unit: Column) -> Column:
    return F.concat(F.coalesce(unit, F.lit("pixel")), F.lit("²"))


def length_unit(unit: Column) -> Column:
    return F.coalesce(unit, F.lit("pixel"))
