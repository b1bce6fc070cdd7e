"""Amounts as printed in French and Moroccan filings.

An amount is read by patterns, each on the result of the one before: the text without currency marks, whether it is an
amount, its sign, and its digits, whose last comma or dot may be decimal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AMOUNT = "decimal(20,4)"
# What a cell without an amount holds, and currency marks.
EMPTY = ["", "-", "−", "–", "—", "n/a", "N/A", "null", "None"]
CURRENCY = r"MAD|Dh|DH|€|\*"
DIGITS, BLANKS, SIGNS = "0123456789", " \t\n\r\u00a0\u202f", "-−–"  # the plain sign first, as classes of patterns need it
#: Largest amount that is taken for one.
MOST = 10**12


def bind(value: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` of a value that is computed once however often the step names it."""
    return F.get(F.transform(F.array(value), step), F.lit(0))


def apart(column: str) -> Column:
    """A column as it is, through a lambda, for projections of many long rules.

    Spark puts a plain projection and its neighbours into one method, which the JVM never compiles if it is longer than 8,000 bytes; one that
    holds a lambda is generated on its own, in short methods.
    """
    return bind(F.col(column), lambda x: x).alias(column)


def only(text: Column, kept: str) -> Column:
    """The characters of ``text`` that are among ``kept``."""
    return F.call_function("translate", text, F.translate(text, kept, ""), F.lit(""))


# An amount in a bracket and between signs, if any: groups of three after blanks or dots or digits alone, and up to four decimals after a comma or dot.
PRINTED = rf"\A\(?[{SIGNS}]?(?:\d+|\d{{1,3}}(?:[{BLANKS}.]\d{{3}})+)(?:[.,]\d{{1,4}})?[{SIGNS}]?\)?\z"
# A lone dot that is decimal: not before exactly three digits after three at most.
LONE_DOT = r"\A(?!\d{1,3}\.\d{3}\z)(\d+)\.(\d+)\z"
# A number up to MOST, which is the last that may have thirteen digits.
IN_BOUNDS = r"\A-?0*(?:\d{1,12}(?:\.\d*)?|10{12}(?:\.0*)?)\z"


def parse_amount(raw: Column) -> Column:
    """DECIMAL(20,4), or null for empty cells, dashes and other text; parentheses and signs on either side are negative.

    Of comma and dot the later is decimal; a lone comma is; a lone dot before exactly three digits, after three at
    most, and several dots part thousands. Text around the amount is tried without anything but digits, marks and
    signs. Amounts beyond 1e12 are null. One chain of searches and replacements, each on the result of the one
    before, so that all of it is generated code.
    """
    return unmarked_amount(unmarked(raw))


def unmarked(raw: Column) -> Column:
    """Without currency marks, trimmed: the first step of ``parse_amount``, for callers that keep it as a column, since the others read it four times."""
    return F.trim(F.regexp_replace(raw, CURRENCY, ""))


def unmarked_amount(text: Column) -> Column:
    """``parse_amount`` of a text without currency marks."""
    fits = text.rlike(PRINTED) | F.regexp_replace(text, rf"[^{SIGNS}0-9,.()]+", "").rlike(PRINTED)
    sign = F.when(text.rlike(rf"[{SIGNS}(]"), "-").otherwise("")
    # what fits has one comma at most, behind all dots; a decimal dot becomes one, and then dots go
    number = F.translate(F.regexp_replace(F.regexp_replace(text, "[^0-9,.]+", ""), LONE_DOT, "$1,$2"), ",.", ".")
    return F.regexp_extract(F.when(fits, F.concat(sign, number)), IN_BOUNDS, 0).try_cast(AMOUNT)


def parse_ocr_amount(raw: Column) -> Column:
    """``parse_amount`` without any blanks; commas between groups of three with two decimals after the last are tried next."""
    text = F.translate(raw, BLANKS, "")
    return F.coalesce(parse_amount(text), _mixed_amount(text))


def _mixed_amount(text: Column) -> Column:
    """The amount of a text without blanks whose commas part both thousands and decimals."""
    mixed = F.when(text.rlike(MIXED), F.concat(F.replace(F.left(text, F.length(text) - 3), F.lit(","), F.lit("")), F.lit("."), F.right(text, F.lit(2))))
    return mixed.try_cast(AMOUNT)


def with_ocr_amount(df: DataFrame, raw: str, name: str) -> DataFrame:
    """``df`` with ``parse_ocr_amount`` of a column; the texts that its rules read several times are columns on the way, so that each is made once."""
    out = df.withColumn("_text", F.translate(raw, BLANKS, "")).withColumn("_bare", unmarked(F.col("_text")))
    return out.withColumn(name, F.coalesce(unmarked_amount(F.col("_bare")), _mixed_amount(F.col("_text")))).drop("_text", "_bare")


#: Commas between groups of three, and before two decimals.
MIXED = r"^-?\d{1,3}(,\d{3})+,\d{2}$"


def is_mixed_comma(raw: Column) -> Column:
    """Whether commas part both thousands and decimals."""
    return F.coalesce(F.translate(raw, BLANKS, "").rlike(MIXED), F.lit(False))


def is_explicit_zero(raw: Column, parsed: Column | None = None) -> Column:
    """A displayed zero, which is not an empty cell; ``parsed`` is the amount where it is known already."""
    return F.coalesce((parse_ocr_amount(raw) if parsed is None else parsed) == 0, F.lit(False))


def legacy_amount(raw: Column) -> Column:
    """Blanks between thousands and a decimal comma, without further checks; null if that gives no number."""
    return F.translate(raw, ",−" + BLANKS, ".-").try_cast(AMOUNT)


def sum_present(*values: Column) -> Column:
    """Sum of the values that are not null; null if all are."""
    present = F.filter(F.array(*values), lambda x: x.isNotNull())
    return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0).cast("decimal(24,4)"), lambda a, x: (a + x).cast("decimal(24,4)")))


def safe_divide(top: Column, base: Column) -> Column:
    """Null if either is null or the base is 0."""
    return F.try_divide(top, base)


def quantize2(value: Column) -> Column:
    """Two decimals, half up."""
    return F.round(value.cast(AMOUNT), 2).cast("decimal(20,2)")
