"""Text of recognised labels: normalising, typing and reading numbers, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Arabic-Indic and extended digits, and characters without width.
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
ZERO_WIDTH = "​‌‍‎‏⁠﻿\u0000"
# Patterns of numbers, pairs of numbers and activity ids.
NUMBER = r"[-+]?(?:\d[\d,]*\.?\d*|\.\d+)"
PURE_NUMBER = rf"^{NUMBER}$"
PAIR = r"(\d+(?:\.\d+)?)\s*[/\-]\s*(\d+(?:\.\d+)?)"
ACTIVITY_IDS = (r"^[A-Za-z]\d{1,4}$", r"^[A-Za-z]{1,3}\d{1,4}$", r"^\d{1,4}[A-Za-z]$")
# What a single character may have been before recognition.
AMBIGUOUS = {
    "O": ["0", "D", "Q"],
    "0": ["O", "D", "Q"],
    "S": ["5", "8"],
    "5": ["S"],
    "V": ["Y", "U"],
    "Y": ["V"],
    "I": ["1", "l"],
    "1": ["I", "l"],
    "Z": ["2"],
    "2": ["Z"],
    "B": ["8"],
    "8": ["B"],
    "G": ["6", "C"],
    "6": ["G"],
    "Q": ["O", "0"],
    "D": ["O", "0"],
}
# The letter that a digit is taken for where an id must be a letter.
LETTER_FOR_DIGIT = {"0": "O", "5": "S", "8": "B", "1": "I", "2": "Z", "6": "G", "3": "B"}


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for; one Arrow batch at a time."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


def digits_to_ascii(c: Column) -> Column:
    return F.translate(c, ARABIC_DIGITS, "0123456789" * 2)


def normalised(c: Column) -> Column:
    """ASCII digits, no characters without width, single spaces, trimmed; apply to nfkc() text."""
    plain = F.translate(F.translate(digits_to_ascii(c), ZERO_WIDTH, ""), " ", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def is_number(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(PURE_NUMBER), F.lit(False))


def parsed(c: Column) -> Column:
    """Thousands commas dropped, then a double; null when it is none."""
    return F.regexp_replace(c, ",", "").try_cast("double")


def numbers_in(c: Column) -> Column:
    """array<double>: the whole text as one number, else all numbers in it, as far as they can be read."""
    whole = F.when(is_number(c), F.array(F.trim(c))).otherwise(F.regexp_extract_all(c, F.lit(NUMBER), 0))
    return F.filter(F.transform(whole, parsed), lambda v: v.isNotNull())


def pairs_in(c: Column) -> Column:
    """array<struct<first, second>> of values such as 3/6 or 3-6."""
    first, second = (F.regexp_extract_all(c, F.lit(PAIR), k) for k in (1, 2))
    return F.zip_with(first, second, lambda a, b: F.struct(a.cast("double").alias("first"), b.cast("double").alias("second")))


def is_activity_id(c: Column) -> Column:
    t = F.trim(c)
    return t.rlike(ACTIVITY_IDS[0]) | t.rlike(ACTIVITY_IDS[1]) | t.rlike(ACTIVITY_IDS[2])


def text_type(c: Column) -> Column:
    """numeric, activity_id, text_label (2 to 50 characters with a letter) or unknown."""
    t = F.trim(c)
    label = F.length(t).between(2, 50) & t.rlike(r"\p{L}")
    return F.when(is_number(c), "numeric").when(is_activity_id(c), "activity_id").when(label, "text_label").otherwise("unknown")


def type_confidence(c: Column, confidence: Column) -> Column:
    t = F.trim(c)
    base = F.when(confidence > 0, confidence).otherwise(0.8)
    digits = F.regexp_replace(t, "[.+-]", "").rlike(r"^\d+$")
    kind = text_type(c)
    return (
        F.when(kind == "numeric", F.when(digits, F.least(base + 0.1, F.lit(1.0))).otherwise(base))
        .when(kind == "activity_id", 0.8)
        .when(kind == "text_label", F.when(F.length(t) >= 5, 0.6).otherwise(0.5))
        .otherwise(0.0)
    )


def extracted_id(c: Column) -> Column:
    """A letter with digits, or one to four letters and digits, in upper case; else null."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[A-Za-z]\d*$") | t.rlike(r"^\p{L}$") | t.rlike(r"^[A-Za-z0-9]{1,4}$"), F.upper(t))


def is_plausible_id(c: Column) -> Column:
    t = F.trim(c)
    refused = (t == "") | (F.size(F.split(t, r"\s+")) > 2) | (F.length(t) > 6) | t.rlike(r"[؀-ۿݐ-ݿ]") | t.rlike(r"[|\\/\-_=+<>{}()\[\]]")
    return F.coalesce(~refused & (t.rlike(r"^\p{L}$") | t.rlike(r"^[A-Za-z]\d{0,2}$") | t.rlike(r"^\p{L}{1,4}$")), F.lit(False))


def first_number(c: Column) -> Column:
    """The text as a number, or the first number in it."""
    return F.coalesce(F.trim(c).try_cast("double"), F.nullif(F.regexp_extract(c, r"[-+]?\d*\.?\d+", 0), F.lit("")).try_cast("double"))


def is_duration_format(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(r"^\d+(\.\d+)?$"), F.lit(False))


def lookup(known: dict[str, str] | dict[str, list[str]], key: Column) -> Column:
    """The entry of a small fixed map, null where it has none."""
    value = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return F.create_map(*[x for k, v in known.items() for x in (F.lit(k), value(v))])[key]


def unconfused(c: Column) -> Column:
    """The letter for a text of one digit that recognition takes for a letter; other texts as they are."""
    return F.coalesce(lookup(LETTER_FOR_DIGIT, c), c)


def ambiguous(c: Column) -> Column:
    """array<string>: what else a text of one character may say, in order; empty for others."""
    return F.coalesce(lookup(AMBIGUOUS, c), F.array().cast("array<string>"))
