"""Scalar text functions: channel names, file names, pairing names, result lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and patterns the recordings use.
REFERENCE_NAME = "EEG VREF"
REFERENCE_TARGET = "Cz"
NUMBERED_PREFIX = "EEG "
NUMBERED_TARGET = "E"
PAIRING_PATTERN = r"^(spk|lst)(\d+)-(spk|lst)(\d+)$"
ROLE_NAMES = {"spk": "speaker", "lst": "listener"}
CLEANED_SUFFIX = "_preprocessed"


def channel_number(ch: Column) -> Column:
    """Second space-separated token as an integer, or NULL."""
    token = F.trim(F.get(F.split(ch, " "), F.lit(1)))
    plain = F.regexp_replace(token, r"(?<=\d)_(?=\d)", "")
    return F.when(plain.rlike(r"^[+-]?\d+$"), plain.try_cast("bigint"))


def renamed_channel(ch: Column) -> Column:
    number = channel_number(ch)
    return (
        F.when(F.upper(ch) == REFERENCE_NAME, F.lit(REFERENCE_TARGET))
        .when(F.startswith(ch, F.lit(NUMBERED_PREFIX)) & number.isNotNull(), F.concat(F.lit(NUMBERED_TARGET), number.cast("string")))
        .otherwise(ch)
    )


def rename_skipped(ch: Column) -> Column:
    """True for a name that looks numbered but has no number."""
    return (F.upper(ch) != REFERENCE_NAME) & F.startswith(ch, F.lit(NUMBERED_PREFIX)) & channel_number(ch).isNull()


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(base_name(path), r"^(.+)\.[^.]*$", "$1")


def cleaned_name(path: Column) -> Column:
    return F.concat(stem(path), F.lit(CLEANED_SUFFIX))


def pairing_part(pairing: Column, side: str, what: str) -> Column:
    """``what`` ('role' or 'subject') of ``side`` ('a' or 'b') in a name such as ``spk9-lst10``."""
    group = {("a", "role"): 1, ("a", "subject"): 2, ("b", "role"): 3, ("b", "subject"): 4}[(side, what)]
    part = F.nullif(F.regexp_extract(pairing, PAIRING_PATTERN, group), F.lit(""))
    if what == "subject":
        return part.cast("bigint")
    named = F
    for short, full in ROLE_NAMES.items():
        named = named.when(part == short, F.lit(full))
    return named


def exclusion_list(text: Column) -> Column:
    """``'1, 2,x,-3, 07'`` -> ``[1, 2, 7]``: comma-separated, trimmed, digits only."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    digits = F.filter(parts, lambda p: p.rlike(r"^\d+$"))
    return F.transform(digits, lambda p: p.cast("bigint"))


def result_line(tag: Column, consistency: Column, variability: Column) -> Column:
    return F.format_string("%-40s  consistency=%.4f  variability=%.4f", tag, consistency, variability)
