"""String helpers: timestamps, tags, answers, slugs, prompts' parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Openings that an answer may have, removed in this order, case-sensitive.
ANSWER_PREFIXES = ("The best answer is", "The correct answer is", "The answer is", "The answer", "The best option is", "The correct option is", "Best answer:", "Best option:")
#: What a response says when nothing fits (any of them, in the trimmed lower-cased text).
NO_MATCH = (
    r"^none[.!]?$",
    r"^no match[.!]?$",
    r"\bnone of (the )?(provided )?(chunks|chunk|frames|images) match\b",
    r"\bnone of (the )?(provided )?(chunks|chunk|frames|images) matches\b",
    r"\bno (provided )?(chunk|chunks) match\b",
    r"\bno (provided )?(chunk|chunks) matches\b",
    r"\bno suitable chunk\b",
    r"\bno matching chunk\b",
    r"\bthere is no suitable chunk\b",
    r"\bthere is no matching chunk\b",
)


def parse_timestamp(x: Column) -> Column:
    """Seconds of H:M:S with ,ms or .ms; what follows the mark counts thousandths, so .5 is 0.005 s."""
    parts = F.split(F.replace(F.trim(x), F.lit(","), F.lit(".")), ":")
    last = F.split(F.element_at(parts, -1), "\\.")
    ms = F.when(F.size(last) > 1, F.element_at(last, 2).cast("double") / 1000).otherwise(F.lit(0.0))
    whole = F.element_at(last, 1).cast("double")
    n = F.size(parts)
    minutes = F.when(n >= 2, F.element_at(parts, -2).cast("double")).otherwise(F.lit(0.0))
    hours = F.when(n >= 3, F.get(parts, n - 3).cast("double")).otherwise(F.lit(0.0))
    return hours * 3600 + minutes * 60 + whole + ms


def clock(seconds: Column) -> Column:
    """HH:MM:SS, at least 0."""
    s = F.greatest(seconds, F.lit(0.0)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def short_clock(seconds: Column) -> Column:
    """mm:ss.s"""
    tenths = F.round(F.greatest(seconds, F.lit(0.0)) * 10).cast("long")
    return F.format_string("%02d:%02d.%d", F.floor(tenths / 600), F.floor(tenths % 600 / 10), tenths % 10)


def strip_tags(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", ""), "\\s+", " "))


def chunk_number(response: Column, n: Column | int) -> Column:
    """The first integer of a response that lies in 1..n; null without one."""
    n = n if isinstance(n, Column) else F.lit(n)
    found = F.regexp_extract_all(F.coalesce(response, F.lit("")), F.lit("\\d+"), F.lit(0))
    good = F.filter(F.transform(found, lambda d: F.when(F.length(d) <= 9, d.cast("int"))), lambda v: (v >= 1) & (v <= n))
    return F.get(good, F.lit(0))


def no_match(response: Column) -> Column:
    """Whether a response says that nothing fits."""
    return F.lower(F.trim(F.coalesce(response, F.lit("")))).rlike("|".join(NO_MATCH))


def standalone_letter(answer: Column, letters: str = "ABCD") -> Column:
    """The first letter of the set that stands alone in the upper-cased answer; null without one."""
    return F.nullif(F.regexp_extract(F.upper(answer), f"\\b([{letters}])\\b", 1), F.lit(""))


def any_letter(answer: Column, letters: str = "ABCD") -> Column:
    """Drops known openings in their order, then takes the first letter of the set anywhere; null for none."""
    if not letters:
        raise ValueError("no valid letters")
    x = F.trim(answer)
    for prefix in ANSWER_PREFIXES:
        x = F.replace(x, F.lit(prefix), F.lit(""))
    return F.nullif(F.regexp_extract(F.upper(x), f"([{letters}])", 1), F.lit(""))


def slug(x: Column) -> Column:
    s = F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("unknown")).otherwise(s)


def answer_tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def shorten(x: Column, n: int) -> Column:
    flat = F.trim(F.replace(x, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 3), F.lit("..."))).otherwise(flat)


def search_text(x: Column, most: int = 200) -> Column:
    return F.substring(F.btrim(F.btrim(F.btrim(x), F.lit("\"'"))), 1, most)


def letter(index: Column) -> Column:
    """A for 0, B for 1 and on through all code points (F.char begins anew at 256)."""
    return F.decode(F.unhex(F.lpad(F.hex((index + 65).cast("long")), 8, "0")), "UTF-32")


def lettered(options: Column) -> Column:
    """Options with their letters: A. first, B. second; empty ones go, and letters that are there already aren't doubled."""
    bare = F.filter(F.transform(options, lambda o: F.trim(o)), lambda o: o != "")
    return F.transform(bare, lambda o, i: F.concat(letter(i), F.lit(". "), F.regexp_replace(o, "^\\(?[A-Z][).:]\\s*", "")))


def interval_line(index: Column, start: Column, end: Column, score: Column) -> Column:
    """One line of a prompt: number, interval with one digit and score with two."""
    return F.format_string("%d. [%.1f-%.1f] score %.2f", index, start, end, score)
