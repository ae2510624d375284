"""Text expressions that keep to Python's notions of white space and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip has it, for a Java character class.
SPACE = r"\s\x1C-\x1F\x85\p{Z}"
WORD = r"[\p{L}\p{N}_]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"[{SPACE}]+", " "))


def blank(c: Column) -> Column:
    """Null or nothing but white space."""
    return c.isNull() | (strip(c) == "")


def tokens(c: Column) -> Column:
    """Lower-case words in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def word_count(c: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.when(c.isNull(), 0).otherwise(F.size(F.filter(F.split(c, rf"[{SPACE}]+"), lambda w: w != "")))


def content_blocks(c: Column, least_words: int = 5) -> Column:
    """Lines of at least ``least_words`` words, white space collapsed, each once."""
    lines = F.transform(F.split(c, "\n"), collapse)
    return F.array_distinct(F.filter(lines, lambda x: (x != "") & (F.size(F.split(x, " ")) >= least_words)))


def cut(c: Column, n: int) -> Column:
    """At most n code points; empty becomes null."""
    return F.nullif(F.substring(c, 1, n), F.lit(""))


def format_score(c: Column) -> Column:
    return F.when(c.isNull(), "—").otherwise(F.format_string("%.0f%%", c))


def score_class(c: Column) -> Column:
    return F.when(c.isNull(), "score-na").when(c >= 80, "score-good").when(c >= 60, "score-mid").otherwise("score-bad")


def format_delta(c: Column) -> Column:
    return F.when(c.isNull(), "—").when(c == 0, "±0").when(c > 0,
        F.format_string("+%.0f", c)).otherwise(F.format_string("%.0f", c))


def delta_class(c: Column) -> Column:
    return F.when(c.isNull() | (c == 0), "delta-zero").when(c > 0, "delta-up").otherwise("delta-down")


def format_bytes(c: Column) -> Column:
    kb, mb = c / 1024, c / (1024 * 1024)
    return F.when(c.isNull(), "—").when(c < 1024, F.format_string("%d B", c)).when(c < 1024 * 1024,
        F.format_string("%.1f KB", kb)).otherwise(F.format_string("%.1f MB", mb))


def format_ms(c: Column) -> Column:
    return F.when(c.isNull(), "—").otherwise(F.concat(c.cast("string"), F.lit(" ms")))


def format_time(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "dd.MM.yyyy HH:mm"), F.lit("—"))
