"""Column expressions for response and SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_match(text: Column, pattern: str) -> Column:
    """Group 1 of the last match of ``pattern``, or NULL."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def occurrences(text: Column, token: str) -> Column:
    """Non-overlapping count of a fixed ``token``."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token))


def squeeze(text: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip(text: Column) -> Column:
    """White space (not only blanks) removed from both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def outside_quotes(text: Column, fn) -> Column:
    """Apply ``fn`` to the parts of ``text`` outside '…' and "…", keep the quoted parts.

    The text is cut at quoted spans; spans and gaps alternate, so both lists are zipped back.
    """
    quoted = r"'[^']*'|\"[^\"]*\""
    gaps = F.split(text, quoted, -1)
    spans = F.regexp_extract_all(text, F.lit(f"({quoted})"), F.lit(1))
    zipped = F.zip_with(
        F.transform(gaps, fn), spans, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))
    )
    return F.array_join(zipped, "")
