"""Text expressions the templates are made of. All stay in the JVM."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions.wording import WHITESPACE


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip_text(text: Column | str) -> Column:
    """Remove Unicode white space at both ends (``trim`` only knows the space)."""
    return F.btrim(_column(text), F.lit(WHITESPACE))


def is_filled(text: Column | str) -> Column:
    """True for text that is neither null nor empty; blank text counts as filled."""
    text = _column(text)
    return text.isNotNull() & (text != F.lit(""))


def text_or(text: Column | str, fallback: str) -> Column:
    """Stripped text, or ``fallback`` for null and ``''`` (a blank strips to ``''``)."""
    text = _column(text)
    return F.when(is_filled(text), strip_text(text)).otherwise(F.lit(fallback))


def has_items(items: Column | str) -> Column:
    """True for an array that is neither null nor empty."""
    return F.coalesce(F.size(_column(items)), F.lit(0)) > 0


def join_or(items: Column | str, fallback: str) -> Column:
    """Items joined by ``', '``, or ``fallback`` for a null or empty array."""
    items = _column(items)
    return F.when(has_items(items), F.array_join(items, ", ")).otherwise(F.lit(fallback))


def with_period(text: Column | str) -> Column:
    """Stripped text that ends in a period; one is added only where none is there."""
    stripped = strip_text(text)
    return F.when(F.endswith(stripped, F.lit(".")), stripped).otherwise(
        F.concat(stripped, F.lit("."))
    )


def prefixed(prefix: str, text: Column | str) -> Column:
    """Task prefix in front of a text."""
    return F.concat(F.lit(prefix), _column(text))


def fill(wording: str, **slots: Column | str) -> Column:
    """One ``concat`` of a fixed wording and the columns for its ``{slots}``."""
    parts: list[Column] = []
    for fixed, slot, _, _ in Formatter().parse(wording):
        if fixed:
            parts.append(F.lit(fixed))
        if slot is not None:
            parts.append(_column(slots[slot]))
    return F.concat(*parts)


def fill_if(condition: Column, wording: str, **slots: Column | str) -> Column:
    """The filled wording where ``condition`` holds, else the empty text."""
    return F.when(condition, fill(wording, **slots)).otherwise(F.lit(""))
