"""UUID text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plain and hyphenated forms of a UUID in lower case, after ``urn:uuid:`` or in a pair of braces.
_DIGITS = r"[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}"
UUID_FORMS = rf"\A(?:(?:urn:uuid:)?{_DIGITS}|\{{{_DIGITS}\}})\z"
_PARTS = r"^(.{8})(.{4})(.{4})(.{4})(.{12})$"


_PLAIN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"


def canonical_uuid(text: Column | str) -> Column:
    """Lower-case hyphenated form of a UUID text; null for anything else.

    Most texts are in that form already: one comparison settles them before any replacement.
    """
    text = F.col(text) if isinstance(text, str) else text
    lower = F.lower(text)
    digits = F.regexp_replace(lower, r"urn:uuid:|[{}-]", "")
    other = F.when(lower.rlike(UUID_FORMS), F.regexp_replace(digits, _PARTS, "$1-$2-$3-$4-$5"))
    return F.when(text.rlike(_PLAIN), text).otherwise(other)
