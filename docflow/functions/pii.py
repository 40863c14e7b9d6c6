"""Regex PII redaction as nested ``regexp_replace`` (JVM regex, codegen).

U7: the redactor is a column function; callers may pass any ``Column -> Column``
backend (for example a pandas UDF around an NER model) in its place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The masking patterns and tokens, applied in this order
# (e-mail, then card, then phone). Order matters: 13-16 digit runs become [CARD].
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CARD_PATTERN = r"\b(?:\d[ -]*?){13,16}\b"
PHONE_PATTERN = r"(?:(?<=\D)|^)(?:\+?\d[\s\-()]?){9,14}\d(?=\D|$)"
EMAIL_MASK = "[EMAIL]"
CARD_MASK = "[CARD]"
PHONE_MASK = "[PHONE]"

# (?U): Unicode-aware \d, \s and \b, as in Python's str patterns.
_U = "(?U)"
# How every match of PHONE_PATTERN starts, looked at before what stands in front of it.
_PHONE_START = r"(?=[+\d])"

Redactor = Callable[[Column], Column]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mask_email(text) -> Column:
    """A text without an ``@`` holds no address; the pattern would look on from every character of it."""
    t = _c(text)
    return F.when(F.contains(t, F.lit("@")), F.regexp_replace(t, F.lit(EMAIL_PATTERN), F.lit(EMAIL_MASK))).otherwise(t)


def mask_card(text) -> Column:
    return F.regexp_replace(_c(text), F.lit(_U + CARD_PATTERN), F.lit(CARD_MASK))


def mask_phone(text) -> Column:
    return F.regexp_replace(_c(text), F.lit(_U + _PHONE_START + PHONE_PATTERN), F.lit(PHONE_MASK))


def redact(text) -> Column:
    """E-mail, then card, then phone."""
    return mask_phone(mask_card(mask_email(text)))
