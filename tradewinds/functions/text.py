"""Text cleaning and text tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CARRIAGE_RETURN = "\r"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_blank(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


def clean_text(
    c: Column | str,
    case: str | None = None,
    blank_to_null: bool = False,
    drop_cr: bool = True,
) -> Column:
    """Drop carriage returns, trim spaces, fold case; optionally turn '' into NULL.

    ``case`` is 'lower', 'upper' or None. A CRLF file read with '\\n' line ends leaves a
    '\\r' on its last field, so the carriage return is removed before trimming.
    """
    out = _col(c)
    if drop_cr:
        out = F.replace(out, F.lit(CARRIAGE_RETURN), F.lit(""))
    out = F.trim(out)
    if case == "lower":
        out = F.lower(out)
    elif case == "upper":
        out = F.upper(out)
    elif case is not None:
        raise ValueError(f"case must be 'lower', 'upper' or None, not {case!r}")
    return null_if_blank(out) if blank_to_null else out


def is_blank(c: Column | str, cleaned: bool = False) -> Column:
    """TRUE for NULL or empty text; with ``cleaned`` also for text that cleans to empty."""
    out = _col(c)
    probe = clean_text(out) if cleaned else out
    return out.isNull() | (probe == "")


def is_digits(c: Column | str) -> Column:
    return _col(c).rlike("^[0-9]+$")


def text_bytes(c: Column | str) -> Column:
    """Length in bytes, which is what the source system's LENGTH() reports."""
    return F.octet_length(_col(c))


def joined_label(first: Column | str, second: Column | str, sep: str = "_") -> Column:
    """``first`` + sep + ``second``; NULL as soon as one part is NULL."""
    return F.concat(_col(first), F.lit(sep), _col(second))
