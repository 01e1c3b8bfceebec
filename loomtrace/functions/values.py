"""Scalar functions on trace values, all as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(v: Column | str) -> Column:
    """``v`` without blanks (space, tab, CR) at both ends."""
    return F.btrim(_col(v), F.lit(BLANKS))


def parse_id(v: Column | str) -> Column:
    """BIGINT that a block id or address denotes; NULL where ``v`` is unreadable.

    Readable: after trimming, all digits, or ``0x``/``0X`` and hex digits; a line feed is
    not trimmed. Values of 64 bits keep their bit pattern, in decimal as in hex, so an
    address from 2^63 on becomes negative; wider ones have no BIGINT and give NULL.
    """
    t = trimmed(v)
    short = F.when(t.rlike(r"^[0-9]{1,18}\z"), t.try_cast("bigint"))
    digits = F.regexp_replace(t, "^0+(?=.)", "")
    fits = (F.length(digits) < 20) | ((F.length(digits) == 20) & (digits <= F.lit(str(2**64 - 1))))
    long = F.when(t.rlike(r"^[0-9]{19,}\z") & fits, F.conv(digits, 10, -10).try_cast("bigint"))
    hexa = F.when(t.rlike(r"^0[xX]0*[0-9a-fA-F]{1,16}\z"), F.conv(F.regexp_replace(F.substring(t, 3, 1 << 30), "^0+(?=.)", ""), 16, -10).try_cast("bigint"))
    return F.coalesce(short, hexa, long)


_T = "trim(v, ' ' || chr(9) || chr(13))"
_U = f"TRY_CAST(ltrim({_T}, '0') AS UBIGINT)"
PARSE_ID_SQL = (
    f"CASE WHEN regexp_full_match({_T}, '[0-9]{{1,18}}|0[xX]0*[0-9a-fA-F]{{1,15}}') THEN TRY_CAST({_T} AS BIGINT) "
    f"WHEN regexp_full_match({_T}, '[0-9]+') THEN CAST(CASE WHEN {_U} > 9223372036854775807 THEN {_U}::HUGEINT - 18446744073709551616 ELSE coalesce({_U}, CASE WHEN ltrim({_T}, '0') = '' THEN 0 END)::HUGEINT END AS BIGINT) "
    f"WHEN regexp_full_match({_T}, '0[xX]0*[0-9a-fA-F]{{16}}') THEN CAST(CASE WHEN TRY_CAST({_T} AS UBIGINT) > 9223372036854775807 THEN TRY_CAST({_T} AS UBIGINT)::HUGEINT - 18446744073709551616 ELSE TRY_CAST({_T} AS UBIGINT)::HUGEINT END AS BIGINT) END"
)


def decode_bytes(v: Column | str) -> Column:
    """Bytes of a ``LoadValue``/``StoreValue`` dump: ``0X`` and two hex digits a byte.

    NULL where ``v`` has another form; ``0X`` alone gives empty bytes.
    """
    t = trimmed(v)
    return F.when(t.rlike(r"^0[xX]([0-9a-fA-F]{2})*\z"), F.unhex(F.substring(t, 3, 1 << 30)))


def parse_line(line: Column | str) -> Column:
    """``struct(key, value)`` of a log line: its first two ``:`` fields, value NULL without a second."""
    parts = F.split(_col(line), ":", -1)
    return F.struct(F.get(parts, F.lit(0)).alias("key"), F.get(parts, F.lit(1)).alias("value"))


def squeezed_label(label: Column | str) -> Column:
    """Label in one spelling: trimmed, lower case, blanks and dashes as ``_``."""
    return F.lower(F.regexp_replace(trimmed(label), "[ \\-]+", "_"))
