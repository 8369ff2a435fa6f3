"""Scalar column functions (``Column -> Column``).

All are built from Spark's own expressions so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space characters removed from both ends of
# text by strip(): tab, line feed, vertical tab, form feed, carriage return,
# space, next line, no-break space, ogham space mark, en quad .. hair space,
# line separator, paragraph separator, narrow no-break space, medium
# mathematical space, ideographic space.
WHITESPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680"
              "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
              "\u2028\u2029\u202f\u205f\u3000")
# A plain decimal number, optionally signed, with optional exponent.
_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The helpers below accept a column name or a Column. Given a name they build
# the expression as one SQL text (one call into the JVM instead of one per
# sub-expression - building a query is then cheap); given a Column they
# compose it from pyspark functions. Both give the same expression tree.

def sql_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_str(text: str) -> str:
    """A SQL string literal (backslashes and quotes escaped, other characters as \\uXXXX)."""
    out = []
    for ch in text:
        if ch in "\\'":
            out.append("\\" + ch)
        elif " " < ch < "\x7f":
            out.append(ch)
        else:
            out.append("\\u%04x" % ord(ch))
    return "'" + "".join(out) + "'"


def strip_sql(expr: str) -> str:
    t = f"trim(CAST({expr} AS STRING))"
    ws = sql_str(WHITESPACE)
    return (f"CASE WHEN instr({ws}, substring({t}, 1, 1)) > 0 OR instr({ws}, substring({t}, -1, 1)) > 0 "
            f"THEN btrim({t}, {ws}) ELSE {t} END")


def strip(c) -> Column:
    """Remove leading and trailing whitespace (any Unicode space, not only ' ').

    Plain ``trim`` removes spaces; only a value whose first or last character
    is still whitespace after that (tab, no-break space, ...) goes through the
    slower trim over the whole character set. No regular expression runs.
    """
    if isinstance(c, str):
        return F.expr(strip_sql(sql_ident(c)))
    t = F.trim(_col(c).cast("string"))
    ws = F.lit(WHITESPACE)
    # instr(set, '') is 1, so '' also takes the (harmless) full-trim branch
    edge = (F.instr(ws, F.substring(t, 1, 1)) > 0) | (F.instr(ws, F.substring(t, -1, 1)) > 0)
    return F.when(edge, F.btrim(t, ws)).otherwise(t)


def ck(c) -> Column:
    """Canonical key: stripped and upper-cased."""
    if isinstance(c, str):
        return F.expr(f"upper({strip_sql(sql_ident(c))})")
    return F.upper(strip(c))


def lenient_int(c, thousands: bool = False, default: int | None = 0) -> Column:
    """Text to 64-bit integer; anything unparsable becomes ``default``.

    ``thousands=True`` removes every ',' first, so "1,234" reads as 1234;
    otherwise it is unparsable.
    """
    if isinstance(c, str):
        s_sql = strip_sql(sql_ident(c))
        if thousands:
            s_sql = f"translate({s_sql}, ',', '')"
        parsed_sql = f"try_cast({s_sql} AS BIGINT)"
        return F.expr(parsed_sql if default is None else f"coalesce({parsed_sql}, CAST({int(default)} AS BIGINT))")
    s = strip(c)
    if thousands:
        s = F.translate(s, ",", "")
    parsed = s.try_cast("bigint")
    return parsed if default is None else F.coalesce(parsed, F.lit(default).cast("bigint"))


def lenient_float(c, default: float | None = 0.0) -> Column:
    """Text to double; missing or unparsable (incl. NaN / infinities) becomes ``default``.

    Only plain decimal notation is accepted, which keeps Spark from reading
    suffixes such as '12d' that other parsers reject.
    """
    if isinstance(c, str):
        s_sql = strip_sql(sql_ident(c))
        parsed_sql = f"CASE WHEN {s_sql} RLIKE {sql_str(_DECIMAL)} THEN try_cast({s_sql} AS DOUBLE) END"
        return F.expr(parsed_sql if default is None else f"coalesce({parsed_sql}, CAST({float(default)!r} AS DOUBLE))")
    s = strip(c)
    parsed = F.when(s.rlike(_DECIMAL), s.try_cast("double"))
    return parsed if default is None else F.coalesce(parsed, F.lit(default).cast("double"))


def safe_int(c) -> Column:
    """Text -> float -> integer truncated toward zero; blank is 0, failure is 0."""
    if isinstance(c, str):
        s_sql = strip_sql(sql_ident(c))
        as_double = f"CASE WHEN {s_sql} RLIKE {sql_str(_DECIMAL)} THEN try_cast({s_sql} AS DOUBLE) END"
        return F.expr(f"CASE WHEN coalesce({s_sql}, '') = '' THEN CAST(0 AS BIGINT) "
                      f"ELSE coalesce(try_cast({as_double} AS BIGINT), CAST(0 AS BIGINT)) END")
    s = strip(c)
    as_double = F.when(s.rlike(_DECIMAL), s.try_cast("double"))
    truncated = as_double.try_cast("bigint")
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(0).cast("bigint")).otherwise(
        F.coalesce(truncated, F.lit(0).cast("bigint")))


def text_or_blank(c, legacy_null_text: bool = False) -> Column:
    """Value as text with null shown as '' (or as 'None' in legacy mode)."""
    return F.coalesce(_col(c).cast("string"), F.lit("None" if legacy_null_text else ""))


def is_blank(c) -> Column:
    """True when null or only whitespace."""
    return F.coalesce(strip(c), F.lit("")) == ""


def non_blank(c) -> Column:
    """True when not null and not ''."""
    return _col(c).isNotNull() & (_col(c).cast("string") != "")


def batch_stamp(ts) -> Column:
    """Import batch stamp ``yyyyMMdd_HHmmss`` of a timestamp (a parameter, for repeatability)."""
    ts_col = F.lit(ts).cast("timestamp") if not isinstance(ts, Column) else ts
    return F.date_format(ts_col, "yyyyMMdd_HHmmss")


def contains_ci(c, needle: str) -> Column:
    """Case-insensitive literal substring test (no LIKE wildcards)."""
    return F.instr(F.lower(text_or_blank(c)), needle.lower()) > 0


def money(c, symbol: str = "") -> Column:
    """Two-decimal money text with an optional currency symbol; null shows '-'."""
    return F.when(_col(c).isNull(), F.lit("-")).otherwise(
        F.concat(F.lit(symbol), F.format_string("%.2f", _col(c).cast("double"))))


def grouped_int(c) -> Column:
    """Integer with thousands grouping ('1,234'); null shows '-'."""
    return F.when(_col(c).isNull(), F.lit("-")).otherwise(F.format_number(_col(c).cast("bigint"), 0))


def dash_if_null(c) -> Column:
    """Text with null shown as '-'; blank text stays blank."""
    return F.coalesce(_col(c).cast("string"), F.lit("-"))


def plain_number(c) -> Column:
    """A number as it is written: whole numbers without decimals; null shows '-'."""
    whole = (_col(c) == F.floor(_col(c))) & (F.abs(_col(c)) < 1e15)
    return F.when(_col(c).isNull(), F.lit("-")).when(whole, _col(c).cast("bigint").cast("string")).otherwise(_col(c).cast("string"))


def row_message(row_no, sku, reason) -> Column:
    """'Row n: reason' or 'Row n (SKU: x): reason' when a SKU is known."""
    reason_col = _col(reason)
    sku_col = _col(sku)
    return F.when(sku_col.isNull() | (sku_col == ""),
                  F.format_string("Row %d: %s", _col(row_no), reason_col)).otherwise(
        F.format_string("Row %d (SKU: %s): %s", _col(row_no), sku_col, reason_col))


def json_list(c) -> Column:
    """The texts of a JSON list held as text; null if it is null or no list."""
    return F.from_json(_col(c), "array<string>")
