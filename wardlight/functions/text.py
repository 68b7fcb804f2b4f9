"""String column helpers that keep the reference's JavaScript semantics but stay JVM-side.

All helpers return ``Column`` expressions (no Python UDFs), so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters JS ``String.prototype.trim`` strips (WhiteSpace + LineTerminator:
# tab, LF, VT, FF, CR, space, NBSP, OGHAM SPACE MARK, U+2000..U+200A, LS, PS, NNBSP, MMSP,
# IDEOGRAPHIC SPACE, BOM). Spark's ``trim`` strips only blanks; ``btrim`` with this set is exact and
# needs no regex.
JS_WHITESPACE = ("\t\n\u000b\f\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                 + "\u2028\u2029\u202f\u205f\u3000\ufeff")


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(JS_WHITESPACE))


def falsy_to_null(c: Column, dtype: T.DataType | None = None) -> Column:
    """``a || ...`` operand: empty strings and numeric zeros fall through like null."""
    if isinstance(dtype, T.StringType) or dtype is None:
        return F.when(c != F.lit(""), c)
    if isinstance(dtype, (T.NumericType,)):
        return F.when((c != F.lit(0)) & ~F.isnan(c.cast("double")), c)
    return c


def truthy_or(*cols: Column, default: Column | str | None = None) -> Column:
    """JS ``a || b || c || default`` over string columns (empty strings fall through)."""
    parts = [F.when(c != F.lit(""), c) for c in cols]
    if default is not None:
        parts.append(default if isinstance(default, Column) else F.lit(default))
    return F.coalesce(*parts) if len(parts) > 1 else parts[0]


def js_number(d: Column) -> Column:
    """A double as JavaScript prints it: plain decimals from 1e-6 to below 1e21, else an exponent
    with its sign and no superfluous ``.0``."""
    size, text = F.abs(d), d.cast("string")
    small = (size >= 1e-6) & (size < 1)
    plain = F.when(small, F.when(small, d).cast("decimal(38,28)").cast("string")) \
        .otherwise(F.when((size >= 1) & (size < 1e21), d).cast("decimal(38,16)").cast("string"))
    short = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    exponent = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), "E-", "e-"), r"E(\d)", "e+$1")
    return (F.when(d.isNull() | F.isnan(d) | (size == float("inf")), text).when(size == 0, F.lit("0"))
            .when((size < 1e-6) | (size >= 1e21), exponent).otherwise(short))


def js_string(c: Column, dtype: T.DataType) -> Column:
    """``String(value)`` for the value types that occur in entity rows.

    Integral doubles print without a fraction (JS prints 23 for 23.0); timestamps are rendered in
    ISO form (JS ``Date.toString`` text is deliberately not reproduced).
    """
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        return js_number(d)
    if isinstance(dtype, T.TimestampNTZType):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(dtype, T.TimestampType):
        # an instant: render its UTC wall clock, as ``toISOString`` does, whatever the session zone
        utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))
        return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("true")).when(~c, F.lit("false"))
    return c.cast("string")


# Fixed values of the cleaning rule (value length cap, hex-hash pattern, image marker and the key
# fragments whose values are never embedded).
MAX_VALUE_CHARS = 500
HEX_HASH_PATTERN = "(?i)^[a-f0-9]{32,}$"
IMAGE_MARKER = "data:image"
DROPPED_KEY_PARTS = ("token", "path", "url")
PASSWORD_KEY_PART = "password"


def key_is_dropped(alias: str) -> bool:
    k = alias.lower()
    return any(p in k for p in DROPPED_KEY_PARTS)


def clean_value(alias: str, c: Column, dtype: T.DataType) -> Column | None:
    """Cleaned text of one mapped value, or null when it must not be embedded.

    Returns ``None`` (no column at all) when the key itself is excluded, so excluded columns are
    never read (column pruning reaches the scan).
    """
    if key_is_dropped(alias) or PASSWORD_KEY_PART in alias.lower():
        return None
    if not isinstance(dtype, T.StringType):
        # numbers, dates, booleans render short, without blanks, hex runs or image markers
        return js_string(c, dtype)
    s = js_trim(c)
    return (F.when(s.isNull(), F.lit(None))
            .when(F.length(s) > MAX_VALUE_CHARS, F.lit(None))
            .when((F.length(s) >= 32) & s.rlike(HEX_HASH_PATTERN), F.lit(None))
            .when(s.contains(IMAGE_MARKER), F.lit(None))
            .when(s == F.lit(""), F.lit(None))
            .otherwise(s))


def stable_id(table: Column | str, tenant: Column, record_id: Column) -> Column:
    """md5 of ``table:tenant:id`` laid out as 8-4-4-4-12 (the vector point id)."""
    t = F.lit(table) if isinstance(table, str) else table
    h = F.md5(F.concat_ws(":", t, tenant, record_id))
    return F.concat_ws("-", *[F.substring(h, p, n) for p, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def full_name(first: Column, last: Column) -> Column:
    """``CONCAT(first, ' ', last)``: null when either part is null."""
    return F.concat(first, F.lit(" "), last)


def name_contains(c: Column, needle: str, wildcards: bool = False) -> Column:
    """Case-insensitive ``LIKE %needle%``. Caller's ``%``/``_`` are literal unless ``wildcards``."""
    if wildcards:
        return c.ilike(f"%{needle}%")
    return F.lower(c).contains(needle.lower())


def name_prefix(c: Column, prefix: str, wildcards: bool = False) -> Column:
    if wildcards:
        return c.ilike(f"{prefix}%")
    return F.lower(c).startswith(prefix.lower())
