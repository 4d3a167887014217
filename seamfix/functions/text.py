"""Scalar Column functions (F1-F11). All are JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamfix import constants as K

# Character class of a stray-delimiter candidate: not a letter or digit and
# not one of the excluded value characters.
STRAY_CLASS = r"[^\p{L}\p{N}\-_.'" + '"' + r"@ ]"
# A complete quoted field. Possessive and unrolled: Java matches it in a loop, so a
# field of any length needs no stack and no backtracking.
QUOTED = '"[^"]*+(?:""[^"]*+)*+"'
INVISIBLE_CLASS = "[\\x{FEFF}\\x{200B}\\x{200C}\\x{200D}\\x{2060}]"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where ``body``
    uses it inside a lambda (which would evaluate an expression per element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def quote_regex(d) -> Column:
    """Regex matching the literal character(s) ``d`` (Java \\Q..\\E quoting)."""
    return F.concat(F.lit("\\Q"), _c(d), F.lit("\\E"))


def regex_replacement(d) -> Column:
    """``d`` escaped for use as a regex replacement string."""
    d = _c(d)
    return F.when(d.isin("\\", "$"), F.concat(F.lit("\\"), d)).otherwise(d)


def occurrences(raw, d) -> Column:
    """Number of occurrences of the single character ``d`` in ``raw``."""
    raw = _c(raw)
    return F.length(raw) - F.length(F.replace(raw, _c(d), F.lit("")))


def blank_quoted(raw, d) -> Column:
    """Replace each complete quoted field (delimited by ``d``) by ``Q``."""
    pat = F.concat(F.lit('(^|'), quote_regex(d), F.lit(f'){QUOTED}(?='), quote_regex(d), F.lit("|$)"))
    return F.regexp_replace(_c(raw), pat, F.lit("$1Q"))


def blank_any_quoted(raw) -> Column:
    """Replace each complete quoted field, whatever candidate delimiter
    bounds it, by ``Q``: what is left of a delimiter stands outside quotes."""
    edge = "[,;\\t|:]"
    return F.regexp_replace(_c(raw), f'(^|{edge}){QUOTED}(?={edge}|$)', "$1Q")


def field_count(raw, d) -> Column:
    """Quote-aware number of fields of one line under delimiter ``d``.

    Lines without a double quote take the cheap literal-count path.
    """
    raw = _c(raw)
    plain = occurrences(raw, d) + 1
    quoted = occurrences(blank_quoted(raw, d), d) + 1
    return F.when(F.instr(raw, '"') > 0, quoted).otherwise(plain).cast("long")


# Regex metacharacters; any other single character splits literally.
REGEX_META = ".$|()[{^?*+\\"


def split_pattern(d) -> Column:
    """Split pattern matching the literal ``d``. A single character goes as
    itself, or as backslash + itself when it is a regex metacharacter:
    both take the JVM's literal fast path of ``String.split`` instead of
    compiling a pattern for every line, as ``\\Q..\\E`` would."""
    if isinstance(d, str):
        if len(d) != 1:
            return quote_regex(d)
        return F.lit("\\" + d if d in REGEX_META else d)
    d = _c(d)
    return F.when(F.length(d) != 1, quote_regex(d)) \
        .when(F.instr(F.lit(REGEX_META), d) > 0, F.concat(F.lit("\\"), d)).otherwise(d)


def split_fields(raw, d) -> Column:
    """Split an unquoted line on the literal character ``d``, keeping
    trailing empty fields."""
    return F.split(_c(raw), split_pattern(d), -1)


def stray_candidates(raw, d=None) -> Column:
    """Distinct sorted stray-delimiter candidates of ``raw`` minus ``d``."""
    found = F.array_distinct(F.regexp_extract_all(_c(raw), F.lit("(" + STRAY_CLASS + ")"), 1))
    if d is not None:
        found = F.array_remove(found, _c(d))
    return F.array_sort(found)


def csv_quote(field) -> Column:
    """Minimal CSV quoting of one field for a comma/``d`` join."""
    f = _c(field)
    return F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_join(fields, d) -> Column:
    """Serialise an array of fields with delimiter ``d``, quoting a field
    only when it holds ``d``, a double quote, CR or LF (F7)."""
    d = _c(d)
    return F.call_function(
        "array_join",
        F.transform(
            _c(fields),
            lambda f: F.when(
                (F.instr(f, '"') > 0) | (F.instr(f, "\r") > 0) | (F.instr(f, "\n") > 0)
                | (F.length(f) != F.length(F.replace(f, d, F.lit("")))),
                csv_quote(f),
            ).otherwise(f),
        ),
        d,
    )


def strip_invisible(x) -> Column:
    """Remove the invisible characters (F8)."""
    return F.regexp_replace(_c(x), INVISIBLE_CLASS, "")


def has_invisible(x) -> Column:
    return _c(x).rlike(INVISIBLE_CLASS)


def strip_cr(raw) -> Column:
    """``raw`` without a carriage return at its end; the bytes stay as they are, also where
    they are not UTF-8."""
    raw = _c(raw)
    return F.when(raw.endswith("\r"), F.substr(raw.cast("binary"), F.lit(1), F.octet_length(raw) - 1).cast("string")).otherwise(raw)


def is_blank(x) -> Column:
    """True when the line holds only blanks (F11). A line starting with a
    printable ASCII character is not blank; only the others (empty, or
    starting with a control, space or non-ASCII character) take the regex."""
    x = _c(x)
    first = F.ascii(x)
    return F.when((first > 32) & (first < 127), F.lit(False)).otherwise(x.rlike(r"^[\s\p{Z}]*$"))


def parses_float(x) -> Column:
    """Python ``float()`` grammar (F1)."""
    return _c(x).rlike(K.FLOAT_RE)


def parses_int(x) -> Column:
    """Python ``int()`` grammar (F2)."""
    return _c(x).rlike(K.INT_RE)


def parses_bool(x) -> Column:
    """``true``/``false`` case-blind, trimmed."""
    return F.lower(F.trim(_c(x))).isin("true", "false")


def parses_iso_datetime(x) -> Column:
    """ISO-8601 calendar date or datetime in extended or basic form, with
    clock fields in range and an existing date (F4)."""
    v = F.trim(_c(x))
    hour, sixty = r"(?:[01]\d|2[0-3])", r"[0-5]\d"
    extended = rf"{hour}(?::{sixty}(?::{sixty}(?:[.,]\d+)?)?)?"
    basic = rf"{hour}(?:{sixty}(?:{sixty}(?:[.,]\d+)?)?)?"
    zone = rf"(?:Z|[+-]{hour}(?::?{sixty}(?::?{sixty})?)?)?"
    day = F.regexp_replace(F.regexp_extract(v, r"^(\d{4}-\d{2}-\d{2}|\d{8})", 1), "-", "")
    return v.rlike(rf"^(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{8}})(?:[T ](?:{extended}|{basic}){zone})?$") \
        & F.try_to_timestamp(day, F.lit("yyyyMMdd")).isNotNull()


def codec_key(x) -> Column:
    """Codec name canonical form: lower case, alphanumerics only."""
    return F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]", "")


def wasbs_uri(url) -> Column:
    """``https://host/container/name?sig`` -> ``wasbs://container@host/name``."""
    u = _c(url)
    host = F.regexp_extract(u, r"^https?://([^/?#]+)", 1)
    path = F.regexp_extract(u, r"^https?://[^/?#]+/([^?#]*)", 1)
    container = F.regexp_extract(path, r"^([^/]+)", 1)
    rest = F.regexp_extract(path, r"^[^/]+/?(.*)$", 1)
    return F.when(host != "", F.concat(F.lit("wasbs://"), container, F.lit("@"), host, F.lit("/"), rest))
