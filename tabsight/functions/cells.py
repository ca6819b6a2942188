"""Cell standardizers as native Spark column expressions.

Every function takes a ``Column`` and the *kind* of its physical type (see
:func:`kind_of`) so that typed columns skip text parsing altogether. Nothing
here is a Python UDF: the expressions stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.config import BOOLEAN, CATEGORICAL, DATE, NUMERIC

# The tokens that read as "no value", and the accepted words for booleans.
MISSING_TOKENS = ("", "na", "n/a", "null", "none", "nan", "-", "--")
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")

# Month names; both the full form and its first three letters are accepted.
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

# The code points str.strip() and str.split() treat as whitespace.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def character_ranges(characters: str) -> str:
    """Body of a pattern character class; neighbours are joined, which matches faster."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, characters)):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" if a < b else rf"\x{{{a:x}}}" for a, b in ranges)


_WS = character_ranges(WHITESPACE)


def _words(words) -> str:
    return "|".join(w for w in words if w)


_MISSING = rf"^[{_WS}]*+(?:(?i:{_words(MISSING_TOKENS)}))?[{_WS}]*+$"
_TRUE = rf"^[{_WS}]*+(?i:{_words(TRUE_WORDS)})[{_WS}]*+$"
_FALSE = rf"^[{_WS}]*+(?i:{_words(FALSE_WORDS)})[{_WS}]*+$"
# A run that a single plain space does not already equal.
_SPACE_RUN = rf"[{_WS}]{{2,}}|[{_WS}&&[^ ]]"

_EDGE_SPACE = rf"^[{_WS}]|[{_WS}]\z"


def _whole(pattern: str) -> str:
    """The pattern as a whole cell, whitespace around it allowed."""
    return rf"^[{_WS}]*+{pattern}[{_WS}]*+$"


_LETTERS = r"\p{Lu}\p{Ll}\p{Lt}"
_CASED = rf"^[{_LETTERS}]"
_TITLE_PARTS = rf"[{_LETTERS}]+[^{_LETTERS}]?|[^{_LETTERS}]+"

_PLAIN_NUMBER = r"^[\t-\r\x20]*+[+-]?\d+(?:\.\d+)?[\t-\r\x20]*+$"
_TWO_EXPONENTS = r"(?s)[eE].*[eE]"
_NOT_NUMBER_CHARS = r"[^0-9eE.\-+()%]+"
_NOT_A_NUMBER = r"(?s)^(?![+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$).*$"
_BRACKETED = r"(?s)" + _whole(r"\(.*\)")
_PERCENT = rf"(?s)(?:^[{_WS}]*+\(.*%\)|%)[{_WS}]*+\z"
# What surrounds the number: a pair of brackets, a percent sign inside or instead of them.
_DECORATION = rf"(?s)^[{_WS}]*+\((.*?)%?\)[{_WS}]*+\z|%[{_WS}]*+\z"
_STRICT_NUMBER = _whole(
    r"\(?[$€£¥]?\s*[+-]?(?:\d{1,3}(?:,\d{3})+|\d+|(?=\.))(?:\.\d*)?(?:[eE][+-]?\d+)?\s*%?\)?"
)

_MONTH_NAME = "|".join(f"{m}|{m[:3]}" for m in MONTHS)
_DATE_HINT = rf"^[{_WS}]*+(?:\d{{4}}|\d{{1,2}}/|(?i:{_MONTH_NAME})[{_WS}])"
# Groups: 1 year, 2-5 month and day (dashed or basic), 6 hour, 8 minute, 9 second, 10 fraction, 11 offset.
_ISO = _whole(
    r"(?!0000)(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2}))"
    r"(?:[^Z](\d{2})(?:(:?)(\d{2})(?:\7(\d{2})(?:[.,](\d{1,6})\d*)?)?)?(Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d)?)?|Z)?"
)
# Groups: 1 year, 2-5 week and day (dashed or basic), 6 a time that follows the date as in an ISO text.
_ISO_WEEK = _whole(
    r"(?!0000)(\d{4})(?:-W(\d{2})(?:-([1-7]))?|W(\d{2})([1-7])?)"
    r"((?:[^Z\d-]\d{2}(?:(:?)\d{2}(?:\7\d{2}(?:[.,]\d+)?)?)?(?:Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d)?)?|Z)?)"
)
_DASHED = _whole(rf"(?!0000)\d{{4}}-\d{{1,2}}-\d{{1,2}}(?:[{_WS}]+\d{{1,2}}:\d{{1,2}}(?::\d{{1,2}})?)?")
_SLASHED = _whole(rf"(?!0000)\d{{4}}/\d{{1,2}}/\d{{1,2}}(?:[{_WS}]+\d{{1,2}}:\d{{1,2}}:\d{{1,2}})?")
_YEAR_LAST = _whole(r"(\d{1,2})/(\d{1,2})/((?!0000)\d{4})")
_NAMED_MONTH = _whole(rf"((?i:{_MONTH_NAME}))[{_WS}]+(\d{{1,2}})[{_WS}]+((?!0000)\d{{4}})")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Reference a column by its literal name (dots and spaces allowed)."""
    return F.col(quoted(name))


def kind_of(dtype: T.DataType) -> str:
    """Physical kind of a column: string, integral, floating, decimal, boolean or temporal."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integral"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "floating"
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    raise ValueError(f"Columns of type {dtype.simpleString()} are outside the data model; select or flatten them first.")


def kinds(df: DataFrame, columns: list[str]) -> dict[str, str]:
    fields = {f.name: f.dataType for f in df.schema.fields}
    return {c: kind_of(fields[c]) for c in columns}


def strip(c: Column) -> Column:
    return F.when(c.rlike(_EDGE_SPACE), F.btrim(c, F.lit(WHITESPACE))).otherwise(c)


def collapse_text(c: Column) -> Column:
    """Turn each whitespace run into one space, then trim."""
    return F.trim(F.regexp_replace(c, _SPACE_RUN, " "))


def text_of(c: Column, kind: str = "string") -> Column:
    """The cell as text; booleans read ``True`` / ``False``."""
    if kind == "string":
        return c
    if kind == "boolean":
        return F.when(c, "True").when(~c, "False")
    return c.cast("string")


def is_missing(c: Column, kind: str = "string") -> Column:
    if kind == "string":
        return c.isNull() | c.rlike(_MISSING)
    return c.isNull()


def fold_value(c: Column, kind: str = "string") -> Column:
    """Counting key of a cell: trimmed, collapsed, lower case."""
    if kind == "string":
        return F.lower(collapse_text(c))
    return F.lower(text_of(c, kind))


def normalize_text(c: Column, case: str = "lower", strip_spaces: bool = True) -> Column:
    text = collapse_text(c) if strip_spaces else c
    if case == "lower":
        return F.lower(text)
    if case == "upper":
        return F.upper(text)
    if case == "title":
        # Runs of letters with the sign after them, whose case follows theirs, and runs of other signs. A part refers to
        # nothing but itself: what a lambda names of the row is computed for each part again.
        parts = F.regexp_extract_all(text, F.lit(_TITLE_PARTS), F.lit(0))

        def titled(part: Column) -> Column:
            # A capital sigma is lowered as it is alone, wherever it stands.
            rest = F.lower(F.replace(F.substr(part, F.lit(2)), F.lit("\u03a3"), F.lit("\u03c3")))
            return F.when(part.rlike(_CASED), F.concat(F.upper(F.left(part, F.lit(1))), rest)).otherwise(F.upper(part))

        return F.array_join(F.transform(parts, titled), "")
    return text


def parse_number(c: Column, kind: str = "string", strict: bool = False) -> Column:
    """Tolerant number: ``(x)`` negates, a trailing ``%`` divides by 100, other symbols are dropped."""
    if kind in ("integral", "decimal"):
        return c.cast("double")
    if kind == "floating":
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if kind != "string":
        return F.lit(None).cast("double")

    def read(kept: Column) -> Column:
        # Text that is no number becomes NaN, which costs no parse exception, then NULL.
        number = F.regexp_replace(kept, _NOT_A_NUMBER, "NaN").try_cast("double")
        return F.nanvl(number, F.lit(None).cast("double"))

    # Few references to the cell: a predicate on the result inlines all of them.
    core = F.regexp_replace(c, _DECORATION, "$1")
    sign = F.when(c.rlike(_BRACKETED), F.lit(-1.0)).otherwise(F.lit(1.0))
    scale = F.when(c.rlike(_PERCENT), F.lit(100.0)).otherwise(F.lit(1.0))
    decorated = read(F.regexp_replace(core, _NOT_NUMBER_CHARS, "")) * sign / scale
    # Every missing token lacks a digit; two exponent letters can never form a number.
    number = (
        F.when(~c.rlike("[0-9]"), None)
        .when(c.rlike(_PLAIN_NUMBER), c.try_cast("double"))
        .when(c.rlike(_TWO_EXPONENTS), None)
        .when(c.rlike("[()%]"), decorated)
        .otherwise(read(F.regexp_replace(c, _NOT_NUMBER_CHARS, "")))
    )
    return F.when(c.rlike(_STRICT_NUMBER), number) if strict else number


def _iso_time(c: Column) -> Column:
    """The UTC time of an ISO text; offsets of up to a day, which a cast would refuse beyond 18 hours.

    One rewriting gives the local time its canonical form: generated code grows with every pattern that is named.
    """
    spread = F.regexp_replace(c, _ISO, "$1-$2$4-$3$5 $6:$8:$9.$10")
    text = F.regexp_replace(F.regexp_replace(spread, r"(?<= \d\d)::\.$", ":00"), r"[ :.]+$", "")
    # The offset as the number of its digits, hhmm: in minutes that is 40 less for every hour.
    digits = F.rpad(F.translate(F.regexp_extract(c, _ISO, 11), ":Z", ""), 5, "0").try_cast("int")
    minutes = digits - F.lit(40) * F.call_function("div", digits, F.lit(100)).cast("int")
    return text.try_cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def _week_text(c: Column) -> Column:
    """An ISO week date as the ISO date of its day (Monday, where none is named); NULL for a week the year hasn't."""
    named = F.regexp_replace(c, _ISO_WEEK, "$1$2$4$3$5")
    fourth = F.concat(F.substring(named, 1, 4), F.lit("-01-04")).try_cast("date")  # is in the first week
    days = F.substring(named, 5, 2).try_cast("int") * 7 + F.rpad(F.substring(named, 7, 1), 1, "1").try_cast("int") - 8
    date = F.date_add(F.trunc(fourth, "week"), days)
    # A week that the year hasn't is one of the year before or after, and no day lies beyond the year 9999.
    there = F.extract(F.lit("YEAROFWEEK"), date) * 100 + F.weekofyear(date)
    shown = F.concat(F.substring(date.cast("string"), 1, 10), F.regexp_extract(c, _ISO_WEEK, 6))
    return F.when((there == F.substring(named, 1, 6).try_cast("int")) & (date <= F.lit("9999-12-31").cast("date")), shown)


def parse_date(c: Column, kind: str = "string") -> Column:
    """Timestamp of an ISO 8601 text or one of the accepted layouts, month before day; UTC.

    All layouts are rewritten to one canonical text by patterns and cast once,
    so no cell costs a formatter exception.
    """
    if kind == "temporal":
        return c.cast("timestamp")
    if kind == "integral":
        # Eight digits are an ISO basic date.
        return parse_date(c.cast("string"))
    if kind != "string":
        return F.lit(None).cast("timestamp")

    spaced = collapse_text(F.translate(c, "/", "-"))
    month_name = F.lower(F.substring(F.regexp_extract(c, _NAMED_MONTH, 1), 1, 3))
    month = (F.position(month_name, F.lit("".join(m[:3] for m in MONTHS))) + 2) / 3
    named = F.concat_ws(
        "-",
        F.regexp_extract(c, _NAMED_MONTH, 3),
        month.cast("int").cast("string"),
        F.regexp_extract(c, _NAMED_MONTH, 2),
    )
    return (
        F.when(~c.rlike(_DATE_HINT), None)
        .when(c.rlike(_DASHED) | c.rlike(_SLASHED), spaced.try_cast("timestamp"))
        .when(c.rlike(_ISO) | c.rlike(_ISO_WEEK), _iso_time(F.when(c.rlike(_ISO_WEEK), _week_text(c)).otherwise(c)))
        .when(
            c.rlike(_YEAR_LAST),
            F.coalesce(
                F.regexp_replace(c, _YEAR_LAST, "$3-$1-$2").try_cast("timestamp"),
                F.regexp_replace(c, _YEAR_LAST, "$3-$2-$1").try_cast("timestamp"),
            ),
        )
        .when(c.rlike(_NAMED_MONTH), named.try_cast("timestamp"))
    )


def parse_boolean(c: Column, kind: str = "string") -> Column:
    if kind == "boolean":
        return c
    if kind == "integral":
        return F.when(c == 1, True).when(c == 0, False)
    if kind == "decimal":
        return parse_boolean(c.cast("string"))
    if kind != "string":
        return F.lit(None).cast("boolean")
    return F.when(c.rlike(_TRUE), True).when(c.rlike(_FALSE), False)


def iso_text(ts: Column) -> Column:
    """ISO 8601 text; the fraction is written only when there is one."""
    micros = F.unix_micros(ts) % 1_000_000
    fraction = F.when(micros != 0, F.date_format(ts, ".SSSSSS")).otherwise("")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction)


def standardize_cell(
    c: Column,
    detected_type: str,
    kind: str = "string",
    case: str = "lower",
    strip_spaces: bool = True,
    strict_numbers: bool = False,
) -> Column:
    """Typed value of a cell; missing and unparseable cells become NULL."""
    if detected_type == NUMERIC:
        return parse_number(c, kind, strict_numbers)
    if detected_type == DATE:
        return parse_date(c, kind)
    if detected_type == BOOLEAN:
        return parse_boolean(c, kind)
    text = text_of(c, kind)
    if detected_type == CATEGORICAL:
        value = normalize_text(text, case, strip_spaces)
    else:
        value = collapse_text(text)
    return F.when(~is_missing(c, kind), value)


def standardize(df: DataFrame, types: dict[str, str], **options) -> DataFrame:
    """Project every typed column to its standardized value; other columns pass through."""
    by_kind = kinds(df, [c for c in df.columns if c in types])
    return df.select(
        *[
            standardize_cell(col(c), types[c], by_kind[c], **options).alias(c) if c in types else col(c)
            for c in df.columns
        ]
    )
