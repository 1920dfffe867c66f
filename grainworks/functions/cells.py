"""Cells: column expressions that test, infer, convert and render single values.

A cell is NULL or one of four kinds.  As a column it is ``STRUCT<k, b, i, f, s>`` with the kind in ``k`` and the
value in the field of that kind; homogeneous columns are kept as plain BIGINT, DOUBLE, BOOLEAN or STRING.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StringType, StructType

#: Unicode White_Space, which Rust-style trimming removes (fixed values)
WHITE_SPACE = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
TRUE_WORDS, FALSE_WORDS = ("true", "yes"), ("false", "no")
FLOAT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
CELL = "struct<k:string,b:boolean,i:bigint,f:double,s:string>"


def _between(c: Column, low, high) -> Column:
    return (c >= low) & (c <= high)


def trimmed(c: Column) -> Column:
    """Without white space at either end; a value between two visible ASCII characters is taken as it is, which is cheap to see."""
    bare = _between(F.substring(c, 1, 1), "!", "~") & _between(F.substring(c, -1, 1), "!", "~")
    return F.when(bare, c).otherwise(F.trim(c, F.lit(WHITE_SPACE)))


def has_leading_zero(t: Column) -> Column:
    """A zero before another digit, after an optional minus: such a number is a code and stays text."""
    digit = lambda at: _between(F.substring(t, at, 1), "0", "9")
    return (t.startswith("0") & digit(2)) | (t.startswith("-0") & digit(3))


def is_whole_number(t: Column) -> Column:
    return t.rlike("^-?[0-9]+$")


def may_be_number(t: Column) -> Column:
    """Starts with a sign, a point or a digit."""
    return _between(F.substring(t, 1, 1), "+", "9")


def as_int(t: Column) -> Column:
    """An optional sign and digits; the cast, whose failures are slow, is left with numbers that are too long."""
    return F.when(may_be_number(t) & _between(F.substring(t, -1, 1), "0", "9") & t.rlike("^[+-]?[0-9]+$"), t.try_cast("bigint"))


def special(t: Column) -> Column:
    """The name of an infinity or of no number, in lower case without its sign, else NULL."""
    name = F.regexp_replace(F.lower(t), r"^[+-]", "")
    return F.when(F.substring(t, 1, 1).isin(*"+-iInN") & (F.octet_length(t) <= 9), F.when(name.isin("inf", "infinity", "nan"), name))


def as_float(t: Column) -> Column:
    name, sign = special(t), F.when(t.startswith("-"), -1.0).otherwise(1.0)
    return (
        F.when(may_be_number(t) & t.rlike(FLOAT), t.try_cast("double"))
        .when(name == "nan", F.lit(float("nan")))
        .when(name.isNotNull(), sign * F.lit(float("inf")))
    )


def is_int(t: Column) -> Column:
    return ~has_leading_zero(t) & as_int(t).isNotNull()


def is_float(t: Column) -> Column:
    return ~has_leading_zero(t) & ((may_be_number(t) & t.rlike(FLOAT)) | special(t).isNotNull())


def is_bool(t: Column) -> Column:
    return (F.octet_length(t) <= 5) & F.lower(t).isin(*TRUE_WORDS, *FALSE_WORDS)


def is_true(t: Column) -> Column:
    return F.lower(t).isin(*TRUE_WORDS)


#: bits of ``code``: not blank, and the tests that a value passes
SOME, INT, REAL, NUMBER, BOOL, DATE = 1, 2, 4, 8, 16, 32


def code(t: Column) -> Column:
    """All tests of a trimmed value at once, as bits: each value is looked at once, and only by the tests that its first character allows."""
    bit = lambda test, n: F.when(test, n).otherwise(0)
    number = F.when(t.rlike(FLOAT), NUMBER + bit(~is_whole_number(t), REAL)).when(special(t).isNotNull(), NUMBER + REAL).otherwise(0)
    numeric = F.when(as_int(t).isNotNull(), F.when(has_leading_zero(t), 0).otherwise(NUMBER + INT + bit(t.startswith("+"), REAL))).otherwise(bit(looks_like_date(t), DATE) + F.when(has_leading_zero(t), 0).otherwise(number))
    other = bit(special(t).isNotNull(), NUMBER + REAL) + bit(is_bool(t), BOOL)
    return F.when(t.isNull() | (t == ""), 0).when(may_be_number(t), SOME + numeric).otherwise(SOME + other)


def looks_like_date(t: Column) -> Column:
    """Digits and two or more of - / . in 6 to 10 characters; the shape only."""
    return _between(F.octet_length(t), 6, 10) & t.rlike(r"^[0-9./-]{6,10}$") & (F.length(F.regexp_replace(t, "[0-9]", "")) >= 2)


def infer(raw: Column) -> Column:
    """A cell from text by itself, as one expression; ``coded`` and ``of_code`` do the same for many columns without repeating work."""
    t = trimmed(raw)
    return of_code(t, code(t))


def coded(df: DataFrame, values: dict[str, Column], keep: list[str] = ()) -> DataFrame:
    """The columns ``keep`` and, for each name, the trimmed text (``name_t``) and its code (``name``).

    All values of a row go through one lambda each: the tests are in the plan once, however many columns there are (as a
    projection of every column they would make methods too long for the JVM to compile), and each step is a projection
    of its own, so that a value is trimmed once and tested once whatever is made of it later.
    """
    both = _codes(df.select(*keep, F.array(*values.values()).alias("_v")), keep) if values else df.select(*keep)
    return both.select(*keep, *[x for i, n in enumerate(values) for x in (F.get("_t", F.lit(i)).alias(f"{n}_t"), F.get("_k", F.lit(i)).alias(n))])


def _codes(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, the trimmed texts ``_t`` and the codes ``_k`` of an array ``_v``."""
    return df.select(*keep, F.transform("_v", trimmed).alias("_t")).select(*keep, "_t", F.transform("_t", code).alias("_k"))


def inferred(df: DataFrame, values: dict[str, Column], keep: list[str] = ()) -> DataFrame:
    """The columns ``keep`` and, under each name, the cell of a raw text column."""
    if not values:
        return df.select(*keep)
    made = _codes(df.select(*keep, F.array(*values.values()).alias("_v")), keep).select(*keep, F.zip_with("_t", "_k", lambda t, k: of_code(t, k)).alias("_c"))
    return made.select(*keep, *[F.get("_c", F.lit(i)).alias(n) for i, n in enumerate(values)])


def has(bits: Column, test: int) -> Column:
    return bits.bitwiseAND(test) > 0


def of_code(t: Column, bits: Column, kinds: int = INT | REAL | BOOL) -> Column:
    """A cell of a trimmed text: of the first of ``kinds`` that its code allows, else text; NULL if it is blank."""
    tests = [(k, name) for k, name in ((INT, "int"), (REAL, "float"), (BOOL, "bool")) if k & kinds]
    kind = F.lit("text")
    for k, name in reversed(tests):
        kind = F.when(has(bits, k), name).otherwise(kind)
    only = lambda k, v: F.when(has(bits, k) & (~has(bits, INT) if k == REAL and kinds & INT else F.lit(True)), v) if k & kinds else F.lit(None)
    other = ~has(bits, kinds) if kinds else F.lit(True)
    cell = F.struct(kind.alias("k"), only(BOOL, is_true(t)).cast("boolean").alias("b"), only(INT, t.try_cast("bigint")).cast("bigint").alias("i"), only(REAL, as_float(t)).cast("double").alias("f"), F.when(other, t).alias("s"))
    return F.when(bits > 0, cell)


def double_text(d: Column) -> Column:
    """A double as digits without exponent or a trailing ``.0``."""
    s = d.cast("string")
    sign, head, tail, power = (F.regexp_extract(s, r"^(-?)(\d)\.(\d+)E(-?\d+)$", g) for g in (1, 2, 3, 4))
    tail = F.when(tail == "0", "").otherwise(tail)
    power = power.try_cast("int")
    digits = F.concat(head, tail)
    large = F.when(F.length(tail) <= power, F.rpad(digits, power + 1, "0")).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(400))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    return (
        F.when(F.isnan(d), "NaN")
        .when(d == float("inf"), "inf")
        .when(d == float("-inf"), "-inf")
        .when(s.contains("E"), F.concat(sign, F.when(power >= 0, large).otherwise(small)))
        .otherwise(F.regexp_replace(s, r"\.0$", ""))
    )


def is_cell(t: DataType) -> bool:
    return isinstance(t, StructType) and t.fieldNames() == ["k", "b", "i", "f", "s"]


def kind_of(c: Column, t: DataType) -> Column:
    """The kind of each value, NULL for null: a literal for plain columns."""
    if is_cell(t):
        return c["k"]
    name = "int" if isinstance(t, LongType) else "float" if isinstance(t, DoubleType) else "bool" if isinstance(t, BooleanType) else "text"
    return F.when(c.isNotNull(), F.lit(name))


def export_text(c: Column, t: DataType) -> Column:
    """What the CSV sink writes for a value; null is empty."""
    if is_cell(t):
        out = F.coalesce(c["s"], c["i"].cast("string"), double_text(c["f"]), c["b"].cast("string"))
    else:
        out = double_text(c) if isinstance(t, DoubleType) else c if isinstance(t, StringType) else c.cast("string")
    return F.coalesce(out, F.lit(""))


def json_text(c: Column, t: DataType) -> Column:
    """A value as a bare JSON scalar."""
    quote = lambda x: F.regexp_replace(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', "$1")
    # a bare NaN or infinity has no JSON form
    number = lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), "null").otherwise(x.cast("string"))
    if is_cell(t):
        return F.when(c["k"] == "text", quote(c["s"])).when(c["k"] == "int", c["i"].cast("string")).when(c["k"] == "float", number(c["f"])).when(c["k"] == "bool", c["b"].cast("string")).otherwise("null")
    out = number(c) if isinstance(t, DoubleType) else quote(c) if isinstance(t, StringType) else c.cast("string")
    return F.when(c.isNull(), "null").otherwise(out)


def unpacked(c: Column, kind: str) -> Column:
    return c[{"int": "i", "float": "f", "bool": "b", "text": "s"}[kind]]
