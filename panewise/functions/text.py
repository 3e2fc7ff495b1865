"""Column expressions for delimited text, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_pattern(text: str) -> str:
    """A regular expression that matches ``text`` itself."""
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in text)


# The characters up to U+0020, which count as blanks around a line.
BLANKS = "".join(chr(code) for code in range(0x21))


def strip_controls(line: Column) -> Column:
    """Drop leading and trailing characters up to U+0020 (blanks, tabs, line ends)."""
    return F.btrim(line, F.lit(BLANKS))


def drop_trailing(line: Column, delimiter: str) -> Column:
    """Remove the delimiters at the end of a line, and with them its empty last fields."""
    if len(delimiter) == 1:
        return F.rtrim(line, F.lit(delimiter))
    return F.regexp_replace(line, f"(?:{literal_pattern(delimiter)})+\\z", "")


def split_fields(line: Column, delimiter: str) -> Column:
    """Fields of a stripped line; trailing empty fields do not count.

    A line of nothing but delimiters has no fields, an empty line has one.
    """
    stripped = strip_controls(line)
    kept = drop_trailing(stripped, delimiter)
    no_fields = (kept == "") & (stripped != "")
    fields = F.split(kept, literal_pattern(delimiter))
    return F.when(no_fields, F.array().cast("array<string>")).otherwise(fields)


def to_int(field: Column) -> Column:
    """32-bit integer, or null: signs and digits only, no blanks, no overflow."""
    return F.when(field.rlike(r"\A[+-]?[0-9]+\z"), field.try_cast("int"))


def to_double(field: Column) -> Column:
    """Double, or null. Blanks around the number are allowed.

    Spark also reads ``inf``/``nan`` in any case; only the spellings ``NaN`` and
    ``Infinity`` are numbers here. No finite number has an ``n`` in it.
    """
    finite = ~field.contains("n") & ~field.contains("N")
    exact = field.rlike(r"\A[\x00-\x20]*[+-]?(Infinity|NaN)[\x00-\x20]*\z")
    return F.when(finite | exact, field.try_cast("double"))


CONVERTERS = {"int": to_int, "double": to_double, "string": lambda field: field}


# The blank-separated fields (counted from 0) that may hold an address.
ADDRESS_FIELDS = (3, 5)

# A dotted address of exactly five parts; empty parts count, trailing dots do not.
_FIVE_PARTS = r"\A([^.]*)\.([^.]*)\.([^.]*)\.([^.]*)\.([^.]+)\.*\z"


def split_address(field: Column) -> Column:
    """``a.b.c.d.e`` becomes ``a.b.c d.e`` (network, then host and port)."""
    return F.regexp_replace(field, _FIVE_PARTS, "$1.$2.$3 $4.$5")


def normalise_addresses(fields: Column, positions: tuple[int, ...] = ADDRESS_FIELDS) -> Column:
    """A blank-separated line with its addresses split, from the fields of that line.

    A position the line does not reach is null and adds nothing.
    """
    pieces, done = [], 0
    for position in sorted(positions):
        pieces.append(F.slice(fields, done + 1, position - done))
        pieces.append(split_address(F.get(fields, F.lit(position))))
        done = position + 1
    pieces.append(F.slice(fields, F.lit(done + 1), F.greatest(F.size(fields), F.lit(1))))
    return F.concat_ws(" ", *pieces)


def join_fields(columns: list[str], delimiter: str) -> Column:
    """One delimited line; a null becomes an empty field so that positions hold."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.concat_ws(delimiter, *parts)
