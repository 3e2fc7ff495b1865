"""Rules for delimited lines and addresses."""

import pytest

from panewise.sources.delimited import declare, line_counts, parse, split_addresses
from panewise.operators.sinks import write_delimited
from panewise.session import shared_folder
from tests.conftest import rows


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


@pytest.mark.parametrize(
    "line, expected",
    [
        ("1,2", (1, 2)),
        (" 3,4 ", (3, 4)),
        ("\t5,6\r", (5, 6)),
        ("1,2,", (1, 2)),
        ("1,2,,,", (1, 2)),
        ("+1,-2", (1, -2)),
        ("007,2", (7, 2)),
        ("1, 2", None),
        ("1,x", None),
        ("1,2.0", None),
        ("1", None),
        ("1,2,3", None),
        ("1,,2", None),
        (",2", None),
        (",", None),
        ("", None),
        ("2147483647,-2147483648", (2147483647, -2147483648)),
        ("2147483648,1", None),
        ("1,-", None),
    ],
)
def test_integers(spark, line, expected):
    got = rows(parse(lines(spark, line), "a int, b int", ","))
    assert got == ([expected] if expected else [])


def test_null_line_is_rejected(spark):
    df = spark.createDataFrame([(None,), ("1,2",)], "value string")
    assert rows(parse(df, "a int, b int", ",")) == [(1, 2)]
    assert rows(line_counts(df, "a int, b int", ",")) == [(2, 1, 1)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("1.5", 1.5),
        ("x, 2.5 ", 2.5),
        ("1e3", 1000.0),
        ("-.5", -0.5),
        ("3", 3.0),
        ("Infinity", float("inf")),
        ("-Infinity", float("-inf")),
        ("1e400", float("inf")),
        ("inf", None),
        ("nan", None),
        ("infinity", None),
        ("one", None),
    ],
)
def test_doubles(spark, text, expected):
    line = text if "," in text else f"x,{text}"
    got = rows(parse(lines(spark, line), "s string, d double", ","))
    assert got == ([("x", expected)] if expected is not None else [])


def test_not_a_number(spark):
    ((value,),) = rows(parse(lines(spark, "NaN"), "d double", ","))
    assert value != value


def test_one_string_column(spark):
    df = lines(spark, "", ",", ",,", "a", "a,", "a,b", " a ")
    assert rows(parse(df, "s string", ",")) == [("",), ("a",), ("a",), ("a",)]


@pytest.mark.parametrize("delimiter", ["|", ".", "\t", "::", "*", "\\", "a+", "#"])
def test_delimiter_is_literal(spark, delimiter):
    line = delimiter.join(["1", "two", "3"]) + delimiter
    df = parse(lines(spark, line), "x int, y string, z int", delimiter)
    assert rows(df) == [(1, "two", 3)]


def test_whole_line_is_read(spark):
    fields = [str(i) for i in range(3000)]
    schema = ", ".join(f"c{i} int" for i in range(40))
    df = lines(spark, ",".join(fields), ",".join(fields[:40]))
    assert line_counts(df, schema, ",").collect()[0].n_kept == 1


def test_kept_columns(spark):
    df = spark.createDataFrame([(7, "1,2"), (8, "bad")], "id int, value string")
    assert rows(parse(df, "a int, b int", ",", keep=("id",))) == [(7, 1, 2)]


@pytest.mark.parametrize("schema", ["a long", "a", "a int b", "a int, b decimal"])
def test_only_declared_types(spark, schema):
    with pytest.raises(ValueError):
        parse(lines(spark, "1"), schema, ",")


def test_split_happens_once(spark):
    """Dropping lines must not repeat the split in a pushed-down predicate."""
    text = parse(lines(spark, "1,2"), "a int, b int", ",")._jdf.queryExecution().toString()
    physical = text[text.index("== Physical Plan ==") :]
    assert "Generate inline" in physical
    assert physical.count("split(") == 1


def test_write_and_declare(spark):
    path = shared_folder(spark, "text")
    df = spark.createDataFrame(
        [(1, "a", 2.5), (2, "b c", -1.0), (3, "", 1e20)], "n int, s string, d double"
    )
    write_delimited(df, path, ["n", "s", "d"], "|")
    declare(spark, "pw_written", "n int, s string, d double", path, "|")
    got = rows(spark.sql("SELECT * FROM pw_written"))
    assert got == [(1, "a", 2.5), (2, "b c", -1.0), (3, "", 1e20)]


@pytest.mark.parametrize(
    "field, expected",
    [
        ("131.243.1.2.80", "131.243.1 2.80"),
        ("131.243.1.2", "131.243.1.2"),
        ("1.2.3.4.5.6", "1.2.3.4.5.6"),
        ("host.80", "host.80"),
        ("a..c.d.e", "a..c d.e"),
        ("a.b.c.d.e..", "a.b.c d.e"),
        ("a.b.c.d..", "a.b.c.d.."),
    ],
)
def test_addresses(spark, field, expected):
    df = lines(spark, f"0 1 2 {field} 4 {field} 6 {field}", f"0 1 2 {field}", f"{field} 1")
    assert [r.value for r in split_addresses(df).collect()] == [
        f"0 1 2 {expected} 4 {expected} 6 {field}",
        f"0 1 2 {expected}",
        f"{field} 1",
    ]


def test_address_lines_keep_their_blanks(spark):
    df = lines(spark, "", "  ", "a  b", " a b  ", "a")
    assert [r.value for r in split_addresses(df).collect()] == ["", "", "a  b", " a b", "a"]


def test_written_lines_read_back_or_are_refused(spark):
    data = [
        (1, "plain", "x"), (2, "a|b", "x"), (3, "two\nlines", "x"), (4, "cr\r", "x"), (5, "", "x"),
        (6, "last", ""), (7, None, "x"), (8, "blank at the end", "x "), (9, " kept ", "x"),
    ]
    df = spark.createDataFrame(data, "n int, s string, e string")
    path = shared_folder(spark, "back")
    write_delimited(df, f"{path}/lines", df.columns, "|", rejects=f"{path}/rejects")
    got = declare(spark, "pw_back", "n int, s string, e string", f"{path}/lines", "|")
    assert rows(got) == [(1, "plain", "x"), (5, "", "x"), (9, " kept ", "x")]
    assert rows(spark.read.parquet(f"{path}/rejects").select("n")) == [(n,) for n in (2, 3, 4, 6, 7, 8)]
    with pytest.raises(Exception, match="would not read back"):
        write_delimited(df, f"{path}/refused", df.columns, "|")
