"""Rules of single functions that the tables' values don't reach."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import dates as D
from larkspur.functions import json as J
from larkspur.functions import logic as L
from larkspur.functions import numbers as N
from larkspur.functions import text as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: S.ascii_code(F.lit("é")), 195), (lambda: S.ascii_code(F.lit("")), 0), (lambda: S.char_of(F.lit(256 * 65 + 66)), "AB"), (lambda: S.char_of(F.lit(None).cast("int"), F.lit(67)), "C"), (lambda: S.lpad(F.lit("abc"), 2), "ab"),
        (lambda: S.lpad(F.lit("a"), 3, ""), "a"), (lambda: S.left(F.lit("abc"), -1), ""), (lambda: S.substr(F.lit("abc"), -2, 1), "b"), (lambda: S.substr(F.lit("abc"), 9), ""), (lambda: S.insert(F.lit("abc"), 9, 1, F.lit("x")), "abc"), (lambda: S.insert(F.lit("abcdef"), 3, 100, F.lit("x")), "abx"),
        (lambda: S.unhex(F.lit("141")), "\x01A"), (lambda: S.unhex(F.lit("4G")), None), (lambda: S.find_in_set(F.lit("c"), F.lit("a,b,c")), 3), (lambda: S.instr(F.lit("abc"), F.lit("")), 1), (lambda: S.concat_ws(F.lit(None).cast("string"), F.lit("a")), None),
        (lambda: S.like(F.lit("50%"), "50!%", "!"), True), (lambda: S.regexp_substr(F.lit("abc"), "z"), ""), (lambda: S.quote(F.lit("a\\b")), "'a\\\\b'"), (lambda: S.get_format("datetime", "usa"), "%Y-%m-%d %H.%i.%s"),
        (lambda: N.div(F.lit(-7), F.lit(2)), -3), (lambda: N.div(F.lit(7), F.lit(0)), None), (lambda: N.truncate(F.lit(-1.999), 2), -1.99), (lambda: N.truncate(F.lit(1234.5), -2), 1200.0), (lambda: N.conv(F.lit("ff"), 16, 10), "255"), (lambda: N.conv(F.lit("1"), 1, 10), None),
        (lambda: N.crc32(F.lit("abc"), 0), 891568578), (lambda: N.leading_number(F.lit(" 1.5e2xyz")), 150.0), (lambda: N.uncompress(F.lit(b"junkjunk")), None), (lambda: N.sha2(F.lit("a"), 100), None), (lambda: N.log(F.lit(8.0), 2), 3.0), (lambda: N.log(F.lit(8.0), 1), None),
        (lambda: L.greatest(F.lit(1), F.lit(None).cast("int")), None), (lambda: L.decode_oracle(F.lit(5), 1, "a"), None), (lambda: L.in_list(F.lit(9), 1, None), None),
        (lambda: D.week(F.lit("2008-01-01"), 1), 1), (lambda: D.week(F.lit("2000-01-01"), 0), 0), (lambda: D.week(F.lit("2000-01-01"), 2), 52), (lambda: D.week(F.lit("2008-12-31"), 1), 53), (lambda: D.yearweek(F.lit("1987-01-01")), 198652), (lambda: D.week(F.lit("1998-12-31"), 3), 53),
        (lambda: D.makedate(70, 1).cast("string"), "1970-01-01"), (lambda: D.makedate(69, 1).cast("string"), "2069-01-01"), (lambda: D.period_add(9912, 1), 200001), (lambda: D.sec_to_time(F.lit(-4000000)), "-838:59:59"), (lambda: D.time_format(F.lit("100:05:06"), "%H %k %h %l"), "100 100 04 4"),
        (lambda: D.timediff(F.lit("10:00:00"), F.lit("2024-01-01 00:00:00")), None), (lambda: D.extract("DAY_MICROSECOND", F.lit("2024-01-02 03:04:05.000006")), 2030405000006), (lambda: D.date_format(F.lit("2024-03-22"), "%D %w %U"), "22nd 5 11"),
        (lambda: D.timestampdiff("YEAR", F.lit("2020-05-01"), F.lit("2024-04-30")), 3), (lambda: D.timestampdiff("DAY", F.lit("2024-01-02"), F.lit("2024-01-01 12:00:00")), 0), (lambda: D.dayname(F.lit("nonsense")), None), (lambda: D.str_to_date(F.lit("99"), "%d"), None),
        (lambda: D.to_days(F.lit("2007-10-07")), 733321), (lambda: D.date_add(F.lit("2024-01-31"), 1, "MONTH").cast("string"), "2024-02-29 00:00:00"), (lambda: D.date_sub(F.lit("2024-01-01"), "1 1:1:1.5", "DAY_MICROSECOND").cast("string"), "2023-12-30 22:58:58.5"),
        (lambda: J.json_depth(F.lit('[1, {"a": [2]}]')), 4), (lambda: J.json_length(F.lit('{"a": 1, "b": 2}')), 2), (lambda: J.json_keys(F.lit("[1]")), None), (lambda: J.json_extract(F.lit('{"a b": {"c": [1,2]}}'), '$."a b".c[*]'), "[1, 2]"), (lambda: J.json_contains(F.lit("[1,2,[3]]"), "[1]"), 1),
        (lambda: J.json_contains(F.lit('{"a": 1}'), '{"a": true}'), 0), (lambda: J.json_value(F.lit("[true]"), "$[0]"), "1"), (lambda: J.json_unquote(F.lit('"a\\nb"')), "a\nb"), (lambda: J.json_merge_preserve(F.lit("1"), F.lit("[2]")), "[1, 2]"), (lambda: J.json_array_append(F.lit("5"), ("$", 6)), "[5, 6]"),
        (lambda: J.json_remove(F.lit("[1,[2,3]]"), "$[1][0]"), "[1, [3]]"), (lambda: J.json_insert(F.lit('{"a": 1}'), ("$.b", None)), '{"a": 1, "b": null}'), (lambda: J.json_type(F.lit("1.5")), "DOUBLE"), (lambda: J.json_equals(F.lit("1"), F.lit("1.0")), 1), (lambda: J.json_valid(F.lit("NaN")), 0),
        (lambda: J.json_search(F.lit('["10%", "10x"]'), "all", "10\\%"), '"$[0]"'),
    ],
)
def test_value(spark, make, want):
    assert value(spark, make()) == want


def test_errors(spark):
    with pytest.raises(Exception, match="out of range"):
        value(spark, N.exp(F.lit(1e4)))
    with pytest.raises(ValueError, match="path"):
        J.parse_path("a.b")


def test_legacy_crypt_round_trip():
    s = S._Shuffle(b"key")
    data = bytes(range(256))
    assert S._Shuffle(b"key").decode(s.encode(data)) == data
    assert S._Shuffle(b"other").decode(S._Shuffle(b"key").encode(data)) != data


def test_legacy_crypt_of_batches(spark):
    """Whole arrays as text by text, with nulls, empty, long and sliced ones; the key is set up once, not for each text."""
    texts = ["", None, "a", "é" * 9, "x y " * 5000, *[f"text {i}" * (i % 5) for i in range(60)], None]
    one = lambda t, of: None if t is None else getattr(S._Shuffle(b"pass word"), of)(t)
    made = S._Batches(b"pass word")
    made.shuffle.__class__ = type("Counted", (S._Shuffle,), {"draw": lambda self: (drawn.append(1), S._Shuffle.draw(self))[1]})
    drawn = []
    items = S.pa.array([None if t is None else t.encode() for t in texts])
    for part in (items[:0], items[5:30], items, items[1:2]):
        coded = made.encode(part)
        assert coded.to_pylist() == [one(t, "encode") for t in part.to_pylist()]
        assert made.decode(coded).to_pylist() == part.to_pylist()
    assert len(drawn) <= 2 * 20_000
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", "t", S.encode("t", "pass word").alias("c"), S.decode(S.encode("t", "pass word"), "pass word").alias("p"), S.decode(S.encode("t", "pass word"), "other").alias("o")).collect()
    for r in got:
        c = one(None if r["t"] is None else r["t"].encode(), "encode")
        assert (None if r["c"] is None else bytes(r["c"])) == c and r["p"] == r["t"]
        assert r["o"] == (None if c is None else S._Shuffle(b"other").decode(c).decode("utf-8", "replace"))
