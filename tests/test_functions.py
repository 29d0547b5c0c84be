import datetime as dt

from pyspark.sql import functions as F

from conftest import values
from sediment.functions import numbers, sketches, text, times


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_day_from_millis_uses_utc_and_rounds_down(spark):
    assert one(spark, times.day_from_millis(F.lit(1704067199999))) == dt.date(2023, 12, 31)
    assert one(spark, times.day_from_millis(F.lit(1704067200000))) == dt.date(2024, 1, 1)


def test_us_date_with_one_digit_parts(spark):
    got = one(spark, times.from_us_date_and_time(F.lit("1/5/2024"), F.lit("7:03")))
    assert got == dt.datetime(2024, 1, 5, 7, 3)
    assert one(spark, times.from_us_date_and_time(F.lit("x"), F.lit("7:03"))) is None


def test_hour_label(spark):
    ts = F.lit("2024-01-03 05:00:00").cast("timestamp")
    assert one(spark, times.hour_label(ts)) == "03 Jan 2024 05:00"


def test_slots_include_both_ends(spark):
    start = F.lit("2024-01-03 05:29:59").cast("timestamp")
    got = one(spark, times.slots_covered(start, F.lit(1801).cast("long"), 1800))
    assert [s.minute for s in got] == [0, 30, 0]


def test_cut_decimals_toward_zero(spark):
    assert one(spark, numbers.cut_decimals(F.lit(-1.29), 1)) == -1.2
    assert one(spark, numbers.cut_decimals(F.lit(1.29), 1)) == 1.2


def test_percentage_of_nothing_is_null(spark):
    assert one(spark, numbers.percentage(F.lit(0), F.lit(0))) is None
    assert one(spark, numbers.percentage(F.lit(2), F.lit(1))) == 66.7


def test_readable_size(spark):
    sizes = [0, 1023, 1024, 1536, 5 * 1024**3]
    got = [one(spark, numbers.readable_size(F.lit(s).cast("long"))) for s in sizes]
    assert got == ["0.00 B", "1023.00 B", "1.00 KiB", "1.50 KiB", "5.00 GiB"]


def test_text_metric(spark):
    rows = spark.createDataFrame([("9",), ("10",), ("T",), ("",), (None,)], "m string")
    got = rows.agg(F.avg(numbers.lenient_double(F.col("m"))).alias("a"), F.max("m").alias("t")).first()
    assert got["a"] == 9.5
    assert got["t"] == "T"
    assert rows.where("m <> 'T'").agg(F.max("m")).first()[0] == "9"


def test_base64_has_no_line_breaks(spark):
    assert one(spark, text.base64_text(F.lit("ab" * 100))).count("\n") == 0


def test_bitmaps_over_several_buckets(spark):
    rows = spark.createDataFrame(
        [("a", i) for i in (1, 1, 40_000, 90_000)] + [("b", i) for i in (40_000, 7)] + [("a", None)],
        "kind string, id long",
    )
    bitmaps = sketches.id_bitmaps(rows, ["kind"], "id")
    assert values(sketches.bitmap_cardinality(bitmaps, ["kind"], "n"), "kind") == [("a", 3), ("b", 2)]
    assert values(sketches.set_sizes(bitmaps, "kind", [("a", "b")])) == [("a", "b", 1, 4)]
    merged = sketches.union_bitmaps(bitmaps.select("bucket", "bitmap"), [])
    assert values(sketches.bitmap_cardinality(merged, [], "n")) == [(4,)]
