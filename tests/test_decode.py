import datetime as dt

from pyspark.sql import functions as F

from conftest import values
from sediment.sources import decode, feeds


def messages(spark, *bodies):
    return spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "n int, value string")


def test_broken_message_and_bad_value_are_told_apart(spark):
    raw = messages(spark, '{"a": 1, "b": "x"}', '{"a": 1', '{"a": "no", "b": "y"}', "", None, '{"b": "z"}')
    got = values(decode.decode_json(raw, "a BIGINT, b STRING").select("n", "a", "b", "_error"), "n")
    assert got == [
        (0, 1, "x", None),
        (1, None, None, decode.MALFORMED),
        (2, None, "y", "bad value: a"),
        (3, None, None, decode.MALFORMED),
        (4, None, None, decode.MALFORMED),
        (5, None, "z", None),
    ]


def test_lenient_turns_bad_values_into_null(spark):
    raw = messages(spark, '{"a": "no"}', '{"a": "40.66"}')
    got = values(decode.decode_json(raw, "a INT", strict=False).select("a", "_error"), "n")
    assert got == [(None, None), (40, None)]


def test_root_nested_path_and_array_index(spark):
    raw = messages(spark, '{"data": {"u": {"id": 7}, "tags": ["p", "q"]}}')
    rows = decode.decode_json(
        raw, "uid BIGINT, tag STRING", paths={"uid": "$.u.id", "tag": "$.tags[1]"}, root="$.data"
    )
    assert values(rows.select("uid", "tag", "_error")) == [(7, "q", None)]


def test_outer_array_keeps_good_neighbours(spark):
    raw = messages(spark, '[{"a": 1}, {"a": "x"}, {"a": 3}]', "[]", "{oops")
    got = values(decode.decode_json(raw, "a BIGINT", outer_array=True).select("n", "a", "_error"), "n", "a")
    assert (0, 1, None) in got and (0, 3, None) in got and (0, None, "bad value: a") in got
    assert (2, None, decode.MALFORMED) in got


def test_large_integers_keep_every_digit(spark):
    raw = messages(spark, '{"a": 9007199254740993}')
    assert values(decode.decode_json(raw, "a BIGINT").select("a")) == [(9007199254740993,)]


def test_crash_line_by_position(spark):
    cells = ["09/11/2021", "2:39", "QUEENS", "11101", "40.66", "-73.9", '"(40.66, -73.9)"', '"MAIN ST, N"', "", ""]
    cells += ["0"] * 8 + ["Speed", "Other", "", "", "", "4455765", "Sedan", "Taxi", "", "", ""]
    raw = messages(spark, ",".join(cells), "only,two")
    rows = decode.decode_csv(
        raw,
        feeds.CRASH_SCHEMA,
        feeds.positional(feeds.CRASH_WIDTH, feeds.CRASH_POSITIONS),
        derived=feeds.crash_derived(),
    )
    good, bad = decode.split_good_bad(rows)
    got = good.first()
    assert (got.COLLISION_ID, got.CRASH_DATE) == (4455765, dt.datetime(2021, 9, 11, 2, 39))
    assert (got.LATITUDE, got.LONGITUDE) == (40, -73)
    assert (got.LOCATION, got.ON_STREET_NAME) == ("(40.66, -73.9)", "MAIN ST, N")
    assert (got.VEHICLE_TYPE_CODE_1, got.VEHICLE_TYPE_CODE_2) == ("Sedan", "Taxi")
    assert bad.select("n").collect()[0]["n"] == 1


def test_weather_line_by_position(spark):
    cells = [f"c{i}" for i in range(feeds.WEATHER_WIDTH)]
    cells[1] = "2015-01-01T00:51:00"
    rows = decode.decode_csv(
        messages(spark, ",".join(cells)),
        feeds.WEATHER_SCHEMA,
        feeds.positional(feeds.WEATHER_WIDTH, feeds.WEATHER_POSITIONS),
        derived=feeds.weather_derived(),
    )
    got = rows.first()
    assert got._error is None
    assert got.WEATHER_DATE == dt.datetime(2015, 1, 1, 0, 51)
    assert (got.NAME, got.HourlyPrecipitation, got.HourlyVisibility, got.HourlyWindSpeed) == ("c5", "c11", "c19", "c23")


def test_counters(spark):
    raw = messages(spark, '{"user_id": 1}', '{"user_id": 0}', '{"user_id": null}', "{")
    decoded = decode.decode_json(raw, "user_id BIGINT")
    got = decode.load_counters(decoded, F.col("user_id") > 0).first()
    assert tuple(got) == (4, 1, 2, 1)


def test_an_empty_array_has_no_rows_and_no_error(spark):
    messages = spark.createDataFrame([("[]",), ('[{"a": 1}]',), ("{",), (None,)], "value string")
    got = decode.decode_json(messages, "a BIGINT", outer_array=True)
    assert sorted((r["a"] or 0, r["_error"] is not None) for r in got.collect()) == [(0, True), (0, True), (1, False)]
