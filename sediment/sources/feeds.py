"""Layout of the three demonstration feeds and of the event feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from sediment.functions import times

# Table columns and the position of each stored column in the incoming CSV line.
EVENT_SCHEMA = "event_id BIGINT, user_id BIGINT, event_ts BIGINT, eviction_date DATE"

CRASH_SCHEMA = (
    "COLLISION_ID INT, CRASH_DATE TIMESTAMP, BOROUGH STRING, ZIP_CODE STRING, LATITUDE INT, "
    "LONGITUDE INT, LOCATION STRING, ON_STREET_NAME STRING, CROSS_STREET_NAME STRING, "
    "OFF_STREET_NAME STRING, CONTRIBUTING_FACTOR_VEHICLE_1 STRING, "
    "CONTRIBUTING_FACTOR_VEHICLE_2 STRING, VEHICLE_TYPE_CODE_1 STRING, VEHICLE_TYPE_CODE_2 STRING"
)
CRASH_WIDTH = 29
CRASH_POSITIONS = {
    0: "crash_day",
    1: "crash_time",
    2: "BOROUGH",
    3: "ZIP_CODE",
    4: "LATITUDE",
    5: "LONGITUDE",
    6: "LOCATION",
    7: "ON_STREET_NAME",
    8: "CROSS_STREET_NAME",
    9: "OFF_STREET_NAME",
    18: "CONTRIBUTING_FACTOR_VEHICLE_1",
    19: "CONTRIBUTING_FACTOR_VEHICLE_2",
    23: "COLLISION_ID",
    24: "VEHICLE_TYPE_CODE_1",
    25: "VEHICLE_TYPE_CODE_2",
}

WEATHER_SCHEMA = (
    "WEATHER_DATE TIMESTAMP, NAME STRING, HourlyDewPointTemperature STRING, "
    "HourlyDryBulbTemperature STRING, HourlyPrecipitation STRING, HourlyPresentWeatherType STRING, "
    "HourlyPressureChange STRING, HourlyPressureTendency STRING, HourlyRelativeHumidity STRING, "
    "HourlySkyConditions STRING, HourlyVisibility STRING, HourlyWetBulbTemperature STRING, "
    "HourlyWindDirection STRING, HourlyWindGustSpeed STRING, HourlyWindSpeed STRING"
)
WEATHER_WIDTH = 123
WEATHER_POSITIONS = {
    1: "observed",
    5: "NAME",
    9: "HourlyDewPointTemperature",
    10: "HourlyDryBulbTemperature",
    11: "HourlyPrecipitation",
    12: "HourlyPresentWeatherType",
    13: "HourlyPressureChange",
    14: "HourlyPressureTendency",
    15: "HourlyRelativeHumidity",
    16: "HourlySkyConditions",
    19: "HourlyVisibility",
    20: "HourlyWetBulbTemperature",
    21: "HourlyWindDirection",
    22: "HourlyWindGustSpeed",
    23: "HourlyWindSpeed",
}

CLICK_SCHEMA = "uid BIGINT, site STRING, vtime BIGINT"
CLICK_PATHS = {"uid": "$.uid", "site": "$.site", "vtime": "$.vtime"}
# Share of each site in the click feed, out of 201.
CLICK_SITES = {
    "https://www.example.org/": 100,
    "https://docs.example.org/": 55,
    "https://www.example.org/blog": 34,
    "https://www.example.org/community": 12,
}
CLICK_USERS = 10_000
CLICK_MAX_JITTER = 1_800
CLICK_JITTER_FACTORS = 4


def positional(width: int, positions: dict[int, str]) -> list[str | None]:
    return [positions.get(i) for i in range(width)]


def crash_derived() -> dict:
    """The crash time comes from a date and a time column."""
    joined = times.from_us_date_and_time(F.col("crash_day"), F.col("crash_time"))
    return {"CRASH_DATE": times.timestamp_text(joined)}


def weather_derived() -> dict:
    return {"WEATHER_DATE": F.col("observed")}
