"""Declared schemas of the input tables."""

HOURLY = "id string, date timestamp, acc3 int, acc4 int, acc5 int, act_score double"
PRESSURE = "id string, date timestamp, temp_c double, pressure_hpa double"
TWILIGHT_TEXT = "series string, timestamp string, value double, label string"
PATH = (
    "id string, date timestamp, lat double, lon double, stap_id double, "
    "sunrise timestamp, sunset timestamp"
)
PARAMS = "id string, key string, value string"
REANALYSIS = (
    "lat double, lon double, ts timestamp, altitude double, surface_pressure double, "
    "temperature_2m double, dewpoint_temperature_2m double"
)
