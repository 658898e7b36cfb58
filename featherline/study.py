"""Values of the field study the library serves.

These are fixed values: they must equal the study's own for its results to be
reproduced.  Every operator takes them as arguments.
"""

from __future__ import annotations

# Hours between these days are never flight hours.
MASK = ("06-15", "08-01")

# Rules of a migration period.
PERIOD_RULES = {
    "gap_days": 5,
    "window_days": 5,
    "min_flights": 3,
    "min_hours": 16,
    "last_spring_yday": 150,
}

# First dates that no longer count, for hours and for days.
HOURLY_CUTS = {"91A": "2023-06-10", "92A": "2023-06-10"}
DAILY_CUTS = {"ACA": "2024-02-29", "ACB": "2024-03-23"}

# Fixed values: (tag, at least, at most, becomes) for flights and for days.
FLIGHT_RECODES = [
    ("ACA", 10.0, None, None),
    ("ACB", 10.0, None, None),
    ("DB6", 8.0, 8.0, None),
    ("DB6", 10.0, 10.0, 8.0),
]
DAILY_RECODES = [("AC2", 7.0, 7.0, 9.0)]

# Fixed values: (tag, period, side kept, days added to the border).
PERIOD_CUTS = [("ACA", 8.0, "until", 1), ("ACB", 8.0, "until", 1), ("AC2", 2.0, "from", 1)]

# Season of each period, in calendar order.
FLIGHT_SEASONS = {"Autumn": [2, 3, 4, 5, 6, 7, 8], "Spring": [10, 11, 12]}
DAILY_SEASONS = {
    "Breeding": [1, 13],
    "Autumn": [2, 3, 4, 5, 6, 7, 8],
    "Wintering": [9],
    "Spring": [10, 11, 12],
}

# Barrier band in degrees north and the period that crosses it.
AUTUMN_BARRIER = {"low": 18.0, "high": 37.0, "period": 4}
SPRING_BARRIER = {"low": 12.0, "high": 30.0, "period": 12}
SPRING_BOX_LIMITS = (0.0, 20.0)

# Tags left out of the latitude profiles, and their days of the year.
AUTUMN_PROFILE = {"first": 166, "last": 365, "exclude": ["90A"]}
SPRING_PROFILE = {"first": 1, "last": 165, "exclude": ["91A", "90A"], "period_above": 9}

# Default parameters, as dotted keys.
DEFAULT_PARAMS = {
    "tag_set_map.extent": "5,60,-27,57",
    "tag_set_map.scale": "2",
    "tag_set_map.include_min_duration": "0",
    "pressure_map.margin": "10",
    "pressure_map.sd": "0.8",
    "pressure_map.thr_mask": "0.9",
    "pressure_map.log_linear_pooling_weight": "ln(n)/n",
    "graph_create.thr_likelihood": "0.9",
    "graph_create.thr_gs": "150",
    "graph_set_movement.shape": "6",
    "graph_set_movement.scale": "7",
    "graph_set_movement.method": "gamma",
    "graph_set_movement.low_speed_fix": "20",
    "graph_set_movement.zero_speed_ratio": "1.5",
}

# Fixed values: (first day, last day, known stationary periods, longitude) per tag.
TAG_WINDOWS = {
    "91D": ("2022-06-15", "2023-05-20", "1,-1", "13.44"),
    "90E": ("2022-06-15", "2023-05-17", "1,-1", "13.43"),
    "92A": ("2022-06-15", "2023-06-02", "1,-1", "13.43"),
    "91A": ("2022-06-15", "2023-03-12", "1", "13.43"),
    "AC4": ("2023-06-15", "2024-05-07", "1,-1", "13.43"),
    "AC2": ("2023-06-15", "2024-03-18", "1", "13.43"),
    "ACA": ("2023-06-15", "2024-04-09", "1", "13.43"),
    "ACB": ("2023-06-15", "2024-03-23", "1", "13.43"),
    "DBA": ("2024-06-15", "2025-06-07", "1,-1", "13.43"),
    "AC0": ("2023-06-15", "2024-03-09", "1", "13.43"),
    "DB6": ("2024-06-15", "2024-12-21", "1", "13.43"),
}

# Other parameters that differ from the default.
TAG_PARAMS = {
    "AC4": {"pressure_map.sd": "0.9"},
    "AC0": {
        "pressure_map.sd": "0.9",
        "tag_set_map.extent": "7,46,-23,57",
        "tag_set_map.scale": "2",
    },
}
KNOWN_LATITUDE = "55.7"


def param_rows() -> list[tuple[str, str, str]]:
    """The parameters as rows of ``id, key, value``."""
    rows = [("default", k, v) for k, v in DEFAULT_PARAMS.items()]
    for tag, (start, end, staps, lon) in TAG_WINDOWS.items():
        own = {
            "tag_create.crop_start": start,
            "tag_create.crop_end": end,
            "tag_set_map.known.stap_id": staps,
            "tag_set_map.known.known_lon": lon,
            "tag_set_map.known.known_lat": KNOWN_LATITUDE,
        }
        rows += [(tag, k, v) for k, v in (own | TAG_PARAMS.get(tag, {})).items()]
    return rows
