"""Table schemas, fixed values of the model, and the catalogue of outcomes."""

from __future__ import annotations

ACCOUNTS = (
    "id STRING, supabase_user_id STRING, email STRING, display_name STRING, avatar_url STRING, profile_customized BOOLEAN, "
    "providers ARRAY<STRING>, auth_metadata MAP<STRING,STRING>, is_active BOOLEAN, last_seen_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP"
)
MEETUPS = "id STRING, created_by_account_id STRING, name STRING, location STRING, starts_at TIMESTAMP"
PARTICIPANTS = (
    "id STRING, meetup_id STRING, account_id STRING, created_by_account_id STRING, name STRING, travel_mode STRING, "
    "latitude DOUBLE, longitude DOUBLE, created_at TIMESTAMP"
)
HAPPENINGS = (
    "id BIGINT, lang_primary STRING, title_de STRING, title_en STRING, description_de STRING, description_en STRING, url STRING, origin_url STRING, "
    "image_url STRING, venue_name_raw STRING, street STRING, postcode STRING, city STRING, lat DOUBLE, lon DOUBLE, disappeared_at TIMESTAMP"
)
OCCURRENCES = "id BIGINT, event_id BIGINT, start_utc TIMESTAMP, start_local TIMESTAMP_NTZ, date_local DATE, all_day BOOLEAN"
TABLES = {"accounts": ACCOUNTS, "meetups": MEETUPS, "participants": PARTICIPANTS, "happenings": HAPPENINGS, "occurrences": OCCURRENCES}

MANIFEST = (
    "format_version INT, city STRING, grid_version STRING, grid STRUCT<file: STRING, n_cells: INT>, "
    "matrices MAP<STRING, STRUCT<file: STRING, build_hash: STRING, build_inputs: STRUCT<mode: STRING, departure: STRING, departure_window_min: INT>, "
    "shape: ARRAY<INT>, wall_seconds: DOUBLE, coverage_pct: DOUBLE, min_seconds: INT, max_seconds: INT, timezone: STRING>>"
)
GRID = "grid_version STRING, n_cells INT, h3_res INT, cells ARRAY<STRUCT<id: INT, h3: STRING, lat: DOUBLE, lon: DOUBLE>>"

# Fixed values.
SUPPORTED_FORMAT = 1
UNREACHABLE = 65535
DEFAULT_TIMEZONE = "Europe/Vienna"
MODES = ("walk", "bicycle", "car", "transit")
MODE_MATRIX = {"walk": "walk", "bicycle": "bike", "car": "car"}
#: Departure hours with a matrix of their own, by day class, in order of preference.
DEPARTURES = {"weekday": (8, 12, 18, 22), "saturday": (10, 14, 20), "sunday": (10, 14, 20)}
DAY_NAMES = {"weekday": "wed", "saturday": "sat", "sunday": "sun"}


def transit_keys() -> list[str]:
    return [f"transit_{DAY_NAMES[day]}{hour:02d}" for day, hours in DEPARTURES.items() for hour in hours]


# Outcome codes of data, with the status that goes with each and its text.
OUTCOMES = {
    "missing_bearer_token": (401, "Missing bearer token"),
    "invalid_bearer_token": (401, "Invalid or expired access token"),
    "unauthenticated_role": (403, "Authenticated account required"),
    "meetup_not_found": (404, "Meetup %s not found"),
    "account_not_found": (404, "Account %s not found"),
    "participant_not_found": (404, "Participant %s not found"),
    "validation_error": (422, "Request validation failed"),
    "no_positioned_participants": (422, "No participant has a position set"),
    "participant_off_grid": (422, "%s is outside the area the travel times cover"),
    "rendezvous_infeasible": (422, "No spot is within %s minutes of everyone: %s cannot reach any candidate in time"),
}
OK, MISSING_MATRIX = "ok", "missing_matrix"
