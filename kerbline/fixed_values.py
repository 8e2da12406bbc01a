"""Fixed values that results depend on: header names, word lists, constants.

Everything in this module is data, not logic. Order matters where a tuple is
used: header aliases are in priority order, hazard categories in matching
order.
"""

# --- Fixed values: accepted CSV headers, first match wins ------------------

CRASH_HEADERS = {
    "id": ("incident_id", "object_id", "INCIDENT_ID", "objectid", "OBJECTID"),
    "lon": ("geo_lon", "POINT_X", "Longitude", "lon", "LONGITUDE"),
    "lat": ("geo_lat", "POINT_Y", "Latitude", "lat", "LATITUDE"),
    "time": (
        "first_occurrence_date",
        "occurred_at",
        "FIRST_OCCURRENCE_DATE",
        "first_occurrence_dttm",
    ),
    "fatalities": ("FATALITIES", "fatalities", "Fatalities"),
    "seriously_injured": (
        "SERIOUSLY_INJURED",
        "seriously_injured",
        "Seriously_Injured",
    ),
}
CRASH_REQUIRED = ("id", "lon", "lat", "time")

HAZARD_HEADERS = {
    "id": ("OBJECTID", "ObjectId", "Id", "OBJECT ID"),
    "lon": ("Longitude", "lon", "LONGITUDE", "POINT_X", "geo_lon"),
    "lat": ("Latitude", "lat", "LATITUDE", "POINT_Y", "geo_lat"),
    "status": ("Case Status", "Status"),
    "created_at": (
        "Case Created dttm",
        "Case Created Date",
        "Created Date",
        "Opened",
    ),
    "type": ("Type",),
    "topic": ("Topic",),
    "summary": ("Case Summary", "Summary"),
}
HAZARD_REQUIRED = ("id", "lon", "lat", "status", "created_at")

BIKEWAY_HEADERS = {
    "id": ("FID", "fid", "OBJECTID", "objectid", "geomid"),
    "type": ("fac_type", "FAC_TYPE"),
    "status": ("status", "STATUS"),
    "wkt": ("geom", "GEOM", "WKT", "wkt"),
}
BIKEWAY_REQUIRED = ("id", "wkt")

# Names the key column of a stored bikeway table may have, first match wins.
BIKEWAY_KEYS = ("infra_id", "way_id", "id")

# --- Fixed values: cell texts that mean "missing" in a raw CSV --------------

NA_WORDS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# White space removed by a full strip of a text.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- Fixed values: hazard categories, first list with a hit wins ------------

HAZARD_CATEGORIES = (
    ("pothole", ("pothole", "potholes")),
    ("debris", ("debris", "glass", "trash", "sand", "gravel")),
    ("signal", ("signal", "traffic light", "stop light")),
    ("bike_blocked", ("bike", "bicycle", "lane block", "bike lane", "path blocked")),
    ("snow_ice", ("snow", "ice")),
)
HAZARD_CATEGORY_OTHER = "other"

# Status patterns of a hazard that still counts as open ("_" matches any one
# character, case does not matter).
OPEN_STATUS_PATTERNS = (
    "open",
    "re-opened",
    "in_progress",
    "pending_closure",
    "waiting_on_customer",
    "customer_updated",
)

# --- Fixed values: travel modes and request defaults ------------------------

MODES = ("driving", "cycling", "walking")
DEFAULT_MODE = "driving"
DEFAULT_BUFFER = 60.0
DEFAULT_ALTERNATIVES = 3
MIN_ALTERNATIVES = 1
MAX_ALTERNATIVES = 5

# --- Fixed values: risk formulas --------------------------------------------

# Severity weights, "literal" as written in the two published formulas and
# "corrected" for the codes the loaders produce (1 fatal, 2 serious, 3 minor).
# Each entry: ({code: weight}, weight of any other code).
EXPOSURE_WEIGHTS = {
    "literal": ({4: 1.00, 3: 0.60, 2: 0.30}, 0.10),
    "corrected": ({1: 1.00, 2: 0.60, 3: 0.30}, 0.10),
}
SCORE_WEIGHTS = {
    "literal": ({3: 3, 2: 2}, 1),
    "corrected": ({1: 3, 2: 2}, 1),
}
SECONDS_PER_MONTH = 30 * 24 * 3600
RECENCY_HALF_LIFE_MONTHS = 24.0
SCORE_LOOKBACK_DAYS = 365
SCORE_BUFFER_M = 50.0
MIN_LENGTH_KM = 0.001
CRASH_SATURATION = 1.5
CRASH_POINTS = 60.0
HAZARD_SATURATION = 3.0
HAZARD_POINTS = 40.0
CRASH_HISTORY_YEARS = 5
HAZARD_HISTORY_DAYS = 365

# --- Fixed values: alternative routes ----------------------------------------

COMPASS_DEGREES = 0.02
COMPASS_MIN_DIFFERENCE = 0.03
ON_LINE_SHIFT = 0.005
ON_LINE_FALLBACK_DEGREES = 0.01
ON_LINE_MIN_DIFFERENCE = 0.05
EAST_WEST_DEGREES = 0.01
ZIGZAG_DEGREES = 0.001
ZIGZAG_STRETCH = (1.05, 0.05)
SHIFT_DEGREES = 0.002
SHIFT_STRETCH = (1.1, 0.1)

# --- Fixed values: result texts ----------------------------------------------

BADGES = {
    "winner": "Best Route",
    "medium": "Average Risk",
    "high": "Higher Risk",
}

# --- Fixed values: Web Mercator and ellipsoids -------------------------------

MERCATOR_RADIUS = 6378137.0
TILE_WORLD = 40075016.6855784
TILE_ORIGIN = 20037508.3427892
CRASH_TILE_ZOOM = 12

WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
GRS80_F = 1 / 298.257222101

# NAD83 / Colorado Central (ftUS), EPSG:2232, a Lambert conformal conic with
# two standard parallels. Degrees, and US survey feet.
STATE_PLANE_2232 = {
    "lat_1": 39.75,
    "lat_2": 38.45,
    "lat_0": 37.8333333333333,
    "lon_0": -105.5,
    "false_easting": 3_000_000.0,
    "false_northing": 1_000_000.0,
    "foot": 1200.0 / 3937.0,
}
