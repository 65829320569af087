"""Scalar Column helpers (date parts, labels, codes, distances, rounding).

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions, so it stays inside whole-stage codegen. No Python UDFs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's so results agree.
# ---------------------------------------------------------------------------

# Staging time-period labels by hour band (inclusive bounds).
STAGING_PERIODS = [
    (6, 9, "Morning Rush"),
    (10, 15, "Midday"),
    (16, 19, "Evening Rush"),
    (20, 23, "Evening"),
]
STAGING_PERIOD_DEFAULT = "Night"

# Training ordinal map for time-period labels; unmatched labels become 0.
TRAINING_PERIOD_CODES = {"Night": 0, "Morning": 1, "Afternoon": 2, "Evening": 3}

# Full five-level ordinal for the staging labels (the consistent default).
STAGING_PERIOD_CODES = {"Night": 0, "Morning Rush": 1, "Midday": 2,
                        "Evening Rush": 3, "Evening": 4}

# Route-scorer weather keywords; the first keyword contained in the
# lower-cased condition wins, so the order matters. Default 0.
SCORER_WEATHER_KEYWORDS = [
    "clear", "fair", "cloudy", "overcast", "fog", "haze", "smoke", "rain",
    "drizzle", "thunderstorm", "snow", "sleet", "ice", "freezing", "windy",
    "dust", "sand",
]

# Route-scorer poor-weather words (any contained in lower(condition)).
POOR_WEATHER_WORDS = [
    "rain", "drizzle", "thunderstorm", "snow", "sleet", "ice", "freezing",
    "fog", "haze", "smoke",
]

# Request-scoring weather names; index is the code. A condition matches a
# name when either lower-cased string contains the other; first wins.
API_WEATHER_CONDITIONS = [
    "Clear", "Cloudy", "Overcast", "Rain", "Light Rain", "Heavy Rain",
    "Snow", "Light Snow", "Heavy Snow", "Fog", "Haze", "Thunderstorm",
    "Drizzle", "Sleet", "Smoke", "Windy", "Fair", "Partly Cloudy",
]

# Weather-service condition code -> category; unknown codes are "Clear".
WEATHER_CODE_CATEGORIES = {
    200: "Thunderstorm", 201: "Thunderstorm", 202: "Thunderstorm",
    210: "Thunderstorm", 211: "Thunderstorm", 212: "Thunderstorm",
    221: "Thunderstorm", 230: "Thunderstorm", 231: "Thunderstorm",
    232: "Thunderstorm",
    300: "Drizzle", 301: "Drizzle", 302: "Drizzle",
    310: "Drizzle", 311: "Drizzle", 312: "Drizzle",
    313: "Drizzle", 314: "Drizzle", 321: "Drizzle",
    500: "Light Rain", 501: "Rain", 502: "Heavy Rain",
    503: "Heavy Rain", 504: "Heavy Rain",
    511: "Sleet",
    520: "Rain", 521: "Rain", 522: "Heavy Rain", 531: "Rain",
    600: "Light Snow", 601: "Snow", 602: "Heavy Snow",
    611: "Sleet", 612: "Sleet", 613: "Sleet",
    615: "Snow", 616: "Snow",
    620: "Snow", 621: "Snow", 622: "Heavy Snow",
    701: "Fog", 711: "Smoke", 721: "Haze",
    731: "Haze", 741: "Fog", 751: "Haze",
    761: "Haze", 762: "Haze",
    771: "Windy", 781: "Windy",
    800: "Clear",
    801: "Partly Cloudy", 802: "Cloudy",
    803: "Cloudy", 804: "Overcast",
}
WEATHER_CODE_DEFAULT = "Clear"

# Day names, Sunday = 0.
WEEKDAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday",
                 "Friday", "Saturday"]

# Request weekday words, Monday = 0.
REQUEST_WEEKDAYS = {"monday": 0, "tuesday": 1, "wednesday": 2, "thursday": 3,
                    "friday": 4, "saturday": 5, "sunday": 6}

# The twelve staged road-feature flags, in staging order.
ROAD_FLAGS = [
    "has_amenity", "has_bump", "has_crossing", "has_give_way",
    "has_junction", "has_no_exit", "has_railway", "has_roundabout",
    "has_station", "has_stop", "has_traffic_calming", "has_traffic_signal",
]

EARTH_RADIUS_MI = 3959.0
KM_PER_DEGREE = 111.0
METERS_PER_MILE = 1609.34
MPH_PER_MS = 2.237

# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _map_lit(mapping: dict) -> Column:
    """A literal map column; folded to a constant by Catalyst."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


# C1 / C2 / C3 --------------------------------------------------------------

def dow_sunday0(ts) -> Column:
    """Day of week with Sunday = 0 (Spark's dayofweek is Sunday = 1)."""
    return (F.dayofweek(_c(ts)) - 1).cast("int")


def dow_monday0(ts) -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(_c(ts)).cast("int")


def monday0_to_sunday0(dow) -> Column:
    return ((_c(dow) + 1) % 7).cast("int")


# C4 ------------------------------------------------------------------------

def epoch_micros_ntz(ts) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock timestamp, zone-free."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, _c(ts).cast("timestamp_ntz"))


def minute_boundaries(start, end) -> Column:
    """Number of minute boundaries crossed from start to end.

    Same as a SQL ``DATEDIFF('minute', start, end)`` that counts boundaries
    (10:59:59 -> 11:00:01 is 1), unlike Spark's elapsed-minute
    ``timestamp_diff``. Computed on wall-clock micros so no time zone or DST
    rule can change it.
    """
    per_min = 60_000_000
    return (F.floor(epoch_micros_ntz(end) / per_min)
            - F.floor(epoch_micros_ntz(start) / per_min)).cast("bigint")


# C5 - C9 -------------------------------------------------------------------

def staging_time_period(hour) -> Column:
    h = _c(hour)
    expr = None
    for lo, hi, label in STAGING_PERIODS:
        cond = h.between(lo, hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(STAGING_PERIOD_DEFAULT)


def scorer_period_code(hour) -> Column:
    """Route-scorer period code: 0-5 -> 0, 6-9 -> 1, 10-15 -> 2, 16-19 -> 3, else 4."""
    h = _c(hour)
    return (F.when((h >= 0) & (h < 6), 0).when((h >= 6) & (h < 10), 1)
            .when((h >= 10) & (h < 16), 2).when((h >= 16) & (h < 20), 3)
            .otherwise(4))


def api_period_code(hour) -> Column:
    """Request-scoring period code: 6-11 -> 1, 12-17 -> 2, 18-21 -> 3, else 0."""
    h = _c(hour)
    return (F.when((h >= 6) & (h < 12), 1).when((h >= 12) & (h < 18), 2)
            .when((h >= 18) & (h < 22), 3).otherwise(0))


def period_label_code(label, compat: bool = True) -> Column:
    """Period label -> ordinal code.

    ``compat=True`` applies the training map (Night/Morning/Afternoon/
    Evening, anything else 0), which is what the reference computes on its
    own staging labels. ``compat=False`` uses the five staging labels.
    """
    mapping = TRAINING_PERIOD_CODES if compat else STAGING_PERIOD_CODES
    return F.coalesce(F.element_at(_map_lit(mapping), _c(label)), F.lit(0)).cast("int")


def is_rush_hour(hour, variant: str = "training") -> Column:
    """Rush-hour flag as int. training/api: 7-9 or 16-19; scorer: {7,8,9,16,17,18}."""
    h = _c(hour)
    if variant == "scorer":
        cond = h.isin(7, 8, 9, 16, 17, 18)
    else:
        cond = h.between(7, 9) | h.between(16, 19)
    return F.when(cond, 1).otherwise(0)


# C10 - C13 -----------------------------------------------------------------

def poor_weather_numeric(visibility, precipitation) -> Column:
    return F.when((_c(visibility) < 5) | (_c(precipitation) > 0), 1).otherwise(0)


def poor_weather_text(condition) -> Column:
    low = F.lower(_c(condition))
    hit = reduce(lambda a, b: a | b, [low.contains(w) for w in POOR_WEATHER_WORDS])
    return F.when(hit, 1).otherwise(0)


def extreme_temp(temp) -> Column:
    return F.when((_c(temp) < 32) | (_c(temp) > 95), 1).otherwise(0)


def flag_count(flags: list) -> Column:
    """Sum of boolean/int flags (nulls count 0)."""
    if not flags:
        return F.lit(0)
    return reduce(lambda a, b: a + b,
                  [F.coalesce(_c(f).cast("int"), F.lit(0)) for f in flags])


# C14 - C16 -----------------------------------------------------------------

def scorer_weather_code(condition) -> Column:
    """First keyword (in fixed order) contained in lower(condition); default 0."""
    low = F.lower(_c(condition))
    expr = None
    for i, kw in enumerate(SCORER_WEATHER_KEYWORDS):
        cond = low.contains(kw)
        expr = F.when(cond, i) if expr is None else expr.when(cond, i)
    return F.coalesce(expr.otherwise(0), F.lit(0)).cast("int")


def api_weather_code(condition) -> Column:
    """Index of the first name that contains, or is contained in, the condition."""
    low = F.lower(_c(condition))
    expr = None
    for i, name in enumerate(API_WEATHER_CONDITIONS):
        n = name.lower()
        cond = F.lit(n).contains(low) | low.contains(n)
        expr = F.when(cond, i) if expr is None else expr.when(cond, i)
    return F.when(_c(condition).isNull(), 0).otherwise(expr.otherwise(0)).cast("int")


def weather_category(code) -> Column:
    return F.coalesce(F.element_at(_map_lit(WEATHER_CODE_CATEGORIES), _c(code).cast("int")),
                      F.lit(WEATHER_CODE_DEFAULT))


# C17 - C20 -----------------------------------------------------------------

def haversine_miles(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle miles (R = 3959, atan2 form)."""
    la1, la2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat = F.radians(_c(lat2) - _c(lat1))
    dlon = F.radians(_c(lon2) - _c(lon1))
    a = (F.pow(F.sin(dlat / 2), 2)
         + F.cos(la1) * F.cos(la2) * F.pow(F.sin(dlon / 2), 2))
    return F.lit(EARTH_RADIUS_MI) * (2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)))


def planar_km(lat1, lon1, lat2, lon2) -> Column:
    """Flat-earth km: sqrt(dlat^2 + dlon^2) * 111."""
    return F.sqrt(F.pow(_c(lat1) - _c(lat2), 2) + F.pow(_c(lon1) - _c(lon2), 2)) * KM_PER_DEGREE


def kelvin_to_f(k) -> Column:
    return (_c(k) - 273.15) * 9 / 5 + 32


def meters_to_miles(m) -> Column:
    return _c(m) / METERS_PER_MILE


def ms_to_mph(ms) -> Column:
    return _c(ms) * MPH_PER_MS


def grid_key(coord, digits: int = 2) -> Column:
    """Coordinate grid cell (~1 km at 2 digits), half away from zero."""
    return round_half_away(coord, digits)


# C21 - C25 -----------------------------------------------------------------

def risk_level3(p) -> Column:
    return F.when(_c(p) < 0.3, "LOW").when(_c(p) < 0.6, "MEDIUM").otherwise("HIGH")


def risk_level4(p, moderate_label: str = "MEDIUM") -> Column:
    """4-way level; the route scorer calls the second band MODERATE."""
    return (F.when(_c(p) < 0.3, "LOW").when(_c(p) < 0.5, moderate_label)
            .when(_c(p) < 0.7, "HIGH").otherwise("CRITICAL"))


def confidence_distance(p) -> Column:
    """|p - 0.5| * 2 (request scoring)."""
    return F.abs(_c(p) - 0.5) * 2


def confidence_max(p) -> Column:
    """max(p, 1 - p) (route scorer)."""
    return F.greatest(_c(p), 1 - _c(p))


def safety_score(risk) -> Column:
    return 100 - _c(risk) * 100


def hour_label(hour) -> Column:
    """0 -> '12:00 AM', 9 -> '9:00 AM', 12 -> '12:00 PM', 13 -> '1:00 PM'."""
    h = _c(hour)
    return (F.when(h == 0, "12:00 AM")
            .when(h < 12, F.format_string("%d:00 AM", h))
            .when(h == 12, "12:00 PM")
            .otherwise(F.format_string("%d:00 PM", h - 12)))


def clock_label(hour) -> Column:
    """Zero-padded 12-hour clock at the full hour: 8 -> '08:00 AM', 17 -> '05:00 PM'."""
    h = _c(hour)
    h12 = F.when(h % 12 == 0, 12).otherwise(h % 12)
    return F.format_string("%02d:00 %s", h12, F.when(h < 12, "AM").otherwise("PM"))


def weekday_name(dow_sun0) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), _c(dow_sun0).cast("int") + 1)


def request_weekday(value) -> Column:
    """Weekday word -> Monday=0 number; numbers pass through; unknown -> null."""
    v = _c(value).cast("string")
    word = F.element_at(_map_lit(REQUEST_WEEKDAYS), F.lower(v))
    return F.coalesce(word, v.try_cast("int"))


# C27 / C31 -----------------------------------------------------------------

def round_half_away(x, digits: int) -> Column:
    """SQL-engine ROUND on doubles: scale, round half away from zero, unscale.

    Spark's ``round`` rounds the shortest decimal string instead, which
    differs at binary near-ties (2.675 -> 2.68 vs 2.67). This form is the
    same IEEE operations the oracle engine performs.
    """
    scale = float(10 ** digits)
    v = _c(x).cast("double")
    big = F.abs(v) * scale
    # From 2^52 on (and for NaN) there is nothing left to round, and floor() would saturate.
    return F.when(big < float(1 << 52), F.signum(v) * F.floor(big + 0.5) / scale).otherwise(v)


def round_half_up(x, digits: int) -> Column:
    """floor(x * 10^n + 0.5) / 10^n: engine-neutral rounding for nonnegative scores."""
    scale = float(10 ** digits)
    v = _c(x).cast("double")
    return F.when(F.abs(v) * scale < float(1 << 52), F.floor(v * scale + 0.5) / scale).otherwise(v)


def rate_pct(part, total) -> Column:
    """100 * part / total as double (never decimal), null on zero total."""
    return F.try_divide(_c(part).cast("double") * 100.0, _c(total).cast("double"))


# C28 - C30 -----------------------------------------------------------------

def display_name(feature) -> Column:
    return F.initcap(F.regexp_replace(_c(feature), "_", " "))


def normalize_key(s) -> Column:
    return F.lower(F.trim(_c(s)))


def location_string(lat, lon) -> Column:
    """'(lat, lon)' at 5 digits. Java's %.5f rounds exact ties up; rounding
    half-to-even first gives the usual printf result (33.515625 -> 33.51562)."""
    return F.format_string("(%.5f, %.5f)", F.bround(_c(lat), 5), F.bround(_c(lon), 5))
