"""The scalar functions as temporary SQL functions: they are inlined into plans like built-in ones."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import LAND_USE

#: Name, parameters, type and body.
FUNCTIONS = [
    (
        "haversine_m", "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
        "2 * 6371000D * atan2(sqrt(power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2)), "
        "sqrt(1 - (power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2))))",
    ),
    ("mercator_x", "lon DOUBLE", "DOUBLE", "radians(lon) * 6378137D"),
    (
        "mercator_y", "lat DOUBLE", "DOUBLE",
        "CASE WHEN lat IS NOT NULL THEN ln(tan(pi() / 4 + radians(greatest(least(lat, 85D), -85D)) / 2)) * 6378137D END"
    ),
    (
        "in_night", "h INT, from_hour INT, to_hour INT", "BOOLEAN",
        "CASE WHEN from_hour > to_hour THEN h >= from_hour OR h < to_hour ELSE h >= from_hour AND h < to_hour END"
    ),
    ("hours_between", "a TIMESTAMP, b TIMESTAMP", "DOUBLE", "(unix_micros(b) - unix_micros(a)) / 3.6e9"),
    (
        "land_use", "value STRING", "STRING",
        "CASE WHEN value IS NULL THEN NULL " + " ".join(
            f"WHEN contains(lower(value), '{w}') THEN '{kind}'" for kind, words in LAND_USE for w in words.split(", ")
        ) + " ELSE 'other' END"
    ),
]


def register(spark: SparkSession) -> list[str]:
    """Registers all functions in the session and returns their names."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
