"""String rules: title case, land-use keywords, numbers from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Land-use keywords in the order in which they are tried, and the type each stands for.
LAND_USE = [
    (
        "residential",
        "residential, single family, single-family, multi family, multi-family, multifamily, mobile home, condominium, duplex, triplex, apartment"
    ),
    ("hotel/motel", "hotel, motel, lodging"),
    ("commercial", "commercial, shopping, store, restaurant, retail, office, mixed use, parking, service station, gas station"),
    ("industrial", "industrial, manufacturing, warehouse"),
    ("public", "federal property, public, school, educational, hospital, religious, church, shelter, government, institutional, civic, exempt"),
    ("open space", "park, recreation, open space, agriculture, rural, vacant"),
    ("road", "road, highway, transportation, right of way"),
    ("unknown", "unknown"),
]


def standardize_type(value: Column) -> Column:
    """The type of the first keyword that a lower-cased value contains; 'other' without any; null stays null."""
    low, rule = F.lower(value), None
    for kind, words in LAND_USE:
        for word in words.split(", "):
            hit = low.contains(word)
            rule = F.when(hit, kind) if rule is None else rule.when(hit, kind)
    return F.when(value.isNotNull(), rule.otherwise("other"))


def title_case(value: Column) -> Column:
    """Each run of letters capitalised: after any character that is no letter, a letter is upper case."""
    step = lambda a, c: F.struct(
        F.concat(a["out"], F.when(a["letter"], F.lower(c)).otherwise(F.upper(c))).alias("out"), c.rlike(r"^\p{L}$").alias("letter")
    )
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("letter"))
    return F.when(value.isNotNull(), F.aggregate(F.split(value, ""), start, step, lambda a: a["out"]))


def number(value: Column) -> Column:
    """A double, null where the value is no number."""
    found = value.try_cast("double")
    return F.when(~F.isnan(found), found)
