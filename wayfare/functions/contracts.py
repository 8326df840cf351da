"""Column contracts: names that an operator needs, with aliases. Checks read the schema and start no job; ``row_report`` reads
the rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class InputError(ValueError):
    """A table does not fit its contract."""


@dataclass(frozen=True)
class Contract:
    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)


PINGS = Contract("pings", ("ID", "datetime"), ("latitude", "longitude", "timestamp_ms", "TIMESTAMP"), {"latitude": ("LAT",), "longitude": ("LONG",)})
HOMES = Contract("homes", ("ID", "home_lat_4326", "home_lon_4326"))
TRIP_CHAIN = Contract(
    "trip_chain",
    ("user_id", "seq_idx", "start_ts", "end_ts", "dwell_s", "lat", "lon", "distance_from_home_m", "distance_from_prev_m", "stop_role"),
    ("stop_id", "is_overnight"),
)
DESTINATIONS = Contract("destinations", ("ID", "dest_lat", "dest_lon", "dest_date", "eu_distance_km", "dest_order"), ("source_role", "dest_type"))


def validate(df: DataFrame, contract: Contract, allow_aliases: bool = True) -> None:
    """Raises InputError with the required columns that are missing; an alias stands in for its column."""
    have = set(df.columns)
    missing = [c for c in contract.required if c not in have and not (allow_aliases and have & set(contract.aliases.get(c, ())))]
    if missing:
        raise InputError(f"{contract.name}: missing columns {missing}")


def canonicalize(df: DataFrame, contract: Contract) -> DataFrame:
    """Renames the first alias that is present to its column, where the column itself is absent."""
    names = {}
    for column, aliases in contract.aliases.items():
        found = next((a for a in aliases if a in df.columns), None)
        if column not in df.columns and found:
            names[found] = column
    return df.withColumnsRenamed(names) if names else df


def optional_missing(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


#: What values must be readable as, by the end of a column's name.
KINDS = {
    "datetime": "timestamp", "_ts": "timestamp", "_ms": "long", "latitude": "double", "longitude": "double", "_4326": "double", "_m": "double",
    "_s": "double", "lat": "double", "lon": "double"
}


def _unreadable(column: str) -> Column:
    kind = next((k for end, k in KINDS.items() if column.endswith(end)), None)
    return F.col(column).isNotNull() & F.col(column).cast("string").try_cast(kind).isNull() if kind else F.lit(False)


def row_report(df: DataFrame, contract: Contract) -> DataFrame:
    """A row for each column of a contract: whether it is required and there (under its own name or an alias), the table's
    rows, those without a value (all, if the column is absent), and those whose value is not of its kind. One pass."""
    rows = canonicalize(df, contract)
    names = [*contract.required, *contract.optional]
    held = [c for c in names if c in rows.columns]
    counts = rows.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in held],
        *[F.count_if(_unreadable(c)).alias(f"bad_{c}") for c in held]
    )
    report = [
        F.struct(
            F.lit(c).alias("column"), F.lit(c in contract.required).alias("required"), F.lit(c in held).alias("present"), F.col("n").alias("n_rows"),
            F.col(f"null_{c}" if c in held else "n").alias("n_null"), (F.col(f"bad_{c}") if c in held else F.lit(0).cast("long")).alias("n_unreadable")
        ) for c in names
    ]
    return counts.select(F.explode(F.array(*report)).alias("r")).select("r.*")
