"""The intermediate tables that a feed is built from, out of the transit store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravan.functions import geo


def agencies_with_vehicles(agencies: DataFrame, vehicles: DataFrame) -> DataFrame:
    """agencies(..., vehicle_id) with vehicle_name and the vehicle's other columns; agencies without a vehicle stay."""
    known = vehicles.withColumnsRenamed({"gid": "vehicle_id", "name": "vehicle_name"})
    return agencies.join(known, "vehicle_id", "left")


def boarding_rules(agencies: DataFrame) -> DataFrame:
    """(agency_id, continuous_pickup, continuous_drop_off): 1 where the agency's vehicles have serials, else 0."""
    rule = F.when(F.coalesce("has_serial", F.lit(False)), 1).otherwise(0)
    return agencies.select("agency_id", rule.alias("continuous_pickup"), rule.alias("continuous_drop_off"))


def extract(store: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The eight tables by name, of store's agencies, vehicles, stops, trips_view, terminals, intervals, trips_intervals,
    trip_stops_sequence and od_stats: trips have a line and their agency's boarding rules, intervals are active, frequencies are
    those of such intervals."""
    agencies = agencies_with_vehicles(store["agencies"], store["vehicles"])
    trips = store["trips_view"].where(F.col("geom").isNotNull() & ~geo.is_empty(F.col("geom")))
    intervals = store["intervals"].where("active")
    times = ["o_id", "d_id", "interval_id", "interval_start", "duration", "vehicle_name"]
    return {
        "agency": agencies,
        "stops": store["stops"],
        "trips": trips.join(boarding_rules(agencies), "agency_id", "left"),
        "terminals": store["terminals"],
        "intervals": intervals,
        "frequencies": store["trips_intervals"].join(intervals.select(F.col("gid").alias("interval_id")), "interval_id", "left_semi"),
        "trip_stop_sequence": store["trip_stops_sequence"].drop("gid"),
        "travel_times_trackpoints": store["od_stats"].select(*times),
    }


def write_extract(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as a folder of Parquet parts by its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
