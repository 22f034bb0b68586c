"""City dimensions as small tables, with their referential checks."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm
from ..session import settled


@dataclass(frozen=True)
class CityDims:
    """Dimension frames of all cities at once.

    districts(city, nr, name, aliases) · quarters(city, nr, name, district, aliases)
    postcodes(city, plz, note) · postcode_quarters(city, plz, quarter)
    themes(city, key, label, terms, pos) · cities(city, name, aliases, on_demand)
    streets(city, name, quarters array<struct<quarter,n>>, postcodes) may be None.
    """

    districts: DataFrame
    quarters: DataFrame
    postcodes: DataFrame
    postcode_quarters: DataFrame
    themes: DataFrame | None = None
    cities: DataFrame | None = None
    streets: DataFrame | None = None

    def settled(self) -> "CityDims":
        """The same dimensions with small frames worked out once."""
        return CityDims(**{f.name: None if getattr(self, f.name) is None else settled(getattr(self, f.name)) for f in fields(self)})


def normalise_terms(themes: DataFrame) -> DataFrame:
    """Theme terms normalised, distinct and sorted."""
    terms = F.array_sort(F.array_distinct(F.filter(F.transform("terms", norm), lambda t: t != "")))
    return themes.withColumn("terms", terms)


def dimension_errors(dims: CityDims) -> DataFrame:
    """Hard errors of the dimensions: quarter, postcode and alias references that lead nowhere."""
    d, q = dims.districts, dims.quarters

    def orphan(child, parent, keys, what):
        on = [child[a] == parent[b] for a, b in keys]
        return child.join(parent, on, "left_anti").select(
            "city", F.lit(what).alias("error"), F.col(keys[-1][0]).cast("string").alias("value"))

    errors = orphan(q, d, [("city", "city"), ("district", "nr")], "quarter without district")
    pq = dims.postcode_quarters
    errors = errors.unionByName(orphan(pq, q, [("city", "city"), ("quarter", "nr")], "postcode with unknown quarter"))
    errors = errors.unionByName(orphan(pq, dims.postcodes, [("city", "city"), ("plz", "plz")], "unknown postcode"))
    if dims.streets is not None:
        named = dims.streets.select("city", F.explode("quarters").alias("q")).select("city", F.col("q.quarter").alias("quarter"))
        errors = errors.unionByName(orphan(named, q, [("city", "city"), ("quarter", "nr")], "street with unknown quarter"))
    return errors


def quarter_postcodes(dims: CityDims) -> DataFrame:
    """Reverse bridge: the postcodes a quarter lies in."""
    return dims.postcode_quarters.groupBy("city", "quarter").agg(F.array_sort(F.collect_set("plz")).alias("postcodes"))
