"""Street registers and city hierarchies from a street extract, and the register's text form.

The extract has Name, PostalCode, Locality, RegionalKey, Borough, Suburb.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import blank, norm, street_key
from ..session import small_side

MIN_SHARE, MIN_STREETS = 0.10, 3
MIN_POSTCODE_STREETS = 10
EXTRACT = "Name string, PostalCode string, Locality string, RegionalKey string, Borough string, Suburb string"


def read_extract(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("header", True).schema(EXTRACT).csv(path)


def classify_streets(extract: DataFrame, quarters: DataFrame, postcodes: DataFrame, regional_key: str) -> DataFrame:
    """Extract rows with comparison name, quarter and the first reason to reject them.

    quarters: name, quarter (names and aliases); postcodes: plz of the city.
    """
    known = (quarters.select(street_key("name").alias("_qk"), "quarter").groupBy("_qk").agg(F.min("quarter").alias("quarter")))
    area = postcodes.select(F.col("plz").alias("_plz")).distinct().withColumn("_in", F.lit(True))
    df = (extract.withColumn("name", street_key("Name")).withColumn("plz", F.trim(blank("PostalCode"))).withColumn("_qk", street_key("Suburb"))
          .join(small_side(known), "_qk", "left").join(small_side(area), F.col("plz") == F.col("_plz"), "left"))
    reason = (F.when(~F.col("RegionalKey").eqNullSafe(regional_key), "fremde_gemeinde").when(F.col("name") == "", "ohne_namen")
              .when(F.col("quarter").isNull(), "unbekannter_stadtteil").when((F.col("plz") != "") & F.col("_in").isNull(), "ausserhalb_plz"))
    return df.select("name", "quarter", "plz", reason.alias("reason"))


def register_counts(classified: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Street counts per quarter, postcodes per street, rejected rows by reason."""
    good = classified.filter("reason is null")
    per_quarter = good.groupBy("name", "quarter").agg(F.count(F.lit(1)).alias("n"))
    per_postcode = good.filter("plz <> ''").select("name", "plz").distinct()
    rejected = classified.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return per_quarter, per_postcode, rejected


def build_register(per_quarter: DataFrame, per_postcode: DataFrame) -> DataFrame:
    """One row per street name; its quarters and postcodes are bounded by the city's own."""
    q = per_quarter.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("quarter", F.col("n").cast("int").alias("n")))).alias("quarters"))
    p = per_postcode.groupBy("name").agg(F.array_sort(F.collect_set("plz")).alias("postcodes"))
    return q.join(p, "name", "left").withColumn("postcodes", F.coalesce("postcodes", F.array().cast("array<string>")))


def postcode_quarters(per_quarter: DataFrame, per_postcode: DataFrame) -> DataFrame:
    """Quarters of a postcode: at least three streets and a tenth of the postcode's streets.

    A name's full counts go to each of its postcodes.
    """
    spread = per_postcode.join(per_quarter, "name").groupBy("plz", "quarter").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("plz"))
    return spread.withColumn("share", share).filter((F.col("n") >= MIN_STREETS) & (F.col("share") >= MIN_SHARE))


def unmapped_boroughs(extract: DataFrame, boroughs: DataFrame) -> DataFrame:
    """Boroughs of the extract without a district; any row here stops the hierarchy."""
    b = extract.filter(blank("Borough") != "").groupBy(F.col("Borough").alias("borough")).agg(F.count(F.lit(1)).alias("n"))
    return b.join(boroughs.select("borough"), "borough", "left_anti")


def build_hierarchy(extract: DataFrame, boroughs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quarters by majority vote of their streets, numbered within the district; postcodes with enough streets.

    boroughs: borough, nr, name. A tie goes to the lower district number.
    """
    votes = (extract.filter(blank("Suburb") != "").join(small_side(boroughs.select(F.col("borough").alias("Borough"), "nr")), "Borough")
             .groupBy("Suburb", "nr").agg(F.count(F.lit(1)).alias("n")))
    order = F.struct(F.col("n").alias("n"), (-F.col("nr").cast("int")).alias("low"))
    major = votes.groupBy(F.col("Suburb").alias("name")).agg(F.max_by("nr", order).alias("district"))
    w = Window.partitionBy("district").orderBy(street_key("name"), "name")
    quarters = major.withColumn("_i", F.row_number().over(w)).select(
        (F.col("district").cast("int") * 100 + F.col("_i")).cast("string").alias("nr"), "name", F.col("district").cast("string").alias("district"))
    postcodes = (extract.filter(F.trim(blank("PostalCode")) != "").groupBy(F.trim("PostalCode").alias("plz"))
                 .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_POSTCODE_STREETS))
    return quarters, postcodes


def register_lines(register: DataFrame) -> DataFrame:
    """Text lines of a register: name, nr:count list, postcode list."""
    q = F.array_join(F.transform("quarters", lambda x: F.concat_ws(":", x["quarter"], x["n"].cast("string"))), ",")
    return register.select("name", F.concat_ws("\t", "name", q, F.array_join("postcodes", ",")).alias("line"))


def write_register(register: DataFrame, path: str, header: list[str] = ()) -> None:
    """Register as text files sorted by name; the header is a part of its own that sorts first."""
    spark = register.sparkSession
    head = spark.createDataFrame([(0, str(i).zfill(4), f"# {h}") for i, h in enumerate(header)], "part int, name string, line string")
    body = register_lines(register).select(F.lit(1).alias("part"), "name", "line")
    head.unionByName(body).orderBy("part", "name").select("line").write.mode("overwrite").text(path)


def read_register(spark: SparkSession, path, city: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Streets, header values and bad lines of a register file."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    head = lines.filter(F.startswith("value", F.lit("#")))
    values = head.select(F.regexp_extract("value", r"^# (Quelle|Lizenz|Stand):\s*(.*?)\s*$", 1).alias("key"),
                         F.regexp_extract("value", r"^# (Quelle|Lizenz|Stand):\s*(.*?)\s*$", 2).alias("value")).filter("key <> ''")
    cols = F.split("value", "\t")
    df = lines.filter(~F.startswith("value", F.lit("#"))).select("value", cols.alias("c"))
    parts = F.filter(F.transform(F.split(F.coalesce(F.get("c", 1), F.lit("")), ","), F.trim), lambda p: p != "")
    quarters = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("quarter"),
                                                     F.coalesce(F.when(F.contains(p, F.lit(":")), F.substring_index(p, ":", -1).try_cast("int")), F.lit(1)).alias("n")))
    postcodes = F.filter(F.split(F.coalesce(F.get("c", 2), F.lit("")), ","), lambda p: F.trim(p) != "")
    df = df.select("value", F.trim(F.get("c", 0)).alias("name"), quarters.alias("quarters"), postcodes.alias("postcodes"))
    bad = (F.col("name") == "") | (F.size("quarters") == 0)
    return df.filter(~bad).select(F.lit(city).alias("city"), "name", "quarters", "postcodes"), values, df.filter(bad).select("value")


def load_press(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Press references with normalised criteria, and the bad rows with the reason.

    refs: city, pos, medium, title, url, date, keywords, references.
    """
    def normal(c):
        return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), norm), lambda x: x != "")))

    df = refs.withColumn("keywords", normal("keywords")).withColumn("references", normal("references"))
    date = F.trim(blank("date"))
    error = (F.when((F.trim(blank("medium")) == "") | (F.trim(blank("title")) == "") | (F.trim(blank("url")) == ""), "medium, title and url are needed")
             .when(~F.trim("url").rlike("^https?://"), "url is not http(s)")
             .when((date != "") & (~date.rlike(r"^\d{4}-\d{2}-\d{2}$") | date.try_cast("date").isNull()), "date is not an ISO day")
             .when((F.size("keywords") == 0) & (F.size("references") == 0), "no criterion"))
    df = df.withColumn("error", error)
    return df.filter("error is null").drop("error"), df.filter("error is not null").select("city", "pos", "error")
