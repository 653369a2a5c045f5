"""Entity resolution of listings, pseudonymised release tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.pseudonym import pseudonym


def resolve(df: DataFrame, name: str, city: str) -> DataFrame:
    """df with base_key, property_type, resolved_type, entity_key.

    Listings of one base key (city and discriminative words) merge where their
    stated types are compatible: with one stated type or none, all are one
    entity; with several, each type is one, and those that state none join the
    most frequent type (ties: the first by name). Types are counted per base
    key, so a frequent key costs one row a task and type.
    """
    place = T.canonical_location(F.col(city))
    d = df.withColumns({"base_key": F.concat(place, F.lit(" | "), T.discriminative_key(F.col(name), F.col(city))), "property_type": T.property_type(F.col(name))})
    stated = d.where(F.col("property_type") != T.UNSPECIFIED).groupBy("base_key", "property_type").count()
    per = stated.groupBy("base_key").agg(F.count("*").alias("n_types"), F.min(F.struct((-F.col("count")).alias("c"), F.col("property_type").alias("t"))).alias("top"))
    per = per.select("base_key", "n_types", F.col("top.t").alias("main_type"))
    out = d.join(per, "base_key", "left")
    resolved = F.when(F.coalesce("n_types", F.lit(0)) <= 1, F.coalesce("main_type", F.lit(T.UNSPECIFIED))).when(F.col("property_type") == T.UNSPECIFIED, F.col("main_type")).otherwise(F.col("property_type"))
    out = out.withColumn("resolved_type", resolved).drop("n_types", "main_type")
    return out.withColumn("entity_key", F.concat_ws(" | ", "base_key", "resolved_type")).select(*df.columns, "base_key", "property_type", "resolved_type", "entity_key")


def cross_source(df: DataFrame, key: str, source: str) -> DataFrame:
    """key, n_sources, sources (sorted, joined by ' | ') of keys that several sources name."""
    g = df.groupBy(key).agg(F.array_sort(F.collect_set(source)).alias("s"))
    return g.where(F.size("s") > 1).select(key, F.size("s").cast("long").alias("n_sources"), F.array_join("s", " | ").alias("sources"))


def most_frequent(df: DataFrame, key: str, value: str, alias: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the least."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).count()
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("count")).alias("c"), F.col(value).alias("v"))).alias("x")).select(key, F.col("x.v").alias(alias))


def numbered(df: DataFrame, key: str, pattern: str, alias: str, start: int = 1) -> DataFrame:
    """key and a label such as H0001 for each distinct key in order; one task numbers the distinct keys."""
    d = df.select(key).where(F.col(key).isNotNull()).distinct()
    return d.withColumn(alias, F.format_string(pattern, F.row_number().over(Window.orderBy(key)) + (start - 1)))


def release(df: DataFrame, salt: str, name: str = "CustomerName", hotel: str = "NameHotel", key: str = "entity_key", place: str = "Location", rating: str = "Rating_clean", date: str = "Date_parsed", source: str = "source") -> dict[str, DataFrame]:
    """The tables interactions, users, hotels, and mapping; the last holds names and must never be published."""
    ids = numbered(df, key, "H%04d", "hotel_id")
    d = df.join(ids, key).withColumn("user_id", pseudonym(F.col(name), salt))
    interactions = d.select("user_id", "hotel_id", F.col(rating).alias("rating"), F.date_format(date, "yyyy-MM-dd").alias("date"), F.col(source).alias("source"))
    users = d.groupBy("user_id").agg(F.count("*").alias("n_interactions"))
    hotels = most_frequent(d, "hotel_id", hotel, "name").join(most_frequent(d, "hotel_id", place, "location"), "hotel_id", "left")
    return {"interactions": interactions, "users": users, "hotels": hotels, "mapping": d.select(F.col(name), "user_id").distinct()}
