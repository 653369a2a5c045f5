"""Audit of display names as identities: name space, placeholders, proven collisions, filter policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..settings import MIN_INTERACTIONS, SHORT_NAME, TOP_NAMES

POLICIES = ("all_names", "drop_placeholders", "drop_short_le3", "drop_single_token", "min_two_tokens_and_no_collision")


def named(df: DataFrame, name: str = "CustomerName") -> DataFrame:
    """Rows with a name, trimmed."""
    return df.withColumn(name, F.trim(name)).where(F.col(name).isNotNull() & (F.col(name) != ""))


def name_space(df: DataFrame, name: str = "CustomerName") -> DataFrame:
    """One row on the distinct names: lengths, word counts, initials-only names, and the rows they carry."""
    per = df.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("c"))
    p = per.select("c", F.char_length("name").alias("len"), F.size(T.name_words(F.col("name"))).alias("words"), T.is_initials(F.col("name")).alias("initials"))
    one, short = F.col("words") == 1, F.col("len") <= SHORT_NAME
    part = lambda flag: F.coalesce(F.sum(F.when(flag, F.col("c"))), F.lit(0))
    return p.agg(
        F.sum("c").alias("n_interactions"), F.count("*").alias("n_names"), F.round(F.avg("len"), 2).alias("mean_len"), F.percentile("len", F.lit(0.5)).alias("median_len"), F.percentile("len", F.lit(0.1)).alias("p10_len"), F.percentile("len", F.lit(0.9)).alias("p90_len"), F.max("len").alias("max_len"),
        F.count_if(one).alias("single_token_names"), part(one).alias("single_token_interactions"), F.count_if(short).alias("short_names"), part(short).alias("short_interactions"), F.count_if("initials").alias("initials_only_names"),
    )


def token_distribution(df: DataFrame, name: str = "CustomerName") -> DataFrame:
    """words, names: distinct names by number of words."""
    return df.select(name).distinct().groupBy(F.size(T.name_words(F.col(name))).alias("words")).agg(F.count("*").alias("names"))


def top_names(df: DataFrame, name: str = "CustomerName", place: str = "loc_key", n: int = TOP_NAMES) -> DataFrame:
    g = df.groupBy(name).agg(F.count("*").alias("n_interactions"), F.count_distinct(place).alias("n_cities"))
    return g.withColumn("n_tokens", F.size(T.name_words(F.col(name)))).orderBy(F.desc("n_interactions"), name).limit(n)


def placeholders(df: DataFrame, name: str = "CustomerName", hotel: str = "hotel_key", place: str = "loc_key") -> DataFrame:
    """Each placeholder name with its rows, hotels and cities."""
    return df.where(T.is_placeholder(F.col(name))).groupBy(name).agg(F.count("*").alias("n_interactions"), F.count_distinct(hotel).alias("n_hotels"), F.count_distinct(place).alias("n_cities"))


def collisions(df: DataFrame, name: str = "CustomerName", date: str = "Date_parsed", place: str = "loc_key") -> DataFrame:
    """name, people: names seen in several cities on one day, and the most such cities: that many people at least share it."""
    day = df.where(F.col(date).isNotNull()).groupBy(name, date).agg(F.count_distinct(place).alias("cities"))
    return day.groupBy(name).agg(F.max("cities").alias("people")).where("people > 1")


def collision_bound(df: DataFrame, name: str = "CustomerName", **columns) -> DataFrame:
    """n_names, n_colliding, people: a lower bound of the people behind the names, and rows under colliding names."""
    per = df.groupBy(name).agg(F.count("*").alias("c"))
    j = per.join(collisions(df, name, **columns), name, "left")
    return j.agg(F.count("*").alias("n_names"), F.count("people").alias("n_colliding"), F.sum(F.coalesce("people", F.lit(1))).alias("people"), F.coalesce(F.sum(F.when(F.col("people").isNotNull(), F.col("c"))), F.lit(0)).alias("colliding_interactions"))


def policy(name: Column, collides: Column, which: str) -> Column:
    """Whether a row stays under a filter policy; an unknown one raises ValueError."""
    real, words = ~T.is_placeholder(name), F.size(T.name_words(name))
    rules = {
        "all_names": F.lit(True), "drop_placeholders": real, "drop_short_le3": real & (F.char_length(name) > SHORT_NAME), "drop_single_token": real & (words >= 2),
        "min_two_tokens_and_no_collision": real & (words >= 2) & ~collides,
    }
    if which not in rules:
        raise ValueError(which)
    return rules[which]


def sensitivity(df: DataFrame, name: str = "CustomerName", hotel: str = "hotel_key", k: int = MIN_INTERACTIONS, date: str = "Date_parsed", place: str = "loc_key") -> DataFrame:
    """A row for each policy: rows kept, users, hotels, means, eligible users, sparsity.

    Everything comes from one aggregate by name, hotel, day and place, which is
    dealt once and read again by each part; policies are judged and exploded by
    name and by (name, hotel), not by row.
    """
    cube = df.groupBy(F.col(name).alias("name"), F.col(hotel).alias("hotel"), F.col(date).alias("day"), F.col(place).alias("place")).agg(F.count("*").alias("c"))
    cities = cube.where("day is not null and c > 0").groupBy("name", "day").agg(F.count_distinct("place").alias("cities"))
    hit = cities.groupBy("name").agg((F.max("cities") > 1).alias("hit"))
    judged = cube.groupBy("name").agg(F.sum("c").alias("n")).join(hit, "name", "left")
    kept = F.array_compact(F.array(*[F.when(policy(F.col("name"), F.coalesce("hit", F.lit(False)), p), F.lit(p)) for p in POLICIES]))
    judged = judged.select("name", "n", kept.alias("kept"))
    users = judged.select("n", F.explode("kept").alias("policy")).groupBy("policy").agg(
        F.sum("n").alias("n_interactions"), F.count("*").alias("n_users"), F.round(F.avg("n"), 2).alias("mean_per_user"), F.max("n").alias("max_per_user"),
        F.round(100.0 * F.avg((F.col("n") == 1).cast("double")), 4).alias("single_pct"), F.count_if(F.col("n") >= k).alias("eligible_users"),
    )
    by_hotel = cube.where("c > 0").select("name", "hotel").distinct().join(judged.select("name", "kept"), "name")
    hotels = by_hotel.select("hotel", F.explode("kept").alias("policy")).groupBy("policy").agg(F.count_distinct("hotel").alias("n_hotels"))
    all_ = judged.agg(F.sum("n").alias("_n"))
    out = users.join(hotels, "policy").crossJoin(all_)  # one row
    return out.withColumns({"retained_pct": F.round(100.0 * F.col("n_interactions") / F.col("_n"), 4), "sparsity_pct": F.round(100.0 * (1 - F.col("n_interactions") / (F.col("n_users") * F.col("n_hotels"))), 4)}).drop("_n")


def placeholder_removal(df: DataFrame, name: str = "CustomerName") -> DataFrame:
    """One row: rows and names under placeholders, and what is left without them (rows, names, rows a name)."""
    per = df.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("c")).withColumn("real", ~T.is_placeholder(F.col("name")))
    part = lambda flag: F.coalesce(F.sum(F.when(flag, F.col("c"))), F.lit(0))
    real = F.col("real")
    g = per.agg(part(~real).alias("placeholder_rows"), F.count_if(~real).alias("placeholder_names"), part(real).alias("rows_left"), F.count_if(real).alias("names_left"))
    return g.withColumn("mean_left", F.round(F.col("rows_left") / F.nullif(F.col("names_left"), F.lit(0)), 4))


def histograms(df: DataFrame, name: str = "CustomerName", most_words: int = 5, most_cities: int = 6, **columns) -> DataFrame:
    """kind, size, names: names by number of words (most_words stands for all above), and colliding names by cities on one day."""
    words = F.least(F.size(T.name_words(F.col(name))), F.lit(most_words))
    a = df.select(name).distinct().groupBy(words.alias("size")).agg(F.count("*").alias("names")).withColumn("kind", F.lit("words"))
    b = collisions(df, name, **columns).groupBy(F.least(F.col("people").cast("int"), F.lit(most_cities)).alias("size")).agg(F.count("*").alias("names")).withColumn("kind", F.lit("cities"))
    return a.unionByName(b).select("kind", "size", "names")
