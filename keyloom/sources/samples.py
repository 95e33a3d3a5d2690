"""Sample datasets by rule, of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def complete_graph(spark: SparkSession, n: int) -> DataFrame:
    a = spark.range(n).withColumnRenamed("id", "src")
    return a.crossJoin(spark.range(n).withColumnRenamed("id", "dst")).where("src <> dst")


def friends_of_friends(spark: SparkSession, people: int, friends: int, seed: int = 1) -> DataFrame:
    """(u, v): each person's friends, drawn by a hash."""
    e = spark.range(people).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(1), F.lit(friends))).alias("k"))
    return e.select("u", F.pmod(F.xxhash64(F.lit(seed), "u", "k"), F.lit(people)).alias("v")).where("u <> v").distinct()


def social_graph(spark: SparkSession, people: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(friendship, lived_in): dated friendships, and places with the time of moving there."""
    day = lambda *cs: F.timestamp_seconds(F.lit(946684800) + F.pmod(F.xxhash64(F.lit(seed), *cs), F.lit(4000)) * 86400)
    friendship = friends_of_friends(spark, people, 5, seed).withColumn("since", day("u", "v"))
    moves = spark.range(people).select(F.col("id").alias("user"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))
    return friendship, moves.select("user", day("user", "k").alias("moved"), F.pmod(F.xxhash64(F.lit(seed + 1), "user", "k"), F.lit(100)).alias("place"))


def money_transfers(spark: SparkSession, accounts: int, transfers: int, seed: int = 1) -> DataFrame:
    h = lambda k: F.pmod(F.xxhash64(F.lit(seed + k), "id"), F.lit(accounts))
    return spark.range(transfers).select("id", h(0).alias("src"), h(1).alias("dst"), (F.pmod(F.xxhash64(F.lit(seed + 2), "id"), F.lit(10_000)) + 1).alias("amount"))


def beers(spark: SparkSession, breweries: int, each: int) -> DataFrame:
    b = spark.range(breweries).select(F.col("id").alias("brewery"), F.explode(F.sequence(F.lit(1), F.lit(each))).alias("beer"))
    return b.select("brewery", "beer", F.concat(F.lit("beer "), "brewery", F.lit("-"), "beer").alias("name"), (F.pmod(F.xxhash64("brewery", "beer"), F.lit(90)) / 10 + 3).alias("strength"))


def tweets(spark: SparkSession, users: int, each: int, seed: int = 1) -> DataFrame:
    t = spark.range(users).select(F.col("id").alias("user"), F.explode(F.sequence(F.lit(1), F.lit(each))).alias("tweet"))
    tag = F.concat(F.lit("#t"), F.pmod(F.xxhash64(F.lit(seed), "user", "tweet"), F.lit(50)).cast("string"))
    return t.withColumn("text", F.concat(F.lit("hello from "), F.col("user").cast("string"), F.lit(" "), tag))


def cast_list(spark: SparkSession, films: int, actors: int) -> DataFrame:
    """Typed edges (film, 'cast', actor)."""
    return spark.range(films).select(F.col("id").alias("film"), F.lit("cast").alias("kind"), F.explode(F.sequence(F.col("id") % actors, F.col("id") % actors + 4)).alias("actor"))


def image(spark: SparkSession, entries: list[tuple[tuple, object]], schema: str) -> DataFrame:
    """Literal key and value pairs, as in a test's starting state: schema names the key's columns and then the value's."""
    return spark.createDataFrame([(*k, v) for k, v in entries], schema)
