"""Classification of codes by a soft vote of their nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(found: DataFrame, k_total: int = 200, k_per_class: int = 20, min_similarity: float = 0.0) -> DataFrame:
    """The neighbours (query_id, label, memory_id, sim) that vote: the best of each class, then the best of all.

    Similarities must be above the least one; equal ones are taken by memory_id.  k_per_class 0
    skips the first cut.
    """
    rows = found.where(F.col("sim") > min_similarity)
    best = [F.desc("sim"), F.asc("memory_id")]
    if k_per_class > 0:
        by = Window.partitionBy("query_id", "label").orderBy(*best)
        rows = rows.withColumn("__rn", F.row_number().over(by)).where(F.col("__rn") <= k_per_class)
    by = Window.partitionBy("query_id").orderBy(*best)
    return rows.withColumn("__rn", F.row_number().over(by)).where(F.col("__rn") <= k_total).drop("__rn")


def soft_vote(neighbours: DataFrame, temperature: Column | float = 0.35, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(*keys, label, weight, best_sim, n): exp((sim - best sim) / temperature) summed by class."""
    top = neighbours.withColumn("__top", F.max("sim").over(Window.partitionBy(*keys)))
    temperature = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    weight = F.exp((F.col("sim") - F.col("__top")) / temperature)
    return top.groupBy(*keys, "label").agg(F.sum(weight).alias("weight"), F.max("sim").alias("best_sim"), F.count("*").alias("n"))


def predictions(queries: DataFrame, votes: DataFrame, classes: list[int], keys: tuple[str, ...] = ("query_id",), digits: int = 9) -> DataFrame:
    """(*keys, predicted_class, probabilities, confidence) for every query.

    Classes without a vote have probability 0; a query without any neighbour has even ones.  The
    first of the most probable classes wins; probabilities are rounded, so that sums in another
    order do not decide.
    """
    held = votes.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("label", "weight"))).alias("w"), F.sum("weight").alias("total"))
    order = F.array(*[F.lit(c) for c in classes])
    even = F.array_repeat(F.lit(1.0 / max(len(classes), 1)), len(classes))
    shares = F.transform(order, lambda c: F.round(F.coalesce(F.try_element_at("w", c), F.lit(0.0)) / F.col("total"), digits))
    rows = queries.select(*keys).join(held, list(keys), "left")
    rows = rows.select(*keys, F.when(F.col("total") > 0, shares).otherwise(even).alias("probabilities"))
    place = F.array_position("probabilities", F.array_max("probabilities"))
    return rows.select(*keys, F.get(order, place.cast("int") - 1).alias("predicted_class"), "probabilities", F.array_max("probabilities").alias("confidence"))


def top_classes(votes: DataFrame, n: int = 3, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(*keys, rank, label, weight): each query's classes of most weight."""
    by = Window.partitionBy(*keys).orderBy(F.desc("weight"), "label")
    return votes.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n).select(*keys, "rank", "label", "weight")


def accuracy(predicted: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, n, accuracy): the share of queries whose predicted class is their label."""
    joined = predicted.join(truth.select("query_id", F.col("label").alias("truth")), "query_id")
    right = (F.col("predicted_class") == F.col("truth")).cast("double")
    return joined.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"))


def calibrate(neighbours: DataFrame, queries: DataFrame, classes: list[int], temperatures: tuple[float, ...] = (0.25, 0.35, 0.5, 0.75, 1.0)) -> DataFrame:
    """(temperature, n, accuracy, best): accuracy at each temperature; the first of the best ones is marked."""
    grid = F.posexplode(F.array(*[F.lit(t) for t in temperatures])).alias("place", "temperature")
    votes = soft_vote(neighbours.select("*", grid), F.col("temperature"), ("query_id", "place", "temperature"))
    asked = queries.select("query_id", F.posexplode(F.array(*[F.lit(t) for t in temperatures])).alias("place", "temperature"))
    keys = ("query_id", "place", "temperature")
    rates = accuracy(predictions(asked, votes, classes, keys), queries, ("place", "temperature"))
    first = rates.groupBy().agg(F.min(F.struct((-F.col("accuracy")).alias("a"), "place")).alias("b")).select("b.place")
    best = first.select(F.col("place").alias("b_place"))
    return rates.join(F.broadcast(best), F.col("place") == F.col("b_place"), "left").select("temperature", "n", "accuracy", F.col("b_place").isNotNull().alias("best"))
