"""Scores of a crawl: what findings weigh against what they could at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators.registry import CATEGORIES, MULTIPLIER, rules_frame


def category_scores(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """(category, load, capacity, score), a row for each category; findings without a registered rule weigh nothing.

    pages: the HTML pages that findings are weighed against, counted in the same plan.
    """
    multiplier = F.create_map(*[F.lit(x) for kv in MULTIPLIER.items() for x in kv])
    rules = rules_frame(findings.sparkSession)
    weighed = rules.select("rule_id", F.col("category"), (F.col("weight") * multiplier[F.col("severity")]).alias("w"))
    counts = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    load = weighed.join(counts, "rule_id", "left").groupBy("category").agg(F.sum(F.coalesce(F.col("n"),
                F.lit(0)) * F.col("w")).alias("load"))
    # one row, so that each category gets it by an equal key
    evaluated = pages.agg(F.count(F.lit(1)).alias("pages")).withColumn("one", F.lit(1))
    most = rules.filter(F.col("category").isin(*CATEGORIES)).groupBy("category").agg(
        (F.sum("weight") * 1.5).alias("most")).withColumn("one", F.lit(1))
    most = most.join(F.broadcast(evaluated), "one").select("category",
        (F.col("most") * F.col("pages")).alias("capacity"))
    score = F.when(F.col("capacity") > 0, F.greatest(F.lit(0.0),
            F.least(F.lit(100.0), F.round(100 * (1 - F.col("load") / F.col("capacity")), 2)))).otherwise(100.0)
    return load.join(most, "category").select("category", "load", "capacity", score.alias("score"))


def overall_score(scores: DataFrame) -> DataFrame:
    """(score): the mean of the categories'; 100 without any."""
    return scores.agg(F.coalesce(F.round(F.avg("score"), 2), F.lit(100.0)).alias("score"))


#: The column of a crawl that holds a category's score (fixed values).
SCORE_COLUMNS = {"tech_meta": "score_tech", "structure": "score_struct", "content": "score_content"}


def with_scores(crawls: DataFrame, scores: DataFrame) -> DataFrame:
    """crawls (id, ...) with their scores from rows (crawl_id, category, score), and the mean of the categories' as score_overall."""
    pick = [F.max(F.when(F.col("category") == c, F.col("score"))).cast("decimal(5,2)").alias(name) for c,
        name in SCORE_COLUMNS.items()]
    wide = scores.groupBy(F.col("crawl_id").alias("id")).agg(*pick,
        F.round(F.avg("score"), 2).cast("decimal(5,2)").alias("score_overall"))
    return crawls.drop(*SCORE_COLUMNS.values(), "score_overall").join(wide, "id", "left")
