"""Commit index of replicated logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def commit_index(matches: DataFrame, log: DataFrame, term: str = "term") -> DataFrame:
    """Per group the highest index that a majority has reached and that is of the current term.

    matches: grp, node, match_index, current_term; log: grp, idx, term. Entries of
    earlier terms are committed only through a later one of the current term.
    """
    reached = matches.groupBy("grp").agg(
        F.element_at(F.sort_array(F.collect_list("match_index"), asc=False), (F.floor(F.count("*") / 2) + 1).cast("int")).alias("reached"), F.max("current_term").alias("now")
    )
    fit = log.join(reached, "grp").filter((F.col("idx") <= F.col("reached")) & (F.col(term) == F.col("now")))
    return reached.select("grp").join(fit.groupBy("grp").agg(F.max("idx").alias("commit_index")), "grp", "left").select("grp", F.coalesce("commit_index", F.lit(0)).alias("commit_index"))
