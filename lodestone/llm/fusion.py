"""One ranking from scores on unlike scales: reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranking import grouped_rank


def best_scores(df: DataFrame, scores: list[str], query: str = "query_id", item: str = "document_id") -> DataFrame:
    """One row per query and item with its best value of each score; NaN counts as null, rows without keys are left out."""
    rows = df.where(F.col(query).isNotNull() & F.col(item).isNotNull())
    best = [F.max(F.when(~F.isnan(s), F.col(s))).alias(s) for s in scores]
    return rows.groupBy(query, item).agg(*best)


def fuse(df: DataFrame, scores: list[str], query: str = "query_id", item: str = "document_id", constant: int = 60) -> DataFrame:
    """``query, item, place_<score>..., place_sum, rrf, rank``: every item of every query, ranked by the fused score.

    An item's place in a score is 1 + the number of items of its query with a higher value; null is below all values,
    equal values share a place. ``rrf`` sums ``1 / (constant + place)``; ``rank`` orders by it, then by the sum of the
    places, then by item. Scores only enter by order, so no scale outweighs another. Repeated rows count once; an
    empty table gives an empty result; other columns, whatever their names, are not looked at. Places are found over
    range partitions, so a query may have any share of all candidates.
    """
    ranked = best_scores(df, scores, query, item)
    for s in scores:
        ranked = grouped_rank(ranked, [query], [(f"`{s}`", "desc")], f"place_{s}")
    places = [F.col(f"place_{s}") for s in scores]
    fused = ranked.select(
        query,
        item,
        *places,
        sum(places[1:], places[0]).alias("place_sum"),
        F.round(sum((F.lit(1.0) / (constant + p) for p in places[1:]), F.lit(1.0) / (constant + places[0])), 12).alias("rrf"),
    )
    return grouped_rank(fused, [query], [("rrf", "desc"), ("place_sum", "asc"), (f"`{item}`", "asc")], "rank", ties=False)


def first_of_each(fused: DataFrame, query: str = "query_id", item: str = "document_id") -> DataFrame:
    """The first item of each query's fused ranking."""
    return fused.where("rank = 1").select(query, item)
