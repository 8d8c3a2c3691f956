"""Hybrid retrieval: graph distance, similarity, recency, importance and confidence in one score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..errors import ValidationError
from ..functions import scores as S
from ..model import GraphView
from .lookup import within
from .traversal import distances
from .vectors import candidates, space, uses_index


def ranked(
    view: GraphView, limit: int, now_epoch_ms: int, query_vector: Sequence[float] | None = None, reference_node_id: str | None = None, edge_type: str | None = None, from_epoch_ms: int | None = None,
    to_epoch_ms: int | None = None, vector_name: str | None = None, top_k: int | None = None, profile: str | None = None, settings: config.VectorConfig = config.VectorConfig(),
) -> DataFrame:
    """All columns of the limit best nodes, score and its five parts, by score and then id.

    With a query vector, the top_k most similar nodes (all with a vector, when searched exactly) and those within three hops of the reference are
    candidates; without one, or if there are none, all nodes. The time window, if any, holds for all. The edge type
    bears on distances only."""
    if query_vector is None and reference_node_id is None:
        raise ValidationError("ranked retrieval needs a query_vector or a reference_node_id")
    if query_vector is not None and not query_vector:
        raise ValidationError("query_vector cannot be empty")
    if profile is not None and profile != S.PROFILE:
        raise ValidationError(f"unknown retrieval profile: {profile}")
    if from_epoch_ms is not None and to_epoch_ms is not None and from_epoch_ms > to_epoch_ms:
        raise ValidationError("time range start is after its end")
    limit = config.result_limit(limit)
    top_k = settings.semantic_top_k if top_k is None else config.result_limit(top_k)
    name = vector_name or config.DEFAULT_VECTOR
    near = distances(view, reference_node_id, 3, edge_type) if reference_node_id is not None else None
    slim = within(view.nodes, from_epoch_ms, to_epoch_ms).select("id", "timestamp_ms", "importance", "confidence", F.col("vectors")[name].alias("vector"))
    slim = slim.join(near, "id", "left") if near is not None else slim.withColumn("distance", F.lit(None).cast("int"))
    if query_vector is not None:
        if uses_index(view, query_vector, name, settings):
            found = candidates(view, query_vector, max(limit, top_k), None, vector_name, settings).select("id")
            slim, close = slim.join(found.withColumn("close", F.lit(True)), "id", "left"), F.coalesce("close", F.lit(False))
        else:  # all that have the vector: a condition, not a join
            found, close = space(view, vector_name), F.col("vector").isNotNull()
        if not (found if near is None or near.isEmpty() else near).isEmpty():
            slim = slim.where(close | F.col("distance").isNotNull())
    semantic = F.coalesce(S.cosine(F.col("vector"), query_vector), F.lit(0.0)) if query_vector is not None else F.lit(0.0)
    parts = slim.select(
        "id", F.coalesce(S.distance_score(F.col("distance")), F.lit(0.0)).alias("structural"), semantic.alias("semantic"),
        S.recency(F.col("timestamp_ms"), now_epoch_ms).alias("temporal"), S.signal(F.col("importance")).alias("importance"), S.signal(F.col("confidence")).alias("confidence"),
    )
    best = parts.withColumn("score", S.blended()).orderBy(F.desc("score"), "id").limit(limit)
    best = best.select("id", "score", *(F.col(x).alias(f"{x}_score") for x in S.WEIGHTS))
    return view.nodes.join(F.broadcast(best), "id").orderBy(F.desc("score"), "id")


def score_histogram(results: DataFrame) -> DataFrame:
    return results.groupBy(S.score_band(F.col("score")).alias("band")).count()
