"""Observations as a stream against a static graph."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.observe import match_items
from ..operators.profile import Profile


def match_stream(observations: DataFrame, items: DataFrame, profile: Profile) -> DataFrame:
    """match_items for streamed observations (query_id, observation): a stateless stream-static join, so it needs no watermark
    and loses nothing to late data. items must come from stored tables (load_parquet); they are read anew with each micro-batch."""
    return match_items(observations, items, profile)
