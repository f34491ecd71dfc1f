"""Raw sources -> cleaned hourly table."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.align import align
from ..operators.quality import clean, gate_contiguous, training_view
from ..sources.tables import stage


def cleaned_frame(metered: DataFrame, preliminary: DataFrame | None, weather: DataFrame,
                  tz: str = "America/New_York") -> DataFrame:
    """Aligned and cleaned, with the unlabelled recent tail: the serving view.

    The joined and the aligned table are each written once, so no join runs twice.
    """
    return clean(stage(align(metered, preliminary, weather, tz, staged=True), "aligned"))


def training_frame(metered: DataFrame, preliminary: DataFrame | None, weather: DataFrame,
                   tz: str = "America/New_York", gate: bool = True) -> DataFrame:
    """Labelled rows of the cleaned frame; raises on a hole in any zone."""
    view = stage(training_view(cleaned_frame(metered, preliminary, weather, tz)), "cleaned")
    return gate_contiguous(view) if gate else view
