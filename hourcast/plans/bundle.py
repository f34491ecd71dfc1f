"""A fitted model with all that serving it needs, on shared storage."""
from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.baseline import baseline_from_samples, residual_target
from ..operators.models import feature_rows, gather, hour_routes, predict_routes, regime_routes, tag_regime
from ..operators.regimes import check_regimes
from ..operators.samples import ThermalRefs
from ..schema import EXPERT_HOURS, SEASON_MONTHS, SampleConfig
from ..sources.tables import stage
from .training import Fitted


@dataclass(frozen=True)
class Bundle:
    """Models by route and the settings they were fitted with."""

    name: str
    models: Mapping[str, PipelineModel]
    features: list[str]
    cfg: SampleConfig
    residual: bool
    routed: bool
    use_forecast: bool
    window: str
    baseline_mode: str
    experts: dict
    seasons: dict
    refs: ThermalRefs | None = None

    @property
    def seq_cols(self) -> tuple[str, ...]:
        return self.cfg.seq_cols


def save_bundle(fitted: Fitted, path: str, cfg: SampleConfig, refs: ThermalRefs | None = None,
                baseline_mode: str = "hourly", experts: dict = EXPERT_HOURS, seasons: dict = SEASON_MONTHS) -> None:
    """Write ``path/<name>``: a pipeline for each route, the frozen references and the settings. The
    settings come last, so a bundle that can be found is whole."""
    check_regimes(seasons, experts)
    spark, root = fitted.rows.sparkSession, f"{path}/{fitted.name}"
    for route, m in fitted.models.items():
        m.write().overwrite().save(f"{root}/routes/{route}")
    if refs is not None:
        refs.threshold.write.mode("overwrite").parquet(f"{root}/threshold")
        refs.climatology.write.mode("overwrite").parquet(f"{root}/climatology")
    settings = {
        "name": fitted.name, "routes": list(fitted.models), "features": list(fitted.features),
        "cfg": asdict(cfg) | {"seq_cols": list(fitted.seq_cols)}, "residual": fitted.residual, "routed": fitted.routed,
        "use_forecast": fitted.use_forecast, "window": fitted.window, "baseline_mode": baseline_mode,
        "experts": {s: {e: list(h) for e, h in x.items()} for s, x in experts.items()},
        "seasons": {s: list(m) for s, m in seasons.items()}, "refs": refs is not None}
    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/settings")


def _settings(spark: SparkSession, path: str) -> list[dict]:
    try:
        return [json.loads(r.value) for r in spark.read.text(f"{path}/settings").collect()]
    except AnalysisException:
        return []


def available_models(spark: SparkSession, path: str) -> list[str]:
    """Names of the bundles under ``path``."""
    return sorted(s["name"] for s in _settings(spark, f"{path}/*"))


def load_bundle(spark: SparkSession, path: str, name: str) -> Bundle:
    found = _settings(spark, f"{path}/{name}")
    if not found:
        raise FileNotFoundError(f"no model {name!r} under {path}; there are {available_models(spark, path)}")
    s, root = found[0], f"{path}/{name}"
    models = {r: PipelineModel.load(f"{root}/routes/{r}") for r in s["routes"]}
    refs = ThermalRefs(spark.read.parquet(f"{root}/threshold"), spark.read.parquet(f"{root}/climatology")) if s["refs"] else None
    cfg = SampleConfig(**s["cfg"] | {"seq_cols": tuple(s["cfg"]["seq_cols"])})
    return Bundle(name, models, s["features"], cfg, s["residual"], s["routed"], s["use_forecast"], s["window"],
                  s["baseline_mode"], s["experts"], s["seasons"], refs)


def as_forecaster(bundle: Bundle) -> Callable[[DataFrame], DataFrame]:
    """For ``serving.apply_models``: samples to (zone, target_day, yhat of 24 hours). A residual model has the
    baseline taken off and put back in the mode it was fitted with; days whose hours lack a model are absent."""
    def forecast(samples: DataFrame) -> DataFrame:
        unknown = F.array_repeat(F.lit(None).cast("double"), 24)
        rows = samples.withColumn("y", F.coalesce("y", unknown))  # a day ahead has no target yet
        if bundle.residual:
            rows = residual_target(baseline_from_samples(rows, mode=bundle.baseline_mode))
        rows, _ = feature_rows(rows, bundle.seq_cols, "residual" if bundle.residual else "y", bundle.use_forecast, bundle.window)
        # Every route reads these rows.
        rows = stage(rows, f"serve-{bundle.name}")
        if bundle.routed:
            rows = tag_regime(rows, bundle.experts, bundle.seasons)
            routes = regime_routes(rows.sparkSession, bundle.experts, bundle.seasons)
        else:
            routes = hour_routes()
        pred = predict_routes(rows, bundle.models, routes, bundle.name)
        days = gather(pred, rows, bundle.residual)
        return days.where(F.size("yhat") == 24).select("zone", "target_day", "yhat")

    return forecast
