"""Schemas, column lists and settings shared by every module.

Columns every hourly frame carries: ``zone``, ``ts_utc`` (timestamp, UTC) and ``ts_local``
(timestamp_ntz wall clock). ``load`` is the metered label, ``load_est`` the preliminary load.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Weather variable of the source -> canonical column.
WEATHER_RENAME = {
    "temperature_2m": "Temp_F",
    "apparent_temperature": "ApparentTemp_F",
    "dew_point_2m": "Dewpoint_F",
    "relative_humidity_2m": "RelativeHumidity_pct",
    "shortwave_radiation": "SolarRadiation_Wm2",
    "wind_speed_10m": "WindSpeed_mph",
    "wind_direction_10m": "WindDirection_deg",
    "wind_gusts_10m": "WindGusts_mph",
    "precipitation": "Precip_in",
    "cloud_cover": "CloudCover_pct",
    "soil_temperature_0_to_7cm": "SoilTemp0_7cm_F",
}
WEATHER_COLS = list(WEATHER_RENAME.values())
# The forecast archive has every variable but soil temperature.
FORECAST_RENAME = {k: v for k, v in WEATHER_RENAME.items() if not k.startswith("soil")}
FORECAST_COLS = list(FORECAST_RENAME.values())
LEAD_DAYS = (1, 2)

THERMAL_SEQ_COLS = [
    "CDD_h", "HDD_h", "CDD_cum_24h", "CDD_cum_48h", "CDD_cum_72h",
    "Temp_ma_24h", "Temp_ma_72h", "Temp_delta_24h", "HeatIndex_F", "WetBulb_F",
]
CALENDAR_NAMES = [
    "tmrw_month_sin", "tmrw_month_cos", "tmrw_dow_sin", "tmrw_dow_cos",
    "tmrw_is_weekend", "tmrw_is_holiday",
]
MACRO_NAMES = [
    "macro_q05_slope_d1", "macro_q05_slope_d2", "macro_energy_ratio", "macro_lag168_err",
]
THERMAL_STATIC_NAMES = [
    "heatwave_day_count", "temp_max_prev_day", "cdd_prev_day", "temp_max_3d",
    "cdd_ratio_d1_d2", "temp_ma_d1_minus_d3", "temp_anomaly_vs_climatology",
]
FC_NAMES = [f"fc_dev_h{h}" for h in range(24)] + [
    "fc_d1_cdd_dev", "fc_d1_hdd_dev", "fc_d0_max_dev", "fc_d1_max_dev",
    "fc_2d_cdd_buildup", "fc_d1_temp_max", "fc_d1_temp_peak", "fc_heatwave_days",
]

# Season of each month, and the hours each expert of a season owns.
SEASON_MONTHS = {
    "summer": [7, 8],
    "upper_shoulder": [6, 9],
    "shoulder": [3, 4, 5, 10, 11],
    "winter": [12, 1, 2],
}
EXPERT_HOURS = {
    "summer": {
        "low": [1, 2, 3, 4, 5, 6],
        "peak": [12, 13, 14, 15, 16, 17, 18, 19, 20],
        "high": [0, 7, 8, 9, 10, 11, 21, 22, 23],
    },
    "upper_shoulder": {
        "low": [1, 2, 3, 4, 5, 6],
        "peak": [14, 15, 16, 17, 18, 19],
        "high": [0, 7, 8, 9, 10, 11, 12, 13, 20, 21, 22, 23],
    },
    "shoulder": {
        "low": [0, 1, 2, 3, 4],
        "peak": [6, 7, 8, 9, 17, 18, 19, 20],
        "high": [5, 10, 11, 12, 13, 14, 15, 16, 21, 22, 23],
    },
    "winter": {
        "low": [0, 1, 2, 3, 4],
        "peak": [6, 7, 8, 9, 17, 18, 19, 20, 21],
        "high": [5, 10, 11, 12, 13, 14, 15, 16, 22, 23],
    },
}

METERED = T.StructType([
    T.StructField("datetime_beginning_ept", T.StringType()),
    T.StructField("datetime_beginning_utc", T.StringType()),
    T.StructField("is_verified", T.StringType()),
    T.StructField("load_area", T.StringType()),
    T.StructField("mkt_region", T.StringType()),
    T.StructField("mw", T.DoubleType()),
    T.StructField("nerc_region", T.StringType()),
    T.StructField("zone", T.StringType()),
])
PRELIMINARY = T.StructType([
    T.StructField("datetime_beginning_ept", T.StringType()),
    T.StructField("datetime_beginning_utc", T.StringType()),
    T.StructField("datetime_ending_ept", T.StringType()),
    T.StructField("datetime_ending_utc", T.StringType()),
    T.StructField("load_area", T.StringType()),
    T.StructField("prelim_load_avg_hourly", T.DoubleType()),
])
HOURLY_JSON = T.StructType([
    T.StructField("zone", T.StringType()),
    T.StructField("hourly", T.StructType(
        [T.StructField("time", T.ArrayType(T.StringType()))]
        + [T.StructField(v, T.ArrayType(T.DoubleType())) for v in WEATHER_RENAME]
    )),
])
FORECAST_JSON = T.StructType([
    T.StructField("zone", T.StringType()),
    T.StructField("hourly", T.StructType(
        [T.StructField("time", T.ArrayType(T.StringType()))]
        + [T.StructField(f"{v}_previous_day{d}", T.ArrayType(T.StringType()))
           for d in LEAD_DAYS for v in FORECAST_RENAME]
    )),
])


@dataclass(frozen=True)
class SampleConfig:
    """Window lengths and rules of sample assembly; defaults are the published ones."""

    lookback: int = 168          # hours in the sequence window
    history: int = 504           # hours the macro features need (three weeks of `week` hours)
    week: int = 168              # hours of one macro week
    cutoff_hour: int = 0         # last known local hour; above 9 it is taken a day earlier
    test_frac: float = 0.16
    base_temp: float = 65.0
    tz: str = "America/New_York"
    position: str = "clock"      # "clock" after the contiguity gate, else "rank"
    seq_cols: tuple[str, ...] = tuple(["load_est"] + WEATHER_COLS + THERMAL_SEQ_COLS)
    use_forecast: bool = True


EMBARGO_DAYS = 14
# Zones whose preliminary load is published for a larger region.
LOAD_EST_DIVISOR = {"bge": 8.8}
