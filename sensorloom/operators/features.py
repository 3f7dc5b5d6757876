"""One table of features by window: ten of the signal, six of the heart, each scaled by its session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import beats as heart
from . import kernels, splits, windows

KEYS = ["pid", "sid", "s"]
HRV = {"n_beats": "hrv_nbeats", "mean_rr": "hrv_mean_rr", "sdnn": "hrv_sdnn", "rmssd": "hrv_rmssd", "pnn50": "hrv_pnn50", "mean_hr": "hrv_mean_hr"}
KERNEL = {"scr_count": "eda_scr_count", "scr_amp_mean": "eda_scr_amp_mean", "scr_amp_max": "eda_scr_amp_max", "phasic_std": "eda_phasic_std", "tonic_slope": "eda_tonic_slope"}


def scaled(rows: DataFrame, columns: list[str], keys: list[str], deviation=F.stddev_pop, names: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with each column less its mean in the session and over its deviation and 1e-8, under its own or a new name; sums meet, not rows."""
    stats = rows.groupBy(*keys).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("d", deviation))])
    z = {(names or {}).get(c, c): (F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__d_{c}") + F.lit(1e-8)) for c in columns}
    return rows.join(stats, keys).withColumns(z).drop(*[f"__{n}_{c}" for c in columns for n in ("m", "d")])


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, v: s + v)


def signal_features(z: str, rate: float = 4.0) -> dict[str, Column]:
    """Mean, deviation, range, slope by second and mean step of an array of two samples or more."""
    n, c = F.size(z), F.col(z)
    mean = total(c) / n
    middle = (n - 1) / F.lit(2.0)
    along = F.aggregate(F.transform(c, lambda v, i: v * (i - middle)), F.lit(0.0), lambda s, v: s + v)
    steps = F.zip_with(F.slice(c, F.lit(2), n - 1), F.slice(c, F.lit(1), n - 1), lambda a, b: F.abs(a - b))
    return {
        "eda_mean": mean, "eda_std": F.sqrt(total(F.transform(c, lambda v: (v - mean) * (v - mean))) / n), "eda_range": F.array_max(c) - F.array_min(c),
        "eda_slope": along * rate * 12 / (n * (n.cast("double") * n - 1)), "eda_absdiff": total(steps) / (n - 1),
    }


def eda_hrv(samples: DataFrame, beats: DataFrame, step: int, span: float, least_mean: float, least_beats: int = 2, folds: int = 5) -> DataFrame:
    """(pid, sid, s, t_start, y, ten columns eda_, six columns hrv_, fold): labelled windows on the body with enough beats of their own recording.

    samples: (pid, sid, i, t, x, y); beats: (pid, sid, bt, rr).  The five columns of the plain signal are of samples scaled by
    session; those of its phasic and tonic parts are of raw ones.  Heart columns are scaled by session over the windows
    that are kept, by the sample deviation (null for a single window).  Folds are floors of a window's place in time.
    """
    w = windows.windows(scaled(samples, ["x"], ["pid", "sid"], names={"x": "z"}), step, 0, least_mean, ("z",)).filter("y >= 0").select(*KEYS, "t_start", "y", "x", "z")
    h = heart.variability(heart.beats_in(w, beats, span), KEYS).filter(F.col("n_beats") >= least_beats)
    parts = kernels.phasic(w).select(*KEYS, *[F.col(a).alias(b) for a, b in KERNEL.items()])
    both = w.join(h, KEYS).withColumns(signal_features("z")).drop("x", "z").join(parts, KEYS)
    out = scaled(both, list(HRV), ["pid", "sid"], F.stddev_samp, HRV).drop(*HRV)
    placed = splits.placed_by_time(out, ["pid"], "t_start", "sid", "s")
    return placed.withColumn("fold", F.floor((F.col("place") - 1) * folds / F.col("places")).cast("long")).drop("place", "places")
