"""The preset catalog, name lookup and preview preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cuesheet.functions.text import strip
from cuesheet.operators.scans import attach, salt

NO_PRESET = "none"
# Presets with their stages and parameters, in order.
PRESETS = {
    "master": [("loudness", {})],
    "narrator": [
        ("highpass", {"cutoff_hz": 85.0}),
        ("compressor", {"threshold_db": -28.0, "ratio": 2.8, "attack_ms": 5.0, "release_ms": 240.0, "makeup_db": 2.2}),
        ("mid_side", {"mid_gain": 1.18, "side_gain": 0.62}),
        ("tilt", {"low_band_db": -1.4, "high_band_db": 1.6}),
        ("reflections", {"dry_mix": 0.96, "taps": [(9.0, 0.09, 0.12), (18.0, 0.07, 0.05), (31.0, 0.04, 0.06)]}),
    ],
    "thoughts": [
        ("highpass", {"cutoff_hz": 90.0}),
        ("compressor", {"threshold_db": -30.0, "ratio": 3.2, "attack_ms": 4.0, "release_ms": 260.0, "makeup_db": 2.4}),
        ("mid_side", {"mid_gain": 1.14, "side_gain": 0.72}),
        ("tilt", {"low_band_db": -1.3, "high_band_db": 1.8}),
        ("repeats", {"delay_ms": 44.0, "stereo_offset_ms": 7.0, "feedback": 0.58, "repeats": 4, "wet_gain": 0.08, "dry_mix": 0.96}),
    ],
    "outdoor1": [
        ("highpass", {"cutoff_hz": 100.0}),
        ("tilt", {"low_band_db": -0.6, "high_band_db": 1.0}),
        ("mid_side", {"mid_gain": 0.98, "side_gain": 1.18}),
        ("noise", {"relative_db": -28.0}),
        ("reflections", {"dry_mix": 0.99, "taps": [(24.0, 0.04, 0.05), (46.0, 0.03, 0.025)]}),
    ],
    "outdoor2": [
        ("highpass", {"cutoff_hz": 115.0}),
        ("mid_side", {"mid_gain": 0.97, "side_gain": 1.12}),
        ("noise", {"relative_db": -24.0}),
        ("repeats", {"delay_ms": 66.0, "stereo_offset_ms": 10.0, "feedback": 0.6, "repeats": 5, "wet_gain": 0.1, "dry_mix": 0.94}),
        ("tilt", {"low_band_db": -0.8, "high_band_db": 1.2}),
    ],
    "indoor1": [
        ("highpass", {"cutoff_hz": 80.0}),
        ("reflections", {"dry_mix": 0.93, "taps": [(12.0, 0.14, 0.09), (21.0, 0.09, 0.14), (33.0, 0.06, 0.06), (48.0, 0.04, 0.04)]}),
        ("mid_side", {"mid_gain": 1.08, "side_gain": 0.74}),
        ("tilt", {"low_band_db": 0.8, "high_band_db": -0.6}),
        ("lowpass", {"cutoff_hz": 8200.0}),
    ],
    "indoor2": [
        ("highpass", {"cutoff_hz": 85.0}),
        ("compressor", {"threshold_db": -27.0, "ratio": 2.2, "attack_ms": 7.0, "release_ms": 200.0, "makeup_db": 1.2}),
        ("reflections", {"dry_mix": 0.9, "taps": [(15.0, 0.16, 0.1), (28.0, 0.1, 0.16), (42.0, 0.07, 0.08), (63.0, 0.05, 0.05)]}),
        ("mid_side", {"mid_gain": 1.1, "side_gain": 0.66}),
        ("lowpass", {"cutoff_hz": 6500.0}),
    ],
}
# Other names of presets.
ALIASES = {"narrator1": "narrator", "narrator2": "thoughts"}
NAMES = sorted(PRESETS)
PREVIEW_NAMES = [NO_PRESET, *[name for name in NAMES if name != "master"]]


def catalog(spark: SparkSession) -> DataFrame:
    """The presets as a table: (preset, stage_no, stage, params). A fixed list of some 30 rows."""
    rows = [
        (preset, number, stage, {k: float(v) for k, v in params.items() if k != "taps"}, params.get("taps"))
        for preset, stages in PRESETS.items()
        for number, (stage, params) in enumerate(stages)
    ]
    return spark.createDataFrame(
        rows,
        "preset string, stage_no int, stage string, params map<string,double>, "
        "taps array<struct<delay_ms: double, left_gain: double, right_gain: double>>",
    )


def canonical(name: Column) -> Column:
    """Preset name without case, spaces and aliases."""
    plain = F.lower(strip(name))
    aliases = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, plain), plain)


def preset_error(name: Column) -> Column:
    """Message for a name that is no preset, else null."""
    return F.when(
        ~canonical(name).isin(*NAMES),
        F.concat(F.lit("Unknown preset '"), name, F.lit(f"'. Available presets: {', '.join(NAMES)}")),
    )


def no_preset(name: Column) -> Column:
    """Whether a clip asks for no preset: null, blank, or the name for none."""
    return F.coalesce(canonical(name).isin(NO_PRESET, ""), F.lit(True))


def with_chain(clips: DataFrame, presets: DataFrame, name: str = "preset") -> DataFrame:
    """Clips with the stages of their preset, in order. The catalog is a fixed list, so it is broadcast."""
    named = clips.withColumn("preset", canonical(F.col(name)))
    return named.join(F.broadcast(presets), "preset")


def preparations(requests: DataFrame, prepared: DataFrame) -> DataFrame:
    """Previews still to make: each clip's distinct known names in order, without prepared ones.

    ``requests``: clip_id, names array. ``prepared``: clip_id, preset. An explode, not a product of
    clips and presets.
    """
    distinct = F.array_distinct(F.transform("names", canonical))
    asked = requests.select("clip_id", F.posexplode(distinct).alias("idx", "preset"))
    return asked.where(F.col("preset").isin(*PREVIEW_NAMES)).join(prepared, ["clip_id", "preset"], "left_anti")


def preparation_errors(requests: DataFrame) -> DataFrame:
    """Requests with an unknown name, or none at all."""
    unknown = F.filter(F.transform("names", canonical), lambda n: ~n.isin(*PREVIEW_NAMES))
    return requests.select(
        "clip_id",
        F.when(F.size("names") == 0, F.lit("At least one preset name is required"))
        .when(F.size(unknown) > 0, F.concat(F.lit("Unknown preset: "), F.element_at(unknown, 1)))
        .alias("error"),
    ).where("error is not null")


def slice_status(requests: DataFrame, prepared: DataFrame) -> DataFrame:
    """Whether a slice can be served: ok, unknown preset, or not prepared yet."""
    named = requests.withColumn("preset", canonical(F.col("preset_name")))
    done = prepared.select("clip_id", "preset", F.lit(True).alias("_done"))
    status = (
        F.when(F.col("_done") | (F.col("preset") == NO_PRESET), "ok")
        .when(F.col("preset").isin(*PREVIEW_NAMES), "not prepared")
        .otherwise("unknown preset")
    )
    # Many requests may ask for the same clip and preset.
    joined = attach(named, done, ["clip_id", "preset"], salt(*named.columns), "left")
    return joined.withColumn("status", status).drop("_done")


def preview_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, n in enumerate(PREVIEW_NAMES)], "idx int, preset string")
