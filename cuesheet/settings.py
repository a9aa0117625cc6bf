"""Production settings and their defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Defaults. A falsy setting takes the first kind, only a missing one the second.
FALSY_DEFAULTS = {
    "voice_directory": "./voices",
    "sounds_directory": "./sounds",
    "output_sample_rate": 48000,
    "output_channels": 2,
    "batch_size": 10,
    "device": "cuda",
}
NULL_DEFAULTS = {"cfg_scale": 1.2, "disable_prefill": False, "ddpm_inference_steps": 8}
NATIVE_SAMPLE_RATE = 24000
ASR_SAMPLE_RATE = 16000
# Debug categories.
DEBUG_CATEGORIES = ("compose_audio", "forced_alignment", "vibevoice_output", "whisperx")


def resolve(settings: DataFrame) -> DataFrame:
    """Fill in defaults in every settings column present; debug categories lose repeats, in order."""
    changes: dict[str, Column] = {}
    for name, default in FALSY_DEFAULTS.items():
        if name in settings.columns:
            falsy = F.lit(0) if isinstance(default, int) else F.lit("")
            changes[name] = F.coalesce(F.nullif(F.col(name), falsy), F.lit(default))
    for name, default in NULL_DEFAULTS.items():
        if name in settings.columns:
            changes[name] = F.coalesce(F.col(name), F.lit(default))
    if "debug_categories" in settings.columns:
        changes["debug_categories"] = F.array_distinct("debug_categories")
    return settings.withColumns(changes)
