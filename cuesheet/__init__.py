"""Cue sheets on Spark: dialogue, timelines, marks, assets and audio as DataFrames."""
