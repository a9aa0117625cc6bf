"""Resolving voice names and sound references to files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cuesheet.operators.scans import attach, salt

# Audio file extensions.
AUDIO_EXTENSIONS = (".wav", ".mp3", ".flac", ".ogg", ".m4a", ".aac")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """Name without its last extension; a leading or closing dot starts none."""
    return F.regexp_replace(name, "^(.+)\\.[^.]+$", "$1")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, "^.+(\\.[^.]+)$", 1))


def supported(files: DataFrame, path: str = "path") -> DataFrame:
    """Files with an audio extension."""
    return files.where(extension(file_name(F.col(path))).isin(*AUDIO_EXTENSIONS))


def voice_catalog(files: DataFrame) -> DataFrame:
    """Lookup keys of the voice files: name and stem, as written and in lower case.

    Of files that share a key the first by path keeps it.
    """
    name = file_name(F.col("path"))
    keys = F.array(name, stem(name), F.lower(name), F.lower(stem(name)))
    exploded = supported(files).select("path", F.explode(F.array_distinct(keys)).alias("key"))
    return exploded.groupBy("key").agg(F.min("path").alias("path"))


def available_voices(files: DataFrame) -> DataFrame:
    """Distinct names of the supported voice files."""
    return supported(files).select(file_name(F.col("path")).alias("name")).distinct()


def resolve_voices(refs: DataFrame, files: DataFrame, directory: str) -> DataFrame:
    """Path of each distinct voice name, null where nothing matches.

    A file at the given path comes first, then one in the directory, then the catalog by six keys.
    """
    voice = F.col("voice_name")
    name = file_name(voice)
    asked = [voice, F.concat(F.lit(directory.rstrip("/") + "/"), voice)]
    catalog_keys = [voice, name, stem(name), F.lower(voice), F.lower(name), F.lower(stem(name))]
    wanted = refs.select("voice_name").distinct()
    candidates = wanted.select(
        "voice_name",
        F.explode(
            F.array(
                *[F.struct(F.lit("path").alias("kind"), c.alias("key"), F.lit(i).alias("prio")) for i, c in enumerate(asked)],
                *[
                    F.struct(F.lit("catalog").alias("kind"), c.alias("key"), F.lit(i + 2).alias("prio"))
                    for i, c in enumerate(catalog_keys)
                ],
            )
        ).alias("c"),
    ).select("voice_name", "c.*")
    lookup = (
        files.select(F.lit("path").alias("kind"), F.col("path").alias("key"), "path")
        .distinct()
        .unionByName(voice_catalog(files).select(F.lit("catalog").alias("kind"), "key", "path"))
    )
    found = candidates.join(lookup, ["kind", "key"]).groupBy("voice_name").agg(
        F.min_by("path", "prio").alias("resolved_path"), F.min("prio").alias("prio")
    )
    return wanted.join(found, "voice_name", "left")


def voices_of(rows: DataFrame, refs: DataFrame, chunk: Column) -> DataFrame:
    """Resolved paths on all rows; one voice may be asked for by a third of them."""
    return attach(rows, refs, ["voice_name"], chunk)


def missing_voices(resolved: DataFrame, directory: str) -> DataFrame:
    return resolved.where("resolved_path is null").select(
        "voice_name",
        F.concat(F.lit("Voice '"), "voice_name", F.lit(f"' was not found in {directory}")).alias("message"),
    )


def _parts(path: Column) -> Column:
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))


def _bare(parts: Column) -> Column:
    """Path parts with the extension of the last one removed."""
    return F.concat(
        F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
        F.when(F.size(parts) > 0, F.array(stem(F.element_at(parts, -1)))).otherwise(F.array().cast("array<string>")),
    )


def sound_tails(files: DataFrame) -> DataFrame:
    """Every ending of every file's path, without extension: (tail, depth_diff, path)."""
    bare = supported(files).select("path", _bare(_parts(F.col("path"))).alias("parts"))
    return bare.select(
        "path",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("parts")),
                lambda n: F.struct(
                    F.array_join(F.slice("parts", F.size("parts") - n + 1, n), "/").alias("tail"),
                    (F.size("parts") - n).alias("depth_diff"),
                ),
            )
        ).alias("t"),
    ).select("path", "t.tail", "t.depth_diff")


def sound_index(files: DataFrame) -> DataFrame:
    """Best match of every tail: (tail, depth_diff, n_best, path).

    The top rank is found with plain aggregates, which combine on the map side; a window over a tail
    that a third of the files share would not.
    """
    per_depth = sound_tails(files).groupBy("tail", "depth_diff").agg(
        F.count(F.lit(1)).alias("n"), F.min("path").alias("path")
    )
    return per_depth.groupBy("tail").agg(
        F.min("depth_diff").alias("depth_diff"),
        F.min_by("n", "depth_diff").alias("n_best"),
        F.min_by("path", "depth_diff").alias("path"),
    )


def resolve_sounds(refs: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Resolution of each distinct reference: path, or an error.

    Relative references match the end of a path, with or without extension, the shallowest file
    winning; absolute ones must name a file. ``files`` holds paths relative to ``root``.
    """
    wanted = refs.select("ref").distinct()
    absolute = F.col("ref").startswith("/")
    prefix = root.rstrip("/") + "/"
    relative = wanted.where(~absolute).withColumn("tail", F.array_join(_bare(_parts(F.col("ref"))), "/"))
    matched = relative.join(sound_index(files), "tail", "left")
    quoted = F.concat(F.lit("Sound '"), F.col("ref"), F.lit("' "))
    near = matched.select(
        "ref",
        F.coalesce("n_best", F.lit(0)).cast("bigint").alias("n_best"),
        F.when(F.col("n_best") == 1, F.concat(F.lit(prefix), "path")).alias("resolved_path"),
        F.when(F.col("n_best").isNull(), F.concat(quoted, F.lit(f"was not found under {root}")))
        .when(F.col("n_best") > 1, F.concat(quoted, F.lit(f"matched multiple files under {root}")))
        .alias("error"),
    )
    full = supported(files).select(F.concat(F.lit(prefix), "path").alias("ref"), F.lit(True).alias("_hit"))
    exact = (
        wanted.where(absolute)
        .join(full, "ref", "left")
        .select(
            "ref",
            F.when(F.col("_hit"), F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("n_best"),
            F.when(F.col("_hit"), F.col("ref")).alias("resolved_path"),
            F.when(F.col("_hit").isNull(), F.concat(quoted, F.lit("was not found as an absolute path"))).alias("error"),
        )
    )
    return near.unionByName(exact)


def ambiguous_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """The tied files of every ambiguous path ending that is asked for: (tail, path), once for all its references."""
    tails = refs.where(~F.col("ref").startswith("/")).select(
        F.array_join(_bare(_parts(F.col("ref"))), "/").alias("tail")
    ).distinct()
    tied = sound_index(files).where("n_best > 1").select("tail", "depth_diff")
    ties = sound_tails(files).join(tied, ["tail", "depth_diff"])
    return ties.join(tails, "tail", "left_semi").select("tail", "path")


def sounds_root(configured: Column, document_path: Column) -> Column:
    """Configured folder, else ``sounds`` beside the document."""
    folder = F.regexp_replace(document_path, "/?[^/]*$", "")
    beside = F.when(folder == "", F.lit("sounds")).otherwise(F.concat(folder, F.lit("/sounds")))
    return F.coalesce(configured, beside)


def normalise_once(uses: DataFrame, stage, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Run a costly per-file stage once per distinct file and share it with every use.

    ``stage`` maps the distinct files to results keyed by path. One file may serve a third of all
    uses, so the results come back through a salted join.
    """
    return attach(uses, stage(uses.select(*keys).distinct()), list(keys), salt(*uses.columns))
