"""Audio over embeddings: 64 values are 64 mono frames or 32 stereo frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cuesheet.functions.timing import clean_zero
from cuesheet.operators import blocks as B
from cuesheet.operators import frames as FR
from cuesheet.operators import recursion as R
from cuesheet.operators import mixdown as MX
from cuesheet.operators import timeline as L
from cuesheet.operators.presets import PRESETS, canonical, no_preset, preset_error
from cuesheet.registry.common import table
from cuesheet.registry.timeline import _MIX, _TREE, _overlapping, clips, hierarchy
from cuesheet.session import work_path
from cuesheet.sources import wav

RATE = 1000
BLOCK = 8


def _stereo_clips(spark, sf_dir):
    half = lambda rest: F.transform(
        F.sequence(F.lit(0), F.lit(31)), lambda i: F.get("embedding", i * 2 + rest)
    )
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("clip_id"), half(0).alias("l"), half(1).alias("r")
    )


def _stereo(spark, sf_dir):
    return FR.stereo_frames(_stereo_clips(spark, sf_dir), F.col("l"), F.col("r"))


def _blocks(spark, sf_dir):
    return B.cut_blocks(_stereo_clips(spark, sf_dir), F.col("l"), F.col("r"), BLOCK)


def _shown(stereo):
    return stereo.select(
        "clip_id", F.col("frame").cast("bigint").alias("frame"),
        clean_zero(F.col("l").cast("double"), 6).alias("l"), clean_zero(F.col("r").cast("double"), 6).alias("r"),
    )


def _mono(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.posexplode("embedding").alias("frame", "value"))
    return rows.select("clip_id", F.col("frame").cast("bigint").alias("frame"), F.lit(0).alias("ch"), "value")


def _channels(spark, sf_dir):
    both = F.array(F.struct(F.lit(0).alias("ch"), F.col("l").alias("value")), F.struct(F.lit(1).alias("ch"), F.col("r").alias("value")))
    return _stereo(spark, sf_dir).select("clip_id", "frame", F.explode(both).alias("s")).select("clip_id", "frame", "s.ch", "s.value")


def _valued(frames):
    return frames.select("clip_id", "frame", F.col("ch").cast("int").alias("ch"), clean_zero(F.col("value").cast("double"), 6).alias("value"))


def channels_down(spark, sf_dir):
    return _valued(FR.convert_channels(_channels(spark, sf_dir), 2, 1))


def channels_up(spark, sf_dir):
    return _valued(FR.convert_channels(_channels(spark, sf_dir), 2, 3))


def mid_side(spark, sf_dir):
    return _shown(FR.mid_side(_stereo(spark, sf_dir), 1.18, 0.62))


def db_gain(spark, sf_dir):
    return _shown(FR.gain(_stereo(spark, sf_dir), -4.5))


def early_reflections(spark, sf_dir):
    stereo = _stereo(spark, sf_dir)
    taps = FR.reflection_taps(RATE, PRESETS["narrator"][4][1]["taps"])
    return _shown(FR.add_taps(stereo, FR.clip_lengths(stereo), taps, 0.96))


def feedback_repeats(spark, sf_dir):
    stereo = _stereo(spark, sf_dir)
    taps = FR.repeat_taps(RATE, 6.0, 1.0, 0.6, 5, 0.1)
    return _shown(FR.add_taps(stereo, FR.clip_lengths(stereo), taps, 0.94))


def block_reflections(spark, sf_dir):
    taps = FR.reflection_taps(RATE, PRESETS["narrator"][4][1]["taps"])
    return _shown(B.block_frames_table(B.run_stage(_blocks(spark, sf_dir), B.echoes(taps, 0.96), BLOCK)))


def block_mid_side(spark, sf_dir):
    return _shown(B.block_frames_table(B.mid_side_stage(_blocks(spark, sf_dir), 1.18, 0.62)))


# Own presets of the tree's queries, which SQL can follow: a projection, a gain and echoes.
CHAINS = {
    "wide": B.mid_side(1.18, 0.62),
    "loud": B.Local(lambda x, _, __: x * 0.75),
    "echo": B.echoes([(3, 0.3, 0.2), (11, 0.1, 0.15)], 0.9),
}


def _placed_tree(spark, sf_dir):
    """The region hierarchy: three of four nations and every seventh customer have a preset, customers play embeddings."""
    placements, summaries = L.compose_tree(hierarchy(spark, sf_dir), 4, 2)
    number = F.substring("node_id", 2, 20).cast("bigint")
    nation = F.when(number % 4 == 0, "wide").when(number % 4 == 1, "loud").when(number % 4 == 2, "echo")
    placed = placements.withColumns(
        {
            "preset": F.when(F.col("is_container"), nation).otherwise(F.when(number % 7 == 0, "loud")),
            "clip_id": number % 500,
            "first": number % 5,
        }
    )
    return placed, L.trim_to_boundary(summaries.where("depth = 0"), 4)


def plan_audio(spark, sf_dir):
    """Whole productions from a placed tree, frame by frame: gaps, overlaps, presets inside presets, boundary trim."""
    placed, productions = _placed_tree(spark, sf_dir)
    done = MX.mix_tree(placed, productions, _blocks(spark, sf_dir), MX.by_chain(CHAINS, BLOCK), 2, BLOCK)
    return _shown(B.block_frames_table(done)).withColumnRenamed("clip_id", "production")


def block_slices(spark, sf_dir):
    """Three overlapping parts of every clip, moved to one new clip with a pause, over block edges."""
    moves = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("clip_id"), (F.col("vec_id") % 97).alias("target"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")
    ).select(
        "clip_id", "target", (F.col("k") * 7 + F.col("clip_id") % 4).alias("first"),
        (F.col("k") * 7 + F.col("clip_id") % 4 + 13).alias("last"), (F.col("clip_id") * 5 + F.col("k") * 9 + 2).alias("at"),
    )
    lengths = moves.groupBy(F.col("target").alias("clip_id")).agg(F.max(F.col("at") + 15).alias("frames"))
    return _shown(B.block_frames_table(MX.move(_blocks(spark, sf_dir), moves, lengths, BLOCK)))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.col("label").cast("bigint").alias("label"))


def block_slice_times(spark, sf_dir):
    """Time slices of blocks, every fifth open at its end, every thirteenth reversed and so left out."""
    start = (F.col("clip_id") % 25).cast("double") / 100 + 0.006
    end = F.when(F.col("clip_id") % 5 != 0, F.when(F.col("clip_id") % 13 == 0, start - 0.05).otherwise(start + 0.105))
    slices = _vectors(spark, sf_dir).select("clip_id", (F.col("clip_id") * 10 + 1).alias("target"), start.alias("start"), end.alias("end"))
    return _shown(B.block_frames_table(MX.slice_blocks(_blocks(spark, sf_dir), slices, 100, BLOCK)))


def block_splice(spark, sf_dir):
    """Each clip cut at three markers, with ten frames of its neighbour between the parts."""
    blocks, ids = _blocks(spark, sf_dir), _vectors(spark, sf_dir)
    middle = (F.col("clip_id") * 7 % 40).cast("bigint")
    full = F.lit(32).cast("bigint")
    marks = F.array(F.lit(0).cast("bigint"), F.least(middle, full), F.greatest(F.least(middle, full), F.lit(20).cast("bigint")), full)
    parts = MX.marker_parts(ids.select("clip_id", F.col("clip_id").alias("target"), marks.alias("frames")))
    inline = ids.select(
        F.col("clip_id"), F.greatest(F.col("clip_id") - 1, F.lit(0)).alias("target"),
        F.explode(F.array(F.lit(1), F.lit(3)).cast("array<bigint>")).alias("idx"),
        F.lit(4).cast("bigint").alias("first"), F.lit(14).cast("bigint").alias("last"),
    ).where("clip_id > 0")
    return _shown(B.block_frames_table(MX.chain(blocks, parts.unionByName(inline), BLOCK)))


def block_line_clips(spark, sf_dir):
    """The clips of a label as the lines of one script: joined to one clip, in order."""
    lines = _vectors(spark, sf_dir).select("clip_id", F.col("label").alias("target"), F.col("clip_id").alias("line_no"))
    return _shown(B.block_frames_table(MX.join_lines(_blocks(spark, sf_dir), lines, BLOCK)))


def block_loudness(spark, sf_dir):
    return _shown(B.block_frames_table(B.loudness_stage(_blocks(spark, sf_dir), 40)))


def block_asr_view(spark, sf_dir):
    """What a recogniser is given, from blocks: mono, at its rate."""
    found = B.asr_blocks(_blocks(spark, sf_dir), 24_000, BLOCK).select("clip_id", "start_frame", F.posexplode("samples").alias("pos", "value"))
    return _valued(found.select("clip_id", (F.col("start_frame") + F.col("pos")).alias("frame"), F.lit(0).alias("ch"), "value"))


def wav_files(spark, sf_dir):
    """All clips as stereo files, written in parts and read back; odd ids as floats, even ones as 16-bit numbers."""
    folder = work_path(spark, "wavs")
    blocks = _blocks(spark, sf_dir)
    for odd in (0, 1):
        named = blocks.where(F.col("clip_id") % 2 == odd).withColumn("path", F.format_string("%d/c%d.wav", F.lit(odd), "clip_id"))
        wav.write_wavs(named, folder, 24_000, bool(odd))
    found = wav.read_wavs(spark, f"{folder}/*/*.wav", 11)
    number = F.regexp_extract("clip_id", "c([0-9]+)[.]wav$", 1).cast("bigint")
    return _shown(B.block_frames_table(found.withColumn("clip_id", number)))


def clip_rms(spark, sf_dir):
    return FR.rms(_stereo(spark, sf_dir)).select("clip_id", clean_zero(F.col("rms"), 6).alias("rms"))


def diff_rms(spark, sf_dir):
    stereo = _stereo(spark, sf_dir)
    return FR.difference_rms(FR.mid_side(stereo, 1.18, 0.62), stereo).select("clip_id", clean_zero(F.col("rms"), 6).alias("rms"))


def loudness_gain(spark, sf_dir):
    gains = FR.loudness_gain(_stereo(spark, sf_dir), 40)
    return gains.select("clip_id", clean_zero(F.col("loudness"), 6).alias("loudness"), clean_zero(F.col("gain"), 6).alias("gain"))


def loudness_applied(spark, sf_dir):
    stereo = _stereo(spark, sf_dir)
    return _shown(FR.apply_gain(stereo, FR.loudness_gain(stereo, 40)))


def compressor(spark, sf_dir):
    params = PRESETS["narrator"][1][1]
    return _shown(B.block_frames_table(R.compressor(_blocks(spark, sf_dir), **params, rate=RATE)))


def highpass(spark, sf_dir):
    return _shown(B.block_frames_table(R.band_filter(_blocks(spark, sf_dir), "highpass", 85.0, RATE, BLOCK)))


def tilt(spark, sf_dir):
    # At this rate both band edges lie inside the band.
    return _shown(B.block_frames_table(R.tilt(_blocks(spark, sf_dir), -1.4, 1.6, 16_000, BLOCK)))


def resample_up(spark, sf_dir):
    mono = _mono(spark, sf_dir)
    lengths = mono.groupBy("clip_id").agg((F.max("frame") + 1).alias("frames"))
    return _valued(FR.resample(mono, lengths, 24_000, 48_000))


def resample_asr(spark, sf_dir):
    stereo = _channels(spark, sf_dir)
    lengths = stereo.groupBy("clip_id").agg((F.max("frame") + 1).alias("frames"))
    return _valued(FR.asr_view(stereo, lengths, 2, 24_000))


def resample_blocks(spark, sf_dir):
    done = B.resample_blocks(_blocks(spark, sf_dir), 24_000, 48_000, BLOCK)
    return _shown(B.block_frames_table(done))


def convert_format(spark, sf_dir):
    mono = _mono(spark, sf_dir)
    lengths = mono.groupBy("clip_id").agg((F.max("frame") + 1).alias("frames"))
    return _valued(FR.convert_format(mono, lengths, 1, 24_000, 2, 48_000))


def noise_bed(spark, sf_dir):
    return _shown(FR.add_noise(_stereo(spark, sf_dir), -24.0))


def block_noise(spark, sf_dir):
    return _shown(B.block_frames_table(B.noise_stage(_blocks(spark, sf_dir), -24.0)))


def preset_chain(spark, sf_dir):
    """Every clip goes through the preset its label picks; some have none."""
    names = [*PRESETS, None, "none", " Narrator1 "]
    picked = F.get(F.array(*[F.lit(n) for n in names]), F.pmod(F.col("clip_id"), F.lit(len(names))).cast("int"))
    blocks = _blocks(spark, sf_dir).withColumn("preset", picked)
    return _shown(B.block_frames_table(B.by_preset(blocks, RATE, BLOCK)))


def preset_difference(spark, sf_dir):
    """How much a preset changes each clip."""
    blocks = _blocks(spark, sf_dir)
    wet = B.block_frames_table(B.apply_preset(blocks, "indoor1", RATE, BLOCK))
    return FR.difference_rms(wet, _stereo(spark, sf_dir)).select("clip_id", clean_zero(F.col("rms"), 5).alias("rms"))


def mix_blocks(spark, sf_dir):
    placed = _overlapping(spark, sf_dir).select("label", "start_frame", "samples")
    mixed = B.mix_blocks(placed, ["label"], 50)
    rows = mixed.select("label", "block_no", F.posexplode("samples").alias("at", "value"))
    return rows.select(
        "label", (F.col("block_no") * 50 + F.col("at")).alias("frame"), clean_zero(F.col("value"), 6).alias("value")
    )


def custom_stage(spark, sf_dir):
    """A user's own stage, a short echo: a block needs three frames before it, a clip's start has none."""

    def factory():
        def kernel(x, at_start, at_end):
            made = x * 0.5
            made[..., 3:] += x[..., :-3] * 0.25
            return made

        return kernel

    return _shown(B.block_frames_table(B.apply_custom(_blocks(spark, sf_dir), factory, 3, 0, BLOCK)))


def stateful_stage(spark, sf_dir):
    """A user's own stage with a memory: samples are divided by the loudest one of either channel so far."""

    def factory():
        def hold(x, peak):
            peaks = np.maximum.accumulate(np.append(peak or 0.0, np.abs(x).max(axis=0)))[1:]
            return np.divide(x, peaks, out=np.zeros_like(x), where=peaks > 0), float(peaks[-1])

        return hold

    return _shown(B.block_frames_table(B.apply_stateful(_blocks(spark, sf_dir), factory)))


def silent_blocks(spark, sf_dir):
    """Pieces far apart: every block of the timeline is there, with silence where nothing sounds."""
    placed = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("label"), (F.col("vec_id") * 130).alias("start_frame"),
        F.transform("embedding", lambda x: x.cast("double")).alias("samples"),
    )
    lengths = placed.groupBy("label").agg(F.max(F.col("start_frame") + F.size("samples")).alias("frames"))
    mixed = B.fill_silence(B.mix_blocks(placed, ["label"], 50), lengths, ["label"], 50)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return mixed.select("label", "block_no", clean_zero(total, 4).alias("total"), F.size("samples").cast("bigint").alias("n"))


def preset_route(spark, sf_dir):
    """Names in any spelling, none, and unknown ones: each clip has a preset, passes, or has an error."""
    asked = ["narrator1", " Thoughts ", None, "none", "", "the moon", "INDOOR1", "master"]
    name = F.get(F.array(*[F.lit(n) for n in asked]), F.pmod(F.col("clip_id"), F.lit(len(asked))).cast("int"))
    clips = _blocks(spark, sf_dir).select("clip_id", "total", name.alias("preset"))
    chosen = F.when(~no_preset(F.col("preset")) & preset_error(F.col("preset")).isNull(), canonical(F.col("preset")))
    routed = clips.select("clip_id", chosen.alias("routed")).distinct()
    return routed.join(B.preset_problems(clips), "clip_id", "left")


def wav_pcm(spark, sf_dir):
    made = clips(spark, sf_dir).select("idx", "samples", wav.wav_bytes(F.col("samples"), 24_000, False).alias("wav"))
    return made.select(
        "idx", F.length("wav").cast("bigint").alias("n_bytes"), F.lower(F.hex(F.substring("wav", 1, 44))).alias("header"),
        F.sha2(F.expr("substring(wav, 45)"), 256).alias("payload_sha256"),
    )


def wav_float(spark, sf_dir):
    made = clips(spark, sf_dir).select("idx", wav.wav_bytes(F.col("samples"), 24_000, True).alias("wav"))
    return made.select("idx", F.length("wav").cast("bigint").alias("n_bytes"), F.lower(F.hex(F.substring("wav", 1, 44))).alias("header"))


QUERIES = {
    "plan_audio": plan_audio,
    "block_slices": block_slices,
    "wav_files": wav_files,
    "block_slice_times": block_slice_times,
    "block_splice": block_splice,
    "block_line_clips": block_line_clips,
    "block_loudness": block_loudness,
    "block_asr_view": block_asr_view,
    "channels_down": channels_down,
    "channels_up": channels_up,
    "mid_side": mid_side,
    "db_gain": db_gain,
    "early_reflections": early_reflections,
    "feedback_repeats": feedback_repeats,
    "block_reflections": block_reflections,
    "block_mid_side": block_mid_side,
    "clip_rms": clip_rms,
    "diff_rms": diff_rms,
    "loudness_gain": loudness_gain,
    "loudness_applied": loudness_applied,
    "compressor": compressor,
    "highpass": highpass,
    "tilt": tilt,
    "resample_up": resample_up,
    "resample_asr": resample_asr,
    "resample_blocks": resample_blocks,
    "convert_format": convert_format,
    "noise_bed": noise_bed,
    "block_noise": block_noise,
    "preset_chain": preset_chain,
    "preset_difference": preset_difference,
    "mix_blocks": mix_blocks,
    "silent_blocks": silent_blocks,
    "custom_stage": custom_stage,
    "stateful_stage": stateful_stage,
    "preset_route": preset_route,
    "wav_pcm": wav_pcm,
    "wav_float": wav_float,
}

_STEREO = """
st AS (
  SELECT vec_id AS clip_id, i::BIGINT AS frame, embedding[2 * i + 1] AS l, embedding[2 * i + 2] AS r
  FROM embeddings, (SELECT unnest(range(32)) AS i) AS n)"""


def _round(x):
    return f"CASE WHEN round(({x})::DOUBLE, 6) = 0 THEN 0.0 ELSE round(({x})::DOUBLE, 6) END"


def _sql_shown(source="o"):
    return f"SELECT clip_id, frame, {_round('l')} AS l, {_round('r')} AS r FROM {source}"


def _sql_taps(taps, dry):
    values = ", ".join(f"({d}, {float(gl)!r}::DOUBLE, {float(gr)!r}::DOUBLE)" for d, gl, gr in taps)
    return f"""WITH {_STEREO},
taps(d, gl, gr) AS (VALUES {values}),
m AS (SELECT clip_id, frame, (l::DOUBLE + r::DOUBLE) / 2 AS v FROM st),
e AS (SELECT clip_id, frame + d AS frame, sum(v * gl) AS l, sum(v * gr) AS r FROM m, taps GROUP BY clip_id, frame + d),
o AS (
  SELECT st.clip_id, st.frame, (st.l::DOUBLE * {dry}::DOUBLE + coalesce(e.l, 0))::FLOAT AS l,
         (st.r::DOUBLE * {dry}::DOUBLE + coalesce(e.r, 0))::FLOAT AS r
  FROM st LEFT JOIN e ON e.clip_id = st.clip_id AND e.frame = st.frame)
{_sql_shown()}"""


def _sql_resample(source, input_rate, output_rate, n_frames):
    up, down = FR.resample_ratio(input_rate, output_rate)
    half = 10 * max(up, down)
    taps = ", ".join(repr(float(t)) for t in FR.resample_taps(up, down))
    end = -(-n_frames * up // down)
    return f"""
h AS (SELECT [{taps}]::DOUBLE[] AS t),
n AS (SELECT unnest(range({end}))::BIGINT AS m),
rs AS (
  SELECT clip_id, ch, m AS frame, sum(value::DOUBLE * t[(m * {down} - frame * {up} + {half} + 1)::BIGINT])::FLOAT AS value
  FROM {source} JOIN n ON frame * {up} BETWEEN m * {down} - {half} AND m * {down} + {half}, h GROUP BY clip_id, ch, m)"""


_MONO = """
mono AS (
  SELECT vec_id AS clip_id, generate_subscripts(embedding, 1)::BIGINT - 1 AS frame, 0 AS ch, unnest(embedding) AS value FROM embeddings)"""
_SHOW_VALUE = f"SELECT clip_id, frame, ch::INTEGER AS ch, {_round('value')} AS value"


def _sql_filter(name, source, kind, cutoff, rate, n=32, pad=B.PAD):
    """Zero-phase filter as two recursive walks; one walk step moves every (clip, channel) on. The coefficients are SQL."""
    k = f"tan(pi() * {cutoff}::DOUBLE / {rate})"
    scale = f"(1 / (1 + sqrt(2::DOUBLE) * {k} + {k} * {k}))"
    b = [f"({factor} * {scale})" for factor in ((f"{k} * {k}", f"2 * {k} * {k}", f"{k} * {k}") if kind == "lowpass" else (1, -2, 1))]
    a = [1, f"(2 * ({k} * {k} - 1) * {scale})", f"((1 - sqrt(2::DOUBLE) * {k} + {k} * {k}) * {scale})"]
    level = f"(({b[0]} + {b[1]} + {b[2]}) / (1 + {a[1]} + {a[2]}))"
    z1, z2 = f"({level} - {b[0]})", f"({b[2]} - {a[2]} * {level})"
    total = n + 2 * pad

    def walk(out, feed):
        return f"""
{out} AS (
  SELECT clip_id, ch, 0::BIGINT AS i, x * {b[0]} + x * {z1} AS y,
         x * {b[1]} - (x * {b[0]} + x * {z1}) * {a[1]} + x * {z2} AS s1,
         x * {b[2]} - (x * {b[0]} + x * {z1}) * {a[2]} AS s2
  FROM {feed} WHERE i = 0
  UNION ALL
  SELECT w.clip_id, w.ch, f.i, f.x * {b[0]} + w.s1, f.x * {b[1]} - (f.x * {b[0]} + w.s1) * {a[1]} + w.s2,
         f.x * {b[2]} - (f.x * {b[0]} + w.s1) * {a[2]}
  FROM {out} w JOIN {feed} f ON f.clip_id = w.clip_id AND f.ch = w.ch AND f.i = w.i + 1)"""

    return f"""
{name}_ext AS MATERIALIZED (
  SELECT clip_id, ch, frame + {pad} AS i, x FROM {source}
  UNION ALL SELECT q.clip_id, q.ch, {pad} - q.frame, 2 * p.x - q.x FROM {source} q JOIN {source} p USING (clip_id, ch)
    WHERE p.frame = 0 AND q.frame BETWEEN 1 AND {pad}
  UNION ALL SELECT q.clip_id, q.ch, {pad} + 2 * {n - 1} - q.frame, 2 * p.x - q.x FROM {source} q JOIN {source} p USING (clip_id, ch)
    WHERE p.frame = {n - 1} AND q.frame BETWEEN {n - 1 - pad} AND {n - 2}),
{walk(f"{name}_there", f"{name}_ext")},
{name}_turn AS MATERIALIZED (SELECT clip_id, ch, {total - 1} - i AS i, y AS x FROM {name}_there),
{walk(f"{name}_back", f"{name}_turn")},
{name} AS (
  SELECT clip_id, ch, {total - 1} - i - {pad} AS frame, y::FLOAT AS y FROM {name}_back WHERE {total - 1} - i - {pad} BETWEEN 0 AND {n - 1})"""


_CH = f"""{_STEREO},
src AS MATERIALIZED (
  SELECT clip_id, frame, 0 AS ch, l::DOUBLE AS x FROM st UNION ALL SELECT clip_id, frame, 1, r::DOUBLE FROM st)"""


def _sql_pivot(source, column="y"):
    return f"""o AS (SELECT clip_id, frame::BIGINT AS frame, max({column}) FILTER (ch = 0) AS l, max({column}) FILTER (ch = 1) AS r
FROM {source} GROUP BY clip_id, frame) {_sql_shown()}"""


_COMP = PRESETS["narrator"][1][1]
_LOUD = f"""{_STEREO},
hp AS (SELECT clip_id, frame // 4 AS hop, sum(l::DOUBLE ** 2 + r::DOUBLE ** 2) AS s, count(*) AS n FROM st GROUP BY clip_id, frame // 4),
wn AS (SELECT clip_id, unnest(range(greatest(hop - 3, 0), hop + 1)) AS w, s, n FROM hp),
ms AS (SELECT clip_id, w, sum(s) / sum(n) AS ms, sum(n) AS n FROM wn GROUP BY clip_id, w HAVING sum(n) >= 16 OR w = 0),
ld AS (SELECT * FROM ms WHERE 10 * log10(greatest(ms, 1e-12)) > -70),
mn AS (SELECT clip_id, avg(ms) AS mean FROM ld GROUP BY clip_id),
fi AS (SELECT ld.clip_id, 10 * log10(avg(ms)) AS loudness FROM ld JOIN mn USING (clip_id) WHERE ms > mean / 10 GROUP BY ld.clip_id),
gn AS (
  SELECT c.clip_id, loudness, coalesce(pow(10.0::DOUBLE, (-24.0::DOUBLE - loudness) / 20), 1.0) AS gain
  FROM (SELECT DISTINCT clip_id FROM ms) c LEFT JOIN fi USING (clip_id))"""
_MIDSIDE = f"""{_STEREO},
o AS (
  SELECT clip_id, frame, (0.5::DOUBLE * (l::DOUBLE + r::DOUBLE) * 1.18::DOUBLE + 0.5::DOUBLE * (l::DOUBLE - r::DOUBLE) * 0.62::DOUBLE)::FLOAT AS l,
         (0.5::DOUBLE * (l::DOUBLE + r::DOUBLE) * 1.18::DOUBLE - 0.5::DOUBLE * (l::DOUBLE - r::DOUBLE) * 0.62::DOUBLE)::FLOAT AS r FROM st)"""
_REFLECTED = _sql_taps(FR.reflection_taps(RATE, PRESETS["narrator"][4][1]["taps"]), 0.96)

def _sql_unit(channel, salt):
    start = f"((frame * 1000003 + {channel * 7919 + 7 * 104729 + salt * 15485863}) % 2147483647)"
    once = f"(({start} * 48271) % 2147483647)"
    return f"((((({once} * {once} + {start}) % 2147483647) * 69621) % 2147483647) + 0.5::DOUBLE) / 2147483647.0::DOUBLE"


def _sql_normal(channel):
    return f"sqrt(-2.0::DOUBLE * ln({_sql_unit(channel, 0)})) * cos(2 * pi() * ({_sql_unit(channel, 1)}))"


_NOISY = f"""WITH {_STEREO},
n AS (SELECT *, {_sql_normal(0)} AS nl, {_sql_normal(1)} AS nr FROM st),
k AS (
  SELECT clip_id, greatest(sqrt(avg(l::DOUBLE * l + r::DOUBLE * r) / 2) * pow(10.0::DOUBLE, -24.0::DOUBLE / 20), 1e-4::DOUBLE)
         / greatest(sqrt(avg(nl * nl + nr * nr) / 2), 1e-6::DOUBLE) AS k FROM n GROUP BY clip_id),
o AS (SELECT n.clip_id, frame, (l + nl * k)::FLOAT AS l, (r + nr * k)::FLOAT AS r FROM n JOIN k ON k.clip_id = n.clip_id)
{_sql_shown()}"""

_TREE_AUDIO = f"""{_STEREO},{_TREE},
mid_abs AS (
  SELECT m.production, m.node_id, m.idx, m.frames, cursor + pre - s.min_start AS abs_start, m.min_start
  FROM mid_cur m JOIN mid_sum s ON m.parent_id = s.node_id),
leaf_abs AS (
  SELECT l.production, l.parent_id AS bus, l.idx, l.frames, cursor + pre - a.min_start AS place
  FROM leaf_cur l JOIN mid_abs a ON l.parent_id = a.node_id),
heard AS (
  SELECT bus, place + frame - idx % 5 AS frame, CASE WHEN idx % 7 = 0 THEN (l::DOUBLE * 0.75)::FLOAT ELSE l END AS l,
         CASE WHEN idx % 7 = 0 THEN (r::DOUBLE * 0.75)::FLOAT ELSE r END AS r
  FROM leaf_abs JOIN st ON clip_id = idx % 500 AND frame >= idx % 5 AND frame < idx % 5 + frames),
inside AS (SELECT bus, frame, sum(l::DOUBLE) AS l, sum(r::DOUBLE) AS r FROM heard GROUP BY bus, frame),
bus AS (
  SELECT a.*, i.frame, CASE WHEN idx % 4 < 3 THEN i.l::FLOAT::DOUBLE ELSE i.l END AS l,
         CASE WHEN idx % 4 < 3 THEN i.r::FLOAT::DOUBLE ELSE i.r END AS r
  FROM mid_abs a JOIN inside i ON i.bus = a.node_id),
echoed AS (
  SELECT production, abs_start, frames, node_id, frame + d AS frame, CASE WHEN d = 0 THEN l * dry ELSE (l + r) / 2 * gl END AS l,
         CASE WHEN d = 0 THEN r * dry ELSE (l + r) / 2 * gr END AS r
  FROM bus, (VALUES (0, 0.9::DOUBLE, 0::DOUBLE, 0::DOUBLE), (3, 0, 0.3, 0.2), (11, 0, 0.1, 0.15)) AS t(d, dry, gl, gr)
  WHERE idx % 4 = 2 AND frame + d < frames),
treated AS (
  SELECT production, abs_start + frame AS frame, (0.5::DOUBLE * (l + r) * 1.18::DOUBLE + 0.5::DOUBLE * (l - r) * 0.62::DOUBLE)::FLOAT::DOUBLE AS l,
         (0.5::DOUBLE * (l + r) * 1.18::DOUBLE - 0.5::DOUBLE * (l - r) * 0.62::DOUBLE)::FLOAT::DOUBLE AS r FROM bus WHERE idx % 4 = 0
  UNION ALL SELECT production, abs_start + frame, (l * 0.75)::FLOAT, (r * 0.75)::FLOAT FROM bus WHERE idx % 4 = 1
  UNION ALL SELECT production, abs_start + frame, sum(l)::FLOAT, sum(r)::FLOAT FROM echoed GROUP BY production, node_id, abs_start, frame
  UNION ALL SELECT production, abs_start + frame, l, r FROM bus WHERE idx % 4 = 3),
sums AS (SELECT production, frame, sum(l) AS l, sum(r) AS r FROM treated GROUP BY production, frame),
edges AS (
  SELECT production, max_end - min_start AS frames, greatest(0, -min_start) AS trim_start,
         greatest(0, max_end - cursor_end) AS cut, greatest(0, cursor_end - max_end) AS tail FROM mid_sum),
grid AS (
  SELECT *, unnest(range(greatest(0, frames - cut - trim_start) + tail)) AS frame FROM edges),
o AS (
  SELECT g.production, g.frame, coalesce(s.l, 0)::FLOAT AS l, coalesce(s.r, 0)::FLOAT AS r
  FROM grid g LEFT JOIN sums s ON s.production = g.production AND s.frame = g.frame + g.trim_start
       AND g.frame + g.trim_start < g.frames - g.cut)"""

_SLICED = f"""{_STEREO},
moves AS (
  SELECT vec_id AS clip_id, vec_id % 97 AS target, k * 7 + vec_id % 4 AS first, vec_id * 5 + k * 9 + 2 AS place
  FROM embeddings, (VALUES (0), (1), (2)) AS v(k)),
sums AS (
  SELECT target, place + frame - first AS frame, sum(l::DOUBLE) AS l, sum(r::DOUBLE) AS r
  FROM moves JOIN st ON st.clip_id = moves.clip_id AND frame >= first AND frame < first + 13 GROUP BY ALL),
grid AS (SELECT target, unnest(range(max(place) + 15)) AS frame FROM moves GROUP BY target),
o AS (
  SELECT g.target AS clip_id, g.frame, coalesce(s.l, 0)::FLOAT AS l, coalesce(s.r, 0)::FLOAT AS r
  FROM grid g LEFT JOIN sums s ON s.target = g.target AND s.frame = g.frame)"""

_TIMED = f"""{_STEREO},
b AS (
  SELECT vec_id AS id, (vec_id % 25) / 100.0::DOUBLE + 0.006::DOUBLE AS s,
         CASE WHEN vec_id % 13 = 0 THEN (vec_id % 25) / 100.0::DOUBLE + 0.006::DOUBLE - 0.05::DOUBLE
              ELSE (vec_id % 25) / 100.0::DOUBLE + 0.006::DOUBLE + 0.105::DOUBLE END AS t FROM embeddings),
f AS (
  SELECT id, trunc(s * 100)::BIGINT AS a, 32::BIGINT AS z FROM b WHERE id % 5 = 0
  UNION ALL SELECT id, greatest(0, round_even(s * 100, 0)::BIGINT), round_even(t * 100, 0)::BIGINT FROM b WHERE id % 5 <> 0 AND t >= s),
o AS (
  SELECT id * 10 + 1 AS clip_id, frame - a AS frame, l, r FROM f JOIN st ON st.clip_id = id AND frame >= a AND frame < z)"""

_SPLICED = f"""{_STEREO},
mk AS (
  SELECT vec_id AS id, [0::BIGINT, least(vec_id * 7 % 40, 32), greatest(least(vec_id * 7 % 40, 32), 20), 32::BIGINT] AS f FROM embeddings),
parts AS (
  SELECT id AS clip_id, id AS target, k * 2 AS idx, f[k + 1] AS a, greatest(f[k + 1], f[k + 2]) AS z
  FROM mk, (VALUES (0), (1), (2)) AS v(k)
  UNION ALL SELECT vec_id, vec_id - 1, k, 4, 14 FROM embeddings, (VALUES (1), (3)) AS v(k) WHERE vec_id > 0),
placed AS (
  SELECT *, coalesce(sum(z - a) OVER (PARTITION BY target ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
            AS place FROM parts),
o AS (
  SELECT target AS clip_id, place + frame - a AS frame, l, r
  FROM placed JOIN st ON st.clip_id = placed.clip_id AND frame >= a AND frame < z)"""

_LINED = f"""{_STEREO},
placed AS (
  SELECT vec_id, label::BIGINT AS label, 32 * (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) AS place FROM embeddings),
o AS (SELECT label AS clip_id, place + frame AS frame, l, r FROM placed JOIN st ON st.clip_id = vec_id)"""

_FILED = f"""{_STEREO},
o AS (
  SELECT clip_id, frame, CASE WHEN clip_id % 2 = 1 THEN l ELSE (round_even(least(greatest(l::DOUBLE, -1), 1) * 32767, 0) / 32767)::FLOAT END AS l,
         CASE WHEN clip_id % 2 = 1 THEN r ELSE (round_even(least(greatest(r::DOUBLE, -1), 1) * 32767, 0) / 32767)::FLOAT END AS r FROM st)"""

ORACLE = {
    "wav_files": f"WITH {_FILED} {_sql_shown()}",
    "block_slice_times": f"WITH {_TIMED} {_sql_shown()}",
    "block_splice": f"WITH {_SPLICED} {_sql_shown()}",
    "block_line_clips": f"WITH {_LINED} {_sql_shown()}",
    "plan_audio": f"WITH {_TREE_AUDIO} SELECT production, frame, {_round('l')} AS l, {_round('r')} AS r FROM o",
    "block_slices": f"WITH {_SLICED} {_sql_shown()}",
    "channels_down": f"""WITH {_STEREO}
SELECT clip_id, frame, 0 AS ch, {_round('((l::DOUBLE + r::DOUBLE) / 2)::FLOAT')} AS value FROM st""",
    "channels_up": f"""WITH {_STEREO}
SELECT clip_id, frame, ch::INTEGER AS ch, {_round('((l::DOUBLE + r::DOUBLE) / 2)::FLOAT')} AS value FROM st, (VALUES (0), (1), (2)) AS v(ch)""",
    "mid_side": f"WITH {_MIDSIDE} {_sql_shown()}",
    "block_mid_side": f"WITH {_MIDSIDE} {_sql_shown()}",
    "db_gain": f"""WITH {_STEREO},
o AS (
  SELECT clip_id, frame, (l::DOUBLE * pow(10.0::DOUBLE, -4.5::DOUBLE / 20))::FLOAT AS l,
         (r::DOUBLE * pow(10.0::DOUBLE, -4.5::DOUBLE / 20))::FLOAT AS r FROM st) {_sql_shown()}""",
    "early_reflections": _REFLECTED,
    "block_reflections": _REFLECTED,
    "feedback_repeats": _sql_taps(FR.repeat_taps(RATE, 6.0, 1.0, 0.6, 5, 0.1), 0.94),
    "clip_rms": f"""WITH {_STEREO}
SELECT clip_id, {_round('sqrt(sum(l::DOUBLE ** 2 + r::DOUBLE ** 2) / 64)')} AS rms FROM st GROUP BY clip_id""",
    "diff_rms": f"""WITH {_MIDSIDE}
SELECT o.clip_id, {_round('sqrt(sum((o.l::DOUBLE - st.l) ** 2 + (o.r::DOUBLE - st.r) ** 2) / 64)')} AS rms
FROM o JOIN st ON st.clip_id = o.clip_id AND st.frame = o.frame GROUP BY o.clip_id""",
    "loudness_gain": f"WITH {_LOUD} SELECT clip_id, {_round('loudness')} AS loudness, {_round('gain')} AS gain FROM gn",
    "loudness_applied": f"""WITH {_LOUD},
o AS (SELECT clip_id, frame, (l::DOUBLE * gain)::FLOAT AS l, (r::DOUBLE * gain)::FLOAT AS r FROM st JOIN gn USING (clip_id)) {_sql_shown()}""",
    "compressor": f"""WITH RECURSIVE {_STEREO},
pk AS MATERIALIZED (
  SELECT *, greatest(abs(l::DOUBLE), abs(r::DOUBLE)) AS p, exp(-1.0::DOUBLE / {RATE * _COMP['attack_ms'] / 1000}) AS a,
         exp(-1.0::DOUBLE / {RATE * _COMP['release_ms'] / 1000}) AS q FROM st),
walk AS (
  SELECT DISTINCT clip_id, -1::BIGINT AS frame, 0.0::DOUBLE AS level FROM pk
  UNION ALL
  SELECT pk.clip_id, pk.frame, CASE WHEN p > level THEN a * level + (1 - a) * p ELSE q * level + (1 - q) * p END
  FROM walk JOIN pk ON pk.clip_id = walk.clip_id AND pk.frame = walk.frame + 1),
db AS (SELECT clip_id, frame, 20 * log10(greatest(level, 1e-6)) AS e FROM walk WHERE frame >= 0),
gn AS (
  SELECT clip_id, frame, pow(10.0::DOUBLE, (CASE WHEN e > {_COMP['threshold_db']}
      THEN ({_COMP['threshold_db']}::DOUBLE + (e - ({_COMP['threshold_db']}::DOUBLE)) / {_COMP['ratio']}::DOUBLE) - e ELSE 0 END
      + {_COMP['makeup_db']}::DOUBLE) / 20) AS g FROM db),
o AS (SELECT st.clip_id, st.frame, (l::DOUBLE * g)::FLOAT AS l, (r::DOUBLE * g)::FLOAT AS r
      FROM st JOIN gn ON gn.clip_id = st.clip_id AND gn.frame = st.frame) {_sql_shown()}""",
    "highpass": f"WITH RECURSIVE {_CH}, {_sql_filter('hi', 'src', 'highpass', 85.0, RATE)}, {_sql_pivot('hi')}",
    "tilt": f"""WITH RECURSIVE {_CH}, {_sql_filter('lo', 'src', 'lowpass', 220.0, 16_000)},
{_sql_filter('hi', 'src', 'highpass', 3200.0, 16_000)},
t AS (
  SELECT src.clip_id, src.ch, src.frame, (lo.y::DOUBLE * pow(10.0::DOUBLE, -1.4::DOUBLE / 20) + (x - lo.y::DOUBLE - hi.y::DOUBLE)
         + hi.y::DOUBLE * pow(10.0::DOUBLE, 1.6::DOUBLE / 20))::FLOAT AS y
  FROM src JOIN lo ON lo.clip_id = src.clip_id AND lo.ch = src.ch AND lo.frame = src.frame
  JOIN hi ON hi.clip_id = src.clip_id AND hi.ch = src.ch AND hi.frame = src.frame), {_sql_pivot('t')}""",
    "resample_up": f"WITH {_MONO}, {_sql_resample('mono', 24_000, 48_000, 64)} {_SHOW_VALUE} FROM rs",
    "resample_asr": f"""WITH {_STEREO},
mono AS (SELECT clip_id, frame, 0 AS ch, ((l::DOUBLE + r::DOUBLE) / 2)::FLOAT AS value FROM st),
{_sql_resample('mono', 24_000, 16_000, 32)} {_SHOW_VALUE} FROM rs""",
    "resample_blocks": f"""WITH {_STEREO},
both_ch AS (SELECT clip_id, frame, 0 AS ch, l AS value FROM st UNION ALL SELECT clip_id, frame, 1, r FROM st),
{_sql_resample('both_ch', 24_000, 48_000, 32)}, {_sql_pivot('rs', 'value')}""",
    "convert_format": f"""WITH {_MONO}, {_sql_resample('mono', 24_000, 48_000, 64)},
two AS (SELECT clip_id, frame, v.c AS ch, value FROM rs, (VALUES (0), (1)) AS v(c)) {_SHOW_VALUE} FROM two""",
    "mix_blocks": f"""WITH {_MIX},
f AS (SELECT label, b * 50 + i AS frame FROM (SELECT DISTINCT label, frame // 50 AS b FROM m), (SELECT unnest(range(50)) AS i))
SELECT f.label, f.frame, {_round('coalesce(v, 0)')} AS value FROM f LEFT JOIN m ON m.label = f.label AND m.frame = f.frame""",
    "custom_stage": f"""WITH {_STEREO},
o AS (
  SELECT clip_id, frame, (l * 0.5::DOUBLE + coalesce(lag(l, 3) OVER w, 0) * 0.25::DOUBLE)::FLOAT AS l,
         (r * 0.5::DOUBLE + coalesce(lag(r, 3) OVER w, 0) * 0.25::DOUBLE)::FLOAT AS r
  FROM st WINDOW w AS (PARTITION BY clip_id ORDER BY frame)) {_sql_shown()}""",
    "stateful_stage": f"""WITH {_STEREO},
p AS (
  SELECT *, max(greatest(abs(l::DOUBLE), abs(r::DOUBLE))) OVER (PARTITION BY clip_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS m
  FROM st),
o AS (
  SELECT clip_id, frame, (CASE WHEN m > 0 THEN l::DOUBLE / m ELSE 0 END)::FLOAT AS l,
         (CASE WHEN m > 0 THEN r::DOUBLE / m ELSE 0 END)::FLOAT AS r FROM p) {_sql_shown()}""",
    "noise_bed": _NOISY,
    "block_noise": _NOISY,
    "silent_blocks": """
WITH s AS (
  SELECT label::BIGINT AS label, vec_id * 130 + generate_subscripts(embedding, 1) - 1 AS f, unnest(embedding)::DOUBLE AS v FROM embeddings),
b AS (SELECT label, unnest(range(0, max(f) // 50 + 1)) AS block_no FROM s GROUP BY label),
t AS (SELECT label, f // 50 AS block_no, round(sum(v), 4) AS total FROM s GROUP BY ALL)
SELECT b.label, b.block_no, CASE WHEN coalesce(total, 0) = 0 THEN 0.0 ELSE total END::DOUBLE AS total, 50::BIGINT AS n
FROM b LEFT JOIN t ON t.label = b.label AND t.block_no = b.block_no""",
    "preset_route": """
SELECT vec_id AS clip_id,
       CASE vec_id % 8 WHEN 0 THEN 'narrator' WHEN 1 THEN 'thoughts' WHEN 6 THEN 'indoor1' WHEN 7 THEN 'master' END AS routed,
       CASE WHEN vec_id % 8 = 5 THEN 'Unknown preset ''the moon''. Available presets: '
            || 'indoor1, indoor2, master, narrator, outdoor1, outdoor2, thoughts' END AS message
FROM embeddings""",
    "wav_pcm": """
WITH e AS (SELECT vec_id AS idx, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
s AS (SELECT idx, i, round_even(greatest(least(x, 1.0), -1.0) * 32767.0::DOUBLE, 0)::BIGINT AS v FROM e),
u AS (SELECT idx, i, CASE WHEN v < 0 THEN v + 65536 ELSE v END AS v FROM s),
b AS (
  SELECT idx, string_agg(lpad(to_hex(v % 256), 2, '0') || lpad(to_hex(v // 256), 2, '0'), '' ORDER BY i) AS bytes FROM u GROUP BY idx)
SELECT idx, 172::BIGINT AS n_bytes,
       '52494646a400000057415645666d7420100000000100' || '0100' || 'c05d0000' || '80bb0000' || '0200' || '1000' || '64617461' || '80000000' AS header,
       sha256(unhex(bytes)) AS payload_sha256 FROM b""",
    "wav_float": """
SELECT vec_id AS idx, 300::BIGINT AS n_bytes,
       '524946462401000057415645666d7420100000000300' || '0100' || 'c05d0000' || '00770100' || '0400' || '2000' || '64617461' || '00010000' AS header
FROM embeddings""",
}
ORACLE["block_loudness"] = ORACLE["loudness_applied"]
ORACLE["block_asr_view"] = ORACLE["resample_asr"]
