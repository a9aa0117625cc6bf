"""Time the headline queries: BENCH_SF_DIR (default sf0.1), BENCH_CPUS, BENCH_QUERIES (optional list)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cuesheet.registry import all_queries  # noqa: E402
from cuesheet.session import local_session  # noqa: E402

HEADLINE = (
    "conversation_cues stanza_turns normalized_script timeline_placement composite_summary nested_timeline mix_overlap "
    "mix_blocks greedy_align line_spans marker_frames token_run_match marks_visible mark_cut nested_cut voice_resolve "
    "sound_resolve request_keys cache_split batch_numbers replay_frames shred_nodes doc_errors early_reflections "
    "block_reflections compressor highpass resample_up loudness_gain preset_chain wav_pcm plan_timeline"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cpus, max(8, int(cpus)) if cpus.isdigit() else 8, "cuesheet-bench")
    queries = all_queries()
    # Start the JVM's and the Python workers' machinery before the clock runs.
    queries["timeline_placement"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    queries["wav_pcm"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        begin = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
