"""Aligning a script with timed words.

The unit is one script: its lines, clauses and words are arrays in one row, as one script element and
one recogniser response are one cell each. Every operator here is an expression over these arrays, so
aligning a corpus is a projection: no shuffle, no group, and nothing that one hot key could overload.

Spans are arrays of ``struct<start: double, end: double>``; a missing time is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cuesheet.functions import text as T
from cuesheet.operators.scans import is_bounded
from cuesheet.session import stored

SPAN = "struct<start: double, end: double>"
SHINGLE = 8
BROADCAST_KEYS = 200_000


def _number(value: float) -> Column:
    return F.lit(float(value))


def let(body, **values: Column) -> Column:
    """Evaluate the named values once per row and hand them to ``body``.

    A column used inside a lambda may be inlined by the optimizer and then run once per element; as
    the argument of a one-element transform it is run once per row.
    """
    bound = F.array(F.struct(*[value.alias(name) for name, value in values.items()]))
    return F.get(F.transform(bound, lambda v: body(*[v[name] for name in values])), 0)


def unfold(rows: DataFrame, keep: list, array: Column, pos: str, item: str) -> DataFrame:
    """Array elements as rows.

    The plain explode makes the optimizer filter on the array's size below all projections, which
    repeats whatever computes the array; the outer one does not, and its null rows go afterwards.
    """
    exploded = rows.select(*keep, F.posexplode_outer(array).alias(pos, item)).where(F.col(pos).isNotNull())
    return exploded.withColumn(pos, F.col(pos).cast("bigint"))


def cumulative(counts: Column) -> Column:
    """Running totals with a leading zero: one more entry than the input."""
    return F.aggregate(
        counts,
        F.array(F.lit(0)),
        lambda acc, n: F.concat(acc, F.array(F.try_element_at(acc, F.lit(-1)) + n)),
    )


def line_tokens(lines: Column) -> Column:
    return F.transform(lines, T.tokens)


def fallback_clauses(lines: Column, seconds: Column) -> Column:
    """Share a duration over the lines by token count; a line without tokens counts as one."""
    counts = F.transform(lines, lambda l: F.greatest(F.size(T.raw_tokens(l)), F.lit(1)))

    def shared(texts: Column, ends: Column, duration: Column) -> Column:
        total = F.greatest(F.try_element_at(ends, F.lit(-1)), F.lit(1)).cast("double")
        return F.transform(
            texts,
            lambda line, i: F.struct(
                line.alias("text"),
                (duration * F.get(ends, i) / total).alias("start"),
                (duration * F.get(ends, i + 1) / total).alias("end"),
            ),
        )

    return let(shared, texts=lines, ends=cumulative(counts), duration=seconds)


def fallback_words(clauses: Column) -> Column:
    """Spread the tokens of each clause evenly over it."""

    def spread(clause: Column) -> Column:
        def evenly(found: Column) -> Column:
            shown = F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)
            step = (clause["end"] - clause["start"]) / F.greatest(F.size(found), F.lit(1))
            return F.transform(
                shown,
                lambda token, i: F.struct(
                    token.alias("text"),
                    (clause["start"] + i * step).alias("start"),
                    (clause["start"] + (i + 1) * step).alias("end"),
                ),
            )

        return let(evenly, found=T.tokens(clause["text"]))

    return F.flatten(F.transform(clauses, spread))


def fallback_word_rows(scripts: DataFrame, keep: list, lines: Column, seconds: Column) -> DataFrame:
    """``fallback_words`` of ``fallback_clauses`` as rows: ``keep, pos, text, start, end``.

    Lines are searched for tokens once, and words get their times as rows, not inside an array of the whole script.
    """

    def shared(found: Column, ends: Column, duration: Column) -> Column:
        total = F.greatest(F.try_element_at(ends, F.lit(-1)), F.lit(1)).cast("double")
        return F.transform(
            found,
            lambda line, i: F.struct(
                F.when(F.size(line) == 0, F.array(F.lit(""))).otherwise(line).alias("shown"),
                F.get(ends, i).alias("before"),
                (duration * F.get(ends, i) / total).alias("start"),
                (duration * F.get(ends, i + 1) / total).alias("end"),
            ),
        )

    counts = lambda found: F.transform(found, lambda line: F.greatest(F.size(line), F.lit(1)))
    clauses = let(
        lambda found, duration: let(shared, found=found, ends=cumulative(counts(found)), duration=duration),
        found=F.transform(lines, T.raw_tokens),
        duration=seconds,
    )
    rows = unfold(scripts, keep, clauses, "_line", "_c").select(*keep, "_c.*")
    step = (F.col("end") - F.col("start")) / F.size("shown")
    words = unfold(rows.withColumn("_step", step), [*keep, "before", "start", "_step"], F.col("shown"), "_k", "text")
    return words.select(
        *keep,
        (F.col("before") + F.col("_k")).alias("pos"),
        # Tokens are ASCII, so this is exact.
        F.lower("text").alias("text"),
        (F.col("start") + F.col("_k") * F.col("_step")).alias("start"),
        (F.col("start") + (F.col("_k") + 1) * F.col("_step")).alias("end"),
    )


def word_tokens(words: Column) -> Column:
    """Tokens of the words; each inherits its word's times."""
    return F.flatten(
        F.transform(
            words,
            lambda w: F.transform(
                T.tokens(w["text"]),
                lambda t: F.struct(t.alias("token"), w["start"].alias("start"), w["end"].alias("end")),
            ),
        )
    )


def clause_ranges(clauses: Column) -> Column:
    """Clauses with their tokens and their token range ``lo..hi`` in the whole text."""
    listed = F.transform(
        clauses,
        lambda c: F.struct(T.tokens(c["text"]).alias("tokens"), c["start"].alias("start"), c["end"].alias("end")),
    )

    def ranged(items: Column) -> Column:
        ends = cumulative(F.transform(items, lambda c: F.size(c["tokens"])))
        return let(
            lambda rows, at: F.transform(
                rows,
                lambda c, i: F.struct(
                    c["tokens"].alias("tokens"),
                    c["start"].alias("start"),
                    c["end"].alias("end"),
                    F.get(at, i).alias("lo"),
                    F.get(at, i + 1).alias("hi"),
                ),
            ),
            rows=items,
            at=ends,
        )

    return let(ranged, items=listed)


def with_offsets(scripts: DataFrame, clauses: str = "clauses") -> DataFrame:
    """Add token arrays and offsets of lines and clauses for the operators below.

    Input: ``lines`` array<string> and ``clauses`` array<struct<text, start, end>>.
    """
    return (
        scripts.withColumn("line_tokens", line_tokens(F.col("lines")))
        .withColumn("line_ends", cumulative(F.transform("line_tokens", F.size)))
        .withColumn("clause_ranges", clause_ranges(F.col(clauses)))
    )


def is_exact(line_ends: Column, ranges: Column) -> Column:
    """Every line ends where some clause ends, counted in tokens, and both texts are equally long."""
    return is_exact_at(line_ends, F.concat(F.array(F.lit(0)), F.transform(ranges, lambda c: c["hi"])))


def is_exact_at(line_ends: Column, clause_ends: Column) -> Column:
    """``is_exact`` from running token counts of both, each with its leading zero."""

    def same(lines: Column, clauses: Column) -> Column:
        same_total = F.try_element_at(lines, F.lit(-1)) == F.try_element_at(clauses, F.lit(-1))
        return (F.size(lines) == 1) | (same_total & (F.size(F.array_except(lines, clauses)) == 0))

    return let(same, lines=line_ends, clauses=clause_ends)


def exact_spans(tokens_: Column, line_ends: Column, ranges: Column) -> Column:
    """Per line of an exact script: first known start and last known end of the clauses inside it.

    Where lines end, clauses end, so a line's clauses lie between two places in the list of clause ends.
    """

    def spans(lines: Column, ends: Column, clauses: Column, clause_ends: Column) -> Column:
        def span(_: Column, i: Column) -> Column:
            before, last = _place(clause_ends, F.get(ends, i)), _place(clause_ends, F.get(ends, i + 1))
            inside = F.slice(clauses, before + 1, F.greatest(last - before, F.lit(0)))
            return let(
                lambda rows: F.struct(
                    F.try_element_at(F.filter(rows, lambda c: c["start"].isNotNull()), F.lit(1))["start"].alias("start"),
                    F.try_element_at(F.filter(rows, lambda c: c["end"].isNotNull()), F.lit(-1))["end"].alias("end"),
                ),
                rows=inside,
            )

        return F.transform(lines, span)

    return let(
        lambda lines, ends, clauses: let(
            spans, lines=lines, ends=ends, clauses=clauses, clause_ends=F.transform(clauses, lambda c: c["hi"])
        ),
        lines=tokens_,
        ends=line_ends,
        clauses=F.filter(ranges, lambda c: c["hi"] > c["lo"]),
    )


def _place(offsets: Column, value: Column) -> Column:
    """Where a number first stands in an array, from 1; 0 if nowhere. A plain loop over numbers, without a lambda."""
    return F.array_position(offsets, value).cast("int")


def greedy_hits(tokens_: Column, joined: Column) -> Column:
    """Find each line's token run in the word tokens, in order.

    ``joined`` is the word tokens between single spaces. Tokens hold no spaces, so a run of tokens is
    a substring between spaces. One fold over the lines keeps the place after the last hit; a line
    that is not found leaves it. Returns per line ``struct<first, last>`` token positions or nulls.
    """
    start = F.struct(
        F.lit(1).alias("cursor"),
        F.lit(0).alias("token"),
        F.expr("cast(array() as array<struct<first: int, last: int>>)").alias("hits"),
    )
    miss = F.struct(F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def search(lines: Column, text: Column) -> Column:
        def step(state: Column, line: Column) -> Column:
            def move(size: Column, width: Column, at: Column) -> Column:
                skipped = F.substring(text, state["cursor"], at - state["cursor"])
                passed = F.length(skipped) - F.length(F.replace(skipped, F.lit(" "), F.lit("")))
                hit = let(
                    lambda first: F.struct(
                        (at + width - 1).alias("cursor"),
                        (first + size).alias("token"),
                        F.concat(
                            state["hits"], F.array(F.struct(first.alias("first"), (first + size - 1).alias("last")))
                        ).alias("hits"),
                    ),
                    first=state["token"] + passed,
                )
                missed = F.struct(
                    state["cursor"].alias("cursor"),
                    state["token"].alias("token"),
                    F.concat(state["hits"], F.array(miss)).alias("hits"),
                )
                return F.when((size > 0) & (at > 0), hit).otherwise(missed)

            pattern = F.concat(F.lit(" "), F.array_join(line, " "), F.lit(" "))
            return let(
                lambda pattern_, size: let(
                    move,
                    size=size,
                    width=F.length(pattern_),
                    at=F.call_function("locate", pattern_, text, state["cursor"]),
                ),
                pattern_=pattern,
                size=F.size(line),
            )

        return F.aggregate(lines, start, step, lambda state: state["hits"])

    return let(search, lines=tokens_, text=joined)


def matched_spans(tokens_: Column, line_ends: Column, hits: Column, words: Column, ranges: Column) -> Column:
    """Word times of each hit; a clause that begins or ends the line at its offset wins."""

    def spans(
        lines: Column, ends: Column, found: Column, timed: Column,
        opens: Column, los: Column, closes_: Column, his: Column,
    ) -> Column:
        def span(line: Column, i: Column) -> Column:
            lo, hi = F.get(ends, i), F.get(ends, i + 1)
            # Only one clause with tokens begins at a place.
            opening = F.get(opens, _place(los, lo) - 1)
            # The last that ends there: one without tokens hides the one before it, and then never matches.
            closing = F.get(closes_, _place(his, hi) - 1)

            def chosen(open_: Column, close: Column, hit: Column) -> Column:
                n_open, n_close = F.size(open_["tokens"]), F.size(close["tokens"])
                begins = (n_open <= F.size(line)) & (F.slice(line, 1, n_open) == open_["tokens"])
                tail = F.slice(line, F.greatest(F.size(line) - n_close + 1, F.lit(1)), n_close)
                closes = (n_close > 0) & (n_close <= F.size(line)) & (tail == close["tokens"])
                return F.struct(
                    F.coalesce(F.when(begins, open_["start"]), F.get(timed, hit["first"])["start"]).alias("start"),
                    F.coalesce(F.when(closes, close["end"]), F.get(timed, hit["last"])["end"]).alias("end"),
                )

            return let(chosen, open_=opening, close=closing, hit=F.get(found, i))

        return F.transform(lines, span)

    def listed(lines: Column, ends: Column, found: Column, timed: Column, opens: Column, closes_: Column) -> Column:
        return let(
            spans, lines=lines, ends=ends, found=found, timed=timed,
            opens=opens, los=F.transform(opens, lambda c: c["lo"]),
            closes_=closes_, his=F.transform(closes_, lambda c: c["hi"]),
        )

    return let(
        listed, lines=tokens_, ends=line_ends, found=hits, timed=words,
        opens=F.filter(ranges, lambda c: c["hi"] > c["lo"]), closes_=F.reverse(ranges),
    )


def line_spans(scripts: DataFrame) -> DataFrame:
    """Raw span of every line: from exact clauses, else from word runs and clause edges.

    Input: ``lines``, ``clauses``, ``words``. Adds ``exact`` and ``spans``.
    """
    counted = scripts.withColumn("line_ends", _line_ends()).withColumn("clause_ends", _clause_ends(F.col("clauses")))
    exact = is_exact_at(F.col("line_ends"), F.col("clause_ends"))
    return _spans(counted.withColumn("exact", exact)).drop("line_ends", "clause_ends")


def aligned_spans(scripts: DataFrame, fine: Column, words: Column) -> DataFrame:
    """``line_spans`` of what ``decide`` chose, with the token counts it decided by.

    ``fine`` and ``words`` are expressions over the scripts, and made just for the scripts that need them.
    """
    decided = _decided(scripts, fine, words)
    exact = F.col("decision").isin("transcription_exact_clause_match", "aligned_exact_clause_match")
    # Without a recogniser nothing is known of the clauses yet.
    ends = F.when(F.col("decision") == "fallback", _clause_ends(F.col("clauses"))).otherwise(F.col("clause_ends"))
    lost = (F.col("decision") == "fallback") & is_exact_at(F.col("line_ends"), ends)
    return _spans(decided.withColumn("clause_ends", ends).withColumn("exact", exact | lost)).drop("line_ends", "clause_ends")


def _spans(scripts: DataFrame) -> DataFrame:
    """Adds ``spans``. Exact scripts need only token counts; tokens are looked for in the others."""
    exact = F.col("exact")
    joined = F.concat(F.lit(" "), F.array_join(F.transform("tokens", lambda t: t["token"]), " "), F.lit(" "))
    args = [F.col("line_tokens"), F.col("line_ends")]
    ranges = F.transform(
        "clauses",
        lambda c, i: F.struct(
            c["start"].alias("start"),
            c["end"].alias("end"),
            F.get("clause_ends", i).alias("lo"),
            F.get("clause_ends", i + 1).alias("hi"),
        ),
    )
    return (
        scripts.withColumn("line_tokens", F.when(~exact, line_tokens(F.col("lines"))))
        .withColumn("clause_ranges", F.when(~exact, clause_ranges(F.col("clauses"))))
        .withColumn("tokens", F.when(~exact, word_tokens(F.col("words"))))
        .withColumn("hits", F.when(~exact, greedy_hits(F.col("line_tokens"), joined)))
        .withColumn(
            "spans",
            F.when(exact, exact_spans(F.col("lines"), F.col("line_ends"), ranges))
            .otherwise(matched_spans(*args, F.col("hits"), F.col("tokens"), F.col("clause_ranges")))
            .cast(f"array<{SPAN}>"),
        )
        .drop("line_tokens", "clause_ranges", "tokens", "hits")
    )


def fill_gaps(spans: Column) -> Column:
    """A missing start is the end before it (0 at first), a missing end is the line's own start."""
    start = F.struct(
        _number(0).alias("previous"), F.expr(f"cast(array() as array<{SPAN}>)").alias("spans")
    )

    def step(state: Column, span: Column) -> Column:
        first = F.coalesce(span["start"], state["previous"])
        last = F.coalesce(span["end"], first)
        return F.struct(
            last.alias("previous"),
            F.concat(state["spans"], F.array(F.struct(first.alias("start"), last.alias("end")).cast(SPAN))).alias("spans"),
        )

    return F.aggregate(spans, start, step, lambda state: state["spans"])


def inline_positions(filled: Column, lines_before: Column) -> Column:
    """Time of each inline item, given how many lines stand before it.

    Between two lines it is the middle of their gap, after the last line its end, and before the
    first line 0.
    """

    def positions(counts: Column, spans: Column) -> Column:
        return F.transform(
            counts,
            lambda n: F.when(n <= 0, _number(0))
            .when(n >= F.size(spans), F.get(spans, n - 1)["end"])
            .otherwise((F.get(spans, n - 1)["end"] + F.get(spans, n)["start"]) / 2),
        )

    return let(positions, counts=lines_before, spans=filled)


def marker_frames(positions: Column, frames: Column, rate: int) -> Column:
    """0, the inline positions and the end as frames: clamped, never going back."""

    def markers(at: Column, n: Column) -> Column:
        total = n.cast("double") / rate if rate > 0 else _number(0)
        seconds = F.concat(
            F.array(_number(0)),
            F.transform(at, lambda p: F.least(F.greatest(p, _number(0)), total)),
            F.array(total),
        )
        rising = F.aggregate(
            seconds,
            F.expr("cast(array() as array<double>)"),
            lambda acc, s: F.concat(
                acc, F.array(F.least(F.greatest(s, F.coalesce(F.try_element_at(acc, F.lit(-1)), _number(0))), total))
            ),
        )
        return F.transform(
            rising, lambda s: F.least(n, F.greatest(F.lit(0), F.rint(s * rate).cast("bigint"))).cast("bigint")
        )

    return let(markers, at=positions, n=frames)


def decide(scripts: DataFrame) -> DataFrame:
    """Which stage settles each script, from its coarse segments and, where needed, its fine ones.

    Input: ``lines``, ``coarse`` and ``fine`` clause arrays, ``words`` of the fine stage; ``coarse``
    null means no recogniser. Adds ``decision`` and replaces ``clauses`` and ``words`` by what the
    line spans are taken from.
    """
    return _decided(scripts, F.col("fine"), F.col("words")).drop("line_ends", "clause_ends")


def _decided(scripts: DataFrame, fine: Column, words: Column) -> DataFrame:
    """``decide`` with the running token counts of lines and of the chosen clauses: ``line_ends`` and ``clause_ends``.

    Fine clauses and words stand once, inside conditions, so expressions are not run for scripts that are settled before.
    """
    coarse_ends = F.when(F.col("coarse").isNotNull(), _clause_ends(F.col("coarse")))
    sure, fits = (F.col(name) for name in ("_sure", "_fits"))
    counted = scripts.withColumn("line_ends", _line_ends()).withColumn("_coarse_ends", coarse_ends)
    first = counted.withColumn(
        "_sure", F.col("coarse").isNotNull() & is_exact_at(F.col("line_ends"), F.col("_coarse_ends"))
    ).withColumn("_fine", F.when(F.coalesce(sure, F.lit(False)), F.lit(None)).otherwise(fine))
    second = first.withColumn(
        "_fine_ends", F.when(F.col("coarse").isNotNull() & ~F.coalesce(sure, F.lit(False)), _clause_ends(F.col("_fine")))
    ).withColumn("_fits", F.coalesce(is_exact_at(F.col("line_ends"), F.col("_fine_ends")), F.lit(False)))
    decision = (
        F.when(F.col("coarse").isNull(), "fallback")
        .when(sure, "transcription_exact_clause_match")
        .when(fits, "aligned_exact_clause_match")
        .otherwise("aligned_word_matching")
    )
    none = F.array().cast(scripts.select(words.alias("words")).schema["words"].dataType)
    decided = second.withColumn("decision", decision)
    by_words, by_coarse = F.col("decision") == "aligned_word_matching", F.col("decision") == "transcription_exact_clause_match"
    return (
        decided.withColumn("clauses", F.when(by_coarse, F.col("coarse")).otherwise(F.col("_fine")))
        .withColumn("clause_ends", F.when(by_coarse, F.col("_coarse_ends")).otherwise(F.col("_fine_ends")))
        .withColumn("words", F.when(by_words, words).otherwise(none))
        .drop("_coarse_ends", "_sure", "_fine", "_fine_ends", "_fits")
    )


def _line_ends() -> Column:
    return cumulative(F.transform("lines", lambda line: F.size(T.raw_tokens(line))))


def _clause_ends(clauses: Column) -> Column:
    return cumulative(F.transform(clauses, lambda c: F.size(T.raw_tokens(c["text"]))))


def needs_fine_stage(scripts: DataFrame) -> DataFrame:
    """Scripts whose coarse clauses do not settle them: only these go to the costly fine stage."""
    counted = scripts.withColumn("line_ends", _line_ends())
    sure = is_exact_at(F.col("line_ends"), _clause_ends(F.col("coarse")))
    return counted.where(F.col("coarse").isNotNull() & ~sure).drop("line_ends")


def token_runs(texts: DataFrame, text_id: str, runs: DataFrame, run_id: str, salts: int = 16) -> DataFrame:
    """Every place where a short text's tokens occur as a run inside a long text.

    The first tokens of each run, at most ``SHINGLE``, are an equi-join key against the shingles of
    the long texts; a hit is then compared as a whole. Runs with equal tokens are joined once, and
    the key is salted by the long text's id, as one shingle may be in a third of all texts.
    Input columns: id and ``text`` on both sides. Returns ids and the zero-based token position.
    """
    listed = runs.select(run_id, T.tokens(F.col("text")).alias("run")).where(F.size("run") > 0)
    distinct = listed.select("run").distinct()
    width = F.least(F.size("run"), F.lit(SHINGLE))
    keyed = distinct.select(
        "run", width.alias("_w"), F.xxhash64(F.slice("run", 1, width)).alias("_key")
    )
    # At most SHINGLE different numbers, whatever the data.
    widths = [row["_w"] for row in keyed.select("_w").distinct().collect()]
    needles = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keys = keyed.select("_w", "_key").distinct()

    def shingle_keys(found: Column, sizes: Column) -> Column:
        at = lambda w: F.when(F.size(found) >= w, F.sequence(F.lit(1), F.size(found) - w + 1)).otherwise(
            F.array().cast("array<int>")
        )
        of_width = lambda w: F.transform(
            at(w),
            lambda i: F.struct(w.alias("_w"), (i - 1).alias("pos"), F.xxhash64(F.slice(found, i, w)).alias("_key")),
        )
        return F.flatten(F.transform(sizes, of_width))

    sizes = F.array(*[F.lit(w) for w in widths]).cast("array<int>")
    long = texts.select(text_id, let(shingle_keys, found=T.tokens(F.col("text")), sizes=sizes).alias("_all"))
    # The outer explode keeps the optimizer from computing the shingles again for a size filter.
    shingles = (
        long.select(text_id, F.explode_outer("_all").alias("_s"))
        .select(text_id, "_s._w", "_s.pos", "_s._key")
        .where("_key is not null")
        .withColumn("_salt", F.pmod(F.hash(text_id), F.lit(salts)))
    )
    # Few keys are broadcast first, so that shingles without a partner never travel.
    if is_bounded(keys, BROADCAST_KEYS):
        shingles = shingles.join(F.broadcast(keys), ["_w", "_key"], "left_semi")
    # Stored, so that Spark knows their size when the texts come back by id to be compared in full.
    candidates = stored(shingles.join(needles, ["_w", "_key", "_salt"]).select(text_id, "pos", "run"), "candidates")
    whole = candidates.join(texts.select(text_id, T.tokens(F.col("text")).alias("_tokens")), text_id).where(
        F.slice("_tokens", F.col("pos") + 1, F.size("run")) == F.col("run")
    )
    hits = whole.select(text_id, "run", F.col("pos").cast("bigint").alias("pos"))
    # One run may stand in a third of the texts.
    dealt = hits.withColumn("_salt", F.pmod(F.hash(text_id, "pos"), F.lit(salts)))
    owners = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(owners, ["run", "_salt"]).select(text_id, run_id, "pos")


def needs_alignment(contents: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Contents of scripts with inline audio, and of the others, which stay as they are."""
    with_audio = contents.where(F.col("kind") == "audio").select(*keys).distinct()
    return contents.join(with_audio, list(keys), "left_semi"), contents.join(with_audio, list(keys), "left_anti")
