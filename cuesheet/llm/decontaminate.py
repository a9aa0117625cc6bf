"""Benchmark passages in documents, as a prefix-filtered set join; built-in functions only.

Every benchmark item is cut into windows of ten consecutive words (a shorter item is one window). A window is the set
of its shingles of three words (a window of fewer words is its own shingle). Shingles are ordered by rarity, counted
over all documents. As a window must be contained as a whole, its prefix under that order is one shingle, its rarest;
only documents that hold that shingle can hold the window. Where a document holds it, the shingle's place gives the one
place where the window could start: it must lie inside the document (positional and length bound), and there the
window's words are compared one by one.

The documents are read twice, once for the counts and once for the join; both times their shingles meet a table of
benchmark shingles inside the scan's own stage, so that only counts and candidates are shuffled. That table is
broadcast if it has at most ``MOST_BROADCAST`` rows; beyond that it is joined by shuffling the documents' codes and
places, and only documents with a candidate get their words, once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuesheet.session import stored

WINDOW = 10
SHINGLE = 3
MOST_BROADCAST = 1_000_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.transform(F.array(value), use)[0]


def shingle_codes(found: Column, width: int) -> Column:
    """The 64-bit codes of all shingles of one width, in order; ``found`` is an array of words."""

    def of(codes: Column) -> Column:
        last = F.size(codes) - width
        places = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda at: at <= last)
        return F.transform(places, lambda at: F.xxhash64(F.lit(width), *[F.get(codes, at + k) for k in range(width)]))

    return _let(F.transform(found, lambda w: F.xxhash64(w)), of)


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct (item_id, window, n): the words of each window of each item, joined by spaces, and their number."""
    found = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    found = found.select("item_id", "w", F.explode(starts).alias("start"))
    window = F.slice("w", F.col("start"), F.lit(size))
    return found.select("item_id", F.array_join(window, " ").alias("window"), F.size(window).alias("n")).distinct()


def _is_small(table: DataFrame) -> bool:
    """Whether the stored table may be broadcast; its rows are counted, not estimated."""
    return table.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST


def _sized(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if _is_small(table) else table


def prefixes(texts: DataFrame, distinct: DataFrame) -> tuple[DataFrame, list[int]]:
    """(code, offset, window, n), per window the one shingle to look for and its place in it; and the widths in use.

    ``texts(w)`` are the documents' words, ``distinct(window, n)`` the windows.
    """
    sizes = distinct.select(F.least("n", F.lit(SHINGLE)).alias("width")).distinct()
    widths = sorted(r["width"] for r in sizes.collect())  # at most SHINGLE values
    empty = distinct.limit(0).select(F.lit(0).cast("bigint").alias("code"), F.lit(0).alias("offset"), "window", "n")
    if not widths:
        return empty, widths
    entries = None
    for width in widths:
        codes = shingle_codes(F.split("window", " "), width)
        part = distinct.where(F.least("n", F.lit(SHINGLE)) == width).select(
            "window", "n", F.posexplode(codes).alias("offset", "code")
        )
        entries = part if entries is None else entries.unionByName(part)
    entries = stored(entries, "benchmark-shingles")
    codes = stored(entries.select("code").distinct(), "benchmark-codes")
    seen = texts.select(F.explode(F.concat(*[shingle_codes(F.col("w"), k) for k in widths])).alias("code"))
    counted = seen.join(_sized(codes), "code").groupBy("code").agg(F.count("*").alias("found"))
    # A shingle that no document has rules its window out.
    ranked = entries.join(counted, "code", "left")
    order = F.struct(F.coalesce("found", F.lit(0)).alias("found"), "code", "offset")
    chosen = ranked.groupBy("window", "n").agg(F.min(order).alias("best")).where("best.found > 0")
    return stored(chosen.select("best.code", "best.offset", "window", "n"), "benchmark-prefixes"), widths


def occurrences(documents: DataFrame, distinct: DataFrame) -> DataFrame:
    """Per row of ``documents(doc_id, text)`` and occurrence of a window: (row, doc_id, n_words, start, n, window).

    Each row of documents also comes once with null start, n and window.
    """
    texts = documents.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w")
    )
    lookup, widths = prefixes(texts, distinct)
    small = _is_small(lookup)
    if not small:
        # Read more than once under its row numbers.
        texts = stored(texts, "benchmark-texts")
    # Every document also has one marker entry, which the lookup table holds as well: one pass gives both kinds of rows.
    marker = F.array(F.lit(0).cast("bigint"))
    entries = F.concat(marker, *[shingle_codes(F.col("w"), k) for k in widths])
    each = texts.select("row", "doc_id", "w", F.posexplode(entries).alias("at", "code"))
    each = each.withColumn("marked", F.col("at") == 0).withColumn("at", F.col("at") - 1)
    # Entries of a width follow those of the one before.
    before, place = F.lit(0), None
    for width in widths:
        count = F.greatest(F.size("w") - width + 1, F.lit(0))
        inside = F.col("at") < before + count
        place = F.when(inside, F.col("at") - before) if place is None else place.when(inside, F.col("at") - before)
        before = before + count
    if place is not None:
        each = each.withColumn("at", F.when(F.col("marked"), F.col("at")).otherwise(place))
    marks = documents.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("code"),
        F.lit(None).cast("int").alias("offset"),
        F.lit(None).cast("string").alias("window"),
        F.lit(None).cast("int").alias("n"),
    )
    lookup = stored(lookup.select("code", "offset", "window", "n").unionByName(marks), "benchmark-lookup")
    start = F.col("at") - F.col("offset")
    inside = (start >= 0) & (start + F.col("n") <= F.size("w"))
    same = F.array_join(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("n")), " ") == F.col("window")
    hit = ~F.col("marked") & F.col("window").isNotNull() & inside & same
    if not small:
        return _shuffled(texts, each, lookup, hit)
    found = each.join(F.broadcast(lookup), "code").where((F.col("marked") & F.col("window").isNull()) | hit)
    return found.select(
        "row",
        "doc_id",
        F.size("w").cast("bigint").alias("n_words"),
        F.when(~F.col("marked"), start).alias("start"),
        "n",
        "window",
    )


def _shuffled(texts: DataFrame, each: DataFrame, lookup: DataFrame, hit: Column) -> DataFrame:
    """``occurrences`` for a lookup table of any size: no words beside the codes, and words once for each document."""
    rows = texts.select("row", "doc_id", F.size("w").cast("bigint").alias("n_words"))
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("start", "int"), ("n", "int"), ("window", "string"))]
    windows_of = lookup.where("window IS NOT NULL")
    near = each.where("NOT marked").select("row", "code", "at").join(windows_of, "code")
    near = near.where("at >= offset").withColumn("marked", F.lit(False))
    found = texts.join(near, "row").where(hit)
    start = (F.col("at") - F.col("offset")).alias("start")
    return rows.select("*", *nothing).unionByName(
        found.select("row", "doc_id", F.size("w").cast("bigint").alias("n_words"), start, "n", "window")
    )


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row of ``documents(doc_id, text)``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts words inside any occurrence of a window of ``benchmark(item_id, text)``; items_sha256 is the digest of
    the comma-joined item ids, sorted as strings, whose windows occur (of the empty string if none). Null texts have no
    words; items without words are left out, and a null item_id counts for words but is no item. Rows that repeat give
    repeated results. An empty benchmark contaminates nothing.
    """
    items = stored(windows(benchmark, size), "benchmark-windows")
    found = stored(occurrences(documents, items.select("window", "n").distinct()), "benchmark-found")
    hits = found.where("window IS NOT NULL")
    spans = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n_hit"))

    def add(so_far: Column, span: Column) -> Column:
        end = span["start"] + span["n"]
        return F.struct(
            F.greatest(so_far["end"], end).alias("end"),
            (so_far["n_hit"] + F.greatest(F.lit(0), end - F.greatest(so_far["end"], span["start"]))).alias("n_hit"),
        )

    covered = spans.select("row", F.aggregate("spans", start, add)["n_hit"].alias("n_hit"))
    held = hits.select("row", "window").distinct().join(items.select("window", "item_id"), "window")
    named = held.groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    rows = found.where("window IS NULL").select("row", "doc_id", "n_words")
    rows = rows.join(covered, "row", "left").join(named, "row", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.size(items_of).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
