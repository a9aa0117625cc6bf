"""Near-duplicate documents by SimHash fingerprints that differ in two bits at most.

A fingerprint of 64 bits is cut into two segments: of two fingerprints that differ in at most two bits, one segment
differs in at most one. So each segment is indexed by its 32 variants with one bit left out. Equal variants put
fingerprints into one bucket, in which pairs are verified; a pair is taken in the first bucket only in which it meets.

A bucket's fingerprints agree in 31 bits and may be many where thousands of documents are alike. Buckets of up to
``SMALL`` give their pairs; members of larger ones are linked without pairs: two fingerprints differ in at most two bits
exactly if there is a value from which each of them differs in at most one. Every member names its 65 such values, and
all that name a value are linked to the smallest of them. No link is lost and the rows stay in proportion to the members.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cuesheet.llm.arrow import per_slice
from cuesheet.llm.components import compact, contract
from cuesheet.session import stored

WORDS = 3
SEED = 42
DISTANCE = 2
SMALL = 16  # members of a bucket whose pairs are compared
_PART = 1 << 15  # shingles whose bits are counted at a time

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _bit_counts(hashes: list[int]) -> np.ndarray:
    values = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(values, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None) -> int:
    """Unsigned: bit k is set if it is set in over half the hashes of the text's shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    width = min(WORDS, len(words))
    total, counts = len(words) - width + 1, np.zeros(64, np.int64)
    for start in range(0, total, _PART):
        part = words[start : start + _PART + width - 1]
        shingles = map(b" ".join, zip(*[part[k:] for k in range(width)]))
        counts += _bit_counts(list(map(xxhash.xxh64_intdigest, shingles, repeat(SEED))))
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def _fingerprints(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = np.array([fingerprint(text) for text in batch.column(1).to_pylist()], np.uint64)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "print"])


def _variant(k: str = "k") -> Column:
    """Bucket number of variant k (0 to 63) of ``print``: k, then the segment without the bit."""
    segment = f"(shiftrightunsigned(print, {k} & 32) & 4294967295L)"
    return F.expr(f"shiftleft(cast({k} AS bigint), 32) | ({segment} & ~shiftleft(1L, {k} & 31))")


def _first_variant(a: str, b: str) -> str:
    """The first k whose variants of two fingerprints are equal, if one segment differs in at most one bit."""
    low, high = (f"(shiftrightunsigned({a} ^ {b}, {s}) & 4294967295L)" for s in (0, 32))
    place = "CASE WHEN {0} = 0 THEN 0 ELSE bit_count({0} - 1) END"
    return f"CASE WHEN bit_count({low}) <= 1 THEN {place.format(low)} ELSE 32 + {place.format(high)} END"


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between different values of ``print`` that make the same components as all links do."""
    variants = prints.select("print", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).select(
        "print", _variant().alias("bucket")
    )
    shared = variants.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = compact(variants.join(compact(shared, "simhash-buckets"), "bucket"), "simhash-members")

    small = members.where(F.col("members") <= SMALL)
    one, other = (small.select("bucket", F.col("print").alias(side)) for side in "ab")
    near = f"bit_count(a ^ b) <= {DISTANCE}"
    pairs = one.join(other, "bucket").where(
        f"a < b AND {near} AND shiftright(bucket, 32) = {_first_variant('a', 'b')}"
    )

    large = members.where(F.col("members") > SMALL).select("print").distinct()
    flips = F.expr("explode(transform(sequence(0, 64), k -> CASE WHEN k = 64 THEN print ELSE print ^ shiftleft(1L, k) END))")
    balls = large.select("print", flips.alias("centre"))
    hubs = balls.groupBy("centre").agg(F.min("print").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = balls.join(compact(hubs.select("centre", "b"), "simhash-hubs"), "centre")
    stars = stars.select(F.col("print").alias("a"), "b").where(f"a <> b AND {near}").distinct()
    return pairs.select("a", "b").unionByName(stars)


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per row of ``documents(doc_id, text)``: doc_id, fingerprint (16 hex digits), component_id.

    Null, empty and blank texts have fingerprint zero and are linked as any other. Rows without a doc_id have a
    fingerprint, a null component_id, and link nothing. Rows that repeat a doc_id are one node, so what links to one of
    its texts links to all. Further columns are ignored, whatever their names. An empty table gives no rows.
    Fingerprints, buckets and links are written to the shared folder.
    """
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = stored(texts.mapInArrow(per_slice(_fingerprints), "doc_id long, print long"), "simhash")
    usable = signed.where("doc_id IS NOT NULL")
    classes = compact(usable.groupBy("print").agg(F.min("doc_id").alias("rep")), "simhash-classes")

    several = usable.groupBy("doc_id").agg(F.min("print").alias("a"), F.max("print").alias("last")).where("a <> last")
    same_id = usable.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("print").alias("b"))
    found = contract(links(classes.select("print")).unionByName(same_id.where("a <> b")), "simhash")

    joined = classes.join(found.withColumnRenamed("node", "print"), "print", "left")
    joined = compact(joined.withColumn("component", F.coalesce("component", "print")), "simhash-joined")
    least = compact(joined.groupBy("component").agg(F.min("rep").alias("component_id")), "simhash-least")
    labels = compact(joined.join(least, "component").select("print", "component_id"), "simhash-labels")
    result = signed.join(labels, "print", "left")
    return result.select(
        "doc_id",
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
