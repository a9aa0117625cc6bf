"""Near-duplicate documents by circulant MinHash.

A document is the set of its distinct five-word shingles. Two permutations of the universe of 2^32 shingle codes give
the whole signature: the first scatters the codes, the second is applied to the scattered codes shifted by k for
coordinate k, and the smallest value is kept. 32 bands of 4 coordinates propose pairs; a pair of similarity 0.75
shares no band with a probability of 5e-6. Links are decided by exact Jaccard similarity on the full sets.

How it stays linear where thousands of documents look alike:

* Documents with equal sets are one class, whose smallest id stands for it in all further steps.
* In each band's bucket every class is compared with the bucket's smallest one only. Links that verify are contracted
  to components.
* Only where a bucket then still holds several components are pairs *between* components compared, so no link is lost.
  Buckets of up to ``SMALL`` classes give their pairs. The classes of larger ones meet where they share one of their rarest
  shingles: linked sets have one in common among the rarest quarter of either. Bounds by length and by the place of the
  shingle leave out pairs that cannot be similar enough, and the largest component at a shingle never meets itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from cuesheet.llm.arrow import batch_rows, per_slice
from cuesheet.llm.components import compact, contract
from cuesheet.session import stored

WORDS = 5
BANDS = 32
ROWS = 4
SIMILARITY = (3, 4)  # linked if 4 * intersection >= 3 * union
SMALL = 8  # buckets of so many classes have their pairs as rows
SET_ROWS = 400  # rows of a batch of sets or pairs of sets
_BLOCK = 1 << 15  # array cells of a signature step, small enough for a core's cache
_KEEP = 400_000  # words whose hash a worker remembers

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MULT = np.random.default_rng(7).integers(1, 1 << 62, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32)[:, None]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEEP:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _permute(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A bijection of 32-bit codes, in place: xor-shifts and odd multipliers."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(first)
    x ^= x >> np.uint32(15)
    x *= np.uint32(second)
    x ^= x >> np.uint32(16)
    return x


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def shingle_set(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit codes of the shingles; fewer words than ``size`` are one shingle, none is the empty set."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    width = min(size, len(found))
    count = len(found) - width + 1
    total = np.full(count, width, np.uint64)
    for k in range(width):
        total += _mix64(codes[k : k + count] + np.uint64(k)) * _MULT[k]
    return np.unique(_mix64(total))


def signature(codes: np.ndarray) -> np.ndarray:
    """The circulant signature of a non-empty set."""
    scattered = _permute((codes ^ (codes >> np.uint64(32))).astype(np.uint32), 0x21F0AAAD, 0xD35A2D97)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    step = max(1, _BLOCK // len(_SHIFTS))
    for start in range(0, len(scattered), step):
        shifted = scattered[None, start : start + step] + _SHIFTS
        np.minimum(least, _permute(shifted, 0x85EBCA6B, 0xC2B2AE35).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    parts = least.astype(np.uint64).reshape(BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * _MULT[ROWS + 1]
    for j in range(ROWS):
        total = _mix64(total + parts[:, j] * _MULT[j])
    return total.view(np.int64)


def _signatures(batch: pa.RecordBatch) -> pa.RecordBatch:
    counts, prints, bands = [], [], []
    for text in batch.column(1).to_pylist():
        codes = shingle_set(text)
        counts.append(len(codes))
        if len(codes):
            prints.append(_print(codes.tobytes()))
            bands.append(band_keys(signature(codes)))
        else:
            prints.append(None)
            bands.append(None)
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            pa.array(counts, pa.int64()),
            pa.array(prints, pa.binary()),
            pa.array(bands, pa.list_(pa.int64())),
        ],
        ["doc_id", "n_shingles", "print", "bands"],
    )


def _print(codes: bytes) -> bytes:
    return hashlib.blake2b(codes, digest_size=16).digest()


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    codes = [shingle_set(text).tobytes() for text in batch.column(1).to_pylist()]
    prints = [_print(c) for c in codes]
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(prints, pa.binary()), pa.array(codes, pa.binary())], ["doc_id", "print", "codes"]
    )


def linked(one: np.ndarray, other: np.ndarray, similarity=SIMILARITY) -> bool:
    """Exact decision on two sorted sets."""
    part, whole = similarity
    small, large = (one, other) if len(one) <= len(other) else (other, one)
    if not len(small) or whole * len(small) < part * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return whole * common >= part * (len(small) + len(large) - common)


def _verify(batch: pa.RecordBatch) -> pa.RecordBatch:
    keep = [
        linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
    ]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    with_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("codes").alias("codes_b")), "b")
    both = with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("codes").alias("codes_a")), "a")
    return both.select("a", "b", "codes_a", "codes_b").mapInArrow(per_slice(_verify), "a long, b long")


def _tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each code of each set."""
    codes = [np.frombuffer(c, np.uint64).view(np.int64) for c in batch.column(3).to_pylist()]
    counts = np.array([len(c) for c in codes], np.int64)
    row = pa.array(np.repeat(np.arange(len(codes)), counts))
    columns = [batch.column(k).take(row) for k in range(3)]
    columns += [pa.array(np.repeat(counts, counts)), pa.array(np.concatenate([np.empty(0, np.int64), *codes]))]
    return pa.RecordBatch.from_arrays(columns, ["rep", "print", "component", "n", "code"])


def _prefixes(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The rarest codes of each set of classes(rep, component), so many that linked sets have one of them in common.

    (rep, component, n, code, at): ``at`` is the place of the code among the n of its set, the rarest first. Codes of one
    set only come first and can have no partner, so they are counted but not returned.
    """
    part, whole = SIMILARITY
    own = sets.withColumnRenamed("doc_id", "rep").join(classes, "rep").select("rep", "print", "component", "codes")
    tokens = own.mapInArrow(per_slice(_tokens), "rep long, print binary, component long, n long, code long")
    tokens = compact(tokens, "minhash-tokens")
    often = compact(tokens.groupBy("code").agg(F.count("*").alias("sets")).where("sets > 1"), "minhash-often")
    shared = tokens.join(often, "code")
    mine = Window.partitionBy("rep", "print")
    at = F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("sets", "code"))
    shared = shared.withColumn("at", at).where(f"at <= n - ceil({part} * n / {whole}) + 1")
    return compact(shared.select("rep", "component", "n", "code", "at"), "minhash-prefixes")


def _crossing(prefixes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes in different components that share a prefix code and may be similar enough.

    Of the components that share a code, the one with most classes meets only the others, never itself.
    """
    part, whole = SIMILARITY
    counts = prefixes.groupBy("code", "component").agg(F.count("*").alias("rows"))
    largest = F.max(F.struct("rows", "component"))["component"].alias("main")
    codes = counts.groupBy("code").agg(largest, F.count("*").alias("components")).where("components > 1")
    rows = compact(prefixes.join(compact(codes.select("code", "main"), "minhash-codes"), "code"), "minhash-crossing")
    one, other = (
        df.select("code", "main", *[F.col(c).alias(f"{c}_{side}") for c in ("rep", "component", "n", "at")])
        for side, df in (("a", rows.where("component <> main")), ("b", rows))
    )
    # No more codes can be common than those from this one on, if it is the first common one.
    common = "(1 + least(n_a - at_a, n_b - at_b))"
    pairs = one.join(other.drop("main"), "code").where(
        "component_a <> component_b AND (component_b = main OR rep_a < rep_b) "
        f"AND {whole} * least(n_a, n_b) >= {part} * greatest(n_a, n_b) "
        f"AND {part + whole} * {common} >= {part} * (n_a + n_b)"
    )
    return pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def _between(members: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between different components that share a bucket.

    The few pairs of a small bucket are rows. Classes of larger buckets are joined on their rarest codes.
    """
    placed = members.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    placed = compact(placed.withColumn("component", F.coalesce("component", "rep")), "minhash-placed")
    open_buckets = placed.groupBy("bucket").agg(
        F.min("component").alias("first"), F.max("component").alias("last"), F.count("*").alias("rows")
    )
    open_buckets = compact(open_buckets.where("first <> last").select("bucket", "rows"), "minhash-open")
    placed = compact(placed.join(open_buckets, "bucket"), "minhash-split")

    small = placed.where(F.col("rows") <= SMALL)
    one, other = (
        small.select("bucket", *[F.col(c).alias(f"{c}_{side}") for c in ("rep", "n_shingles", "component")])
        for side in "ab"
    )
    part, whole = SIMILARITY
    pairs = one.join(other, "bucket").where(
        "rep_a < rep_b AND component_a <> component_b "
        f"AND {whole} * least(n_shingles_a, n_shingles_b) >= {part} * greatest(n_shingles_a, n_shingles_b)"
    )
    pairs = pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))

    large = placed.where(F.col("rows") > SMALL).select("rep", "component").distinct()
    pairs = pairs.unionByName(_crossing(_prefixes(large, sets))).distinct()
    return verified(compact(pairs, "minhash-candidates"), sets)


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per row of ``documents(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    Null and empty texts have no shingles and are linked with nothing, as are rows without a doc_id (component_id null,
    kept). Rows with the same doc_id are one node: what links to one of them links to all. Further columns are ignored.
    Tables with the signatures, the sets of candidates and the links are written to the shared folder.
    """
    texts = documents.select("doc_id", "text")
    signed = stored(
        texts.mapInArrow(per_slice(_signatures), "doc_id long, n_shingles long, print binary, bands array<long>"),
        "minhash",
    )
    usable = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    # Stored before they are joined back, so that a group that is far larger than others can be split in the join.
    classes = compact(usable.groupBy("print").agg(F.min("doc_id").alias("rep")), "minhash-classes")
    # A class stands in the buckets once, by its smallest document.
    reps = usable.join(classes.select("print", F.col("rep").alias("doc_id")), ["print", "doc_id"], "left_semi")
    members = reps.select(F.col("doc_id").alias("rep"), "n_shingles", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub <> last")
    shared = compact(shared.select("bucket", "hub"), "minhash-hubs")
    members = compact(members.join(shared, "bucket"), "minhash-buckets")
    nodes = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = texts.join(nodes, "doc_id", "left_semi").mapInArrow(per_slice(_sets), "doc_id long, print binary, codes binary")
    sets = stored(sets, "minhash-sets")

    rows = usable.join(classes, "print").select("doc_id", "rep")
    several = rows.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a <> last")
    same_id = rows.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b"))

    star = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    with batch_rows(documents.sparkSession, SET_ROWS):
        links = stored(verified(star, sets).unionByName(same_id), "minhash-links")
    found = contract(links, "minhash")

    with batch_rows(documents.sparkSession, SET_ROWS):
        more = compact(_between(members, found, sets), "minhash-more")
    if not more.isEmpty():
        found = contract(links.unionByName(more), "minhash")

    labels = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    labels = labels.select("print", F.coalesce("component", "rep").alias("component"))
    result = signed.select("doc_id", "n_shingles", "print").join(labels, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return result.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
