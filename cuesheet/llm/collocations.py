"""Collocations: phrases that stand together far more often than their parts would by chance.

Phrase counts come from suffix trees that are cut off at ``LONGEST`` words and built apart from each other:

* The corpus is cut vertically, by the words with which a suffix begins. A first pass counts one-word prefixes. Prefixes
  with more suffixes than the memory budget are extended by one word and counted again, until each fits. Their hashes
  are dealt to slots, and neighbouring slots are packed into groups of at most the budget.
* A second pass sends every suffix to the group of its prefix. A suffix ends after ``LONGEST`` words, at the end of its
  piece, and before a word that is too rare to be part of any result. Equal suffixes of a batch leave as one with a
  weight, packed with the words that they need.
* Each group sorts its suffixes, which is its subtree: a node's children lie side by side, and the count of a node
  is the total of the leaves below it. Nodes above an extended prefix are spread over groups, so their parts are summed.

Scores use decimals of 38 digits, so products beyond 64 bits stay exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from cuesheet.llm.components import compact
from cuesheet.session import stored

LONGEST = 5
LEAST = 100  # occurrences of a phrase
PERCENT = 100  # a phrase goes if a longer one around it has so many percent of its occurrences
TOP = 2000  # phrases reported for each language
BUDGET = 1 << 20  # suffixes in a group
SLOTS = 1 << 18  # into which prefixes are dealt before they are packed; bounds what is sent to every task
RARE_BITS = 23  # places of the filter of words that are not rare
_HELD = 1 << 21  # words of a language that a task holds before it sends their suffixes
_PARTS = 64  # into which a language is dealt before its first phrases are chosen

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CUT = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")


@dataclass(frozen=True)
class Partition:
    """Where suffixes go. ``heavy[d]`` are the sorted hashes of the prefixes of d + 1 words that were extended."""

    heavy: tuple[np.ndarray, ...]
    group_of_slot: np.ndarray
    frequent: np.ndarray  # bits by word hash; a word without its bit is rare


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of every piece of a text, in lower case (A-Z)."""
    if text:
        for piece in _CUT.split(text.encode("utf-8", "surrogatepass").translate(_LOWER)):
            found = piece.split()  # a piece has no other white space than blanks and tabs
            if found:
                yield found


def _word_hash(word: bytes, lang: str) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42))


def _further(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of prefixes that are one word longer."""
    x = (prefix ^ (prefix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


class _Held:
    """Words of one language as numbers, in order; a zero stands between pieces."""

    def __init__(self, lang: str):
        self.lang, self.index, self.parts, self.count = lang, {}, [], 0

    def add(self, text: str | None) -> None:
        index, ids = self.index, []
        for words in pieces(text):
            ids += [index.setdefault(word, len(index) + 1) for word in words]
            ids.append(0)
        if ids:
            self.parts.append(np.array(ids, np.int32))
            self.count += len(ids)

    def suffixes(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of LONGEST word numbers (zero after the end), and the hash of each number's word."""
        ids = np.concatenate([*self.parts, np.zeros(LONGEST, np.int32)])
        hashes = np.fromiter((_word_hash(w, self.lang) for w in self.index), np.uint64, len(self.index))
        hashes = np.concatenate([np.zeros(1, np.uint64), hashes])
        place = hashes & np.uint64((1 << RARE_BITS) - 1)
        kept = (frequent[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
        kept[0] = 0
        ids = np.where(kept[ids] == 1, ids, 0)
        end = len(ids) - LONGEST
        starts = np.flatnonzero((ids[:end] > 0) & (ids[1 : end + 1] > 0))
        rows = np.empty((LONGEST, len(starts)), np.int32)
        on = np.ones(len(starts), bool)
        for d in range(LONGEST):
            rows[d] = ids[starts + d] * on
            on &= rows[d] > 0
        return rows, hashes


def _by_language(batches: Iterator[pa.RecordBatch], ready) -> Iterator:
    """``ready(held)`` for the words of a language, each time that enough are there, and at the end."""
    held: dict[str, _Held] = {}
    total = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = held.setdefault(lang, _Held(lang))
            before = own.count
            own.add(text)
            total += own.count - before
            if own.count >= _HELD:
                total -= own.count
                yield from ready(held.pop(lang))
            elif total >= 4 * _HELD:  # many languages with few words each
                for own in held.values():
                    yield from ready(own)
                held, total = {}, 0
    for own in held.values():
        if own.count:
            yield from ready(own)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = counts.setdefault(lang, Counter())
            for words in pieces(text):
                own.update(words)
        for lang, own in counts.items():
            words = list(own)
            hashes = np.fromiter((_word_hash(w, lang) for w in words), np.uint64, len(words))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(words), pa.string()),
                    pa.array(words, pa.binary()).cast(pa.string()),
                    pa.array(hashes.view(np.int64)),
                    pa.array(list(own.values()), pa.int64()),
                ],
                ["lang", "word", "hash", "f"],
            )


def _prefixes(rows: np.ndarray, hashes: np.ndarray, heavy: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the hash of its prefix and how many words that has: one more than the heavy ones it begins with."""
    code, size = hashes[rows[0]], np.ones(rows.shape[1], np.int8)
    at = np.arange(rows.shape[1])
    for d, known in enumerate(heavy):
        at = at[_in(code[at], known)]
        if not len(at):
            break
        code[at] = _further(code[at], hashes[rows[d + 1, at]])
        size[at] += 1
    return code, size


def _count_prefixes(frequent: np.ndarray, heavy: tuple[np.ndarray, ...]):
    """Counts of the prefixes that are one word longer than the longest heavy ones."""

    def count(held: _Held) -> Iterator[pa.RecordBatch]:
        rows, hashes = held.suffixes(frequent)
        code, size = _prefixes(rows, hashes, heavy)
        found, counts = np.unique(code[size == len(heavy) + 1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], ["hash", "f"])

    return lambda batches: _by_language(batches, count)


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint16 if not len(values) or values.max() < 1 << 16 else np.uint32)


def _equal_next(rows: np.ndarray) -> np.ndarray:
    return (rows[:, 1:] == rows[:, :-1]).all(axis=0)


def _order(rows: np.ndarray) -> np.ndarray:
    """Places that sort suffixes word by word."""
    if rows.size and rows.max() < 1 << 21:
        wide = rows.astype(np.int64)
        return np.lexsort(((wide[3] << 21) | wide[4], (wide[0] << 42) | (wide[1] << 21) | wide[2]))
    return np.lexsort(rows[::-1])


def _send(partition: Partition):
    """Suffixes of a task's words, packed for each group."""

    def pack(held: _Held) -> Iterator[pa.RecordBatch]:
        rows, hashes = held.suffixes(partition.frequent)
        rows = rows[:, _order(rows)]
        if not rows.shape[1]:
            return
        first = np.flatnonzero(np.concatenate([[True], ~_equal_next(rows)]))
        weights = np.diff(np.concatenate([first, [rows.shape[1]]]))
        rows = rows[:, first]
        code, size = _prefixes(rows, hashes, partition.heavy)
        group = partition.group_of_slot[(code & np.uint64(SLOTS - 1)).astype(np.int64)]
        order = np.argsort(group, kind="stable")
        words, zip_ = list(held.index), zstandard.ZstdCompressor(level=1)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group[order])) + 1, [len(order)]])
        packed = []
        for low, high in zip(cuts[:-1], cuts[1:]):
            own = order[low:high]
            used, local = np.unique(rows[:, own], return_inverse=True)
            local = local.reshape(LONGEST, -1)
            if used[0]:  # no suffix of the group ends early, so that zero is not among its numbers
                used, local = np.concatenate([[0], used]), local + 1
            cells, many = _narrow(local), _narrow(weights[own])
            packed.append(
                (
                    int(group[own[0]]), held.lang, len(own), cells.itemsize, many.itemsize,
                    zip_.compress(b"\n".join(words[k - 1] for k in used[1:].tolist())),
                    zip_.compress(cells.tobytes() + many.tobytes() + size[own].tobytes()),
                )
            )
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*packed)], _PACKED_NAMES)

    return lambda batches: _by_language(batches, pack)


_PACKED = "grp long, lang string, rows long, cell long, many long, words binary, cells binary"
_PACKED_NAMES = [part.split()[0] for part in _PACKED.split(", ")]


def _unpack(row: dict, index: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    unzip, n, cell, many = zstandard.ZstdDecompressor(), row["rows"], row["cell"], row["many"]
    words = unzip.decompress(row["words"]).split(b"\n")
    ids = np.array([0, *[index.setdefault(word, len(index) + 1) for word in words]], np.int32)
    data = unzip.decompress(row["cells"])
    end = LONGEST * n * cell
    cells = np.frombuffer(data[:end], f"<u{cell}").reshape(LONGEST, n)
    weights = np.frombuffer(data[end : end + n * many], f"<u{many}").astype(np.int64)
    return ids[cells], weights, np.frombuffer(data[end + n * many :], np.int8)


def _subtrees(least: int):
    """Counts of the nodes below a group's prefixes, and parts of the counts of nodes above them."""

    def count(packed: pa.Table) -> pa.Table:
        langs, phrases, sizes, counts = [], [], [], []
        by_lang: dict[str, list[dict]] = {}
        for row in packed.to_pylist():
            by_lang.setdefault(row["lang"], []).append(row)
        for lang, own in by_lang.items():
            index: dict[bytes, int] = {}
            parts = [_unpack(row, index) for row in own]
            rows = np.concatenate([p[0] for p in parts], axis=1)
            order = _order(rows)
            rows = rows[:, order]
            weights = np.concatenate([p[1] for p in parts])[order]
            prefix = np.concatenate([p[2] for p in parts])[order]
            names = [b"", *index]
            changed = np.zeros(rows.shape[1], bool)
            changed[0] = True
            changed[1:] = rows[0, 1:] != rows[0, :-1]
            for d in range(1, LONGEST):
                changed[1:] |= rows[d, 1:] != rows[d, :-1]
                starts = np.flatnonzero(changed)
                total = np.add.reduceat(weights, starts)
                above = np.maximum.reduceat(prefix, starts) > d + 1
                kept = starts[(rows[d, starts] > 0) & ((total >= least) | above)]
                total = total[(rows[d, starts] > 0) & ((total >= least) | above)]
                langs += [lang] * len(kept)
                phrases += [b" ".join(names[k] for k in ids) for ids in rows[: d + 1, kept].T.tolist()]
                sizes += [d + 1] * len(kept)
                counts += total.tolist()
        return pa.table(
            {
                "lang": pa.array(langs, pa.string()),
                "phrase": pa.array(phrases, pa.binary()).cast(pa.string()),
                "size": pa.array(sizes, pa.int32()),
                "f": pa.array(counts, pa.int64()),
            }
        )

    return count


def _collect_numbers(df: DataFrame, *names: str) -> list[np.ndarray]:
    table = df.select(*names).toArrow()
    return [table.column(name).to_numpy() for name in names]


def divide(words: DataFrame, texts: DataFrame, budget: int) -> Partition:
    """The vertical partition: words(hash, f) are the one-word prefixes that are not rare.

    What reaches the driver is bounded: places of the filter and slots by their number, heavy prefixes by the number of
    suffixes over the budget.
    """
    place = F.col("hash").bitwiseAND(F.lit((1 << RARE_BITS) - 1)).alias("place")
    (places,) = _collect_numbers(words.select(place).distinct(), "place")
    frequent = np.zeros(1 << (RARE_BITS - 3), np.uint8)
    np.bitwise_or.at(frequent, places >> 3, (1 << (places & 7)).astype(np.uint8))
    heavy: list[np.ndarray] = []
    loads = np.zeros(SLOTS, np.int64)
    counted = words.select("hash", "f")
    while True:
        # A prefix of all words but the last has nothing to be extended by, except the end.
        final = len(heavy) == LONGEST - 1
        light = counted if final else counted.where(F.col("f") <= budget)
        slot = F.col("hash").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")
        slots = light.groupBy(slot).agg(F.sum("f").alias("f"))
        at, load = _collect_numbers(slots, "slot", "f")
        loads[at] += load
        if final:
            break
        (over,) = _collect_numbers(counted.where(F.col("f") > budget), "hash")
        if not len(over):
            break
        heavy.append(np.sort(over.view(np.uint64)))
        longer = texts.mapInArrow(_count_prefixes(frequent, tuple(heavy)), "hash long, f long")
        counted = stored(longer.groupBy("hash").agg(F.sum("f").alias("f")), f"prefixes-{len(heavy) + 1}")
    return Partition(tuple(heavy), pack_slots(loads, budget), frequent)


def pack_slots(loads: np.ndarray, budget: int) -> np.ndarray:
    """Group of every slot: neighbours together as long as they fit; a slot over the budget is alone."""
    groups, group, filled = np.zeros(len(loads), np.int64), 0, 0
    for slot, load in enumerate(loads.tolist()):
        if filled and filled + load > budget:
            group, filled = group + 1, 0
        groups[slot], filled = group, filled + load
    return groups


def count_phrases(documents: DataFrame, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of 1 to LONGEST words with f >= least, and (lang, n)."""
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    words = texts.mapInArrow(_count_words, "lang string, word string, hash long, f long")
    words = stored(words.groupBy("lang", "word", "hash").agg(F.sum("f").alias("f")), "collocation-words")
    sizes = compact(words.groupBy("lang").agg(F.sum("f").alias("n")), "collocation-sizes")
    often = words.where(F.col("f") >= least)
    partition = divide(often, texts, budget)
    packed = texts.mapInArrow(_send(partition), _PACKED)
    nodes = packed.groupBy("grp").applyInArrow(_subtrees(least), "lang string, phrase string, size int, f long")
    nodes = nodes.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    ones = often.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "f")
    return stored(ones.unionByName(nodes), "collocation-phrases"), sizes


def _parts(first: str, last: str) -> str:
    return f"array_join(slice(words, {first}, {last}), ' ')"


def scored(phrases: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score) of every phrase of two or more words, by its weakest cut."""
    candidates = phrases.where("size > 1").withColumn("words", F.split("phrase", " ")).join(sizes, "lang")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")).select(
        "lang", "phrase", "size", F.col("f").alias("a"), "n", "cut",
        F.expr(_parts("1", "cut")).alias("left"), F.expr(_parts("cut + 1", "size - cut")).alias("right"),
    )
    known = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = {name: F.col(name).cast("decimal(19,0)") for name in "alrn"}
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["n"], wide["l"] * wide["r"])
    cuts = cuts.withColumn("score", score.cast("bigint"))
    best = cuts.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "size", "a", "best.l", "best.r", "n", "best.score")


def subsumed(phrases: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(lang, phrase) of phrases that stand inside a longer one with nearly as many occurrences."""
    longer = phrases.where("size > 2").withColumn("words", F.split("phrase", " "))
    inside = F.expr(
        "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1),"
        " i -> array_join(slice(words, i, m), ' '))))"
    )
    inside = longer.select("lang", F.explode(inside).alias("phrase"), F.col("f").alias("around"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    own = phrases.where("size > 1").select("lang", "phrase", "f")
    return own.join(inside, ["lang", "phrase"]).where(100 * F.col("around") >= percent * F.col("f")).select("lang", "phrase")


def collocations(
    documents: DataFrame, top: int = TOP, least: int = LEAST, percent: int = PERCENT, budget: int = BUDGET
) -> DataFrame:
    """Per language its first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A null lang is ``und``. Null and empty texts have no words; texts may be of any length, and rows that repeat count
    each time. Equal scores go by occurrences, then by the phrase's UTF-8 bytes, so no two phrases tie. Further columns
    are ignored, whatever their names. An empty table gives no rows.
    """
    phrases, sizes = count_phrases(documents, least, budget)
    found = scored(phrases, sizes).join(subsumed(phrases, percent), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's phrases are first thinned out in parts, each of which may hold all of the first ones.
    part = F.pmod(F.xxhash64("phrase"), F.lit(_PARTS)).alias("part")
    rank = F.row_number()
    found = found.select("*", part).withColumn("rank", rank.over(Window.partitionBy("lang", "part").orderBy(*order)))
    found = found.where(F.col("rank") <= top)
    found = found.withColumn("rank", rank.over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return found.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
