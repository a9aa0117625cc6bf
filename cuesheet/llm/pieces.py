"""Sampled segmentations over a SentencePiece vocabulary, and lossless decoding.

All ways to write a text as pieces form a lattice. Forward filtering sums the weights of all ways to reach each place;
backward sampling then draws one way, piece by piece from the end, with its exact probability. The random numbers are
hashes of the row's key, the word's number and the step, so a row gets the same segmentation wherever and whenever it
is encoded. A piece weighs ``exp(score / temperature)``; the vocabulary of a merge-based model, whose scores are ranks,
gets ``score = -log(1 + rank)``. Characters that are no piece are written as byte pieces, which also keeps a literal
U+2581 apart from a space.

No piece of the usual vocabularies goes on after a word's end, so the lattice of a text is a chain of the lattices of
its words; these are filtered once per worker and remembered, and all words of a slice are sampled together.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cuesheet.llm.arrow import slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
TEMPERATURE = 0.25
SEED = 1
_MOST_EDGES = 3_000_000  # a worker's remembered lattices are dropped between slices beyond this
_SPACE = "▁"


@dataclass
class Vocabulary:
    pieces: dict[str, int]  # with a plain space for U+2581
    scores: list[float]
    byte_ids: list[int]
    written: list[bytes]  # what each id stands for
    longest: int
    cuts: bool  # no piece goes on after the end of a word

    @staticmethod
    def load(path: str = VOCABULARY) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [k for k in range(size) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        given = {k: model.get_score(k) for k in plain}
        ranked = sorted(plain, key=lambda k: (-given[k], k))
        # Scores that are whole numbers down to minus the size are ranks; others are log probabilities.
        is_rank = all(v == int(v) for v in given.values())
        scores = [0.0] * size
        for rank, k in enumerate(ranked):
            scores[k] = -math.log(1 + rank) if is_rank else given[k]
        pieces, written, byte_ids = {}, [b""] * size, [-1] * 256
        for k in range(size):
            if model.is_byte(k):
                value = int(model.id_to_piece(k)[1:-1], 16)
                byte_ids[value], written[k] = k, bytes([value])
        for k in plain:
            text = model.id_to_piece(k).replace(_SPACE, " ")
            pieces[text], written[k] = k, text.encode()
        for value, k in enumerate(byte_ids):
            if k < 0:
                raise ValueError(f"the vocabulary has no piece for byte {value}, so that not every text can be written")
            scores[k] = -math.log(1 + len(ranked)) if is_rank else min(given.values()) - 1
        return Vocabulary(
            pieces,
            scores,
            byte_ids,
            written,
            max(map(len, pieces)),
            not any(" " in p.lstrip(" ") for p in pieces),
        )

    def decode(self, ids) -> str | None:
        """The text of a sequence of ids; null for null."""
        if ids is None:
            return None
        text = b"".join(map(self.written.__getitem__, ids)).decode("utf-8")
        return text[1:]  # the space that encoding puts in front


_WORDS = re.compile(r" +[^ ]*|[^ ]+")


class Prefixes:
    """All beginnings of all pieces in an open hash table over 64-bit codes, for look-ups of whole arrays."""

    STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: dict[str, int]):
        found = {}
        for text, k in pieces.items():
            code = 0
            for length, char in enumerate(text, 1):
                code = (code * int(self.STEP) + ord(char) + 1) % (1 << 64)
                found.setdefault(code, -1)
                if length == len(text):
                    found[code] = k
        self.bits = max(16, len(found).bit_length() + 2)
        size = 1 << self.bits
        self.codes, self.ids, self.used = np.zeros(size, np.uint64), np.full(size, -1, np.int32), np.zeros(size, bool)
        codes = np.fromiter(found, np.uint64, len(found))
        for code, at, k in zip(codes, self.slot(codes).tolist(), found.values()):
            while self.used[at]:
                at = (at + 1) % size
            self.codes[at], self.ids[at], self.used[at] = code, k, True

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes ^ (codes >> np.uint64(32))) * self.STEP >> np.uint64(64 - self.bits)).astype(np.int64)

    def extend(self, codes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        return codes * self.STEP + chars + np.uint64(1)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each code whether it is the beginning of a piece, and the piece that it is as a whole (or -1)."""
        at = self.slot(codes)
        known, ids = self.codes[at] == codes, self.ids[at]
        known &= self.used[at]
        on = np.flatnonzero(~known & self.used[at])
        at = at[on]
        while len(on):  # the next slots, for the few that share one
            at = (at + 1) % len(self.codes)
            hit = self.used[at] & (self.codes[at] == codes[on])
            known[on[hit]], ids[on[hit]] = True, self.ids[at[hit]]
            more = self.used[at] & ~hit
            on, at = on[more], at[more]
        return known, np.where(known, ids, -1)


class Lattices(dict):
    """Filtered lattices of words: text -> number of the last node; all nodes of a worker lie in shared arrays.

    Every character of a word is a node: the place behind it. A node's edges lie side by side; ``upto`` is the summed
    probability of the node's edges so far, 1 at its last one. ``back`` is the node that the edge comes from (-1: the
    word's start), ``piece`` its id, or -1 - c for a character c that is written in bytes.
    """

    def __init__(self, vocabulary: Vocabulary, temperature: float):
        self.vocabulary, self.temperature = vocabulary, temperature
        self.prefixes = Prefixes(vocabulary.pieces)
        self.scores = np.array(vocabulary.scores) / temperature
        self.byte_score = float(np.mean([self.scores[k] for k in vocabulary.byte_ids]))
        self.byte_ids = np.array(vocabulary.byte_ids, np.int32)
        self._space = [np.empty(0), np.empty(0, np.int32), np.empty(0, np.int32)]
        self._first = np.empty(0, np.int32)
        self.edges = self.nodes = 0

    def reset(self) -> None:
        self.clear()
        self.edges = self.nodes = 0

    def arrays(self) -> list[np.ndarray]:
        """upto, back and piece by edge, and each node's first edge."""
        return [*(x[: self.edges] for x in self._space), self._first[: self.nodes]]

    def _append(self, upto: np.ndarray, back: np.ndarray, piece: np.ndarray, first: np.ndarray) -> None:
        end, last = self.edges + len(upto), self.nodes + len(first)
        self._space = [_room(x, self.edges, end) for x in self._space]
        for space, part in zip(self._space, (upto, back, piece)):
            space[self.edges : end] = part
        self._first = _room(self._first, self.nodes, last)
        self._first[self.nodes : last] = first
        self.edges, self.nodes = end, last

    def ends(self, words: list[str]) -> list[int]:
        """The last node of each word; words not seen before are filtered, all together."""
        new = [w for w in dict.fromkeys(words) if w not in self]
        if new:
            text = np.frombuffer("".join(new).encode("utf-32-le"), np.uint32)
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            last = self.nodes + np.cumsum(sizes) - 1
            self._filter(text, sizes)
            self.update(zip(new, last.tolist()))
        return list(map(self.__getitem__, words))

    def _filter(self, text: np.ndarray, sizes: np.ndarray) -> None:
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.arange(len(text))
        inside = place - starts  # the character's place in its word
        room = np.repeat(sizes, sizes) - inside
        # Edges: from every character, ever longer beginnings of pieces.
        froms, tos, ids = [], [], []
        alone = np.ones(len(text), bool)
        at, codes = place, np.zeros(len(text), np.uint64)
        for length in range(1, self.vocabulary.longest + 1):
            on = room[at] >= length
            at, codes = at[on], codes[on]
            codes = self.prefixes.extend(codes, text[at + length - 1].astype(np.uint64))
            known, found = self.prefixes.find(codes)
            whole = found >= 0
            froms.append(at[whole])
            tos.append(at[whole] + length - 1)
            ids.append(found[whole])
            if length == 1:
                alone[at[whole]] = False
            at, codes = at[known], codes[known]
            if not len(at):
                break
        weights = [self.scores[k] for k in ids]
        rest = np.flatnonzero(alone)  # characters that are no piece
        chars = text[rest].astype(np.int64)
        froms.append(rest)
        tos.append(rest)
        ids.append(np.where(chars < 0x80, self.byte_ids[np.minimum(chars, 0x7F)], -1 - chars).astype(np.int32))
        weights.append(self.byte_score * _bytes_of(chars))
        # Longer pieces first: they are the likelier ones, and sampling tries a node's edges in order.
        start, end, piece, weight = (np.concatenate(x[::-1]) for x in (froms, tos, ids, weights))
        by_node = np.argsort(end, kind="stable")
        start, piece, weight = start[by_node], piece[by_node], weight[by_node]
        back = np.where(inside[start] == 0, -1, start - 1)
        count = np.bincount(end, minlength=len(text))
        first = np.cumsum(count) - count
        # Forward: all nodes at the same place of their words at once.
        order = np.argsort(inside.astype(np.uint16 if sizes.max() < 1 << 16 else np.int64), kind="stable")
        own = count[order]
        place = np.cumsum(own) - own
        edges = np.repeat(first[order] - place, own) + np.arange(len(back))
        from_, weight = back[edges], weight[edges]
        log_sum, upto = np.zeros(len(text) + 1), np.empty(len(back))  # the last entry serves back = -1
        levels = np.concatenate([[0], np.cumsum(np.bincount(inside))])
        marks = np.append(place, len(back))[levels]
        for k in range(len(levels) - 1):
            nodes, many = order[levels[k] : levels[k + 1]], own[levels[k] : levels[k + 1]]
            low, high = marks[k], marks[k + 1]
            begin = place[levels[k] : levels[k + 1]] - low
            total = log_sum[from_[low:high]] + weight[low:high]
            most = np.maximum.reduceat(total, begin)
            share = np.exp(total - np.repeat(most, many))
            added = np.add.reduceat(share, begin)
            log_sum[nodes] = most + np.log(added)
            running = np.cumsum(share)
            before = running[begin] - share[begin]
            part = np.minimum((running - np.repeat(before, many)) / np.repeat(added, many), 1.0)
            part[begin + many - 1] = 1.0
            upto[low:high] = part
        chance = np.empty(len(back))
        chance[edges] = upto
        back = np.where(back < 0, -1, back + self.nodes)
        self._append(chance, back, piece, first + self.edges)


def _room(array: np.ndarray, used: int, wanted: int) -> np.ndarray:
    """The array, or its used part in a larger one."""
    return array if wanted <= len(array) else np.concatenate([array[:used], np.empty(max(wanted, 1 << 16), array.dtype)])


def _bytes_of(chars: np.ndarray) -> np.ndarray:
    """How many bytes the characters have in UTF-8."""
    return 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, word: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on nothing but the row's key, the word's number in its text and the step."""
    value = _mix(key + word * np.uint64(0x9E3779B97F4A7C15) + np.uint64((step * 0xD1B54A32D192ED03) % (1 << 64)))
    return (value >> np.uint64(11)).astype(np.float64) * 2.0**-53


def sample(texts: list[str | None], keys: np.ndarray, lattices: Lattices) -> list[np.ndarray | None]:
    """One segmentation per text; null gives null, the empty text no piece."""
    if lattices.edges > _MOST_EDGES:
        lattices.reset()
    words, sizes = [], []
    for text in texts:
        own = [] if not text else _WORDS.findall(" " + text) if lattices.vocabulary.cuts else [" " + text]
        words += own
        sizes.append(len(own))
    if not words:
        return [None if t is None else np.empty(0, np.int32) for t in texts]
    nodes = lattices.ends(words)
    sizes = np.array(sizes)
    upto, back, piece, first_edge = lattices.arrays()
    first = np.cumsum(sizes) - sizes
    number = (np.arange(len(nodes)) - np.repeat(first, sizes)).astype(np.uint64)
    key = np.repeat(keys, sizes)
    at, word = np.array(nodes, np.int32), np.arange(len(nodes))
    drawn, steps = [], np.zeros(len(nodes), np.int64)
    step = 0
    while len(at):
        # A node's last edge has 1, above every number drawn, so the search stays within the node.
        edge, drawn_at = first_edge[at], uniform(key[word], number[word], step)
        past = np.flatnonzero(upto[edge] <= drawn_at)
        while len(past):
            edge[past] += 1
            past = past[upto[edge[past]] <= drawn_at[past]]
        drawn.append((word, piece[edge]))
        steps[word] += 1
        at = back[edge]
        on = at >= 0
        at, word = at[on], word[on]
        step += 1
    ends = np.cumsum(steps)
    out = np.empty(ends[-1], np.int32)
    for k, (word, ids) in enumerate(drawn):  # drawn from the end of each word
        out[ends[word] - 1 - k] = ids
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
    out, bounds = _with_bytes(out, bounds, lattices.byte_ids)
    return [None if t is None else out[bounds[k] : bounds[k + 1]] for k, t in enumerate(texts)]


def _with_bytes(ids: np.ndarray, bounds: np.ndarray, byte_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the byte pieces of the characters that are no piece, and where each text now starts."""
    where = np.flatnonzero(ids < 0)
    if not len(where):
        return ids, bounds
    chars = -1 - ids[where].astype(np.int64)
    many = _bytes_of(chars)
    count = np.ones(len(ids), np.int64)
    count[where] = many
    ends = np.cumsum(count)
    out = np.repeat(ids, count)
    first = ends[where] - many
    for k in range(4):
        on = many > k
        below = 6 * (many[on] - 1 - k)
        bits = chars[on] >> below
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[many[on]]
        out[first[on] + k] = byte_ids[(bits | lead) if k == 0 else (bits & 0x3F) | 0x80]
    return out, np.concatenate([[0], ends])[bounds]


def row_keys(keys: pa.Array, seed: int = SEED) -> np.ndarray:
    """64-bit keys of the rows' ids; a null id counts as one more id."""
    null = np.array(keys.is_null())
    values = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return _mix(values * np.uint64(2) + null.astype(np.uint64) + _mix(np.full(len(values), seed, np.uint64)))


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """Per row of ``documents(doc_id, text)``: doc_id, ids, n_pieces, lossless (decoding the ids gave the text).

    Null texts have null ids, no pieces and are lossless; the empty text has the empty list. A doc_id is the row's key:
    rows that repeat get the same segmentation. Further columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(shared.value, temperature)
        decode = shared.value.decode
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            found = sample(texts, row_keys(part.column(0), seed), lattices)
            sizes = np.array([0 if f is None else len(f) for f in found], np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = np.concatenate([f for f in found if f is not None] or [np.empty(0, np.int32)])
            ids = pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(values, pa.int32()), mask=pa.array([t is None for t in texts])
            )
            same = [f is None or not len(f) and not t or decode(f.tolist()) == t for f, t in zip(found, texts)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), ids, pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())],
                ["doc_id", "ids", "n_pieces", "lossless"],
            )

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, ids array<int>, n_pieces long, lossless boolean"
    )


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row of ``encoded(doc_id, ids)``: doc_id and text, exactly the text that was encoded."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [shared.value.decode(ids) for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
