"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into segments that no piece crosses. The most frequent ones make
a dictionary: their substrings of at most the longest piece's length are joined
with the piece table; what matches are the edges of a segment's lattice, which
are grouped by segment and folded with a higher-order ``aggregate``.

The fold follows the model's own rule. For a BPE model that is: merge the
neighbours whose piece has the highest score, leftmost first, until none is
left. (A Viterbi fold, which looks for the path with the largest sum of
scores, gives other ids for such a model; see README.) The state of the fold is
a bit mask of the cuts still standing. One pass over the edges does: the piece
table is checked to merge every piece from parts of better scores, so a merge
never makes an earlier edge possible. Segments too long for a mask, and all
segments of a model that fails the check, follow the same rule in a Python task.

The dictionary, of bounded size, goes to all tasks. Other segments, most of which
occur once, would cost a shuffled row each to meet an encoding that nobody else
needs; the task that reads the text builds and folds their lattices itself, by the
same rule. Only counts of segments are shuffled. Nothing is dropped.

A space becomes the sign U+2581, as does the start of a text. Characters that
no piece has are encoded as bytes. Decoding gives the text back, except that a
U+2581 of the text itself becomes a space. A null or empty text has no tokens.
Rows equal in id and text get equal results, one each. Other columns of the
input are not read.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import itertools
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscale.llm.common import materialised, stored, text_hash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MASK_CHARS = 62
FREQUENT = 1 << 16
REMEMBERED = 200_000  # segments that a task keeps beside its texts
ROWS_AT_ONCE = 1024

# Where segments end: at a space, around line ends and tabs, between a letter and a mark.
_MARK = re.compile(r"[\n\t.,!?;:]")
_AT_SPACES = re.compile(rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_CUT_IN_PIECE = regex.compile(rf"[^{SPACE}]{SPACE}|.[\n\t]|[\n\t].|\p{{L}}[.,!?;:]")


class PieceModel:
    """The pieces of a model file; their number bounds what is broadcast."""

    def __init__(self, path: str = MODEL) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: list[tuple[str, int, float]] = []
        self.byte_ids: dict[int, int] = {}
        self.hex: list[tuple[int, str]] = []
        for number in range(model.get_piece_size()):
            piece = model.id_to_piece(number)
            if model.is_byte(number):
                self.byte_ids[int(piece[3:5], 16)] = number
                self.hex.append((number, piece[3:5]))
            elif not (model.is_control(number) or model.is_unknown(number) or model.is_unused(number)):
                self.pieces.append((piece, number, model.get_score(number)))
                self.hex.append((number, piece.encode().hex().upper()))
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces, so it cannot encode every text")
        crossed = [piece for piece, _, _ in self.pieces if len(piece) > 1 and _CUT_IN_PIECE.search(piece)]
        if crossed:
            raise ValueError(f"pieces that cross segment ends: {crossed[:5]}")
        self.longest = max(len(piece) for piece, _, _ in self.pieces)
        scores = {piece: (number, score) for piece, number, score in self.pieces}
        # Pieces that, alone, are merged from parts with a worse score than their own.
        self.late = [piece for piece, _, score in self.pieces if lowest_merge(piece, scores) < score]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.pieces, "piece string, id int, score double")

    def hex_table(self, spark: SparkSession) -> DataFrame:
        return F.broadcast(spark.createDataFrame(self.hex, "id int, hex string"))

    def byte_array(self) -> Column:
        return F.array(*[F.lit(self.byte_ids[value]) for value in range(256)])


def between_spaces(text: str | None) -> list[str]:
    """A text's parts, cut before its runs of spaces; each begins with one or more as U+2581."""
    if not text:
        return []
    if "  " in text or SPACE in text or text[0] == " ":
        return _AT_SPACES.findall(SPACE + text.replace(" ", SPACE))
    return (SPACE + text.replace(" ", f" {SPACE}")).split(" ")


def segments(part: str) -> list[str]:
    """The segments of a part of ``between_spaces``, in order."""
    body = part[1:-1]
    if body.isalpha() and part[0] == SPACE:  # most parts: letters between a space and a last letter or mark
        last = part[-1]
        if last.isalpha():
            return [part]
        if last in ".,!?;:\n\t":
            return [part[:-1], last]
    cuts = [0]
    for found in _MARK.finditer(part):
        at = found.start()
        if part[at] in "\n\t":
            cuts += [at, at + 1]
        elif part[at - 1].isalpha():
            cuts.append(at)
    if len(cuts) == 1:
        return [part]
    return [part[start:stop] for start, stop in itertools.pairwise([*cuts, len(part)]) if stop > start]


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join with a broadcast table of bounded size: a number as the first key is found faster than a text.

    Texts are still compared in full.
    """
    table = table.withColumnRenamed(key, "_key")
    hashed = F.broadcast(table.withColumn("_hash", F.xxhash64("_key")))
    # Said as a range, equality of the texts stays a check of what the number finds.
    same = (F.xxhash64(rows[key]) == F.col("_hash")) & rows[key].between(F.col("_key"), F.col("_key"))
    return rows.join(hashed, same, "left").drop("_key", "_hash")


def lattice(words: DataFrame, model: PieceModel) -> DataFrame:
    """(word, edges): for each word the pieces among its substrings, best first.

    Characters without a piece get an edge with id -1. ``ends`` has the bits of
    an edge's two cuts, ``inner`` those of the cuts within it.
    """
    size = F.length("word")
    starts = words.select("word", F.explode(F.sequence(F.lit(0), size - 1)).alias("start"))
    most = F.least(F.lit(model.longest), F.length("word") - F.col("start"))
    spans = starts.select("word", "start", F.explode(F.sequence(F.lit(1), most)).alias("size"))
    parts = spans.select("word", "start", "size", F.substring("word", F.col("start") + 1, F.col("size")).alias("piece"))
    matched = looked_up(parts, model.table(words.sparkSession), "piece").where("id is not null or size = 1")

    def bit(at: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), at)

    stop = F.col("start") + F.col("size")
    edge = F.struct(
        F.coalesce(-F.col("score"), F.lit(0.0)).alias("rank"),
        "start",
        F.coalesce("id", F.lit(-1)).alias("id"),
        bit(F.col("start")).bitwiseOR(bit(stop)).alias("ends"),
        (bit(stop) - bit(F.col("start") + 1)).alias("inner"),
    )
    return matched.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def fold(edges: DataFrame, model: PieceModel) -> DataFrame:
    """(word, ids) from the lattices.

    One pass over the edges, best score first: pieces with parts of a worse
    score than their own (``PieceModel.late``) are not among them.
    """
    merges = F.filter("edges", lambda edge: edge["inner"] != 0)
    uncut = F.call_function("shiftleft", F.lit(1).cast("long"), F.length("word") + 1) - 1

    def step(cuts: Column, edge: Column) -> Column:
        ends = cuts.bitwiseAND(edge["ends"]) == edge["ends"]
        joins_two = F.bit_count(cuts.bitwiseAND(edge["inner"])) == 1
        return F.when(ends & joins_two, cuts.bitwiseAND(F.bitwise_not(edge["inner"]))).otherwise(cuts)

    with_cuts = materialised(edges, cuts=F.aggregate(merges, uncut, step))

    def stands(edge: Column) -> Column:
        ends = F.col("cuts").bitwiseAND(edge["ends"]) == edge["ends"]
        return ends & (F.col("cuts").bitwiseAND(edge["inner"]) == 0)

    path = F.array_sort(
        F.transform(F.filter("edges", stands), lambda edge: F.struct(edge["start"].alias("start"), edge["id"].alias("id")))
    )
    plain = F.transform("path", lambda step: step["id"])
    bytes_of = model.byte_array()

    def ids_of(step: Column) -> Column:
        text = F.hex(F.encode(F.substring("word", step["start"] + 1, F.lit(1)), "UTF-8"))
        pairs = F.transform(F.sequence(F.lit(1), F.length(text), F.lit(2)), lambda at: F.substring(text, at, F.lit(2)))
        values = F.transform(pairs, lambda pair: F.get(bytes_of, F.conv(pair, 16, 10).cast("int")))
        return F.when(step["id"] < 0, values).otherwise(F.array(step["id"]))

    with_path = materialised(with_cuts.select("word", "edges", "cuts"), path=path).select("word", "path")
    ids = F.when(F.exists("path", lambda step: step["id"] < 0), F.flatten(F.transform("path", ids_of))).otherwise(plain)
    return with_path.select("word", ids.alias("ids"))


def _merge_steps(word: str, scores: dict[str, tuple[int, float]]) -> tuple[list[tuple[int, int]], list[float]]:
    """The spans of the pieces of a segment, by the same rule, and the score of each merge in order."""
    before, after = list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
    stop, alive = list(range(1, len(word) + 1)), [True] * len(word)
    heap: list[tuple[float, int, int]] = []

    def offer(left: int) -> None:
        if left >= 0 and after[left] < len(word):
            found = scores.get(word[left : stop[after[left]]])
            if found:
                heapq.heappush(heap, (-found[1], left, stop[after[left]]))

    for at in range(len(word) - 1):
        offer(at)
    done: list[float] = []
    while heap:
        rank, left, end = heapq.heappop(heap)
        right = after[left] if alive[left] else len(word)
        if right >= len(word) or not alive[left] or stop[right] != end:
            continue
        done.append(-rank)
        alive[right], stop[left], after[left] = False, end, after[right]
        if after[right] < len(word):
            before[after[right]] = left
        offer(before[left])
        offer(left)
    return [(at, stop[at]) for at in range(len(word)) if alive[at]], done


def lowest_merge(piece: str, scores: dict[str, tuple[int, float]]) -> float:
    """The least score among the merges that make a piece; the most possible where none does."""
    spans, done = _merge_steps(piece, scores)
    return min(done, default=float("inf")) if len(spans) == 1 else float("inf")


def merged(word: str, scores: dict[str, tuple[int, float]], byte_ids: dict[int, int]) -> list[int]:
    """The ids of one segment in plain Python."""
    ids: list[int] = []
    for start, stop in _merge_steps(word, scores)[0]:
        found = scores.get(word[start:stop])
        ids += [found[0]] if found else [byte_ids[value] for value in word[start:stop].encode("utf-8", "surrogatepass")]
    return ids


def encode_words(words: DataFrame, model: PieceModel) -> DataFrame:
    """(word, ids) of distinct words."""
    scores, byte_ids = {piece: (number, score) for piece, number, score in model.pieces}, model.byte_ids

    def long_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"word": batch["word"], "ids": [merged(word, scores, byte_ids) for word in batch["word"]]})

    most = 0 if model.late else MASK_CHARS
    short = fold(lattice(words.where(F.length("word") <= most), model), model)
    rest = words.where(F.length("word") > most).select("word")
    return short.unionByName(rest.mapInPandas(long_words, "word string, ids array<int>"))


def decode_ids(tokens: DataFrame, model: PieceModel, keys: list[str]) -> DataFrame:
    """Add ``decoded`` to rows with ``ids``, unique by ``keys``: the text with U+2581 for spaces."""
    parts = tokens.select(*keys, F.posexplode("ids").alias("at", "id")).join(model.hex_table(tokens.sparkSession), "id")
    hexes = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "hex"))), lambda part: part["hex"]), "")
    return parts.groupBy(*keys).agg(F.decode(F.unhex(hexes), "UTF-8").alias("decoded"))


def segment_counts(texts: DataFrame) -> DataFrame:
    """(word, places) of the segments in parts that are found twice or more in a batch of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                parts.update(between_spaces(text))
            counts: Counter = Counter()
            for part, places in parts.items():
                if places > 1:
                    for word in segments(part):
                        counts[word] += places
            words, places = list(counts), list(counts.values())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(places, pa.int64())], ["word", "places"])

    return texts.mapInArrow(count, "word string, places bigint").groupBy("word").agg(F.sum("places").alias("places"))


def dictionary(docs: DataFrame, model: PieceModel, text_column: str = "text") -> DataFrame:
    """(word, ids) of the most frequent segments, ``FREQUENT`` at most."""
    counted = stored(segment_counts(docs.select(F.col(f"`{text_column}`"))), "segments")
    often = counted.where(F.col("places") >= _frequent_from(counted)).select("word")
    return stored(encode_words(often.repartition("word"), model), "dictionary")


def _frequent_from(known: DataFrame) -> int:
    """The least number of places such that at most ``FREQUENT`` words have it."""
    steps = F.floor(F.log2("places") * 4).cast("int")
    rows = known.groupBy(steps.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("places").alias("least")).collect()
    total, least = 0, 1 << 62
    for row in sorted(rows, key=lambda row: -row["step"]):  # four rows per doubling
        total += row["words"]
        if total > FREQUENT:
            break
        least = row["least"]
    return least


# By ``start << 6 | stop``: the bits of an edge's two cuts, and of the cuts within it.
_ENDS = [1 << start | 1 << stop for start in range(64) for stop in range(64)]
_INNER = [max(0, (1 << stop) - (2 << start)) for start in range(64) for stop in range(64)]


class Encodings(dict):
    """(ids as 32-bit numbers, decoded bytes, whether these are the segment's own) per segment.

    Segments of the dictionary have their ids from it. Others go through the same
    lattice and fold when they are met, and are remembered up to a limit.
    """

    def __init__(self, known: pd.DataFrame, model: PieceModel) -> None:
        super().__init__()
        self.scores = {piece: (number, score) for piece, number, score in model.pieces}
        self.byte_ids = model.byte_ids
        # Finds all pieces in a segment, the edges of its lattice. A value is the piece's place in the order of scores,
        # and what makes, with 65 times the place of its last character, ``start << 6 | stop``.
        ranks = {score: rank for rank, score in enumerate(sorted({score for _, _, score in model.pieces}, reverse=True))}
        self.edges = ahocorasick.Automaton()
        for piece, _, score in model.pieces:
            if len(piece) > 1:
                self.edges.add_word(piece, (ranks[score] << 12) + 65 - (len(piece) << 6))
        self.edges.make_automaton()
        self.numbers = {piece: number for piece, number, _ in model.pieces}
        self.most = 0 if model.late else MASK_CHARS
        self.raw = {number: bytes.fromhex(digits) for number, digits in model.hex}
        self.frequent = {word: list(ids) for word, ids in zip(known["word"], known["ids"], strict=True)}

    def __missing__(self, word: str) -> tuple[bytes, bytes, bool]:
        if len(self) > REMEMBERED:
            self.clear()
        ids = self.frequent.get(word)
        if ids is None:
            ids = self._folded(word) if len(word) <= self.most else merged(word, self.scores, self.byte_ids)
        decoded = b"".join([self.raw[number] for number in ids])
        # Bytes are small, and the garbage collector does not go through them.
        found = self[word] = (array("i", ids).tobytes(), decoded, decoded == word.encode())
        return found

    def _folded(self, word: str) -> list[int]:
        """What ``lattice`` and ``fold`` do, for one segment."""
        edges = sorted([value + 65 * last for last, value in self.edges.iter(word)])
        cuts = (1 << len(word) + 1) - 1
        for edge in edges:
            span = edge & 4095
            cut = cuts & _INNER[span]
            # One cut is left between two pieces that both stand.
            if cut and not cut & cut - 1:
                ends = _ENDS[span]
                if cuts & ends == ends:
                    cuts ^= cut
        get, ids, start = self.numbers.get, [], 0
        cuts >>= 1
        while cuts:
            stop = start + (cuts & -cuts).bit_length()
            piece = word[start:stop]
            found = get(piece)
            if found is None:
                ids += map(self.byte_ids.__getitem__, piece.encode())
            else:
                ids.append(found)
            cuts >>= stop - start
            start = stop
        return ids


@dataclass(frozen=True)
class Encoded:
    """Texts side by side: where their segments and ids end, and what these are."""

    segments: np.ndarray  # texts + 1 places
    ends: np.ndarray  # segments + 1 places among the ids
    ids: np.ndarray
    whole: np.ndarray  # per segment
    decoded: list[str]


def _runs(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of ``values``, one after the other."""
    stops = np.cumsum(sizes)
    return values[np.repeat(begins - (stops - sizes), sizes) + np.arange(int(sizes.sum()))]


def _places(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def encoded_texts(texts: list[str | None], encodings: Encodings) -> Encoded:
    split = [between_spaces(text) for text in texts]
    borders = _places(np.fromiter(map(len, split), np.int64, len(split)))
    coded = pa.array(itertools.chain.from_iterable(split), pa.string()).dictionary_encode()
    at = coded.indices.to_numpy()
    words = [segments(part) for part in coded.dictionary.to_pylist()]
    count = np.fromiter(map(len, words), np.int64, len(words))
    found = list(map(encodings.__getitem__, itertools.chain.from_iterable(words)))
    numbers, bytes_of, own = zip(*found) if found else ((), (), ())
    sizes = np.fromiter(map(len, numbers), np.int64, len(found)) // 4
    whole = np.fromiter(own, bool, len(found))
    ends = _places(sizes)
    ids = np.frombuffer(b"".join(numbers), np.int32)
    stops = _places(count)
    begins, length = ends[stops[:-1]], np.diff(ends[stops])
    first = stops[:-1][at]
    raw = [b"".join(bytes_of[start:stop]) for start, stop in itertools.pairwise(stops.tolist())]
    places = at.tolist()
    joined = (b"".join(map(raw.__getitem__, places[start:stop])) for start, stop in itertools.pairwise(borders.tolist()))
    return Encoded(
        _places(count[at])[borders],
        _places(_runs(sizes, first, count[at])),
        _runs(ids, begins[at], length[at]),
        _runs(whole, first, count[at]),
        # The sign that stands before every text is not part of it.
        [text.decode("utf-8", "replace").replace(SPACE, " ")[1:] for text in joined],
    )


def _hashed(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """XXH64 of 32-bit integers, as SQL's ``xxhash64`` has it."""
    out = seeds + np.uint64(0x27D4EB2F165667C5 + 4)
    out ^= values.astype(np.uint32).astype(np.uint64) * np.uint64(0x9E3779B185EBCA87)
    out = (out << np.uint64(23) | out >> np.uint64(41)) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)
    out = (out ^ out >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F)
    out = (out ^ out >> np.uint64(29)) * np.uint64(0x165667B19E3779F9)
    return out ^ out >> np.uint64(32)


def _place_hashes(found: Encoded) -> np.ndarray:
    """31 bits of ``xxhash64(position, ids)`` for each segment."""
    counts, sizes = np.diff(found.segments), np.diff(found.ends)
    position = np.arange(len(sizes)) - np.repeat(found.segments[:-1], counts)
    out = _hashed(position, np.full(len(sizes), 42, np.uint64))
    active = np.arange(len(sizes))
    for number in range(int(sizes.max(initial=0))):
        active = active[sizes[active] > number]
        out[active] = _hashed(found.ids[found.ends[active] + number], out[active])
    return (out & np.uint64((1 << 31) - 1)).astype(np.int64)


def _encoded_rows(docs: DataFrame, model: PieceModel, id_column: str, text_column: str, columns, schema: str) -> DataFrame:
    """(doc_id, text_hash, ...): ``columns`` makes rows of a batch's keys and its encoded texts.

    Rows stay where they are: no segment is shuffled.
    """
    text = F.col(f"`{text_column}`")
    known, at_once = dictionary(docs, model, text_column).toPandas(), ROWS_AT_ONCE  # FREQUENT rows at most
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), text_hash(text).alias("text_hash"), text.alias("text"))
    out = StructType([*rows.schema.fields[:2], *StructType.fromDDL(schema).fields])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        encodings = Encodings(known, model)
        # The model and the dictionary stay until the task ends: the collector need not go through them again.
        gc.collect()
        gc.freeze()
        try:
            for batch in batches:
                for first in range(0, batch.num_rows, at_once):
                    part = batch.slice(first, at_once)
                    yield pa.RecordBatch.from_arrays(columns(part, encoded_texts(part.column(2).to_pylist(), encodings)), out.names)
        finally:
            gc.unfreeze()

    return rows.mapInArrow(encode, out)


def encode_documents(docs: DataFrame, model: PieceModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text_hash, position, ids, whole): one row per segment of every text."""

    def columns(batch: pa.RecordBatch, found: Encoded) -> list[pa.Array]:
        rows = np.repeat(np.arange(batch.num_rows), np.diff(found.segments))
        position = np.arange(len(rows)) - found.segments[rows]
        keys = [batch.column(at).take(pa.array(rows)) for at in (0, 1)]
        return [*keys, pa.array(position, pa.int32()), pa.ListArray.from_arrays(found.ends, found.ids), pa.array(found.whole)]

    return _encoded_rows(docs, model, id_column, text_column, columns, "position int, ids array<int>, whole boolean")


def encoded_digest(docs: DataFrame, model: PieceModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_segments, n_tokens, ids_sum, round_trip, ids, decoded_sha256, same_text``.

    ``ids_sum`` adds up a hash of position and ids per segment, so it depends on
    every id and its place. ``round_trip`` says that each segment's ids give the
    segment back, as it was encoded. ``ids`` has the document's ids in order,
    ``decoded_sha256`` the digest of the text that they decode to, and
    ``same_text`` says whether that is the document's own: not so if it has a U+2581.
    """

    def columns(batch: pa.RecordBatch, found: Encoded) -> list[pa.Array]:
        def total(values: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[found.segments])

        tokens = found.ends[found.segments]
        digests = [hashlib.sha256(text.encode()).hexdigest() for text in found.decoded]
        same = [text == (own or "") for text, own in zip(found.decoded, batch.column(2).to_pylist(), strict=True)]
        return [
            batch.column(0),
            batch.column(1),
            pa.array(np.diff(found.segments).astype(np.int64)),
            pa.array(np.diff(tokens).astype(np.int64)),
            pa.array(total(_place_hashes(found))),
            pa.array(total(~found.whole) == 0),
            pa.ListArray.from_arrays(tokens, found.ids),
            pa.array(digests, pa.string()),
            pa.array(same, pa.bool_()),
        ]

    schema = "n_segments bigint, n_tokens bigint, ids_sum bigint, round_trip boolean, ids array<int>, decoded_sha256 string, same_text boolean"
    return _encoded_rows(docs, model, id_column, text_column, columns, schema).drop("text_hash")
