"""Removal of passages that repeat, within a document or across documents.

A window is a run of consecutive words. Every word covered by a window whose
word sequence also starts elsewhere is removed.

Documents are dealt to shards of bounded text size; the texts are shuffled once.

1. Anchors. Of the short phrases in a window, that with the smallest hash, the
   first of several, is its anchor. Equal windows have equal anchors at the same
   place, and neighbouring windows mostly share theirs, so there are few. A
   window holds the ``context`` words that begin with its anchor, or those that
   end with it. These runs are counted by hash.
2. Passages. Windows whose run recurs are counted by hash, beside the phrases
   that anchor them; those found twice or more are confirmed. Short phrases recur
   by chance, and all the more in larger inputs. Runs of half a window mostly
   recur only with the passage, so few other windows are counted.
3. Automata. Each shard gets the confirmed windows of its own documents and the
   recurring phrases that anchor them, and compiles an Aho-Corasick automaton of
   the phrases; all its documents are streamed through it. Around each occurrence
   the windows are compared with the confirmed ones and their words marked.

What is counted goes from shards to buckets of hashes and back. Both grow in
number with the input, and a value is in a shard's part of a bucket once,
however often the shard has it. Windows are told apart by 64-bit hashes.

Words are runs without white space, unchanged. A null or empty text has no
words. Rows equal in id and text are separate documents, whose windows are each
other's copies; null ids are kept as they are. Columns other than id and text
are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscale.llm.words import WordHashes, sliding, window_hashes, words_of

WINDOW = 35
PHRASE = 5
SHARD_BYTES = 12 << 20
CHUNK_WORDS = 1 << 17  # words of a shard's documents looked at together

FOUND = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:int,stop:int>>, kept_text string"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

# A shard's part of a bucket: distinct hashes, and whether the shard has each more than once. For windows, they
# are in the order of the phrases that anchor them, ``sizes`` says how many each phrase has.
PART = "bucket int, shard int, hashes binary, more binary, phrases array<string>, sizes binary"
PART_FIELDS = pa.schema(
    [("bucket", pa.int32()), ("shard", pa.int32()), ("hashes", pa.binary()), ("more", pa.binary())]
    + [("phrases", pa.list_(pa.string())), ("sizes", pa.binary())]
)
RECURRING = "shard int, hashes binary, phrases array<string>"
RECURRING_FIELDS = pa.schema([("shard", pa.int32()), ("hashes", pa.binary()), ("phrases", pa.list_(pa.string()))])

_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
_ENDS = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Chunk:
    """Some documents side by side: their words, and where each begins among them."""

    rows: range
    words: list[str]
    begins: np.ndarray  # documents + 1

    def starts(self, window: int) -> np.ndarray:
        """Where windows start that lie within a document."""
        sizes = np.maximum(np.diff(self.begins) - window + 1, 0)
        stops = np.cumsum(sizes)
        return np.repeat(self.begins[:-1] - (stops - sizes), sizes) + np.arange(int(stops[-1]) if len(stops) else 0)


def chunks(texts: pa.ChunkedArray) -> Iterator[Chunk]:
    words, sizes, first = [], [0], 0
    for row, text in enumerate(texts):
        words += words_of(text.as_py())
        sizes.append(len(words))
        if len(words) >= CHUNK_WORDS:
            yield Chunk(range(first, row + 1), words, np.array(sizes, np.int64))
            words, sizes, first = [], [0], row + 1
    if len(sizes) > 1:
        yield Chunk(range(first, first + len(sizes) - 1), words, np.array(sizes, np.int64))


def anchor_places(phrases: np.ndarray, span: int) -> np.ndarray:
    """Where the anchor of each window is. Half of a hash says which is smallest, so that the place fits in beside it."""
    keys = (phrases & _HIGH) | np.arange(len(phrases), dtype=np.uint64)
    return (sliding(keys, span, np.minimum) & _LOW).astype(np.int64)


def anchored_runs(values: np.ndarray, starts: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows that start so, in documents of these word hashes: place and hash of the anchor, hash of the run it begins or ends."""
    phrases, context = window_hashes(values, phrase), (window + phrase) // 2
    anchors, runs = anchor_places(phrases, window - phrase + 1)[starts], window_hashes(values, context)
    begins = anchors - starts <= window - context
    found = runs[np.where(begins, anchors, anchors + phrase - context)]
    return anchors, phrases[anchors], np.where(begins, found, found ^ _ENDS)


def _bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """The distinct hashes of a column of parts, in order."""
    return np.unique(np.frombuffer(b"".join(column.to_pylist()), np.uint64))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _cuts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([[0], np.nonzero(values[1:] != values[:-1])[0] + 1, [len(values)]])


def counted_runs(shard: int, texts: pa.Table, buckets: int, window: int, phrase: int) -> pa.Table:
    """The runs around the anchors of a shard, by bucket."""
    hashes, parts = WordHashes(), []
    for chunk in chunks(texts["text"]):
        starts = chunk.starts(window)
        if not len(starts):
            continue
        anchors, _, runs = anchored_runs(hashes.array(chunk.words), starts, window, phrase)
        # A run is counted once for each place, however many windows hold it. Neighbours share a place.
        changed = np.concatenate([[True], (runs[1:] != runs[:-1]) | (anchors[1:] != anchors[:-1])])
        parts.append(runs[changed])
    if not parts:
        return PART_FIELDS.empty_table()
    found, places = np.unique(np.concatenate(parts), return_counts=True)
    bucket = (found % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    found, more, bucket = found[order], (places[order] > 1).astype(np.uint8), bucket[order]
    cuts = list(itertools.pairwise(_cuts(bucket).tolist()))
    rows = [(int(bucket[at]), shard, _bytes(found[at:end]), _bytes(more[at:end]), [], b"") for at, end in cuts]
    return pa.Table.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), PART_FIELDS)], schema=PART_FIELDS)


def counted_windows(shard: int, texts: pa.Table, recurring: pa.Table, buckets: int, window: int, phrase: int) -> pa.Table:
    """The windows of a shard whose runs recur, by bucket of their anchors."""
    hashes, known = WordHashes(), _numbers(recurring["hashes"])
    windows, anchored, named = [], [], {}
    for chunk in chunks(texts["text"]) if len(known) else ():
        starts = chunk.starts(window)
        if not len(starts):
            continue
        values = hashes.array(chunk.words)
        anchors, phrases, runs = anchored_runs(values, starts, window, phrase)
        wanted = _among(runs, known)
        anchors, phrases = anchors[wanted], phrases[wanted]
        windows.append(window_hashes(values, window)[starts[wanted]])
        anchored.append(phrases)
        for value, at in zip(*(part.tolist() for part in np.unique(phrases, return_index=True)), strict=True):
            if value not in named:
                place = int(anchors[at])
                named[value] = " ".join(chunk.words[place : place + phrase])
    if not named:
        return PART_FIELDS.empty_table()
    found, first, places = np.unique(np.concatenate(windows), return_index=True, return_counts=True)
    phrases = np.concatenate(anchored)[first]
    bucket = phrases % np.uint64(buckets)
    order = np.lexsort((phrases, bucket))
    found, more, phrases, bucket = found[order], (places[order] > 1).astype(np.uint8), phrases[order], bucket[order]
    starts = _cuts(phrases)
    rows = []
    for at, end in itertools.pairwise(_cuts(bucket).tolist()):
        mine = starts[np.searchsorted(starts, at) : np.searchsorted(starts, end) + 1]
        texts_of = [named[value] for value in phrases[mine[:-1]].tolist()]
        rows.append((int(bucket[at]), shard, _bytes(found[at:end]), _bytes(more[at:end]), texts_of, _bytes(np.diff(mine).astype(np.int32))))
    return pa.Table.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), PART_FIELDS)], schema=PART_FIELDS)


def recurring_parts(parts: pa.Table) -> pa.Table:
    """Of a bucket, per shard the hashes that have two places or more, wherever they are, and their phrases."""
    hashes = [np.frombuffer(part, np.uint64) for part in parts["hashes"].to_pylist()]
    more = [np.frombuffer(part, np.uint8) for part in parts["more"].to_pylist()]
    found, at, places = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    several = places > 1
    several[at[np.concatenate(more) > 0]] = True
    kept, rows = several[at], []
    ends = np.cumsum([len(part) for part in hashes])
    for number, (end, own) in enumerate(zip(ends.tolist(), hashes, strict=True)):
        mine = kept[end - len(own) : end]
        if not mine.any():
            continue
        sizes = np.frombuffer(parts["sizes"][number].as_py(), np.int32)
        phrases = []
        if len(sizes):
            some = np.add.reduceat(mine.astype(np.int64), np.cumsum(sizes) - sizes) > 0
            phrases = list(itertools.compress(parts["phrases"][number].as_py(), some.tolist()))
        rows.append((parts["shard"][number].as_py(), _bytes(own[mine]), phrases))
    if not rows:
        return RECURRING_FIELDS.empty_table()
    return pa.Table.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), RECURRING_FIELDS)], schema=RECURRING_FIELDS)


def _covered(chunk: Chunk, automaton, confirmed: np.ndarray, hashes: WordHashes, window: int, phrase: int) -> np.ndarray:
    """Which words stand in a confirmed window around an occurrence of a phrase."""
    words, starts = chunk.words, chunk.starts(window)
    if not len(starts) or automaton is None:
        return np.zeros(len(words), bool)
    # Two spaces between documents, which no phrase has.
    parts = [f" {' '.join(words[at:end])} " for at, end in itertools.pairwise(chunk.begins.tolist()) if end > at]
    # Where the space before each word is: there a phrase found in the text begins.
    spaces = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    spaces = np.concatenate([[0], spaces[:-1]])
    filled = chunk.begins[:-1][np.diff(chunk.begins) > 0]
    further = np.zeros(len(words), np.int64)
    further[filled[1:]] = 1
    spaces += np.cumsum(further)
    begins = np.fromiter((last - size + 1 for last, size in automaton.iter("".join(parts))), np.int64)
    at = np.unique(np.searchsorted(spaces, begins))
    # Occurrences in the window that starts at each place: phrases that begin in its first window - phrase + 1 words.
    near = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(words)))])
    starts = starts[near[starts + window - phrase + 1] > near[starts]]
    found = window_hashes(hashes.array(words), window)[starts]
    starts = starts[_among(found, confirmed)]
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return np.cumsum(edges)[:-1] > 0


def _spans(covered: np.ndarray) -> list[dict]:
    edges = np.nonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))[0]
    return [{"start": start, "stop": stop} for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def without_repeats(texts: pa.Table, known: pa.Table, window: int, phrase: int) -> pa.Table:
    """A shard's documents, streamed through the automaton of its recurring phrases."""
    hashes, automaton = WordHashes(), None
    wanted = set(itertools.chain.from_iterable(known["phrases"].to_pylist()))
    if wanted:
        automaton = ahocorasick.Automaton()
        for value in wanted:
            automaton.add_word(f" {value} ", len(value) + 2)
        automaton.make_automaton()
    confirmed = _numbers(known["hashes"])
    counts, removed, spans, kept_texts = [], [], [], []
    for chunk in chunks(texts["text"]):
        gone = _covered(chunk, automaton, confirmed, hashes, window, phrase)
        for at, end in itertools.pairwise(chunk.begins.tolist()):
            words, mine = chunk.words[at:end], gone[at:end]
            lost = int(mine.sum())
            counts.append(end - at)
            removed.append(lost)
            spans.append(_spans(mine) if lost else [])
            kept_texts.append(" ".join(itertools.compress(words, (~mine).tolist()) if lost else words))
    columns = [texts["doc_id"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, SPANS), pa.array(kept_texts, pa.string())]
    return pa.Table.from_arrays(columns, ["doc_id", "n_words", "n_removed", "spans", "kept_text"])


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, spans, kept_text``; spans are word ranges removed."""
    plain = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    # All steps read the same columns by the same key, so Spark shuffles the texts once.
    dealt = plain.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int")).groupBy("shard")

    def runs(key: tuple, texts: pa.Table) -> pa.Table:
        np.seterr(over="ignore")
        return counted_runs(key[0].as_py(), texts, shards, window, phrase)

    def windows(key: tuple, texts: pa.Table, recurring: pa.Table) -> pa.Table:
        np.seterr(over="ignore")
        return counted_windows(key[0].as_py(), texts, recurring, shards, window, phrase)

    def locate(texts: pa.Table, known: pa.Table) -> pa.Table:
        np.seterr(over="ignore")
        return without_repeats(texts, known, window, phrase)

    recurring = dealt.applyInArrow(runs, PART).groupBy("bucket").applyInArrow(recurring_parts, RECURRING)
    counted = dealt.cogroup(recurring.groupBy("shard")).applyInArrow(windows, PART)
    confirmed = counted.groupBy("bucket").applyInArrow(recurring_parts, RECURRING)
    return dealt.cogroup(confirmed.groupBy("shard")).applyInArrow(locate, FOUND)


def repeats_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
