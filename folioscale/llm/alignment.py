"""Aligning the tokens of two tokenizers over the same text.

Both tokenizers encode the whole text; every token stands for a run of the
text's bytes. Where a token of each ends at the same byte, they are linked, and
such places cut the tokens into groups.

Most shared ends stand before a word: there the next token of both begins with
a space mark. These are the anchors. Once the joined bytes of both sides are
verified to be those of the text, anchors split a document into windows of
token ids, and the alignment within a window depends on its ids alone. So it
is worked out once per pair of id tuples and remembered.

The corpus-wide count of a linked pair of ids comes from the stored counts per
document. Two tokens end together only if the bytes of one are an ending of
the other's, so the number of pairs is bounded by the vocabularies
(``most_pairs``), not by the corpus. The table of pairs is refused beyond that
bound, and is small enough to go to every task.

A text that is null, empty, or whose tokens do not give back its bytes (one
with a U+2581, for example) has no tokens: counts are 0 and the hash is ''.
Rows with repeated or null ids get a row each. Very long texts are encoded one
at a time. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscale.llm.common import stored

#: Windows, and parts between spaces, that a task remembers; each memory is
#: emptied when it has grown larger.
REMEMBERED = 200_000
#: Characters that are encoded together.
BATCH_CHARS = 1 << 18
#: Rows that are aligned and passed on together.
ROWS_PER_BATCH = 1024
SPACE = "▁"
_CUT = re.compile(r"(?<=\S)(?= \S)")
# Fixed value: how a byte-level vocabulary of this kind splits a text before merging.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_INNER_SPACE = re.compile(f"[^{SPACE}]{SPACE}")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable
    Latin-1 characters for themselves, the other bytes from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in printable]
    return {chr(byte): byte for byte in printable} | {chr(256 + n): byte for n, byte in enumerate(others)}


def merges_by_rank(bpe: str) -> bool:
    """Whether merging whichever neighbours form the token with the lowest id
    does what the merge list of a vocabulary says: ids ascend with the list, and
    merging a token's bytes by lower ids only leaves the pair that the list names."""
    model = json.loads(bpe)["model"]
    signs = byte_alphabet()
    ranks = {bytes(map(signs.__getitem__, token)): number for token, number in model["vocab"].items() if all(map(signs.__contains__, token))}
    last = 0
    for merge in model["merges"]:
        pair = [bytes(map(signs.__getitem__, side)) for side in (merge.split(" ") if isinstance(merge, str) else merge)]
        own = ranks[pair[0] + pair[1]]
        if own <= last:
            return False
        last, parts = own, [bytes([byte]) for byte in pair[0] + pair[1]]
        while len(parts) > 2:
            rank, at = min((ranks.get(parts[n] + parts[n + 1], own), n) for n in range(len(parts) - 1))
            if rank >= own:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if parts != pair:
            return False
    return True


class Tokenizers:
    """A byte-level BPE vocabulary (A) and a SentencePiece model (B), by their
    content: it travels to the tasks, the files need not exist there."""

    def __init__(self, bpe_path: str, piece_path: str) -> None:
        self.bpe = Path(bpe_path).read_text(encoding="utf-8")
        self.model = Path(piece_path).read_bytes()

        self.by_rank = merges_by_rank(self.bpe)

    def load(self) -> tuple[tokenizers.Tokenizer, sentencepiece.SentencePieceProcessor]:
        bpe = tokenizers.Tokenizer.from_str(self.bpe)
        bpe.encode_special_tokens = True
        return bpe, sentencepiece.SentencePieceProcessor(model_proto=self.model)

    def token_bytes(self) -> tuple[list[bytes], list[bytes]]:
        """The bytes of each id, of A and of B."""
        signs = byte_alphabet()
        vocabulary = json.loads(self.bpe)["model"]["vocab"]
        a = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            a[number] = bytes(signs[sign] for sign in token) if all(sign in signs for sign in token) else token.encode()
        pieces = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        b = []
        for number in range(pieces.get_piece_size()):
            piece = pieces.id_to_piece(number)
            b.append(bytes([int(piece[3:5], 16)]) if pieces.is_byte(number) else piece.replace(SPACE, " ").encode())
        return a, b

    def most_pairs(self) -> int:
        """How many pairs of ids can ever be linked: one's bytes end the other's."""
        a, b = self.token_bytes()

        def endings(longer: list[bytes], shorter: list[bytes], proper: int) -> int:
            known: dict[bytes, int] = {}
            for token in shorter:
                known[token] = known.get(token, 0) + 1
            return sum(known.get(token[start:], 0) for token in longer for start in range(proper, len(token)))

        return endings(a, b, 0) + endings(b, a, 1)


class Aligner:
    """Aligns whole documents, window by window; one per task."""

    def __init__(self, source: Tokenizers, remembered: int = REMEMBERED) -> None:
        self.bpe, self.pieces = source.load()
        self.a_bytes, self.b_bytes = source.token_bytes()
        self.a_sizes = np.array([len(token) for token in self.a_bytes])
        self.b_sizes = np.array([len(token) for token in self.b_bytes])
        self.b_counts = self.b_sizes.tolist()
        self.a_spaced = np.array([token.startswith(b" ") for token in self.a_bytes])
        self.b_spaced = np.array([token.startswith(b" ") for token in self.b_bytes])
        self.remembered = remembered
        #: A link is one number, ``a * width + b``.
        self.width = len(self.b_bytes)
        #: An id with the sign that follows it: within a side, after A's side, after a group, at the end.
        most = max(len(self.a_bytes), self.width)
        self.signed = [f"{number}{sign}" for sign in (",", "|", ";", "") for number in range(most)]
        self.most = most
        #: Groups as text and packed links, by a window's id tuples, packed: A ids, -1, B ids.
        self.known: dict[bytes, tuple[str, bytes]] = {}
        #: The ids of both sides, packed, by part of a text, and whether both stand for its bytes.
        self.parts: dict[str, tuple[bytes, bytes, bool]] = {}
        #: The same vocabulary in a faster encoder, for parts it is sure to split in the same way.
        self.quick = None
        if source.by_rank:
            ranks = {token: number for number, token in enumerate(self.a_bytes) if token}
            self.quick = tiktoken.Encoding("a", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        names = map(self.pieces.id_to_piece, range(self.width))
        self.whole_only = any(_INNER_SPACE.search(name) for name in names)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """All tokens of each text, A's and B's, and whether the joined bytes of
        both are those of the text. A's own splitting always ends before a space
        that stands between two other signs, and no piece of B goes on across
        one (else texts are encoded whole), so what lies between such places is
        encoded and verified once, and remembered."""
        cut = [[f" {text}"] if self.whole_only else _CUT.split(f" {text}") for text in texts]
        if len(self.parts) >= self.remembered:
            self.parts.clear()
        self._encode_parts(list({part for parts in cut for part in parts} - self.parts.keys()))
        result = []
        for parts in cut:
            a, b, verified = zip(*map(self.parts.__getitem__, parts))
            result.append((np.frombuffer(b"".join(a), np.int32), np.frombuffer(b"".join(b), np.int32), all(verified)))
        return result

    def _encode_parts(self, parts: list[str]) -> None:
        if not parts:
            return
        sizes = [len(part.encode()) for part in parts]
        own = "".join(parts).encode()
        in_b = self.pieces.encode([part[1:] for part in parts], num_threads=1)
        b_ids = np.fromiter(chain.from_iterable(in_b), np.int32)
        b_packed = _cut(b_ids, np.cumsum([len(ids) for ids in in_b]))
        a_packed = self._a_parts(parts, sizes)
        # All bytes at once; only if they differ, part by part.
        joined = b"".join(map(self.b_bytes.__getitem__, b_ids.tolist()))
        right = joined == own and all(map(int.__eq__, sizes, map(self._b_size, in_b)))
        a_ids = np.frombuffer(b"".join(a_packed), np.int32).tolist()
        right = right and b"".join(map(self.a_bytes.__getitem__, a_ids)) == own
        verified = repeat(True) if right else map(self._verified, parts, a_packed, b_packed)
        self.parts.update(zip(parts, zip(a_packed, b_packed, verified)))

    def _b_size(self, ids: list[int]) -> int:
        return sum(map(self.b_counts.__getitem__, ids))

    def _verified(self, part: str, a: bytes, b: bytes) -> bool:
        sides = ((self.a_bytes, a), (self.b_bytes, b))
        return all(b"".join([known[n] for n in array("i", ids)]) == part.encode() for known, ids in sides)

    def _a_parts(self, parts: list[str], sizes: list[int]) -> list[bytes]:
        """A's ids of each part. Plain parts are encoded in one go and cut where
        they end, the others one by one by the vocabulary's own library."""
        found: list[bytes | None] = [None] * len(parts)
        plain = [n for n, part in enumerate(parts) if self.quick and _is_plain(part)]
        ids = np.array(self.quick.encode_ordinary("".join([parts[n] for n in plain])) if plain else [], np.int32)
        stops = np.searchsorted(self.a_sizes[ids].cumsum(), np.cumsum([sizes[n] for n in plain])) + 1
        for n, packed in zip(plain, _cut(ids, stops)):
            found[n] = packed
        others = [n for n, ids in enumerate(found) if ids is None]
        for n, one in zip(others, self.bpe.encode_batch_fast([parts[n] for n in others], add_special_tokens=False)):
            found[n] = array("i", one.ids).tobytes()
        return found

    def documents(self, tokens: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[str, np.ndarray]]:
        """Groups as text and links of each document, from its verified tokens."""
        if len(self.known) >= self.remembered:
            self.known.clear()
        keys = [self._windows(a, b) for a, b in tokens]
        self._align(list({key for windows in keys for key in windows} - self.known.keys()))
        result = []
        for windows in keys:
            texts, links = zip(*map(self.known.__getitem__, windows))
            result.append((";".join(texts), np.frombuffer(b"".join(links), np.int64)))
        return result

    def _windows(self, a_ids: np.ndarray, b_ids: np.ndarray) -> list[bytes]:
        """The packed id tuples of a document's windows. A window ends at a byte
        where a token of each side ends and the next of each begins with a space mark."""
        a_cut = np.flatnonzero(self.a_spaced[a_ids[1:]]) + 1
        b_cut = np.flatnonzero(self.b_spaced[b_ids[1:]]) + 1
        a_ends, b_ends = self.a_sizes[a_ids].cumsum()[a_cut - 1], self.b_sizes[b_ids].cumsum()[b_cut - 1]
        _, a_at, b_at = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        a_stops, b_stops = np.append(a_cut[a_at], len(a_ids)), np.append(b_cut[b_at], len(b_ids))
        laid = _side_by_side(a_ids, b_ids, a_stops, b_stops, gap=1)
        return _cut(laid, a_stops + b_stops + np.arange(1, len(a_stops) + 1))

    def _align(self, windows: list[bytes]) -> None:
        """Work out windows that are not known yet, all together: each ends with
        both sides, so one after the other they are like one long text."""
        if not windows:
            return
        laid = np.frombuffer(b"".join(windows), np.int32)
        stops = np.cumsum([len(window) // 4 for window in windows])
        gaps = np.flatnonzero(laid == -1)
        starts = np.append(0, stops[:-1])
        in_a = np.zeros(len(laid) + 1, np.int64)
        np.add.at(in_a, starts, 1)
        np.add.at(in_a, gaps, -1)
        in_a = in_a.cumsum()[:-1] > 0
        in_b = ~in_a
        in_b[gaps] = False
        a_ids, b_ids = laid[in_a], laid[in_b]
        a_stops, b_stops = (gaps - starts).cumsum(), (stops - gaps - 1).cumsum()
        a_ends, b_ends = self.a_sizes[a_ids].cumsum(), self.b_sizes[b_ids].cumsum()
        shared, a_at, b_at = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        links = a_ids[a_at].astype(np.int64) * self.width + b_ids[b_at]
        # What follows each id: a comma, but a bar at the end of A's side of a group, a semicolon
        # at that of B's, and nothing at the end of a window.
        a_named, b_named = a_ids.copy(), b_ids.copy()
        a_named[a_at] += self.most
        b_named[b_at] += 2 * self.most
        b_named[b_stops - 1] += self.most
        named = _side_by_side(a_named, b_named, a_at + 1, b_at + 1)
        texts = list(map(self.signed.__getitem__, named.tolist()))
        edges = [0, *(a_stops + b_stops).tolist()]
        packed = _cut(links, np.searchsorted(shared, a_ends[a_stops - 1]) + 1)
        joined = ["".join(texts[start:stop]) for start, stop in zip(edges, edges[1:])]
        self.known.update(zip(windows, zip(joined, packed)))


def _cut(values: np.ndarray, stops: np.ndarray) -> list[bytes]:
    """The bytes of the values up to each stop."""
    packed = values.tobytes()
    edges = [0, *(values.itemsize * stops).tolist()]
    return [packed[start:stop] for start, stop in zip(edges, edges[1:])]


def _side_by_side(a: np.ndarray, b: np.ndarray, a_stops: np.ndarray, b_stops: np.ndarray, gap: int = 0) -> np.ndarray:
    """Of each stretch the values of ``a`` and those of ``b``, with a gap of -1 between."""
    number = np.arange(len(a_stops)) * gap
    a_starts, b_starts = np.append(0, a_stops[:-1]), np.append(0, b_stops[:-1])
    laid = np.full(len(a) + len(b) + gap * len(a_stops), -1, np.int32)
    laid[np.arange(len(a)) + np.repeat(b_starts + number, a_stops - a_starts)] = a
    laid[np.arange(len(b)) + np.repeat(a_stops + number + gap, b_stops - b_starts)] = b
    return laid


_FACTS = [
    ("n_a", pa.int64(), "bigint"),
    ("n_b", pa.int64(), "bigint"),
    ("n_groups", pa.int64(), "bigint"),
    ("n_links", pa.int64(), "bigint"),
    ("links", pa.list_(pa.int64()), "array<bigint>"),
    ("times", pa.list_(pa.int32()), "array<int>"),
    ("groups_sha256", pa.string(), "string"),
]


def _is_plain(part: str) -> bool:
    """Printable Latin letters, digits and signs and no space at the end: what
    any version of the character tables classes alike, so that the part is split
    alike, alone and among others."""
    return len(part) < 1000 and part.isprintable() and (part.isascii() or max(part) < "\u0250") and part[-1] != " "


def _batches(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def align_documents(docs: DataFrame, source: Tokenizers, keep_groups: bool = False) -> DataFrame:
    """Per row: ``doc_id``, token, group and link counts, the distinct ``links``
    (``a * pieces + b``) with how many ``times`` each stands in the text, and the
    hash of the groups; with ``keep_groups`` the groups themselves, too."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(source)  # two vocabulary files
    facts = _FACTS + ([("groups", pa.large_string(), "string")] if keep_groups else [])
    none = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "links": [], "times": [], "groups_sha256": "", "groups": ""}

    def facts_of(a: np.ndarray, b: np.ndarray, groups: str, links: np.ndarray) -> dict:
        distinct, times = np.unique(links, return_counts=True)
        return {
            "n_a": len(a),
            "n_b": len(b),
            "n_groups": len(links),  # each group ends with its link
            "n_links": len(links),
            "links": distinct,
            "times": times.astype(np.int32),
            "groups_sha256": hashlib.sha256(groups.encode()).hexdigest(),
            "groups": groups,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(sent.value)
        # No cycles are made here, and the collector would look through all that is remembered.
        gc.disable()
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS_PER_BATCH):
                    yield part_of(aligner, batch.slice(start, ROWS_PER_BATCH))
        finally:
            gc.enable()

    def part_of(aligner: Aligner, batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("text").dictionary_encode()  # equal texts are aligned once
        rows = []
        for texts in _batches(column.dictionary.to_pylist()):
            tokens = aligner.encode(texts)
            fit = [(a, b) for text, (a, b, verified) in zip(texts, tokens) if text and verified]
            aligned = iter([facts_of(*sides, *found) for sides, found in zip(fit, aligner.documents(fit))])
            rows += [next(aligned) if text and verified else none for text, (_, _, verified) in zip(texts, tokens)]
        rows.append(none)
        at = pc.fill_null(column.indices, len(rows) - 1)
        columns = [pa.array([row[name] for row in rows], kind).take(at) for name, kind, _ in facts]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id"] + [name for name, _, _ in facts])

    rows = docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text"))
    ddl = [f"doc_id {rows.schema['doc_id'].dataType.simpleString()}"] + [f"{name} {kind}" for name, _, kind in facts]
    return rows.mapInArrow(run, ", ".join(ddl))


def pair_counts(aligned_docs: DataFrame, width: int) -> DataFrame:
    """``link, count, best``: how often each pair is linked in the corpus, and
    whether no pair of the same B id is linked more often."""
    entry = F.inline(F.arrays_zip("links", "times"))
    counts = aligned_docs.select(entry).groupBy(F.col("links").alias("link")).agg(F.sum("times").alias("count"))
    of_b = Window.partitionBy(F.col("link") % width)
    return counts.withColumn("best", F.col("count") == F.max("count").over(of_b))


def alignment_digest(docs: DataFrame, source: Tokenizers) -> DataFrame:
    """Per row the counts of its alignment and what the corpus says of its links."""
    spark = docs.sparkSession
    found = stored(align_documents(docs, source), "alignments", "zstd")
    width = len(source.token_bytes()[1])
    most = source.most_pairs()
    table = pair_counts(found, width).limit(most + 1).toArrow()
    if table.num_rows > most:
        raise ValueError("more linked pairs than the vocabularies allow")
    links = table.column("link").to_numpy()
    order = np.argsort(links)
    sent = spark.sparkContext.broadcast(
        (links[order], table.column("count").to_numpy()[order], table.column("best").to_numpy()[order].astype(np.int64))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = sent.value
        for batch in batches:
            listed, times = batch.column("links"), batch.column("times").flatten().to_numpy().astype(np.int64)
            at = np.searchsorted(keys, listed.flatten().to_numpy())
            ends = np.cumsum(listed.value_lengths().to_numpy())
            sums = []
            for values in (times * best[at], times * counts[at]):
                running = np.concatenate([[0], np.cumsum(values)])
                sums.append(pa.array(np.diff(running[np.concatenate([[0], ends])]), pa.int64()))
            kept = [batch.column(name) for name in shown]
            yield pa.RecordBatch.from_arrays([*kept, *sums], [*shown, "n_best", "count_sum"])

    shown = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    ddl = [f"{name} {found.schema[name].dataType.simpleString()}" for name in shown] + ["n_best bigint", "count_sum bigint"]
    return found.mapInArrow(run, ", ".join(ddl))
