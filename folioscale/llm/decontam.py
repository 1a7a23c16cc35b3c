"""Documents that hold benchmark passages, found by latent semantic retrieval.

1. Statistics: in how many documents each hashed word occurs, over all documents.
2. Fit: a randomised SVD of the TF-IDF matrix of the benchmark's passages. The
   matrix stays distributed; only products of fixed size (features x
   directions) come together.
3. Search: every document is cut into overlapping windows of three lengths. A
   window and a benchmark passage are candidates if their vectors in the latent
   space are close by cosine, and the window has enough of the passage. A bound
   per word, summed over the window, tells most windows apart from all passages
   before their vectors are needed. The latent space has fewer directions than a
   block can have passages, so on its own it would miss some; an index of words
   therefore proposes every window that has enough words of a passage to pass the
   check. This bound loses nothing that the check accepts.
4. Check: the longest common subsequence of words. A large share is a copy. A
   middling share is a paraphrase only if the passage's end, its answer, is
   there too.

The benchmark is fitted and searched in blocks of bounded size, each against
all documents. Words are runs of letters and digits in lower case. A null or empty
text is clean; so is everything if the benchmark is empty. Benchmark rows
without text, or with fewer than ``LEAST_WORDS`` words, say too little to be
searched for. Rows are judged by themselves: repeated rows and null ids are
kept as they are. Other columns of the inputs are not read.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscale.llm.common import folded, stored, text_hash, unfolded

FEATURES = 1 << 16
RANK = 128
EXTRA = 8
POWER_STEPS = 2
PASSAGE = 64
LENGTHS = (16, 32, 64)  # words in a window; a passage is searched with the shortest that holds it
ITEMS_PER_BLOCK = 512
LEAST_WORDS = 5
LEAST_COSINE = 0.5
LEAST_CONTAINED = 0.5
COPY_SHARE = 0.8
PARAPHRASE_SHARE = 0.5
FREQUENT_PART = 0.67  # of the words a match needs, how many may be too frequent to be looked up
ANSWER_SHARE = 0.75
CHUNK_WORDS = 1 << 16
COUNTED_WORDS = 100_000  # words that a task counts before it adds them up by feature

MATCHES = "array<struct<item_id:bigint,share:double,kind:string,start:int,stop:int>>"
# Bytes of ASCII that stand in no word become spaces; those of other characters stay.
_ASCII = bytes(range(128))
_ASCII_SPACED = bytes(byte if byte >= 128 or chr(byte).isalnum() else 32 for byte in range(256))
_OTHER_SPACE = re.compile(r"[^\w\x00-\x7F]+")


def plain_words(text: str | None) -> list[str]:
    """Runs of ``[^\\W_]`` in the text in lower case."""
    if not text:
        return []
    raw = text.lower().encode("utf-8", "surrogatepass")
    spaced = raw.translate(_ASCII_SPACED).decode("utf-8", "surrogatepass")
    if not raw.isascii() and not raw.translate(None, _ASCII).decode("utf-8", "surrogatepass").isalnum():
        # Beyond ASCII, too, there is something other than letters and digits.
        spaced = _OTHER_SPACE.sub(" ", spaced)
    return spaced.split()


class Features(dict):
    """The hashed feature of each word, remembered up to a limit."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) & (FEATURES - 1)
        return value


def passages_of(words: list[str]) -> list[list[str]]:
    return [words[at : at + PASSAGE] for at in range(0, len(words), PASSAGE)]


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Per feature, in how many documents its words occur; the table has a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, totals = Features(), np.zeros(FEATURES, np.int64)

        def add(words: Counter) -> None:
            found = np.fromiter(map(features.__getitem__, words), np.int64, len(words))
            np.add.at(totals, found, np.fromiter(words.values(), np.int64, len(words)))

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(set(plain_words(text)))
                if len(counts) > COUNTED_WORDS:
                    add(counts)
                    counts.clear()
        add(counts)
        some = np.nonzero(totals)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(totals[some])], ["feature", "docs"])

    rows = docs.select("text").mapInArrow(count, "feature int, docs bigint").groupBy("feature").agg(F.sum("docs").alias("docs"))
    out = np.zeros(FEATURES, np.int64)
    for row in rows.collect():
        out[row["feature"]] = row["docs"]
    return out


def weights(features: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a passage and their TF-IDF weights, of length 1."""
    ids, counts = np.unique(np.asarray(features, np.int64), return_counts=True)
    values = (1 + np.log(counts)) * idf[ids]
    return ids, (values / max(np.linalg.norm(values), 1e-12)).astype(np.float32)


def _products(passages: DataFrame, basis: np.ndarray, numbers: np.ndarray, idf: np.ndarray, small: bool) -> np.ndarray:
    """``A'(A Q)``, or with ``small`` the Gram matrix of ``A Q``, for the passage matrix A."""
    rows, width = (basis.shape[1] if small else len(basis)), basis.shape[1]
    block = 1024

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((rows, width), np.float32)
        for batch in batches:
            for features in batch["features"]:
                ids, values = weights(numbers[np.asarray(features)], idf)
                projected = values @ basis[ids]
                if small:
                    out += np.outer(projected, projected)
                else:
                    out[ids] += values[:, None] * projected
        for at in range(0, rows, block):
            part = out[at : at + block]
            if part.any():
                yield pd.DataFrame({"block": [at], "sums": [part.tobytes()]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(part, np.float32).astype(np.float64) for part in group["sums"]], axis=0)
        return pd.DataFrame({"block": [group["block"].iloc[0]], "sums": [total.astype(np.float32).tobytes()]})

    schema = "block int, sums binary"
    sums = passages.mapInPandas(multiply, schema).groupBy("block").applyInPandas(add, schema)
    out = np.zeros((rows, width))
    for row in sums.collect():  # rows x width floats in all, whatever the input
        part = np.frombuffer(row["sums"], np.float32).reshape(-1, width)
        out[row["block"] : row["block"] + len(part)] = part
    return out


@dataclass(frozen=True)
class LatentSpace:
    """Per feature its weighted direction; features without one share the last row, of zeros."""

    rows: np.ndarray  # FEATURES + 1 row numbers
    vectors: np.ndarray  # rows x RANK

    def of(self, features: np.ndarray) -> np.ndarray:
        return self.vectors[self.rows[features]].sum(axis=-2)


def fit(benchmark: DataFrame, idf: np.ndarray, seed: int = 1) -> LatentSpace:
    """The latent space of the passages of (a block of) the benchmark."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for batch in batches:
            parts = [part for text in batch["text"] for part in passages_of(plain_words(text if isinstance(text, str) else None))]
            yield pd.DataFrame({"features": [[features[word] for word in part] for part in parts]})

    passages = stored(benchmark.select("text").mapInPandas(cut, "features array<int>"), "passages")
    # Only features of this block have columns: FEATURES at most.
    used = np.array(sorted(row[0] for row in passages.select(F.explode("features")).distinct().collect()), np.int64)
    numbers = np.full(FEATURES + 1, len(used), np.int32)
    numbers[used] = np.arange(len(used))
    idf = idf[used]
    width = min(RANK + EXTRA, max(len(used), 1))
    basis = np.random.default_rng(seed).standard_normal((len(used), width)).astype(np.float32)
    for _ in range(POWER_STEPS + 1):
        basis = np.linalg.qr(_products(passages, basis, numbers, idf, small=False))[0].astype(np.float32)
    values, turn = np.linalg.eigh(_products(passages, basis, numbers, idf, small=True))
    order = np.argsort(-values)[:RANK]
    # Directions that hold nothing of the passages are left out.
    order = order[values[order] > 1e-6 * max(values.max(initial=0.0), 1e-12)]
    weighted = np.zeros((len(used) + 1, RANK), np.float32)
    weighted[:-1, : len(order)] = (basis @ turn[:, order]) * idf[:, None]
    return LatentSpace(numbers, weighted)


def common_subsequence(first: list[str], second: list[str]) -> int:
    """Length of the longest common subsequence, a row of bits per word of ``second``."""
    masks: dict[str, int] = {}
    for at, word in enumerate(first):
        masks[word] = masks.get(word, 0) | 1 << at
    full = (1 << len(first)) - 1
    row = full
    for word in second:
        both = row & masks.get(word, 0)
        row = ((row + both) | (row - both)) & full
    return len(first) - row.bit_count()


def judged(item: list[str], words: list[str]) -> tuple[float, str | None]:
    """Share of the item's words that stand in order in ``words``, and what that means."""
    share = common_subsequence(item, words) / len(item)
    if share >= COPY_SHARE:
        return share, "copy"
    if share >= PARAPHRASE_SHARE:
        answer = item[-max(3, len(item) // 4) :]
        if common_subsequence(answer, words) / len(answer) >= ANSWER_SHARE:
            return share, "paraphrase"
    return share, None


@dataclass(frozen=True)
class Items:
    """Passages of a block of the benchmark, by window length."""

    ids: dict[int, list[int]]
    words: dict[int, list[list[str]]]
    vectors: dict[int, np.ndarray]
    norms: dict[int, np.ndarray]
    most: dict[int, np.ndarray]  # per feature, the largest part of a passage that the word can be
    index: dict[int, WordIndex]
    distinct: dict[int, list[frozenset[str]]]
    known: dict[str, int]  # the feature of each word that a passage has


@dataclass(frozen=True)
class WordIndex:
    """Which passages have a word: those of feature f are ``items[begins[f]:begins[f + 1]]``.

    ``least`` has the words that a place must have in common with each passage.
    """

    begins: np.ndarray  # FEATURES + 2, none for the feature of no word
    items: np.ndarray
    least: np.ndarray


def word_index(passages: list[np.ndarray], idf: np.ndarray) -> WordIndex:
    """The index of passages, given as features.

    A match has ``PARAPHRASE_SHARE`` of a passage's words at least. Up to a part
    of these may be frequent words; the others must be among the words that
    the index has, so the most frequent words of a passage are left out of it.
    """
    pairs, least = [], []
    for item, passage in enumerate(passages):
        needed = max(1, int(np.ceil(PARAPHRASE_SHARE * len(passage) - 1e-9)))
        found, counts = np.unique(passage, return_counts=True)
        order = np.argsort(idf[found], kind="stable")
        left_out = np.cumsum(counts[order])
        skipped = int(np.searchsorted(left_out, int(needed * FREQUENT_PART), "right"))
        least.append(needed - (int(left_out[skipped - 1]) if skipped else 0))
        kept = found[order[skipped:]]
        pairs.append(np.stack([kept, np.full(len(kept), item)]))
    features, items = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    begins = np.concatenate([[0], np.cumsum(np.bincount(features, minlength=FEATURES + 1))])
    return WordIndex(begins, items[np.argsort(features, kind="stable")], np.array(least, np.int64))


def item_block(rows: list, space: LatentSpace, idf: np.ndarray) -> Items:
    features = Features()
    ids, words = {length: [] for length in LENGTHS}, {length: [] for length in LENGTHS}
    for row in rows:
        for part in passages_of(plain_words(row["text"])):
            if len(part) >= LEAST_WORDS:
                length = next(length for length in LENGTHS if length >= len(part))
                ids[length].append(row["item_id"])
                words[length].append(part)
    vectors, norms, most, index = {}, {}, {}, {}
    for length, parts in words.items():
        numbers = [np.array([features[word] for word in part], np.int64) for part in parts]
        index[length] = word_index(numbers, idf)
        found = [space.of(part) for part in numbers]
        vectors[length] = np.array(found, np.float32).reshape(-1, RANK)
        norms[length] = np.maximum(np.linalg.norm(vectors[length], axis=1), 1e-6)
        share = space.vectors @ (vectors[length] / norms[length][:, None] ** 2).T
        most[length] = np.maximum(share.max(axis=1, initial=0.0), 0.0)[space.rows].astype(np.float32)
    distinct = {length: [frozenset(part) for part in parts] for length, parts in words.items()}
    known = {word: features[word] for parts in words.values() for part in parts for word in part}
    return Items(ids, words, vectors, norms, most, index, distinct, known)


def _candidates(features: np.ndarray, space: LatentSpace, items: Items) -> Iterator[tuple[int, int, int]]:
    """(first word, window length, item) of close windows in a run of features."""
    for length in LENGTHS:
        stride = length // 4
        if not items.ids[length] or len(features) < length:
            continue
        # A window has no more of any passage than its words' bounds add up to.
        sums = items.most[length][features][: len(features) // stride * stride].reshape(-1, stride).sum(axis=1)
        bounds = sums[:-3] + sums[1:-2] + sums[2:-1] + sums[3:]
        chosen = np.nonzero(bounds >= LEAST_CONTAINED * 0.999)[0] * stride
        for begin in range(0, len(chosen), 1024):
            starts = chosen[begin : begin + 1024]
            windows = space.of(features[starts[:, None] + np.arange(length)])
            found = windows @ items.vectors[length].T
            norms = items.norms[length]
            sizes = np.maximum(np.linalg.norm(windows, axis=1)[:, None] * norms, 1e-12)
            at, item = np.nonzero((found >= LEAST_CONTAINED * norms * norms) & (found >= LEAST_COSINE * sizes))
            yield from zip(starts[at].tolist(), [length] * len(at), item.tolist(), strict=True)


def _sharing(features: np.ndarray, items: Items) -> Iterator[tuple[int, int, int]]:
    """(first word, window length, item) of all windows that, with their margins, have enough words of a passage."""
    for length in LENGTHS:
        index, stride, count = items.index[length], length // 4, len(items.ids[length])
        if not count:
            continue
        cells = -(-len(features) // stride)
        most = max(64, (1 << 21) // count)  # cells at a time, so that memory stays bounded
        for first in range(0, cells, most):
            # A place reaches over four cells, and its margins over one more on either side.
            low, high = max(0, first - 1), min(cells, first + most + 4)
            part = features[low * stride : high * stride]
            begins = index.begins[part]
            sizes = index.begins[part + 1] - begins
            total = int(sizes.sum())
            within = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            cell = np.repeat(np.arange(len(part)) // stride + (1 + low - first), sizes)
            hits = cell * count + index.items[np.repeat(begins, sizes) + within]
            rows = min(most, cells - first)
            table = np.bincount(hits, minlength=(rows + 5) * count).astype(np.int16).reshape(-1, count)
            pairs = table[:-1] + table[1:]
            sums = pairs[:rows] + pairs[2 : rows + 2] + pairs[4 : rows + 4]
            at, item = np.nonzero(sums >= index.least)
            yield from zip(((at + first) * stride).tolist(), [length] * len(at), item.tolist(), strict=True)


def _chunks(texts: list[str | None], known: dict[str, int]) -> Iterator[tuple[list[tuple[int, int, list[str]]], np.ndarray]]:
    """Texts side by side, apart by a window of no words: ((place, text, words)..., features).

    A word that no passage has is no word here: it can be part of no match.
    """
    placed, parts, size = [], [], 0
    for number, text in enumerate(texts):
        words = plain_words(text)
        if not words:
            continue
        fill = -len(words) % LENGTHS[-1] + LENGTHS[-1]
        parts += [np.fromiter(map(known.get, words, itertools.repeat(FEATURES)), np.int64, len(words)), np.full(fill, FEATURES)]
        placed.append((size, number, words))
        size += len(words) + fill
        if size >= CHUNK_WORDS:
            yield placed, np.concatenate(parts)
            placed, parts, size = [], [], 0
    if placed:
        yield placed, np.concatenate(parts)


def find_matches(texts: list[str | None], space: LatentSpace, items: Items) -> list[list[dict]]:
    """Per text, the benchmark items found in it, the best place of each."""
    out: list[list[dict]] = [[] for _ in texts]
    for placed, run in _chunks(texts, items.known):
        begins = np.array([place for place, _, _ in placed])
        best: dict[tuple[int, int], dict] = {}
        close = {
            (begin + at, length, item)
            for begin, end in _pieces(len(run))
            for at, length, item in _candidates(run[begin:end], space, items)
        }
        proposed = sorted(close.union(_sharing(run, items)))
        texts_of = np.searchsorted(begins, [at for at, _, _ in proposed], "right") - 1
        for (at, length, item), text in zip(proposed, texts_of.tolist(), strict=True):
            place, number, words = placed[text]
            wanted = items.words[length][item]
            start = max(0, at - place - len(wanted) // 4)
            stop = min(len(words), at - place + length + len(wanted) // 4)
            # Each word of the passage counts as often as it has it, which is the most they can have in order.
            distinct = items.distinct[length][item]
            if len(distinct.intersection(words[start:stop])) + len(wanted) - len(distinct) < PARAPHRASE_SHARE * len(wanted):
                continue
            share, kind = judged(wanted, words[start:stop])
            key = (number, items.ids[length][item])
            if kind and (key not in best or share > best[key]["share"]):
                best[key] = {"item_id": key[1], "share": share, "kind": kind, "start": start, "stop": stop}
        for (number, _), match in sorted(best.items(), key=lambda entry: (entry[0][0], entry[0][1] or 0)):
            out[number].append(match)
    return out


def _pieces(size: int) -> Iterator[tuple[int, int]]:
    """Cuts of a long run, overlapping by a window, so that memory stays bounded."""
    for begin in range(0, size, CHUNK_WORDS):
        yield begin, min(size, begin + CHUNK_WORDS + LENGTHS[-1])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: ``doc_id, text_hash, matches, contaminated``."""
    text = F.col(f"`{text_column}`")
    plain = docs.select(F.col(f"`{id_column}`").alias("doc_id"), text_hash(text).alias("text_hash"), text.alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where("text is not null")
    frequency = document_frequencies(plain)
    total = max(plain.count(), 1)
    # Words that share a feature can be found in more documents together than there are.
    idf = np.log((total + 1) / (np.minimum(frequency, total) + 1)).astype(np.float32) + np.float32(0.05)
    blocks = max(1, -(-items.count() // ITEMS_PER_BLOCK))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    parts = [items.where(number == block) for block in range(blocks)]
    found = [_search(plain, part.collect(), fit(part, idf), idf) for part in parts]  # a block is bounded
    merged = found[0]
    if blocks > 1:
        for other in found[1:]:
            merged = merged.unionByName(other)
        # Equal rows have equal matches; one of each block's is enough, for as many rows as there are.
        merged = merged.groupBy("doc_id", "text_hash").agg(
            (F.count(F.lit(1)) / blocks).cast("int").alias("_copies"), F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches")
        )
        merged = merged.select("doc_id", "text_hash", "matches", F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).drop("_copy")
    return merged.withColumn("contaminated", F.size("matches") > 0)


def _search(docs: DataFrame, rows: list, space: LatentSpace, idf: np.ndarray) -> DataFrame:
    items = item_block(rows, space, idf)
    kind = pa.list_(
        pa.struct(
            [("item_id", pa.int64()), ("share", pa.float64()), ("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]
        )
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matches = find_matches(batch.column(2).to_pylist(), space, items)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(matches, kind)], ["doc_id", "text_hash", "matches"]
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(search, f"doc_id {id_type}, text_hash bigint, matches {MATCHES}")


def contamination_digest(found: DataFrame) -> DataFrame:
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda match: match["item_id"])))
    share = F.array_max(F.transform("matches", lambda match: match["share"]))
    return found.select(
        "doc_id",
        "contaminated",
        F.array_join(ids, ",").alias("item_ids"),
        F.coalesce(share, F.lit(0.0)).alias("share"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the documents that hold benchmark passages."""
    bad = decontaminate(docs, benchmark, id_column, text_column).where("contaminated").select("doc_id", "text_hash").distinct()
    rows = folded(docs, own_id=F.col(f"`{id_column}`"), own_hash=text_hash(F.col(f"`{text_column}`")))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash"))
    return unfolded(rows.join(bad, same, "left_anti"), docs)
