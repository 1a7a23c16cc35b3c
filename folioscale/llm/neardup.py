"""Near-duplicate documents by MinHash with tensored banding.

A document is the set of its word shingles; two are linked if the Jaccard
similarity of the full sets reaches the threshold, and linked documents form
components.

Candidates meet in hash tables. A table's key is a pair (a, b) of blocks, a
from one small collection of minhash blocks and b from another. With ``m``
blocks on each side there are ``m * m`` tables, but only ``2 * m`` blocks to
compute: the number of minhashes is about the square root of what separate
keys would take.

Equal sets are one node from the start. Within a key, every node is compared
with one hub, the node that meets most others, not with all others. Keys whose
nodes are then still in different components get another hub, a few times. What
is left after that goes on to pairs, of which the set sizes, the triangle
inequality of the Jaccard distance (distances to the last hub are known) and
parity signatures of 1024 bits rule most out. No pair of a key that could still be linked is left out.

A null or empty text has no shingles and is linked with nothing. A text with
fewer words than a shingle is one shingle. Repeated ids: a component's id is
the smallest id of any of its rows, and every row with that id is kept. Rows
without id take part; if all rows of a component lack one, its id is null and
all are kept. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscale.llm.common import folded, stored, text_hash, unfolded
from folioscale.llm.flags import bucket_flags
from folioscale.llm.words import WordHashes, lower_ascii, mixed, window_hashes, words_of

BLOCKS = 8
HASHES_PER_BLOCK = 2
THRESHOLD_PERCENT = 80
FLAG_BITS = 20
STAR_ROUNDS = 3

SIGNATURES = (
    "doc_id {kind}, text_hash bigint, n_shingles bigint, node bigint, left_blocks array<bigint>, right_blocks array<bigint>"
)
SETS = "node bigint, parity array<bigint>, shingles array<bigint>"
PARITY_WORDS = 16


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = words_of(lower_ascii(text))
    if not words:
        return np.empty(0, np.uint64)
    values = hashes.array(words)
    if len(values) < width:
        # Seeded with the length: never equal to a full shingle by construction.
        return window_hashes(values, len(values)) ^ np.uint64(len(values) + 1)
    return np.unique(window_hashes(values, width))


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


_SALTS = mixed(np.arange(1, 2 * BLOCKS * HASHES_PER_BLOCK + 1, dtype=np.uint64)) | np.uint64(1)


def block_values(shingles: np.ndarray) -> np.ndarray:
    """Left, then right block hashes; each combines a few minhashes."""
    if len(shingles) <= 1 << 14:
        smallest = (shingles[None, :] * _SALTS[:, None]).min(axis=1)
    else:
        smallest = np.array([(shingles * salt).min() for salt in _SALTS])
    blocks = smallest.reshape(-1, HASHES_PER_BLOCK)
    value = np.arange(1, len(blocks) + 1, dtype=np.uint64)
    for number in range(HASHES_PER_BLOCK):
        value = mixed(value * np.uint64(31) + blocks[:, number])
    return value.view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """Per row: id, size of its set, node (hash of the whole set), block hashes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        np.seterr(over="ignore")
        for batch in batches:
            sizes, nodes, left, right = [], [], [], []
            for text in batch.column(1).to_pylist():
                shingles = shingle_set(text, width, hashes)
                sizes.append(len(shingles))
                if not len(shingles):
                    nodes.append(None), left.append(None), right.append(None)
                    continue
                nodes.append(_node(shingles))
                blocks = block_values(shingles).tolist()
                left.append(blocks[:BLOCKS])
                right.append(blocks[BLOCKS:])
            columns = [
                batch.column(0),
                batch.column(2),
                pa.array(sizes, pa.int64()),
                pa.array(nodes, pa.int64()),
                pa.array(left, pa.list_(pa.int64())),
                pa.array(right, pa.list_(pa.int64())),
            ]
            names = ["doc_id", "text_hash", "n_shingles", "node", "left_blocks", "right_blocks"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(sign, SIGNATURES.format(kind=docs.schema["doc_id"].dataType.simpleString()))


def table_keys(nodes: DataFrame) -> DataFrame:
    """(key, node) for each pair of a left and a right block."""
    left = nodes.select("node", "right_blocks", F.posexplode("left_blocks").alias("i", "a"))
    both = left.select("node", "i", "a", F.posexplode("right_blocks").alias("j", "b"))
    return both.select(F.xxhash64("i", "a", "j", "b").alias("key"), "node")


def shingle_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """The full sets of the given nodes, one row each, from the texts.

    A table of one byte per bucket of nodes, the same size for any input, goes
    to all tasks; what it lets through by chance is removed by the join.
    """
    flags = bucket_flags(nodes, "node", FLAG_BITS)

    def collect_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, mask = WordHashes(), (1 << FLAG_BITS) - 1
        np.seterr(over="ignore")
        for batch in batches:
            found, sets = [], []
            for text in batch.column(0).to_pylist():
                shingles = shingle_set(text, width, hashes)
                if len(shingles) and flags[(node := _node(shingles)) & mask]:
                    found.append(node)
                    sets.append(shingles.view(np.int64))
                if len(found) >= 500:
                    yield _set_batch(found, sets)
                    found, sets = [], []
            if found:
                yield _set_batch(found, sets)

    sets = docs.select("text").mapInArrow(collect_sets, SETS)
    # Equal sets of different rows are the same row here.
    once = sets.groupBy("node").agg(F.first("parity").alias("parity"), F.first("shingles").alias("shingles"))
    return once.join(nodes, "node", "left_semi")


def parity(shingles: np.ndarray) -> np.ndarray:
    """1024 bits, of which each shingle flips one: two sets differ in no fewer shingles than bits."""
    counts = np.bincount((shingles & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _set_batch(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(values) for values in sets])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))
    bits = np.concatenate([parity(values.view(np.uint64)) for values in sets])
    places = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * PARITY_WORDS)
    columns = [pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(places, pa.array(bits)), lists]
    return pa.RecordBatch.from_arrays(columns, ["node", "parity", "shingles"])


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, shared, together): sizes of intersection and union of the full sets."""
    left = sets.select(F.col("node").alias("x"), F.col("shingles").alias("x_set"))
    right = sets.select(F.col("node").alias("y"), F.col("shingles").alias("y_set"))
    shared = F.size(F.array_intersect("x_set", "y_set")).cast("long")
    return (
        pairs.join(left, "x")
        .join(right, "y")
        .select("x", "y", shared.alias("shared"), (F.size("x_set") + F.size("y_set")).alias("both"))
        .select("x", "y", "shared", (F.col("both") - F.col("shared")).alias("together"))
    )


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node: the smallest node that it reaches.

    Each round takes the smallest label among the neighbours, then the label
    which that node has found itself.
    """
    edges = stored(links.select("x", "y").union(links.select("y", "x")).distinct(), "links")
    current = stored(edges.select(F.col("x").alias("node"), F.col("x").alias("label")).distinct(), "labels")
    while True:
        near = edges.join(current, edges["y"] == current["node"]).groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        best = current.join(near, "node").select("node", "label", F.least("label", "near").alias("best"))
        ahead = best.select(F.col("node").alias("best"), F.col("best").alias("ahead"))
        found = best.join(ahead, "best").select("node", F.col("label").alias("old"), F.least("best", "ahead").alias("label"))
        moved = stored(found, "labels")
        current = moved.select("node", "label")
        if moved.where("old <> label").limit(1).count() == 0:
            return current


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = THRESHOLD_PERCENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: ``doc_id, text_hash, n_shingles, component_id, kept`` and
    ``component``, a number for the component; null for a text without words."""
    texts = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    texts = texts.withColumn("text_hash", text_hash(F.col("text")))
    signed = stored(signatures(texts, width), "signatures")
    nodes = (
        signed.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.first("left_blocks").alias("left_blocks"),
            F.first("right_blocks").alias("right_blocks"),
        )
    )
    keys = table_keys(nodes)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(keys.join(shared, "key").select("key", "node", "size"), "members")
    # A node that meets many others is compared with them first: an original among its copies.
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    sets = stored(shingle_sets(texts, degree.select("node"), width), "shingle-sets")
    sizes = sets.select("node", F.size("shingles").alias("n"), "parity")
    placed = members.join(degree.join(sizes, "node"), "node")
    active = stored(placed.select("key", "node", "degree", "n", "parity", F.lit(0.0).alias("distance"), F.lit(False).alias("hub")), "active")
    linked = F.col("shared") * 100 >= F.col("together") * percent
    links, labels = None, None
    for _ in range(STAR_ROUNDS):
        hubs = active.where("not hub").groupBy("key").agg(F.max_by("node", F.struct("degree", "node")).alias("x"), F.count(F.lit(1)).alias("left"))
        starred = active.join(hubs.where("left > 1").select("key", "x"), "key")
        stars = starred.where("x <> node and not hub").select("x", F.col("node").alias("y")).distinct()
        tested = stored(similarities(stars, sets), "star-pairs")
        found = tested.where(linked).select("x", "y")
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        far = tested.select("x", F.col("y").alias("node"), (1 - F.col("shared") / F.col("together")).alias("to_hub"))
        known = labels.select("node", "label")
        moved = (
            starred.join(far, ["x", "node"], "left")
            .join(known, "node", "left")
            .select(
                "key",
                "node",
                "degree",
                "n",
                "parity",
                F.coalesce("to_hub", F.when(F.col("node") == F.col("x"), F.lit(0.0)), "distance").alias("distance"),
                (F.col("hub") | (F.col("node") == F.col("x"))).alias("hub"),
                F.coalesce("label", "node").alias("label"),
            )
        )
        moved = stored(moved, "moved")
        # A key all of whose nodes are in one component is settled.
        apart = moved.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        active = stored(moved.join(apart.select("key"), "key", "left_semi").drop("label"), "active")

    # Pairs that neither size nor distance from the last hub rules out. Hubs have met everyone.
    open_ = active.where("not hub").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = stored(open_, "open-pairs")
    first, second = open_.alias("p"), open_.alias("q")
    within = 1 - percent / 100 + 1e-9
    bits = [F.bit_count(F.col("p.parity")[at].bitwiseXOR(F.col("q.parity")[at])) for at in range(PARITY_WORDS)]
    # Similar sets of a and b shingles differ in (100 - percent) / (100 + percent) of a + b at most.
    alike = sum(bits[1:], bits[0]) * (100 + percent) <= (F.col("p.n") + F.col("q.n")) * (100 - percent)
    rest = (
        first.join(second, F.col("p.key") == F.col("q.key"))
        .where("p.node < q.node and p.label <> q.label")
        .where((F.col("p.n") * 100 >= F.col("q.n") * percent) & (F.col("q.n") * 100 >= F.col("p.n") * percent))
        .where(F.abs(F.col("p.distance") - F.col("q.distance")) <= within)
        .where(alike)
        .select(F.col("p.node").alias("x"), F.col("q.node").alias("y"))
        .distinct()
    )
    more = stored(similarities(rest, sets).where(linked).select("x", "y"), "other-links")
    if more.limit(1).count():
        labels = components(links.union(more))

    placed_nodes = nodes.select("node", "doc_id").join(labels, "node", "left")
    placed_nodes = placed_nodes.select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    smallest = placed_nodes.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    known = placed_nodes.join(smallest, "label").select("node", "component_id", F.col("label").alias("component"))
    return (
        signed.select("doc_id", "text_hash", "n_shingles", "node")
        .join(known, "node", "left")
        .select(
            "doc_id",
            "text_hash",
            "n_shingles",
            F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            "component",
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def drop_near_duplicates(docs: DataFrame, width: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (a null
    one comes last), among equal ids with the smallest text hash. Of rows equal
    in id and text one stays. Rows without words are in no component and stay."""
    facts = near_duplicates(docs, width, id_column=id_column, text_column=text_column)
    facts = stored(facts.where("component is not null").select("component", "doc_id", "text_hash"), "component-rows")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    counted = facts.groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    survivors = counted.groupBy("component").agg(F.min(place).alias("first"))
    judged = counted.join(survivors, "component").select(
        F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), (place == F.col("first")).alias("stays"), "copies"
    )
    judged = stored(judged, "judged-rows")
    rows = folded(docs, own_id=F.col(f"`{id_column}`"), own_hash=text_hash(F.col(f"`{text_column}`")))
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash"))
    left = unfolded(rows.join(judged.where("not stays or copies > 1"), same, "left_anti"), docs)
    again = judged.where("stays and copies > 1")
    if again.isEmpty():
        return left
    # Equal rows are combined before the shuffle, so a row repeated very often is no hot key.
    once = rows.join(again, same).groupBy("own_id", "own_hash").agg(F.first("row").alias("row"))
    return left.unionByName(unfolded(once, docs))
