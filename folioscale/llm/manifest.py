"""A Merkle manifest of a table: one tree per group, one tree over the groups.

A leaf is the sha256 of a row's values, each written as its byte count, a
colon and the value, or ``-`` for a null. In a group the leaves ascend by the
order column; eight consecutive nodes become their hash until one is left, the
group's ``subroot``. The subroots, ordered by group (null first, by bytes),
become the ``root`` in the same way.

Leaves get their place by a range sort and the running counts of its
partitions, so a group with most of the rows is spread like any other. Aligned
blocks of 512 nodes then keep each of their levels as one string of hex digits:
fixed-width substrings of it are the runs that hash to the next level, and
what stands left and right of a node in its run are its sibling segments. The
tops of the blocks are the nodes of the next round, until each tree has ended.
On the way back every block hands the segments above it down to its nodes, so
the table of leaves meets nothing but the slim table of blocks.

Nulls: a null in any column is ``-``; a null order value comes first, a null
group is a group. Rows with equal order values follow each other by their leaf
hash; rows that are equal altogether are leaves of their own, interchangeable.
An empty table has no leaves. Columns that are not named are not read.
"""

from __future__ import annotations

import string
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscale.llm.common import stored

FAN = 8
LEVELS = 3
BLOCK = FAN**LEVELS
DIGITS = 64
RUN = FAN * DIGITS

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_SEGMENT = "struct<before: string, after: string>"


def sized(value: Column) -> Column:
    """The value as text after its byte count, or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[sized(value) for value in values]), 256)


def with_places(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Add ``place``, from 0 within the group, and ``total``, the group's rows.

    ``order`` must tell all rows apart. The rows are stored in ranges; each
    range knows its rows by number, and the table of ranges, a few rows per
    partition, tells how many come before.
    """
    at = F.monotonically_increasing_id()
    ranges = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", at)
    ranges = stored(ranges, "manifest-ranges", "zstd").withColumn("_range", F.shiftright("_at", 33))
    counts = ranges.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    same = Window.partitionBy(group)
    before = F.sum("_rows").over(same.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select(
        group,
        "_range",
        (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(same).alias("total"),
    )
    # Stored, its size is known to Spark, which then decides how to join it.
    placed = ranges.join(stored(shifts, "manifest-shifts"), [group, "_range"])
    return placed.withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def _runs(level: Column) -> Column:
    """The level's runs of eight digests, the last one perhaps shorter."""
    count = F.ceil(F.length(level) / F.lit(RUN)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(level, k * RUN + 1, F.lit(RUN)))
    return F.when(count > 0, cut)


def _blocks(nodes: DataFrame) -> DataFrame:
    """``tree, block, total, members`` and, for each of the levels that the
    block climbs, its ``runs``; ``top`` is the digest it ends with.

    ``nodes`` are ``tree, place, total, digest, payload``. A block alone in its
    tree ends at one node, any other climbs all three levels.
    """
    member = F.struct("place", "digest", "payload")
    blocks = nodes.groupBy("tree", F.floor(F.col("place") / BLOCK).cast("long").alias("block")).agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list(member)).alias("members")
    )
    level = F.array_join(F.transform("members", lambda m: m["digest"]), "")
    blocks = _kept(blocks, level=level)
    for number in range(LEVELS):
        climbs = (F.col("total") > BLOCK) | (F.length("level") > DIGITS)
        blocks = _kept(blocks, **{f"runs{number}": F.when(climbs, _runs(F.col("level")))})
        up = F.array_join(F.transform(f"runs{number}", lambda run: F.sha2(run, 256)), "")
        blocks = _kept(blocks, level=F.coalesce(up, F.col("level")))
    return blocks.withColumnRenamed("level", "top")


def _kept(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace columns behind a border that projections are not merged
    across, so that lambda functions refer to values and not to expressions."""
    struct = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*[name for name in df.columns if name not in columns], F.inline(F.array(struct)))


def climb(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, and ``tree, top`` of all trees. ``most`` is
    the number of nodes of the largest tree; it gives the number of rounds."""
    rounds, ends = [], []
    while True:
        blocks = stored(_blocks(nodes), "manifest-blocks", "zstd")
        rounds.append(blocks)
        ends.append(blocks.where(F.col("total") <= BLOCK).select("tree", "top"))
        if most <= BLOCK:
            return rounds, reduce(DataFrame.unionAll, ends)
        most = -(-most // BLOCK)
        nodes = blocks.where(F.col("total") > BLOCK).select(
            "tree",
            F.col("block").alias("place"),
            F.ceil(F.col("total") / BLOCK).cast("long").alias("total"),
            F.col("top").alias("digest"),
            F.lit(None).cast("string").alias("payload"),
        )


def _segments(place: Column) -> Column:
    """What flanks the node at ``place`` of the block, and its ancestors there."""

    def flanks(number: int) -> Column:
        index = F.floor(place / FAN**number).cast("int")
        run = F.element_at(F.col(f"runs{number}"), F.floor(index / FAN).cast("int") + 1)
        offset = index % FAN * DIGITS
        before = F.substring(run, F.lit(1), offset).alias("before")
        return F.when(
            F.col(f"runs{number}").isNotNull(), F.struct(before, F.substring(run, offset + DIGITS + 1, F.lit(RUN)).alias("after"))
        )

    return F.array_compact(F.array(*[flanks(number) for number in range(LEVELS)]))


def descend(rounds: list[DataFrame], crown: DataFrame) -> DataFrame:
    """``tree, place, digest, payload, segments`` of the first round's nodes and
    the columns of ``crown`` (``tree, above`` and others, one row per tree):
    ``segments`` lead from the node to the top of the tree, then on by ``above``."""
    passed = [name for name in crown.columns if name not in ("tree", "above")]
    down = None
    for blocks in reversed(rounds):
        last = blocks.where(F.col("total") <= BLOCK).join(crown, "tree")
        if down is not None:
            above = down.select("tree", F.col("place").alias("block"), F.col("segments").alias("above"), *passed)
            inner = blocks.where(F.col("total") > BLOCK).join(above, ["tree", "block"])
            last = last.unionByName(inner)
        member = F.transform(
            "members",
            lambda m, index: F.struct(
                m["place"].alias("place"),
                m["digest"].alias("digest"),
                m["payload"].alias("payload"),
                F.concat(_segments(index), F.col("above")).alias("segments"),
            ),
        )
        down = last.select("tree", *passed, F.inline(member))
    return down


def proof_hash(segments: Column) -> Column:
    """The hash of all siblings from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(segments, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf: Column, segments: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(segments, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def build_manifest(
    docs: DataFrame,
    columns: Sequence[str] = COLUMNS,
    group: str = "lang",
    order: str = "doc_id",
    carried: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Per row of ``docs``: the order column, ``leaf``, the group's ``subroot``,
    the ``root``, the ``segments`` of its proof, and ``carried`` (expressions
    over ``docs`` by name, put into a struct of that name)."""
    carried = carried or {}
    named = [value.alias(name) for name, value in carried.items()]
    rows = stored(
        docs.select(
            # Groups by name, null before all: the sign only keeps null and '' apart.
            F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("tree"),
            F.col(f"`{order}`").alias("key"),
            leaf_hash(*[F.col(f"`{name}`") for name in columns]).alias("digest"),
            F.struct(F.col(f"`{order}`").alias("key"), *named).alias("payload"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "manifest-leaves",
        "zstd",
    )
    nodes = with_places(rows, "tree", ["key", "digest", "row"]).drop("key", "row")
    trees = rows.groupBy("tree").agg(F.count(F.lit(1)).alias("rows"))
    measures = trees.agg(F.count(F.lit(1)), F.max("rows")).first()
    rounds, subroots = climb(nodes, measures[1] or 0)

    subroots = stored(subroots, "manifest-subroots")
    peaks = with_places(subroots.withColumn("all", F.lit(0)), "all", ["tree"])
    peaks = peaks.select(
        F.lit("").alias("tree"), "place", "total", F.col("top").alias("digest"), F.col("tree").alias("payload")
    )
    upper, root = climb(peaks, measures[0])
    nothing = F.array().cast(f"array<{_SEGMENT}>")
    joined = descend(upper, root.select("tree", F.col("top").alias("root"), nothing.alias("above")))
    crown = joined.select(
        F.col("payload").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("segments").alias("above")
    )
    leaves = descend(rounds, crown)
    extra = [F.col("payload")[name].alias(name) for name in carried]
    return leaves.select(
        F.col("payload")["key"].alias(order), F.col("digest").alias("leaf"), "subroot", "root", "segments", *extra
    )


def tampered_leaf(columns: Sequence[str] = COLUMNS, order: str = "doc_id", text: str = "text") -> Column:
    """The leaf of a row whose text lost its capitals, where the id is drawn
    (3 divides its crc32); null for all other rows."""
    lower = F.translate(F.col(f"`{text}`"), string.ascii_uppercase, string.ascii_lowercase)
    values = [lower if name == text else F.col(f"`{name}`") for name in columns]
    drawn = F.crc32(F.encode(F.col(f"`{order}`").cast("string"), "UTF-8")) % 3 == 0
    return F.when(drawn, leaf_hash(*values))


def verified_digest(docs: DataFrame) -> DataFrame:
    """Every row's proof, folded again after some rows were tampered with."""
    found = build_manifest(docs, carried={"tampered": tampered_leaf()})
    result = found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_hash(F.col("segments")).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("segments")).alias("folded_root"),
    )
    return result.withColumn("verified", F.col("folded_root") == F.col("root"))
