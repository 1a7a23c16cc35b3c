"""Lines that nearly repeat an earlier line, by an exact set-similarity join.

A line is the set of its words. In the order of documents (id, then text hash)
and lines, a line is removed if an earlier line, removed or not, has a Jaccard
similarity of 0.8 or more with it. So which lines go does not depend on the
order of work.

Words of a line are ordered by rarity. Two similar lines share a word among
the first fifth of theirs, so only these prefixes are joined. Lengths, the
positions of the shared word and a parity signature of 64 or 128 bits bound the
overlap from above; what passes is verified on the full sets.

Only whether a line has an earlier similar one is asked, not for all pairs. So
each set first meets the earliest one of every word of its prefix, if both have
several of these words in common. In a group of lines that nearly equal each
other this settles almost all, however large or small the group; a settled set
needs no other partner, it stays the earlier side only. The sets still open then
meet all earlier ones of their words, which makes it exact.

Rarity is counted over all lines, in a table of ``RARITY_BUCKETS`` hashed words
whose size does not depend on the input. Lines with equal sets are one set from
the start, so a line that occurs very often is joined once. Only the order of
words by rarity depends on the counts, never the result.

Lines without words stay. Null and empty texts have no words; null ids come
first. Rows equal in id and text are one document: what is removed from one is
removed from all. Other columns of the input are not read.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscale.llm.common import folded, materialised, stored, text_hash, unfolded

RARITY_BUCKETS = 1 << 16
FLAGS = 1 << 20
#: Of the words of its prefix, how many a set has in common with a hub that it meets.
HUB_SHARE = 1 / 3
SETTLED = 1 << 62
LONG = 64  # words in a set from which on it has a second signature
PERCENT = 80
OTHER_SPACE = "\t\x0b\x0c\r"

ROW = ["doc_id", "text_hash", "line_no"]


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, text_hash`` and the text, with a space for each other white space but the ends of lines."""
    text = F.col(f"`{text_column}`")
    # Most texts have no other white space: they are only looked through, byte by byte.
    other = reduce(operator.or_, [F.contains(text, F.lit(space)) for space in OTHER_SPACE])
    spaced = F.when(other, F.translate(text, OTHER_SPACE, " " * len(OTHER_SPACE))).otherwise(text)
    return docs.select(F.col(f"`{id_column}`").alias("doc_id"), text_hash(text).alias("text_hash"), spaced.alias("spaced"))


def _lines(texts: DataFrame) -> DataFrame:
    # The border keeps what is asked of ids and hashes from being evaluated per line.
    keyed = materialised(texts.select("doc_id", "spaced", "text_hash"), text_hash=F.col("text_hash"))
    return keyed.select("doc_id", "text_hash", F.posexplode(F.split("spaced", "\n")).alias("line_no", "line"))


def _words() -> Column:
    # One plain character is split at without a regular expression.
    return F.array_remove(F.split("line", " "), "")


def _hashes() -> Column:
    return F.transform(_words(), lambda word: F.xxhash64(word))


def rarity_table(texts: DataFrame) -> bytes:
    """Per bucket of hashed words a class from 0 (rare) to 127, four to a doubling of the count."""
    words = texts.select(F.explode(F.split(F.replace("spaced", F.lit("\n"), F.lit(" ")), " ")).alias("word")).where("word <> ''")
    bucket = F.xxhash64("word").bitwiseAND(F.lit(RARITY_BUCKETS - 1)).cast("int")
    counts = words.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("places"))
    classes = counts.select("bucket", F.least(F.lit(127), F.floor(F.log2(F.col("places") + 1) * 4)).cast("int").alias("class"))
    table = bytearray(RARITY_BUCKETS)
    for row in classes.collect():  # at most RARITY_BUCKETS rows
        table[row["bucket"]] = row["class"]
    return bytes(table)


def _ordered(hashes: Column, table: bytes) -> Column:
    """The distinct hashes with their word's class in front, so that numbers sort by rarity."""
    # Folded into one literal when the query is planned.
    classes = F.split(F.lit(",".join(str(value << 56) for value in table)), ",").cast("array<bigint>")

    def keyed(value: Column) -> Column:
        # Never null: only arrays without nulls are sorted as plain numbers.
        rarity = F.coalesce(F.get(classes, value.bitwiseAND(F.lit(RARITY_BUCKETS - 1)).cast("int")), F.lit(0).cast("long"))
        return rarity.bitwiseOR(F.shiftrightunsigned(value, 8))

    return F.sort_array(F.transform(F.array_distinct(hashes), keyed))


def _prefix_size(size: Column) -> Column:
    return (size - size % 5) / 5 + 1


def _parity(keys: str, all_words: bool) -> Column:
    """64 bits, of which each word flips one; or only each second word, so that both tell 128 bits apart."""

    def flip(state: Column, key: Column) -> Column:
        mine = F.lit(1).cast("long") if all_words else F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(1))
        return state.bitwiseXOR(F.call_function("shiftleft", mine, key.bitwiseAND(F.lit(63)).cast("int")))

    return F.aggregate(keys, F.lit(0).cast("long"), flip)


def line_sets(lines: DataFrame, table: bytes) -> DataFrame:
    """Per line with words: its place, set, size, prefix of rare words and signature."""
    hashed = materialised(lines.select(*ROW, "line"), ordered=_ordered(_hashes(), table)).where(F.size("ordered") > 0)
    size = F.size("ordered")
    short = F.transform(F.slice("ordered", F.lit(1), _prefix_size(size).cast("int")), lambda key: key.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    return hashed.select(
        *ROW,
        F.xxhash64("ordered").alias("set_id"),
        size.alias("size"),
        short.alias("prefix"),
        _parity("ordered", True).alias("odd"),
        F.when(size > LONG, _parity("ordered", False)).otherwise(F.lit(0).cast("long")).alias("odd_half"),
    )


def distinct_sets(placed: DataFrame) -> DataFrame:
    """Each set once, with its ``first`` place, a number ``no`` that ascends with it, and in how many ``lines`` it is."""
    sets = placed.groupBy("set_id").agg(
        F.min(F.struct(*ROW)).alias("first"), F.count(F.lit(1)).alias("lines"), *[F.first(name).alias(name) for name in ("size", "prefix", "odd", "odd_half")]
    )
    ranges = sets.repartitionByRange("first").sortWithinPartitions("first")
    return stored(ranges.withColumn("no", F.monotonically_increasing_id()), "distinct-sets")


def _entries(sets: DataFrame) -> DataFrame:
    """A row per set and word of its prefix; ``where`` holds the set's size, the
    word's place, and whether the set is settled."""
    entries = sets.select("no", "size", "odd", "odd_half", "settled", F.posexplode("prefix").alias("place", "word"))
    settled = F.when(F.col("settled"), SETTLED).otherwise(0)
    return entries.select("word", "no", _where().bitwiseOR(settled).alias("where"), "odd", "odd_half")


def _where() -> Column:
    return F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(F.col("size").cast("long"))


def _size_in(where: Column) -> Column:
    return where.bitwiseAND(F.lit(0xFFFFFFFF))


def _place_in(where: Column) -> Column:
    return F.shiftright(where, 32).bitwiseAND(F.lit(0x3FFFFFFF))


def _long_enough(x: Column, y: Column) -> Column:
    x_size, y_size = _size_in(x), _size_in(y)
    return (x_size * 100 >= y_size * PERCENT) & (y_size * 100 >= x_size * PERCENT)


def _in_reach(x: Column, y: Column) -> Column:
    """Lengths and places of two entries of a word do not rule out similarity."""
    x_size, y_size = _size_in(x), _size_in(y)
    most = F.least(_place_in(x), _place_in(y)) + F.least(x_size - _place_in(x), y_size - _place_in(y))
    # With similarity 0.8, sets of a and b words share 4/9 (a+b).
    return _long_enough(x, y) & (most * 9 >= (x_size + y_size) * 4)


def _may_be_first(x: Column, y: Column) -> Column:
    """Nor that this is the rarest word they share: all others then stand after it in both."""
    x_size, y_size = _size_in(x), _size_in(y)
    return _long_enough(x, y) & (F.least(x_size - _place_in(x), y_size - _place_in(y)) * 9 >= (x_size + y_size) * 4)


def _may_be_similar(x: str, y: str) -> Column:
    """Nor do the signatures: of the words in all, or by halves if both sets are long."""
    every = F.col(f"{x}.odd").bitwiseXOR(F.col(f"{y}.odd"))
    half = F.col(f"{x}.odd_half").bitwiseXOR(F.col(f"{y}.odd_half"))
    x_size, y_size = _size_in(F.col(f"{x}.where")), _size_in(F.col(f"{y}.where"))
    differ = F.when(F.least(x_size, y_size) > LONG, F.bit_count(half) + F.bit_count(every.bitwiseXOR(half))).otherwise(F.bit_count(every))
    # With similarity 0.8, sets of a and b words differ in (a+b)/9 at most.
    return _may_be_first(F.col(f"{x}.where"), F.col(f"{y}.where")) & (differ * 9 <= x_size + y_size)


def hub_pairs(sets: DataFrame) -> DataFrame:
    """(x, y): each set with the earliest one of its prefix words, if they have
    ``HUB_SHARE`` of them in common. Nothing rests on this share: sets that meet
    no hub stay open."""
    entries = sets.select("no", "size", F.posexplode("prefix").alias("place", "word")).select("word", "no", _where().alias("where"))
    earlier = Window.partitionBy("word").orderBy("no")
    met = entries.select("no", "where", F.first("no").over(earlier).alias("x"), F.first("where").over(earlier).alias("x_where"))
    near = met.where((F.col("x") < F.col("no")) & _in_reach(F.col("x_where"), F.col("where")))
    shared = near.groupBy("x", F.col("no").alias("y")).agg(F.count(F.lit(1)).alias("words"), F.first("where").alias("where"))
    return shared.where(F.col("words") >= _prefix_size(_size_in(F.col("where"))) * HUB_SHARE).select("x", "y")


def open_pairs(entries: DataFrame) -> DataFrame:
    """(x, y): each set that is not settled with all earlier ones that share a word of the prefix."""
    x, y = entries.alias("x"), entries.alias("y")
    # Said of both sides at once, as a filter of one would make a second exchange: a settled set's number falls below all others.
    earlier = F.col("x.no") < F.col("y.no") - F.col("y.where").bitwiseAND(F.lit(SETTLED))
    near = x.join(y, (F.col("x.word") == F.col("y.word")) & earlier & _may_be_similar("x", "y"))
    return near.select(F.col("x.no").alias("x"), F.col("y.no").alias("y")).distinct()


def _flag_table(buckets: DataFrame) -> Column:
    """A byte per bucket, 1 for those of ``bucket``: one value of fixed size, as a scalar subquery."""
    marks = buckets.select(F.col("bucket").cast("long").alias("id")).distinct().withColumn("mark", F.lit("01"))
    filled = buckets.sparkSession.range(FLAGS).join(marks, "id", "left")
    block = F.shiftright(F.col("id"), 10)

    def joined(value: str) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", value))), lambda part: part[value]), "")

    filled = filled.select(block.alias("block"), "id", F.coalesce("mark", F.lit("00")).alias("mark"))
    blocks = filled.groupBy("block").agg(joined("mark").alias("marks")).withColumnRenamed("block", "id")
    return blocks.agg(F.unhex(joined("marks")).alias("flags")).scalar()


def _bucket(*names: str) -> Column:
    return F.pmod(F.xxhash64(*names), F.lit(FLAGS)).cast("int")


def similar_sets(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The later sets of the pairs whose full sets are similar, as ``y``; only
    texts that hold sets of ``pairs`` are cut into lines again."""
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("no")).distinct()
    places = stored(sets.select("no", "first").join(wanted, "no").select("no", "first.*"), "wanted-lines")
    buckets = places.select(F.explode(F.array(_bucket(*ROW[:2]), _bucket(*ROW))).alias("bucket"))
    flags = _flag_table(buckets)

    def flagged(*names: str) -> Column:
        return F.substring(flags, _bucket(*names) + 1, F.lit(1)) == F.lit(b"\x01")

    maybe = _lines(texts.where(flagged(*ROW[:2]))).where(flagged(*ROW))
    hashes = maybe.select(*ROW, F.array_distinct(_hashes()).alias("hashes")).alias("l").join(
        places.alias("p"),
        F.col("l.doc_id").eqNullSafe(F.col("p.doc_id"))
        & (F.col("l.text_hash") == F.col("p.text_hash"))
        & (F.col("l.line_no") == F.col("p.line_no")),
    )
    full = stored(hashes.groupBy("no").agg(F.first("hashes").alias("hashes")), "wanted-sets")
    left = full.select(F.col("no").alias("x"), F.col("hashes").alias("x_set"))
    right = full.select(F.col("no").alias("y"), F.col("hashes").alias("y_set"))
    shared = F.size(F.array_intersect("x_set", "y_set"))
    together = F.size("x_set") + F.size("y_set") - shared
    similar = pairs.join(left, "x").join(right, "y").where(shared * 100 >= together * PERCENT)
    return stored(similar.select("y").distinct(), "later-sets")


def repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document that loses lines: ``doc_id, text_hash, removed``, the line numbers from 0."""
    texts = _texts(docs, id_column, text_column)
    placed = stored(line_sets(_lines(texts), rarity_table(texts)), "line-sets")
    sets = distinct_sets(placed)
    nothing = docs.sparkSession.createDataFrame([], "y bigint")
    hubs = stored(hub_pairs(sets), "hub-pairs")
    settled = nothing if hubs.isEmpty() else similar_sets(hubs, sets, texts)
    marked = sets.join(settled.select(F.col("y").alias("no"), F.lit(True).alias("settled")), "no", "left")
    others = stored(open_pairs(_entries(marked.withColumn("settled", F.coalesce("settled", F.lit(False))))), "open-pairs")
    later = settled if others.isEmpty() else settled.unionByName(similar_sets(others, sets, texts))
    # Of sets that several lines have, all lines but the first go; of a set with an earlier similar one, the first too.
    several = sets.where("lines > 1").select("set_id", "first")
    repeats = placed.select(*ROW, "set_id").join(several, "set_id").where(F.struct(*ROW) > F.col("first")).select(*ROW)
    firsts = sets.select("no", "first").join(later.select(F.col("y").alias("no")).distinct(), "no").select("first.*")
    return repeats.unionByName(firsts).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def _with_removed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Each row (``row``) with the numbers of the lines removed from it, ``gone``, or null."""
    removed = repeated_lines(docs, id_column, text_column)
    removed = removed.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("removed").alias("gone"))
    rows = folded(docs, own_id=F.col(f"`{id_column}`"), own_hash=text_hash(F.col(f"`{text_column}`")))
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash"))
    return rows.join(removed, same, "left")


def line_digest(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_lines, n_removed, removed_lines``."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    # Only ids, hashes and counts meet what is removed, no texts.
    slim = docs.select(
        F.col(f"`{id_column}`").alias("doc_id"),
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        text_hash(F.col(f"`{text_column}`")).alias("own_hash"),
    )
    removed = repeated_lines(docs, id_column, text_column)
    removed = removed.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("removed").alias("gone"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash"))
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    return slim.join(removed, same, "left").select(
        "doc_id", "n_lines", F.size(gone).cast("long").alias("n_removed"), F.array_join(gone, ",").alias("removed_lines")
    )


def drop_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken out of the text; all rows stay."""
    rows = _with_removed(docs, id_column, text_column)
    text = F.col("row").getField(text_column)
    lines = F.filter(F.split(text, "\n"), lambda _, at: ~F.array_contains("gone", at))
    return unfolded(rows, docs, **{text_column: F.when(F.col("gone").isNull(), text).otherwise(F.array_join(lines, "\n"))})
