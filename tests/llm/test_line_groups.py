"""Line dedup on groups of lines that nearly equal each other."""

import random

from folioscale.llm import line_dedup
from folioscale.llm.line_dedup import line_digest


def brute_force(lines):
    """Which lines have an earlier one at 0.8 or more."""
    sets = [frozenset(line.split()) for line in lines]
    return [any(5 * len(own & other) >= 4 * len(own | other) for other in sets[:at]) for at, own in enumerate(sets)]


def removed(spark, lines):
    docs = spark.createDataFrame([(at, line) for at, line in enumerate(lines)], "doc_id bigint, text string").repartition(4)
    return {row["doc_id"] for row in line_digest(docs).collect() if row["n_removed"]}


def spy_on_pairs(monkeypatch):
    """Counts the pairs that are verified."""
    counts, verify = [], line_dedup.similar_sets

    def counted(pairs, *rest):
        counts.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(line_dedup, "similar_sets", counted)
    return counts


def test_a_large_group_makes_few_pairs(spark, monkeypatch):
    words = [f"base{n}" for n in range(40)]
    lines = [" ".join(words)]
    for number in range(2000):
        edited = list(words)
        edited[number % 40] = f"edit{number}"
        lines.append(" ".join(edited))
    random.Random(2).shuffle(lines)
    counts = spy_on_pairs(monkeypatch)
    assert removed(spark, lines) == set(range(1, 2001))
    assert sum(counts) <= 10 * len(lines)  # all pairs would be 2 million


def test_chains_and_near_misses_equal_brute_force(spark):
    draw = random.Random(9)
    lines = []
    for group in range(12):
        words = [f"g{group}w{n}" for n in range(draw.randrange(3, 30))]
        for _ in range(25):  # each line is an edit of the one before
            at = draw.randrange(len(words))
            words = [*words[:at], f"n{draw.randrange(10**6)}", *words[at + 1 :]] if draw.random() < 0.7 else words[: max(1, len(words) - 1)] + [f"x{draw.randrange(40)}"]
            lines.append(" ".join(words))
    lines += ["", "one", "one", "one two", "a b c d", "a b c d e", "a b c d e f"]
    draw.shuffle(lines)
    expected = {at for at, gone in enumerate(brute_force(lines)) if gone and lines[at]}
    assert removed(spark, lines) == expected and len(expected) > 100


def test_small_groups_make_no_pair_of_all_their_lines(spark, monkeypatch):
    # Forty lines of a group are too few to be frequent words; they still meet the earliest only.
    draw, lines = random.Random(5), []
    for group in range(30):
        words = [f"g{group}w{at}" for at in range(40)]
        for number in range(40):
            edited = list(words)
            edited[number] = f"g{group}edit{number}"
            lines.append(" ".join(edited))
    draw.shuffle(lines)
    counts = spy_on_pairs(monkeypatch)
    expected = {at for at, gone in enumerate(brute_force(lines)) if gone}
    assert removed(spark, lines) == expected and len(expected) == 30 * 39
    assert sum(counts) <= 3 * len(lines)  # all pairs would be 23,400


def test_open_sets_meet_over_one_shuffle(spark):
    settled = line_dedup.SETTLED
    rows = [(7, 1, 5, 0, 0), (7, 2, 5 | settled, 0, 0), (7, 3, 5, 0, 0), (7, 4, 5, 63, 0), (7, 5, 1 << 32 | 5, 0, 0), (9, 6, 5, 0, 0)]
    entries = spark.createDataFrame(rows, "word int, no bigint, where bigint, odd bigint, odd_half bigint").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = line_dedup.open_pairs(line_dedup.stored(entries, "entries"))
        # 2 is an earlier side only, the signature of 4 is far from all, after its place 5 has too few words left.
        assert {tuple(row) for row in pairs.collect()} == {(1, 3), (2, 3)}
        assert "ReusedExchange" in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
