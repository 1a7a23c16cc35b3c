"""Repeated passages: which windows are counted, and edits held against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from folioscale.llm import substrings
from folioscale.llm.substrings import PART_FIELDS, counted_runs, counted_windows, recurring_parts, remove_repeats


def counted(texts, window=35, phrase=5, buckets=3):
    """The numbers of runs and of windows that one shard counts."""
    table = pa.table({"text": pa.array(texts, pa.string())})
    with np.errstate(over="ignore"):
        runs = counted_runs(0, table, buckets, window, phrase)
        parts = [recurring_parts(runs.filter(pa.compute.equal(runs["bucket"], bucket))) for bucket in sorted(set(runs["bucket"].to_pylist()))]
        windows = counted_windows(0, table, pa.concat_tables(parts), buckets, window, phrase)
    return [sum(len(part) // 8 for part in found["hashes"].to_pylist()) for found in (runs, windows)]


def test_phrases_that_recur_by_chance_count_no_windows():
    draw = random.Random(3)
    phrases = [" ".join(f"p{number}w{at}" for at in range(8)) for number in range(200)]
    # Every phrase of five words is found several times; a run of twenty is part of three and is not.
    texts = [" ".join(draw.choice(phrases) for _ in range(40)) for _ in range(30)]
    runs, windows = counted(texts)
    assert runs > 0 and windows == 0
    runs, windows = counted([*texts, " ".join(texts[0].split()[:100])])
    assert 66 <= windows <= 100  # those of the copy, and few that overlap it


@pytest.mark.parametrize("chunk", [40, 1 << 17])
def test_edited_copies_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(substrings, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 3000)
    draw = random.Random(7)
    texts = [" ".join(draw.choice("abcdefgh") * draw.randrange(1, 3) for _ in range(draw.randrange(0, 90))) for _ in range(40)]
    for _ in range(60):
        words = draw.choice(texts).split()
        for _ in range(draw.randrange(3)):
            words.insert(draw.randrange(len(words) + 1), "edit")
        texts.append(" ".join(words[draw.randrange(5) :]))
    texts += ["same " * 80, "", None, "x " * 12, "x " * 13]
    window, phrase = 13, 3
    split = [(text or "").split() for text in texts]
    starts = Counter(tuple(words[at : at + window]) for words in split for at in range(len(words) - window + 1))
    expected = {}
    for number, words in enumerate(split):
        gone = {at + k for at in range(len(words) - window + 1) if starts[tuple(words[at : at + window])] > 1 for k in range(window)}
        expected[number] = (len(words), len(gone), " ".join(word for at, word in enumerate(words) if at not in gone))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    found = {row["doc_id"]: (row["n_words"], row["n_removed"], row["kept_text"]) for row in remove_repeats(docs, window, phrase).collect()}
    assert found == expected and sum(gone for _, gone, _ in expected.values()) > 500


def test_a_bucket_without_recurring_values_gives_nothing():
    part = [(0, shard, np.array([shard, 9 + shard], np.uint64).tobytes(), bytes(2), [], b"") for shard in (1, 2)]
    table = pa.Table.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*part), PART_FIELDS)], schema=PART_FIELDS)
    assert recurring_parts(table).num_rows == 0
