"""Manifest, classifier and token alignment against brute force on small tables."""

import hashlib
import random
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioscale.llm import manifest, pieces
from folioscale.llm.alignment import SPACE, Aligner, Tokenizers, align_documents, alignment_digest, pair_counts
from folioscale.llm.classifier import BINS, classify, estimated_prior, figures_of
from folioscale.llm.manifest import BLOCK, build_manifest, folded, verified_digest
from folioscale.llm.queries import BYTE_BPE, PIECE_BPE, QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- Merkle manifest -------------------------------------------------------

MANIFEST_SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, payload int, tree string"


def leaf_of(row, text):
    values = (row[0], row[1], row[2], row[3], text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 8])) for i in range(0, len(below), 8)])
    return levels


def path_of(levels, index):
    path = []
    for level in levels[:-1]:
        start = index // 8 * 8
        path.append(("".join(level[start:index]), "".join(level[index + 1 : start + 8])))
        index //= 8
    return path


def brute_manifest(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    names = sorted(groups, key=lambda name: (name is not None, (name or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[4])))
        trees[name] = levels_of([leaf_of(r, r[4]) for r in groups[name]])
    top = levels_of([trees[name][-1][0] for name in names])
    result = []
    for position, name in enumerate(names):
        for index, row in enumerate(groups[name]):
            path = path_of(trees[name], index) + path_of(top, position)
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                text = text.translate(LOWER)
            node = leaf_of(row, text)
            for before, after in path:
                node = sha(before + node + after)
            proof = sha("".join(before + after for before, after in path))
            root = top[-1][0]
            result.append((row[0], leaf_of(row, row[4]), trees[name][-1][0], root, proof, node, node == root))
    return result


def check_manifest(spark, rows):
    docs = spark.createDataFrame([(*row, "clash", 7, "clash") for row in rows], MANIFEST_SCHEMA)
    got = Counter(map(tuple, verified_digest(docs.repartition(3)).collect()))
    assert got == Counter(brute_manifest(rows))


def test_manifest_with_nulls_ties_and_repeated_rows(spark):
    rows = [(n, f"src{n % 3}", "en", n * 7, f"Text {n} Ä") for n in range(75)]
    rows += [(n, None, None, None, None) for n in (3, 4)] + [(None, "s", "en", 1, "No Id"), (None, "s", "en", 1, "No Id")]
    rows += [(5, "tie", "en", 1, "Another With The Same Id"), (9, "s", "", 2, ""), (1, "s", "Zz", 2, "Lone"), (2, "s", "é", 2, "x" * 50_000)]
    rows += [(100 + n, "s", f"lang{n}", 1, "One Leaf") for n in range(12)]
    check_manifest(spark, rows)


def test_manifest_climbs_beyond_one_block(spark, monkeypatch):
    # Blocks of 8 nodes and one level: trees of 5 rounds.
    monkeypatch.setattr(manifest, "LEVELS", 1)
    monkeypatch.setattr(manifest, "BLOCK", 8)
    rows = [(n, "s", "en" if n % 3 else "de", n, f"Row {n}") for n in range(700)]
    rows += [(n, "s", f"l{n}", n, "Few") for n in range(20)]
    check_manifest(spark, rows)


@pytest.mark.parametrize("count", [1, 8, 9, BLOCK, BLOCK + 1])
def test_manifest_at_the_edges_of_runs_and_blocks(spark, count):
    check_manifest(spark, [(n, "s", "en", n, "T") for n in range(count)])


def test_manifest_of_one_hot_row_and_of_nothing(spark):
    check_manifest(spark, [(7, "s", "en", 1, "Same")] * 600 + [(n, "s", "fr", 1, "T") for n in range(5)])
    empty = spark.createDataFrame([], MANIFEST_SCHEMA)
    assert verified_digest(empty).count() == 0


def test_proofs_lead_to_the_root_and_show_any_change(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(n, "s", "en", n, f"t{n}") for n in range(30)], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    proofs = build_manifest(docs)
    checked = proofs.select(
        (folded(F.col("leaf"), F.col("segments")) == F.col("root")).alias("own"),
        (folded(F.sha2(F.lit("x"), 256), F.col("segments")) == F.col("root")).alias("other"),
    ).collect()
    assert {tuple(row) for row in checked} == {(True, False)}


# --- Quality classifier ----------------------------------------------------


def test_classifier_on_held_out_labels(spark):
    result = {row["doc_id"]: row for row in QUERIES["op12_quality_classifier"](spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(result) == spark.read.parquet(f"{SF}/documents.parquet").count()
    judged = [(row["quality"], result[row["doc_id"]]) for row in labels if result[row["doc_id"]]["held_out"]]
    assert len(judged) > 80
    assert all(row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 3 == 1) for row in result.values())
    assert sum(quality == row["predicted"] for quality, row in judged) / len(judged) > 0.95
    bad, good = ([row["score"] for quality, row in judged if quality == kind] for kind in (0, 1))
    assert np.mean([one < other for one in bad for other in good]) > 0.98  # area under the curve


def test_classifier_never_sees_held_out_or_bad_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    expected = sorted(map(tuple, classify(docs, labels).collect()))
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) as quality")
    without_bad = flipped.where("quality = 1 or crc32(cast(doc_id as string)) % 3 = 1")
    assert sorted(map(tuple, classify(docs, without_bad).collect())) == expected


def test_classifier_edge_cases(spark):
    schema = "doc_id bigint, text string, score string, figures int, row string, held_out string"
    texts = [(n, f"Some plain words number {n} stand here, and they go on. " * 5) for n in range(60)]
    texts += [(100 + n, "BUY!! NOW!! " * 40) for n in range(20)] + [(None, "no id"), (None, "no id"), (200, None), (201, ""), (202, "z" * 300_000), (3, texts[3][1])]
    docs = spark.createDataFrame([(*row, "clash", 1, "clash", "clash") for row in texts], schema)
    labels = spark.createDataFrame(
        [(n, 1, 0) for n in range(40)] + [(5, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int"
    )
    rows = classify(docs, labels).collect()
    assert sorted(Counter(row["doc_id"] for row in rows).items(), key=str) == sorted(Counter(n for n, _ in texts).items(), key=str)
    assert all(0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.5) for row in rows)
    by_id = {row["doc_id"]: row["score"] for row in rows}
    assert by_id[200] == by_id[201] and not next(row for row in rows if row["doc_id"] is None)["held_out"]
    assert max(by_id[100 + n] for n in range(20)) < min(by_id[n] for n in range(60))
    unknown = classify(docs, labels.where("quality = 0")).collect()
    assert {(row["score"], row["predicted"]) for row in unknown} == {(0.5, 1)}
    assert classify(docs.where("false"), labels).count() == 0
    assert classify(docs, labels.where("false")).count() == len(texts)


def test_prior_is_found_from_the_histograms():
    random.seed(3)
    for prior in (0.3, 0.6, 0.9):
        good = np.bincount([min(BINS - 1, int(BINS * random.betavariate(6, 2))) for _ in range(20_000)], minlength=BINS)
        bad = np.bincount([min(BINS - 1, int(BINS * random.betavariate(1, 9))) for _ in range(20_000)], minlength=BINS)
        found = estimated_prior(good.astype(float), prior * good + (1 - prior) * bad)
        assert abs(found - prior) < 0.05


def test_figures_of_odd_texts():
    for text in (None, "", " \n\t"):
        assert set(figures_of(text)) == {0.0}
    for text in ("a", "\x85", "😀", "ß" * 9, "!?!", "a\n\n\nb\r\n", "　x"):
        assert all(np.isfinite(figures_of(text)))


# --- Token alignment -------------------------------------------------------


@pytest.fixture(scope="module")
def source():
    return Tokenizers(BYTE_BPE, PIECE_BPE)


def brute_alignment(source, texts):
    bpe, pieces = source.load()
    a_bytes, b_bytes = source.token_bytes()
    counts, found = Counter(), []
    for text in texts:
        a = bpe.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        own = f" {text}".encode()
        if not text or b"".join(a_bytes[n] for n in a) != own or b"".join(b_bytes[n] for n in b) != own:
            found.append(None)
            continue
        a_ends = {sum(len(a_bytes[n]) for n in a[: k + 1]): k for k in range(len(a))}
        b_ends = {sum(len(b_bytes[n]) for n in b[: k + 1]): k for k in range(len(b))}
        groups, links, i, j = [], [], 0, 0
        for end in sorted(a_ends.keys() & b_ends.keys()):
            next_i, next_j = a_ends[end] + 1, b_ends[end] + 1
            groups.append(f"{','.join(map(str, a[i:next_i]))}|{','.join(map(str, b[j:next_j]))}")
            links.append((a[next_i - 1], b[next_j - 1]))
            i, j = next_i, next_j
        counts.update(links)
        found.append((len(a), len(b), groups, links))
    highest = defaultdict(int)
    for (_, b), count in counts.items():
        highest[b] = max(highest[b], count)
    rows = []
    for item in found:
        if item is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = item
        best = sum(counts[link] == highest[link[1]] for link in links)
        total = sum(counts[link] for link in links)
        rows.append((n_a, n_b, len(groups), len(links), best, total, sha(";".join(groups))))
    return rows


TEXTS = [
    "The quick brown fox jumps over the lazy dog.",
    "  leading and   inner    spaces \n\n\t tabs\r\n",
    "naïve café — “quotes” … 日本語テキスト 😀👩‍👩‍👧 ​　x",
    "<|endoftext|> <s> </s> <unk> <0x41> [INST] are plain",
    "a▁b holds the sign itself",
    "\x00\x01 control \x7f signs � and ퟿",
    None,
    "",
    " ",
    "\n",
    "x",
    "word " * 5000 + "long" * 4000,
    "The quick brown fox jumps over the lazy dog.",
    "".join(chr(code) for code in range(32, 1200)),
]


def digest_rows(frame):
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return [(row["doc_id"], *[row[name] for name in columns]) for row in frame.collect()]


def test_alignment_equals_brute_force(spark, source):
    ids = [n if n != 2 else None for n in range(len(TEXTS) - 1)] + [0]  # one null, one repeated
    rows = [(doc_id, text, "clash", 5, "clash") for doc_id, text in zip(ids, TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, links string, n_a int, groups string")
    got = digest_rows(alignment_digest(docs.repartition(3), source))
    expected = [(doc_id, *row) for doc_id, row in zip(ids, brute_alignment(source, TEXTS))]
    assert Counter(got) == Counter(expected)
    assert sum(row[-1] == "" for row in got) == 3  # null, empty, and the one with the sign
    assert alignment_digest(docs.where("false"), source).count() == 0


def test_alignment_of_documents_equals_brute_force(spark, source):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((row["doc_id"], row["text"]) for row in docs.select("doc_id", "text").where("n_chars < 3000").collect())
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    expected = [(doc_id, *row) for (doc_id, _), row in zip(rows, brute_alignment(source, [text for _, text in rows]))]
    assert sorted(digest_rows(alignment_digest(table, source))) == expected


def test_alignment_of_random_bytes_and_a_full_memory(source):
    random.seed(5)
    aligner = Aligner(source, remembered=3)
    texts = ["".join(random.choice("ab é\n☃  .,1") for _ in range(random.randrange(1, 60))) for _ in range(300)]
    bare = brute_alignment(source, texts)
    for text, row in zip(texts, bare):
        a, b, verified = aligner.encode([text])[0]
        groups, links = aligner.documents([(a, b)])[0]
        assert verified
        assert (len(a), len(b), len(links), sha(groups)) == (row[0], row[1], row[3], row[6])
        assert len(aligner.known) < 3 + text.count(" ") + 1


def test_texts_are_encoded_whole_though_parts_are_remembered(source):
    random.seed(6)
    aligner = Aligner(source)
    signs = " \u00a0\u3000\x1c\x85\t\n\r'sté1٣½日😀.,!_-'\u0301"
    texts = ["".join(random.choice(signs) for _ in range(random.randrange(1, 80))) for _ in range(3000)]
    texts += [text for text in TEXTS if text] + ["a  b   c ", " a b ", "it's 'quoted' it 's", "x 1 2 ½ ٣ y"]
    bpe, pieces = source.load()
    assert not aligner.whole_only
    for text, (a, b, verified) in zip(texts, aligner.encode(texts)):
        assert verified == (SPACE not in text)
        assert a.tolist() == bpe.encode(f" {text}", add_special_tokens=False).ids, text
        assert b.tolist() == pieces.encode(text), text


def test_pairs_are_bounded_by_the_vocabularies(spark, source):
    docs = spark.createDataFrame([(n, text) for n, text in enumerate(TEXTS)], "doc_id bigint, text string")
    a_bytes, b_bytes = source.token_bytes()
    found = align_documents(docs, source, keep_groups=True)
    for row in pair_counts(found, len(b_bytes)).collect():
        one, other = a_bytes[row["link"] // len(b_bytes)], b_bytes[row["link"] % len(b_bytes)]
        assert one.endswith(other) or other.endswith(one)
    assert source.most_pairs() < 1_000_000
    assert all(sha(row["groups"]) == row["groups_sha256"] for row in found.where("n_links > 0").collect())


def test_pieces_do_not_shuffle_segments(spark, monkeypatch):
    sentencepiece = pytest.importorskip("sentencepiece")
    library, model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.PieceModel()
    rows = [(n, f"A word{n}, and  anoth\u00e9r:\n\tthe {'x' * n} \u65e5\u672c \u2581 end.{n} ") for n in range(90)] + [(90, None), (90, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    results = []
    for most in (1 << 16, 0):  # with and without a dictionary
        monkeypatch.setattr(pieces, "FREQUENT", most)
        result = pieces.encoded_digest(docs, model)
        assert "Exchange" not in result._jdf.queryExecution().executedPlan().toString()
        results.append(sorted(result.collect()))
    assert results[0] == results[1]
    assert [list(row["ids"]) for row in results[0]] == [library.encode(text or "") for _, text in rows]
    parts = pieces.encode_documents(docs, model)
    sums = parts.groupBy("doc_id").agg(F.sum(F.xxhash64("position", "ids").bitwiseAND(F.lit((1 << 31) - 1))).alias("sum"))
    assert {tuple(row) for row in sums.collect()} == {(row["doc_id"], row["ids_sum"]) for row in results[0][:90]}
