"""Text operators against brute force on small tables with nulls, ties, repeats and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from folioscale.llm.decontam import contamination_digest, decontaminate, judged
from folioscale.llm.licenses import license_digest, scan_licenses
from folioscale.llm.line_dedup import drop_repeated_lines, line_digest
from folioscale.llm.neardup import near_duplicates
from folioscale.llm.pieces import MODEL, PieceModel, decode_ids, encode_documents, encoded_digest, merged
from folioscale.llm.pii import find_personal_data, find_spans, personal_data_digest
from folioscale.llm.quality import clean_documents, quality_digest, quality_facts
from folioscale.llm.sharding import assign_shards
from folioscale.llm.substrings import remove_repeats, repeats_digest
from folioscale.llm.warc import (
    archive_digest,
    archive_pages,
    arc_opening,
    arc_record,
    converted,
    mark_revisits,
    pages_to_arc,
    arc_to_warc,
    read_arc,
    warc_date,
)

WORD = re.compile(r"[^\x20\x09-\x0d]+")
PASSAGE = " ".join(f"word{n}" for n in range(60))
PROSE = " ".join(f"plain{n % 97} text{n % 89}" for n in range(70)) + "."
SCHEMA = "doc_id bigint, text string, spans string, kept string, shard int"


def lowered(text):
    return re.sub("[A-Z]", lambda sign: sign.group().lower(), text or "")


def texts():
    near = [word if n % 40 else f"other{n}" for n, word in enumerate(PROSE.split())]
    return [
        (1, PROSE),
        (2, " ".join(near)),
        (3, None),
        (4, ""),
        (5, "Mail a.b@c.example.org, call +1 (212) 555-1234 or 10.0.0.1 or 4111 1111 1111 1111."),
        (6, f"first line\n{PASSAGE}\nThe MIT License and the Apache License.\nfirst line"),
        (7, f"other start {PASSAGE} other end\nGNU General Public License"),
        (7, f"other start {PASSAGE} other end\nGNU General Public License"),
        (None, "no id here\nfirst line"),
        (8, "again and again and again and " * 40),
        (9, "x" * 5000 + " é ▁ 日本 😀\ttab\n\n" + "lone " * 3),
        (10, "### %%% *** $$$ &&& |||\n" * 30),
        (11, PROSE),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(number, text, "clash", "clash", 7) for number, text in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(rows):
    return Counter(map(tuple, rows))


def test_personal_data(docs, empty):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(digits):
        values = [int(d) * (1 + n % 2) for n, d in enumerate(reversed(digits))]
        return sum(v - 9 * (v > 9) for v in values) % 10 == 0

    def fits(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(part) <= 255 for part in found.split("."))
        if kind == "card":
            return 12 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    def base(text):
        return sorted(
            (m.start(), list(patterns).index(kind), m.end())
            for kind, pattern in patterns.items()
            for m in re.finditer(pattern, text or "")
            if fits(kind, m.group())
        )

    tricky = [
        "a@b@c.de f@g.h@i.jk x@y @z.de a@b.c@d.e ü@b.cd q@w.e.r-t",
        "1.2.3.4.5.6.7.8 1..2.3.4.5 256.1.1.1 001.002.003.004 9999999.1.1.1.1",
        "4111-1111-1111-1111 4111  1111 1111 1111 411111111111111111111111 12 34",
        "+1 2 3 +12(3)4-5.678 901 + 12345678901 ++49 30 1234567 +",
    ]
    for text in tricky + [text for _, text in texts()]:
        found = [(s["start"], s["kind"], s["stop"]) for s in find_spans(text) if s["kind"] in patterns]
        assert found == [(start, list(patterns)[kind], stop) for start, kind, stop in base(text)]
    result = personal_data_digest(find_personal_data(docs)).collect()
    assert len(result) == len(texts())
    row = next(r for r in result if r["doc_id"] == 5)
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 1, 1)
    listed = ",".join(f"{list(patterns)[k]}:{s}:{e}" for s, k, e in base(texts()[4][1]))
    assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
    assert personal_data_digest(find_personal_data(empty)).count() == 0


def test_personal_data_of_the_method():
    kinds = [s["kind"] for s in find_spans('see HTTPS://a.example/x?y=1, token = "0123456789abcdef0123", 12 Main Street, Springfield')]
    assert kinds == ["url", "secret", "address"]
    assert [s["value"] for s in find_spans("IBAN: DE89 3704 0044 0532 0130 00.")][-1].startswith("DE89")
    assert find_spans("The street was long and the road too; a token of thanks.") == []


def test_licenses(docs, empty):
    phrases = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
    expected = Counter()
    for number, text in texts():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        places = [
            (at, label)
            for label, phrase in phrases.items()
            for at in range(len(words))
            if words[at : at + len(phrase.split())] == phrase.split()
        ]
        starts = [at for at, _ in places]
        labels = ",".join(sorted({label for _, label in places}))
        expected[number, len(words), len(places), min(starts, default=None), max(starts, default=None), labels] += 1
    result = license_digest(scan_licenses(docs))
    assert bag(result.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()) == expected
    assert all(0 <= row["score"] <= 1 for row in result.collect())
    assert license_digest(scan_licenses(empty)).count() == 0


def test_license_template(spark):
    text = "x Redistribution and use in source and binary forms, with or without changes y"
    rows = spark.createDataFrame([(1, text), (2, "source and binary forms")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["labels"] for r in license_digest(scan_licenses(rows)).collect()} == {1: "bsd", 2: ""}


def test_license_names(spark):
    notices = {
        "Licensed under CC BY-NC 4.0.": "cc",
        "Licensed under CC BY 4.0": "cc",
        "CC-BY-SA-3.0": "cc",
        "text under a Creative Commons Attribution-NonCommercial 4.0 International": "cc",
        "licensed under the GNU Lesser General Public License": "gpl,lgpl",
        "licensed under the Mozilla Public License v 2.0": "mpl",
        "GNU Affero General Public License": "agpl,gpl",
        "SPDX-License-Identifier: MPL-2.0": "mpl",
        "SPDX-License-Identifier: MIT": "mit",
        "SPDX-License-Identifier: Apache-2.0 OR BSD-3-Clause": "apache,bsd",
        "SPDX-License-Identifier: LGPL-2.1-only": "lgpl",
        "GPLv3": "gpl",
        "released under the ISC license": "isc",
        "CC0-1.0": "cc0",
        "Released under the MIT License.": "mit",
        "please cc by mail, a public license, clause 3": "",
    }
    rows = spark.createDataFrame(list(enumerate(notices)), "doc_id bigint, text string")
    found = {row["doc_id"]: row for row in license_digest(scan_licenses(rows)).collect()}
    assert [found[n]["labels"] for n in range(len(notices))] == list(notices.values())
    assert all((row["score"] == 1.0) == (row["labels"] != "") for row in found.values())
    # The phrases of the base columns are as they were.
    assert [n for n, row in found.items() if row["n_base"]] == [4, 6, 14]


def test_line_dedup(docs, empty, spark):
    def removed(rows):
        earlier, out = [], {}
        for number, text in sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0)):
            for at, line in enumerate((text or "").split("\n")):
                words = frozenset(WORD.findall(line))
                if not words:
                    continue
                if any(100 * len(words & other) >= 80 * len(words | other) for other in earlier):
                    out.setdefault(number, []).append(at)
                earlier.append(words)
        return out

    unique = {row: None for row in texts()}
    expected = removed(list(unique))
    result = line_digest(docs).collect()
    assert len(result) == len(texts())
    for row in result:
        assert row["removed_lines"] == ",".join(map(str, expected.get(row["doc_id"], []))), row
    cleaned = drop_repeated_lines(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(texts())
    assert line_digest(empty).count() == 0
    words = [f"w{n}" for n in range(30)]
    rows = [(n, " ".join(words[n % 7 :] + [f"u{n % 3}"] * (n % 4 > 0))) for n in range(40)]
    small = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r["n_removed"] for r in line_digest(small).collect()}
    assert found == {n: len(removed(rows).get(n, [])) for n, _ in rows}


def test_quality(docs, empty):
    expected = Counter()
    for number, text in texts():
        words, seen, again = WORD.findall(text or ""), set(), 0
        for line in (text or "").split("\n"):
            again += bool(WORD.search(line)) and line in seen
            seen.add(line)
        windows = Counter(tuple(words[at : at + 3]) for at in range(len(words) - 2))
        covered = {at + k for at in range(len(words) - 2) if windows[tuple(words[at : at + 3])] > 1 for k in range(3)}
        symbols = sum(sign in "#*$%&|<>" for sign in text or "")
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        expected[number, len(words), sum(map(len, words)), symbols, again, len(covered), failed] += 1
    result = quality_digest(quality_facts(docs))
    assert bag(r[:7] for r in result.collect()) == expected
    kept = clean_documents(docs)
    assert kept.columns == docs.columns
    assert {1, 2, 6, 7, 11} >= {row["doc_id"] for row in kept.collect()} >= {1, 2, 11}
    assert quality_digest(quality_facts(empty)).count() == 0


def test_decontamination(docs, empty, spark):
    items = [(1, PASSAGE), (2, "a quite different question about rivers and lakes in spring"), (3, None), (4, "short")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    result = contamination_digest(decontaminate(docs, benchmark)).collect()
    assert len(result) == len(texts())
    assert sorted(str(r["doc_id"]) for r in result if r["contaminated"]) == ["6", "7", "7"]
    assert {r["item_ids"] for r in result if r["contaminated"]} == {"1"}
    none = benchmark.where("false")
    assert not any(r["contaminated"] for r in contamination_digest(decontaminate(docs, none)).collect())
    assert decontaminate(empty, benchmark).count() == 0


def test_paraphrase_needs_its_answer(spark):
    words = [f"term{n}" for n in range(40)]
    changed = [word if n % 10 < 7 or n >= 30 else f"new{n}" for n, word in enumerate(words)]
    without = words[:28] + [f"new{n}" for n in range(12)]
    rows = [(1, "lead in " + " ".join(changed)), (2, " ".join(without)), (3, PROSE)]
    rows += [(number, f"filler{number}") for number in range(4, 60)]  # so that words have weights of a corpus
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(5, " ".join(words))], "item_id bigint, text string")
    found = {r["doc_id"]: r["contaminated"] for r in decontaminate(docs, benchmark).collect()}
    assert [number for number, bad in found.items() if bad] == [1]


def test_sentence_pieces(docs, empty, spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    library, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), PieceModel()
    expected = Counter()
    for number, text in texts():
        expected[number, len(library.encode(text or ""))] += 1
    result = encoded_digest(docs, model)
    assert bag(result.select("doc_id", "n_tokens").collect()) == expected
    assert all(row["round_trip"] for row in result.collect())
    once = spark.createDataFrame(list({n: (n, t) for n, t in texts() if n != 7}.values()), "doc_id bigint, text string")
    tokens = encode_documents(once, model)
    decoded = decode_ids(tokens, model, ["doc_id", "position"]).join(tokens.select("doc_id", "position", "ids"), ["doc_id", "position"])
    found = {}
    for row in sorted(decoded.collect(), key=lambda row: row["position"]):
        ids, parts = found.setdefault(row["doc_id"], ([], []))
        ids.extend(row["ids"])
        parts.append(row["decoded"])
    for number, text in once.collect():
        if number is not None and text:
            assert found[number][0] == library.encode(text)
            assert "".join(found[number][1]) == ("▁" + text).replace(" ", "▁")
    assert encoded_digest(empty, model).count() == 0


def test_sentence_pieces_of_whole_documents(docs, spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    library, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), PieceModel()
    expected = Counter()
    for number, text in texts():
        ids = library.encode(text or "")
        decoded = library.decode(ids)
        expected[number, tuple(ids), hashlib.sha256(decoded.encode()).hexdigest(), decoded == (text or "")] += 1
    result = encoded_digest(docs, model).select("doc_id", "ids", "decoded_sha256", "same_text").collect()
    assert Counter((row["doc_id"], tuple(row["ids"]), row["decoded_sha256"], row["same_text"]) for row in result) == expected
    # The one text with a U+2581 does not come back.
    assert [row["doc_id"] for row in result if not row["same_text"]] == [9]


def test_long_segments_follow_the_same_rule():
    sentencepiece = pytest.importorskip("sentencepiece")
    library, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), PieceModel()
    scores = {piece: (number, score) for piece, number, score in model.pieces}
    for text in ("a" * 300, "thereandback" * 20, "ñandú日本" * 30):
        assert merged("▁" + text, scores, model.byte_ids) == library.encode(text)


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, empty, width):
    sets = {}
    for number, text in texts():
        words = WORD.findall(lowered(text))
        grams = [tuple(words[at : at + width]) for at in range(len(words) - width + 1)] or [tuple(words)] * bool(words)
        sets[number] = frozenset(grams)
    label = {number: number for number in sets}
    for _ in sets:
        for a, first in sets.items():
            for b, second in sets.items():
                if first and second and 100 * len(first & second) >= 80 * len(first | second):
                    if None not in (label[a], label[b]):
                        label[a] = label[b] = min(label[a], label[b])
    result = near_duplicates(docs, width).collect()
    assert len(result) == len(texts())
    for row in result:
        assert (row["n_shingles"], row["component_id"]) == (len(sets[row["doc_id"]]), label[row["doc_id"]]), row
        assert row["kept"] == (row["doc_id"] == row["component_id"])
    assert near_duplicates(empty, width).count() == 0


def test_near_duplicates_around_an_original(spark):
    words = [f"v{n}" for n in range(200)]
    rows = [(0, " ".join(words))]
    for copy in range(1, 60):
        changed = list(words)
        changed[copy * 3] = changed[(copy * 3 + 90) % 200] = f"edit{copy}"
        rows.append((copy, " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {row["component_id"] for row in near_duplicates(docs, 4).collect()} == {0}


def test_sharding(docs, empty, spark):
    rows = assign_shards(docs, 4).collect()
    assert bag((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (n, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for n, t in texts()
    )
    slots = {}
    for row in rows:
        slots.setdefault(row["shard"], []).append(row["slot"])
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert bag(assign_shards(docs.repartition(5), 4).collect()) == bag(rows)
    assert assign_shards(empty).count() == 0
    many = spark.range(5000).selectExpr("id div 3 as doc_id", "cast(null as string) as text")
    counts = [row["count"] for row in assign_shards(many).groupBy("shard").count().collect()]
    assert len(counts) == 24 and max(counts) - min(counts) <= 1


def test_web_archive(spark):
    long = "<html>" + "é" * 800 + "</html>"
    rows = [(1, "http://a b/", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", long), (6, "", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {row["page_id"]: row[1:] for row in archive_digest(archive_pages(pages)).collect()}
    assert len(found) == len(rows)
    for number, _, html in rows:
        payload = (html or "").encode()
        target = 2 if html == long and number != 2 else None
        kind = "revisit" if target else "response"
        assert found[number] == (len(payload), hashlib.sha1(payload).hexdigest(), kind, target)
    assert archive_pages(pages.where("false")).count() == 0
    assert mark_revisits(arc_to_warc(pages_to_arc(pages))).where("record_type = 'revisit'").count() == 2


@pytest.mark.parametrize("version", [1, 2])
def test_legacy_archive(version):
    body = b"HTTP/1.1 200 OK\r\nX-Page-Id: 9\r\n\r\npay\nload"
    data = arc_opening("x.arc", "19990102030405", version) + arc_record("http://h/a b", "1999010203", body, version)
    ((fields, read),) = read_arc(data)
    record = converted(fields, read)
    assert (read, fields[0], record["page_id"], record["payload_bytes"]) == (body, "http://h/a b", 9, 8)
    assert record["warc_date"] == warc_date("1999010203") == "1999-01-02T03:00:00Z"
    assert record["record_id"] == converted(fields, read)["record_id"]
    with pytest.raises(ValueError):
        list(read_arc(data[:-5]))


def test_repeated_passages(docs, empty):
    window = 35
    split = [(number, WORD.findall(text or "")) for number, text in texts()]
    starts = Counter(tuple(words[at : at + window]) for _, words in split for at in range(len(words) - window + 1))
    expected = Counter()
    for number, words in split:
        gone = {at + k for at in range(len(words) - window + 1) if starts[tuple(words[at : at + window])] > 1 for k in range(window)}
        kept = " ".join(word for at, word in enumerate(words) if at not in gone)
        expected[number, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert bag(repeats_digest(remove_repeats(docs)).collect()) == expected
    assert remove_repeats(empty).count() == 0


@pytest.mark.parametrize("number", [200, 512])
def test_decontamination_loses_no_passage_of_a_large_block(spark, number):
    chance = random.Random(number)
    spoken = [f"w{n}" for n in range(3000)]
    often = [1 / (n + 3) for n in range(3000)]
    speak = lambda size: chance.choices(spoken, often, k=size)
    items, rows, expected = [], [], set()
    for item in range(number):
        words = speak(chance.randint(15, 59))
        items.append((item, " ".join(words)))
        # A copy, and a paraphrase with 45 % of the words replaced but its end kept.
        end = len(words) - max(3, len(words) // 4)
        changed = list(words)
        for at in chance.sample(range(end), int(0.45 * len(words))):
            changed[at] = f"other{chance.randrange(3000)}"
        for place, planted in enumerate((words, changed)):
            before, after = speak(chance.randint(20, 80)), speak(chance.randint(20, 80))
            rows.append((2 * item + place, " ".join(before + planted + after)))
            if judged(words, planted)[1]:
                expected.add((2 * item + place, item))
    assert len(expected) == 2 * number
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    result = decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    found = {(row["doc_id"], match["item_id"]): match for row in result for match in row["matches"]}
    assert not expected - set(found)
    texts_of, items_of = dict(rows), dict(items)
    for (doc, item), match in found.items():
        place = texts_of[doc].split()[match["start"] : match["stop"]]
        assert judged(items_of[item].split(), place) == (match["share"], match["kind"])


def test_decontamination_finds_what_brute_force_finds(spark):
    chance = random.Random(5)
    spoken = [f"w{n}" for n in range(40)]
    items = [(n, " ".join(chance.choices(spoken, k=chance.randint(5, 64)))) for n in range(60)]
    rows = [(n, " ".join(chance.choices(spoken, k=chance.randint(1, 150)))) for n in range(25)]
    expected = set()
    for doc, text in rows:
        words = text.split()
        for item, wanted in ((item, wanted.split()) for item, wanted in items):
            length, margin = next(size for size in (16, 32, 64) if size >= len(wanted)), len(wanted) // 4
            for at in range(0, len(words), length // 4):
                if judged(wanted, words[max(0, at - margin) : at + length + margin])[1]:
                    expected.add((doc, item))
    result = decontaminate(
        spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    )
    assert {(row["doc_id"], match["item_id"]) for row in result.collect() for match in row["matches"]} == expected != set()
