"""Licence notices, filter audit and spelling variants against plain versions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from coastgrid.llm import filter_audit, license_scan, spelling

ODD = ["", None, " ", "plain words", "ünï 漢字 \U0001f600 ends ", "a" * 5000, "tab\tand\r\nbreaks \x00", "word " * 3000, "x 1\n\n y", "CC BY cc-by"]
SCHEMA = "doc_id long, text string, source string, n_words long, labels string, mask int, part string, digest string, word string, n long"


@pytest.fixture(scope="module")
def table(spark):
    def build(texts, sources=("s",)):
        rows = [(n, t, sources[n % len(sources)]) if not isinstance(t, tuple) else t for n, t in enumerate(texts)]
        return spark.createDataFrame([(*r, 1, "x", 3, "p", "d", "w", 9) for r in rows], SCHEMA)

    return build


# Licence scan


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_starts(text):
    found = plain_words(text)
    starts, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        needed = phrase.split()
        for n in range(len(found)):
            if found[n : n + len(needed)] == needed:
                starts.append(n)
                labels.add(label)
    return len(found), starts, labels


def test_phrases_stand_where_a_plain_scan_finds_them(table):
    rng = random.Random(3)
    pool = "cc by all rights reserved general public license general CC-BY, ALL rights; reserved\n ünder × 漢 the of".split(" ")
    texts = ODD + [" ".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(150)] + ["cc " * 4000 + "by cc by"]
    docs = table(texts)
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs, license_scan.build_index(docs)).collect()}
    assert len(got) == len(texts)
    for n, text in enumerate(texts):
        size, starts, labels = plain_starts(text)
        row = got[n]
        assert (row["n_words"], row["n_base"]) == (size, len(starts))
        assert (row["first_word"], row["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert row["base_labels"] == ",".join(sorted(labels))
        assert labels <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1


NOTICES = [
    ("see LICENSE.\nLicensed under the Apache License, Version 2.0 (the \"License\")", {"apache-2.0"}),
    ("distributed under the MIT License", {"mit"}),
    ("der Hund ging mit der Lizenz weg, license", set()),
    ("licensed under CC BY-NC 4.0 here", {"cc-by", "cc-by-nc-4.0"}),
    ("licensed under CC BY 4.0", {"cc-by", "cc-by-4.0"}),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", {"cc-by-sa-4.0"}),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", {"gpl", "gpl-3.0"}),
    ("as published: GNU General Public License, version 2, and released under the MIT License; all rights reserved", {"gpl", "gpl-2.0", "mit", "reserved"}),
    ("the apache helicopter has version 2 0 of its licence", set()),
    ("license license license mit mit mit", set()),
]


@pytest.mark.parametrize("lead", ["", "word " * 5000, "the license under the license " * 300])
def test_notices_are_labelled_wherever_they_stand(table, lead):
    docs = table([lead + text for text, _ in NOTICES] + ["of the " * 50])
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(docs, license_scan.build_index(docs)).collect()}
    for n, (_, labels) in enumerate(NOTICES):
        assert set(filter(None, got[n].split(","))) == labels, NOTICES[n]


def plain_share(index, n, found):
    """The best share of template n at any start, without look-ups by rarity."""
    _, by_rarity, demanded = index.templates[n]
    total, best, d = sum(x[0] for x in by_rarity), 0.0, index.drift
    for start in range(-60, len(found)):
        near = lambda w, p: w in found[max(0, start + p - d) : max(0, start + p + d + 1)]
        share = sum(weight for weight, p, w in by_rarity if near(w, p)) / total
        stands = all(any(s + start >= 0 and found[start + s : start + s + len(ws)] == ws for s in range(at - d, at + d + 1)) for ws, at in demanded)
        if share >= index.share and stands:
            best = max(best, share)
    return best


def test_no_template_is_missed_by_the_look_up(table):
    rng = random.Random(5)
    texts = []
    for template in license_scan.TEMPLATES * 2:
        told = template.text.split()
        for _ in range(rng.randrange(4)):  # a word less or more
            at = rng.randrange(len(told))
            told[at : at + 1] = [] if rng.random() < 0.5 else [told[at], "also"]
        texts.append("some text before it " * rng.randrange(3) + " ".join(told) + " and after")
    docs = table(texts)
    index = license_scan.build_index(docs)
    hits = 0
    for text in texts:
        found = license_scan.words(text)
        expected = {index.templates[n][0] for n in range(len(index.templates)) if plain_share(index, n, found) > 0}
        assert index.scan(text)[3] == expected
        hits += bool(expected)
    assert hits >= len(texts) // 3  # edits inside a demanded phrase rule a notice out


def test_rarity_counts_every_document(table):
    docs = table(["license license", "the license", None, "the", "The"])
    assert license_scan.word_frequencies(docs, {"license", "the", "mit"}) == {"": 5, "license": 2, "the": 3}
    with pytest.raises(ValueError, match="does not hold its phrase"):
        license_scan.build_index(docs, templates=[license_scan.Template("x", "some text", ("other text",))])


# Filter audit


def plain_audit(rows, labels):
    """Every order walked document by document."""
    least = {}
    for i, t, _ in rows:
        if i is not None and ((t or "") not in least or i < least[t or ""]):
            least[t or ""] = i
    parts = defaultdict(list)
    for i, t, part in rows:
        text = t or ""
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = ("A" if len(found) < 200 else "") + ("B" if 100 * len(set(found)) < 50 * len(found) else "")
        fails += "C" if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else ""
        fails += ("D" if re.search("[#$%&*|]", text) else "") + ("E" if i is not None and least[text] < i else "")
        parts[part or ""].append((fails, labels.get(i, (None, None))))
    out = {}
    for part, docs in parts.items():
        removed_by = Counter()
        for order in permutations("ABCDE"):
            kept = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in kept if f in d[0]]
                kept = [d for d in kept if f not in d[0]]
                removed_by[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(kept), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == f for d in docs),
                    sum(d[1][0] == 1 for d in gone), sum(d[1][1] == 1 for d in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_walking_every_order(spark, table):
    rng = random.Random(7)
    bits = ["alpha beta ", "ABC ", "x# ", "word " * 150, " ".join(f"w{n}" for n in range(220)) + " ", "漢字 "]
    rows = [(n, "".join(rng.choice(bits) for _ in range(rng.randrange(4))), rng.choice(["a", "b", "", None])) for n in range(250)]
    rows += [(900 + n, t, "odd") for n, t in enumerate(ODD)] + [(None, "plain words", "a"), (3, rows[3][1], "a"), (3, rows[3][1], "a"), (0, None, "a")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 250, 2)] + [(None, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit_filters(table(rows), frame).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got}
    assert len(got) == len(found)
    assert found == plain_audit(rows, {i: (q, t) for i, q, t in labels if i is not None})


def test_repeated_labels_count_once(spark, table):
    frame = spark.createDataFrame([(0, 1, 0), (0, 1, 1), (0, 0, 0)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit_filters(table(["few words"]), frame).filter("filter_order = 'ABCDE' AND step = 1").collect()
    assert [(r["removed"], r["good_lost"], r["toxic_lost"]) for r in got] == [(1, 1, 1)]


@pytest.mark.parametrize("k", range(1, 6))
def test_swaps_reach_every_order_and_diagrams_stay_small(k):
    rng = random.Random(k)
    masks = {m: (rng.randrange(4), rng.randrange(2), 0) for m in range(1 << k)}
    diagram = filter_audit.FailureDiagram(masks, k)
    seen = {tuple(diagram.order)}
    for place in filter_audit.adjacent_swaps(k):
        diagram.swap(place)
        seen.add(tuple(diagram.order))
        assert all(len(level) <= 1 << n for n, level in enumerate(diagram.levels))
    assert seen == set(permutations(range(k)))


def test_equal_subdiagrams_are_one_node():
    diagram = filter_audit.FailureDiagram({m: (1, 0, 0) for m in range(32)}, 5)
    for place in [None, *filter_audit.adjacent_swaps(5)]:
        if place is not None:
            diagram.swap(place)
        assert [len(level) for level in diagram.levels] == [1] * 5


# Spelling variants


def near_to(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:p] + b[p + 1 :] == a for p in range(len(b)))


def plain_variants(counts, times=10):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if near_to(v, w)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= times * n else None
        out[w] = [form, n, len(near), counts[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.insert(1, root)
    return {w: tuple(r) for w, r in out.items()}


def random_counts(seed, letters, sizes, words):
    rng = random.Random(seed)
    counts = {"".join(rng.choice(letters) for _ in range(rng.choice(sizes))): rng.choice([2, 3, 25, 30, 400, 5000]) for _ in range(words)}
    for w in list(counts)[: words // 2]:  # chains of variants, with repeated letters
        for _ in range(3):
            p = rng.randrange(len(w)) if w else 0
            w = rng.choice([w[:p] + w[p + 1 :] or w, w[:p] + rng.choice(letters) + w[p:], w[:p] + w[p : p + 1] + w[p:], w[:p] + rng.choice(letters) + w[p + 1 :]])
            counts.setdefault(w, rng.choice([2, 20, 300, 4000, 50000]))
    return {w: n for w, n in counts.items() if w}


@pytest.mark.parametrize("seed, letters, sizes", [(1, "ab", range(1, 9)), (2, "abcéß÷", range(3, 7)), (3, "abcdefghijklmnop", range(7, 12)), (4, "a", range(1, 30))])
def test_variants_equal_comparing_all_words(spark, seed, letters, sizes):
    counts = random_counts(seed, letters, sizes, 250)
    frame = spark.createDataFrame([(w, n, "extra") for w, n in counts.items()], "word string, n long, near string")
    got = spelling.spelling_variants(frame).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == plain_variants(counts)
    assert len(got) == len(counts)


def test_long_chains_reach_their_end(spark):
    counts = {"aaaaaaa" + "b" * k: 10**k for k in range(1, 14)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {r["root"] for r in spelling.spelling_variants(frame).collect()} == {"aaaaaaa" + "b" * 13}
    with pytest.raises(ValueError, match="circles"):
        spelling.spelling_variants(frame, times=1)


def test_groups_write_no_pairs(spark):
    """All words with one place open: a group as large as the alphabet, one row for each."""
    letters = "".join(map(chr, range(0xC0, 0x100)))
    frame = spark.createDataFrame([(f"abcdef{c}", 2 + n) for n, c in enumerate(letters)], "word string, n long")
    near = spelling.near_words(frame).collect()
    assert len(near) == 64 and {r["n_near"] for r in near} == {63}
    assert {r["near"] for r in near} == {"abcdefÿ", "abcdefþ"}


def test_word_counts_plant_and_count_whole_texts(table):
    rng = random.Random(11)
    pool = ["Strasse", "straße", "Überfluss", "señorita", "wörterbuch", "a1b2", "longerword", "×÷×÷×÷×", "ÀÉÎÕÜßÿ", "WORDS", "abcdefgh"]
    texts = ODD + ["".join(rng.choice(pool) + rng.choice([" ", "-", "9", "\n", "ſ"]) for _ in range(rng.randrange(80))) for _ in range(120)]
    expected = Counter()
    for n, text in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{n}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                expected[run] += 1
    got = {r["word"]: r["n"] for r in spelling.word_counts(table(texts), drop_every=31).collect()}
    assert got == dict(expected) and any(w not in "".join(pool).lower() for w in got)


def test_empty_tables(spark, table):
    none = table(["x"]).filter("doc_id < 0")
    assert license_scan.scan_licenses(none, license_scan.build_index(none)).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(none, labels).collect() == []
    assert spelling.spelling_variants(spelling.word_counts(none)).collect() == []


def test_repeated_rows_and_null_ids_stay(spark, table):
    docs = table([(1, "all rights reserved", "a"), (1, "all rights reserved", "a"), (None, "all rights reserved", None)])
    found = license_scan.scan_licenses(docs, license_scan.build_index(docs))
    assert found.groupBy("doc_id").count().orderBy("doc_id").collect() == [(None, 1), (1, 2)]
    assert found.filter(F.col("labels") != "reserved").isEmpty()
