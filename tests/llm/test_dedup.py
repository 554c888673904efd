"""Exact, near and line duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest

from coastgrid.llm import exact_dedup, line_dedup, near_dedup
from coastgrid.llm.components import connected_components

SCHEMA = "doc_id long, text string, line string, key long, component_id long, keep_id long, salt int, _lines string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def table(spark):
    """Documents with extra columns whose names clash with the operators' own."""

    def build(texts):
        rows = [(n, t) if not isinstance(t, tuple) else t for n, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, "y") for i, t in rows], SCHEMA)

    return build


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota"]) + str(rng.randrange(40)) for _ in range(n))


def lowered(text):
    return (text or "").translate(LOWER)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: exact_dedup.F.left(exact_dedup.sha256(c), exact_dedup.F.lit(1))])
def test_exact_duplicates_compare_whole_texts(table, digest):
    texts = ["Same", "same", "sÄme", "säme", "", None, "x" * 200_000, "x" * 200_000, *(["hot"] * 60), *map(str, range(40))]
    rows = [*enumerate(texts), (None, "same"), (3, "säme")]
    want = defaultdict(list)
    for i, t in rows:
        want[lowered(t)].append(i)
    got = exact_dedup.exact_duplicates(table(rows), digest=digest).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        group = want[lowered(t)]
        keep = max((x for x in group if x is not None), default=None)
        groups.setdefault(i, set()).add((keep, len(group), i == keep))
    assert all((r["keep_id"], r["group_size"], r["kept"]) in groups[r["doc_id"]] for r in got)


def test_exact_duplicates_of_an_empty_table(table):
    assert exact_dedup.exact_duplicates(table([])).count() == 0
    assert exact_dedup.drop_exact_duplicates(table([])).count() == 0


def test_text_digest_is_that_of_the_lowered_text(table):
    got = exact_dedup.exact_duplicates(table(["ÄBC", None])).collect()
    assert {r["doc_id"]: r["text_digest"] for r in got} == {n: hashlib.sha256(t.encode()).hexdigest() for n, t in enumerate(["Äbc", ""])}


def word_sets(texts):
    out = []
    for t in texts:
        words = WORDS.findall(lowered(t))
        width = min(5, len(words))
        out.append({tuple(words[n : n + width]) for n in range(len(words) - width + 1)} if words else set())
    return out


def classes(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                one, two = sorted((find(a), find(b)))
                root[two] = one
    return [find(n) for n in range(len(sets))]


def near_texts():
    rng = random.Random(5)
    texts = ["", None, "  \t", "one two", "ONE two", "one  two three", "a\x00b c"]
    for _ in range(25):
        base = sentence(rng, rng.randrange(40, 300)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            other = list(base)
            for _ in range(rng.randrange(6)):
                other[rng.randrange(len(other))] = "new" + str(rng.randrange(9))
            texts.append(" ".join(other).upper() if rng.random() < 0.3 else "\n".join(other))
    # A chain: neighbours are linked, its ends are not.
    base = sentence(rng, 300).split()
    for n in range(12):
        base = [*base[:-8], *sentence(rng, 8).split()] if n % 2 else [*sentence(rng, 6).split(), *base[6:]]
        texts.append(" ".join(base))
    return texts


@pytest.mark.parametrize("limits", [{}, {"group_docs": 3, "block_docs": 2}])
def test_near_duplicates_equal_brute_force(table, limits):
    texts = near_texts()
    sets = word_sets(texts)
    got = near_dedup.near_duplicates(table(texts), config=near_dedup.NearConfig(**limits)).collect()
    want = classes(sets)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {
        n: (len(sets[n]), want[n], want[n] == n) for n in range(len(texts))
    }


def test_a_large_group_of_near_copies_is_split_and_stays_one(table):
    rng = random.Random(6)
    base = sentence(rng, 200).split()
    texts = []
    for n in range(150):
        texts.append(" ".join([*base[: n % 190], f"own{n}", *base[n % 190 + 1 :]]))
    config = near_dedup.NearConfig(group_docs=20, block_docs=16)
    got = near_dedup.near_duplicates(table(texts), config=config).collect()
    assert {r["component_id"] for r in got} == {0}
    kept = near_dedup.drop_near_duplicates(table(texts), config=config)
    assert [r["doc_id"] for r in kept.collect()] == [0] and kept.columns == table([]).columns


def test_near_duplicates_of_odd_rows(table):
    assert near_dedup.near_duplicates(table([])).count() == 0
    long = "word" + " word".join(map(str, range(60_000)))
    got = near_dedup.near_duplicates(table([(5, long), (5, long), (9, long + " more"), (None, long)])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(5, 5), (5, 5), (9, 5)]


def test_pruning_bounds_grow_with_what_is_seen():
    least = near_dedup.NearConfig().least_matches()
    assert [n for n, _ in least] == [32, 64, 96, 128]
    assert all(a[1] < b[1] for a, b in zip(least, least[1:])) and all(m < 0.85 * n for n, m in least)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(n, n + 1) for n in range(300)] + [(1000, 1001)], "a long, b long")
    got = connected_components(edges).collect()
    assert len(got) == 303 and {r["component"] for r in got if r["node"] <= 300} == {0}
    assert connected_components(edges.filter("a < 0")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_components_of_sparse_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(103, 101), (103, 102), (104, 100), (104, 102)]
    low = {n: n for e in pairs for n in e}
    for _ in low:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    got = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert sorted(map(tuple, got)) == sorted((n, low[n]) for n in linked)


def within_one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    short, long = sorted((a, b), key=len)
    return any(long[:n] + long[n + 1 :] == short for n in range(len(long)))


def lines_to_drop(texts):
    """Brute force: per document the equal and the near lines."""
    blanks, firsts, seen = " \t\x0b\f\r", [], {}
    out = {n: (set(), set()) for n in range(len(texts))}
    for n, text in enumerate(texts):
        for i, raw in enumerate((text or "").split("\n") if text is not None else []):
            line = raw.strip(blanks)
            if len(line) < 10:
                continue
            if line in seen:
                out[n][0].add(i)
            else:
                seen[line] = (n, i)
                firsts.append((n, i, line))
    for at, (n, i, line) in enumerate(firsts):
        if len(line) >= 20 and any(len(e) >= 20 and within_one_edit(line, e) for _, _, e in firsts[:at]):
            out[n][1].add(i)
    return out


def test_repeated_lines_equal_brute_force(table):
    rng = random.Random(7)
    pool = [sentence(rng, rng.randrange(2, 12)) for _ in range(30)] + ["ünï " * 9, "x" * 3000, "y" * 19, "z" * 20, "z" * 21]
    texts = ["", None, "\n\n", "short\nshort"]
    for _ in range(60):
        lines = []
        for _ in range(rng.randrange(1, 9)):
            line = rng.choice(pool)
            kind, at = rng.randrange(5), rng.randrange(len(line))
            line = [line, line[:at] + line[at + 1 :], line[:at] + "q" + line[at:], line[:at] + "q" + line[at + 1 :], f"  {line}\r"][kind]
            lines.append(line)
        texts.append("\n".join(lines))
    want = lines_to_drop(texts)
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(table(texts)).collect()}
    assert len(got) == len(texts)
    for n, text in enumerate(texts):
        equal, near = want[n]
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in equal | near)
        assert (got[n]["text"], got[n]["equal_lines"], got[n]["near_lines"]) == (kept, len(equal), len(near)), n


def test_lines_of_odd_rows(table):
    assert line_dedup.drop_repeated_lines(table([])).count() == 0
    same = "a line that is long enough to count"
    docs = table([(None, same), (1, same), (1, same), (2, same + "\n" + "k" * 300_000)])
    got = line_dedup.drop_repeated_lines(docs).collect()
    assert sorted((r["doc_id"] or 0, r["text"][:6], len(r["text"])) for r in got) == [(0, "a line", 35), (1, "a line", 35), (1, "a line", 35), (2, "kkkkkk", 300_000)]
    assert set(docs.columns) <= set(line_dedup.drop_repeated_lines(docs).columns)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for n, x in enumerate(a, 1):
        before, row[0] = row[0], n
        for m, y in enumerate(b, 1):
            before, row[m] = row[m], min(row[m] + 1, row[m - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_lines_within_some_edits_equal_brute_force(table, edits):
    rng = random.Random(10 + edits)
    pool = [sentence(rng, rng.randrange(3, 8))[:60].strip() for _ in range(8)] + ["ünï " * 6 + "x", "z" * 20, "z" * 24, "ab" * 12]
    lines = []
    for _ in range(220):
        line = rng.choice(pool)
        for _ in range(rng.randrange(6)):
            at, kind = rng.randrange(len(line)), rng.randrange(3)
            line = [line[:at] + line[at + 1 :], line[:at] + "q" + line[at:], line[:at] + "é" + line[at + 1 :]][kind]
        lines.append(line)
    lines = list(dict.fromkeys(lines))
    want = {
        n for n, a in enumerate(lines) if len(a) >= 20 and any(len(b) >= 20 and edit_distance(a, b) <= edits for b in lines[:n])
    }
    got = line_dedup.drop_repeated_lines(table(lines), edits=edits).collect()
    assert {r["doc_id"] for r in got if r["near_lines"]} == want and sum(r["equal_lines"] for r in got) == 0


@pytest.mark.parametrize("small", [2, 6])
def test_groups_paired_and_groups_by_variants_equal_brute_force(table, monkeypatch, small):
    """Near lines in both kinds of group, and of lines that are in one of each."""
    monkeypatch.setattr(line_dedup, "SMALL_GROUP", small)
    rng = random.Random(21)
    pool = ["".join(rng.choice("abcdefgh ") for _ in range(42)).strip() + "x" for _ in range(6)]
    lines = []
    for n in range(70):
        line = pool[min(rng.randrange(12), 5)] if n % 3 else rng.choice(pool)
        for _ in range(rng.randrange(5)):
            at, kind = rng.randrange(len(line)), rng.randrange(3)
            line = [line[:at] + line[at + 1 :], line[:at] + "q" + line[at:], line[:at] + "é" + line[at + 1 :]][kind]
        lines.append(line.strip())
    lines = list(dict.fromkeys(lines))
    want = {n for n, a in enumerate(lines) if any(edit_distance(a, b) <= 2 for b in lines[:n])}
    got = line_dedup.drop_repeated_lines(table(lines), edits=2).collect()
    assert {r["doc_id"] for r in got if r["near_lines"]} == want


def test_pairs_of_near_lines_need_no_variants(table, monkeypatch):
    """Groups of a few lines cost neither rounds nor variants, however many they are."""
    monkeypatch.setattr(line_dedup, "near_lines", None)
    rng = random.Random(22)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(40)) + "x" for _ in range(50)]
    got = line_dedup.drop_repeated_lines(table(lines + [x[:20] + "q" + x[21:] for x in lines]), edits=2).collect()
    assert sorted(r["doc_id"] for r in got if r["near_lines"]) == list(range(50, 100))


def test_shortest_lines_may_be_compared_too(table):
    rng = random.Random(8)
    lines = list(dict.fromkeys("".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(60)))
    want = {n for n, a in enumerate(lines) if any(edit_distance(a, b) <= 1 for b in lines[:n])}
    got = line_dedup.drop_repeated_lines(table(lines), min_chars=1, near_chars=1, edits=1).collect()
    assert {r["doc_id"] for r in got if r["near_lines"]} == want
