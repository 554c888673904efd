"""Repeated and nearly repeated lines across documents, by deletion neighbourhoods."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate, combinations, product
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coastgrid.functions.session import materialise
from coastgrid.llm.common import narrow

BLANK_CHARS = " \t\x0b\f\r"
#: Edits between nearly equal lines in the query and the pipeline: a two-digit year, or two letters of a word.
EDITS = 2
#: Lines that share a segment are compared pair by pair in groups of up to so many, and by their variants in larger ones.
SMALL_GROUP = 32


def _hashed(line: Column, tag: int) -> Column:
    return F.xxhash64(F.lit(tag), line)


def _occurrences(docs: DataFrame, text: str, doc_id: str, min_chars: int, near_chars: int, edits: int) -> DataFrame:
    """One row per line of ``min_chars``: ``doc_id, i, h1, h2, again, keys``.

    Two seeded 64-bit hashes of the trimmed line stand for it; ``again`` marks lines that the
    document has before.  ``keys`` are those of ``_part_keys``, null below ``near_chars`` and for ``again``.
    """
    rows = narrow(docs, doc_id=doc_id, text=text).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("doc_id", F.split("text", "\n").alias("lines"))
    trimmed = F.transform("lines", lambda x, i: F.struct(F.btrim(x, F.lit(BLANK_CHARS)).alias("x"), i.alias("i")))
    sized = F.filter(F.transform(trimmed, lambda s: F.struct(s["x"].alias("x"), s["i"].alias("i"), F.char_length(s["x"]).alias("n"))), lambda s: s["n"] >= min_chars)
    hashed = F.transform(sized, lambda s: F.struct(_hashed(s["x"], 1).alias("h1"), _hashed(s["x"], 2).alias("h2"), s["i"].alias("i"), s["n"].alias("n"), s["x"].alias("x")))
    rows = rows.select("doc_id", F.sort_array(hashed).alias("marks"))
    marks = F.col("marks")
    again = lambda s, k: s["h1"].eqNullSafe(F.get(marks, k - 1)["h1"]) & s["h2"].eqNullSafe(F.get(marks, k - 1)["h2"])
    flagged = F.transform(marks, lambda s, k: F.struct(s["h1"].alias("h1"), s["h2"].alias("h2"), s["i"].alias("i"), s["n"].alias("n"), again(s, k).alias("again"), s["x"].alias("x")))
    # Outer: for a plain explode Spark adds a filter on the array and computes it once more there.
    exploded = rows.select("doc_id", F.explode_outer(flagged).alias("f")).filter("f IS NOT NULL").select("doc_id", "f.*")
    # Four bytes a code point: a part is then cut out in place instead of counted from the start.
    wide = exploded.withColumn("x", F.when((F.col("n") >= near_chars) & ~F.col("again"), F.encode("x", "UTF-32")))
    keys = F.when(F.col("x").isNotNull(), F.array(*_part_keys(F.col("x"), F.col("n"), edits, edits + 1, width=4)))
    return wide.select("doc_id", "i", "h1", "h2", "again", keys.alias("keys"))


def _shared_parts(edits: int, segments: int) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
    """What a line has in common with one that is ``d`` longer: ``(d, segments, shifts)``.

    The longer line is cut into ``segments``.  Let each edit take the segment it is in, or if
    that is taken the next free one (before it, at the end): ``edits`` segments are taken, the
    others are intact, and a run of g taken ones holds at most g edits.  So some choice of
    intact segments occurs in the shorter line, each shifted by what the runs before it lack.
    """
    found = []
    for intact in combinations(range(segments), segments - edits):
        runs = [b - a - 1 for a, b in zip((-1, *intact), (*intact, segments))]
        for lacks in product(*(range(-g, g + 1) for g in runs)):
            if 0 <= sum(lacks) <= edits:
                found.append((sum(lacks), intact, tuple(accumulate(lacks[:-1]))))
    return sorted(found)


def _edge(longer: Column, n: int, segments: int) -> Column:
    """Where segment ``n`` of a line of ``longer`` characters begins."""
    return F.floor(longer * n / segments).cast("int")


def _part_keys(line: Column, size: Column, edits: int, segments: int, width: int = 1) -> list[Column]:
    """Keys of which any two lines within ``edits`` have one in common, in the order of ``_shared_parts``.

    A line takes part as the longer one (keys without shifts) and as the shorter one.  It has
    ``size`` characters of ``width`` bytes, or of any size in a string.  Keys whose segments would
    reach over an end of it, or into each other, are null.
    """
    keys = []
    for lack, intact, shifts in _shared_parts(edits, segments):
        longer = size + lack
        parts = [
            F.substr(line, (_edge(longer, n, segments) - shift) * width + 1, (_edge(longer, n + 1, segments) - _edge(longer, n, segments)) * width)
            for n, shift in zip(intact, shifts)
        ]
        # Long parts and short ones alike are as long as the longer line says, so no mark is put between them.
        key = F.xxhash64(F.lit(".".join(map(str, intact))), longer, *parts)
        runs = zip((-1, *intact), (*intact, segments), (0, *shifts), (*shifts, lack))
        fits = [_edge(longer, after, segments) - _edge(longer, before + 1, segments) >= d for before, after, s, s_after in runs if (d := s_after - s) > 0]
        keys.append(F.when(reduce(and_, fits), key) if fits else key)
    return keys


def _open_parts(line: Column, size: Column, edits: int, segments: int) -> Column:
    """Per key of ``_part_keys``, what lies between its intact segments: an array of ``t, e, d``.

    ``t`` is the text of a run of taken segments, ``e`` the edits it may hold, ``d`` how many
    characters it lacks against the longer line.
    """
    choices = []
    for lack, intact, shifts in _shared_parts(edits, segments):
        longer = size + lack
        parts = []
        for before, after, shift, shift_after in zip((-1, *intact), (*intact, segments), (0, *shifts), (*shifts, lack)):
            if after - before > 1:
                start = _edge(longer, before + 1, segments) - shift
                stop = _edge(longer, after, segments) - shift_after
                parts.append(
                    F.struct(
                        F.substr(line, start + 1, F.greatest(stop - start, F.lit(0))).alias("t"),
                        F.lit(after - before - 1).alias("e"),
                        F.lit(shift_after - shift).alias("d"),
                    )
                )
        choices.append(F.array(*parts))
    return F.array(*choices)


def _halved(slot: int, edits: int) -> Column:
    """The ways to cut the part ``t, e, d`` of ``size`` characters in two: array of ``tag, same, shifted, next``, or null.

    The longer line is cut in the middle and the edits are dealt to the halves; a half
    without edits is the same in both lines (``same``) and is no part any more.  A part of which the
    longer line has one character at most stays as it is.
    """
    t, e, d, size = F.col("t"), F.col("e"), F.col("d"), F.col("size")
    whole = size + d
    middle = F.floor(whole / 2).cast("int")
    cut = lambda start, length: F.substr(t, start + 1, length)
    new = lambda t, e, d: F.struct(t.alias("t"), e.alias("e"), d.alias("d"))

    def way(possible: Column, tag: str, same: Column, shifted: bool, *parts: Column) -> Column:
        told = F.struct(F.lit(f"{slot}{tag}").alias("tag"), F.concat_ws("", whole.cast("string"), F.lit(":"), same).alias("same"), F.lit(shifted).alias("shifted"))
        return F.when(possible, F.struct(told["tag"], told["same"], told["shifted"], F.array(*parts).alias("next")))

    ways = [
        way(whole <= 1, "", F.lit(""), False, new(t, e, d)),
        way((whole > 1) & (size >= middle), "r", F.left(t, middle), False, new(cut(middle, size - middle), e, d)),
        way((whole > 1) & (size >= whole - middle), "l", F.right(t, whole - middle), False, new(F.left(t, size - whole + middle), e, d)),
    ]
    for left in range(1, edits):
        for c in range(-left, left + 1):
            at = middle + c
            possible = (whole > 1) & (e > left) & (F.abs(d + c) <= e - left) & (at >= 0) & (at <= size)
            ways.append(way(possible, f"b{left}", F.lit(""), c != 0, new(F.left(t, at), F.lit(left), F.lit(-c)), new(cut(at, size - at), e - left, d + c)))
    return F.array(*ways)


def _last_letters(part: Column, slot: int) -> Column:
    """The ways to delete what is left of a part, of which the longer line has one character at most: array of ``tag, same``.

    Either all of it is deleted, or one character stays and the rest was inserted around it.
    """
    t, e = part["t"], part["e"]
    size = F.char_length(t)
    gone = F.when((size + part["d"] == 0) | (size <= e), F.struct(F.lit(f"{slot}").alias("tag"), F.lit("").alias("same")))
    letters = F.when((size + part["d"] == 1) & (size > 0), F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    kept = F.transform(letters, lambda p: F.struct(F.lit(f"{slot}k").alias("tag"), F.substr(t, p, F.lit(1)).alias("same")))
    return F.concat(F.filter(F.array(gone), lambda w: w.isNotNull()), F.array_distinct(kept))


def _open_distance(edits: int) -> Column:
    """Edits between the open parts of two lines that are the same elsewhere, and more than ``edits`` if that is more."""
    far = edits + 1
    apart = [
        F.when(F.size("parts") <= n, F.lit(0)).otherwise(
            F.when((d := F.levenshtein(F.get("parts", F.lit(n))["t"], F.get("hub.parts", F.lit(n))["t"], edits)) < 0, far).otherwise(d)
        )
        for n in range(edits)
    ]
    return reduce(add, apart)


def _with_hubs(rows: DataFrame, edits: int) -> DataFrame:
    """The rows of ``key, place, moved, seeks, parts`` later than the first line of their key, with that line as ``b``; written.

    Only keys are left where a row that seeks comes after another line, and one row is unmoved.
    ``seeks`` ends where the first line is within ``edits``: no earlier one can be found by that key.
    """
    first = F.min(F.struct("place", "parts")).alias("hub")
    hubs = rows.groupBy("key").agg(first, F.max(F.when(F.col("seeks"), F.col("place"))).alias("last"), F.min("moved").alias("all_moved"))
    hubs = hubs.filter("hub.place < last AND NOT all_moved").select("key", "hub")
    met = rows.join(hubs, "key").filter("place > hub.place").withColumn("near", _open_distance(edits) <= edits)
    return materialise(met.select("key", "place", "moved", (F.col("seeks") & ~F.col("near")).alias("seeks"), "parts", F.when(F.col("seeks") & F.col("near"), F.col("hub.place")).alias("b")))


def _narrowed(rows: DataFrame, edits: int) -> DataFrame:
    """Every row in all ways to deal the edits of its parts to their halves, one row a way."""
    rows = rows.withColumn("done", F.array().cast(rows.schema["parts"].dataType))
    for slot in range(edits):
        part = F.get("parts", F.lit(slot))
        rows = rows.select("*", part["t"].alias("t"), part["e"].alias("e"), part["d"].alias("d"))
        rows = rows.withColumn("size", F.char_length("t")).withColumn("none", F.size("parts") <= slot)
        rows = rows.withColumn("way", F.explode_outer(F.when(~F.col("none"), _halved(slot, edits)))).filter(F.col("none") | F.col("way").isNotNull())
        rows = rows.select(
            "place",
            "seeks",
            F.when(F.col("none"), F.col("key")).otherwise(F.xxhash64("key", "way.tag", "way.same")).alias("key"),
            (F.col("moved") | F.coalesce("way.shifted", F.lit(False))).alias("moved"),
            "parts",
            F.when(F.col("none"), F.col("done")).otherwise(F.concat("done", "way.next")).alias("done"),
        )
    return rows.select("key", "place", "moved", "seeks", F.col("done").alias("parts"))


def _met_by_letters(rows: DataFrame, edits: int) -> DataFrame:
    """``a, b``: lines whose parts are down to a character, by equal variants of those.

    A line and an unmoved one with an equal variant are within ``edits``; two moved ones need not be.
    So each line meets the earliest unmoved holder of a variant, and an unmoved one the earliest moved holder too.
    """
    for slot in range(edits):
        rows = rows.withColumn("w", F.explode_outer(_last_letters(F.get("parts", F.lit(slot)), slot)))
        rows = rows.filter(F.col("w").isNotNull() | (F.size("parts") <= slot)).withColumn("key", F.xxhash64("key", "w.tag", "w.same"))
    variants = materialise(rows.select("place", F.col("key").alias("variant"), "moved", "seeks").distinct())
    place = F.col("place")
    hubs = variants.groupBy("variant").agg(F.min(F.when(~F.col("moved"), place)).alias("first"), F.min(F.when(F.col("moved"), place)).alias("first_moved"), F.count("*").alias("n"))
    met = variants.filter("seeks").join(hubs.filter("n > 1").drop("n"), "variant")
    met = met.select(place.alias("a"), F.explode(F.array("first", F.when(~F.col("moved"), F.col("first_moved")))).alias("b"))
    return met.filter("b < a")


def near_lines(texts: DataFrame, edits: int = 1) -> DataFrame:
    """Lines within ``edits`` of an earlier line: ``doc_id, i, keep_doc, keep_line``.

    ``texts`` has one row per distinct line, ``doc_id, i, line``.  Earlier means by
    document id, then line number; it does not matter whether the earlier line stays.

    A variant is a line with up to ``edits`` stretches deleted, as a hash that knows where they
    were.  Lines join the earliest holder of an equal variant, and what was deleted is compared.  Any two
    lines within ``edits`` have an equal variant with half of the line deleted; where its first holder is too
    far but another may match, the deletions are narrowed to halves of themselves, down to single characters, where
    holders of one variant are within ``edits``.  So pairs grow with the variants and never with
    the square of a group, and ways that no other line shares are given up.  Distance is verified on
    the whole lines in the end.
    """
    segments = edits + 2
    place, size = F.struct("doc_id", "i"), F.char_length("line")
    told = [F.lit(bool(lack or any(shifts))) for lack, _, shifts in _shared_parts(edits, segments)]
    keyed = texts.select(place.alias("place"), F.posexplode(F.array(*_part_keys(F.col("line"), size, edits, segments))).alias("way", "key")).filter("key IS NOT NULL")
    shared = keyed.groupBy("key").agg(F.min("place").alias("a"), F.max("place").alias("b")).filter("a < b").select("key")
    keyed = keyed.join(shared, "key", "left_semi").withColumns({"moved": F.get(F.array(*told), F.col("way")), "seeks": F.lit(True)})
    opened = F.get(_open_parts(F.col("line"), size, edits, segments), F.col("way")).alias("parts")
    rows = keyed.join(texts.select(place.alias("place"), "line"), "place").select("key", "place", "moved", "seeks", opened)
    found = []
    while True:
        met = _with_hubs(materialise(rows), edits)
        found.append(met.filter("b IS NOT NULL").select(F.col("place").alias("a"), "b"))
        left = met.drop("b")
        # What seekers may still meet: another line later than the first of their key.
        worth = left.groupBy("key").agg(F.min("place").alias("a"), F.max(F.when(F.col("seeks"), F.col("place"))).alias("last")).filter("a < last")
        left = left.join(worth.select("key"), "key", "left_semi")
        widest = left.agg(F.max(F.array_max(F.transform("parts", lambda p: F.char_length(p["t"]) + p["d"])))).first()[0]
        if widest is None:
            break
        if widest <= 1:
            found.append(_met_by_letters(left, edits))
            break
        rows = _narrowed(left, edits)
    pairs = reduce(DataFrame.unionByName, found).distinct()
    lined = lambda name: texts.select(place.alias(name), F.col("line").alias(f"line_{name}"))
    checked = pairs.join(lined("a"), "a").join(lined("b"), "b").filter(F.levenshtein("line_a", "line_b", edits).between(0, edits))
    best = checked.groupBy("a").agg(F.min("b").alias("b"))
    return best.select("a.doc_id", "a.i", F.col("b.doc_id").alias("keep_doc"), F.col("b.i").alias("keep_line"))


def _possible_pairs(firsts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that share a key of ``firsts`` (``h1, keys``): pairs ``a, b`` of ``h1``, and the ``h1`` of lines in large groups.

    Keys are combined inside the tasks first.  A key of two rows is a pair; only the others are looked up again
    for their lines, and a hot one is split by that join.  Groups of up to ``SMALL_GROUP`` lines are paired, so
    pairs grow with the rows; lines of larger groups are left to ``near_lines``.
    """
    keyed = firsts.select("h1", F.explode("keys").alias("key")).filter("key IS NOT NULL")
    shared = materialise(keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.count("*").alias("n")).filter("a < b"))
    crowded = materialise(shared.filter("n > 2").select("key"))
    members = materialise(keyed.join(crowded, "key", "left_semi").distinct())
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    few = members.join(sizes.filter(F.col("n") <= SMALL_GROUP).select("key"), "key")
    paired = few.withColumnRenamed("h1", "a").join(few.withColumnRenamed("h1", "b"), "key").filter("a < b")
    pairs = shared.filter("n = 2").select("a", "b").unionByName(paired.select("a", "b"))
    large = members.join(sizes.filter(F.col("n") > SMALL_GROUP).select("key"), "key").select("h1")
    return materialise(pairs.distinct()), materialise(large.distinct())


def _near_pairs(texts: DataFrame, pairs: DataFrame, edits: int) -> DataFrame:
    """``doc_id, i``: the later line of each of ``pairs`` (``a, b``) whose ``texts`` (``doc_id, i, h1, line``) are within ``edits``."""
    lined = lambda name: texts.select(
        F.col("h1").alias(name), F.struct("doc_id", "i").alias(f"place_{name}"), F.col("line").alias(f"line_{name}")
    )
    met = pairs.join(lined("a"), "a").join(lined("b"), "b").filter(F.levenshtein("line_a", "line_b", edits).between(0, edits))
    return met.select(F.greatest("place_a", "place_b").alias("later")).select("later.doc_id", "later.i").distinct()


def repeated_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 10, near_chars: int = 20, edits: int = 1
) -> DataFrame:
    """The lines to drop, one row per document with any: ``doc_id, equal, near`` (line numbers).

    A line, without blanks at its ends, goes if an equal line occurs earlier, or one within
    ``edits`` (insertion, deletion or substitution of a character).  Earlier means a smaller
    document id, then a smaller line number, counted from 0.  Lines below ``min_chars`` stay;
    lines below ``near_chars`` are only compared for equality.  Both may be 1.

    Only lines that share one of ``edits + 1`` segments, shifted by up to ``edits``, can be near.  Where few share
    one they are compared pair by pair, else by a deletion-neighbourhood join on hashed variants (``near_lines``);
    no pair within the bound is lost on the way.  Texts are read once for the hashes of all lines, which are
    written, and once more for the lines that may have a partner.  Equal lines are counted
    inside the tasks first, and the joins by line are plain equi-joins, which Spark splits for a hot line.

    Documents with null id or text are left alone.  Rows that share an id are taken as
    one document: what is first in one of them is first in all.
    """
    every = materialise(_occurrences(docs, text, doc_id, min_chars, near_chars, edits))
    firsts = every.filter("NOT again").select("doc_id", "i", "h1", "h2", "keys")
    lines = materialise(
        firsts.groupBy("h1", "h2").agg(F.min_by("i", "doc_id").alias("i"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    )
    pairs, large = _possible_pairs(firsts.filter("keys IS NOT NULL").select("h1", "keys"))
    partners = pairs.select(F.explode(F.array("a", "b")).alias("h1")).unionByName(large).distinct()
    wanted = lines.join(partners, "h1", "left_semi").select("doc_id", "i", "h1", "h2")
    numbered = narrow(docs, doc_id=doc_id, text=text).join(materialise(wanted), "doc_id")
    told = numbered.select("doc_id", "i", "h1", "h2", F.btrim(F.get(F.split("text", "\n"), F.col("i")), F.lit(BLANK_CHARS)).alias("line"))
    # Of rows that share an id, the one that has the line there.
    told = told.filter((F.col("h1") == _hashed(F.col("line"), 1)) & (F.col("h2") == _hashed(F.col("line"), 2)))
    texts = materialise(told.select("doc_id", "i", "h1", "line").distinct())
    near = _near_pairs(texts, pairs, edits)
    if not large.isEmpty():
        variants = near_lines(materialise(texts.join(large, "h1", "left_semi").select("doc_id", "i", "line")), edits)
        near = near.unionByName(variants.select("doc_id", "i"))
    shared = lines.filter("n > 1").select("h1", "h2", F.col("doc_id").alias("keep_doc"))
    equal = firsts.select("doc_id", "h1", "h2", "i").join(shared, ["h1", "h2"]).filter("doc_id != keep_doc")
    inside = every.filter("again").select("doc_id", "i")
    drops = (
        equal.select("doc_id", "i", F.lit(True).alias("equal"))
        .unionByName(inside.select("doc_id", "i", F.lit(True).alias("equal")))
        .unionByName(near.select("doc_id", "i", F.lit(False).alias("equal")))
    )
    return drops.groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("equal"), F.col("i"))).alias("equal"), F.collect_set(F.when(~F.col("equal"), F.col("i"))).alias("near")
    )


def drop_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without repeated lines, and ``lines, equal_lines, near_lines``: how many it had and lost.

    Order and separators of the other lines stay.  All rows stay, also those left empty;
    null text stays null with no lines.  The three added columns replace any of that name.
    """
    drops = repeated_lines(docs, text, doc_id, **options).select(
        F.col("doc_id").alias("_drop_doc"), F.col("equal").alias("_drop_equal"), F.col("near").alias("_drop_near")
    )
    lines = F.split(F.col(f"`{text}`"), "\n")
    gone = F.array_union("_drop_equal", "_drop_near")
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), gone))
    joined = docs.join(drops, docs[doc_id] == F.col("_drop_doc"), "left").withColumn("_lines", lines)
    counts = {
        "lines": F.coalesce(F.when(F.col("_lines").isNotNull(), F.size("_lines")), F.lit(0)),
        "equal_lines": F.coalesce(F.when(F.col("_drop_equal").isNotNull(), F.size("_drop_equal")), F.lit(0)),
        "near_lines": F.coalesce(F.when(F.col("_drop_near").isNotNull(), F.size(F.array_except("_drop_near", "_drop_equal"))), F.lit(0)),
    }
    cleaned = F.when(gone.isNull(), F.col(f"`{text}`")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n")
    )
    others = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in counts]
    result = joined.select(*others, cleaned.alias(text), *(c.cast("long").alias(name) for name, c in counts.items()))
    order = [c for c in docs.columns if c not in counts]
    return result.select(*(f"`{c}`" for c in order), *counts)
