"""Spelling variants of words, grouped over permuterm rotations."""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coastgrid.functions.session import materialise
from coastgrid.llm.common import narrow

LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: Ends a word within its rotations; no word holds it.
END = "$"
WORDS_AT_ONCE = 200_000


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_chars: int = 7, drop_every: int | None = None) -> DataFrame:
    """``word, n``: how often each word of at least ``least_chars`` code points occurs.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z only.  With
    ``drop_every``, occurrences whose unsigned crc32 h of ``<doc_id>:<run>`` it divides lose the code point
    at ``h % length`` first, which plants misspellings that any reader of the table can plant again.

    Occurrences are counted inside the tasks, a bounded number of words at a time.  Null text
    has no words, a null id is written as nothing; repeated rows count as often as they occur.
    """
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least_chars)

    def found_in(value: str | None, name: object) -> Iterator[tuple[str, int]]:
        lowered = (value or "").encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")
        begun = zlib.crc32(f"{'' if name is None else name}:".encode())
        for run, n in Counter(runs.findall(lowered)).items():
            if drop_every and not (h := zlib.crc32(run.encode(), begun)) % drop_every:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_chars:
                yield run, n

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for value, name in zip(batch.column("text"), batch.column("doc_id")):
                for word, n in found_in(value.as_py(), name.as_py()):
                    counts[word] += n
                if len(counts) >= WORDS_AT_ONCE:
                    yield batch_of(counts)
                    counts.clear()
        yield batch_of(counts)

    parts = narrow(docs, doc_id=doc_id, text=text).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def rotation_prefixes(words: DataFrame) -> DataFrame:
    """``prefix, word, n, edited, first`` from ``word, n``: where each word can meet a near one.

    Of a word and its end mark every rotation is taken.  Without its last character, a rotation is the
    prefix that all words share which replace that character (``edited``), and it is the whole
    rotation of the word that lacks it.  ``first`` marks a character unlike the one before it: of a
    run of equal characters, deleting any gives one word, and only the first counts.
    """
    size = F.char_length("word")
    turned = F.concat("word", F.lit(END), "word", F.lit(END))
    letter = lambda p: F.substr(F.col("word"), p + 1, F.lit(1))
    whole = F.transform(
        F.sequence(F.lit(1), size + 1),
        lambda p: F.struct(F.substr(turned, p, size + 1).alias("prefix"), F.lit(False).alias("edited"), F.lit(False).alias("first")),
    )
    # The letter at p (from 0) ends the rotation that starts after it.
    without = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda p: F.struct(F.substr(turned, p + 2, size).alias("prefix"), F.lit(True).alias("edited"), ((p == 0) | (letter(p) != letter(p - 1))).alias("first")),
    )
    return words.select("word", "n", F.inline(F.concat(whole, without)))


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, near, near_n``: how many words of ``word, n`` are one edit away, and the commonest of them.

    Near is one code point inserted, deleted or replaced.  Rotations are dealt out by prefix,
    sorted, and scanned group by group.  A prefix determines all but one character, so a
    group has one word more than the alphabet has letters, however many words there are; its members learn
    the size of the group and its two commonest words, and no pair is written.  Ties go to the
    smallest word in code-point order.  Words without a near one are left out.
    """
    group = Window.partitionBy("prefix")
    ranked = group.orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edited, first = F.col("edited").cast("int"), F.col("first").cast("int")
    scanned = (
        rotation_prefixes(words)
        .withColumn("_place", F.struct((-F.col("n")).alias("minus"), F.col("word").alias("word")))
        .withColumns(
            {
                "_rows": F.count("*").over(ranked),
                "_edited": F.sum(edited).over(ranked),
                "_first": F.sum(first).over(ranked),
                "_one": F.first("_place").over(ranked),
                "_two": F.nth_value("_place", 2).over(ranked),
            }
        )
        .filter("_rows > 1")
    )
    shorter = F.col("_rows") - F.col("_edited")
    others = F.when(F.col("edited"), F.col("_edited") - 1 + F.when(F.col("first"), shorter).otherwise(0)).otherwise(F.col("_first"))
    best = F.when(F.col("_one.word") != F.col("word"), F.col("_one")).otherwise(F.col("_two"))
    near = scanned.groupBy("word").agg(F.sum(others).alias("n_near"), F.min(best).alias("_best"))
    return near.select("word", "n_near", F.col("_best.word").alias("near"), (-F.col("_best.minus")).alias("near_n"))


def follow_forms(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the end of each word's chain.

    Every round doubles the steps taken, so chains of k forms need log2 k rounds.  Forms must
    not run in circles.  Each round is written to the shared folder.
    """
    ends = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = materialise(ends.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        ends = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            return ends


def spelling_variants(words: DataFrame, times: int = 10) -> DataFrame:
    """One row per word of ``word, n`` (distinct words): ``word, form, root, n, n_near, form_n``.

    ``form`` is the commonest near word (see ``near_words``) if it occurs at least ``times`` as
    often, else null; ``root`` follows the forms to the last, which is the word itself without a form.
    ``times`` must be above 1, so that counts rise along a chain and it ends.

    Null words are left out; an empty table gives no rows.  Other columns are not used.
    """
    if times <= 1:
        raise ValueError("times must be above 1, or forms could run in circles")
    known = materialise(narrow(words, word="word", n="n").filter("word IS NOT NULL"))
    near = materialise(near_words(known))
    named = known.join(near, "word", "left").withColumn("_taken", (F.col("near_n") >= times * F.col("n")) & (F.col("near_n") > F.col("n")))
    named = named.select(
        "word",
        F.when(F.col("_taken"), F.col("near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("_taken"), F.col("near_n")).alias("form_n"),
    )
    ends = follow_forms(named.filter("form IS NOT NULL"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
