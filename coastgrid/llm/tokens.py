"""Token ids by a tokenizer file, and the exact histogram of encoded lengths."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coastgrid.functions.session import materialise
from coastgrid.llm.common import narrow


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class ByteLevelTokenizer:
    """The ids a byte-level ``tokenizers`` file gives, without special tokens added.

    The file's vocabulary and merges are run by the faster coder of ``tiktoken``, whose
    order of merges is that of the ids.  That needs ids in merge order, which is checked;
    files where it does not hold, and texts that spell out an added token that is no special
    one, go through ``tokenizers`` itself.  Special tokens spelt out in a text are ordinary text.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        every = [t["content"] for t in told.get("added_tokens", [])]
        self.added = [t["content"] for t in told.get("added_tokens", []) if not t.get("special")]
        letters = _byte_of_letter()
        self.fast = None
        model = told["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = [model["vocab"]["".join(m)] for m in merges]
        level = told.get("pre_tokenizer") or {}
        if level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and not told.get("normalizer") and ids == sorted(ids):
            ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in every}
            self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


@cache
def tokenizer(path: str) -> ByteLevelTokenizer:
    """One per worker and file."""
    return ByteLevelTokenizer(path)


def token_counts(docs: DataFrame, path: str, text: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` reduced to ``keys`` and ``n_tokens``, the exact encoded length of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in batches:
            counts = [len(coder.ids(t.as_py() or "")) for t in batch.column("text")]
            columns = [batch.column(n) for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*keys, "n_tokens"])

    rows = narrow(docs, **{k: k for k in keys}, text=text)
    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    return rows.mapInArrow(run, ", ".join([*kinds, "n_tokens long"]))


def length_histogram(
    docs: DataFrame, path: str, text: str = "text", keys: tuple[str, ...] = (), block: int = 1024
) -> DataFrame:
    """Exact histogram of encoded lengths with suffix sums, one row per ``keys`` and length.

    ``n_tokens, docs`` is the histogram.  ``docs_from`` and ``tokens_from`` sum documents and
    tokens of this length and more, ``docs_all`` and ``tokens_all`` those of the key.
    From them follow, for every context limit and without another look at the texts: totals,
    ``truncated_tokens`` (what is left when longer documents are cut to this length) and
    ``quantile`` (the share of documents of at most this length).  ``at_limits`` answers
    limits between two lengths.

    Documents are counted by length inside the tasks that encode them, so a hot key
    moves as few rows as it has lengths.  Suffix sums run inside blocks of ``block``
    lengths and over block totals, so a key's lengths do not meet in one task either.

    Null text counts as empty, with length 0.  Null keys are values of their own.  Repeated rows
    count each.  An empty table gives an empty result.  Texts are encoded whole.  Other
    columns of ``docs`` may have any name; ``keys`` may not be named as the result's columns.
    """
    if set(keys) & {"n_tokens", "docs", "text", "docs_from", "tokens_from", "docs_all", "tokens_all", "truncated_tokens", "quantile"}:
        raise ValueError("keys are named as columns of the result")
    counts = token_counts(docs, path, text, keys).groupBy(*keys, "n_tokens").agg(F.count("*").alias("docs"))
    counts = materialise(counts).withColumns(
        {"_block": F.floor(F.col("n_tokens") / block), "_tokens": F.col("n_tokens") * F.col("docs")}
    )
    sums = counts.groupBy(*keys, "_block").agg(F.sum("docs").alias("d"), F.sum("_tokens").alias("t"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sums = materialise(
        sums.select(
            *(F.col(f"`{k}`").alias(f"_k{n}") for n, k in enumerate(keys)),
            F.col("_block").alias("_b"),
            F.coalesce(F.sum("d").over(later), F.lit(0)).alias("_d"),
            F.coalesce(F.sum("t").over(later), F.lit(0)).alias("_t"),
            F.sum("d").over(whole).alias("docs_all"),
            F.sum("t").over(whole).alias("tokens_all"),
        )
    )
    down = Window.partitionBy(*keys, "_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    inside = counts.withColumns({"_di": F.sum("docs").over(down), "_ti": F.sum("_tokens").over(down)})
    match = F.col("_block") == F.col("_b")
    for n, k in enumerate(keys):
        match &= F.col(f"`{k}`").eqNullSafe(F.col(f"_k{n}"))
    found = inside.join(sums, match).withColumns(
        {"docs_from": F.col("_di") + F.col("_d"), "tokens_from": F.col("_ti") + F.col("_t")}
    )
    longer = F.col("docs_from") - F.col("docs")
    return found.select(
        *(f"`{k}`" for k in keys),
        "n_tokens",
        "docs",
        "docs_from",
        "tokens_from",
        "docs_all",
        "tokens_all",
        (F.col("tokens_all") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).alias("truncated_tokens"),
        ((F.col("docs_all") - longer) / F.col("docs_all")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int], keys: tuple[str, ...] = ()) -> DataFrame:
    """Per key and context limit: documents that fit, and tokens when longer ones are cut to it.

    Answered by the suffix sums of the shortest length above the limit.
    """
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in sorted(set(limits))], "context_limit long")
    first = lambda c: F.min_by(c, F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_tokens")))
    rows = histogram.withColumn("context_limit", F.explode(F.array(*(F.lit(int(x)).cast("long") for x in sorted(set(limits))))))
    found = rows.groupBy(*keys, "context_limit").agg(
        F.coalesce(first("docs_from"), F.lit(0)).alias("longer"),
        F.coalesce(first("tokens_from"), F.lit(0)).alias("tokens_longer"),
        F.max("docs_all").alias("docs_all"),
        F.max("tokens_all").alias("tokens_all"),
    )
    found = found.join(asked, "context_limit", "left_semi")
    return found.select(
        *(f"`{k}`" for k in keys),
        "context_limit",
        (F.col("docs_all") - F.col("longer")).alias("docs_within"),
        (F.col("tokens_all") - F.col("tokens_longer") + F.col("longer") * F.col("context_limit")).alias("truncated_tokens"),
    )


warnings.filterwarnings("ignore", message=".*disallowed_special.*")
