"""Near duplicates by MinHash bands with sequential Bayesian verification."""

from __future__ import annotations

import hashlib
import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coastgrid.functions.session import materialise
from coastgrid.llm.common import narrow
from coastgrid.llm.components import connected_components

LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
WORDS_CACHED = 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class NearConfig:
    """Similarity is at least ``hundredths`` / 100 of the union of ``width``-word shingles.

    ``bands`` of ``rows`` hashes choose candidates: a link at the threshold is missed with
    probability (1 - s ** rows) ** bands, 5e-5 for the defaults.  Candidates are pruned
    after every ``batch`` of ``hashes`` when the posterior probability of a link, from a
    uniform prior, falls below ``miss``.  Candidate groups of more than ``group_docs``
    documents or ``group_shingles`` shingles are split by bucket and block.
    """

    hundredths: int = 85
    width: int = 5
    bands: int = 21
    rows: int = 6
    hashes: int = 128
    batch: int = 32
    miss: float = 1e-6
    group_docs: int = 512
    group_shingles: int = 2_000_000
    block_docs: int = 128
    seed: int = 20

    def least_matches(self) -> list[tuple[int, int]]:
        """(hashes seen, fewest equal ones that are not pruned) after each batch."""
        t, found = self.hundredths / 100, []
        for n in range(self.batch, self.hashes + 1, self.batch):
            # P(S >= t | m of n) = P(Binomial(n + 1, t) <= m)
            total, m = 0.0, -1
            while total < self.miss:
                m += 1
                total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            found.append((n, m))
        return found

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        draw = lambda: rng.integers(0, 2**63, self.hashes, dtype=np.uint64)
        return draw() * np.uint64(2) + np.uint64(1), draw()


class _WordHashes(dict):
    """64-bit hash by word; emptied when full, so that it stays small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_CACHED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, width: int, hashed: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all shingles of the whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    x = np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words))
    span = min(width, len(x))
    n = len(x) - span + 1
    h = np.full(n, span, np.uint64)
    for k in range(span):
        h = (h ^ x[k : k + n]) * MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set, 32 bits each."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(items), 2048):
        np.minimum(least, (items[start : start + 2048, None] * a + b).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _sketch(config: NearConfig):
    """Per document: size and digest of its set, and one key per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, (a, b) = _WordHashes(), config.multipliers()
        used = config.bands * config.rows
        a, b = a[:used], b[:used]
        for batch in batches:
            sizes, ones, twos, keys = [], [], [], []
            for text in batch.column("text"):
                items = shingles(text.as_py(), config.width, hashed)
                digest = np.frombuffer(hashlib.blake2b(items.tobytes(), digest_size=16).digest(), np.int64)
                sizes.append(len(items))
                ones.append(int(digest[0]))
                twos.append(int(digest[1]))
                if len(items):
                    rows = signature(items, a, b).reshape(config.bands, config.rows)
                    keys.append([xxhash.xxh64_intdigest(rows[k].tobytes(), k) - 2**63 for k in range(config.bands)])
                else:
                    keys.append([])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "d1", "d2", "keys"],
            )

    return run


def _full_sets(config: NearConfig):
    """Per candidate: its whole set, as bytes of sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _WordHashes()
        for batch in batches:
            sets = [shingles(text.as_py(), config.width, hashed).tobytes() for text in batch.column("text")]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sets, pa.binary())], [*names, "items"])

    return run


def _links(config: NearConfig):
    """Links inside one group: of possible pairs, only those that join two components so far."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        ids = group["doc_id"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group["items"]]
        keys = np.array(group["keys"].tolist(), np.int64)
        (a, b), least = config.multipliers(), config.least_matches()
        signs = np.array([signature(x, a, b) for x in sets])
        sizes = np.array([len(x) for x in sets])
        bucket, low, high = group["bucket"].iloc[0], group["low"].iloc[0], group["high"].iloc[0]
        block = group["block"].to_numpy()
        root = list(range(len(ids)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for x in range(len(ids)):
            equal = keys[x + 1 :] == keys[x]
            possible = equal.any(axis=1)
            if bucket >= 0:  # a pair belongs to the first bucket the two have in common
                possible &= keys[x + 1 :, bucket] == keys[x, bucket]
                possible &= equal.argmax(axis=1) == bucket
                if low != high:
                    possible &= block[x + 1 :] != block[x]
            small, large = np.minimum(sizes[x + 1 :], sizes[x]), np.maximum(sizes[x + 1 :], sizes[x])
            left = x + 1 + np.flatnonzero(possible & (100 * small >= config.hundredths * large))
            matches, seen = np.zeros(len(left), np.int64), 0
            for n, fewest in least:
                matches += (signs[left, seen:n] == signs[x, seen:n]).sum(axis=1)
                stay = matches >= fewest
                left, matches, seen = left[stay], matches[stay], n
            for y in left[np.argsort(-matches, kind="stable")]:
                one, two = find(x), find(int(y))
                if one == two:
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= config.hundredths * (sizes[x] + sizes[y] - both):
                    root[max(one, two)] = min(one, two)
                    out.append((ids[x], ids[y]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _split_hot(hot: DataFrame, config: NearConfig) -> DataFrame:
    """One row per document of a large group, bucket of two or more and pair of blocks."""
    cut = F.greatest(
        F.ceil(F.col("n") / config.block_docs), F.ceil(F.col("shingles") / (config.group_shingles // 4)), F.lit(1)
    ).cast("int")
    rows = hot.select("*", F.posexplode("keys").alias("bucket", "key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")).filter("n > 1")
    rows = rows.join(counts.select("key", cut.alias("cut")), "key")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("cut")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    return rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", config: NearConfig = NearConfig()) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Words are runs of non-blank characters after lower-casing A-Z.  A document's set holds its
    distinct five-word shingles, or its whole word sequence if shorter.  Documents are
    linked at the similarity of ``config``; ``component_id`` is the smallest id reachable
    and ``kept`` marks the document that has it.

    Documents with equal sets become one class before anything is compared.  Classes that share a
    band key form candidate groups (components of stars around each bucket's smallest
    id, never pairs).  A group's documents travel once, with their whole sets, to one
    task; a group above the limits is split by bucket and by pairs of blocks inside a
    bucket, and each pair is judged in the first bucket it shares.  Pairs are pruned
    batch by batch on signatures and confirmed on whole sets, as 64-bit hashes of every
    shingle; pairs that earlier links already connect are skipped, so a group of n yields
    at most n - 1 links a task.

    Null and empty texts have an empty set and link with nothing.  Null ids are left
    out.  Repeated rows return as often as they occur and, with an equal set, in one class.
    Other columns of ``docs`` are not used and may have any name.
    """
    rows = narrow(docs, doc_id=doc_id, text=text).filter("doc_id IS NOT NULL")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    sketches = materialise(rows.mapInArrow(_sketch(config), "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>"))
    classes = materialise(
        sketches.filter("n_shingles > 0")
        .groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("n_shingles").alias("n_shingles"))
    )
    buckets = classes.select("rep", F.explode("keys").alias("key"))
    hubs = buckets.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = buckets.join(hubs, "key").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    groups = connected_components(stars)
    members = groups.join(classes.select(F.col("rep").alias("node"), "keys", "n_shingles"), "node")
    sizes = groups.join(classes.select(F.col("rep").alias("node"), "n_shingles"), "node")
    sizes = sizes.groupBy("component").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("total"))
    large = (F.col("docs") > config.group_docs) | (F.col("total") > config.group_shingles)
    members = members.join(sizes.select("component", large.alias("large")), "component")
    members = materialise(members.select(F.col("node").alias("doc_id"), "component", "keys", "n_shingles", "large"))

    texts = rows.join(members, "doc_id").dropDuplicates(["doc_id"])
    schema = "doc_id long, component long, keys array<long>, n_shingles long, large boolean, items binary"
    ordered = texts.select("doc_id", "component", "keys", "n_shingles", "large", "text")
    full = materialise(ordered.mapInArrow(_full_sets(config), schema))
    none = {"bucket": F.lit(-1), "key": F.lit(0).cast("long"), "block": F.lit(0), "low": F.lit(0), "high": F.lit(0)}
    columns = ["doc_id", "keys", "items", "component", *none]
    tasks = full.filter("not large").withColumns(none).select(*columns)
    split = _split_hot(full.filter("large"), config).select(*columns)
    links = (
        tasks.unionByName(split).groupBy("component", "bucket", "key", "low", "high").applyInPandas(_links(config), "a long, b long")
    )
    found = materialise(connected_components(links))
    named = classes.join(found, classes["rep"] == found["node"], "left").select(
        "d1", "d2", F.coalesce("component", "rep").alias("component_id")
    )
    joined = sketches.select("doc_id", "n_shingles", "d1", "d2").join(materialise(named), ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", config: NearConfig = NearConfig()) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns."""
    gone = near_duplicates(docs, text, doc_id, config).filter("not kept").select(F.col("doc_id").alias(doc_id))
    return docs.join(gone, doc_id, "left_anti").select(*docs.columns)
