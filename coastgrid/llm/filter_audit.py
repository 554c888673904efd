"""How text filters interact in every order, by decision diagrams of their failures."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coastgrid.functions.session import materialise
from coastgrid.llm.common import narrow

#: The filters in bit order: few words, few distinct words, capitals, symbols, an earlier copy.
FILTERS = "ABCDE"
UPPER = string.ascii_uppercase.encode()
SYMBOLS = b"#$%&*|"
STEPS = "filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
Weights = tuple[int, int, int]


def adjacent_swaps(k: int) -> Iterator[int]:
    """Places ``i`` whose swaps with ``i + 1``, one after the other, lead through all orders of ``k`` things."""
    if k < 2:
        return
    inner = adjacent_swaps(k - 1)
    while True:
        yield from range(k - 2, -1, -1)
        if (place := next(inner, None)) is None:
            return
        yield place + 1
        yield from range(k - 1)
        if (place := next(inner, None)) is None:
            return
        yield place


class FailureDiagram:
    """A decision diagram over failure masks whose nodes carry what they weigh.

    Level n tests ``order[n]``; every node has a pass and a fail edge.  Equal subdiagrams
    are one node, and whatever weighs nothing is the empty node 0 on every level.
    """

    def __init__(self, masks: Mapping[int, Weights], filters: int):
        self.order = list(range(filters))
        self.edges: list[tuple[int, int]] = [(0, 0)]
        self.weights: list[Weights] = [(0, 0, 0)]
        self.shared: dict[tuple, int] = {}
        self.levels: list[set[int]] = [set() for _ in range(filters)]
        level = {m: self._leaf(w) for m, w in masks.items()}
        for n in reversed(range(filters)):
            bit = 1 << n
            level = {m: self._node(n, level.get(m, 0), level.get(m | bit, 0)) for m in {m & ~bit for m in level}}
        self.root = level.get(0, 0)

    def _leaf(self, weights: Weights) -> int:
        return self._new(("leaf", weights), (0, 0), weights) if any(weights) else 0

    def _new(self, key: tuple, edges: tuple[int, int], weights: Weights) -> int:
        if key not in self.shared:
            self.shared[key] = len(self.edges)
            self.edges.append(edges)
            self.weights.append(weights)
        return self.shared[key]

    def _node(self, level: int, passes: int, fails: int) -> int:
        """The node of the filter at ``level`` with these edges."""
        if not (passes or fails):
            return 0
        weights = tuple(map(sum, zip(self.weights[passes], self.weights[fails])))
        node = self._new((self.order[level], passes, fails), (passes, fails), weights)
        self.levels[level].add(node)
        return node

    def swap(self, n: int) -> None:
        """Exchanges levels ``n`` and ``n + 1``; nodes of level n keep their place, so nothing above changes."""
        upper = self.levels[n]
        self.levels[n + 1] = set()
        for node in upper:
            self.shared.pop((self.order[n], *self.edges[node]), None)
        self.order[n], self.order[n + 1] = self.order[n + 1], self.order[n]
        for node in upper:
            passes, fails = self.edges[node]
            (pp, pf), (fp, ff) = self.edges[passes], self.edges[fails]
            self.edges[node] = self._node(n + 1, pp, fp), self._node(n + 1, pf, ff)
            self.shared[(self.order[n], *self.edges[node])] = node

    def all_pass(self) -> Iterator[tuple[int, Weights, Weights]]:
        """Along the path that passes everything: filter, what weighs the pass edge, what the fail edge."""
        node = self.root
        for filter_ in self.order:
            passes, fails = self.edges[node]
            yield filter_, self.weights[passes], self.weights[fails]
            node = passes


def steps_of_orders(masks: Mapping[int, Weights], filters: str = FILTERS) -> list[tuple]:
    """All orders with their steps, as rows of ``STEPS``, from the weights (rows, good, toxic) of failure masks."""
    diagram = FailureDiagram(masks, len(filters))
    fails = [sum(w[0] for m, w in masks.items() if m >> f & 1) for f in range(len(filters))]
    paths, unique, shapley = [], [0] * len(filters), [0] * len(filters)
    for place in [None, *adjacent_swaps(len(filters))]:
        if place is not None:
            diagram.swap(place)
        path = list(diagram.all_pass())
        paths.append(path)
        last, _, (only, _, _) = path[-1]
        unique[last] = only
        for f, _, (removed, _, _) in path:
            shapley[f] += removed
    rows = []
    for path in paths:
        order = "".join(filters[f] for f, _, _ in path)
        for step, (f, (kept, _, _), (removed, good, toxic)) in enumerate(path, 1):
            rows.append((order, step, kept, removed, fails[f] - removed, unique[f], good, toxic, shapley[f]))
    return rows


def audit_orders(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from ``part, mask, n, good, toxic``.

    ``mask`` has bit k where the k-th letter of ``filters`` fails.  Rows are summed by part and
    mask first, so that a diagram is built from at most ``2 ** len(filters)`` rows however many
    rows a part has.  Masks that are null count as passing all; an empty table gives no rows.
    """
    sums = masks.groupBy("part", F.coalesce("mask", F.lit(0)).alias("mask")).agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    parts = sums.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", *(c.split()[0] for c in STEPS.split(", "))]
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * (len(names) - 3)]
        for batch in batches:
            for part, masks in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist()):
                weights = {m["mask"]: (m["n"], m["good"], m["toxic"]) for m in masks}
                rows = [(part, *row) for row in steps_of_orders(weights, filters)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return parts.mapInArrow(run, f"part string, {STEPS}")


def text_failures(text: str) -> tuple[int, bytes]:
    """The mask of the filters A to D, which see one text alone, and its digest."""
    data = text.encode("utf-8", "surrogatepass")
    found = data.split()  # at \x20 and \x09-\x0D
    mask = (
        (len(found) < 200)
        | (100 * len(set(found)) < 50 * len(found)) << 1
        | (100 * (len(data) - len(data.translate(None, UPPER))) > 2 * len(text)) << 2
        | (len(data.translate(None, SYMBOLS)) < len(data)) << 3
    )
    return int(mask), hashlib.sha256(data).digest()


def failure_masks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """``doc_id, part, mask``: which of the five filters each document fails.

    A: under 200 words; B: fewer distinct words than half of them; C: over 2 % capitals A-Z;
    D: one of ``#$%&*|``; E: a smaller id has the same text (by SHA-256), removed or not.

    Null text counts as empty, a null part is the empty one.  Repeated rows of one id are no
    copies of each other; a null id is neither smaller nor larger than any.  The texts are
    read once: their masks and digests are written, and all that follows reads those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_failures(value.as_py() or "") for value in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array([m for m, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())],
                ["doc_id", "part", "mask", "digest"],
            )

    rows = narrow(docs, doc_id=doc_id, text=text, part=part)
    rows = rows.withColumn("part", F.coalesce(F.col("part").cast("string"), F.lit("")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    seen = materialise(rows.mapInArrow(run, f"doc_id {kind}, part string, mask int, digest binary"))
    # Only groups of several rows are joined; the hot side is the left one, which Spark splits.
    groups = seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    copies = seen.join(materialise(groups), "digest", "left")
    late = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return copies.select("doc_id", "part", (F.col("mask") + F.when(late, 16).otherwise(0)).alias("mask"))


def with_labels(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic`` of every document; an id is good or toxic if any label row says so."""
    told = narrow(labels, doc_id="doc_id", quality="quality", toxic="toxic").filter("doc_id IS NOT NULL")
    said = told.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flag = lambda c: F.when(F.col(c), 1).otherwise(0).cast("long").alias(c)
    return masks.join(said, "doc_id", "left").select("part", "mask", F.lit(1).cast("long").alias("n"), flag("good"), flag("toxic"))


def audit_filters(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """Per part, order of the five filters and step: ``part`` and the columns of ``STEPS``.

    ``kept`` and ``removed`` are counts after and at the step, ``redundant`` fail its filter but left
    earlier, ``unique_fails`` fail nothing else, ``good_lost`` and ``toxic_lost`` are labelled rows
    among the removed, ``shapley`` is what the filter removes, summed over all orders.  Failures and edge cases
    are as in ``failure_masks``; rows without a label are neither good nor toxic, and null labels say nothing.
    """
    return audit_orders(with_labels(failure_masks(docs, **columns), labels))
