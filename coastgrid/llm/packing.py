"""Hierarchical packing of documents into sequences of several context sizes."""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from coastgrid.llm.common import narrow
from coastgrid.llm.tokens import tokenizer

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "context_size long, padded_length long, step_group long, ids binary"
)


@dataclass(frozen=True)
class PackingConfig:
    """``tiers`` are context sizes, powers of two; a sequence of a tier fills it exactly.

    ``pool_tokens`` bounds what a task holds while it packs, ``step_tokens`` is the size of
    a step group.  ``end_id`` closes every document.
    """

    tiers: tuple[int, ...] = (256, 512, 1024, 2048)
    end_id: int = 1
    pool_tokens: int = 2_000_000
    step_tokens: int = 64 * 2048


class Packer:
    """Packs pieces (document number, start, length); holds no texts or ids."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tuple(sorted(tiers))
        self.rest: list[tuple[int, int, int]] = []  # by length

    def add(self, doc: int, length: int) -> list[list[tuple[int, int, int]]]:
        """Routes a document: whole windows of the longest tier at once, what is left by its length."""
        longest, out = self.tiers[-1], []
        for start in range(0, length - longest + 1, longest):
            out.append([(doc, start, longest)])
        if length % longest:
            insort(self.rest, (length % longest, doc, length - length % longest))
        return out

    def _take(self, at: int) -> tuple[int, int, int]:
        length, doc, start = self.rest.pop(at)
        return doc, start, length

    def pack(self, last: bool) -> list[list[tuple[int, int, int]]]:
        """Fills a window for each piece, longest first, from the tier that the piece belongs to.

        The gap takes the longest shorter pieces that fit; what then is left of it takes
        the head of a piece that is cut.  A window for which too few tokens are left waits, or
        with ``last`` becomes a part of the closing sequences.
        """
        out = []
        left = sum(x[0] for x in self.rest)
        for tier in reversed(self.tiers):
            floor = max((t for t in self.tiers if t < tier), default=0)
            while self.rest and floor < self.rest[-1][0] <= tier <= left:
                window = [self._take(-1)]
                gap = tier - window[0][2]
                while gap and self.rest:
                    at = bisect_right(self.rest, (gap, np.inf)) - 1
                    if at < 0:
                        break
                    window.append(self._take(at))
                    gap -= window[-1][2]
                if gap:  # only pieces longer than the gap are left: cut the shortest
                    doc, start, length = self._take(bisect_left(self.rest, (gap,)))
                    window.append((doc, start, gap))
                    insort(self.rest, (length - gap, doc, start + gap))
                left -= tier
                out.append(window)
        if last:
            waiting = [self._take(-1) for _ in range(len(self.rest))]
            while left:  # the tail of a task: powers of two while they fit, then one padded sequence
                size = max((t for t in self.tiers if t <= left), default=left)
                window, gap = [], size
                while gap:
                    doc, start, length = waiting.pop()
                    window.append((doc, start, min(length, gap)))
                    if length > gap:
                        waiting.append((doc, start + gap, length - gap))
                    gap -= window[-1][2]
                out.append(window)
                left -= size
        return out


def _step_groups(lengths: list[int], group_tokens: int) -> list[int]:
    """Groups of about equal tokens: the longest sequence goes to the lightest group."""
    count = max(1, round(sum(lengths) / group_tokens))
    heap = [(0, g) for g in range(count)]
    groups = [0] * len(lengths)
    for n in sorted(range(len(lengths)), key=lambda n: -lengths[n]):
        load, g = heap[0]
        heapq.heapreplace(heap, (load + lengths[n], g))
        groups[n] = g
    return groups


def pack_documents(
    docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", config: PackingConfig = PackingConfig(), with_ids: bool = True
) -> DataFrame:
    """Token sequences of all documents, one row per piece.

    ``doc_id, start, length, doc_tokens`` say where in its document a piece lies, ``sequence_id,
    offset`` where in its sequence; ``ids`` are its ids (little-endian 32-bit, null without
    ``with_ids``) and ``ids_crc32`` their checksum.  ``context_size`` is the sequence's tier,
    ``padded_length`` its length with padding, ``step_group`` a group of sequences of
    about ``step_tokens``, balanced within the task that made it.

    A document's ids end with ``end_id``.  It is routed to the longest tier for its whole windows and to
    the smallest tier that holds what is left.  Windows of a tier start with one piece of
    that tier, their gap is filled with the longest shorter pieces that fit, and at last
    with the head of a piece that is cut, so they are full and need no padding.  What
    cannot fill a window waits for later documents of the task; a task ends with at most
    one sequence per tier and one padded one.

    Each task packs its own documents in pools of bounded size: nothing is shuffled, so no key
    can be hot, and a lost task is repeated alone with the same sequence ids, which carry
    the number of the partition.

    Null and empty texts have just the closing id.  Null document ids and repeated rows are packed
    like others.  Texts are encoded whole.  Other columns of ``docs`` may have any name.
    """
    tiers = tuple(sorted(config.tiers))
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = tokenizer(path), Packer(tiers)
        base = TaskContext.get().partitionId() << 36
        held: dict[int, tuple] = {}  # document number: id, ids, tokens not written yet
        number, pooled, next_sequence, next_group = 0, 0, 0, 0
        ready: list[list[tuple[int, int, int]]] = []

        def rows(windows: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
            nonlocal next_sequence, next_group
            sizes = [sum(p[2] for p in w) for w in windows]
            groups = _step_groups(sizes, config.step_tokens)
            out = []
            for window, size, group in zip(windows, sizes, groups):
                offset = 0
                tier = next(t for t in tiers if t >= size)
                padded = size if size & (size - 1) == 0 else tiers[-1]
                for doc, start, length in window:
                    name, ids, unwritten = held[doc]
                    part = ids[start : start + length].tobytes()
                    out.append(
                        (name, start, length, zlib.crc32(part), len(ids), base + next_sequence, offset, tier, padded, base + next_group + group, part if with_ids else None)
                    )
                    offset += length
                    if unwritten == length:
                        del held[doc]
                    else:
                        held[doc] = (name, ids, unwritten - length)
                next_sequence += 1
            next_group += max(groups, default=-1) + 1
            kinds = [pa.int64()] * 10 + [pa.binary()]
            columns = zip(*out) if out else [[]] * 11
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for name, value in zip(batch.column("doc_id"), batch.column("text")):
                ids = np.append(coder.ids(value.as_py() or ""), np.array([config.end_id], "<u4")).astype("<u4", copy=False)
                held[number] = (name.as_py(), ids, len(ids))
                ready += packer.add(number, len(ids))
                number += 1
                pooled += len(ids)
                if pooled >= config.pool_tokens:
                    ready += packer.pack(last=False)
                    yield rows(ready)
                    ready, pooled = [], 0
        ready += packer.pack(last=True)
        if ready:
            yield rows(ready)

    rows_in = narrow(docs, doc_id=doc_id, text=text)
    return rows_in.mapInArrow(run, SCHEMA)
