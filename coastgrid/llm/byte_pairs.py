"""Byte-level BPE with a segment tree of pair ranks."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from coastgrid.llm.common import narrow

NONE = np.int64(2**62)
#: Bits of a tree entry that hold the position; the pair's rank stands above them.
PLACE_BITS = 32
PLACE = np.int64(2**PLACE_BITS - 1)
PIECES_CACHED = 400_000
PIECES_AT_ONCE = 200_000
#: Pieces up to this many bytes are merged side by side, longer ones alone.
SIDE_BY_SIDE = 256


class BytePairs:
    """Encodes and decodes by a file of ranks, as lines of base64 token and rank."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.singles = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.known: dict[str, bytes] = {}

    def _entries(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Tree entries of pairs: rank, then place, or ``NONE``."""
        if not len(self.pair_keys):
            return np.full(len(left), NONE)
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (right >= 0), self.pair_ranks[at] << PLACE_BITS | place, NONE)

    def _merge_together(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Merges pieces of at most ``width`` (a power of two) bytes, one tree per row.

        Leaf i holds the rank of the pair that begins at byte i; a node holds the smaller of
        its children, so the root is the leftmost pair of least rank.  A merge changes the
        leaves of the pair, of the part it swallowed and of the live neighbour before it.
        """
        count = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        ids = np.full((count, width + 1), -1, np.int64)
        inside = np.arange(width) < lengths[:, None]
        ids[:, :width][inside] = self.singles[np.frombuffer(b"".join(pieces), np.uint8)]
        following = np.tile(np.arange(1, width + 1), (count, 1))
        before = np.tile(np.arange(-1, width - 1), (count, 1))
        tree = np.full((count, 2 * width), NONE)
        row, at = np.nonzero(inside[:, 1:])
        tree[row, width + at] = self._entries(ids[row, at], ids[row, at + 1], at)
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            i = root & PLACE
            j = following[rows, i]
            ids[rows, i] = root >> PLACE_BITS
            ids[rows, j] = -1
            k = following[rows, j]
            following[rows, i] = k
            more = k < lengths[rows]
            before[rows[more], k[more]] = i[more]
            leaf_rows, leaves = [rows, rows], [i, j]
            entries = [self._entries(ids[rows, i], np.where(more, ids[rows, k], -1), i), np.full(len(rows), NONE)]
            has = before[rows, i] >= 0
            some, h = rows[has], before[rows, i][has]
            leaf_rows.append(some)
            leaves.append(h)
            entries.append(self._entries(ids[some, h], ids[some, i[has]], h))
            r, node = np.concatenate(leaf_rows), np.concatenate(leaves) + width
            tree[r, node] = np.concatenate(entries)
            while width > 1 and node[0] > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
            rows = rows[tree[rows, 1] < NONE]
        return [ids[n, : lengths[n]][ids[n, : lengths[n]] >= 0] for n in range(count)]

    def _merge_alone(self, piece: bytes) -> np.ndarray:
        """The same tree for one long piece, on lists."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        ids = self.singles[np.frombuffer(piece, np.uint8)]
        tree = np.full(2 * width, NONE)
        tree[width : width + n - 1] = self._entries(ids[:-1], ids[1:], np.arange(n - 1))
        level = width // 2
        while level:
            tree[level : 2 * level] = np.minimum(tree[2 * level : 4 * level : 2], tree[2 * level + 1 : 4 * level : 2])
            level //= 2
        tree, ids = tree.tolist(), ids.tolist()
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none, place, pairs = int(NONE), int(PLACE), self.pairs

        def put(at: int, entry: int) -> None:
            node = at + width
            tree[node] = entry
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def entry(left: int, right: int) -> int:
            rank = pairs.get(ids[left] << 32 | ids[right])
            return none if rank is None else rank << PLACE_BITS | left

        while tree[1] < none:
            i = tree[1] & place
            j = following[i]
            ids[i] = tree[1] >> PLACE_BITS
            ids[j] = -1
            k = following[i] = following[j]
            put(j, none)
            if k < n:
                before[k] = i
                put(i, entry(i, k))
            else:
                put(i, none)
            if before[i] >= 0:
                put(before[i], entry(before[i], i))
        return np.array([x for x in ids if x >= 0], np.int64)

    def _learn(self, pieces: Iterable[str]) -> None:
        """Adds the ids of new pieces to the cache, as little-endian 32-bit integers."""
        waiting: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode("utf-8")
            rank = self.ranks.get(data)
            if rank is not None:
                self.known[piece] = rank.to_bytes(4, "little")
            elif len(data) > SIDE_BY_SIDE:
                self.known[piece] = self._merge_alone(data).astype("<u4").tobytes()
            else:
                waiting.setdefault(1 << (len(data) - 1).bit_length(), []).append((piece, data))
        for width, group in waiting.items():
            step = max(1, 2**20 // width)
            for start in range(0, len(group), step):
                part = group[start : start + step]
                for (piece, _), ids in zip(part, self._merge_together([d for _, d in part], width)):
                    self.known[piece] = ids.astype("<u4").tobytes()

    def encode_many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of whole texts, each match of the pattern on its own.

        Matches of several texts, or of a part of a long one, are looked up at a time.
        """
        waiting: list[list[str]] = []
        ends: list[bool] = []
        begun: list[bytes] = []
        count = 0

        def flush() -> Iterator[bytes]:
            if len(self.known) > PIECES_CACHED:
                self.known.clear()
            self._learn(set().union(*waiting).difference(self.known))
            for pieces, ends_text in zip(waiting, ends):
                begun.append(b"".join(map(self.known.__getitem__, pieces)))
                if ends_text:
                    yield b"".join(begun)
                    begun.clear()
            waiting.clear()
            ends.clear()

        for text in texts:
            found = (m.group() for m in self.pattern.finditer(text))
            full = True
            while full:
                pieces = list(islice(found, PIECES_AT_ONCE))
                full = len(pieces) == PIECES_AT_ONCE
                waiting.append(pieces)
                ends.append(not full)
                count += len(pieces)
                if count >= PIECES_AT_ONCE:
                    yield from flush()
                    count = 0
        yield from flush()

    def encode(self, text: str) -> bytes:
        return next(self.encode_many([text]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def byte_pairs(path: str) -> BytePairs:
    """One coder per worker and file."""
    return BytePairs(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id``, ``ids`` (little-endian 32-bit, as bytes), ``n_tokens``.

    ``path`` names a rank file that every worker has.  A text is cut by the tokenizer's pattern and
    each match merged on its own in a segment tree over its bytes.  A match that is a token
    as a whole is that token.  Workers remember the ids of recent matches, up to a fixed number.

    Null and empty texts have no ids; null ids of documents and repeated rows are kept.
    Texts are read whole.  Other columns of ``docs`` are not used and may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pairs(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids = list(coder.encode_many(t.as_py() or "" for t in part.column("text")))
                counts = [len(x) // 4 for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(counts, pa.int64())], ["doc_id", "ids", "n_tokens"]
                )

    rows = narrow(docs, doc_id=doc_id, text=text)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, n_tokens long")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, data``: the bytes of ``ids`` (null: null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pairs(path)
        for batch in batches:
            data = [None if (x := ids.as_py()) is None else coder.decode(x) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, data binary")


def round_trips(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document, from one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``; edge cases as in ``encode_documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pairs(path)
        for batch in batches:
            counts, ones, twos = [], [], []
            for ids in coder.encode_many(value.as_py() or "" for value in batch.column("text")):
                counts.append(len(ids) // 4)
                ones.append(hashlib.sha256(ids).hexdigest())
                twos.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ones, pa.string()), pa.array(twos, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = narrow(docs, doc_id=doc_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
