"""Toxicity by compression distance to two trained zstandard dictionaries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coastgrid.llm.boosting import logistic
from coastgrid.llm.common import narrow

#: Known to both dictionaries and put before each window, so that the fixed cost of a first
#: match is the same on either side.
MARK = bytes(range(1, 9)) * 2
GAIN_STEPS = 8
#: Savings above this are not told apart.
MOST_GAIN = 64
#: Bits of the hash table of the toxic dictionary's runs of bytes.
HASH_BITS = 20


@dataclass(frozen=True)
class ToxicityConfig:
    """Bounds of the training sample, and the method's parameters.

    At most ``toxic_docs`` and ``ordinary_docs`` labelled documents of at most ``longest_chars``
    characters train the dictionaries and, in ``folds`` parts, weights and threshold.  A stretch of
    text trains the toxic dictionary if its ``gram`` bytes occur in a share ``support`` of the toxic documents
    and ``ratio`` times as often as in ordinary ones, which train theirs whole.  ``windows`` are lengths in words.
    """

    toxic_docs: int = 2000
    ordinary_docs: int = 4000
    longest_chars: int = 20_000
    dictionary_bytes: int = 4096
    gram: int = 7
    support: float = 0.02
    ratio: float = 10.0
    windows: tuple[int, ...] = (1, 2)
    level: int = 3
    #: Bytes of the shortest match that zstandard makes at ``level`` in windows this short.
    shortest_match: int = 4
    folds: int = 3
    remembered: int = 300_000


def held_out(doc_id):
    """The rows that nothing is learned from: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _normal(text: str) -> bytes:
    return (" " + " ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass")


def _distinct_lines(texts: Iterable[str]) -> list[str]:
    """Texts reduced to lines no earlier one has; mostly repeated ones are left out."""
    seen: set[str] = set()
    out = []
    for text in texts:
        lines = [x for x in text.lower().split("\n") if x.strip()]
        fresh = [x for x in lines if x not in seen]
        seen.update(lines)
        if fresh and 2 * sum(map(len, fresh)) >= sum(map(len, lines)):
            out.append("\n".join(fresh))
    return out


def _grams(data: bytes, size: int) -> np.ndarray:
    """The code of each run of ``size`` (up to 8) bytes."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    codes = np.zeros(max(0, len(x) - size + 1), np.uint64)
    for k in range(size if len(codes) else 0):
        codes = (codes << np.uint64(8)) | x[k : k + len(codes)]
    return codes


def _slots(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)


def _counted(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    every = [np.unique(_grams(t, size)) for t in texts]
    return np.unique(np.concatenate(every or [np.empty(0, np.uint64)]), return_counts=True)


def _own_grams(own, other, own_docs: int, other_docs: int, config: ToxicityConfig) -> np.ndarray:
    """Grams that a class has far more often than the other."""
    grams, counts = own
    their, theirs = other
    against = np.zeros(len(grams))
    if len(their):
        at = np.minimum(np.searchsorted(their, grams), len(their) - 1)
        against = np.where(their[at] == grams, theirs[at], 0)
    often = counts >= max(3, config.support * own_docs)
    return grams[often & (counts / max(1, own_docs) >= config.ratio * (against + 1) / (other_docs + config.ratio))]


def _stretches(data: bytes, grams: np.ndarray, size: int) -> bytes:
    codes = _grams(data, size)
    if not len(codes) or not len(grams):
        return b""
    at = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
    hits = np.flatnonzero(grams[at] == codes)
    if not len(hits):
        return b""
    cut = np.flatnonzero(np.diff(hits) > size)
    starts, ends = hits[np.r_[0, cut + 1]], hits[np.r_[cut, len(hits) - 1]] + size
    return b" ".join(data[a:b] for a, b in zip(starts, ends))


def _train(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of too few samples for the trainer, their own last bytes."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


class CompressionDistance:
    """What the toxic dictionary saves over the ordinary one, window by window.

    Windows overlap: one begins at every word.  A window of which no ``shortest_match`` bytes
    in a row are in the toxic dictionary cannot be compressed by it and saves nothing, so only the others are compressed.
    """

    def __init__(self, toxic: bytes, ordinary: bytes, config: ToxicityConfig):
        self.config = config
        self.coders = [self._coder(d + MARK) for d in (ordinary, toxic)]
        self.known: dict[bytes, int] = {}
        self.fixed = len(self.coders[1].compress(MARK))
        self.matched = np.zeros(1 << HASH_BITS, bool)
        self.matched[_slots(_grams(toxic, config.shortest_match))] = True

    def _coder(self, content: bytes) -> zstandard.ZstdCompressor:
        # As raw content: a trained entropy table would price single letters, not phrases.
        trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(
            level=self.config.level, dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False
        )

    def _gain(self, window: bytes) -> int:
        gain = self.known.get(window)
        if gain is None:
            ordinary, toxic = self.coders
            gain, size = 0, len(toxic.compress(MARK + window))
            # Else the toxic dictionary shortens nothing; longer runs of literals have longer headers.
            if size < len(window) + self.fixed + (len(window) > 31) + (len(window) > 4095):
                gain = min(max(0, len(ordinary.compress(MARK + window)) - size), MOST_GAIN)
            if len(self.known) >= self.config.remembered:
                self.known.clear()
            self.known[window] = gain
        return gain

    def features(self, text: str) -> np.ndarray:
        """Per window length: how many windows save at least 1, 2, ... bytes, and the largest saving."""
        data = _normal(text)
        blanks = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        words = max(0, len(blanks) - 1) if data.strip() else 0
        hits = np.flatnonzero(self.matched[_slots(_grams(data, self.config.shortest_match))]) if words else np.empty(0, int)
        out = []
        for size in self.config.windows:
            counts = np.zeros(MOST_GAIN + 1)
            if words and len(hits):
                # A text shorter than a window is one window.
                starts, ends = blanks[: max(1, words - size + 1)], blanks[min(size, words) :] + 1
                some = np.searchsorted(hits, starts) < np.searchsorted(hits, ends - self.config.shortest_match, side="right")
                for start, end in zip(starts[some].tolist(), ends[some].tolist()):
                    counts[self._gain(data[start:end])] += 1
            counts[0] = 0
            largest = counts.nonzero()[0].max(initial=0)
            out += [np.log1p(counts[::-1].cumsum()[::-1][1 : GAIN_STEPS + 1]), [largest / 4]]
        return np.concatenate([*out, [np.log1p(words) / 4, 1.0]])


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    config: ToxicityConfig

    def scorer(self) -> CompressionDistance:
        return CompressionDistance(self.toxic, self.ordinary, self.config)


def _dictionaries(toxic: list[str], ordinary: list[str], config: ToxicityConfig) -> tuple[bytes, bytes]:
    one, two = ([_normal(t) for t in _distinct_lines(x)] for x in (toxic, ordinary))
    counts = [_counted(x, config.gram) for x in (one, two)]
    own = _own_grams(counts[0], counts[1], len(one), len(two), config)
    return _train([_stretches(t, own, config.gram) for t in one], config.dictionary_bytes), _train(two, config.dictionary_bytes)


def _best_cut(raw: np.ndarray, y: np.ndarray) -> float:
    """The cut of ``raw`` at which precision and recall of the toxic rows agree best (largest F1), amid its neighbours."""
    order = np.argsort(-raw, kind="stable")
    raw, caught = raw[order], y[order].cumsum()
    f1 = 2 * caught / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][raw[:-1] == raw[1:]] = -1  # No cut between equal values.
    at = int(f1.argmax())
    return float((raw[at] + raw[min(at + 1, len(raw) - 1)]) / 2)


def fit(toxic: list[str], ordinary: list[str], share: float, config: ToxicityConfig) -> ToxicityModel:
    """Dictionaries from all texts; weights and threshold from savings by dictionaries that have not seen the text.

    For those, each of ``folds`` parts is measured with dictionaries of the other parts.  ``share`` is the share of
    toxic documents that scores are calibrated for.  The constant is then moved so that 0.5 is
    the score at which precision and recall agree best, measured likewise on parts the weights have not seen.
    With fewer texts of a class than folds the score is ``share`` for every text.
    """
    dictionaries = _dictionaries(toxic, ordinary, config)
    distance = CompressionDistance(*dictionaries, config)
    weights = np.zeros(len(distance.features("")))
    folds = config.folds
    if min(len(toxic), len(ordinary)) < folds:
        weights[-1] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return ToxicityModel(*dictionaries, tuple(weights), config)
    x, y, part = [], [], []
    for k in range(folds):
        others = ([t for n, t in enumerate(texts) if n % folds != k] for texts in (toxic, ordinary))
        distance = CompressionDistance(*_dictionaries(*others, config), config)
        for label, texts in ((1.0, toxic[k::folds]), (0.0, ordinary[k::folds])):
            x += [distance.features(t) for t in texts]
            y += [label] * len(texts)
            part += [k] * len(texts)
    x, y, part = np.array(x), np.array(y), np.array(part)
    weight = np.where(y == 1, share * len(y) / len(toxic), (1 - share) * len(y) / len(ordinary))
    weights = logistic(x, y, weight)
    unseen = np.zeros(len(y))
    for k in range(folds):
        unseen[part == k] = x[part == k] @ logistic(x[part != k], y[part != k], weight[part != k])
    weights[-1] -= _best_cut(unseen, y)
    return ToxicityModel(*dictionaries, tuple(weights), config)


def fit_from_labels(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", config: ToxicityConfig = ToxicityConfig()
) -> ToxicityModel:
    """Fits on a bounded sample of labelled rows, none of them held out.

    The sample is that of the smallest hashed ids, so it depends on nothing but the rows.
    Null labels, ids and texts, and texts above ``longest_chars``, are not learned from.
    """
    marks = narrow(labels, doc_id=doc_id, label=label).filter(~held_out("doc_id") & F.col("label").isNotNull())
    share = marks.agg(F.avg("label")).first()[0]
    rows = narrow(docs, doc_id=doc_id, text=text).filter(~held_out("doc_id"))
    rows = rows.filter(F.char_length("text").between(1, config.longest_chars))
    # The ids are chosen first, so that only their texts are moved.
    chosen = marks.filter("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.toxic_docs)
    chosen = chosen.unionByName(marks.filter("label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.ordinary_docs))
    found = rows.join(chosen, "doc_id").select("doc_id", "label", "text")
    # Once more, since rows may share an id.
    first = lambda label, count: found.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(count).collect()
    sample = first(1, config.toxic_docs) + first(0, config.ordinary_docs)
    sample.sort(key=lambda r: (r["doc_id"], r["text"]))
    by = lambda value: [r["text"] for r in sample if r["label"] == value]
    return fit(by(1), by(0), float(share or 0.0), config)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Each whole text is cut into overlapping windows of words; both dictionaries compress each window
    that the toxic one can shorten, and the bytes it saves over the other are counted by size.  A logistic
    function fitted on texts the dictionaries had not seen turns the counts into a score.

    Null and empty texts have no windows and get the score of that.  Null ids and repeated rows
    are kept.  Other columns of ``docs`` are not used and may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance, weights = model.scorer(), np.array(model.weights)
        for batch in batches:
            raw = np.array([distance.features(t.as_py() or "") @ weights for t in batch.column("text")], float)
            scores = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype("int32"), pa.int32())],
                ["doc_id", "score", "predicted"],
            )

    rows = narrow(docs, doc_id=doc_id, text=text)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
