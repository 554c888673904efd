"""Licence notices by a positional index of rare template words."""

from __future__ import annotations

import math
import string
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coastgrid.llm.common import narrow


@dataclass(frozen=True)
class Template:
    """A notice: its label, its text, and the phrases without which it does not count."""

    label: str
    text: str
    phrases: tuple[str, ...]


#: Phrases that count wherever their words stand consecutively.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Wording of public licences and of the notices that name them.
TEMPLATES = (
    Template("mit", "released under the MIT License", ("mit license",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        ' files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,'
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge to any person obtaining a copy of this software", "to deal in the software without restriction"),
    ),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("apache-1.1", "Licensed under the Apache Software License, Version 1.1", ("apache software license version 1 1",)),
    Template(
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
        " derived from this software without specific prior written permission",
        ("may be used to endorse or promote products derived from this software",),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met: Redistributions of source code must retain the above copyright notice",
        ("redistribution and use in source and binary forms", "are permitted provided that"),
    ),
    Template("bsd", "released under the BSD License", ("bsd license",)),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies",
        ("for any purpose with or without fee is hereby granted",),
    ),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template(
        "gpl-2.0",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        ("gnu general public license as published by the free software foundation", "version 2 of the license"),
    ),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template(
        "gpl-3.0",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License",
        ("gnu general public license as published by the free software foundation", "version 3 of the license"),
    ),
    Template("lgpl-2.1", "licensed under the GNU Lesser General Public License, version 2.1", ("lesser general public license version 2 1",)),
    Template("lgpl-3.0", "licensed under the GNU Lesser General Public License, version 3", ("lesser general public license version 3",)),
    Template("agpl-3.0", "licensed under the GNU Affero General Public License, version 3", ("affero general public license version 3",)),
    Template("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    Template("mpl-2.0", "licensed under the Mozilla Public License, version 2.0", ("mozilla public license version 2 0",)),
    Template("epl-2.0", "made available under the terms of the Eclipse Public License 2.0", ("eclipse public license 2 0",)),
    Template("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license version 1 0",)),
    Template("ofl-1.1", "licensed under the SIL Open Font License, Version 1.1", ("open font license version 1 1",)),
    Template(
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable"
        " for any damages arising from the use of this software",
        ("in no event will the authors be held liable for any damages arising from the use of this software",),
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain",
        ("free and unencumbered software released into the public domain",),
    ),
    Template(
        "cc0-1.0",
        "has waived all copyright and related or neighboring rights to this work",
        ("waived all copyright and related or neighboring rights",),
    ),
    Template("cc0-1.0", "released under CC0 1.0", ("cc0 1 0",)),
    Template("cc-by-4.0", "licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-nd-4.0", "licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
    Template("cc-by-nc-sa-4.0", "licensed under CC BY-NC-SA 4.0", ("cc by nc sa 4 0",)),
    Template("cc-by-nc-nd-4.0", "licensed under CC BY-NC-ND 4.0", ("cc by nc nd 4 0",)),
    Template(
        "cc-by-4.0",
        "licensed under a Creative Commons Attribution 4.0 International License",
        ("creative commons attribution 4 0",),
    ),
    Template(
        "cc-by-sa-4.0",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        ("creative commons attribution sharealike 4 0",),
    ),
    Template(
        "cc-by-nc-4.0",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        ("creative commons attribution noncommercial 4 0",),
    ),
    Template(
        "proprietary",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, without the prior"
        " written permission of the publisher",
        ("no part of this publication may be reproduced",),
    ),
)

#: Words a template word may stand away from its place, before or after.
DRIFT = 3
#: Least part of a template that must be found, its words weighed by rarity.
SHARE = 0.6


def _word_bytes() -> bytes:
    """A-Z becomes a-z, digits, a-z and everything beyond ASCII stay, the rest parts words."""
    kept = set(string.digits + string.ascii_lowercase)
    return bytes(ord(c.lower()) if (c := chr(b)).lower() in kept else b if b >= 0x80 else 0x20 for b in range(256))


WORD_BYTES = _word_bytes()


def words(text: str | None) -> list[bytes]:
    """The words of a whole text, lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def _stands(phrase: Sequence[bytes], found: Sequence[bytes], start: int) -> bool:
    return start >= 0 and found[start : start + len(phrase)] == phrase


class LicenseIndex:
    """Postings ``word -> (template, position)`` of all templates, and each word's rarity.

    A template is looked up by its highest-IDF word among those its phrases demand, so that
    a file without that word costs one look-up, and no file that holds the template is missed.
    """

    def __init__(self, documents: int, frequency: Mapping[str, int], templates: Sequence[Template], phrases: Mapping[str, str], drift: int, share: float):
        self.drift, self.share = drift, share
        idf = lambda w: 1.0 + math.log((documents + 1) / (frequency.get(w.decode(), 0) + 1))
        rarest = lambda ws: max(range(len(ws)), key=lambda n: (idf(ws[n]), -n))
        #: Per anchor: the phrases it finds, as ``(words, place of the anchor, label)``.
        self.phrases: dict[bytes, list[tuple[list[bytes], int, str]]] = defaultdict(list)
        for phrase, label in phrases.items():
            at = rarest(told := words(phrase))
            self.phrases[told[at]].append((told, at, label))
        #: Per anchor: ``(template, place of the anchor in it)``.
        self.anchored: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        #: Per template: label, ``(idf, place, word)`` by falling rarity, phrases with their places.
        self.templates: list[tuple[str, list[tuple[float, int, bytes]], list[tuple[list[bytes], int]]]] = []
        for n, template in enumerate(templates):
            told = words(template.text)
            demanded = []
            for phrase in template.phrases:
                needed = words(phrase)
                start = next((s for s in range(len(told)) if _stands(needed, told, s)), None)
                if not needed or start is None:
                    raise ValueError(f"the text of {template.label!r} does not hold its phrase {phrase!r}")
                demanded.append((needed, start))
            places = [start + k for needed, start in demanded for k in range(len(needed))]
            anchor = max(places, key=lambda p: (idf(told[p]), -p))
            self.anchored[told[anchor]].append((n, anchor))
            by_rarity = sorted(((idf(w), p, w) for p, w in enumerate(told)), key=lambda x: (-x[0], x[1]))
            self.templates.append((template.label, by_rarity, demanded))
        self.anchors = {*self.phrases, *self.anchored}
        self.vocabulary = {w for _, by_rarity, _ in self.templates for _, _, w in by_rarity} | self.anchors

    def _template_share(self, n: int, starts: np.ndarray, places: Mapping[bytes, np.ndarray], found: Sequence[bytes]) -> float:
        """The largest share of template ``n`` at any start where its phrases stand; 0 below the least share.

        Postings are intersected by relative position, rarest word first; a start leaves when
        the words still to come cannot bring it to the least share.
        """
        _, by_rarity, demanded = self.templates[n]
        total = sum(weight for weight, _, _ in by_rarity)
        got, rest = np.zeros(len(starts)), total
        for weight, place, word in by_rarity:
            rest -= weight
            at = places.get(word)
            if at is not None:
                first = np.searchsorted(at, starts + (place - self.drift))
                near = first < len(at)
                near[near] = at[first[near]] <= starts[near] + (place + self.drift)
                got = got + weight * near
            alive = got + rest >= self.share * total * (1 - 1e-9)
            starts, got = starts[alive], got[alive]
            if not len(starts):
                return 0.0
        best = 0.0
        for start, share in zip(starts.tolist(), (got / total).tolist()):
            if share > best and all(
                any(_stands(phrase, found, start + place + d) for d in range(-self.drift, self.drift + 1)) for phrase, place in demanded
            ):
                best = min(1.0, share)
        return best

    def scan(self, text: str | None) -> tuple[int, list[int], set[str], set[str], float]:
        """``(words, starts of phrases, their labels, labels of templates, score)`` of a whole text."""
        found = words(text)
        anchors = self.anchors.intersection(found)
        if not anchors:
            return len(found), [], set(), set(), 0.0
        placed: dict[bytes, list[int]] = defaultdict(list)
        for p, word in enumerate(found):
            if word in self.vocabulary:
                placed[word].append(p)
        places = {word: np.array(ps) for word, ps in placed.items()}
        starts, base, labels, score = [], set(), set(), 0.0
        for anchor in sorted(anchors):
            for phrase, at, label in self.phrases.get(anchor, ()):
                here = [p - at for p in placed[anchor] if _stands(phrase, found, p - at)]
                if here:
                    starts += here
                    base.add(label)
                    score = 1.0
            for n, at in self.anchored.get(anchor, ()):
                share = self._template_share(n, places[anchor] - at, places, found)
                if share > 0:
                    labels.add(self.templates[n][0])
                    score = max(score, share)
        return len(found), starts, base, labels, score


def word_frequencies(docs: DataFrame, vocabulary: Iterable[str], text: str = "text") -> dict[str, int]:
    """Documents that hold each word of ``vocabulary``, and under ``""`` all of them.

    Counted over every whole text, inside the tasks first; what comes to the driver has
    one number per word of the vocabulary at most.
    """
    wanted = frozenset(w.encode() for w in vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            counts[b""] += batch.num_rows
            for value in batch.column("text"):
                for word in wanted.intersection(words(value.as_py())):
                    counts[word] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
        )

    found = narrow(docs, text=text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in found.collect()}


def build_index(
    docs: DataFrame,
    text: str = "text",
    templates: Sequence[Template] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    drift: int = DRIFT,
    share: float = SHARE,
) -> LicenseIndex:
    """The index of ``templates`` and ``phrases``, with rarity counted over all of ``docs``."""
    vocabulary = {w.decode() for told in [*(t.text for t in templates), *phrases] for w in words(told)}
    frequency = word_frequencies(docs, vocabulary, text)
    return LicenseIndex(frequency.pop("", 0), frequency, templates, phrases, drift, share)


SCANNED = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, index: LicenseIndex, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Words are runs of letters, digits and everything beyond ASCII, lower-cased in A-Z only.
    ``n_base`` counts the places where the words of a phrase stand consecutively, overlapping ones
    too; ``first_word`` and ``last_word`` are the smallest and largest start, null without any.

    Templates are looked up by the rarest word their phrases demand; the postings of the others
    are intersected by relative position, up to ``drift`` words away, rarest first.  A template
    counts if ``share`` of its weight stands there and each demanded phrase stands word for word,
    within the drift of its place.  ``labels`` has ``base_labels`` too; both are distinct, sorted
    and comma-joined, empty without any.  ``score`` is the largest share found, 1 for a phrase, else 0.

    Texts are read whole, one at a time.  Null and empty texts have no words.  Null ids and
    repeated rows are kept, and so are copies, each on its own; an empty table gives no rows.
    Other columns of ``docs`` are not used and may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                n, starts, base, labels, score = index.scan(value.as_py())
                rows.append((n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            arrays = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *(c.split()[0] for c in SCANNED.split(", "))])

    rows = narrow(docs, doc_id=doc_id, text=text)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCANNED}")
