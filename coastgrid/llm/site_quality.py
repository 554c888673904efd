"""Document quality from a classifier and from hosts and paths, by hierarchical empirical Bayes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coastgrid.functions.session import materialise
from coastgrid.llm.boosting import logistic
from coastgrid.llm.common import narrow
from coastgrid.llm.quality_rules import text_statistics

EVIDENCE = ("words", "word_length", "marks", "symbols", "capitals", "repeats", "line_repeats")
#: Probabilities stay this far from 0 and 1, so that no document outweighs every site.
LEAST = 1e-4


@dataclass(frozen=True)
class QualityModel:
    """Weights of the evidence, centred and scaled, and of its squares; the last is the constant."""

    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    share: float

    def probability(self) -> Column:
        """That a document is bad, from its own evidence alone."""
        total = F.lit(self.weights[-1])
        p = len(EVIDENCE)
        for n, name in enumerate(EVIDENCE):
            x = F.greatest(F.least((F.col(name) - self.centre[n]) / self.scale[n], F.lit(8.0)), F.lit(-8.0))
            total = total + self.weights[n] * x + self.weights[p + n] * x * x / 8
        return _inside(1 / (1 + F.exp(-total)))


def _inside(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1 - LEAST)), F.lit(LEAST))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def evidence(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``text``) with the columns of ``EVIDENCE`` instead of the text."""
    counted = text_statistics(F.col("text"), docs)
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    rate = lambda a, b: F.log(0.05 + share(a, b))
    columns = {
        "words": F.log1p("n_words"),
        "word_length": rate("word_chars", "n_words"),
        "marks": rate("n_marks", "n_words"),
        "symbols": rate("n_symbols", "n_words"),
        "capitals": rate("n_capitals", "n_words"),
        "repeats": share("n_repeat_words", "n_words"),
        "line_repeats": share("n_dup_lines", "n_lines"),
    }
    kept = [c for c in docs.columns if c != "text"]
    return counted.select(*kept, *(c.alias(name) for name, c in columns.items()))


def fit(labelled: DataFrame, train_docs: int = 20_000) -> QualityModel:
    """Logistic regression on the evidence of at most ``train_docs`` labelled documents.

    ``labelled`` has ``doc_id, quality`` (1 good, 0 bad) and the columns of ``EVIDENCE``.  Those of the
    smallest hashed ids are taken, seven numbers each.  Without both classes the weights are zero.
    """
    rows = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).select("quality", *EVIDENCE).collect()
    y = np.array([1.0 - r[0] for r in rows])
    x = np.array([[float(v) for v in r[1:]] for r in rows]).reshape(-1, len(EVIDENCE))
    share = min(max(float(y.mean()) if len(y) else 0.5, LEAST), 1 - LEAST)
    if not 0 < y.sum() < len(y):
        return QualityModel((0.0,) * len(EVIDENCE), (1.0,) * len(EVIDENCE), (0.0,) * (2 * len(EVIDENCE)) + (float(np.log(share / (1 - share))),), share)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.clip((x - centre) / scale, -8, 8)
    weights = logistic(np.hstack([z, z * z / 8, np.ones((len(z), 1))]), y, np.ones(len(y)), ridge=1.0)
    return QualityModel(tuple(map(float, centre)), tuple(map(float, scale)), tuple(map(float, weights)), share)


def _strength(groups: DataFrame, rate: Column, docs: Column, prior: Column) -> float:
    """How many documents the prior of a level is worth, by the method of moments.

    Compares the spread of the rates of groups of two or more with what chance alone gives.
    """
    many = groups.filter(docs > 1)
    found = many.agg(
        F.count("*").alias("k"),
        F.sum(docs).alias("n"),
        F.sum(docs * docs).alias("nn"),
        F.sum(docs * (rate - prior) * (rate - prior)).alias("q"),
        F.sum(docs * prior * (1 - prior)).alias("v"),
    ).first()
    if not found["k"] or found["k"] < 2:
        return 1e6
    n, within = float(found["n"]), float(found["v"]) / float(found["n"])
    between = (found["q"] - (found["k"] - 1) * within) / max(n - found["nn"] / n, 1e-9)
    return float(min(max(within / max(between, 1e-9) - 1, 1.0), 1e6))


def site_quality(
    docs: DataFrame,
    sites: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    train_docs: int = 20_000,
    threshold: float = 0.5,
) -> DataFrame:
    """One row per document: ``doc_id, host, path, own, site, bad, kept``.

    ``sites`` has one row per document id with ``host`` and ``path``; ``labels`` have ``quality``, 1 or 0.  ``own`` is the
    classifier's probability that the document is bad, ``site`` that of its place without the
    document itself, ``bad`` both combined, and ``kept`` says that ``bad`` is below ``threshold``.

    Every level is a beta prior for the next: the rate of all documents for hosts, a host's
    posterior for its paths.  How much a prior weighs is estimated from the spread of the
    groups of its level, so a sparse site keeps near its prior and a large one goes by its
    own documents.  Groups are summed inside the tasks, which leaves one row per task and path of a hot host; the
    sums join back by host and path, which Spark splits for a hot key.

    Documents without a site, or with null host or path, take part in the level above alone.
    Null and empty texts have the evidence of no words.  Null ids and repeated rows are kept and
    count as often as they occur; of several sites of an id the smallest is taken.
    Texts are read whole.  Other columns of ``docs`` are not used and may have any name.
    """
    rows = materialise(evidence(narrow(docs, doc_id=doc_id, text=text)))
    marks = narrow(labels, label_doc="doc_id", quality="quality").filter("quality IN (0, 1)")
    model = fit(rows.join(marks, rows["doc_id"] == marks["label_doc"]).drop("label_doc"), train_docs)
    places = narrow(sites, site_doc="doc_id", host="host", path="path").filter("site_doc IS NOT NULL")
    places = places.groupBy("site_doc").agg(F.min(F.struct("host", "path")).alias("s")).select("site_doc", "s.host", "s.path")
    scored = rows.select("doc_id", model.probability().alias("own"))
    scored = materialise(scored.join(places, scored["doc_id"] == places["site_doc"], "left").drop("site_doc"))

    paths = scored.filter("host IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("path_docs"), F.sum("own").alias("path_bad"))
    paths = materialise(paths)
    hosts = materialise(paths.groupBy("host").agg(F.sum("path_docs").alias("host_docs"), F.sum("path_bad").alias("host_bad")))
    overall = scored.agg(F.avg("own")).first()[0]
    prior = F.lit(min(max(float(overall if overall is not None else 0.5), LEAST), 1 - LEAST))
    host_weight = _strength(hosts, F.col("host_bad") / F.col("host_docs"), F.col("host_docs"), prior)
    host_rate = (F.col("host_bad") + host_weight * prior) / (F.col("host_docs") + host_weight)
    both = paths.filter("path IS NOT NULL").join(hosts, "host")
    path_weight = _strength(both, F.col("path_bad") / F.col("path_docs"), F.col("path_docs"), host_rate)

    joined = scored.join(hosts, "host", "left").join(
        paths.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "path_docs", "path_bad"),
        (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")),
        "left",
    )
    without = lambda bad, n: (F.greatest(F.col(bad) - F.col("own"), F.lit(0.0)), F.col(n) - 1)
    host_bad, host_docs = without("host_bad", "host_docs")
    of_host = F.coalesce((host_bad + host_weight * prior) / (host_docs + host_weight), prior)
    path_bad, path_docs = without("path_bad", "path_docs")
    site = _inside(F.coalesce((path_bad + path_weight * of_host) / (path_docs + path_weight), of_host))
    joined = joined.withColumn("site", site)
    total = _logit(F.col("own")) - F.lit(float(np.log(model.share / (1 - model.share)))) + _logit(F.col("site"))
    joined = joined.withColumn("bad", 1 / (1 + F.exp(-total)))
    return joined.select("doc_id", "host", "path", "own", "site", "bad", (F.col("bad") < threshold).alias("kept"))


def sites_of_pages(pages: DataFrame, url: str = "url") -> DataFrame:
    """``doc_id, host, path`` of page addresses whose last number names the document.

    The path is the first part of the address after the host.  Other addresses are left out.
    """
    address = F.col(f"`{url}`")
    number = F.regexp_extract(address, r"/([0-9]+)(?:\.html)?/?(?:[?#].*)?$", 1)
    return pages.select(
        F.when(F.char_length(number).between(1, 18), number.cast("long")).alias("doc_id"),
        F.lower(F.regexp_extract(address, r"^[A-Za-z]+://([^/?#]+)", 1)).alias("host"),
        F.regexp_extract(address, r"^[A-Za-z]+://[^/?#]+/([^/?#]+)/", 1).alias("path"),
    ).filter("doc_id IS NOT NULL AND host != ''")


def merged_sites(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Sites of documents: those of their pages, and of the others their source and language."""
    known = sites_of_pages(pages)
    rest = docs.select("doc_id", F.concat(F.lit("source:"), "source").alias("host"), F.col("lang").alias("path"))
    return known.unionByName(rest.join(known.select("doc_id"), "doc_id", "left_anti"))

