"""Quality classifier: document evidence, then host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterable
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import common as C

#: Labelled documents that the document classifier is fitted on, at most; the rest of the labels is left for tests.
FIT_ROWS = 20_000
#: A word is chosen if it is so many standard deviations more or less frequent than labels explain.
LEAST_Z = 5.0
WORDS, BINS, MIN_DOCS, STEPS, BIN_DECAY, WORD_DECAY = 2000, 12, 4, 300, 3e-4, 1e-5
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-")
HEADS = ("quality", "toxic")
#: The level above is worth no more documents than this.
MOST_STRENGTH = 1e6


def shape(text: bytes, words: list[bytes]) -> list[float]:
    """What a text looks like, whatever its words: all zero for an empty one."""
    n, m = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split(b"\n") if x.strip()]
    most = Counter(words).most_common(1)[0][1] if words else 0
    longest = max(map(len, words), default=0)
    return [
        math.log1p(len(words)), len(set(words)) / n, (m - len(text.translate(None, UPPER))) / m,
        (m - len(text.translate(None, SYMBOLS))) / m, (m - len(text.translate(None, DIGITS))) / m,
        len(text) / n, most / n, sum(map(eq, words, words[1:])) / n,
        len(set(lines)) / max(1, len(lines)), math.log1p(longest), text.count(b"|") / n, text.count(b"\n") / n,
    ]


class DocumentModel:
    """Logistic regression for each head over binned shape and the presence of chosen words."""

    def __init__(self, edges: list[np.ndarray], words: dict[bytes, int], weights: np.ndarray, bias: np.ndarray, prior: np.ndarray):
        self.edges, self.words, self.weights, self.bias, self.prior = edges, words, weights, bias, prior
        self.known = frozenset(words)

    @staticmethod
    def look(text: bytes) -> tuple[list[float], set[bytes]]:
        return shape(text, text.split()), set(text.translate(C.ITEM_WORDS).split())

    @staticmethod
    def binned(edges: list[np.ndarray], shapes: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, shapes[:, k], side="right") + k * (BINS + 1) for k, e in enumerate(edges)], 1)

    @classmethod
    def fit(cls, texts: Iterable[bytes], labels: np.ndarray | list[np.ndarray]) -> DocumentModel:
        """labels: a column for each head, 0 or 1; or a list of such arrays that grows as the texts are read.  Word choice and weights come from these rows alone.

        A text is held no longer than it takes to number its words.
        """
        shapes, sets = [], []
        number: dict[bytes, int] = {}
        for x in texts:
            s, w = cls.look(x)
            shapes.append(s)
            sets.append(np.fromiter((number.setdefault(v, len(number)) for v in w), np.int32, len(w)))
        shapes = np.array(shapes, np.float64)
        names = list(number)
        labels = np.concatenate(labels) if isinstance(labels, list) else labels
        edges = [np.unique(np.quantile(shapes[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(shapes.shape[1])]
        chosen: dict[bytes, int] = {}
        n = len(shapes)
        count = lambda rows: np.bincount(np.concatenate([*rows, np.zeros(0, np.int32)]), minlength=len(names))
        every = count(sets)
        for h in range(labels.shape[1]):
            yes = count([s for s, y in zip(sets, labels[:, h]) if y])
            m = labels[:, h].sum()
            if 0 < m < n:
                p = m / n
                often = np.flatnonzero(every >= MIN_DOCS)
                c = every[often]
                z = np.abs(yes[often] - c * p) / np.sqrt(c * p * (1 - p) * (1 - c / (n + 1)))
                far = sorted((-float(v), names[k]) for v, k in zip(z, often.tolist()) if v >= LEAST_Z)
                for _, w in far[: WORDS // labels.shape[1]]:
                    chosen.setdefault(w, len(chosen))
        base = len(edges) * (BINS + 1)
        bins = cls.binned(edges, shapes)
        rows, cols = [np.repeat(np.arange(n), bins.shape[1])], [bins.ravel()]
        column = np.full(len(names) + 1, -1)
        for w, k in chosen.items():
            column[number[w]] = base + k
        for i, s in enumerate(sets):
            own = column[s]
            own = own[own >= 0]
            rows.append(np.full(len(own), i))
            cols.append(own)
        row, col = np.concatenate(rows), np.concatenate(cols)
        decay = np.r_[np.full(base, BIN_DECAY), np.full(len(chosen), WORD_DECAY)]
        weights, bias = np.zeros((labels.shape[1], base + len(chosen))), np.zeros(labels.shape[1])
        prior = np.clip(labels.mean(0), 1e-4, 1 - 1e-4)
        for h in range(labels.shape[1]):
            y, w, b = labels[:, h], weights[h], math.log(prior[h] / (1 - prior[h]))
            m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
            for t in range(1, STEPS + 1):
                p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[col], n), -30, 30)))
                g = np.r_[np.bincount(col, (p - y)[row], len(w)) / n + decay * w, (p - y).mean()]
                m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
                step = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
                w -= step[:-1]
                b -= step[-1]
            bias[h] = b
        return cls(edges, chosen, weights, bias, prior)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros((0, len(self.bias)))
        shapes, base = [], len(self.edges) * (BINS + 1)
        word = np.zeros((len(texts), len(self.bias)))
        for i, x in enumerate(texts):
            s, w = self.look(x)
            shapes.append(s)
            if own := [base + self.words[v] for v in w & self.known]:
                word[i] = self.weights[:, own].sum(1)
        return self.bias + word + self.weights[:, self.binned(self.edges, np.array(shapes))].sum(2).T


def chosen(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, quality, toxic) of at most ``rows`` labelled documents, chosen by a hash of their id.

    A document labelled more than once counts by the mean of its labels; rows without id or label are left out.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
        .dropna().groupBy("doc_id").agg(*[(F.avg(h) >= 0.5).cast("double").alias(h) for h in HEADS])
    )
    known = C.materialize(known, "quality-known")
    million, n = 1_000_000, max(1, known.count())
    # About the number wanted passes the threshold, so no task gets more than that.
    near = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < max(1, -(-million * rows // n)))
    return C.materialize(near.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "quality-labels")


def fit(docs: DataFrame, known: DataFrame) -> DocumentModel | None:
    """The document classifier, from the documents of ``chosen`` labels; None if there are none.

    Of rows that repeat an id one text counts, so the task that fits reads no more texts than there are labels.
    """

    def train(it):
        ys = [np.zeros((0, 2))]

        def stream():
            for b in C.batches(it):
                ys.append(np.stack([b.column(k).to_numpy() for k in (1, 2)], 1))
                yield from C.texts(b.column(0))

        first, rest = [], stream()
        for x in rest:
            first.append(x)
            break
        if first:
            yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(DocumentModel.fit(chain(first, rest), ys))]})

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sample = slim.join(F.broadcast(known), "doc_id").groupBy("doc_id", *HEADS).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = sample.select("text", *HEADS, "doc_id").repartition(1).sortWithinPartitions("doc_id")
    found = sample.mapInArrow(train, "model binary").collect()
    return pickle.loads(found[0][0]) if found else None


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, head: str, n: str, above: Column, above_n: Column) -> float:
    """How many documents the level above is worth to a group: from the variance of groups around the mean of the level
    above, ``above`` of ``above_n`` documents, beyond that of sampling."""
    own, size = F.col(head) / F.col(n), F.col(n).cast("double")
    noise = above * (1 - above)
    r = groups.agg(
        F.sum(size * (own - above) ** 2).alias("s"), F.sum(noise * (1 - size / above_n)).alias("e"),
        F.sum(size - size * size / above_n).alias("spread"), F.sum(size * noise).alias("v"), F.sum(size).alias("n"),
    ).first()
    if not r["n"] or not r["spread"] or r["spread"] <= 0:
        return MOST_STRENGTH
    between = (r["s"] - r["e"]) / r["spread"]
    return float(min(MOST_STRENGTH, max(1.0, r["v"] / r["n"] / between - 1))) if between > 0 else MOST_STRENGTH


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", rows: int = FIT_ROWS, least: float = 0.5, most_toxic: float = 0.5, carry: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, quality, toxic, host_quality, path_quality, kept.

    What is expected of documents is summed by host (``host``) and by path (``host``, ``path``): the document
    classifier's probabilities, or the labels themselves where they were among those chosen for the fit.  A host's
    posterior mean shrinks towards the global mean, a path's towards its host's, by strengths estimated from the
    spread of hosts around the global mean and of paths around their hosts': a site of few documents says little.  The
    document's log odds then move by how far its path's log odds are from the global ones.  kept: quality at least
    ``least`` and toxic under ``most_toxic``.  With ``carry`` the columns of docs come first, whatever their names, and
    of the others _quality, _toxic and _kept.
    Null text counts as empty; null hosts and paths are groups of their own; repeated rows are scored each; without
    usable labels everything has quality 1, toxic 0 and is kept; an empty table gives no rows; other columns are
    ignored.
    """
    spark = docs.sparkSession
    known = chosen(labels, rows)
    model = fit(docs, known)
    kept = (F.col("quality") >= least) & (F.col("toxic") < most_toxic)
    own, at, types = C.carried(docs, "text", carry)

    def told(df: DataFrame, *columns: str) -> DataFrame:
        if carry:
            return df.select(*C.restored(docs), F.col("quality").alias("_quality"), F.col("toxic").alias("_toxic"), kept.alias("_kept"))
        return df.select("doc_id", "quality", "toxic", *columns, kept.alias("kept"))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), *own)
    if model is None:
        one = F.lit(1.0)
        return told(slim.withColumns({"quality": one, "toxic": F.lit(0.0), "host_quality": one, "path_quality": one}), "host_quality", "path_quality")
    labelled = {r["doc_id"]: (r["quality"], r["toxic"]) for r in known.collect()}  # FIT_ROWS at most
    shared = spark.sparkContext.broadcast((pickle.dumps(model), labelled))  # some 2000 words and their weights

    def score(it):
        packed, labelled = shared.value
        model = pickle.loads(packed)
        for b in C.batches(it):
            z = model.logits(C.texts(b.column(3 + at)))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            told = np.array([labelled.get(d, q) for d, q in zip(b.column(0).to_pylist(), p)]).reshape(-1, 2)
            passed = [*b.columns[3:]] if carry else []
            yield pa.RecordBatch.from_arrays([*passed, b.column(0), b.column(1), b.column(2), *map(pa.array, (p[:, 0], p[:, 1], told[:, 0], told[:, 1]))], [*(f"__c{k}" for k in range(len(passed))), "doc_id", "host", "path", "quality", "toxic", "told_quality", "told_toxic"])

    schema = C.fields(types if carry else T.StructType(), "doc_id long, host string, path string, quality double, toxic double, told_quality double, told_toxic double")
    scored = C.materialize(slim.mapInArrow(score, schema), "quality-scores")
    by_path = C.materialize(scored.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(f"told_{h}").alias(h) for h in HEADS]), "quality-paths")
    total = by_path.agg(F.sum("n").alias("n"), *[F.sum(h).alias(h) for h in HEADS]).first()
    if not total["n"]:
        return told(scored.withColumns({"host_quality": F.col("quality"), "path_quality": F.col("quality")}), "host_quality", "path_quality")
    mean = {h: total[h] / total["n"] for h in HEADS}
    by_host = C.materialize(by_path.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.sum(h).alias(f"host_{h}") for h in HEADS]), "quality-hosts")
    joined = by_path.join(by_host.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    for h in HEADS:
        k = _strength(by_host, f"host_{h}", "host_n", F.lit(mean[h]), F.lit(float(total["n"])))
        joined = joined.withColumn(f"host_{h}", (F.col(f"host_{h}") + k * mean[h]) / (F.col("host_n") + k))
        k2 = _strength(joined, h, "n", F.col(f"host_{h}"), F.col("host_n"))
        joined = joined.withColumn(f"path_{h}", (F.col(h) + k2 * F.col(f"host_{h}")) / (F.col("n") + k2))
    sites = C.materialize(joined.select(_site("host", "path").alias("site"), "n", *[f"{x}_{h}" for x in ("host", "path") for h in HEADS]), "quality-sites")
    out = C.join_groups(scored.withColumn("site", _site("host", "path")), sites, ["site"], "n", 120)
    for h in HEADS:
        shift = _logit(F.col(f"path_{h}")) - _logit(F.lit(mean[h]))
        out = out.withColumn(h, 1 / (1 + F.exp(-(_logit(F.col(h)) + shift))))
    return told(out, "host_quality", "path_quality")


def _site(host: str, path: str) -> Column:
    """A host and a path as one key of fixed size; null is unlike any name."""
    return F.md5(F.to_json(F.struct(F.col(host).alias("h"), F.col(path).alias("p"))).cast("binary"))
