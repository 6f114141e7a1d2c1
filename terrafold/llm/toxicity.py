"""Toxicity from two class-conditional Kneser-Ney word models.

The toxic and the ordinary model are interpolated bigram models. Both back off to class unigrams made of
continuation counts, and those to one shared distribution of continuation counts over both classes. Counts are of
distinct words before an expression, so copies of a text add nothing. A class keeps the count of an expression only
where it stands out against the other class; all else, rare expressions above all, is discounted wholly into the
shared backoff counts and weighs nothing. A text's evidence is the difference of its two
log-likelihoods, normalised by length; a logistic curve, fitted on labelled rows that the counts have not seen,
turns it into a score. The curve is shifted so that 0.5 is the cut that is worth most on those rows (``steady_point``).

The classifier is fitted on a bounded sample of labelled rows: about ``rows_per_class`` rows of each class, chosen
by a hash of the id (``SHARE`` of them for the counts). The models are broadcast; their size follows that bound,
not the table.

Defined results: null and empty texts have no evidence and get the score of the curve at zero evidence; without
labelled rows of both classes every score is 0; ids with several labels are toxic if one of them says so; null
labels count as no label; repeated rows are scored each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.shared import stored
from terrafold.llm.textcols import fold, text_of, uniform
from terrafold.llm.words import PUNCTUATION, _BASE, mixed, parts, words

ROWS_PER_CLASS = 4000
SHARE = 0.7
DISCOUNT = 0.75
STANDS_OUT = 3.0
TIMES = 3.0
#: How many times the share of toxic texts that are missed the share of ordinary texts that are taken for toxic weighs.
FALSE_ALARM = 25.0


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * np.uint64(_BASE) + right)


@dataclass
class Model:
    """Sorted keys with, for both classes, probabilities: unigrams, weights of contexts, discounted bigrams."""

    words: np.ndarray
    unigram: np.ndarray  # (n + 1, 2); the last row is for unknown words
    backoff: np.ndarray  # (n + 1, 2); likewise
    pairs: np.ndarray
    bigram: np.ndarray  # (m + 1, 2); the last row is zero
    curve: np.ndarray

    def evidence(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log-likelihood under the toxic model minus that under the ordinary one, a text."""
        if not len(hashes):
            return np.zeros(len(bounds) - 1)
        at = _find(self.words, hashes)
        p = self.unigram[at]
        follows = np.ones(len(hashes), bool)
        follows[bounds[:-1][np.diff(bounds) > 0]] = False
        i = np.flatnonzero(follows)
        p[i] = self.bigram[_find(self.pairs, pair_keys(hashes[i - 1], hashes[i]))] + self.backoff[at[i - 1]] * p[i]
        sums = np.concatenate([[0.0], np.cumsum(np.log(p[:, 1]) - np.log(p[:, 0]))])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def scores(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(bounds) - 1)
        return 1 / (1 + np.exp(-np.clip(features(self.evidence(hashes, bounds), np.diff(bounds)) @ self.curve, -500, 500)))


def features(evidence: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Evidence a word, evidence by the root of the length (its own noise grows so), and 1."""
    n = np.maximum(n, 1)
    return np.stack([evidence / n, evidence / np.sqrt(n), np.ones(len(n))], 1)


def _find(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Positions in sorted keys; the number of keys where there is none."""
    if not len(keys):
        return np.zeros(len(of), np.int64)
    at = np.searchsorted(keys, of)
    at[at == len(keys)] = 0
    return np.where(keys[at] == of, at, len(keys))


def outstanding(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """What a class keeps of each continuation count; the rest goes to the shared backoff.

    A count is kept, less the discount, where it stands out: ``STANDS_OUT`` deviations over what both classes
    together lead one to expect, and at ``TIMES`` the other class's rate.
    """
    expected = counts.sum(1, keepdims=True) * totals / totals.sum()
    other = (counts[:, ::-1] + 0.5) / totals[::-1]
    keep = (counts - expected > STANDS_OUT * np.sqrt(expected)) & (counts / totals >= TIMES * other)
    return np.where(keep, counts - DISCOUNT, 0.0)


def may_stand_out(totals: np.ndarray) -> Column:
    """Whether ``outstanding`` can keep the counts a and b of a bigram for either class, by its deviations alone."""
    share = totals / max(totals.sum(), 1)
    uses = F.col("a") + F.col("b")
    return F.greatest(*[F.col(c) - uses * float(p) - STANDS_OUT * F.sqrt(uses * float(p)) for c, p in zip("ab", share)]) > -1e-6


def kneser_ney(words_: np.ndarray, contexts: np.ndarray, often: np.ndarray, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> Model:
    """The model from continuation counts; columns are the ordinary and the toxic class.

    ``contexts``: distinct words before each word; ``often``: summed counts of the bigrams that each word opens;
    ``counts``: distinct words before each bigram (left, right), of those bigrams that can stand out.
    """
    order = np.argsort(words_)
    vocabulary, contexts, often = words_[order], contexts[order], often[order]
    totals = np.maximum(contexts.sum(0), 1)
    kept = outstanding(contexts, totals)
    shared = np.append((contexts - kept).sum(1), 0) + 0.5
    shared /= shared.sum()
    unigram = np.vstack([kept / totals, [[0, 0]]]) + shared[:, None] * (1 - kept.sum(0) / totals)
    kept = outstanding(counts, np.maximum(often.sum(0), 1))
    v = np.searchsorted(vocabulary, left)
    bigram = kept / np.maximum(often, 1)[v]
    backoff = 1 - np.stack([np.bincount(v, bigram[:, c], len(vocabulary)) for c in (0, 1)], 1)
    some = np.flatnonzero(kept.any(1))
    pairs = pair_keys(left[some], right[some])
    order = np.argsort(pairs)
    return Model(vocabulary, unigram, np.vstack([backoff, [[1, 1]]]), pairs[order], np.vstack([bigram[some][order], [[0, 0]]]), np.array([0.0, 0.0, -1e3]))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weighted, lightly ridged logistic regression by Newton steps that are halved until they help."""
    scale = np.maximum(np.abs(x).mean(0), 1e-9)
    z = x / scale

    def loss(b: np.ndarray) -> float:
        return float(weight @ np.logaddexp(0, np.where(y == 1, -1, 1) * (z @ b)) + ridge * b @ b / 2)

    b, now = np.zeros(x.shape[1]), np.inf
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        grad = z.T @ (weight * (p - y)) + ridge * b
        step, now = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(b)), grad), loss(b)
        while loss(b - step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        b = b - step
        if np.abs(step).max() < 1e-7:
            break
    return b / scale


def steady_point(margins: np.ndarray, y: np.ndarray, times: int = 50) -> float:
    """The mean working point of resampled rows: a few rows more or less near the cut move it little."""
    rng, rows = np.random.Generator(np.random.PCG64(1)), [np.flatnonzero(y == c) for c in (0, 1)]
    chosen = [np.concatenate([rng.choice(r, len(r)) for r in rows]) for _ in range(times)]
    return float(np.mean([working_point(margins[i], y[i]) for i in chosen]))


def working_point(margins: np.ndarray, y: np.ndarray) -> float:
    """The cut with the largest recall less ``FALSE_ALARM`` times the rate of false alarms: 0 if it is among the best, else the middle of
    the best gap between margins that lies nearest to 0."""
    m = np.unique(margins)
    low, high = np.r_[m[0] - 2, m], np.r_[m, m[-1] + 2]  # cuts lie above low and up to high
    hits, alarms = np.sort(margins[y == 1]), np.sort(margins[y == 0])
    worth = 1 - np.searchsorted(hits, high) / len(hits) - FALSE_ALARM * (1 - np.searchsorted(alarms, high) / len(alarms))
    best = np.flatnonzero(worth >= worth.max() - 1e-12)
    if any(low[i] < 0 <= high[i] for i in best):
        return 0.0
    middle = (low[best] + high[best]) / 2
    return float(middle[np.abs(middle).argmin()])


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, seed: str = "toxic-1") -> Model:
    """``docs`` has doc_id and text, ``labels`` has doc_id and toxic; held-out rows are not in them."""
    spark = docs.sparkSession
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    hashes_, pairs_ = np.empty(0, np.uint64), np.empty((0, 2))
    nothing = kneser_ney(hashes_, pairs_, pairs_, hashes_, hashes_, pairs_)
    if not sizes.get(0) or not sizes.get(1):
        return nothing
    share = F.when(F.col("toxic") == 1, F.lit(rows_per_class / sizes[1])).otherwise(F.lit(rows_per_class / sizes[0]))
    sample = marks.where(uniform("doc_id", seed=seed) < share).withColumn("counts", uniform("doc_id", seed=seed + "b") < SHARE)
    # At most about 2 * rows_per_class ids: a bound that doesn't grow with the tables.
    rows = docs.select(F.col("doc_id"), text_of("text").alias("text")).join(F.broadcast(sample), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for first, data, bounds in parts(batch.column("text")):
                hashes, at = words(data, bounds, PUNCTUATION)
                inner = np.ones(len(hashes), bool)
                inner[at[:-1][np.diff(at) > 0]] = False
                i = np.flatnonzero(inner)
                label = np.repeat(toxic[first : first + len(at) - 1], np.diff(at))[i]
                before = np.where(inner[i - 1], hashes[i - 2], np.uint64(0))  # 0 at the start of a text
                yield pa.RecordBatch.from_pydict({"u": before.view(np.int64), "l": hashes[i - 1].view(np.int64), "r": hashes[i].view(np.int64), "toxic": label.astype(np.int32)})

    triples = rows.where("counts").select("text", "toxic").mapInArrow(count, "u long, l long, r long, toxic int")
    by_class = [F.count_if(F.col("toxic") == c).alias(name) for c, name in ((0, "a"), (1, "b"))]
    pairs = stored(triples.distinct().groupBy("l", "r").agg(*by_class), "toxic-pairs")
    left = pairs.select(F.col("l").alias("w"), F.lit(0).alias("ca"), F.lit(0).alias("cb"), F.col("a").alias("oa"), F.col("b").alias("ob"))
    right = pairs.select(F.col("r").alias("w"), (F.col("a") > 0).cast("int").alias("ca"), (F.col("b") > 0).cast("int").alias("cb"), F.lit(0), F.lit(0))
    table = left.union(right).groupBy("w").agg(*[F.sum(c).alias(c) for c in ("ca", "cb", "oa", "ob")]).toArrow()
    column = lambda t, c: t.column(c).to_numpy()
    both = lambda t, *names: np.stack([column(t, c) for c in names], 1).astype(float)
    large = pairs.where(may_stand_out(both(table, "oa", "ob").sum(0))).toArrow()
    model = kneser_ney(column(table, "w").view(np.uint64), both(table, "ca", "cb"), both(table, "oa", "ob"),
                       column(large, "l").view(np.uint64), column(large, "r").view(np.uint64), both(large, "a", "b"))

    sent = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, bounds in parts(batch.column("text")):
                hashes, at = words(data, bounds, PUNCTUATION)
                yield pa.RecordBatch.from_pydict({"evidence": sent.value.evidence(hashes, at), "n": np.diff(at), "toxic": batch.column("toxic").slice(first, len(at) - 1)})

    seen = rows.where("not counts").select("text", "toxic").mapInArrow(weigh, "evidence double, n long, toxic int").toArrow()
    e, n, y = (seen.column(c).to_numpy() for c in ("evidence", "n", "toxic"))
    if not len(y) or y.min() == y.max():
        return nothing
    weight = np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum()) * len(y) / sum(sizes.values())
    model.curve = logistic(features(e, n), y, weight)
    model.curve[2] -= steady_point(features(e, n) @ model.curve, y)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the score as the last column, in place of a column of that name if there is one."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != to]
    rows = docs.select(*[docs[f"`{c}`"] for c in kept], docs[f"`{text_col}`"].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty(0)]
            for _, data, bounds in parts(batch.columns[-1]):
                found.append(sent.value.scores(*words(data, bounds, PUNCTUATION)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(found))], names=[*kept, to])

    schema = type(docs.schema)([docs.schema[c] for c in kept]).add(to, "double")
    return rows.mapInArrow(run, schema)


def fit_tables(spark, docs: DataFrame, sf_dir: str) -> Model:
    """The model of the tables' labels, without held-out rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return fit(docs.select("doc_id", "text"), labels.where(~fold(F.col("doc_id"), 5, 0)))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs.withColumn("held_out", fold(F.col("doc_id"), 5, 0)), fit_tables(spark, docs, sf_dir))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
