"""Language identification by rank-order profiles.

A profile is the list of the ``most`` most frequent n-grams (1 to 4 characters of lower-case words, with a blank at
either end of a word), by falling frequency. A document gets a profile of the same kind from its whole text, and the
language whose profile has the smallest out-of-place distance: over the document's n-grams, the sum of the
differences of rank, with ``most`` where the language lacks the n-gram.

The profiles are fitted on a bounded sample: about ``rows_per_lang`` documents of each language, chosen by a hash of
the id. What is broadcast is ``most`` n-grams a language.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every text where nothing
could be learned; equal distances go to the language first in code points; equal frequencies rank by the n-gram's
hash; repeated rows are judged each for itself; an empty table gives an empty result. The score is 1 minus the
distance over the largest possible one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.llm.textcols import fold, uniform
from terrafold.llm.words import _BASE, mixed

ROWS_PER_LANG = 1500
MOST = 400
LONGEST = 4


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter or a combining mark of a word."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> np.ndarray:
    """Hashes of all n-grams of a text; empty if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _letters()[points]
    if not inside.any():
        return np.empty(0, np.uint64)
    # One blank stands for each run of other characters, and for both ends.
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    codes = np.concatenate([[0], np.where(inside, points, 0)[keep], [0]]).astype(np.uint64)
    blank = codes == 0
    found, rolled = [mixed(codes[~blank] + np.uint64(1 << 32))], codes
    for n in range(2, LONGEST + 1):
        rolled = rolled[:-1] * np.uint64(_BASE) + codes[n - 1 :]
        fine = np.ones(len(rolled), bool)
        for k in range(1, n - 1):
            fine &= ~blank[k : len(blank) - n + 1 + k]  # blanks stand at the ends only
        if n == 2:
            fine &= ~(blank[:-1] & blank[1:])
        found.append(mixed(rolled[fine] + np.uint64(n << 40)))
    return np.concatenate(found)


def profile(grams: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, by falling frequency and then hash."""
    keys, counts = np.unique(grams, return_counts=True)
    if len(keys) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        some = counts >= least
        keys, counts = keys[some], counts[some]
    return keys[np.argsort(-counts, kind="stable")][:most]


class Profiles:
    """Ranks of all languages' n-grams, as one table."""

    def __init__(self, langs: list[str], ranked: dict[str, np.ndarray], most: int):
        self.langs, self.most = langs, most
        self.keys = np.unique(np.concatenate([*ranked.values(), np.empty(0, np.uint64)]))
        self.ranks = np.full((len(self.keys), len(langs)), -1, np.int32)
        for k, lang in enumerate(langs):
            self.ranks[np.searchsorted(self.keys, ranked[lang]), k] = np.arange(len(ranked[lang]))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's profile to each language's."""
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        known = self.keys[at] == own
        ranks = self.ranks[at[known]]
        apart = np.where(ranks < 0, self.most, np.abs(ranks - np.flatnonzero(known)[:, None]))
        return apart.sum(0) + self.most * np.count_nonzero(~known)

    def best(self, text: str | None) -> tuple[str, float]:
        own = profile(ngrams(text), self.most) if text and self.langs else ()
        if not len(own):
            return "und", 0.0
        apart = self.distances(own)
        k = int(apart.argmin())
        return self.langs[k], float(1 - apart[k] / (self.most * len(own)))


def fit(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, most: int = MOST, seed: str = "lang-1") -> Profiles:
    """Profiles from doc_id, text and lang; held-out rows are not in ``docs``."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Profiles([], {}, most)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, rows_per_lang / n))])[F.col("lang")]
    sample = known.where(uniform("doc_id", seed=seed) < share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                keys, counts = np.unique(ngrams(text), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "gram": keys.view(np.int64), "n": counts.astype(np.int64)})

    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("lang", "gram", "rank").collect()
    langs = sorted({r.lang for r in top})
    ranked = {lang: np.array([r.gram for r in sorted((r for r in top if r.lang == lang), key=lambda r: r.rank)], np.int64).view(np.uint64) for lang in langs}
    return Profiles(langs, ranked, most)


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` as last columns, in place of columns of these names if there are any."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*[docs[f"`{c}`"] for c in kept], docs[f"`{text_col}`"].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.best(t.as_py()) for t in batch.columns[-1]]
            more = [pa.array([x[k] for x in found], t) for k, t in ((0, pa.string()), (1, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*kept, "lang_pred", "score"])

    return rows.mapInArrow(run, type(docs.schema)([docs.schema[c] for c in kept]).add("lang_pred", "string").add("score", "double"))


def op2_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4, 2)
    profiles = fit(docs.where(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")
