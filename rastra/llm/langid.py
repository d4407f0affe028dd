"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed character 1- to 3-grams, scaled to length one. Every language
has a few centroids, found by clustering a bounded sample of its labelled documents; a text gets
the language of the centroid with the largest cosine, and is rejected if even that one is too far:
farther than nearly all starts of that length of the language's own training texts, each of which is left out of its centroid.

What is learned: document frequencies come from every labelled training row, but copies of a text that has a thousandth of the rows or more
count once (one pass, summed by Spark); the centroids from at most ``sample_per_lang`` different texts of each language, in one task for each
language. The driver gets the frequencies and the centroids: both have the size of the model
(features times languages times clusters), whatever the size of the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rastra.llm.common import stored

#: Hash buckets of n-grams, as a power of two.
FEATURE_BITS = 13
#: Different labelled texts a language that the clustering sees at most.
SAMPLE_PER_LANG = 600
CLUSTERS = 3
#: The least cosine whatever the training rows say, for languages of a few rows or of wild ones.
MIN_COSINE = 0.08
#: A text is in none of the learned languages if its best cosine is below MARGIN times this quantile of training texts of its length.
QUANTILE, MARGIN = 0.01, 0.85
#: Lengths are compared by powers of two, from 2 ** LENGTHS[0] characters on.
LENGTHS = range(3, 15)
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter of any script."""
    return bool(text) and any(map(str.isalpha, text))


def _code_points(text: str) -> np.ndarray:
    """Lower-cased letters as numbers, runs of anything else as one space, a space at either end."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_letter = (c - np.uint32(97)) < 26
    other = (c >= 0xC0) & ~((c >= 0x2000) & (c < 0x2C00)) & ~((c >= 0x3000) & (c < 0x3040)) & (c < 0x1F000) & (c != 0xD7) & (c != 0xF7)
    c = np.where(ascii_letter | other, c, np.uint32(32))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    return c[keep]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of a whole text and how often each occurs."""
    c, shift = _code_points(text), np.uint32(32 - FEATURE_BITS)
    one = c * np.uint32(0x9E3779B1)
    grams = [one ^ (one >> np.uint32(15))]
    if len(c) > 1:
        two = (one[:-1] ^ np.uint32(0x7F4A7C15)) * np.uint32(0x85EBCA6B) + c[1:] * np.uint32(0xC2B2AE35)
        grams.append(two ^ (two >> np.uint32(13)))
    if len(c) > 2:
        three = (two[:-1] ^ (two[:-1] >> np.uint32(16))) * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1)
        grams.append(three)
    counts = np.bincount((np.concatenate(grams) * np.uint32(0x9E3779B1)) >> shift, minlength=1 << FEATURE_BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text's TF-IDF vector of length one: places and values."""
    at, n = features(text)
    v = (1 + np.log(n)) * idf[at]
    return at, (v / np.sqrt((v * v).sum())).astype(np.float32)


def length_class(text: str) -> int:
    """The place in LENGTHS of a text, by its characters without what features() leaves out."""
    return min(max(len(_code_points(text)).bit_length() - 1, LENGTHS[0]), LENGTHS[-1]) - LENGTHS[0]


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    langs: list[str]
    #: One row for each centroid, of length one; langs has its language.
    centroids: np.ndarray
    min_cosine: float = MIN_COSINE
    #: One row for each centroid, one column for each of LENGTHS: below it a text is rejected.
    floors: np.ndarray | None = None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The nearest language, the cosine to it, and whether that is too far."""
        if not len(self.centroids) or not has_letter(text):
            return UNKNOWN, 0.0, True
        at, v = vector(text, self.idf)
        cosines = self.centroids[:, at] @ v
        best = int(cosines.argmax())
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.langs[best], score, bool(score < max(self.min_cosine, 0.0 if self.floors is None else self.floors[best, length_class(text)]))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each feature and task, and one for each language and task, which counts its texts as feature -1."""
    total, langs = np.zeros(1 << FEATURE_BITS, np.int64), Counter()
    for batch in batches:
        langs.update(batch.column(1).to_pylist())
        for text in batch.column(0):
            total[features(text.as_py())[0]] += 1
    at = np.flatnonzero(total)
    numbers = [pa.array(np.append(at, np.full(len(langs), -1))), pa.array(np.append(total[at], np.array(list(langs.values()), np.int64)).astype(np.int64))]
    yield pa.RecordBatch.from_arrays([numbers[0], pa.array([None] * len(at) + list(langs), pa.string()), numbers[1]], names=["feature", "lang", "n"])


def clustered(vectors: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means: at most k unit centroids; the seeds are the mean and then the row farthest from all seeds."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    seeds = [unit(vectors.mean(axis=0))]
    while len(seeds) < min(k, len(vectors)):
        seeds.append(vectors[(vectors @ np.array(seeds).T).max(axis=1).argmin()])
    centroids = np.array(seeds)
    for _ in range(rounds):
        nearest = (vectors @ centroids.T).argmax(axis=1)
        moved = np.array([unit(vectors[nearest == i].mean(axis=0)) if (nearest == i).any() else centroids[i] for i in range(len(centroids))])
        if np.allclose(moved, centroids):
            break
        centroids = moved
    return centroids


def floors(texts: list[str], dense: np.ndarray, centroids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """For each of LENGTHS, MARGIN times the low quantile of the cosines that the starts of the training texts have to the nearest centroid.

    A text is taken out of its own centroid first. Lengths that no text reaches have the value of the next shorter one.
    """
    nearest = (dense @ centroids.T).argmax(axis=1)
    sums = np.array([dense[nearest == i].sum(axis=0) for i in range(len(centroids))])
    found: list[list[float]] = [[] for _ in LENGTHS]
    for text, own, at_centroid in zip(texts, dense, nearest.tolist(), strict=True):
        others = centroids.copy()
        rest = sums[at_centroid] - own
        norm = np.linalg.norm(rest)
        others[at_centroid] = rest / norm if norm > 1e-3 else 0  # its only text
        for k in range(length_class(text) + 1):
            part = text if k == length_class(text) else text[: 2 ** LENGTHS[k]]
            if has_letter(part):
                at, v = vector(part, idf)
                found[k].append(float((others[:, at] @ v).max()))
    out, last = [], 0.0
    for cosines in found:
        last = MARGIN * float(np.quantile(cosines, QUANTILE)) if cosines else last
        out.append(last)
    return np.array(out)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", clusters: int = CLUSTERS, sample_per_lang: int = SAMPLE_PER_LANG, min_cosine: float = MIN_COSINE) -> Model:
    """Learn from the text and language of labelled rows, whatever their ids; those without a language or a letter are left out.

    For the centroids repeated rows are one text; in the frequencies they are if they are many (a thousandth of all rows). With no rows at all the model knows no language and calls every text unknown.
    """
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(text_col).cast("string")).alias("order")).where("lang is not null and text is not null")
    known = stored(rows.groupBy("lang", "order").agg(F.count("*").alias("n")), "texts")
    # Texts with a thousandth of all rows or more are at most a thousand: of their copies one counts, and no other text is moved for that.
    limit = max(1, (known.agg(F.sum("n")).first()[0] or 0) // 1000)
    hot = F.broadcast(known.where(F.col("n") > limit).select("lang", "order"))
    one = rows.join(hot, ["lang", "order"], "left_semi").groupBy("lang", "order").agg(F.first("text").alias("text"))
    different = rows.join(hot, ["lang", "order"], "left_anti").select("text", "lang").union(one.select("text", "lang"))
    counts = different.mapInArrow(_document_frequencies, "feature long, lang string, n long").groupBy("feature", "lang").agg(F.sum("n").alias("n")).collect()
    sizes = {r["lang"]: r["n"] for r in counts if r["feature"] < 0}
    n = sum(sizes.values())
    idf = np.ones(1 << FEATURE_BITS) + np.log(1 + n)
    for r in counts:
        if r["feature"] >= 0:
            idf[r["feature"]] = 1 + np.log((1 + n) / (1 + r["n"]))
    by_hash = Window.partitionBy("lang").orderBy("rank", "order")
    chosen = known.select("lang", "order", F.xxhash64("order").alias("rank")).withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= sample_per_lang)
    # As many keys as the sample has texts, which the model is larger than.
    sample = rows.join(F.broadcast(chosen), ["lang", "order"]).groupBy("lang", "order").agg(F.first("text").alias("text"), F.first("rank").alias("rank"))

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["text"].map(has_letter)].sort_values(["rank", "order"])
        dense = np.zeros((len(group), 1 << FEATURE_BITS), np.float32)
        for row, text in enumerate(group["text"]):
            at, v = vector(text, idf)
            dense[row, at] = v
        found = clustered(dense, clusters) if len(group) else dense
        if not len(found):
            return pd.DataFrame({"lang": [], "centroid": [], "floors": []})
        least = floors(list(group["text"]), dense, found, idf)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]] * len(found), "centroid": list(found), "floors": [least] * len(found)})

    found = sorted(sample.groupBy("lang").applyInPandas(centroids, "lang string, centroid array<float>, floors array<double>").collect(), key=lambda r: (r["lang"], r["centroid"]))
    return Model(idf, [r["lang"] for r in found], np.array([r["centroid"] for r in found], np.float32).reshape(len(found), 1 << FEATURE_BITS), min_cosine, np.array([r["floors"] for r in found]).reshape(len(found), len(LENGTHS)))


def language(model: Model, text: Column) -> Column:
    """struct(lang, score, rejected) for a text column.

    Null, empty and letterless texts are ``und``, score 0, rejected. Texts in no learned language keep
    the nearest one as lang but are rejected. Texts are read whole.
    """

    @arrow_udf("struct<lang string, score double, rejected boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        found = [model.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], names=["lang", "score", "rejected"])

    # Else a filter on the result would run it a second time.
    return predict.asNondeterministic()(text.cast("string"))
