"""Toxicity of documents by a chain of linear classifiers.

Method: classifier chains.  Categories are predicted one after another; each linear model sees the
word features and the probabilities of the categories before it.  In training those probabilities are
out-of-fold predictions, so that a later model does not trust them more than it can at use.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _tokens as tk
from ._shared import cut, named, packed

#: ASCII bytes that are no letter or digit part words; bytes of other scripts do not.
BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


#: Byte lengths of word beginnings that count as features beside whole words (inflected forms).
STEMS = (6, 7)


def terms(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and word beginnings, and the text of each."""
    t = tk.word_tokens(raw, off, lower=True, breaks=BREAKS)
    sums = tk.prefix(tk.BYTE_HASH[t.raw])
    h, text = [t.hashes], [t.text]
    for n in STEMS:
        long = np.flatnonzero(t.end - t.start > n)
        h.append(tk.span(sums, t.start[long], t.start[long] + n) ^ tk.U(0x9E37 * n))
        text.append(t.text[long])
    return np.concatenate(h), np.concatenate(text)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 0.2, steps: int = 25) -> np.ndarray:
    """Penalised logistic regression by Newton steps; the last weight is the intercept."""
    a = np.c_[x, np.ones(len(x))]
    ridge = np.full(a.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = sigmoid(a @ w)
        move = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w += np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-8:
            break
    return w


@dataclass
class Chain:
    """Word features (sorted hashes) and one weight vector for each category, in order."""

    categories: list[str]
    features: np.ndarray
    weights: list[np.ndarray]
    thresholds: list[float]

    def counts(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """log(1 + occurrences) of each feature in each text."""
        out = np.zeros((len(off) - 1, len(self.features)))
        if len(self.features):
            h, text = terms(raw, off)
            at = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
            hit = self.features[at] == h
            np.add.at(out, (text[hit], at[hit]), 1.0)
        return np.log1p(out)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, one column for each category."""
        for w in self.weights:
            x = np.c_[x, sigmoid(x @ w[:-1] + w[-1])]
        return x[:, x.shape[1] - len(self.weights) :]


def fit_chain(x: np.ndarray, y: np.ndarray, categories: list[str], features: np.ndarray, fold: np.ndarray, used: dict[tuple[int, int], np.ndarray], penalty: float = 0.2) -> Chain:
    """Fit the chain on rows ``x`` and 0/1 columns ``y``.

    ``fold`` numbers the fold in which each row is left out; ``used`` gives the features that the rows of the
    other folds select for each (fold, category), and those that all rows select for (-1, category).
    """
    weights, thresholds, n = [], [], x.shape[1]

    def fit(rows: np.ndarray, k: int, j: int) -> np.ndarray:
        columns = np.r_[used[k, j], np.arange(n, x.shape[1])]
        w = np.zeros(x.shape[1] + 1)
        w[np.r_[columns, x.shape[1]]] = fit_linear(x[rows][:, columns], y[rows, j], penalty)
        return w

    for j in range(y.shape[1]):
        apart = np.zeros(len(x))
        for k in np.unique(fold):
            w = fit(fold != k, int(k), j)
            apart[fold == k] = sigmoid(x[fold == k] @ w[:-1] + w[-1])
        weights.append(fit(np.ones(len(x), bool), -1, j))
        thresholds.append(best_threshold(apart, y[:, j]))
        x = np.c_[x, apart]
    return Chain(categories, features, weights, thresholds)


def best_threshold(p: np.ndarray, y: np.ndarray, low: float = 0.2, high: float = 0.5) -> float:
    """The threshold of greatest F-score on out-of-fold predictions, the higher one of equals.

    Precision weighs twice as much as recall: a clean document lost costs more than a toxic one kept.
    """
    grid = np.linspace(high, low, 31)
    score = [1.25 * y[p >= c].sum() / max(1.0, (p >= c).sum() + 0.25 * y.sum()) for c in grid]
    return float(grid[int(np.argmax(score))])


def word_lists(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``words`` (a digest of the distinct word hashes), ``h`` (these hashes) and ``n`` (their counts)."""
    others = [c for c in docs.columns if c != "text"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.small(batches):
            raw, off = tk.utf8(batch.column("text"))
            for i in range(batch.num_rows):
                own, count = np.unique(terms(raw[off[i] : off[i + 1]], off[i : i + 2] - off[i])[0], return_counts=True)
                digest = int.from_bytes(blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)
                lists = [pa.array([own.view(np.int64)], pa.list_(pa.int64())), pa.array([count], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, 1) for c in others], pa.array([digest], pa.int64()), *lists], [*others, "words", "h", "n"])

    added = T.StructType().add("words", T.LongType()).add("h", T.ArrayType(T.LongType())).add("n", T.ArrayType(T.IntegerType()))
    return docs.select(*others, "text").mapInArrow(scan, T.StructType([*[docs.schema[c] for c in others], *added.fields]))


def sampled(docs: DataFrame, labels: DataFrame, categories: dict[str, object], most: int, folds: int) -> DataFrame:
    """At most ``most`` labelled texts as word lists, with ``fold`` and a 0/1 column for each category.

    A document's label is 1 where any of its rows in ``labels`` says so.  The sample takes the texts with the
    smallest hashes; equal word sets count once, with the larger label.
    """
    names = list(categories)
    marked = labels.select("doc_id", *[categories[c].cast("int").alias(c) for c in names]).dropna()
    marked = marked.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in names])
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    found = texts.select("doc_id", "mark").join(marked, "doc_id").distinct()
    chosen = cut(found.orderBy(F.xxhash64("doc_id", "mark"), "doc_id", "mark").limit(most), "sample")
    lists = cut(word_lists(texts.join(F.broadcast(chosen), ["doc_id", "mark"])).dropDuplicates(["doc_id", "mark"]), "words")
    first = F.min(F.struct("doc_id", "mark")).alias("first")
    once = lists.groupBy("words").agg(first, *[F.max(c).alias(c) for c in names])
    own = lists.select("words", F.struct("doc_id", "mark").alias("first"), "h", "n")
    return cut(own.join(once, ["words", "first"]).withColumn("fold", F.pmod("words", F.lit(folds)).cast("int")), "rows")


def chi_square(n: np.ndarray, p: np.ndarray, total: float, positive: float) -> np.ndarray:
    """Association of a word that ``n`` of ``total`` texts hold, ``p`` of them positive."""
    expected = n * positive / max(1.0, total)
    spread = expected * (1 - positive / max(1.0, total)) * (1 - n / max(1.0, total))
    return np.where(spread > 0, (p - expected) ** 2 / np.maximum(spread, 1e-9), 0)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, object], most: int = 4000, least_chi2: float = 40.0, most_features: int = 400, folds: int = 5) -> Chain:
    """Fit a chain on at most ``most`` labelled texts (`sampled`).

    ``categories`` names each category and a 0/1 column expression over ``labels``, in chain order.  The
    features of a category are the words of 5 texts or more whose presence is associated with it by a
    chi-square of ``least_chi2`` or more, the ``most_features`` strongest of them; they are selected anew
    without each fold, so the out-of-fold predictions that set the threshold have not seen the texts left
    out.  Words are counted by Spark; the driver holds the counts of words that may be features and, of the
    sampled texts, those words alone.  Rows with a null label or id are left out.  Without usable rows an
    empty chain predicts 0.
    """
    names = list(categories)
    rows = sampled(docs, labels, categories, most, folds)
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names]]
    total = np.zeros((folds, 1 + len(names)))
    for r in rows.groupBy("fold").agg(*sums).collect():
        total[r.fold] = [r.n, *[r[c] for c in names]]
    if not total.any():
        return Chain(names, np.zeros(0, np.uint64), [np.array([*[0.0] * j, -30.0]) for j in range(len(names))], [0.5] * len(names))
    each = rows.select("fold", *names, F.explode("h").alias("h"))
    parts = [F.sum(F.when(F.col("fold") == k, x).otherwise(0)).alias(f"{c}_{k}") for k in range(folds) for c, x in (("n", F.lit(1)), *[(c, F.col(c)) for c in names])]
    counted = each.groupBy("h").agg(F.count(F.lit(1)).alias("df"), *parts).filter("df >= 5")
    # a word weaker than a quarter of the bound over all folds does not reach it without one of them, but for rare luck that costs a feature
    strong = F.greatest(*[_chi(F.col("df"), sum((F.col(f"{c}_{k}") for k in range(folds)), F.lit(0)), *total[:, [0, 1 + j]].sum(axis=0)) for j, c in enumerate(names)], F.lit(0.0))
    kept = counted.withColumn("strong", strong).filter(F.col("strong") >= least_chi2 / 4).orderBy(F.desc("strong"), "h").limit(8 * most_features * len(names)).toPandas().sort_values("h")
    vocabulary = kept["h"].to_numpy(np.int64)
    table = np.stack([kept[[f"{c}_{k}" for c in ("n", *names)]].to_numpy(float) for k in range(folds)], 0) if len(kept) else np.zeros((folds, 0, 1 + len(names)))
    used = {}
    for k in range(-1, folds):
        others = np.arange(folds) != k
        n, t = table[others].sum(axis=0), total[others].sum(axis=0)
        for j in range(len(names)):
            chi2 = np.where(n[:, 0] >= 5, chi_square(n[:, 0], n[:, 1 + j], t[0], t[1 + j]), 0)
            best = np.argsort(-chi2, kind="stable")[:most_features]
            used[k, j] = np.sort(best[chi2[best] >= least_chi2])
    some = np.unique(np.concatenate([*used.values()])).astype(np.int64)
    vocabulary, used = vocabulary[some], {q: np.searchsorted(some, v) for q, v in used.items()}
    wanted = docs.sparkSession.createDataFrame([(int(h), i) for i, h in enumerate(vocabulary)], "h long, i int")
    pairs = rows.select("words", F.explode(F.arrays_zip("h", "n")).alias("x")).select("words", "x.h", "x.n").join(F.broadcast(wanted), "h")
    heads = rows.select("words", "fold", *names).orderBy("words").toArrow()
    where = {w: i for i, w in enumerate(heads.column("words").to_pylist())}
    x = np.zeros((len(where), len(vocabulary)))
    hits = pairs.select("words", "i", "n").toArrow()
    x[[where[w] for w in hits.column("words").to_pylist()], hits.column("i").to_numpy()] = np.log1p(hits.column("n").to_numpy())
    y = np.array([heads.column(c).to_numpy() for c in names], float).T
    # features are sorted as the unsigned numbers that texts are matched by
    order = np.argsort(vocabulary.view(np.uint64), kind="stable")
    rank = np.argsort(order)
    return fit_chain(x[:, order], y, names, vocabulary.view(np.uint64)[order], heads.column("fold").to_numpy(), {q: np.sort(rank[v]) for q, v in used.items()})


def _chi(n, p, total: float, positive: float):
    """`chi_square` as a Column."""
    share = float(positive) / max(1.0, float(total))
    spread = n * F.lit(share * (1 - share)) * (F.lit(1.0) - n / F.lit(max(1.0, float(total))))
    return F.when(spread > 0, (p - n * share) * (p - n * share) / F.greatest(spread, F.lit(1e-9))).otherwise(0.0)


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` with a probability column ``p_<category>`` for each category (replacing such columns).

    Needs ``text``, read whole.  A null or empty text has the probabilities of a text without any
    feature.  Rows may repeat; an empty table gives an empty result.
    """
    added = [f"p_{c}" for c in chain.categories]
    bare = packed(docs.drop(*added), "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.small(batches):
            raw, off = tk.utf8(batch.column("text"))
            p = np.concatenate([chain.predict(chain.counts(raw[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in tk.blocks(off)] or [np.zeros((0, len(added)))])
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *[pa.array(p[:, j]) for j in range(len(added))]], ["_row", *added])

    schema = T.StructType([bare.schema["_row"], *[T.StructField(c, T.DoubleType()) for c in added]])
    return bare.mapInArrow(scan, schema).select("_row.*", *added)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """``docs`` less the rows that the chain rejects; all columns and all other rows stay."""
    chain = train(docs, labels, categories())
    least = chain.thresholds[-1] if threshold is None else threshold
    return scored(docs, chain).filter(F.col("p_toxic") < least).select(*named(docs.columns))


def categories() -> dict[str, object]:
    """The categories that the ``labels`` table can teach, in chain order."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """The documents that the chain rejects: ``doc_id``, the probability of each category, ``toxic``.

    ``threshold`` defaults to that of the best out-of-fold F-score.  See `scored` and `train` for the cases.
    """
    chain = train(docs, labels, categories())
    least = chain.thresholds[-1] if threshold is None else threshold
    found = scored(docs.select("doc_id", "text"), chain).filter(F.col("p_toxic") >= least)
    return found.select("doc_id", F.round("p_low_quality", 6).alias("p_low_quality"), F.round("p_toxic", 6).alias("p_toxic"), F.lit(True).alias("toxic"))
