"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

Features are the distinct hashed 3- to 5-grams of the whole lower-cased text, at unit length.  Each is
scaled by the logarithm of its smoothed share among toxic rows over that among the others; a
logistic regression with an L2 penalty is fitted on top.  The scale and the weights fold into one
number per feature, so a text is scored by adding up numbers.  Fits that each leave out one of FOLDS parts of the rows tell where to cut: on the rows that
they left out, the share of toxic rows found above that of clean rows is the largest, and MOST_CLEAN of the clean rows at most are hit.

Learning uses a bounded sample of labelled rows, drawn by a hash of doc_id: at most `learn_toxic`
toxic and `learn_clean` clean ones.  Scoring covers all of every text.

Null and empty texts have no feature and get the score of the bias alone.  Without labelled rows of both kinds
all texts get the smoothed share of toxic rows, a quarter if there are none.  Rows with null labels teach nothing; a doc_id labelled more than
once counts as toxic if one label says so; of texts with the same doc_id the one with the least hash is learned from.  Null doc_ids are scored, and count as held out.  Repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _base

BITS = 18
SIZES = (3, 4, 5)
LEARN_TOXIC, LEARN_CLEAN = 1200, 2800
PENALTY, ROUNDS = 1e-4, 100
#: Share of clean rows that may count as toxic where the cut is set, and parts of the rows.
MOST_CLEAN, FOLDS = 0.01, 4
CHARS = 1 << 20
#: Features of rows that a pass works on at a time.
BLOCK = 1 << 20


def features(text: str | None):
    """Sorted distinct features of a text."""
    import numpy as np

    seen = np.zeros(1 << BITS, dtype=bool)
    if text:
        text = f" {text.lower()} "
        for a in range(0, len(text), CHARS):
            c = np.frombuffer(text[a : a + CHARS + max(SIZES) - 1].encode("utf-32-le"), "<u4").astype(np.uint64)
            h = np.zeros(len(c), dtype=np.uint64)
            for n in range(1, max(SIZES) + 1):
                if len(c) < n:
                    break
                h = h[: len(c) - n + 1] * np.uint64(1_000_003) + c[n - 1 :]
                if n in SIZES:
                    seen[(h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)] = True
    return np.flatnonzero(seen)


class Classifier:
    def __init__(self, weights, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, rows: Iterable[tuple], penalty: float = PENALTY, rounds: int = ROUNDS) -> "Classifier":
        """rows: (features, 0 or 1); each is let go once it is read."""
        import numpy as np

        labels, sizes, blocks, held, first = [], [], [], [], 0  # blocks: (features, rows) of whole rows, some BLOCK features
        count, weights = np.ones((2, 1 << BITS)), np.zeros(1 << BITS)
        for f, label in rows:
            held.append(np.array(f, dtype=np.int32))
            labels.append(label)
            sizes.append(len(f))
            count[0 if label else 1, held[-1]] += 1
            if sum(sizes[first:]) > BLOCK:
                blocks.append((np.concatenate(held), slice(first, len(sizes))))
                held, first = [], len(sizes)
        if held:
            blocks.append((np.concatenate(held), slice(first, len(sizes))))
        y, sizes = np.array(labels, dtype=np.float64), np.array(sizes, dtype=np.int64)
        if not 0 < y.sum() < len(y):
            p = (y.sum() + 0.5) / (len(y) + 2)
            return cls(weights, float(np.log(p / (1 - p))))
        ratio = np.log(count[0] / count[0].sum()) - np.log(count[1] / count[1].sum())
        unit = 1 / np.sqrt(np.maximum(sizes, 1))
        share = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))  # both kinds weigh the same
        bias = m_bias = v_bias = 0.0
        m, v = np.zeros_like(weights), np.zeros_like(weights)
        for step in range(1, rounds + 1):  # Adam on all rows
            scaled, grad, total = weights * ratio, np.zeros_like(weights), 0.0
            for at, some in blocks:
                sums = np.concatenate([[0.0], np.cumsum(scaled.take(at))])[np.concatenate([[0], np.cumsum(sizes[some])])]
                z = np.diff(sums) * unit[some] + bias
                miss = (1 / (1 + np.exp(-z)) - y[some]) * share[some]
                grad += np.bincount(at, weights=np.repeat(miss * unit[some], sizes[some]), minlength=1 << BITS)
                total += miss.sum()
            grad = grad * ratio / len(y) + penalty * weights
            total /= len(y)
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            m_bias, v_bias = 0.9 * m_bias + 0.1 * total, 0.99 * v_bias + 0.01 * total**2
            a, b = 1 - 0.9**step, 1 - 0.99**step
            weights = weights - 0.05 * (m / a) / (np.sqrt(v / b) + 1e-8)
            bias -= 0.05 * (m_bias / a) / (np.sqrt(v_bias / b) + 1e-8)
        return cls(weights * ratio, float(bias))

    def margin(self, f) -> float:
        return float(self.weights[f].sum()) / max(len(f), 1) ** 0.5 + self.bias

    def score(self, text: str | None) -> float:
        import math

        return 1 / (1 + math.exp(-max(min(self.margin(features(text)), 500.0), -500.0)))


def cut(margins, toxic, most_clean: float = MOST_CLEAN) -> float:
    """The margin from which rows count as toxic; 0 where nothing tells."""
    import numpy as np

    margins, toxic = np.asarray(margins, dtype=np.float64), np.asarray(toxic, dtype=bool)
    if toxic.all() or not toxic.any():
        return 0.0
    cuts = np.unique(margins)
    cuts = np.append((cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1)
    hits, wrong = (1 - np.searchsorted(np.sort(margins[k]), cuts) / k.sum() for k in (toxic, ~toxic))
    sound = np.flatnonzero(wrong <= most_clean)
    return float(cuts[sound[np.argmax((hits - wrong)[sound])]])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, learn_toxic: int = LEARN_TOXIC, learn_clean: int = LEARN_CLEAN) -> Classifier:
    """docs: doc_id, text; labels: doc_id, toxic.  Rows whose crc32(doc_id) is a multiple of 5 are left out."""
    import numpy as np

    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [known.where(is_toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for is_toxic, most in ((F.col("toxic") > 0, learn_toxic), (F.col("toxic") <= 0, learn_clean))]
    sample = drawn[0].union(drawn[1])  # learn_toxic + learn_clean rows at most

    @F.pandas_udf("binary")
    def found(text: pd.Series) -> pd.Series:
        return text.map(lambda t: features(t).astype("<i4").tobytes())

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max(F.col("toxic") > 0).alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # one text of each doc_id
    rows = rows.select("doc_id", "toxic", found("text").alias("f"))

    rows = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")).withColumn("without", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))

    def fit(batches):
        """For each `without`, a fit without the rows of that fold, of which it gives the margins; no row has fold FOLDS."""
        drawn: dict[int, list] = {}
        for batch in batches:
            for row in zip(batch["doc_id"], batch["toxic"], batch["fold"], batch["f"], batch["without"], strict=True):
                drawn.setdefault(row[-1], []).append(row[:-1])
        while drawn:
            without, own = drawn.popitem()
            own.sort(key=lambda r: r[0], reverse=True)  # the fit doesn't depend on how rows arrive
            left = [r for r in reversed(own) if r[2] == without]
            own = [r for r in own if r[2] != without]
            model = Classifier.fit((np.frombuffer(f, "<i4"), int(toxic)) for _, toxic, _, f in (own.pop() for _ in range(len(own))))
            margins = [model.margin(np.frombuffer(r[3], "<i4")) for r in left]
            yield pd.DataFrame({"weights": [model.weights.tobytes() if without == FOLDS else None], "bias": [model.bias], "margins": [margins], "toxic": [[bool(r[1]) for r in left]]})

    # a task has all of the bounded sample; an executor has more room than the driver
    dealt = rows.select("doc_id", "toxic", "f", "fold", "without").repartitionByRange(FOLDS + 1, "without")
    fits = dealt.mapInPandas(fit, "weights binary, bias double, margins array<double>, toxic array<boolean>").collect()  # FOLDS + 1 rows
    whole = next((r for r in fits if r["weights"] is not None), None)
    if whole is None:
        return Classifier(np.zeros(1 << BITS), Classifier.fit([]).bias)
    bias = whole["bias"] - cut([x for r in fits for x in r["margins"]], [x for r in fits for x in r["toxic"]])
    return Classifier(np.frombuffer(whole["weights"], "<f8"), bias)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with held_out, score and predicted added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers

    @F.pandas_udf("double")
    def run(text: pd.Series) -> pd.Series:
        of = shared.value.score
        return text.map(of).astype("float64")

    out = docs.drop("held_out", "score", "predicted").withColumn("held_out", held_out()).withColumn("score", run("text"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    @F.pandas_udf("double")
    def run(text: pd.Series) -> pd.Series:
        of = shared.value.score
        return text.map(of).astype("float64")

    return docs.where(run("text") < 0.5)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = _base.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, learn(docs, _base.table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")
