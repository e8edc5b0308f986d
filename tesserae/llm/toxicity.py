"""Toxicity by two class-conditional Kneser-Ney bigram models with shared backoff counts.

Counts are continuation counts at both levels: of the words before a word, and of the words before a bigram, so a text that
was copied a thousand times with small changes counts about once.  Discounts are estimated from counts of counts.  Below
both classes lies one backoff of the counts that the classes share, in proportion to the smaller of the two, plus ``FLOOR``
counts a word: an expression that is rare, or frequent in both classes, is about equally likely in both.

A toxic text is ordinary text with some toxic expressions, so its likelihood takes a share ``SHARE`` of every token from the
toxic model and the rest from the ordinary one.  The score compares the two log-likelihoods, divided by the text's length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import id_crc, text_or_empty
from tesserae.llm.labelled import labelled_sample, logistic
from tesserae.storage import materialise

#: Labelled ids per class that the models are trained from, at most.
MAX_ROWS = 6000
#: Words and bigrams with up to so many continuations in both classes together come wholly from the backoff.
RARE, PAIR_RARE = 3, 20
#: Shared counts that every word has at least, and that every history adds for the backoff.
FLOOR, HISTORY = 1.0, 100.0
#: Share of the toxic model in a toxic text's tokens, and tokens that a text's length counts more.
SHARE, LENGTH = 0.02, 20
#: Texts that are scored together.
SLICE = 128
TOKEN = re.compile(r"\w+")


@dataclass
class KneserNey:
    """The two models as arrays over word ids; id 0 is every word without a row."""

    ids: dict[str, int]
    unigram: np.ndarray  # [2, V]: interpolated continuation probabilities
    rest: np.ndarray  # [2, V]: mass that a history leaves to the unigram
    keys: np.ndarray  # sorted history * V + word
    bigram: np.ndarray  # [2, len(keys)]: discounted conditional probabilities
    slope: float = 1.0
    intercept: float = 0.0

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ordinary and toxic probability [2, n] of all tokens, text after text, and the number of tokens of each text."""
        get = self.ids.get
        found = [[get(w, 0) for w in TOKEN.findall(t.lower())] for t in texts]
        n = np.array([len(x) for x in found], dtype=np.int64)
        words = np.fromiter((i for x in found for i in x), dtype=np.int64, count=int(n.sum()))
        if not len(words):
            return np.zeros((2, 0)), n
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[(np.cumsum(n) - n)[n > 0]] = get("", 0)  # the history of a text's first word
        p = self.rest[:, before] * self.unigram[:, words]
        if len(self.keys):
            key = before * self.unigram.shape[1] + words
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            p += np.where(self.keys[at] == key, self.bigram[:, at], 0.0)
        return p, n

    def ratios(self, texts: list[str]) -> np.ndarray:
        """Per text the length-normalised log-likelihood ratio of toxic to ordinary, 0 without tokens; made a slice of texts
        at a time, which bounds the arrays over tokens."""
        out = [np.zeros(0)]
        for i in range(0, len(texts), SLICE):
            p, n = self.probabilities(texts[i : i + SLICE])
            total = np.concatenate([[0.0], np.cumsum(np.log1p(SHARE * (p[1] / p[0] - 1)))])
            ends = np.cumsum(n)
            out.append((total[ends] - total[ends - n]) / (n + LENGTH))
        return np.concatenate(out)

    def score(self, texts: list[str]) -> np.ndarray:
        """Calibrated probability of the toxic class."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.ratios(texts) + self.intercept, -40, 40)))


def contexts(batches):
    """Different (history, word, word before the history) of the texts of a partition, and in which classes they are."""
    seen: dict[tuple[str, str, int], int] = {}
    for batch in batches:
        for text, label in zip(batch["text"], batch["label"]):
            words = ["", *TOKEN.findall(text.lower())]
            for before, h, w in set(zip(["", *words], words, words[1:])):
                key = (h, w, xxhash.xxh64_intdigest(before) >> 1)
                seen[key] = seen.get(key, 0) | (1 << label)
            if len(seen) > 200_000:
                yield _frame(seen)
                seen = {}
    if seen:
        yield _frame(seen)


def _frame(seen: dict) -> pd.DataFrame:
    return pd.DataFrame([(h, w, g, c & 1, c >> 1) for (h, w, g), c in seen.items()], columns=["h", "w", "g", "ordinary", "toxic"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **names: str) -> KneserNey:
    """A model of the different texts of the labelled sample.

    Slope and intercept come from a quarter of the sample and a model of the other three quarters.
    """
    rows = labelled_sample(docs, labels, "toxic", max_rows, **names)
    sample = materialise(rows.groupBy("text").agg(F.max("label").alias("label")).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(4))))
    tuned = calibrate(fit(sample.where("fold > 0")), sample.where("fold = 0"))
    model = fit(sample)
    model.slope, model.intercept = tuned
    return model


def discount(ones: int, twos: int) -> float:
    """The absolute discount that counts of counts estimate."""
    return ones / max(1, ones + 2 * twos)


def fit(sample: DataFrame) -> KneserNey:
    """Both class models from (text, label) rows; counts are made on the executors, and those that are not rare collected."""
    found = sample.select("text", "label").mapInPandas(contexts, "h string, w string, g long, ordinary int, toxic int")
    found = found.groupBy("h", "w", "g").agg(F.max("ordinary").alias("ordinary"), F.max("toxic").alias("toxic"))
    pairs = materialise(found.groupBy("h", "w").agg(F.sum("ordinary").alias("c0"), F.sum("toxic").alias("c1")))
    words = materialise(pairs.groupBy("w").agg(*(F.count_if(F.col(f"c{c}") > 0).alias(f"n{c}") for c in (0, 1))))
    tally = lambda df, name: df.agg(*(F.count_if(F.col(f"{name}{c}") == k).alias(f"d{c}{k}") for c in (0, 1) for k in (1, 2))).first()
    of_words, of_pairs = tally(words, "n"), tally(pairs, "c")
    total = words.agg(*(F.coalesce(F.sum(f"n{c}"), F.lit(0)).alias(f"n{c}") for c in (0, 1)), F.count("*").alias("v")).first()
    listed = words.where(F.col("n0") + F.col("n1") > RARE).toPandas()
    kept = pairs.where(F.col("c0") + F.col("c1") > PAIR_RARE)
    sums = pairs.groupBy("h").agg(*(F.sum(f"c{c}").alias(f"s{c}") for c in (0, 1)))
    kept = kept.join(sums, "h").toPandas().sort_values(["h", "w"])

    ids = {w: i for i, w in enumerate(sorted(set(listed.w) | set(kept.w) | set(kept.h)), 1)}
    V, kinds = len(ids) + 1, total.v + 1  # the unknown word is one more
    at = listed.w.map(ids).to_numpy(dtype=np.int64)
    n, N = np.zeros((2, V)), np.array([max(1, total.n0), max(1, total.n1)], dtype=float)
    for c in (0, 1):
        n[c, at] = listed[f"n{c}"].to_numpy()
    shared = np.min(n / N[:, None], axis=0) * N.mean() + FLOOR
    shared /= shared.sum() + FLOOR * (kinds - V + ("" in ids))  # words without an id have the floor; the history "" is no word
    unigram = np.empty((2, V))
    for c in (0, 1):
        own = np.maximum(n[c] - discount(of_words[f"d{c}1"], of_words[f"d{c}2"]), 0)
        whole = N[c] + FLOOR * kinds
        unigram[c] = (own + (whole - own.sum()) * shared) / whole
    h = kept.h.map(ids).to_numpy(dtype=np.int64)
    keys = h * V + kept.w.map(ids).to_numpy(dtype=np.int64)
    bigram, rest = np.zeros((2, len(kept))), np.ones((2, V))
    for c in (0, 1):
        own = np.maximum(kept[f"c{c}"].to_numpy() - discount(of_pairs[f"d{c}1"], of_pairs[f"d{c}2"]), 0)
        bigram[c] = own / (kept[f"s{c}"].to_numpy() + HISTORY)
        np.subtract.at(rest[c], h, bigram[c])
    order = np.argsort(keys)
    return KneserNey(ids, unigram, rest, keys[order], bigram[:, order])


def calibrate(model: KneserNey, sample: DataFrame) -> tuple[float, float]:
    """Slope and intercept of the logistic regression on the ratio."""
    held = sample.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            yield pd.DataFrame({"x": held.value.ratios(list(batch["text"])), "label": batch["label"].to_numpy()})

    tune = sample.select("text", "label").mapInPandas(measure, "x double, label int").toPandas()
    return logistic(tune["x"].to_numpy(), tune["label"].to_numpy(dtype=float))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, and the columns named in ``keep``.

    Null and empty texts have ratio 0; texts of any length are scored whole; a null id counts as held out or not by the crc
    of the empty string; repeated rows score alike; without labels of both classes every score is the base rate; an empty
    table gives no rows; other columns are ignored, and ``keep`` may not name those of the result.  Texts are scored in Arrow
    batches, and nothing but the bounded labelled sample is shuffled.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows, id_col=id_col, text_col=text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), (id_crc(id_col) % 5 == 0).alias("held_out"), text_or_empty(text_col).alias("__text"), *keep)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(list(texts)))

    scored = rows.withColumn("score", score("__text"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *keep)
