"""Quality classifier: gradient-boosted trees on histograms of document statistics, flattened for vectorised traversal."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import id_crc, text_or_empty
from tesserae.llm.labelled import labelled_sample

#: Labelled ids per class that the trees are grown from, at most.
MAX_ROWS = 10_000
BINS, DEPTH, TREES, RATE, RIDGE = 64, 4, 80, 0.15, 2.0
FEATURES = (
    "log_chars", "log_words", "word_length", "word_length_sd", "upper", "digit", "symbol", "space", "odd_words", "capital_words",
    "distinct_words", "top_word", "distinct_pairs", "distinct_fives", "log_lines", "distinct_lines", "line_words", "short_lines",
    "bars", "bangs", "stops", "markup", "at_or_slash",
)
ODD = re.compile(r"[^\w\s.,;:'\"?()-]")


def distinct_share(items: list) -> float:
    return len(set(items)) / len(items) if items else 1.0


def statistics(text: str) -> list[float]:
    """The features of one whole text; 0 or 1 where an empty text leaves a share undefined."""
    n = max(1, len(text))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    odd = ODD.findall(text)
    upper = sum(map(str.isupper, words))
    counts: dict[str, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    capitals = len(re.findall(r"[A-Z]", text))
    return [
        np.log1p(len(text)), np.log1p(len(words)), lengths.mean(), lengths.std(), capitals / n, len(re.findall(r"[0-9]", text)) / n,
        len(odd) / n, text.count(" ") / n, len(odd) / w, upper / w, len(counts) / w if words else 1.0, max(counts.values(), default=0) / w,
        distinct_share(list(zip(words, words[1:]))), distinct_share(list(zip(words, words[1:], words[2:], words[3:], words[4:]))),
        np.log1p(len(lines)), distinct_share(lines), w / max(1, len(lines)), sum(len(x) < 25 for x in lines) / max(1, len(lines)),
        text.count("|") / w, text.count("!") / w, text.count(".") / w, (text.count("<") + text.count("{") + text.count("[")) / w,
        (text.count("@") + text.count("/")) / w,
    ]


def feature_rows(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Forest:
    """Complete trees of one depth as arrays: the children of node i are 2i+1 (not above the cut) and 2i+2."""

    feature: np.ndarray  # [trees, 2**depth - 1]
    cut: np.ndarray
    leaf: np.ndarray  # [trees, 2**depth]
    prior: float

    def score(self, X: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(X), self.prior)
        rows = np.arange(len(X))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(X), dtype=np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (X[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def grow(X: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """Boosting on the logistic loss; all nodes of a level share one pass of histograms.

    A node whose best gain is not positive is cut at infinity, so its rows go to its left child.
    """
    inner = 2**depth - 1
    rate1 = (float(y.sum()) + 1) / (len(y) + 2)
    prior = float(np.log(rate1 / (1 - rate1)))
    none = Forest(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), prior)
    if len(y) == 0 or len(np.unique(y)) < 2:
        return none
    f = X.shape[1]
    edges = [np.unique(np.quantile(X[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(edges[j], X[:, j], side="left") for j in range(f)], axis=1)
    offset = binned + np.arange(f) * bins
    raw = np.full(len(y), prior)
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, cut, cut_bin = np.zeros(inner, int), np.full(inner, np.inf), np.full(inner, bins)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (f * bins) + offset).ravel()
            G = np.bincount(at, np.repeat(g, f), width * f * bins).reshape(width, f, bins).cumsum(axis=2)
            H = np.bincount(at, np.repeat(h, f), width * f * bins).reshape(width, f, bins).cumsum(axis=2)
            gt, ht = G[:, :, -1:], H[:, :, -1:]
            gain = G**2 / (H + RIDGE) + (gt - G) ** 2 / (ht - H + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(H < 1) | (ht - H < 1)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[first + k], cut[first + k], cut_bin[first + k] = j, edges[j][b], b
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut_bin[node])
        leaf = -np.bincount(node - inner, g, inner + 1) / (np.bincount(node - inner, h, inner + 1) + RIDGE) * rate
        raw += leaf[node - inner]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Forest(np.array(features), np.array(cuts), np.array(leaves), prior)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **names: str) -> Forest:
    """A forest from the bounded labelled sample; only its statistics come to the driver."""

    def measure(batches):
        for batch in batches:
            out = pd.DataFrame(feature_rows(list(batch["text"])), columns=list(FEATURES))
            yield out.assign(label=batch["label"].to_numpy(), doc_id=batch["doc_id"].astype("string").to_numpy())

    sample = labelled_sample(docs, labels, "quality", max_rows, **names)
    got = sample.mapInPandas(measure, ", ".join(f"{x} double" for x in FEATURES) + ", label int, doc_id string").toPandas()
    got = got.sort_values(["doc_id", *FEATURES])
    return grow(got[list(FEATURES)].to_numpy(), got.label.to_numpy(dtype=float))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null texts are empty texts, which score as their (constant) statistics do; repeated rows score alike; without labels of
    both classes every score is the base rate; other columns are ignored; an empty table gives no rows.
    """
    forest = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows, id_col=id_col, text_col=text_col))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(forest.value.score(feature_rows(list(texts))))

    rows = docs.select(F.col(id_col).alias("doc_id"), (id_crc(id_col) % 5 == 0).alias("held_out"), score(text_or_empty(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
