"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import process_cache, stored, text_batches

FEATURES = ("log_chars", "log_words", "mean_word", "long_words", "distinct_words", "repeated_pairs", "repeated_lines", "mean_line", "upper", "digits",
            "spaces", "stops", "exclaims", "symbols", "pipes", "other", "ends_in_letter", "commonest_word")
#: Rows that a model is fitted to at most (those with the smallest hash of the id).
MAX_ROWS = 50_000


def _classes() -> np.ndarray:
    """0 lower or caseless letter, 1 upper letter, 2 digit, 3 space, 4 stop or comma, 5 exclamation or question mark, 6 symbol, 7 bar, 8 other."""
    def one(i: int) -> int:
        c, k = chr(i), unicodedata.category(chr(i))
        if k == "Lu":
            return 1
        if k[0] in "LM":
            return 0
        if k[0] == "N":
            return 2
        return 3 if c.isspace() else 4 if c in ".,;:" else 5 if c in "!?" else 7 if c == "|" else 6 if c in "#*$%&<>{}[]=+_~^\\/" else 8
    return np.fromiter(map(one, range(0x110000)), np.uint8, 0x110000)


def statistics(text: str | None) -> list[float]:
    """The values of FEATURES for a whole text (NULL and empty: zeros)."""
    if not text:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(process_cache("classes", _classes)[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=9)
    words, n = text.split(), len(text)
    m = max(1, len(words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x]
    pairs = len(set(zip(words, words[1:])))
    return [np.log1p(n), np.log1p(len(words)), float(lengths.mean()) if len(words) else 0.0, float((lengths > 15).mean()) if len(words) else 0.0,
            len(counts) / m, 1 - pairs / max(1, len(words) - 1), 1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)),
            kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / m, kinds[5] / m, kinds[6] / m, kinds[7] / m, kinds[8] / m,
            sum(1 for w in words if w[-1].isalpha()) / m, max(counts.values(), default=0) / m]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ``x`` (array<float> in the order of FEATURES) per row, from whole texts."""
    def run(batches):
        for b in batches:
            yield pd.DataFrame({id_col: b["id"], "x": [np.array(statistics(t), np.float32) for t in b["text"]]})

    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"`{id_col}` {kind}, x array<float>")


@dataclass
class Forest:
    """Complete trees as arrays (tree, node): the children of node i are 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; all rows go down all trees at once."""
        trees = np.arange(len(self.feature))
        at = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        z = self.base + self.leaf[trees, at - (2 ** self.depth - 1)].sum(axis=1) if len(trees) else np.full(len(x), self.base)
        return 1 / (1 + np.exp(-z))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0) -> Forest:
    """Boost the logistic loss; each level's splits come from one histogram of gradients per feature.

    Without rows, or with one class only, the forest is a constant."""
    inner, leaves = 2 ** depth - 1, 2 ** depth
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(p / (1 - p)))
    none = np.zeros((0, inner), np.int64)
    if not len(y) or y.min() == y.max():
        return Forest(base, none, none.astype(float), np.zeros((0, leaves)), depth)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)  # x <= edge k: code <= k
    z = np.full(len(y), base)
    feature, threshold, leaf = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-z))
        g, h = prob - y, prob * (1 - prob)
        node = np.zeros(len(y), np.int64)
        tf, tt = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            gain, split_f, split_k = np.zeros(width), np.zeros(width, np.int64), np.full(width, -1)
            for f, e in enumerate(edges):
                k = len(e) + 1
                if k < 2:
                    continue
                key = (node - first) * k + code[:, f]
                gs = np.bincount(key, g, width * k).reshape(width, k).cumsum(axis=1)
                hs = np.bincount(key, h, width * k).reshape(width, k).cumsum(axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gl, hl = gs[:, :-1], hs[:, :-1]
                won = gl ** 2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga ** 2 / (ha + ridge)
                won[(hl < 1) | (ha - hl < 1)] = 0
                best = won.argmax(axis=1)
                top = won[np.arange(width), best]
                better = top > gain + 1e-9
                gain[better], split_f[better], split_k[better] = top[better], f, best[better]
            for i in range(width):
                if split_k[i] >= 0:
                    tf[first + i], tt[first + i] = split_f[i], edges[split_f[i]][split_k[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), tf[node]] > tt[node])
        end = node - inner
        value = -rate * np.bincount(end, g, leaves) / (np.bincount(end, h, leaves) + ridge)
        z = z + value[end]
        feature.append(tf), threshold.append(tt), leaf.append(value)
    return Forest(base, np.stack(feature), np.stack(threshold), np.stack(leaf), depth)


def fit_quality(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Forest:
    """A forest from the statistics of labelled rows; ``max_rows`` bounds what comes to the driver (72 bytes a row).
    Of more rows those of the smallest hashes are taken: a cut of the hash by the rows' number leaves about as many, and
    only these are put in order.  Repeated rows count once; of several labels of one id the smallest counts; NULL labels
    are none; without labels, or rows, the forest is a constant."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("double").alias("y"))
    rows = stored(stats.join(known, id_col).select(id_col, "x", "y").distinct().withColumn("h", F.pmod(F.xxhash64(id_col, "x"), F.lit(1 << 40))), "labelled")
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.col("h") < int((1 << 40) * min(1.0, (max_rows + 6 * max_rows ** 0.5) / n)))
    rows = rows.toPandas().sort_values(["h", id_col]).head(max_rows)
    x = np.array(rows["x"].tolist(), np.float32).reshape(len(rows), len(FEATURES))
    return fit_forest(x, rows["y"].to_numpy(float))


def score_quality(stats: DataFrame, model: Forest, id_col: str = "doc_id") -> DataFrame:
    """id_col, score, predicted for every row of statistics."""
    sent = stats.sparkSession.sparkContext.broadcast(model)  # trees x nodes numbers

    def run(batches):
        for b in batches:
            if len(b):
                s = sent.value.scores(np.array(b["x"].tolist(), np.float32))
                yield pd.DataFrame({id_col: b["id"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    kind = stats.schema[id_col].dataType.simpleString()
    return stats.select(F.col(id_col).alias("id"), "x").mapInPandas(run, f"`{id_col}` {kind}, score double, predicted int")


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                     learn_from=None, max_rows: int = MAX_ROWS) -> DataFrame:
    """id_col, score, predicted per row of ``docs``; fitted to the labelled rows where the condition ``learn_from`` holds.

    Whole texts are read once; their statistics go to the shared folder, are joined with
    the labels and scored there.  NULL and empty texts have zero statistics and get a score
    like others; repeated rows and NULL ids too.  Without labels all scores are 0.5.
    An empty table gives no rows; other columns are not read."""
    stats = stored(document_statistics(docs, id_col, text_col), "statistics")
    model = fit_quality(stats if learn_from is None else stats.where(learn_from), labels, id_col, label_col, max_rows)
    return score_quality(stats, model, id_col)
