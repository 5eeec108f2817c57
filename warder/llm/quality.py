"""Document quality by pairwise ranking (Bradley-Terry) over text statistics."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warder.llm.common import documents, free_name

#: Bound of the labelled rows that the ranking is fitted on.
FIT_ROWS = 20_000
BINS = 12
PAIRS_PER_STEP = 4096
STEPS = 400
SEED = 7

UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LOWER = np.zeros(256, bool)
LOWER[97:123] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
STOP = np.zeros(256, bool)
STOP[[33, 44, 46, 58, 59, 63]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[33:127] = True
SYMBOL &= ~(UPPER | LOWER | DIGIT | STOP)

FEATURES = [
    "log_bytes", "upper", "digit", "blank", "stop", "exclaim", "symbol", "high_bytes", "bar", "byte_entropy",
    "words", "word_bytes", "distinct_words", "repeats", "distinct_trigrams", "top_word", "capital_words",
    "lines", "distinct_lines", "line_words", "distinct_sentences", "closed_lines", "short_words", "odd_words",
]


def text_features(text: str) -> list[float]:
    """Statistics of a whole text; an empty one has zeros."""
    data = text.encode("utf-8", "replace")
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts / n
    some = share[share > 0]
    words = text.split()
    m = max(1, len(words))
    distinct: dict[str, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    lines = text.split("\n")
    sentences = text.split(".")
    once = set(lines)
    follow = words[1:]
    return [
        float(np.log1p(n)),
        share[UPPER].sum(),
        share[DIGIT].sum(),
        share[BLANK].sum(),
        share[STOP].sum(),
        share[33],
        share[SYMBOL].sum(),
        share[128:].sum(),
        share[124],
        float(-(some * np.log2(some)).sum()),
        float(np.log1p(len(words))),
        n / m,
        len(distinct) / m,
        sum(map(str.__eq__, words, follow)) / m,
        len(set(zip(words, follow, words[2:], strict=False))) / m,
        max(distinct.values(), default=0) / m,
        sum(map(str.isupper, words)) / m,
        float(np.log1p(len(lines))),
        len(once) / len(lines),
        len(words) / len(lines),
        len(set(sentences)) / len(sentences),
        sum(x[-1:] in ".!?" for x in lines) / len(lines),
        sum(len(w) <= 3 for w in distinct) / max(1, len(distinct)),
        sum(not w[-1].isalnum() for w in distinct) / max(1, len(distinct)),
    ]


def features(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``features array<double>`` of the column text (null: empty)."""
    kinds = dict(df.dtypes)

    def run(batches):
        for batch in batches:
            rows = [text_features(t or "") for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "features"])

    return df.select(*keep, "text").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", features array<double>")


@dataclass
class Ranking:
    """Strength of a document: a weight for the bin of each feature, added up."""

    edges: np.ndarray  # features x (BINS - 1)
    weights: np.ndarray  # features x BINS
    threshold: float
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for f, (edges, weights) in enumerate(zip(self.edges, self.weights, strict=True)):
            total += weights[np.searchsorted(edges, x[:, f])]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; 0.5 at the threshold."""
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strength(x) - self.threshold), -60, 60)))

    def to_json(self) -> str:
        return json.dumps({"edges": self.edges.tolist(), "weights": self.weights.tolist(), "threshold": self.threshold, "slope": self.slope})

    @classmethod
    def from_json(cls, text: str) -> Ranking:
        d = json.loads(text)
        return cls(np.array(d["edges"]), np.array(d["weights"]), d["threshold"], d["slope"])


def pair_gradient(w: np.ndarray, better: np.ndarray, worse: np.ndarray) -> np.ndarray:
    """Gradient of the mean logistic loss of preference pairs; the rows of ``better`` and
    ``worse`` name the weights that add up to a document's strength."""
    miss = 1 / (1 + np.exp(np.clip(w[better].sum(1) - w[worse].sum(1), -60, 60)))
    each = np.repeat(miss, better.shape[1])
    return (np.bincount(worse.ravel(), each, len(w)) - np.bincount(better.ravel(), each, len(w))) / len(better)


def fit_ranking(x: np.ndarray, y: np.ndarray) -> Ranking:
    """Learn strengths from preference pairs: each pair has a document of label 1 and one of
    label 0, and the logistic loss is on the difference of their binned features.

    The threshold is the quantile of the fitted documents' strengths at the share of label 0.
    With labels of one kind only there are no pairs: all strengths are 0 and, at a score of
    0.5, all documents are taken for label 1.
    """
    n_features = len(FEATURES)
    edges = np.zeros((n_features, BINS - 1))
    weights = np.zeros((n_features, BINS))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(edges, weights, 0.0, 1.0)
    at = np.linspace(0, 1, BINS + 1)[1:-1]
    # bins follow the mean of both labels' quantiles, so that a rare label has its own bins
    for f in range(n_features):
        mixed = np.concatenate([np.quantile(x[good, f], at[::2]), np.quantile(x[bad, f], at[1::2])])
        edges[f, : len(mixed)] = np.sort(mixed)
        edges[f, len(mixed) :] = np.inf
    bins = np.stack([np.searchsorted(edges[f], x[:, f]) for f in range(n_features)], axis=1)
    flat = bins + np.arange(n_features) * BINS
    rng = np.random.default_rng(SEED)
    w, mean, square = np.zeros(n_features * BINS), np.zeros(n_features * BINS), np.zeros(n_features * BINS)
    for step in range(1, STEPS + 1):
        a, b = rng.choice(good, PAIRS_PER_STEP), rng.choice(bad, PAIRS_PER_STEP)
        g = pair_gradient(w, flat[a], flat[b]) + 1e-4 * w
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    ranking = Ranking(edges, w.reshape(n_features, BINS), 0.0, 1.0)
    strength = ranking.strength(x)
    ordered = np.sort(strength)
    # halfway between the last rejected and the first kept
    k = min(len(bad), len(ordered) - 1)
    ranking.threshold = float((ordered[k - 1] + ordered[k]) / 2)
    return ranking


def held_out(doc_id: str) -> Column:
    """Rows that are never learned from; a missing doc_id is one of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Ranking:
    """Fit on at most ``fit_rows`` labelled rows, the first by hash of doc_id, never held-out ones.

    The sample's identifiers are broadcast (their number is the bound), so the texts are not
    shuffled; only the features of the sample reach the driver. Null labels are skipped;
    several labels of a document count as the smallest.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = features(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), ["doc_id", "quality"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).toArrow()
    y = rows.column("quality").to_numpy()
    x = np.array(rows.column("features").to_pylist()).reshape(len(y), len(FEATURES))
    return fit_ranking(x, y)


def score_documents(docs: DataFrame, ranking: Ranking, name: str = "quality_score") -> DataFrame:
    """The documents and the score ``name`` of every whole text (null: empty)."""
    at = docs.columns.index("text")
    model = ranking.to_json()

    def run(batches):
        r = Ranking.from_json(model)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            x = np.array([text_features(t or "") for t in texts]).reshape(len(texts), len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r.score(x), pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of documents.

    Null and empty texts have a score too; repeated rows return as often as they come; an
    empty table gives no rows; other columns are not read.
    """
    scored = score_documents(docs.select("doc_id", "text"), learn(docs, labels, fit_rows))
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.col("quality_score").alias("score"),
        F.when(F.col("quality_score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents with a score of at least 0.5, with their columns."""
    name = free_name(docs, "__quality_score")
    return score_documents(docs, learn(docs, labels, fit_rows), name).filter(F.col(name) >= 0.5).drop(name)


def op9_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
