"""Language of documents by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warder.llm.common import documents

#: Bound of the labelled rows that the network is fitted on, and of the pieces of each.
FIT_ROWS, FIT_PIECES = 4_000, 4
#: Bytes that the network reads in a row, in both directions; one token more fills up pieces.
PIECE, FILL = 128, 256
HIDDEN = 8
#: Steps of training, pieces of one, and the rate it starts at.
STEPS, BATCH, RATE = 300, 256, 0.02
#: Pieces that are read side by side.
SIDE_BY_SIDE = 2048
SEED = 13
#: Languages that are told apart at most, the most frequent ones.
LANGUAGES = 256
NO_LANGUAGE = "und"
LETTER = regex.compile(r"\p{L}")

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def start_params(hidden: int, kinds: int, rng: np.random.Generator, dtype=np.float32) -> Params:
    """Two directions, each with what a byte adds to the gates (update, reset, new state) and
    the weights of the state; then the weights of both states for the labels."""
    make = lambda scale, *shape: rng.normal(0, scale, shape).astype(dtype)
    out = {}
    for d in "fb":
        out[f"{d}_byte"] = make(0.3, 257, 3 * hidden)
        out[f"{d}_state"] = make(hidden**-0.5, 3 * hidden, hidden)
        out[f"{d}_label"] = make(hidden**-0.5, kinds, hidden)
    return out | {"bias": np.zeros((kinds, 1), dtype)}


def run_direction(p: Params, d: str, tokens: np.ndarray) -> list[tuple]:
    """All steps of one direction over tokens (time, piece): (time, state before, update, reset,
    state's share of the new one, new, state after)."""
    table, weights = p[f"{d}_byte"].T, p[f"{d}_state"]
    size = weights.shape[1]
    h = np.zeros((size, tokens.shape[1]), weights.dtype)
    steps = []
    for t in range(len(tokens)) if d == "f" else reversed(range(len(tokens))):
        x, a = table[:, tokens[t]], weights @ h
        gates = sigmoid(x[: 2 * size] + a[: 2 * size])
        z, r, share = gates[:size], gates[size:], a[2 * size :]
        new = np.tanh(x[2 * size :] + r * share)
        after = new + z * (h - new)
        steps.append((t, h, z, r, share, new, after))
        h = after
    return steps


def loss_and_gradient(p: Params, tokens: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, Params]:
    """Mean cross-entropy of the labels of all positions in ``mask`` (time, piece), and its
    gradient by backpropagation through time; every position has the label of its piece."""
    runs = {d: run_direction(p, d, tokens) for d in "fb"}
    after: dict[str, dict[int, np.ndarray]] = {d: {s[0]: s[-1] for s in steps} for d, steps in runs.items()}
    g = {k: np.zeros_like(v) for k, v in p.items()}
    total, loss, back = mask.sum(), 0.0, []
    columns = np.arange(len(label))
    for t in range(len(tokens)):
        logits = p["f_label"] @ after["f"][t] + p["b_label"] @ after["b"][t] + p["bias"]
        e = np.exp(logits - logits.max(axis=0))
        e /= e.sum(axis=0)
        loss -= float((np.log(np.maximum(e[label, columns], 1e-30)) * mask[t]).sum())
        e[label, columns] -= 1
        e *= mask[t] / total
        back.append(e)
        g["bias"] += e.sum(axis=1, keepdims=True)
    for d, steps in runs.items():
        weights = p[f"{d}_state"]
        size = weights.shape[1]
        dh, by_token = np.zeros_like(steps[0][1]), np.zeros((len(tokens), 3 * size, len(label)), weights.dtype)
        for t, before, z, r, share, new, state in reversed(steps):
            g[f"{d}_label"] += back[t] @ state.T
            dh = dh + p[f"{d}_label"].T @ back[t]
            d_new = dh * (1 - z) * (1 - new * new)
            d_gates = np.concatenate([dh * (before - new) * z * (1 - z), d_new * share * r * (1 - r)])
            d_a = np.concatenate([d_gates, d_new * r])
            by_token[t] = np.concatenate([d_gates, d_new])
            g[f"{d}_state"] += d_a @ before.T
            dh = dh * z + weights.T @ d_a
        flat, each = tokens.ravel(), by_token.transpose(1, 0, 2).reshape(3 * size, -1)
        g[f"{d}_byte"] = np.stack([np.bincount(flat, row, 257) for row in each], axis=1).astype(weights.dtype)
    return loss / float(total), g


@dataclass
class Network:
    """The languages that were learned, and the weights."""

    languages: list[str]
    params: Params

    def piece_probabilities(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sum over the positions of each piece of the probabilities of its labels (label, piece).

        ``tokens`` is (time, piece). Sigmoids are written as tanh, with the halves put into the
        weights beforehand.
        """
        p = self.params
        size, n = p["f_state"].shape[1], tokens.shape[1]
        half = np.where(np.arange(3 * size) < 2 * size, 0.5, 1).astype(np.float32)
        ready = {d: (np.ascontiguousarray((p[f"{d}_byte"] * half).T), p[f"{d}_state"] * half[:, None]) for d in "fb"}
        forward = np.empty((len(tokens), len(self.languages), n), np.float32)
        x, a = np.empty((3 * size, n), np.float32), np.empty((3 * size, n), np.float32)
        h, new = np.zeros((size, n), np.float32), np.empty((size, n), np.float32)
        total, logits = np.zeros((len(self.languages), n), np.float32), np.empty((len(self.languages), n), np.float32)
        z, r = x[:size], x[size : 2 * size]
        for d in "fb":
            table, weights = ready[d]
            h[:] = 0
            for t in range(len(tokens)) if d == "f" else reversed(range(len(tokens))):
                np.take(table, tokens[t], axis=1, out=x, mode="clip")
                np.matmul(weights, h, out=a)
                gates = x[: 2 * size]
                gates += a[: 2 * size]
                np.tanh(gates, out=gates)
                gates += 1
                gates *= 0.5
                np.multiply(r, a[2 * size :], out=new)
                new += x[2 * size :]
                np.tanh(new, out=new)
                h -= new
                h *= z
                h += new
                if d == "f":
                    np.matmul(p["f_label"], h, out=forward[t])
                    continue
                np.matmul(p["b_label"], h, out=logits)
                logits += forward[t]
                logits += p["bias"]
                logits -= logits.max(axis=0)
                np.exp(logits, out=logits)
                logits *= (t < lengths) / logits.sum(axis=0)
                total += logits
        return total

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean over all bytes of a text of the probabilities of each language (text, label);
        empty texts have zeros. A text is read in pieces; both directions start anew in each."""
        sizes = np.array([len(t) for t in texts], np.int64)
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        tokens = np.full((len(owner), PIECE), FILL, np.int16)
        flat, at = tokens.reshape(-1), 0
        for text, n in zip(texts, pieces, strict=True):
            flat[at * PIECE : at * PIECE + len(text)] = np.frombuffer(text, np.uint8)
            at += n
        lengths = (tokens != FILL).sum(axis=1)
        out = np.zeros((len(texts), len(self.languages)))
        for i in range(0, len(owner), SIDE_BY_SIDE):
            some = slice(i, i + SIDE_BY_SIDE)
            found = self.piece_probabilities(np.ascontiguousarray(tokens[some].T).astype(np.intp), lengths[some])
            for k, row in enumerate(found):
                out[:, k] += np.bincount(owner[some], row, len(texts))
        return out / np.maximum(sizes, 1)[:, None]

    def to_json(self) -> str:
        return json.dumps({"languages": self.languages, "params": {k: v.tolist() for k, v in self.params.items()}})

    @classmethod
    def from_json(cls, text: str) -> Network:
        d = json.loads(text)
        return cls(d["languages"], {k: np.array(v, np.float32) for k, v in d["params"].items()})


def fit(pieces: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = SEED) -> Network:
    """Train on pieces of at most PIECE bytes, by Adam on batches in which all languages are as
    frequent as each other. Without pieces the network knows no language."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    p = start_params(hidden, max(1, len(languages)), rng)
    if not pieces:
        return Network([], p)
    tokens = np.full((len(pieces), PIECE), FILL, np.int64)
    for row, piece in zip(tokens, pieces, strict=True):
        row[: len(piece)] = np.frombuffer(piece, np.uint8)
    mask = (tokens != FILL).astype(np.float32)
    label = np.array([languages.index(x) for x in labels])
    of = [np.flatnonzero(label == k) for k in range(len(languages))]
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        some = np.array([rng.choice(of[k]) for k in rng.integers(0, len(languages), BATCH)])
        _, g = loss_and_gradient(p, np.ascontiguousarray(tokens[some].T), np.ascontiguousarray(mask[some].T), label[some])
        norm = float(np.sqrt(sum((v.astype(np.float64) ** 2).sum() for v in g.values())))
        rate = RATE * (1 - 0.9 * step / steps)
        for k, v in g.items():
            v *= min(1.0, 1.0 / max(norm, 1e-12))
            mean[k] = 0.9 * mean[k] + 0.1 * v
            square[k] = 0.99 * square[k] + 0.01 * v * v
            p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(p[k].dtype)
    return Network(languages, p)


def held_out(doc_id: str) -> Column:
    """Rows that are never learned from; a missing doc_id is one of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def sample_pieces(sample: DataFrame, pieces: int) -> DataFrame:
    """(piece, lang): up to ``pieces`` pieces of each text, spread over all of it."""

    def run(batches):
        for batch in batches:
            out, langs = [], []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                most = max(1, min(pieces, len(text) // PIECE))
                for i in range(most):
                    at = i * len(text) // most
                    out.append(text[at : at + PIECE])
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(langs, pa.string())], names=["piece", "lang"])

    return sample.select(F.col("text").cast("binary").alias("text"), "lang").mapInArrow(run, "piece binary, lang string")


def learn(docs: DataFrame, fit_rows: int = FIT_ROWS, pieces: int = FIT_PIECES, **options) -> Network:
    """Fit on at most ``fit_rows`` rows with text and lang that are not held out.

    The sample takes about as many rows of each language (of at most LANGUAGES, the most
    frequent), those with the least hash of doc_id; rarer languages give all they have. Only
    its pieces reach the driver.
    """
    usable = docs.filter(~held_out("doc_id") & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).collect()
    if not counts:
        return fit([], [], **options)
    share = fit_rows / len(counts)
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, share / r["n"])) for r in counts], "lang string, rate double")
    dice = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    ids = usable.select("doc_id", "lang").join(F.broadcast(rates), "lang").filter(dice < F.col("rate") * 1_000_003)
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select("doc_id").distinct()
    sample = usable.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id")
    rows = sample_pieces(sample, pieces).orderBy(F.xxhash64("piece"), "piece", "lang").limit(fit_rows * pieces).toArrow()
    return fit(rows.column("piece").to_pylist(), rows.column("lang").to_pylist(), **options)


def identify(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row: the language with the highest mean
    probability over all bytes of the whole text, and that probability.

    Texts that are null or have no letter are ``und`` with a score of 0, and so is every text if
    no language was learned. Repeated rows return as often as they come; an empty table gives
    no rows; other columns are not read.
    """
    model = network.to_json()

    def run(batches):
        net = Network.from_json(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            texts = [t if net.languages and LETTER.search(t) else "" for t in texts]
            found = net.probabilities([t.encode("utf-8", "replace") for t in texts])
            best = found.argmax(axis=1) if net.languages else np.zeros(len(texts), int)
            names = [net.languages[k] if t else NO_LANGUAGE for t, k in zip(texts, best, strict=True)]
            score = [min(1.0, max(0.0, float(row[k]))) if t else 0.0 for t, row, k in zip(texts, found, best, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, learn(docs))
