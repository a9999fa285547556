"""Text quality by positive-unlabelled learning."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import python_batches, stage

_MARKS = string.punctuation.encode()
FEATURES = len(_MARKS) + 18
#: Rows that a fit takes at most of the trusted positives, and of the unlabelled texts.
MOST_ROWS = 20_000


def features(text: str | None) -> np.ndarray:
    """Shares of kinds of characters, words and lines in a whole text; all zero for an empty one."""
    out = np.zeros(FEATURES, dtype=np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return out
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    out[: len(_MARKS)] = np.log1p(100 * counts[list(_MARKS)] / n)
    upper, lower, digit, other = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum(), counts[128:].sum()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), dtype=np.int32, count=len(words))
    distinct = len(set(words))
    bare = [w.strip(_MARKS) for w in words]
    out[len(_MARKS) :] = (
        upper / max(1, upper + lower),
        digit / n,
        other / n,
        counts[list(_MARKS)].sum() / n,
        counts[10] / n,
        np.log1p(len(words)),
        lengths.mean(),
        lengths.std(),
        (lengths == 1).mean(),
        (lengths > 15).mean(),
        distinct / len(words),
        len(words) / len(lines),
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
        sum(w.isupper() for w in bare) / len(bare),
        sum(not w for w in bare) / len(bare),
        1.0,
    )
    return out


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, x: the features of every whole text."""
    python_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = np.stack([features(t.as_py()) for t in batch.column(1)]) if batch.num_rows else np.zeros((0, FEATURES), np.float32)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<float>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled, from scores of both: the least ratio, over thresholds, of their shares above.

    Both shares are taken at their confidence bounds, so that thin tails don't decide.
    """
    cuts = np.quantile(positive, np.linspace(0, 0.95, 96))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(4 / delta) / 2)
    ratio = (u + slack / np.sqrt(len(unlabelled))) / np.maximum(p - slack / np.sqrt(len(positive)), 1e-6)
    best = int(np.argmin(ratio))
    return float(np.clip(u[best] / max(p[best], 1e-6), 0.05, 0.99))


class Model:
    """A network of one hidden layer on standardised features."""

    def __init__(self, x: np.ndarray, hidden: int, rng: np.random.Generator):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        k = x.shape[1]
        self.w = [rng.normal(0, 1 / np.sqrt(k), (k, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ self.w[0] + self.w[1])
        return z, h, h @ self.w[2] + self.w[3]

    def gradient(self, z: np.ndarray, h: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        back = slope[:, None] * self.w[2] * (1 - h * h)
        return [z.T @ back, back.sum(axis=0), h.T @ slope, slope.sum(keepdims=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x)[2], -30, 30)))


def _descend(model: Model, slopes, rounds: int, rng: np.random.Generator, positive: np.ndarray, unlabelled: np.ndarray, rate: float = 0.01, decay: float = 1e-4) -> None:
    """Adam over minibatches; slopes gives d risk / d output for the outputs of both sides."""
    m, v = [np.zeros_like(w) for w in model.w], [np.zeros_like(w) for w in model.w]
    for t in range(1, rounds + 1):
        xp, xu = (x[rng.integers(0, len(x), 512)] for x in (positive, unlabelled))
        (zp, hp, fp), (zu, hu, fu) = model.forward(xp), model.forward(xu)
        sp, su = slopes(fp, fu)
        for k, (a, b) in enumerate(zip(model.gradient(zp, hp, sp), model.gradient(zu, hu, su))):
            g = a + b + decay * model.w[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            model.w[k] = model.w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


def fit(positive: np.ndarray, unlabelled: np.ndarray, hidden: int = 16, rounds: int = 1500, seed: int = 7) -> tuple[Model, float]:
    """The model with least non-negative unbiased risk, and the class prior that was estimated for it.

    With l(f, +) and l(f, -) logistic losses and prior q, the risk is q E_P l(f, +) + max(0, E_U l(f, -) - q E_P l(f, -)); where the
    second term falls below 0, its gradient is turned around, so that it doesn't fit the unlabelled positives as negatives.
    """
    rng = np.random.default_rng(seed)
    sigmoid = lambda f: 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    both = np.concatenate([positive, unlabelled])

    first = Model(both, hidden, rng)  # positives against unlabelled, for the prior alone
    half_p, half_u = len(positive) // 2, len(unlabelled) // 2
    _descend(first, lambda fp, fu: ((sigmoid(fp) - 1) / len(fp), sigmoid(fu) / len(fu)), rounds // 2, rng, positive[:half_p], unlabelled[:half_u])
    prior = class_prior(first.score(positive[half_p:]), first.score(unlabelled[half_u:]))

    def slopes(fp, fu):
        loss_minus = lambda f: np.logaddexp(0, f).mean()
        pull = prior * (sigmoid(fp) - 1) / len(fp)
        push_p, push_u = -prior * sigmoid(fp) / len(fp), sigmoid(fu) / len(fu)
        if loss_minus(fu) - prior * loss_minus(fp) < 0:
            return -push_p, -push_u
        return pull + push_p, push_u

    model = Model(both, hidden, rng)
    _descend(model, slopes, rounds, rng, positive, unlabelled)
    return model, prior


def fit_on(rows: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model | None:
    """A model from featured() rows: positives are labelled 1 and not held out, unlabelled texts are any that aren't held out.

    Of each, the most_rows with the smallest hash of their id go to the driver. None without any positives.
    """
    learn = rows.where(~held_out(F.col("doc_id"))).withColumn("order", F.xxhash64("doc_id"))
    good = labels.where("quality = 1").select("doc_id").distinct()
    take = lambda df: np.array(df.orderBy("order", "x").limit(most_rows).select("x").toArrow()["x"].to_pylist(), dtype=np.float64)
    positive, unlabelled = take(learn.join(good, "doc_id", "left_semi")), take(learn)
    return fit(positive, unlabelled)[0] if len(positive) > 1 and len(unlabelled) > 1 else None


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text), from labels (doc_id, quality).

    Scores come from the whole text alone. A null text counts as empty; empty texts are scored like any other. A null id
    isn't held out. Without positive labels every score is 0.5. Labels that are null are none, and of labels that repeat
    any 1 counts. Rows that repeat are scored each; other columns are not used. An empty table gives an empty result.
    """
    rows = stage(featured(docs))
    model = fit_on(rows, labels, most_rows)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    out = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = MOST_ROWS) -> DataFrame:
    """The rows of docs whose score is at least threshold, as they are."""
    model = fit_on(stage(featured(docs)), labels, most_rows)
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = names.index("text")

    def run(batches):
        for batch in batches:
            if model is None or not batch.num_rows:
                yield batch
                continue
            x = np.stack([features(t.as_py()) for t in batch.column(at)])
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, schema)
