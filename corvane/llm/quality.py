"""Quality classifier by positive-unlabelled learning.

A small network minimises the non-negative unbiased risk
    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])
over trusted positives and unlabelled text. Features are shares and lengths of the
text and how common its letter sequences are in the whole corpus. All documents are
the unlabelled text: they are counted into the cells of a fixed division of feature
space, and the fit on the driver draws from the cells' means by their counts, so what
it holds is bounded and no document is left out. The class prior comes from the
scores of all documents: the least ratio of the shares of unlabelled and
positive texts above a score. Scoring covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from corvane.llm.common import LOWER_TABLE, crc32_mod, deflated, materialize, summed, trim

SYMBOLS = b"#*$%&|<>"
FEATURES = 20
#: Runs of three bytes are counted in so many cells.
CELLS = 1 << 16
#: Bins in which the scores of all documents are counted, equal steps of their log-odds from -30 to 30.
BINS = 6_000


def triples(data: bytes) -> np.ndarray:
    """The cells of all runs of three bytes of a text, A-Z in lower case."""
    b = np.frombuffer(data.translate(LOWER_TABLE), np.uint8).astype(np.uint32)
    return (b[:-2] << 10 ^ b[1:-1] << 5 ^ b[2:]) & (CELLS - 1)


def commonness(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """For each cell the log10 of its share of all runs of three bytes in all texts."""
    import pyarrow as pa

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in rows:
            for text in batch.column(0).to_pylist():
                total += np.bincount(triples((text or "").encode()), minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array([deflated(total)], pa.binary())], ["n"])

    counts = summed(docs.select(text_col).mapInArrow(run, "n binary"), "n", CELLS)
    return np.log10((counts + 0.5) / (counts.sum() + 0.5 * CELLS))


def features(text: str | None, common: np.ndarray) -> list[float]:
    """Shares and lengths of a whole text, and how common its letter sequences are. Texts without words give zeros but for their marker."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * (FEATURES - 1) + [1.0]
    known = common[triples(data)] if len(data) > 2 else np.full(1, -3.0)
    n, chars = len(words), len(data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = [data.count(bytes([c])) for c in SYMBOLS]
    marks = data.count(b"!")
    ended = sum(x.rstrip()[-1:] in b".!?:\"'" for x in lines)
    eights = {hash(tuple(words[i : i + 8])) for i in range(max(1, n - 7))}
    return [
        np.log1p(n) / 10,
        min(1.0, sum(symbols) / chars * 4),
        min(1.0, symbols[5] / n),
        min(1.0, (symbols[0] + symbols[1] + symbols[2] + symbols[3] + symbols[4]) / n),
        min(1.0, (symbols[6] + symbols[7]) / n),
        upper / chars,
        min(1.0, marks / n),
        min(1.0, data.count(b"!!") / n),
        min(2.0, sum(map(len, words)) / n / 8),
        len(set(words)) / n,
        len(set(lines)) / len(lines),
        len(eights) / max(1, n - 7),
        ended / len(lines),
        min(1.0, (data.count(b".") + data.count(b",")) / n),
        (chars - len(data.translate(None, b"0123456789"))) / chars,
        min(1.0, n / len(lines) / 100),
        min(1.0, (data.count(b"http") + data.count(b"www.") + data.count(b"{") + data.count(b"=")) / n * 4),
        float(known.mean()),
        float((known < -5).mean()),
        0.0,
    ]


#: Where in the features stands how common a text's letter sequences are.
COMMON = 17


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: tuple  # of the hidden layer, its offsets, the output's, its offset
    prior: float
    least: float = -np.inf  # least commonness among the positives
    common: np.ndarray | None = None  # of the corpus it was trained on

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; texts whose letter sequences are rarer than in any trusted positive fall off."""
        w1, b1, w2, b2 = self.weights
        out = np.maximum(((x - self.mean) / self.scale) @ w1 + b1, 0) @ w2 + b2[0]
        unlike = np.where(x[:, FEATURES - 1] > 0, 0.0, np.minimum(0.0, x[:, COMMON] - self.least + 0.3))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30))) * np.exp(8 * unlike)


def bin_of(scores: np.ndarray) -> np.ndarray:
    """The bin of each score, by its log-odds."""
    s = np.clip(scores, 1e-13, 1 - 1e-13)
    return np.clip((np.log(s / (1 - s)) + 30) / 60 * BINS, 0, BINS - 1).astype(np.int64)


def estimate_prior(pos: np.ndarray, unl: np.ndarray, bins: bool = False) -> float:
    """Share of positives among the unlabelled, from scores of both: least ratio of the shares above a score, with the sampling error added.

    With bins, unl holds how many documents have a score in each bin.
    """
    if bins:
        pos, above = bin_of(pos), np.cumsum(unl[::-1])[::-1]
    cuts = np.quantile(pos, np.linspace(0, 0.5, 101), method="lower")  # at least half of the positives stay above
    n = unl.sum() if bins else len(unl)
    ratios = []
    for c in cuts:
        p, u = (pos >= c).mean(), above[c] / n if bins else (unl >= c).mean()
        ratios.append(u / p + np.sqrt(1 / len(pos) + 1 / n) / p)
    return float(min(0.99, max(0.01, min(ratios))))


#: How strongly weights are drawn to zero.
DECAY = 3e-3


def loss_gradient(weights: list[np.ndarray], x: np.ndarray, sign: float, weight: float) -> tuple[float, list[np.ndarray]]:
    """Of weight * mean sigmoid(-sign * output), with its gradient by the weights."""
    pre = x @ weights[0] + weights[1]
    act = np.maximum(pre, 0)
    out = act @ weights[2] + weights[3][0]
    loss = 1 / (1 + np.exp(np.clip(sign * out, -30, 30)))
    d = -sign * loss * (1 - loss) * weight / len(x)
    back = np.outer(d, weights[2]) * (pre > 0)
    return float(loss.mean() * weight), [x.T @ back, back.sum(0), act.T @ d, np.array([d.sum()])]


def risk_gradient(weights: list[np.ndarray], xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, list[np.ndarray]]:
    """The non-negative risk of positives and unlabelled, and the direction to descend: its gradient, or, where the part
    that can't be negative is, a step back from that part."""
    r_pos, g_pos = loss_gradient(weights, xp, 1.0, prior)
    r_unl, g_unl = loss_gradient(weights, xu, -1.0, 1.0)
    r_neg, g_neg = loss_gradient(weights, xp, -1.0, -prior)
    if r_unl + r_neg >= 0:
        return r_pos + r_unl + r_neg, [a + b + c for a, b, c in zip(g_pos, g_unl, g_neg)]
    return r_pos, [-(b + c) for b, c in zip(g_unl, g_neg)]


def descend(weights: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float, steps: int, rate: float, seed: int, share: np.ndarray | None = None) -> list[np.ndarray]:
    """Adam on the non-negative risk with the sigmoid loss, from these weights; p, u: positives and unlabelled, scaled; share: how often each of u is drawn."""
    rng = np.random.default_rng(seed)
    weights = [w.copy() for w in weights]
    m, v, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    size = 512
    while t < steps:
        up = rng.permutation(len(u)) if share is None else rng.choice(len(u), max(len(u), size), p=share)
        for at in range(0, len(up), size):
            _, g = risk_gradient(weights, p[rng.integers(0, len(p), size)], u[up[at : at + size]], prior)
            t += 1
            g = [x + DECAY * w for x, w in zip(g, weights)]
            for i in range(4):
                m[i] = 0.9 * m[i] + 0.1 * g[i]
                v[i] = 0.999 * v[i] + 0.001 * g[i] ** 2
                weights[i] = weights[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return weights


def fit(pos: np.ndarray, unl: np.ndarray, prior: float | None = None, hidden: int = 24, steps: int = 2400, seed: int = 7, mean: np.ndarray | None = None, scale: np.ndarray | None = None, share: np.ndarray | None = None) -> Model:
    """A fit in memory; without a prior, a first fit at one half ranks texts to estimate it. share: as in descend()."""
    if prior is None:
        first = fit(pos, unl, 0.5, hidden, max(1, steps // 3), seed, mean, scale)
        prior = estimate_prior(first.score(pos), first.score(unl))
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(0) if mean is None else mean, both.std(0) + 1e-3 if scale is None else scale
    rng = np.random.default_rng(seed)
    start = [rng.normal(0, np.sqrt(2 / FEATURES), (FEATURES, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    weights = descend(start, (pos - mean) / scale, (unl - mean) / scale, prior, steps, 3e-3, seed, share)
    return Model(mean, scale, tuple(weights), prior)


def _matrix(column) -> np.ndarray:
    """An Arrow column of lists of FEATURES numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, FEATURES)


def featured(docs: DataFrame, common: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the features of every row; null and empty texts are texts without words, repeated rows stay apart, null ids stay null, other columns are left aside."""
    import pyarrow as pa

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [features(t, common) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float32()))], ["id", "x"])
        trim()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, x array<float>")


def _sampled(rows: DataFrame, ids: DataFrame, n: int) -> np.ndarray:
    """Features of the rows whose ids are the n first by hash, one of each: at most n ids, so they are broadcast. Of rows that share an id the least features count."""
    chosen = ids.where(F.col("id").isNotNull()).distinct().orderBy(F.xxhash64("id"), "id").limit(n)
    got = rows.join(F.broadcast(chosen), "id", "left_semi").groupBy("id").agg(F.min("x").alias("x")).orderBy("id").select("x").toArrow()  # n rows at most
    return _matrix(got.column("x").combine_chunks()) if got.num_rows else np.empty((0, FEATURES))


#: Planes that divide feature space, each cell being a side of every one.
PLANES = 14
#: Sums of scaled features are kept in whole numbers of this fraction, so that they don't depend on the order of rows.
UNIT = 1 << 20


def cells_of(z: np.ndarray) -> np.ndarray:
    """The cell of each row of scaled features, by planes that are the same in every run."""
    rng = np.random.default_rng(11)
    normals, offsets = rng.normal(size=(FEATURES, PLANES)), rng.normal(scale=0.5, size=PLANES)
    return ((z @ normals > offsets) << np.arange(PLANES)).sum(1)


def cells(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, how many documents) of every cell of feature space that holds any: the mean of all its documents."""
    import pyarrow as pa

    width = FEATURES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << PLANES, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                z = np.clip((_matrix(batch.column(0)) - mean) / scale, -100, 100)
                np.add.at(total, cells_of(z), np.c_[np.ones(len(z), np.int64), np.rint(z * UNIT).astype(np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array([deflated(total.ravel())], pa.binary())], ["n"])

    total = summed(rows.select("x").mapInArrow(run, "n binary"), "n", width << PLANES).reshape(-1, width)
    total = total[total[:, 0] > 0]
    return total[:, 1:] / UNIT / total[:, :1] * scale + mean, total[:, 0]


def _counted(rows: DataFrame, model: Model) -> np.ndarray:
    """How many documents have a score in each bin."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            total += np.bincount(bin_of(model.score(_matrix(batch.column(0)))), minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array([deflated(total)], pa.binary())], ["n"])

    return summed(rows.select("x").mapInArrow(run, "n binary"), "n", BINS)


def train_on(rows: DataFrame, labels: DataFrame, common: np.ndarray, sample: int = 20_000, folds: int = 4, held_out_fold: int = 2, id_col: str = "doc_id", label_col: str = "quality") -> Model | None:
    """Fit on rows (as from featured()): at most `sample` labelled positives outside the held-out fold, and all documents as unlabelled ones.

    The unlabelled documents come in as the means and counts of cells; scales and the prior are over all rows too. Labels
    other than 1 are never read as negatives. None where there are no positives or no documents to learn from. Of rows that
    share an id one is a trusted positive; as unlabelled ones all count.
    """
    trusted = labels.where((F.col(label_col) == 1) & (crc32_mod(id_col, folds) != held_out_fold)).select(F.col(id_col).cast("long").alias("id"))
    pos = _sampled(rows, trusted, sample)
    if not len(pos):
        return None
    at = [F.col("x")[i].cast("double") for i in range(FEATURES)]
    sums = rows.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(at)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(at))).first()
    mean, scale = np.array(sums[:FEATURES]), np.array(sums[FEATURES:]) + 1e-3
    unl, n = cells(rows, mean, scale)
    share = n / n.sum()
    ranked = fit(pos, unl, 0.5, steps=800, mean=mean, scale=scale, share=share)
    model = fit(pos, unl, estimate_prior(ranked.score(pos), _counted(rows, ranked), bins=True), mean=mean, scale=scale, share=share)
    return replace(model, least=float(pos[:, COMMON].min()), common=common)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> Model | None:
    """As train_on(), from documents. Null and empty texts are texts without words; rows without an id are never trusted positives."""
    common = commonness(docs, text_col)
    return train_on(materialize(featured(docs, common, id_col, text_col), "features"), labels, common, id_col=id_col, **options)


def scored(rows: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """(id, score, predicted) of rows (as from featured()), each row by itself, so repeats and rows without an id score as any other.

    Texts without words get the score of their marker; without a model all score 1; an empty table gives no rows.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch.column(1))) if model else np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    return rows.select("id", "x").mapInArrow(run, "id long, score double, predicted int")


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted added (columns of those names are replaced).

    Null and empty texts get the score of a text without words; without a model all score 1. Repeated rows score alike.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    return _marked(docs, model, threshold, text_col).select(*(F.col("row")[c].alias(c) for c in names), "score", "predicted")


def _marked(docs: DataFrame, model: Model | None, threshold: float, text_col: str) -> DataFrame:
    """(row, score, predicted), the row as a struct, so that no name of docs can clash."""
    import pyarrow as pa

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(at).to_pylist()
            s = model.score(np.array([features(t, model.common) for t in texts]).reshape(len(texts), FEATURES)) if model else np.ones(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["row", "score", "predicted"])
        trim()

    schema = StructType([*rows.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that the classifier accepts; columns, whatever their names, stay those of docs with their values.

    Null and empty texts are judged as texts without words, repeated rows alike; without positives to learn from all rows
    stay; no rows give none.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    return _marked(docs, model, threshold, text_col).where("predicted = 1").select(*(F.col("row")[c].alias(c) for c in docs.columns))
