"""Language identification by a convolutional network over bytes.

Embedded bytes -> filters of several widths -> ReLU -> max pooling -> softmax, over
windows of a fixed number of bytes; a text's prediction is the mean of its windows'
probabilities, weighted by their bytes. Every byte of every text is read. The network
is trained with numpy on a bounded sample of labelled texts; at prediction time the
embedding and the filters are folded into tables by byte pairs, so that a filter's
answer is one or two table rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops, graph

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 12
UNKNOWN = "und"
#: The sample: about so many texts per language, so many windows of each, and windows in all.
TEXTS_PER_LANGUAGE, WINDOWS_PER_TEXT, MAX_WINDOWS = 400, 4, 20_000


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING; byte 0 pads and answers to no filter
    filters: list[np.ndarray]  # by width: width x EMBEDDING x FILTERS
    bias: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo folds, equals fold; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of all texts (rows of WINDOW bytes, padded with 0), their lengths, and the number of windows before each text."""
    per = -(-np.diff(offsets) // WINDOW)
    before = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
    text = np.repeat(np.arange(len(per)), per)
    start = offsets[:-1][text] + (np.arange(before[-1]) - before[:-1][text]) * WINDOW
    length = np.minimum(offsets[1:][text] - start, WINDOW)
    at = np.arange(WINDOW)
    padded = np.concatenate([bytesops.LOWER[data], np.zeros(WINDOW, np.uint8)])
    cut = padded[start[:, None] + at]
    cut[at >= length[:, None]] = 0
    return cut, length, before


def _responses(model: Model, cut: np.ndarray, k: int) -> np.ndarray:
    width = WIDTHS[k]
    tables = [model.embedding @ model.filters[k][j] for j in range(width)]
    n = WINDOW - width + 1
    out = tables[0][cut[:, :n]]
    for j in range(1, width):
        out += tables[j][cut[:, j : j + n]]
    pad = cut[:, :n] == 0
    for j in range(1, width):
        pad = pad | (cut[:, j : j + n] == 0)
    out[pad] = -1e4
    return out + model.bias[k]


def train(cut: np.ndarray, label: np.ndarray, languages: list[str], epochs: int = 4, rate: float = 4e-3, batch: int = 64, seed: int = 7) -> Model:
    """Adam on the cross entropy; gradients flow through the pooled positions only."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    model = Model(
        languages,
        rng.normal(0, 0.5, (256, EMBEDDING)).astype(f32),
        [rng.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS)).astype(f32) for w in WIDTHS],
        [np.zeros(FILTERS, f32) for _ in WIDTHS],
        rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(f32),
        np.zeros(len(languages), f32),
    )
    params = [model.embedding, *model.filters, *model.bias, model.dense, model.dense_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    share = np.bincount(label, minlength=len(languages))
    weight = (len(label) / len(languages) / np.maximum(share, 1)).astype(f32)
    for _ in range(epochs):
        order = rng.permutation(len(cut))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, y = cut[rows], label[rows]
            pooled, where = [], []
            for k in range(len(WIDTHS)):
                r = _responses(model, x, k)
                p = r.argmax(1)
                where.append(p)
                pooled.append(np.take_along_axis(r, p[:, None], 1)[:, 0])
            raw = np.concatenate(pooled, 1)
            hidden = np.maximum(raw, 0)
            prob = softmax(hidden @ model.dense + model.dense_bias)
            prob[np.arange(len(y)), y] -= 1
            prob *= (weight[y] / len(y))[:, None]
            back = (prob @ model.dense.T) * (raw > 0)
            grads = [np.zeros_like(model.embedding), *[np.zeros_like(w) for w in model.filters], *[np.zeros_like(b) for b in model.bias], hidden.T @ prob, prob.sum(0)]
            for k, width in enumerate(WIDTHS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                grads[1 + len(WIDTHS) + k] = g.sum(0)
                for j in range(width):
                    seen = x[np.arange(len(x))[:, None], where[k] + j]
                    grads[1 + k][j] = np.einsum("nf,nfe->ef", g, model.embedding[seen])
                    np.add.at(grads[0], seen.ravel(), (g[:, :, None] * model.filters[k][j].T[None]).reshape(-1, EMBEDDING))
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, labelled: Column, per_language: int = TEXTS_PER_LANGUAGE) -> Model | None:
    """Train on rows of docs (doc_id, text, lang) for which labelled holds and lang and text are not null.

    The sample is bounded: about per_language texts of each language, those of least
    hash, WINDOWS_PER_TEXT windows of each, evenly spaced over the whole text. None if
    there is no labelled text.
    """
    rows = docs.filter(labelled & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    per_language = max(1, min(per_language, MAX_WINDOWS // WINDOWS_PER_TEXT // len(languages)))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    bar = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 30, int((1 << 30) * per_language / n) + 1))])
    chosen = rows.filter(place < bar[F.col("lang")]).select("lang", "text")

    def cut_up(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bytesops.batches(source):
            lang = b.column("lang").to_pylist()
            for at, end, data, offsets in bytesops.pieces(b.column("text")):
                cut, _, before = windows(data, offsets)
                for i in range(end - at):
                    picks = np.unique(np.linspace(before[i], before[i + 1] - 1, WINDOWS_PER_TEXT).astype(np.int64))
                    yield pa.record_batch([pa.array([lang[at + i]] * len(picks)), pa.array([cut[p].tobytes() for p in picks], pa.binary())], ["lang", "bytes"])

    cuts = chosen.mapInArrow(cut_up, "lang string, bytes binary")
    # hashes let through a few more or less than they should; the bound itself is exact and goes by rank
    got = cuts.withColumn("place", F.xxhash64("bytes", "lang")).orderBy("place", "lang", "bytes").limit(2 * MAX_WINDOWS).drop("place").toArrow()
    cut = np.frombuffer(b"".join(got.column("bytes").to_pylist()), np.uint8).reshape(-1, WINDOW)
    label = np.array([languages.index(x) for x in got.column("lang").to_pylist()], np.int64)
    order = np.lexsort([label, [hash_of(c) for c in cut]])  # the same whatever the order of arrival
    return train(cut[order], label[order], languages)


def hash_of(row: np.ndarray) -> int:
    import zlib

    return zlib.crc32(row.tobytes())


def _scorer(model: Model):
    """A function from windows to probabilities, on tables by byte pair."""
    pair, rest = [], []
    for k, width in enumerate(WIDTHS):
        t = [(model.embedding @ model.filters[k][j]).astype(np.float32) for j in range(width)]
        for x in t:
            x[0] = -1e4
        join = lambda a, b: np.ascontiguousarray((a[:, None] + b[None]).reshape(65536, FILTERS))
        pair.append(join(t[0] + model.bias[k], t[1]))
        rest.append(None if width == 2 else t[2] if width == 3 else join(t[2], t[3]))

    def score(cut: np.ndarray) -> np.ndarray:
        pooled = np.empty((len(cut), FILTERS * len(WIDTHS)), np.float32)
        for at in range(0, len(cut), 64):
            part = cut[at : at + 64]
            two = part[:, :-1].astype(np.intp)
            two *= 256
            two += part[:, 1:]
            for k, width in enumerate(WIDTHS):
                n = WINDOW - width + 1
                r = pair[k].take(two[:, :n], axis=0)
                if width == 3:
                    r += rest[k].take(part[:, 2:], axis=0)
                elif width == 4:
                    r += rest[k].take(two[:, 2 : 2 + n], axis=0)
                pooled[at : at + 64, k * FILTERS : (k + 1) * FILTERS] = r.max(axis=1)
        return softmax(np.maximum(pooled, 0) @ model.dense + model.dense_bias)

    return score


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None, reject_below: float | None = None, labels: bool = True) -> DataFrame:
    """docs with lang_pred and score (columns of these names are replaced), or without them, if labels is false.

    A text that is null or has no letter gets ``und`` and score 0, as does every text
    if the model is None. keep: the columns that are returned with them (all by default).
    reject_below: leave out the rows with ``und`` or a lower score.
    """
    made = {"lang_pred": T.StringType(), "score": T.DoubleType()} if labels else {}
    keep = [c for c in docs.columns if c not in made] if keep is None else keep
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, kind) for c, kind in made.items()])
    text, letters = graph.unused(docs, "text"), graph.unused(docs, "letters")
    source = docs.select(*[F.col(c) for c in keep], F.col("text").alias(text), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(letters))

    def predict(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model) if model else None
        for b in bytesops.batches(source):
            lettered = b.column(letters).to_numpy(zero_copy_only=False)
            for at, end, data, offsets in bytesops.pieces(b.column(text)):
                best, value = np.full(end - at, -1), np.zeros(end - at)
                full = np.flatnonzero(np.diff(offsets) > 0)
                if score and len(full):
                    cut, length, before = windows(data, offsets)
                    prob = np.add.reduceat(score(cut).astype(np.float64) * length[:, None], before[:-1][full], axis=0)
                    prob /= np.diff(offsets)[full][:, None]
                    best[full], value[full] = prob.argmax(1), np.clip(prob.max(1), 0, 1)
                none = ~lettered[at:end]
                best[none], value[none] = -1, 0
                names = pa.array([UNKNOWN if k < 0 else model.languages[k] for k in best], pa.string())
                out = pa.RecordBatch.from_arrays([*[b.column(c).slice(at, end - at) for c in keep], *[names, pa.array(value)][: len(made)]], [*keep, *made])
                yield out if reject_below is None else out.filter(pa.array((best >= 0) & (value >= reject_below)))

    return source.mapInArrow(predict, schema)
