"""Language identification: a byte convolutional network in numpy over fixed-length windows of text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainscope.llm.batches import slices_by_bytes

WINDOW = 512              # bytes
WIDTHS = (2, 3, 4)        # bytes per filter
FILTERS = 12              # per width
DOCS_PER_LANGUAGE = 1500  # documents of the training sample, at most about so many per language
WINDOWS_PER_DOC = 3
EPOCHS = 6
UNDETERMINED = "und"
BATCH = 128
LEAST_LEAD = 0.25         # of the way from an even guess to certainty, that a document's score reaches
LEAST_SURE = 0.9          # a model turns texts away if it gives as much to the languages of its own sample
LEAST_BYTES = 64          # shorter texts say too little to be turned away


@dataclass
class ByteConvNet:
    """Filters are tables (width, byte, filter): the convolution of one-hot bytes is a sum of looked-up rows."""

    classes: list[str]
    tables: list[np.ndarray]
    dense: np.ndarray
    bias: np.ndarray
    sure: float = 0.0     # median probability that the windows of the training sample give to their own language

    @classmethod
    def fresh(cls, classes: list[str], seed: int = 0) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        return cls(classes, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
                   rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32),
                   np.zeros(len(classes), np.float32))

    def pairs(self) -> list[list[np.ndarray]]:
        """Tables over two bytes at once: fewer look-ups at prediction time."""
        out = []
        for t in self.tables:
            steps = [(t[i][:, None, :] + t[i + 1][None, :, :]).reshape(65536, -1) for i in range(0, len(t) - 1, 2)]
            out.append(steps + ([t[-1]] if len(t) % 2 else []))
        return out

    def pooled(self, x: np.ndarray, pairs: list[list[np.ndarray]] | None = None, where: bool = False):
        """Largest response of each filter over each window, and where it is."""
        tops, places = [], []
        two = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        for w, (t, table) in enumerate(zip(self.tables, pairs or [None] * len(self.tables))):
            n = x.shape[1] - len(t) + 1
            if table is None:
                out = t[0][x[:, :n]]
                for j in range(1, len(t)):
                    out += t[j][x[:, j:j + n]]
            else:
                out = table[0][two[:, :n]]
                for j in range(1, len(table)):
                    out += table[j][two[:, 2 * j:2 * j + n] if len(table[j]) > 256 else x[:, 2 * j:2 * j + n]]
            if where:
                at = out.argmax(axis=1)
                places.append(at)
                tops.append(np.take_along_axis(out, at[:, None, :], 1)[:, 0])
            else:
                tops.append(out.max(axis=1))
        return np.maximum(np.concatenate(tops, axis=1), 0), places

    def log_softmax(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.dense + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 0) -> None:
        """Adam on the cross entropy; each filter learns from the place of its largest response."""
        rng = np.random.default_rng(seed)
        parts = [*self.tables, self.dense, self.bias]
        m, v, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), BATCH):
                rows = order[a:a + BATCH]
                xb, yb = x[rows], y[rows]
                features, places = self.pooled(xb, where=True)
                g = np.exp(self.log_softmax(features))
                g[np.arange(len(rows)), yb] -= 1
                g /= len(rows)
                back = (g @ self.dense.T) * (features > 0)
                grads = []
                for w, (t, at) in enumerate(zip(self.tables, places)):
                    own = back[:, w * FILTERS:(w + 1) * FILTERS]
                    grad = np.zeros_like(t)
                    for j in range(len(t)):
                        hit = xb[np.arange(len(rows))[:, None], at + j]
                        np.add.at(grad[j], (hit, np.arange(FILTERS)[None, :]), own)
                    grads.append(grad)
                grads += [features.T @ g, g.sum(axis=0)]
                step += 1
                for p, d, mi, vi in zip(parts, grads, m, v):
                    mi += 0.1 * (d - mi)
                    vi += 0.001 * (d * d - vi)
                    p -= rate * (mi / (1 - 0.9 ** step)) / (np.sqrt(vi / (1 - 0.999 ** step)) + 1e-8)

    def predict(self, texts: list[bytes], pairs: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Class and probability of each text: windows vote with their log probabilities, weighted by their bytes."""
        counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
        x = np.zeros((int(counts.sum()), WINDOW), np.uint8)
        weight = np.zeros(len(x), np.float32)
        ends = np.cumsum(counts)
        flat = x.reshape(-1)
        for t, a, n in zip(texts, (ends - counts).tolist(), counts.tolist()):
            flat[a * WINDOW:a * WINDOW + len(t)] = np.frombuffer(t, np.uint8)
            weight[a:a + n] = WINDOW
            weight[a + n - 1] = len(t) - (n - 1) * WINDOW
        logs = np.concatenate([self.log_softmax(self.pooled(x[a:a + BATCH], pairs)[0])
                               for a in range(0, len(x), BATCH)])
        total = np.add.reduceat(logs * weight[:, None], ends - counts, axis=0)
        mean = total / np.maximum(np.add.reduceat(weight, ends - counts), 1)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best].astype(np.float64)


def held_out(id_col: str, folds: int = 5) -> Column:
    """Rows kept from training: the remainder of crc32 of the id as text is 0. A NULL id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                         per_language: int = DOCS_PER_LANGUAGE) -> ByteConvNet | None:
    """Fit on about ``per_language`` labelled documents of each language that are not held out, chosen by a hash
    of the id; up to three windows, spread over the text, of each reach the driver. None without any such row."""
    labelled = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & has_letter(F.col(text_col)))
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    if not sizes:
        return None
    classes = sorted(sizes)
    chance = F.create_map(*[x for c in classes for x in (F.lit(c), F.lit(min(1.0, per_language / sizes[c])))])
    draw = F.pmod(F.xxhash64(F.lit("language"), id_col, text_col), F.lit(1 << 20)) / (1 << 20)
    length = F.length(text_col)
    part = labelled.where(draw < chance[F.col(lang_col)]).select(lang_col, F.explode(F.transform(
        F.sequence(F.lit(0), F.least(F.lit(WINDOWS_PER_DOC), F.ceil(length / WINDOW)).cast("int") - 1),
        lambda i: F.substring(text_col, (i * F.floor(length / WINDOWS_PER_DOC)).cast("int") + 1, WINDOW))).alias("w"),
        F.xxhash64(id_col).alias("h")).orderBy("h", "w", lang_col).drop("h")
    rows = part.collect()
    x = np.zeros((len(rows), WINDOW), np.uint8)
    for i, r in enumerate(rows):
        raw = r[1].encode()[:WINDOW]
        x[i, :len(raw)] = np.frombuffer(raw, np.uint8)
    net = ByteConvNet.fresh(classes)
    y = np.array([classes.index(r[0]) for r in rows], int)
    net.train(x, y)
    if len(x):
        net.sure = float(np.exp(np.median(np.concatenate([net.log_softmax(net.pooled(x[a:a + BATCH])[0])[
            np.arange(len(x[a:a + BATCH])), y[a:a + BATCH]] for a in range(0, len(x), BATCH)]))))
    return net


def identify(docs: DataFrame, model: ByteConvNet | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, judged from the whole text alone.

    A text that is NULL or has no letter is ``und`` with score 0, and so is every text without a model. Columns of
    these names are replaced; all rows stay. One pass without an exchange, a few megabytes of text at a time.
    """
    base = docs.drop("lang_pred", "score")
    names = base.columns
    mark = "_letter"
    while mark in names:
        mark += "_"
    source = base.withColumn(mark, has_letter(F.col(text_col)))
    at, letter = names.index(text_col), len(names)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields]
                       + ["lang_pred string", "score double"])
    if model is None:
        return base.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        pairs = net.pairs()
        for batch in batches:
            for a, b in slices_by_bytes(batch.column(at)):
                part = batch.slice(a, b - a)
                ok = np.flatnonzero(part.column(letter).to_numpy(zero_copy_only=False))
                lang, score = np.full(len(part), UNDETERMINED, object), np.zeros(len(part))
                if len(ok):
                    raw = part.column(at).cast(pa.binary()).take(pa.array(ok)).to_pylist()
                    best, p = net.predict(raw, pairs)
                    lang[ok], score[ok] = np.array(net.classes, object)[best], p
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:letter], pa.array(lang, pa.string()), pa.array(score)],
                    [*names, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def in_a_language(docs: DataFrame, model: ByteConvNet | None, text_col: str = "text") -> DataFrame:
    """What ``identify`` gives, without texts in no language: no letter, or ``LEAST_BYTES`` or more of which the model
    is unsure.

    Unsure is a score below 1 / k + ``LEAST_LEAD`` * (1 - 1 / k) for k languages (0.4375 for four): letters in no order,
    and most texts in scripts the model never saw. The model knows its own languages only, so texts that resemble one
    of them pass; one language alone is always certain. Every text with a letter stays without a model, and with one that
    learned too little to judge (``sure`` below ``LEAST_SURE``, as from 200 documents).
    """
    found = identify(docs, model, text_col)
    if model is None or model.sure < LEAST_SURE:
        return found.where(has_letter(F.col(text_col)))
    even = 1 / len(model.classes)
    return found.where((F.col("lang_pred") != UNDETERMINED) & (
        (F.col("score") >= even + LEAST_LEAD * (1 - even)) | (F.octet_length(text_col) < LEAST_BYTES)))
