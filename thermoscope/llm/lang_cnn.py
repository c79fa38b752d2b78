"""Language identification with a small byte convolutional network.

The network reads fixed-length byte windows: filters of several widths slide
over one-hot byte classes, each filter's maximum over the window feeds a softmax
layer.  It is trained in numpy on a bounded sample of labelled texts
(``SAMPLE_DOCS`` documents of each language, ``SAMPLE_WINDOWS`` evenly spaced
windows of each) and applied in batches to all windows of every whole text.  A
document's probabilities are the mean over its windows, weighted by letters.

Edge cases: a text that is null or has no letter is ``und`` with score 0; rows
without a label or an id are never learned from, and their ``held_out`` is
false without an id; an empty table gives an empty result, a table without
labels predicts ``und`` everywhere; repeated rows are predicted alike; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, take_ragged

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16           # of each width
SAMPLE_DOCS = 400      # of each language
SAMPLE_WINDOWS = 4
MAX_LANGUAGES = 200
EPOCHS = 8
SLICE_BYTES = 1 << 20    # text bytes cut into windows together
UNDETERMINED = "und"


def _byte_classes() -> np.ndarray:
    """Class of each byte: a space, digits, other ASCII, a-z without case, and every byte from 0x80 on its own."""
    table = np.full(256, 2, np.int64)
    table[[9, 10, 11, 12, 13, 32]] = 0
    table[48:58] = 1
    table[65:91] = table[97:123] = np.arange(3, 29)
    table[128:] = np.arange(29, 157)
    return table


CLASSES = _byte_classes()
N_CLASSES = int(CLASSES.max()) + 1
LETTER = ((CLASSES >= 3) & (CLASSES < 29)) | (np.arange(256) >= 0xC0)


class ByteConvNet:
    """Multi-width byte filters, max pooling, softmax; trained with Adam."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.conv = [rng.normal(0, 0.3, (w, N_CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.02,
            seed: int = 11) -> None:
        """``x``: class codes of windows (n, WINDOW); ``y``: label numbers."""
        rng = np.random.default_rng(seed)
        params = [*self.conv, self.bias, self.out, self.out_bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(order), batch):
                rows = order[lo:lo + batch]
                grads = self._gradients(x[rows], y[rows])
                step += 1
                for p, g, a, b in zip(params, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= (rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-6)).astype(p.dtype)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, pooled, at = len(x), [], []
        for w, k in zip(WIDTHS, self.conv):
            z = sum(k[j][x[:, j:WINDOW - w + 1 + j]] for j in range(w))
            best = z.argmax(1)
            at.append(best)
            pooled.append(np.take_along_axis(z, best[:, None, :], 1)[:, 0])
        raw = np.concatenate(pooled, 1) + self.bias
        hidden = np.maximum(raw, 0)
        p = _softmax(hidden @ self.out + self.out_bias)
        p[np.arange(n), y] -= 1
        p /= n
        g_hidden = (p @ self.out.T) * (raw > 0)
        grads = []
        for i, (w, k) in enumerate(zip(WIDTHS, self.conv)):
            g = np.zeros_like(k)
            part = g_hidden[:, i * FILTERS:(i + 1) * FILTERS]
            f = np.broadcast_to(np.arange(FILTERS), part.shape)
            for j in range(w):
                np.add.at(g[j], (np.take_along_axis(x, at[i] + j, 1), f), part)
            grads.append(g)
        return [*grads, g_hidden.sum(0), hidden.T @ p, p.sum(0)]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Filter sums by pair of neighbouring classes, so a position costs one row read.

        Columns: width 2, first two of width 3, first two of width 4, last two of width 4;
        and the last step of width 3 by single class.
        """
        two, three, four = self.conv
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS)
        return (np.ascontiguousarray(np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]),
                                                     pair(four[0], four[1]), pair(four[2], four[3])], 1)),
                np.ascontiguousarray(three[2]))

    def predict(self, x: np.ndarray, tables=None, chunk: int = 192) -> np.ndarray:
        """Label probabilities of windows of class codes."""
        pairs, last = tables or self.tables()
        out = np.empty((len(x), len(self.labels)), np.float32)
        f = FILTERS
        for lo in range(0, len(x), chunk):
            c = x[lo:lo + chunk]
            rows = pairs[c[:, :-1] * N_CLASSES + c[:, 1:]]
            z2 = rows[:, :, :f].max(1)
            z3 = (rows[:, :-1, f:2 * f] + last[c[:, 2:]]).max(1)
            z4 = (rows[:, :-2, 2 * f:3 * f] + rows[:, 2:, 3 * f:]).max(1)
            hidden = np.maximum(np.concatenate((z2, z3, z4), 1) + self.bias, 0)
            out[lo:lo + chunk] = _softmax(hidden @ self.out + self.out_bias)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def cut_windows(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte windows of every text (the last one filled with spaces) and their number per text."""
    counts = -(-lens // WINDOW)
    flat = np.full(int(counts.sum()) * WINDOW, 32, np.uint8)
    first = (np.cumsum(counts) - counts) * WINDOW
    ends = np.cumsum(lens)
    flat[np.repeat(first - (ends - lens), lens) + np.arange(int(lens.sum()))] = take_ragged(data, starts, lens)
    return flat.reshape(-1, WINDOW), counts


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteConvNet | None:
    """Fit on a bounded sample: the ``SAMPLE_DOCS`` documents of each language with the smallest id hash.

    Only ids and labels are ranked; the sampled ids then fetch their texts.  The ``MAX_LANGUAGES`` labels
    with the most documents (then by name) are learned; rarer ones are never predicted.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    labelled = known.where(F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"))
    usual = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    known = known.where(F.col(lang_col).isin([r["lang"] for r in usual]))
    ids = (known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"),
                        F.xxhash64(id_col).alias("h"))
           .withColumn("r", rank).where(F.col("r") <= SAMPLE_DOCS).select("id").distinct())
    text = F.col("text")
    step = F.greatest(F.length(text) / SAMPLE_WINDOWS, F.lit(1.0))
    pieces = F.array(*[text.substr((step * k + 1).cast("int"), F.lit(WINDOW)) for k in range(SAMPLE_WINDOWS)])
    rows = (known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
            .where(text.rlike(r"\p{L}")).join(F.broadcast(ids), "id").orderBy("lang", "id")
            .select("lang", F.array_distinct(pieces).alias("pieces")).collect())
    labels = sorted({r["lang"] for r in rows})
    if not labels:
        return None
    number = {x: i for i, x in enumerate(labels)}
    texts, y = [], []
    for r in rows:
        for piece in r["pieces"]:
            b = piece.encode()[:WINDOW]
            if LETTER[np.frombuffer(b, np.uint8)].any():
                texts.append(b)
                y.append(number[r["lang"]])
    x = np.frombuffer(b"".join(b.ljust(WINDOW) for b in texts), np.uint8).reshape(-1, WINDOW)
    net = ByteConvNet(labels)
    net.fit(CLASSES[x], np.array(y))
    return net


def predict(docs: DataFrame, net: ByteConvNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` of every row; a map over Arrow batches without a shuffle."""
    return _apply(docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text")), net) \
        .withColumnRenamed("row", id_col)


def keep_determined(docs: DataFrame, net: ByteConvNet | None, text_col: str = "text") -> DataFrame:
    """Rows whose language the network can tell (all but ``und``), with all their columns; with no network, rows with a letter."""
    if net is None:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    rows = _apply(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                              F.col(text_col).alias("text")), net)
    return rows.where(F.col("lang_pred") != UNDETERMINED).select("row.*")


def _apply(rows: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """``row, lang_pred, score`` of (row, text)."""
    key_type = rows.schema["row"].dataType.simpleString()
    net_b = rows.sparkSession.sparkContext.broadcast(net)  # a few hundred KB whatever the corpus

    def run(batches):
        model = net_b.value
        tables = model.tables() if model else None
        for batch in batches:
            text = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            has_letter = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
            n = len(text)
            lang, score = np.full(n, UNDETERMINED, object), np.zeros(n)
            rows = np.flatnonzero(has_letter) if model else np.empty(0, np.int64)
            offsets = np.frombuffer(text.buffers()[1], np.int64, n + 1, text.offset * 8) if n else np.zeros(1, np.int64)
            data = np.frombuffer(text.buffers()[2], np.uint8) if n and text.buffers()[2] else np.empty(0, np.uint8)
            starts, lens = offsets[:-1], np.diff(offsets)
            at = 0
            while at < len(rows):
                size = np.cumsum(lens[rows[at:]])
                part = rows[at:at + max(1, int(np.searchsorted(size, SLICE_BYTES)))]
                at += len(part)
                x, counts = cut_windows(data, starts[part], lens[part])
                p = model.predict(CLASSES[x], tables)
                weight = LETTER[x].sum(1).astype(np.float64)
                first = np.cumsum(counts) - counts
                total = np.add.reduceat(weight, first)
                none = total == 0  # letters cut from their lead bytes, or outside the table: count windows alike
                weight[np.repeat(none, counts)] = 1
                total[none] = counts[none]
                mean = np.add.reduceat(p * weight[:, None], first, axis=0) / total[:, None]
                best = mean.argmax(1)
                lang[part] = np.array(model.labels, object)[best]
                score[part] = np.clip(mean[np.arange(len(part)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)],
                                             ["row", "lang_pred", "score"])
            give_back()

    return rows.select("row", "text").mapInArrow(run, f"row {key_type}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves 1 modulo 3: never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on rows that are not held out, predict all rows."""
    net = train(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    return predict(docs, net, id_col, text_col).withColumn("held_out", held_out(id_col))
