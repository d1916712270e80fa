"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each
filter's maximum over the window is kept, and a softmax over languages follows. A text is
covered by windows from end to end (overlapping by the widest filter less one byte); its
probabilities are its windows' mean, weighted by their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_slices

WINDOW = 256
EMBED = 8
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bounds of the training sample: different texts of a language, windows of a text.
TRAIN_DOCS, TRAIN_WINDOWS = 400, 2
UND = "und"


def has_letter(text: str) -> bool:
    """Whether some code point is of a letter category (Lu, Ll, Lt, Lm, Lo)."""
    return any(map(str.isalpha, text))


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover a whole text, A-Z lower-cased, (n, WINDOW) bytes padded with 0, and their byte counts."""
    data = np.frombuffer(text.encode().lower(), dtype=np.uint8)
    step = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    pad = np.zeros((n - 1) * step + WINDOW, dtype=np.uint8)
    pad[: len(data)] = data
    out = np.lib.stride_tricks.sliding_window_view(pad, WINDOW)[::step]
    return out, np.minimum(WINDOW, len(data) - np.arange(n) * step)


@dataclass
class ByteNet:
    """Weights of the network; a picklable value of a few dozen kilobytes."""

    langs: list[str]
    embed: np.ndarray = field(default_factory=lambda: np.zeros((256, EMBED), np.float32))
    filters: np.ndarray = field(default_factory=lambda: np.zeros((max(WIDTHS) * EMBED, FILTERS * len(WIDTHS)), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS * len(WIDTHS), np.float32))
    out: np.ndarray | None = None
    out_bias: np.ndarray | None = None

    @staticmethod
    def mask() -> np.ndarray:
        """1 where a filter of its width has weights."""
        rows = np.arange(max(WIDTHS) * EMBED)[:, None] // EMBED
        return (rows < np.repeat(WIDTHS, FILTERS)[None, :]).astype(np.float32)

    def columns(self, x: np.ndarray) -> np.ndarray:
        """Embedded stretches of the widest filter at every byte, (windows * WINDOW, widest * EMBED)."""
        n, width = len(x), max(WIDTHS)
        e = np.zeros((n, WINDOW + width - 1, EMBED), dtype=np.float32)
        e[:, :WINDOW] = self.embed[x]
        s = e.strides
        view = np.lib.stride_tricks.as_strided(e, (n, WINDOW, width * EMBED), (s[0], s[1], s[2]))
        return np.ascontiguousarray(view).reshape(n * WINDOW, width * EMBED)

    def pooled(self, x: np.ndarray, where: bool = False):
        h = (self.columns(x) @ self.filters).reshape(len(x), WINDOW, -1)
        top = np.maximum(h.max(axis=1) + self.bias, 0)
        return (top, h.argmax(axis=1)) if where else top

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax over languages for windows, in batches of bounded memory."""
        parts = []
        for i in range(0, len(x), 64):
            z = self.pooled(x[i : i + 64]) @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            parts.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)), np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, probability) of each text."""
        keep = [i for i, t in enumerate(texts) if t and self.langs and has_letter(t)]
        out = [(UND, 0.0)] * len(texts)
        if not keep:
            return out
        pairs = [windows_of(texts[i]) for i in keep]
        p = self.probabilities(np.concatenate([w for w, _ in pairs]))
        weights = np.concatenate([b for _, b in pairs]).astype(np.float64)
        first = np.cumsum([0, *(len(w) for w, _ in pairs[:-1])])
        mean = np.add.reduceat(p * weights[:, None], first, axis=0) / np.add.reduceat(weights, first)[:, None]
        for i, row in zip(keep, mean, strict=True):
            best = int(row.argmax())
            out[i] = (self.langs[best], min(1.0, float(row[best])))
        return out


    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean cross-entropy; it flows through each filter's maximum only."""
        k = max(WIDTHS) * EMBED
        top, at = self.pooled(x, where=True)
        z = top @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(len(y)), y] -= 1
        z /= len(y)
        grad = {"out": top.T @ z, "out_bias": z.sum(axis=0)}
        d = (z @ self.out.T) * (top > 0)
        grad["bias"] = d.sum(axis=0)
        places = at[:, :, None] + np.arange(max(WIDTHS))
        codes = np.pad(x, ((0, 0), (0, max(WIDTHS) - 1)))[np.arange(len(x))[:, None, None], places]
        patch = self.embed[codes].reshape(*at.shape, k)
        patch = patch * (places < WINDOW).repeat(EMBED, axis=2)
        grad["filters"] = np.einsum("nfk,nf->kf", patch, d) * ByteNet.mask()
        back = (d[:, :, None] * self.filters.T[None]).reshape(*at.shape, max(WIDTHS), EMBED)
        grad["embed"] = np.zeros_like(self.embed)
        np.add.at(grad["embed"], codes.reshape(-1), back.reshape(-1, EMBED))
        grad["embed"][0] = 0
        return grad


def train(x: np.ndarray, y: np.ndarray, langs: list[str], steps: int = 600, seed: int = 7, rate: float = 4e-3) -> ByteNet:
    """Fit by Adam on the cross-entropy, in about ``steps`` steps over whole passes."""
    rng = np.random.default_rng(seed)
    net = ByteNet(langs)
    k = max(WIDTHS) * EMBED
    net.embed = rng.normal(0, 0.5, net.embed.shape).astype(np.float32)
    net.embed[0] = 0
    net.filters = (rng.normal(0, 1 / np.sqrt(k), net.filters.shape) * ByteNet.mask()).astype(np.float32)
    net.out = rng.normal(0, 0.1, (net.filters.shape[1], len(langs))).astype(np.float32)
    net.out_bias = np.zeros(len(langs), np.float32)
    names = ("embed", "filters", "bias", "out", "out_bias")
    moment = {n: (np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))) for n in names}
    step = 0
    for _ in range(max(1, round(steps * 32 / max(1, len(x))))):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), 32):
            pick = order[lo : lo + 32]
            grad = net.gradient(x[pick], y[pick])
            step += 1
            for n in names:
                m, v = moment[n]
                m += 0.1 * (grad[n] - m)
                v += 0.01 * (grad[n] ** 2 - v)
                getattr(net, n)[...] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def sample(labelled: DataFrame, text: str, lang: str) -> list[tuple[str, int, bytes]]:
    """Training windows (language, order, bytes): a bounded sample, spread over the whole table.

    Every language takes part. Of its different texts, about twice ``TRAIN_DOCS`` pass a hash
    threshold set from their estimated number, and the ``TRAIN_DOCS`` of least hash stay;
    copies of a text count once. Nothing but the bounded sample leaves the executors.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counts = [(r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()]
    if not counts:
        return []
    span = 1 << 31
    most = F.create_map(*[x for name, n in sorted(counts) for x in (F.lit(name), F.lit(min(span, int(span * 2 * TRAIN_DOCS / max(1, n)))))])
    place = F.pmod(F.xxhash64("text"), F.lit(span))
    picked = rows.withColumn("place", place).where(F.col("place") < F.try_element_at(most, F.col("lang"))).groupBy("lang", "place").agg(F.min("text").alias("text"))
    picked = picked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).where(F.col("rank") <= TRAIN_DOCS)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for name, t, place in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            w, size = windows_of(t)
            w = w[size >= min(24, size.max())]
            rng = np.random.default_rng(place)
            out += [(name, place, w[i].tobytes()) for i in rng.permutation(len(w))[:TRAIN_WINDOWS]]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["lang", "place", "bytes"])

    found = map_slices(picked.select("lang", "text", "place"), "text", step, "lang string, place long, bytes binary").collect()
    return sorted((name, place, bytes(data)) for name, place, data in found)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> ByteNet:
    """Train on a bounded sample of labelled rows; with none, everything is predicted ``und``."""
    found = sample(labelled, text, lang)
    langs = sorted({name for name, _, _ in found})
    if not langs:
        return ByteNet([])
    x = np.frombuffer(b"".join(d for _, _, d in found), dtype=np.uint8).reshape(-1, WINDOW)
    return train(x, np.array([langs.index(name) for name, _, _ in found]), langs)


def predict(df: DataFrame, net: ByteNet, text: str = "text", keep: bool = False) -> DataFrame:
    """``df`` with lang_pred and score of each whole text, less ``text`` unless ``keep``; null or letterless: ``und``, 0.

    Of equally likely languages the first by name is taken. Rows are judged one by one, so repeated rows are no
    matter; an empty table gives no rows. ``df`` shouldn't have columns lang_pred or score of its own.
    """
    names = [c for c in df.columns if c != text]
    out = [*names, text] if keep else names

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = net.predict(batch.column(len(names)).to_pylist())
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(out))), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=[*out, "lang_pred", "score"])

    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in out), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_slices(df.select(*names, text), text, step, schema, most=1 << 20)


def fold(key: str, parts: int) -> F.Column:
    """crc32 of a key's decimal text modulo ``parts``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts
