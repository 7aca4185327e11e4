"""Quality classifier: a byte-level convolutional network in numpy.

Filters run over the bytes of overlapping chunks that cover the whole text. Max-pooled
over a chunk, squashed, averaged over the chunks and combined by a linear layer, they
give one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import col, fresh, materialize, ship

CHUNK, OVERLAP, WIDTH, FILTERS = 512, 64, 6, 8
#: Bytes at which the next stratum of texts begins; each stratum of a class gives as much to the sample.
STRATA = (64, 256, 1024)
#: Chunks scored at a time.
BATCH = 256


def chunks(text: str | None) -> np.ndarray:
    """(chunks, CHUNK) bytes of a whole text; overlapping, the last one padded with zeros."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-max(0, len(b) - OVERLAP) // step))
    full = np.zeros((n - 1) * step + CHUNK, np.uint8)
    full[: len(b)] = b
    return np.lib.stride_tricks.sliding_window_view(full, CHUNK)[::step]


@dataclass
class Network:
    """tables: (WIDTH, 256, FILTERS), a filter's weight for each byte at each place."""

    tables: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: float

    @classmethod
    def new(cls, seed: int = 0) -> Network:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), r.normal(0, 0.5, FILTERS).astype(np.float32), 0.0)

    def pooled(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chunks, FILTERS): the largest response of each filter, and where it is."""
        n = c.shape[1] - WIDTH + 1
        z = self.tables[0][c[:, :n]]
        for k in range(1, WIDTH):
            z += self.tables[k][c[:, k : k + n]]
        at = z.argmax(axis=1)
        return np.take_along_axis(z, at[:, None], axis=1)[:, 0] + self.bias, at

    def pairs(self) -> list[np.ndarray]:
        """The tables of two places at once, by the number of two bytes: half the look-ups."""
        return [(self.tables[k][None, :, :] + self.tables[k + 1][:, None, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]

    def score(self, text: str | None, pairs: list[np.ndarray] | None = None) -> float:
        """The probability of label 1, over all chunks of the text."""
        pairs = pairs or self.pairs()
        c, total = chunks(text), np.zeros(FILTERS)
        for i in range(0, len(c), BATCH):
            part = c[i : i + BATCH]
            two = part[:, :-1].astype(np.uint16) | part[:, 1:].astype(np.uint16) << 8
            n = CHUNK - WIDTH + 1
            z = np.take(pairs[0], two[:, :n], axis=0)
            for k in range(1, WIDTH // 2):
                z += np.take(pairs[k], two[:, 2 * k : 2 * k + n], axis=0)
            total += np.tanh(z.max(axis=1) + self.bias).sum(axis=0)
        return float(1 / (1 + np.exp(-np.clip(total / len(c) @ self.out + self.offset, -30, 30))))

    def train(self, texts: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.02, seed: int = 0) -> None:
        """Adam on the log loss, classes weighted alike; the gradient goes through the largest responses."""
        r = np.random.default_rng(seed)
        weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y <= 0).mean(), 1e-9))
        params = [self.tables, self.bias, self.out, np.array([self.offset], np.float32)]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            step = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-4
            order = r.permutation(len(y))
            for i in range(0, len(y), batch):
                at = order[i : i + batch]
                c = np.concatenate([texts[j] for j in at])
                doc = np.repeat(np.arange(len(at)), [len(texts[j]) for j in at])
                size = np.bincount(doc, minlength=len(at))[:, None].astype(np.float32)
                parts = [self.pooled(c[k : k + BATCH]) for k in range(0, len(c), BATCH)]
                z, where = (np.concatenate(x) for x in zip(*parts, strict=True))
                h = np.tanh(z)
                mean = np.zeros((len(at), FILTERS), np.float32)
                np.add.at(mean, doc, h)
                mean /= size
                p = 1 / (1 + np.exp(-np.clip(mean @ self.out + params[3][0], -30, 30)))
                d = ((p - y[at]) * weight[at] / len(at)).astype(np.float32)
                dz = (d[:, None] * self.out / size)[doc] * (1 - h * h)
                g = np.zeros_like(self.tables)
                f = np.broadcast_to(np.arange(FILTERS), where.shape)
                rows = np.broadcast_to(np.arange(len(c))[:, None], where.shape)
                for k in range(WIDTH):
                    np.add.at(g[k], (c[rows, where + k], f), dz)
                t += 1
                for q, x, mm, vv in zip(params, [g + 1e-5 * self.tables, dz.sum(axis=0), d @ mean + 1e-4 * self.out, np.array([d.sum()], np.float32)], m, v, strict=True):
                    mm += 0.1 * (x - mm)
                    vv += 0.001 * (x * x - vv)
                    q -= (step * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        self.offset = float(params[3][0])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 600, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", epochs: int = 30) -> Network:
    """Learns from about per_class labelled documents of each class (the bound on the sample), by all chunks of their texts.

    A class's rows come in equal parts from texts of each of the STRATA of length, as far as
    there are so many, for short texts differ from long ones. The sample is drawn by a hash of
    the id; lengths of all texts are looked at, and the texts of the sample alone. Rows with a null label or id are not learned from; documents with labels of both kinds
    count once with each; null and empty texts are one chunk of zero bytes. Without rows of
    both classes, as in empty tables, the score is one half for any text.
    """
    ship(docs.sparkSession)
    known = labels.where(col(label_col).isNotNull() & col(id_col).isNotNull()).select(col(id_col).alias("id"), (col(label_col) > 0).cast("int").alias("y")).distinct()
    size, stratum = F.coalesce(F.octet_length(col(text_col)), F.lit(0)), F.lit(0)
    for k in STRATA:
        stratum = stratum + (size >= k).cast("int")
    # Ids and strata only; the labels are the side without texts.
    found = materialize(docs.select(col(id_col).alias("id"), stratum.alias("stratum")).join(known, "id"))
    counts = {(r["y"], r["stratum"]): r["n"] for r in found.groupBy("y", "stratum").agg(F.count("*").alias("n")).collect()}
    net = Network.new()
    if len({y for y, _ in counts}) < 2:
        net.out[:] = 0
        return net
    share = F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(1 << 20))
    want = F.lit(False)
    for y in (0, 1):
        left = per_class
        mine = sorted(((n, k) for (c, k), n in counts.items() if c == y))
        for i, (n, k) in enumerate(mine):  # what a small stratum lacks the larger ones give
            take = -(-left // (len(mine) - i))
            want = want | ((F.col("y") == y) & (F.col("stratum") == k) & (share < min(1 << 20, -(-take * (1 << 20) // n))))
            left -= min(take, n)
    chosen = found.where(want).select("id", "y").distinct().limit(4 * per_class + 64)
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(chosen), "id").limit(8 * per_class + 64)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"id": pdf["id"].astype(str), "y": pdf["y"], "c": [np.ascontiguousarray(chunks(x)).tobytes() for x in pdf["text"]]})

    got = sorted(rows.mapInPandas(cut, "id string, y int, c binary").collect(), key=lambda r: (r["id"], r["y"], bytes(r["c"])))
    y = np.array([r["y"] for r in got], np.float32)
    if len(set(y.tolist())) < 2:
        net.out[:] = 0
        return net
    texts = [np.frombuffer(r["c"], np.uint8).reshape(-1, CHUNK) for r in got]
    net.train(texts, y, epochs)
    return net


def scored(c: Column, net: Network, spark) -> Column:
    sent = spark.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pairs = sent.value.pairs()
        for s in parts:
            yield pd.Series([sent.value.score(x, pairs) for x in s], dtype="float64")

    return of(c)


def with_quality(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """docs with score and predicted (1 if score >= 0.5, else 0), replacing columns of these names.

    Null and empty texts are one chunk of zero bytes. Texts of any length are scored by all
    their chunks; repeated rows are scored each and alike, and a score of exactly one half is
    predicted as 1. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    own = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    (s,) = fresh(docs, "_s")
    out = docs.select(*[col(c) for c in own], scored(col(text_col), net, docs.sparkSession).alias(s))
    return out.select(*[col(c) for c in own], F.col(s).alias("score"), (F.col(s) >= 0.5).cast("int").alias("predicted"))
