"""Mixture-controlled packing: deficit round-robin over source queues.

Texts are tokenised once and their ids stored in the shared folder. The tokens of a
source, in the order of the stored table, are its queue. Time goes in windows; in each,
a queue is credited its share of the window's tokens, takes the whole tokens of its
credit, and carries the rest, its deficit, to the next window. The share of a queue that
has run dry goes to the others in proportion. What a queue is credited after k windows has
a closed form, so the deficit is known for every k without looking at the windows before:
each partition starts anywhere with the deficits carried so far. The windows, end to end,
are one stream that is cut into sequences, so that only the last sequence can be short.

The stored ids are never shuffled. A task looks up where the queues of its own chunks
stand in a small table beside them, so nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import col, materialize, open_fs, shared_dir, ship

#: Id that ends a document.
END = 0
#: Fixed value: the pre-tokens of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of text remembered with their ids, a worker.
REMEMBERED = 1_000_000
#: Chunks whose queues' places are stored together.
TOGETHER = 64
#: Numbers of a schedule that a task keeps at most.
KEPT = 1 << 22


class Encoder:
    """Ids of whole texts as bytes of little-endian unsigned 16- or 32-bit numbers.

    A space before anything but white space starts a new pre-token of a byte-level BPE,
    so the stretches between such spaces are encoded once and remembered. A text in which
    a space stands before white space or at the end is encoded as a whole.

    New stretches are merged by tiktoken with the ranks that are in the tokenizer's file,
    where that is a plain byte-level BPE whose ids follow its merges; else, and wherever
    an added token may stand, by the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = self.dtype.char
        self.known: dict[str, bytes] = {"": b""}
        self.end = np.array([END], self.dtype).tobytes()
        with open(path, encoding="utf-8") as f:
            ranks, self.added = _ranks(json.load(f))
        self.merge = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary if ranks else None

    def plain(self, text: str) -> bytes:
        if self.merge is None or any(x in text for x in self.added):
            return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array(self.code, self.merge(text)).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if "\0" in text:
            return self.plain(text) + self.end
        parts, known = text.replace(" ", "\0 ").split("\0"), self.known
        out = list(map(known.get, parts))
        at = -1
        try:
            while True:
                at = out.index(None, at + 1)
                p = parts[at]
                if at and (len(p) == 1 or p[1].isspace()):
                    return self.plain(text) + self.end
                found = known.get(p)  # it may have been new a little before
                if found is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                        known[""] = b""
                    found = known[p] = self.plain(p)
                out[at] = found
        except ValueError:  # no None is left
            return b"".join(out) + self.end


def _ranks(spec: dict) -> tuple[dict[bytes, int] | None, list[str]]:
    """(rank of each token's bytes, added tokens) of a tokenizer's file; None if ranks can't stand for its merges."""
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    added = [x["content"] for x in spec.get("added_tokens", [])]
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
        return None, added
    # The visible characters that stand for the bytes: printable ones for themselves, others from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if t not in added}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"].get(a + b, -1) for a, b in merges]
    ordered = all(x < y for x, y in zip(ids, ids[1:], strict=False)) and min(ids, default=0) >= 0
    return (ranks if ordered and len(ranks) == len(merges) + 256 else None), added


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's own encoder, whose cache outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _queues(docs: DataFrame, source_col: str, targets: dict | None) -> dict:
    """Number of the queue of each source: of every source, or of those in targets; others share queue 0."""
    if targets is not None:
        return {s: i + 1 for i, s in enumerate(targets)}
    every = docs.groupBy(col(source_col).cast("string").alias("s")).count().orderBy(F.desc("count"), "s").collect()
    return {r["s"]: i + 1 for i, r in enumerate(every)}


def tokenize(docs: DataFrame, tokenizer: str, queues: dict, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc, chunk, queue, start, n, ids): a document's ids with END after them.

    A chunk is a partition of the scan; start counts the tokens before the document in
    its queue within the chunk. Each worker reads one tokenizer and keeps a bounded cache.
    """

    def encoded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, chunk = encoder_of(tokenizer), TaskContext.get().partitionId()
        so_far: dict[int, int] = {}
        for pdf in parts:
            ids = [encoder.encode(x) for x in pdf["text"]]
            queue = [queues.get(s, 0) for s in pdf["source"]]
            n = [len(x) // encoder.dtype.itemsize for x in ids]
            start = []
            for q, k in zip(queue, n, strict=True):
                start.append(so_far.get(q, 0))
                so_far[q] = start[-1] + k
            yield pd.DataFrame({"doc": pdf["doc"], "chunk": chunk, "queue": queue, "start": start, "n": n, "ids": ids, "width": encoder.dtype.itemsize})

    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    source = col(source_col).cast("string") if source_col in docs.columns else F.lit(None).cast("string")
    slim = docs.select(col(id_col).cast("string").alias("doc"), col(text_col).alias("text"), source.alias("source"))
    out = slim.mapInPandas(encoded, "doc string, chunk int, queue int, start long, n long, ids binary, width int")
    return out.withColumn("doc", F.col("doc").cast(kind))


class Schedule:
    """Deficit round-robin in closed form: what each queue has taken after k windows.

    totals: tokens of each queue. weights: wanted share of each, in any unit; None: that of
    its tokens, so that all queues end together. At time t a queue has taken min(n, w t)
    tokens, so that shares of dry queues go to the others in proportion; time is where the
    sum of these is k windows. Queues without a weight come last, in proportion to their
    tokens. Everything is kept in a few numbers for each queue.
    """

    def __init__(self, totals: list[int], window: int, weights: list[float] | None = None):
        self.window, self.n = window, np.array(totals, np.int64)
        w = np.maximum(self.n if weights is None else np.array(weights, np.float64), 0).astype(np.float64)
        self.rate = np.where(self.n > 0, w, 0.0)
        self.late = (self.rate == 0) & (self.n > 0)
        first = np.flatnonzero(self.rate > 0)
        dry = self.n[first] / self.rate[first]
        order = np.argsort(dry, kind="stable")
        # Between the times at which two queues run dry, the sum is gone + t * speed.
        self.edges = dry[order]
        self.gone = np.concatenate([[0], np.cumsum(self.n[first][order])])
        self.speed = np.append(np.cumsum(self.rate[first][order][::-1])[::-1], 0.0)
        self.taken = np.maximum.accumulate(self.gone[1:] + self.edges * self.speed[1:]) if len(first) else np.zeros(0)
        self.early, self.total = int(self.gone[-1]), int(self.n.sum())
        self.windows = -(-self.total // window)
        self.kept: dict[int, np.ndarray] = {}

    def credit(self, queue: int | slice, k: np.ndarray | int) -> np.ndarray:
        """Tokens that a queue, or each queue, has taken after k windows: its credit without the deficit."""
        all_taken = np.minimum(np.asarray(k, np.int64) * self.window, self.total)
        c = np.minimum(all_taken, self.early).astype(np.float64)
        n, rate, late = self.n[queue], self.rate[queue], self.late[queue]
        if len(self.edges):
            i = np.minimum(np.searchsorted(self.taken, c), len(self.edges) - 1)
            t = np.clip((c - self.gone[i]) / self.speed[i], np.where(i > 0, self.edges[i - 1], 0.0), self.edges[i])
        else:
            t = np.zeros_like(c)
        early = np.where(all_taken >= self.early, n, np.minimum(n, np.floor(rate * t).astype(np.int64)))
        share = np.maximum(all_taken - self.early, 0) / max(1, self.total - self.early)
        return np.where(late, np.where(all_taken >= self.total, n, np.minimum(n, np.floor(n * share).astype(np.int64))), early)

    def window_of(self, queue: int, x: np.ndarray) -> np.ndarray:
        """The window in which a queue gives its token x: the last k with credit(k) <= x, by bisection."""
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), self.windows, np.int64)
        while len(x) and (hi - lo > 1).any():
            m = (lo + hi) // 2
            below = self.credit(queue, m) <= x
            lo, hi = np.where(below, m, lo), np.where(below, hi, m)
        return lo

    def within(self, k: int) -> np.ndarray:
        """For each queue what its tokens of window k stand behind their own number in the stream.

        Of the windows asked for last, as many as fit in KEPT numbers are kept.
        """
        if k not in self.kept:
            before, after = self.credit(slice(None), k), self.credit(slice(None), k + 1)
            take = after - before
            while self.kept and (len(self.kept) + 1) * len(take) > KEPT:
                self.kept.pop(next(iter(self.kept)))
            self.kept[k] = before.sum() + np.cumsum(take) - take - before
        return self.kept[k]

    def place(self, queue: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, lo, hi, stream offset) of the segments of [lo, hi) in a queue, cut at the windows."""
        at = np.flatnonzero(lo < hi)
        a, b = lo[at], hi[at]
        first, last = self.window_of(queue, a), self.window_of(queue, b - 1)
        # A queue that gets under a token a window: look at its tokens, else at the windows.
        many = np.minimum(last - first, b - a - 1)
        r = np.repeat(np.arange(len(at)), many)
        j = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many) + 1
        by_token = (last - first > b - a - 1)[r]
        cut = np.where(by_token, a[r] + j, self.credit(queue, np.minimum(first[r] + j, self.windows)))
        inside = (cut > a[r]) & (cut < b[r])
        m = np.flatnonzero(by_token & inside)
        inside[m] = self.window_of(queue, cut[m]) != self.window_of(queue, cut[m] - 1)
        starts = np.concatenate([a, cut[inside]])
        owner = np.concatenate([np.arange(len(at)), r[inside]])
        order = np.lexsort((starts, owner))
        starts, owner = starts[order], owner[order]
        new = np.ones(len(starts), bool)
        new[1:] = (starts[1:] != starts[:-1]) | (owner[1:] != owner[:-1])
        starts, owner = starts[new], owner[new]
        ends = b[owner]
        ends[:-1] = np.where(owner[1:] == owner[:-1], starts[1:], ends[:-1])
        ks, back = np.unique(self.window_of(queue, starts), return_inverse=True)
        into = np.array([self.within(x)[queue] for x in ks.tolist()], np.int64)
        return at[owner], starts, ends, into[back] + starts


def _bases(folder: str, chunk: int) -> dict[int, int]:
    """Tokens before a chunk in each of its queues, from the table beside the ids."""
    import pyarrow.dataset as ds

    fs, top = open_fs(folder)
    found = ds.dataset(f"{top}/together={chunk // TOGETHER}", filesystem=fs, format="parquet").to_table(columns=["queue", "base"], filter=ds.field("chunk") == chunk)
    return dict(zip(found["queue"].to_pylist(), found["base"].to_pylist(), strict=True))


PIECES = "doc string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, window long, ids binary"


def pack(docs: DataFrame, tokenizer: str, sequence: int = 1024, window: int = 64, targets: dict | float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document in a sequence of `sequence` tokens.

    Columns: id_col, start, length, ids_crc32 (of the little-endian 32-bit ids),
    doc_tokens, sequence_id, offset, source, window, and with_ids the ids as binary of such
    numbers. window counts sequences. targets maps sources to wanted shares, or is a power
    that the sources' tokens are raised to for theirs (1 or None: the corpus' own shares, 0:
    equal ones). All documents are packed whatever the targets: a source that runs dry
    leaves its share to the others, sources outside targets come last, their source told as
    null. Sequences are gapless and full but for the last.

    Null and empty texts are the id END alone. Every source has a queue, and so have
    all null ones; where there is no source column, all rows share one. Repeated rows and ids,
    null ids included, are packed each; a queue's ties are in the order of the table. Texts
    of any length are cut at the ends of sequences. An empty table gives an empty table; other
    columns, whatever their names, are not looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    has_source = source_col in docs.columns
    queues = _queues(docs, source_col, targets if isinstance(targets, dict) else None) if has_source else {}
    stored = materialize(tokenize(docs, tokenizer, queues, id_col, text_col, source_col))

    sums = stored.groupBy("chunk", "queue").agg(F.sum("n").alias("tokens"))
    totals = [0] * (len(queues) + 1)
    for r in sums.groupBy("queue").agg(F.sum("tokens").alias("t")).collect():  # a row for each source
        totals[r["queue"]] = r["t"]
    if isinstance(targets, dict):
        weights = [0.0, *map(float, targets.values())]
    else:
        weights = None if targets is None else [float(t) ** targets if t else 0.0 for t in totals]
    plan, names = Schedule(totals, window * sequence, weights), [None, *queues]
    before = Window.partitionBy("queue").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("chunk", "queue", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"), F.expr(f"chunk DIV {TOGETHER}").alias("together"))
    folder = shared_dir(spark)
    bases.repartition("together").write.partitionBy("together").parquet(folder)
    kind = stored.schema["doc"].dataType.simpleString()

    def pieces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, base = -1, {}
        for pdf in parts:
            for (chunk, queue), g in pdf.groupby(["chunk", "queue"]):
                if chunk != now:
                    now, base = chunk, _bases(folder, int(chunk))
                lo = base[int(queue)] + g["start"].to_numpy(np.int64)
                n = g["n"].to_numpy(np.int64)
                row, a, b, off = plan.place(int(queue), lo, lo + n)
                # Cut the segments at the ends of the sequences.
                first, last = off // sequence, (off + b - a - 1) // sequence
                many = last - first + 1
                seg = np.repeat(np.arange(len(row)), many)
                seq = first[seg] + np.arange(len(seg)) - np.repeat(np.cumsum(many) - many, many)
                x = np.maximum(off[seg], seq * sequence)
                y = np.minimum((off + b - a)[seg], (seq + 1) * sequence)
                r = row[seg]
                start = a[seg] + (x - off[seg]) - lo[r]
                # Neighbours in document and sequence become one piece.
                order = np.lexsort((start, r))
                r, seq, x, y, start = r[order], seq[order], x[order], y[order], start[order]
                head = np.concatenate([[True], (r[1:] != r[:-1]) | (x[1:] != y[:-1]) | (seq[1:] != seq[:-1])])
                tail = np.concatenate([head[1:], [True]])
                r, seq, x, start, y = r[head], seq[head], x[head], start[head], y[tail]
                blobs, widths, docs_ = g["ids"].tolist(), g["width"].tolist(), g["doc"].to_numpy(object)
                made, crc, at = [], [], -1
                for i, s, k in zip(r.tolist(), start.tolist(), (y - x).tolist(), strict=True):
                    if i != at:
                        at, buf = i, np.frombuffer(blobs[i], f"<u{widths[i]}").astype("<u4")
                    piece = buf[s : s + k]
                    crc.append(zlib.crc32(piece))
                    made.append(piece.tobytes() if with_ids else None)
                yield pd.DataFrame({"doc": docs_[r], "start": start, "length": y - x, "ids_crc32": crc, "doc_tokens": n[r], "sequence_id": seq, "offset": x - seq * sequence, "source": names[int(queue)], "window": seq // window, "ids": made})

    out = stored.select(F.col("doc").cast("string").alias("doc"), "chunk", "queue", "start", "n", "ids", "width").mapInPandas(pieces, PIECES)
    return out.select(F.col("doc").cast(kind).alias(id_col), *["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "window"], *["ids"] * with_ids)


def window_shares(pieces: DataFrame) -> DataFrame:
    """(window, source, tokens, share): what each source has in each window of pack()."""
    per = pieces.groupBy("window", "source").agg(F.sum("length").alias("tokens"))
    return per.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy("window")))
