"""Benchmark decontamination over a distributed positional inverted index.

build_index() stores the postings of all training tokens, dealt by documents: a row of the
index is a shard of bounded size, with its terms in order, the end of each term's postings
and the sorted positions. find() takes the benchmark to the shards, in blocks of bounded
size. A window starts from the postings of its term that is rarest in the corpus, and the
offset-adjusted positions are intersected with the sorted lists of the others, from the
rarer to the more frequent. Shards go through Arrow one by one; no Python object is made
for a posting or for a document without a hit.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import col, fresh, handed_on, materialize, scratch, ship

#: A-Z to a-z, and what stands between words to a space.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Tokens that a shard holds before it is closed; a longer document is a shard of its own.
SHARD_TOKENS = 1 << 16
#: Code points of benchmark text that go to the executors at once.
BLOCK_CHARS = 1 << 20
#: Candidates that are looked at together.
STEP = 1 << 17
#: Row groups of the index are small, and so are the batches in which it is read.
SMALL_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "8", "parquet.page.size.row.check.min": "1"}

INDEX = "shard string, terms binary, ends binary, positions binary, docs array<string>, a array<long>, b array<long>, starts binary"
HITS = "shard string, row int, span_start array<int>, span_end array<int>, items array<string>"
FOUND = "shard string, row int, doc string, a long, b long, n_words long, span_start array<int>, span_end array<int>, items array<string>"
LISTS = {"docs": pa.list_(pa.string()), "a": pa.list_(pa.int64()), "b": pa.list_(pa.int64())}
INDEX_ARROW = pa.schema([("shard", pa.string()), *[(x, pa.binary()) for x in ("terms", "ends", "positions")], *LISTS.items(), ("starts", pa.binary())])
#: Terms of a shard are joined by this byte, which no word has.
GAP = b" "


def words(text: str | bytes | None) -> list[bytes]:
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return raw.translate(TO_WORDS).split()


class _Open:
    """A shard that still takes documents."""

    def __init__(self) -> None:
        self.tokens: list[np.ndarray] = []
        self.docs: list = []
        self.a: list = []
        self.b: list = []
        self.size = 0
        self.vocabulary: dict[bytes, int] = defaultdict(count().__next__)

    def add(self, doc: str | None, w: list[bytes], a: int, b: int) -> None:
        self.tokens.append(np.fromiter(map(self.vocabulary.__getitem__, w), np.uint32, len(w)))
        self.docs.append(doc), self.a.append(a), self.b.append(b)
        self.size += len(w)

    def closed(self, name: str) -> pa.RecordBatch:
        terms = list(self.vocabulary)
        order = sorted(range(len(terms)), key=terms.__getitem__)
        rank = np.empty(len(terms), np.uint32)
        rank[order] = np.arange(len(terms), dtype=np.uint32)
        ids = rank[np.concatenate(self.tokens)] if self.size else np.zeros(0, np.uint32)
        small = self.size <= 1 << 16  # then numbers of 16 bits, which numpy sorts by radix
        positions = np.argsort(ids.astype(np.uint16) if small else ids, kind="stable").astype("<u2" if small else "<u4")
        ends = np.cumsum(np.bincount(ids, minlength=len(terms))).astype("<u4")
        starts = np.cumsum([0, *map(len, self.tokens)]).astype("<u4")
        row = [name, GAP.join(terms[i] for i in order), ends.tobytes(), positions.tobytes(), self.docs, self.a, self.b, starts.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, INDEX_ARROW, strict=True)], schema=INDEX_ARROW)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The stored index of docs: a row for each shard, every word of every text in it.

    A document is kept as its id as a string (null: null) with two hashes of its text.
    Null texts have no words. Nothing is shuffled: a shard holds documents of one task.
    An empty table gives an empty index; columns besides the two are not looked at.
    """

    def shards(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task that runs again makes the same names, and only one attempt's files count.
        name, number, now = f"{TaskContext.get().partitionId():08d}", count(), _Open()
        for part in parts:
            for at in range(0, part.num_rows, 256):
                doc, text, a, b = (part.column(i).slice(at, 256) for i in range(4))
                for d, t, x, y in zip(doc.to_pylist(), text.cast(pa.binary()).to_pylist(), a.to_pylist(), b.to_pylist(), strict=True):
                    w = words(t)
                    if now.size and now.size + len(w) > shard_tokens:
                        yield now.closed(f"{name}-{next(number):08d}")
                        now = _Open()
                    now.add(d, w, x, y)
        if now.docs:
            yield now.closed(f"{name}-{next(number):08d}")

    ship(docs.sparkSession)
    t = col(text_col)
    slim = docs.select(col(id_col).cast("string").alias("doc"), t.alias("text"), F.xxhash64(t).alias("a"), F.xxhash64(F.lit(7), t).alias("b"))
    return materialize(slim.mapInArrow(shards, INDEX), "snappy", **SMALL_GROUPS)


class Query:
    """Windows of a block of items, as numbers: `window` consecutive words, or all of a shorter item.

    windows is (n, window) of numbers of terms, -1 beyond a shorter one's length; names has
    the items in order, and owner[first[w]:first[w + 1]] the items of window w.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        terms: dict[bytes, int] = defaultdict(count().__next__)
        self.names = sorted({i for i, _ in items})
        at = {x: i for i, x in enumerate(self.names)}
        rows, owners = [], []
        for item, text in items:
            w = np.fromiter(map(terms.__getitem__, words(text)), np.int32)
            if len(w):
                short = np.full((1, window), -1, np.int32)
                short[0, : min(len(w), window)] = w[:window]
                rows.append(np.lib.stride_tricks.sliding_window_view(w, window).copy() if len(w) >= window else short)
                owners.append(np.full(len(rows[-1]), at[item], np.int32))
        self.terms = dict(terms)
        stacked = np.concatenate(rows) if rows else np.zeros((0, window), np.int32)
        self.windows, of = np.unique(stacked, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([of.reshape(-1), np.concatenate(owners) if owners else np.zeros(0, np.int32)]).astype(np.int64), axis=1)
        self.owner = pairs[1].astype(np.int32)
        self.first = np.searchsorted(pairs[0], np.arange(len(self.windows) + 1))
        self.length = (self.windows >= 0).sum(axis=1)
        self.order = np.zeros_like(self.windows, np.int8)
        self.led: np.ndarray = np.zeros(0, np.int64)
        self.leads: np.ndarray = np.zeros(len(self.terms) + 1, np.int64)

    def ranked(self, counts: np.ndarray) -> Query:
        """Orders the terms of each window from the rarest of these counts on; windows with a term of none are out."""
        freq = np.append(counts, np.iinfo(np.int64).max)[self.windows]  # what is beyond a window's length comes last
        self.order = np.argsort(freq, axis=1, kind="stable").astype(np.int8)
        live = np.flatnonzero(freq.min(axis=1) > 0) if len(freq) else np.zeros(0, np.int64)
        lead = self.windows[live, self.order[live, 0]]
        by = np.argsort(lead, kind="stable")
        self.led = live[by]  # windows by their rarest term
        self.leads = np.searchsorted(lead[by], np.arange(len(self.terms) + 1))
        return self

    def owners_of(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, item) for all items of the windows w."""
        n = self.first[w + 1] - self.first[w]
        which = np.repeat(np.arange(len(w)), n)
        return which, self.owner[self.first[w][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]


class Shard:
    """The postings of a row of the index."""

    def __init__(self, terms: bytes, ends: bytes, positions: bytes, starts: bytes):
        self.terms = terms.split(GAP) if terms else []
        self.ends = np.frombuffer(ends, "<u4").astype(np.int64)
        self.begins = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        self.starts = np.frombuffer(starts, "<u4").astype(np.int64)
        n = int(self.starts[-1])
        self.positions = np.frombuffer(positions, "<u2" if n <= 1 << 16 else "<u4")
        self.n = n

    def numbers(self, query: Query) -> np.ndarray:
        """The shard's number of each term of the query, or -1."""
        here = np.full(len(query.terms) + 1, -1, np.int64)
        if len(query.terms) < len(self.terms):
            at = {w: i for i, w in enumerate(self.terms)}
            here[:-1] = [at.get(w, -1) for w in query.terms]
        else:
            for i, w in enumerate(self.terms):
                if (k := query.terms.get(w)) is not None:
                    here[k] = i
        return here

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1

    def least(self, term: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The first posting of each term at lo or after it, -1 if there is none, by bisection of its list."""
        a, end = self.begins[term].copy(), self.ends[term]
        b = end.copy()
        while (open_ := a < b).any():
            m = (a + b) // 2
            right = open_ & (self.positions[np.minimum(m, len(self.positions) - 1)] < lo)
            a, b = np.where(right, m + 1, a), np.where(open_ & ~right, m, b)
        return np.where(a < end, self.positions[np.minimum(a, len(self.positions) - 1)].astype(np.int64), -1)

    def leading(self, query: Query, here: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, position): the postings of the rarest term of each window, for windows whose rarest term is here; STEP at a time."""
        k = np.flatnonzero((here[:-1] >= 0) & (query.leads[1:] > query.leads[:-1]))
        windows = query.leads[k + 1] - query.leads[k]
        both = (self.ends[here[k]] - self.begins[here[k]]) * windows
        ends = np.cumsum(both)
        for i in range(0, int(ends[-1]) if len(ends) else 0, STEP):
            at = np.arange(i, min(i + STEP, int(ends[-1])))
            which = np.searchsorted(ends, at, side="right")
            posting, window = np.divmod(at - (ends - both)[which], windows[which])
            yield query.led[query.leads[k][which] + window], self.positions[self.begins[here[k]][which] + posting].astype(np.int64)

    def phrases(self, query: Query) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every occurrence of a window within one document."""
        here, found = self.numbers(query), []
        for w, pos in self.leading(query, here):
            start = pos - query.order[w, 0]
            end = start + query.length[w]
            ok = (start >= 0) & (end <= self.n)
            ok[ok] = self.doc_of(start[ok]) == self.doc_of(end[ok] - 1)
            w, start = w[ok], start[ok]
            for step in range(1, query.windows.shape[1]):
                off = query.order[w, step].astype(np.int64)
                ok = self._kept(here, query.windows[w, off], lambda t, m, start=start, off=off: self.least(t, start[m] + off[m]) == start[m] + off[m])
                w, start = w[ok], start[ok]
            found.append((w, start))
        return _joined(found)

    def near(self, query: Query, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its rarest term) where each of its terms stands within `slack` words, in one document."""
        here, found = self.numbers(query), []

        def close(t: np.ndarray, at: np.ndarray) -> np.ndarray:
            doc = self.doc_of(at)
            first = self.least(t, np.maximum(at - slack, self.starts[doc]))
            return (first >= 0) & (first <= np.minimum(at + slack, self.starts[doc + 1] - 1))

        for w, pos in self.leading(query, here):
            for step in range(1, query.windows.shape[1]):
                term = query.windows[w, query.order[w, step].astype(np.int64)]
                ok = self._kept(here, term, lambda t, m, pos=pos: close(t, pos[m]))
                w, pos = w[ok], pos[ok]
            found.append((w, pos))
        return _joined(found)

    @staticmethod
    def _kept(here: np.ndarray, term: np.ndarray, test) -> np.ndarray:
        """Where a window has no term (-1), or the term is here and test(its numbers, their places) holds."""
        ok = term < 0
        m = np.flatnonzero(~ok)
        t = here[term[m]]
        m, t = m[t >= 0], t[t >= 0]
        ok[m] = test(t, m)
        return ok

    def hits(self, query: Query, slack: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, from, to) of the stretches hit, and (document, item) of what hits."""
        w, start = self.phrases(query) if slack is None else self.near(query, slack)
        order = np.argsort(start, kind="stable")
        w, start = w[order], start[order]
        doc = self.doc_of(start)
        end = np.maximum.accumulate(start + (query.length[w] if slack is None else 1)) if len(w) else start
        head = np.ones(len(w), bool)  # stretches that meet or overlap are one, within a document
        head[1:] = (start[1:] > end[:-1]) | (doc[1:] != doc[:-1])
        tail = np.append(head[1:], True)[: len(w)]
        d = doc[head]
        which, item = query.owners_of(w)
        pairs = np.unique(np.stack([doc[which], item]), axis=1)
        return d, start[head] - self.starts[d], end[tail] - self.starts[d], pairs[0], pairs[1]


def _joined(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = zip(*found, strict=True) if found else ([np.zeros(0, np.int64)],) * 2
    return np.concatenate(a), np.concatenate(b)


def _blocks(items: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, str | None]]]:
    block, size = [], 0
    for r in items.select(col(item_col).cast("string").alias("i"), col(text_col).alias("t")).where("i is not null").toLocalIterator():
        more = len(r["t"] or "")
        if block and size + more > limit:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += more
    yield block


def corpus_counts(index: DataFrame, query: Query) -> np.ndarray:
    """How many postings each term of the query has in the whole index; only the terms and their ends are read."""
    sent = index.sparkSession.sparkContext.broadcast(query.terms)

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value
        total = np.zeros(len(terms), np.int64)
        for part in parts:
            for blob, ends in zip(part.column(0), part.column(1), strict=True):
                n = np.diff(np.frombuffer(ends.as_py(), "<u4").astype(np.int64), prepend=0)
                for w, x in zip(blob.as_py().split(GAP) if len(n) else [], n.tolist(), strict=True):
                    if (k := terms.get(w)) is not None:
                        total[k] += x
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(total[k], pa.int64())], names=["term", "n"])

    counts = np.zeros(len(query.terms), np.int64)
    for r in index.select("terms", "ends").mapInArrow(of, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term of the block
        counts[r["term"]] = r["n"]
    sent.destroy()
    return counts


def _lists(values: pa.Array, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), values)


def _scan(index: DataFrame, query: Query, slack: int | None, every: bool):
    """(FOUND of every document or HITS of those with hits, the broadcast that it reads)."""
    sent = index.sparkSession.sparkContext.broadcast(query)

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = sent.value
        names = pa.array(query.names, pa.string())
        for part in parts:
            for i in range(part.num_rows):
                row = {c: part.column(c)[i] for c in part.schema.names}
                shard = Shard(*(row[c].as_py() for c in ("terms", "ends", "positions", "starts")))
                doc, lo, hi, named, item = shard.hits(query, slack)
                n_docs = len(shard.starts) - 1
                at = np.arange(n_docs) if every else np.unique(doc)
                per = lambda d: np.bincount(d, minlength=n_docs)[at]
                out = [pa.array([row["shard"].as_py()] * len(at), pa.string()), pa.array(at, pa.int32())]
                if every:
                    out += [row["docs"].values, row["a"].values, row["b"].values, pa.array(np.diff(shard.starts), pa.int64())]
                out += [_lists(pa.array(lo, pa.int32()), per(doc)), _lists(pa.array(hi, pa.int32()), per(doc)), _lists(names.take(pa.array(item, pa.int64())), per(named))]
                yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in (FOUND if every else HITS).split(", ")])

    return index.mapInArrow(of, FOUND if every else HITS), sent


def _joined_spans(spans: Column) -> Column:
    """Sorted stretches with those that meet or overlap as one."""
    start = F.struct(F.array().cast("array<struct<span_start:int,span_end:int>>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        done, last = acc["done"], F.element_at(acc["done"], -1)
        apart = (F.size(done) == 0) | (x["span_start"] > last["span_end"])
        longer = F.array(F.struct(last["span_start"].alias("span_start"), F.greatest(last["span_end"], x["span_end"]).alias("span_end")))
        return F.struct(F.when(apart, F.concat(done, F.array(x))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), longer)).alias("done"))

    return F.aggregate(spans, start, step)["done"]


def find(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = 13, block_chars: int = BLOCK_CHARS, slack: int | None = None) -> DataFrame:
    """A row for each indexed document: doc, a, b, n_words, spans of words hit, items.

    Exact phrases: spans are the maximal stretches [span_start, span_end) of words in an
    occurrence of a window. With slack: proximity, spans hold the rarest term of a window all
    of whose terms stand within slack words. items are ids as strings, sorted. Items
    without words or id match nothing; repeated ids are one item of all their windows. No
    items: no hits; an empty index: no rows.

    One block of items is one pass over the index. Of several blocks each pass writes its
    hits and frees its broadcast; the documents are joined with the hits in the end.
    """
    ship(items.sparkSession)
    blocks = _blocks(items, item_col, text_col, block_chars)
    block, following = next(blocks), next(blocks, None)
    query = Query(block, window)
    query.ranked(corpus_counts(index, query))
    if following is None:
        return _scan(index, query, slack, True)[0]
    parts = []
    while True:
        df, sent = _scan(index, query, slack, False)
        parts.append(materialize(df))
        sent.destroy()
        if following is None:
            break
        query, following = Query(following, window), next(blocks, None)
        query.ranked(corpus_counts(index, query))
    hits = parts[0]
    for more in parts[1:]:
        hits = hits.unionByName(more)
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("span_start", "span_end"))))
    hits = hits.groupBy("shard", "row").agg(_joined_spans(spans).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = hits.select(F.col("shard").alias("s"), F.col("row").alias("r"), "spans", "items")
    nothing = _scan(index, Query([], window), slack, True)[0].select("shard", "row", "doc", "a", "b", "n_words")
    none = F.array().cast("array<int>")
    return nothing.join(hits, (F.col("shard") == F.col("s")) & (F.col("row") == F.col("r")), "left").select(
        "shard", "row", "doc", "a", "b", "n_words", F.coalesce("spans.span_start", none).alias("span_start"), F.coalesce("spans.span_end", none).alias("span_end"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def n_hit() -> Column:
    return F.aggregate(F.zip_with("span_start", "span_end", lambda x, y: (y - x).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def is_contaminated() -> Column:
    """Over the columns n_words and n_hit: a twentieth of the words or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13) -> DataFrame:
    """A row for each row of docs: id_col, n_words, n_hit, items, contaminated, a, b (hashes of the text), spans.

    Null and empty texts have no words and are clean. Repeated rows and ids, null ids
    included, are told each. Very long texts are shards of their own. An empty table gives
    an empty table, and without items all are clean. Other columns, whatever their names,
    are not looked at.
    """
    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    found = find(build_index(docs, id_col, text_col), items, item_col, item_text_col, window)
    found = found.withColumn("n_hit", n_hit()).withColumn("contaminated", is_contaminated())
    return found.select(F.col("doc").cast(kind).alias(id_col), "n_words", "n_hit", "items", "contaminated", "a", "b", "span_start", "span_end")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", **more) -> DataFrame:
    """docs without the contaminated ones; whether one is depends on its text alone.

    Null and empty texts stay, repeated rows stay or go together, and so do rows of one text
    under several ids. All columns are kept, with whatever names. An empty table gives an
    empty table. The index goes once the verdicts are written.
    """
    a, b, bad_a, bad_b = fresh(docs, "_a", "_b", "_bad_a", "_bad_b")
    with scratch(docs.sparkSession) as made:
        bad = contamination(docs, items, id_col, text_col, **more).where("contaminated").select(F.col("a").alias(bad_a), F.col("b").alias(bad_b)).distinct()
        bad = materialize(bad)
        verdicts = made.pop()
    handed_on([verdicts])
    hashed = docs.withColumns({a: F.xxhash64(col(text_col)), b: F.xxhash64(F.lit(7), col(text_col))})
    return hashed.join(bad, (F.col(a) == F.col(bad_a)) & (F.col(b) == F.col(bad_b)), "left_anti").drop(a, b)
