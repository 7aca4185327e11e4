"""SimHash near-dedup: fingerprints, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ._common import col, fresh, materialize, ship
from .components import connected_components

#: Shingles hashed at a time.
BLOCK = 1 << 15


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The signed 64-bit fingerprint of a whole text; null or no words: zero.

    Words are what stands between \\x20 and \\x09-\\x0D, with A-Z lower-cased; shingles
    of `words` words with repeats, space-joined (fewer words: the whole sequence). A bit
    is 1 if it is set in over half the XXH64 hashes of the shingles.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both on ASCII only
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        part = w[i : i + BLOCK + words - 1]
        shingles = zip(*(part[k:] for k in range(words)), strict=False) if len(w) >= words else [w]
        h = np.fromiter(map(xxh64_intdigest, map(b" ".join, shingles), repeat(seed)), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(c: Column, words: int = 3, seed: int = 42) -> Column:
    @F.pandas_udf("long")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([fingerprint(x, words, seed) for x in s], dtype="int64")

    return of(c)


def _masks(blocks: int, max_bits: int) -> list[int]:
    """All choices of blocks - max_bits of equal blocks of 64 bits, as signed masks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    found = [sum(x) for x in combinations(one, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _near(max_bits: int) -> list[tuple[int, int]]:
    """(kept, flipped) masks: two numbers at most max_bits apart have (x & kept) ^ flipped in common for one of these, and any two that do are.

    Of an even number of bits, half are flipped in either; of an odd one, one is blanked first.
    """
    bits, found = [1 << i for i in range(64)], []
    for blank in bits if max_bits % 2 else [0]:
        rest = [b for b in bits if b != blank]
        found += [(~blank, sum(x)) for k in range(max_bits // 2 + 1) for x in combinations(rest, k)]
    return [(k, f - (1 << 64) if f >> 63 else f) for k, f in ((k + (1 << 64) if k < -(1 << 63) else k, f) for k, f in found)]


def close_pairs(prints: DataFrame, max_bits: int = 2, blocks: int | None = None, largest: int = 32) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column fp) at most max_bits apart, which connect all that are.

    Whatever max_bits differ leave blocks - max_bits of the blocks (None: max_bits + 2 of
    them) equal, so every close pair shares the key of one choice of blocks. Keys of at most
    `largest` fingerprints are self-joined and the Hamming distance verified. Fingerprints
    under a larger key are linked without pairs: each stands under all numbers of _near()
    (65 for two bits, 4096 for three, 2081 for four); those that share one are at most
    max_bits apart and any two at most max_bits apart share one, so a star in each gives
    the same components. No fingerprints: no pairs.
    """
    blocks = max_bits + 2 if blocks is None else blocks
    if not 0 < max_bits < blocks <= 64:
        raise ValueError("max_bits is positive and less than the number of blocks, which is 64 at most")
    masks = _masks(blocks, max_bits)
    keyed = F.array(*[F.struct(F.lit(i).cast("short").alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
    rows = prints.select("fp", F.explode(keyed).alias("x")).select("fp", "x.c", "x.k")
    sizes = rows.groupBy("c", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("c").alias("sc"), F.col("k").alias("sk"), "n")
    # On k alone with c as a residual: a hot key can then be split.
    shared = materialize(rows.join(sizes, (F.col("k") == F.col("sk")) & (F.col("c").bitwiseXOR(F.col("sc")) == 0)).select("c", "k", "fp", "n"))

    small = shared.where(F.col("n") <= largest)
    a, b = small.select("c", "k", F.col("fp").alias("a")), small.select("c", "k", F.col("fp").alias("b"))
    pairs = a.join(b, ["c", "k"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b").distinct()

    large = shared.where(F.col("n") > largest).select("fp").distinct()
    # One number of _near() for each of `ways`, made in rows rather than in an expression of thousands.
    kept, flipped = zip(*_near(max_bits), strict=True)
    if max_bits % 2 == 0:
        at = F.explode(F.transform(F.lit(list(flipped)), lambda m: F.col("fp").bitwiseXOR(m))).alias("at")
        stands = large.select("fp", F.lit(0).cast("long").alias("way"), at)
    else:
        ways = F.arrays_zip(F.lit(list(kept)).alias("kept"), F.lit(list(flipped)).alias("flipped"))
        stands = large.select("fp", F.explode(ways).alias("m")).select("fp", F.col("m.kept").alias("way"), F.col("fp").bitwiseAND(F.col("m.kept")).bitwiseXOR(F.col("m.flipped")).alias("at"))
    stars = stands.groupBy("way", "at").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # as many at most as _near() has numbers
    links = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a != b").distinct()
    return pairs.unionByName(links)


def components_of(slim: DataFrame, max_bits: int = 2, blocks: int | None = None) -> DataFrame:
    """(cfp, root, component_id) for every fingerprint of slim(id, fp)."""
    prints = materialize(slim.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(close_pairs(prints.select("fp"), max_bits, blocks))
    rooted = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id")).select(F.bitwise_not("root").alias("k"), "component_id")
    return rooted.join(least, F.bitwise_not("root") == F.col("k")).select(F.col("fp").alias("cfp"), "root", "component_id")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2, blocks: int | None = None) -> DataFrame:
    """(id_col, fingerprint long, component_id), a row for each row of docs.

    component_id is the smallest id reachable over fingerprints that differ in at most
    max_bits bits. Texts without words, null ones included, have fingerprint zero and are
    linked like any other. Repeated rows share fingerprint and component. A null id is
    ignored for component_id, which is null only if all ids of a component are. Exact
    copies are folded by fingerprint before anything is joined. Texts of any length are read
    as a whole. An empty table gives an empty table; other columns are not looked at.
    """
    ship(docs.sparkSession)
    slim = materialize(docs.select(col(id_col).alias("id"), fingerprints(col(text_col), words).alias("fp")))
    found = slim.join(components_of(slim, max_bits, blocks), F.col("fp") == F.col("cfp"))
    return found.select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2, blocks: int | None = None) -> DataFrame:
    """docs, with one row of each component: that with the smallest id (null last).

    Of several rows with that id, repeated rows included, one stays, by the hash of its
    text and then its place in the written table. docs is written once to the shared
    folder, where a row's file and index name it. Texts of any length are read as a whole; all
    columns are kept, whatever their names; an empty table gives an empty table.
    """
    ship(docs.sparkSession)
    hidden = [c for c in docs.columns if c.lower() == "_metadata"]  # the name of what files tell of their rows
    if hidden:
        (other,) = fresh(docs, "_metadata_")
        return one_of_each(docs.withColumnRenamed(hidden[0], other), id_col, text_col, words, max_bits, blocks).withColumnRenamed(other, hidden[0])
    fp, file, at, its_file, its_at = fresh(docs, "_fp", "_file", "_at", "_its_file", "_its_at")
    rows = materialize(docs.withColumn(fp, fingerprints(col(text_col), words)))
    rows = rows.select(*[col(c) for c in rows.columns], F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(at))
    slim = materialize(rows.select(col(id_col).alias("id"), F.col(fp).alias("fp"), F.xxhash64(col(text_col)).alias("h"), F.col(file).alias("file"), F.col(at).alias("at")))
    # The best row of each fingerprint first, so that copies fold before the join.
    best = slim.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "file", "at")).alias("best"))
    rooted = best.join(components_of(slim.select("id", "fp"), max_bits, blocks), F.col("fp") == F.col("cfp"))
    wanted = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.file").alias(its_file), F.col("best.at").alias(its_at))
    return rows.join(wanted, (F.col(file) == F.col(its_file)) & (F.col(at) == F.col(its_at)), "left_semi").select(*[col(c) for c in docs.columns])
