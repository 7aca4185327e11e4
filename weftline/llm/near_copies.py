"""Near copies by Jaccard similarity of word shingles: SimHash proposes, whole texts decide.

Fingerprints of 512 bits over the set of shingles are cut to blocks. Texts with the same
choice of blocks, and of further bits if there are many texts, are proposed, checked by the Hamming distance of the fingerprints and then
by their whole shingles. 64 bits and a radius of two, as in simhash, see only the closest
texts. No choice of blocks shows every pair for certain, so MinHash bands propose after
that, for texts that are still apart. No group of a key but the smallest is compared pair
by pair: larger
ones are cut by size, for near copies have similar ones, and their members are compared with
one of them, the lead. Only those that this leaves apart are looked at again. Who has too
many shingles that no other one has is near to none; for the rest it is known how many of
their differences to a third text two of them need in common to be near copies of each
other, and only those that can have so many are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ._common import col, fresh, materialize, ship
from .components import connected_components
from .simhash import close_pairs, fingerprint

#: A pair of similarity s shares a band with 1 - (1 - s^4)^25: all but two in a million at 0.8.
BANDS, ROWS = 25, 4
#: Shingles hashed at a time.
BLOCK = 1 << 12
#: Members of a group that are compared with each other pair by pair, at most.
SMALL = 32
_RNG = np.random.default_rng(42)
_FLIP = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)

#: Words of 64 bits of a fingerprint, cut to blocks of a byte.
WIDE = 8
#: Orders of the blocks; each gives as many keys of KEPT blocks as it has room for.
ORDERS, KEPT = 4, 3
#: Bits in which fingerprints of near copies differ at most: at 0.8 it is 76 of 512 on average, 96 for the smallest sets; of others 256.
RADIUS = 160
_WIDE_FLIP = _RNG.integers(0, 1 << 64, WIDE, np.uint64)
_WIDE_TIMES = _RNG.integers(0, 1 << 64, WIDE, np.uint64) | np.uint64(1)
_CHOICES = np.concatenate([_RNG.permutation(8 * WIDE)[: 8 * WIDE // KEPT * KEPT].reshape(-1, KEPT) for _ in range(ORDERS)])
#: Keys by SimHash, which come before those by MinHash.
CHOICES = len(_CHOICES)
#: Others, by choice and text, that may share a key of blocks by chance; keys get as many more bits as that takes.
CHANCE = 0.25
#: Where the further bits of each choice's keys are: a word of the fingerprint without its blocks, and the order of the bits.
_FURTHER = [(int(_RNG.choice(np.setdiff1d(np.arange(WIDE), c // 8))), _RNG.permutation(64)) for c in _CHOICES]


def shingles(text: str | None, words: int = 5) -> set[bytes]:
    """The set of shingles of a whole text, words as in simhash.fingerprint; fewer words: all as one."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both on ASCII only
    if len(w) < words:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)))


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """The SimHash fingerprint of hashes of shingles, as bytes: a bit is 1 if it is set in over half of them."""
    counts = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(h), BLOCK):
        x = (h[i : i + BLOCK, None] ^ _WIDE_FLIP) * _WIDE_TIMES
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)  # so that low bits depend on all bits
        x ^= x >> np.uint64(29)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(h), bitorder="little")


def signature(text: str | None, words: int = 5) -> tuple[int, int, list[int], list[int]]:
    """(digest of the set of shingles, its size, keys, fingerprint); without words: zeros, and no keys.

    A key for each choice of blocks of the fingerprint (its number and the blocks), then one
    for each MinHash band.
    """
    found = shingles(text, words)
    if not found:
        return 0, 0, [], [0] * WIDE
    h = np.sort(np.fromiter(map(xxh64_intdigest, found, repeat(42)), np.uint64, len(found)))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), BLOCK):
        x = (h[i : i + BLOCK, None] ^ _FLIP) * _TIMES
        x ^= x >> np.uint64(31)
        np.minimum(least, x.min(axis=0), out=least)
    wide = wide_fingerprint(h)
    blocks = np.arange(CHOICES, dtype=np.int64)
    for b in range(KEPT):
        blocks = blocks << 8 | wide[_CHOICES[:, b]]
    bands = least.reshape(BANDS, ROWS)
    digests = [xxh64_intdigest(h.tobytes()), *[xxh64_intdigest(bands[b].tobytes(), b) for b in range(BANDS)]]
    same, *keys = np.array(digests, np.uint64).view(np.int64).tolist()
    return same, len(h), blocks.tolist() + keys, wide.view(np.int64).tolist()


def signatures(c: Column, words: int = 5) -> Column:
    """What signature() gives, and the fingerprint of simhash: in one function, as each holds a worker of its own."""

    @F.pandas_udf("same long, size long, keys array<long>, wide array<long>, fp long")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield pd.DataFrame([(*signature(x, words), fingerprint(x, words)) for x in s], columns=["same", "size", "keys", "wide", "fp"])

    return of(c)


def similarity(a: Column, b: Column, words: int = 5) -> Column:
    """Jaccard similarity of the shingles of two whole texts."""

    @F.pandas_udf("double")
    def of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        cut = lru_cache(16)(lambda x: shingles(x, words))
        for s, t in parts:
            both = [(len(x & y), len(x | y)) for x, y in ((cut(p), cut(q)) for p, q in zip(s, t, strict=True))]
            yield pd.Series([i / u if u else 1.0 for i, u in both], dtype="float64")

    return of(a, b)


def differences(a: Column, b: Column, words: int = 5) -> Column:
    """(size of a, hashes of what b has and a has not, hashes of what a has and b has not), both in order."""

    @F.pandas_udf("size long, more array<long>, fewer array<long>")
    def of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        cut = lru_cache(16)(lambda x: shingles(x, words))

        def hashes(found: set[bytes]) -> list[int]:
            return np.sort(np.fromiter(map(xxh64_intdigest, found, repeat(7)), np.uint64, len(found))).view(np.int64).tolist()

        for s, t in parts:
            both = [(cut(p), cut(q)) for p, q in zip(s, t, strict=True)]
            yield pd.DataFrame({"size": [len(x) for x, _ in both], "more": [hashes(y - x) for x, y in both], "fewer": [hashes(x - y) for x, y in both]})

    return of(a, b)


def _simhash_links(marks: DataFrame) -> DataFrame:
    """(a, b) of marks(fp, same): sets of texts whose fingerprints are equal or differ in at most two bits.

    A chain of these for each such two; not all of them.
    """
    first = materialize(marks.groupBy("fp").agg(F.min("same").alias("a")))
    equal = marks.join(first.select(F.bitwise_not("fp").alias("nf"), "a"), F.bitwise_not("fp") == F.col("nf")).select("a", F.col("same").alias("b"))
    of_fp = first.select("fp", F.col("a").alias("same"))
    close = close_pairs(first.select("fp")).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    close = close.join(of_fp.select("fp", F.col("same").alias("a")), F.col("fa") == F.col("fp")).drop("fp").join(of_fp.select("fp", F.col("same").alias("b")), F.col("fb") == F.col("fp"))
    pairs = equal.unionByName(close.select("a", "b")).where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _further_bits(texts: int) -> int:
    """Bits beyond KEPT blocks with which a text shares keys with CHANCE of so many texts, by chance, or fewer."""
    return min(64, max(0, math.ceil(math.log2(max(1, texts) * CHOICES / CHANCE) - 8 * KEPT)))


def _groups(nodes: DataFrame) -> DataFrame:
    """(k, same, size, own) for each key of nodes(same, size, keys, wide); own: of blocks of the fingerprint.

    Of n texts, n^2 / 2^24 pairs share three bytes by chance. So keys of blocks get more bits
    of the fingerprint the more texts there are, and what a text shares by chance stays the
    same. Near copies that no longer share one are left to the bands.
    """
    own = F.col("pos") < CHOICES
    keys = nodes.select("same", "size", "wide", F.posexplode("keys").alias("pos", "k"))
    if bits := _further_bits(nodes.count()):
        word = F.get(F.array(*[F.lit(w) for w, _ in _FURTHER]), F.col("pos"))
        masks = np.array([np.bitwise_or.reduce(np.uint64(1) << order[:bits].astype(np.uint64)) for _, order in _FURTHER], np.uint64)
        mask = F.get(F.array(*[F.lit(m).cast("long") for m in masks.view(np.int64).tolist()]), F.col("pos"))
        keys = keys.withColumn("k", F.when(own, F.xxhash64("k", F.get("wide", word).bitwiseAND(mask))).otherwise(F.col("k")))
    return keys.select("k", "same", "size", own.alias("own"))


def _with_leads(groups: DataFrame, least: float) -> DataFrame:
    """groups(k, same, size, own) of two members and more with their lead and their centre, and their number n.

    Groups above SMALL are cut into windows by size: each window is two levels wide and each
    member is in two, so any two whose sizes may belong to near copies have one in common.
    The lead is the member that meets most others, by the sizes of its groups; the centre
    the one of these among all leads of the members' groups of that window, so that groups
    which overlap have a centre in common.
    """

    def counted(rows: DataFrame) -> DataFrame:
        """Those not alone in their group, with its number n."""
        sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.bitwise_not("k").alias("nk"), "n")
        return rows.join(sizes, F.bitwise_not("k") == F.col("nk")).drop("nk")

    found = materialize(counted(groups))
    level = F.floor(F.log("size") / F.log(F.lit(1.01 / least)))  # levels of near copies differ by one at most
    windows = found.where(F.col("n") > SMALL).select("k", "same", "own", F.explode(F.array(level, level + 1)).alias("w")).select(F.xxhash64("k", "w").alias("k"), "same", "own", "w")
    sized = materialize(counted(windows).unionByName(found.where(F.col("n") <= SMALL).select("k", "same", "own", F.lit(-1).cast("long").alias("w"), "n")))
    meets = sized.groupBy("same").agg(F.sum("n").alias("meets")).select(F.bitwise_not("same").alias("ns"), "meets")
    sized = sized.join(meets, F.bitwise_not("same") == F.col("ns")).select("k", "same", "own", F.xxhash64("same", "w").alias("place"), "meets")
    most = F.max(F.struct("meets", "same")).alias("lead")
    leads = sized.groupBy("k").agg(most, F.count(F.lit(1)).alias("n")).select(F.bitwise_not("k").alias("nk"), "lead", "n")
    led = materialize(sized.join(leads, F.bitwise_not("k") == F.col("nk")).select("k", "same", "own", "place", "lead", "n"))
    best = led.groupBy("place").agg(F.max("lead").alias("best")).select(F.bitwise_not("place").alias("np"), "best")
    centres = led.join(best, F.bitwise_not("place") == F.col("np")).groupBy("k").agg(F.max("best").alias("centre")).select(F.bitwise_not("k").alias("nk"), "centre")
    return materialize(led.join(centres, F.bitwise_not("k") == F.col("nk")).select("k", "same", "own", F.col("lead.same").alias("lead"), F.col("centre.same").alias("centre"), "n"))


def _roots(nodes: DataFrame, marks: DataFrame, rows: DataFrame, words: int, least: float) -> DataFrame:
    """(same, best, root) for each of nodes(same, best, size, keys, wide); marks(fp, same) has their fingerprints of simhash, rows(file, at, text) the texts.

    The closest by simhash are compared first, then who shares a choice of blocks with a
    centre or lead and is within the radius of it; then, still apart, members of a band's group
    with its lead, and those of small groups with each other. Let c be the group's centre, x a member that isn't
    linked to it, y any other, and D what a member has more (M) or fewer (F) than c. What y
    has in common with x is in c or in M of both, and is at least |x| times least if they are
    near copies: a member of which c and the M of all others have less has none. With
    t = least / (1 + least), x and y are near copies if and only if D of x and D of y have
    own(x) + (1 - t) |F of y| + t |M of y| in common or more, where own(x) = t (|x| + |c|) -
    |c| + |F of x|, which is above zero as x isn't linked to c. So one of the first elements of
    D of y, its rarest, is one of the first of D of x; what is left of both from there on must be enough. Such
    pairs meet by centre and element, and are compared if nothing else has linked them.
    """
    t = least / (1 + least)
    rooted = nodes.select("same", F.col("same").alias("root"))
    closest = materialize(_simhash_links(marks))
    shared = _with_leads(_groups(nodes), least)

    def within(pairs: DataFrame) -> DataFrame:
        """Those of pairs(a, b) whose fingerprints are within the radius."""
        pairs = pairs.join(nodes.select(F.col("same").alias("sa"), F.col("wide").alias("wa")), F.col("a") == F.col("sa"))
        pairs = pairs.join(nodes.select(F.col("same").alias("sb"), F.col("wide").alias("wb")), F.col("b") == F.col("sb"))
        bits = sum((F.bit_count(F.col("wa")[i].bitwiseXOR(F.col("wb")[i])) for i in range(WIDE)), F.lit(0))
        return materialize(pairs.where(bits <= RADIUS).select("a", "b"))

    def with_lead(of: DataFrame) -> DataFrame:
        return of.where("same != lead").select(F.col("lead").alias("a"), F.col("same").alias("b")).distinct()

    # Of two that share blocks, mostly by chance, those within the radius.
    two = within(with_lead(shared.where("own AND n = 2")))
    asking = shared.where("NOT own OR n > 2")
    ends = asking.select(F.col("same").alias("s")).unionByName(asking.select(F.col("lead").alias("s"))).unionByName(asking.select(F.col("centre").alias("s"))).unionByName(two.unionByName(closest).select(F.explode(F.array("a", "b")).alias("s"))).distinct()
    asked = nodes.join(ends, F.col("same") == F.col("s")).select("same", F.col("best.file").alias("f"), F.col("best.at").alias("i"))
    texts = materialize(rows.join(asked, (F.col("file") == F.col("f")) & (F.col("at") == F.col("i"))).select("same", "text"))

    def with_texts(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(texts.select(F.col("same").alias("sa"), F.col("text").alias("ta")), F.col("a") == F.col("sa"))
        return pairs.join(texts.select(F.col("same").alias("sb"), F.col("text").alias("tb")), F.col("b") == F.col("sb")).drop("sa", "sb")

    def alike(pairs: DataFrame) -> DataFrame:
        return materialize(with_texts(pairs).select("a", "b", similarity(F.col("ta"), F.col("tb"), words).alias("s")).where(F.col("s") >= least).select("a", "b"))

    def joined(links: DataFrame) -> DataFrame:
        """rooted after these links."""
        root_of = rooted.select(F.col("same").alias("s"), "root")
        ends = links.join(root_of.withColumnRenamed("root", "ra"), F.col("a") == F.col("s")).drop("s").join(root_of.withColumnRenamed("root", "rb"), F.col("b") == F.col("s"))
        tops = connected_components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select("node", F.col("root").alias("top"))
        return materialize(rooted.join(tops, F.col("root") == F.col("node"), "left").select("same", F.coalesce("top", "root").alias("root")))

    def apart(pairs: DataFrame) -> DataFrame:
        """Those of pairs(a, b) with different roots ra and rb."""
        root_of = rooted.select(F.col("same").alias("s"), "root")
        pairs = pairs.join(root_of.withColumnRenamed("root", "ra"), F.col("a") == F.col("s")).drop("s")
        return pairs.join(root_of.withColumnRenamed("root", "rb"), F.col("b") == F.col("s")).drop("s").where("ra <> rb")

    rooted = joined(alike(closest))

    def small_pairs(of: DataFrame) -> DataFrame:
        """Pairs with different roots in the small groups; of two members, one is the lead."""
        root_of = rooted.select(F.col("same").alias("s"), "root")
        few = of.where((F.col("n") > 2) & (F.col("n") <= SMALL)).join(root_of, F.col("same") == F.col("s")).select("k", "same", "root")
        return few.select("k", F.col("same").alias("a"), F.col("root").alias("ra")).join(few.select("k", F.col("same").alias("b"), F.col("root").alias("rb")), "k").where("a < b AND ra <> rb").select("a", "b").distinct()

    blocks, bands = shared.where("own AND n > 2"), shared.where("NOT own")
    to_centre = blocks.where("same != centre").select(F.col("centre").alias("a"), F.col("same").alias("b")).distinct()
    by_blocks = [lambda: two.unionByName(within(apart(to_centre))).distinct(), lambda: within(apart(with_lead(blocks)))]
    for pairs in (*by_blocks, lambda: apart(with_lead(bands)), lambda: small_pairs(bands)):
        links = alike(pairs())
        if links.limit(1).count():
            rooted = joined(links)
    root_of = rooted.select(F.col("same").alias("s"), "root")

    members = bands.where((F.col("n") > SMALL) & (F.col("same") != F.col("centre"))).select(F.col("centre").alias("a"), F.col("same").alias("b")).distinct()
    members = members.join(root_of.withColumnRenamed("root", "ra"), F.col("a") == F.col("s")).drop("s").join(root_of.withColumnRenamed("root", "rb"), F.col("b") == F.col("s")).drop("s")
    # Centres with members apart from each other. By the complement, so that one with very many can be split.
    members = materialize(members)
    open_ = members.groupBy("a").agg(F.min("rb").alias("lo"), F.max("rb").alias("hi")).where("lo < hi").select(F.bitwise_not("a").alias("na"))
    told = with_texts(members.join(open_, F.bitwise_not("a") == F.col("na"), "left_semi"))
    told = told.select("a", F.col("b").alias("same"), F.col("rb").alias("root"), differences(F.col("ta"), F.col("tb"), words).alias("d"))
    more, fewer, size = F.size("d.more"), F.size("d.fewer"), F.col("d.size")
    own = t * (2 * size - fewer + more) - size + fewer
    told = told.withColumns({"own": own, "asks": (1 - t) * fewer + t * more, "meant": size - fewer, "wanted": least * (size - fewer + more)})
    told = materialize(told.select("a", "same", "root", "own", "asks", "meant", "wanted", "d.more", "d.fewer"))

    def in_common(told: DataFrame, what: str) -> DataFrame:
        """(na, ns, what): for a centre and member of told, how often and which of its elements others have too."""
        each = materialize(told.select("a", "same", F.explode(what).alias("h")).select("a", "same", F.xxhash64("a", "h").alias("k")))
        often = each.groupBy("k").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(F.bitwise_not("k").alias("nk"), "times")
        each = each.join(often, F.bitwise_not("k") == F.col("nk"))
        # By centre and member, of which a group has no more rows than the member's text has shingles.
        return each.groupBy(F.col("a").alias("na"), F.col("same").alias("ns")).agg(F.collect_list(F.struct("times", "k")).alias(what))

    def with_common(told: DataFrame, what: str) -> DataFrame:
        found = in_common(told, what)
        none = F.array().cast(found.schema[what].dataType)
        return told.drop(what).join(found, (F.col("a") == F.col("na")) & (F.col("same") == F.col("ns")), "left").drop("na", "ns").withColumn(what, F.coalesce(what, none))

    ranked = with_common(told, "more").where(F.col("meant") + F.size("more") >= F.col("wanted") - 1e-6)
    ranked = materialize(ranked)
    lows = ranked.groupBy("a").agg(F.min(F.when(F.col("own") > 1e-9, F.col("own"))).alias("least_own"), F.min("asks").alias("least_asks")).where("least_own IS NOT NULL").select(F.bitwise_not("a").alias("na"), "least_own", "least_asks")
    ranked = materialize(ranked.join(lows, F.bitwise_not("a") == F.col("na")).drop("na"))
    ranked = with_common(ranked, "fewer").withColumn("ks", F.array_sort(F.concat("more", "fewer")))
    # So many of the elements that others have too, the rarest first, that one is in common with whatever is near.
    prefix = lambda need: F.size("ks") - F.ceil(need - 1e-6) + 1
    ranked = ranked.withColumns({"first_x": F.when(F.col("own") > 1e-9, prefix(F.col("own") + F.col("least_asks"))).otherwise(0), "first_y": prefix(F.col("asks") + F.col("least_own"))})
    ranked = ranked.where("first_x > 0 OR first_y > 0").select("same", "root", "own", "asks", "first_x", "first_y", F.size("ks").alias("common"), F.posexplode(F.slice("ks", F.lit(1), F.greatest("first_x", "first_y", F.lit(1)).cast("int"))).alias("pos", "x"))
    left = F.col("common") - F.col("pos")  # the elements from this one on
    ranked = ranked.select(F.col("x.k").alias("k"), "same", "root", "own", "asks", left.alias("left"), (F.col("pos") < F.col("first_x")).alias("is_x"), (F.col("pos") < F.col("first_y")).alias("is_y"))
    ranked = materialize(ranked)
    some = lambda what, c: F.when(F.col(what), F.col(c))
    bounds = ranked.groupBy("k").agg(F.max(some("is_x", "left")).alias("most_x"), F.max(some("is_y", "left")).alias("most_y"), F.min(some("is_x", "own")).alias("own_x"), F.min(some("is_y", "asks")).alias("asks_y"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    bounds = bounds.where("lo < hi AND most_x IS NOT NULL AND most_y IS NOT NULL").select(F.bitwise_not("k").alias("nk"), "most_x", "most_y", "own_x", "asks_y")
    # Only members that have enough left for some other one of the group.
    ranked = ranked.join(bounds, F.bitwise_not("k") == F.col("nk"))
    ranked = ranked.withColumns({"is_x": F.col("is_x") & (F.least("left", "most_y") >= F.col("own") + F.col("asks_y") - 1e-6), "is_y": F.col("is_y") & (F.least("left", "most_x") >= F.col("own_x") + F.col("asks") - 1e-6)})
    ranked = materialize(ranked.where("is_x OR is_y").select("k", "same", "root", "own", "asks", "left", "is_x", "is_y"))
    kinds = ranked.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("is_x").alias("x"), F.max("is_y").alias("y"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("x AND y AND lo < hi").select(F.bitwise_not("k").alias("nk"), "n")
    ranked = materialize(ranked.join(kinds, F.bitwise_not("k") == F.col("nk")).drop("nk"))
    xs = ranked.where("is_x").select(F.col("k").alias("kx"), F.col("same").alias("x"), F.col("root").alias("rx"), "own", F.col("left").alias("left_x"))
    ys = ranked.where("is_y").select("k", F.col("same").alias("y"), F.col("root").alias("ry"), "asks", F.col("left").alias("left_y"))
    enough = F.least("left_x", "left_y") >= F.col("own") + F.col("asks") - 1e-6
    pairs = xs.join(ys, (F.col("k") == F.col("kx")) & (F.col("rx") != F.col("ry")) & enough).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = alike(pairs)
    if links.limit(1).count():
        rooted = joined(links)
    return nodes.join(rooted.select(F.col("same").alias("s"), "root"), F.col("same") == F.col("s")).select("same", "best", "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """docs, with one row of each group of near copies: that with the smallest id (null last).

    Near copies are texts whose sets of shingles of `words` words have a Jaccard
    similarity of at least `least`; groups are what such pairs link. SimHash fingerprints of
    these shingles propose them, MinHash bands what these miss. Texts without words,
    null ones included, are one group. Of several rows with the smallest id one stays, by
    the hash of its text and then its place in the written table. Repeated rows are one group,
    and texts of any length are compared as a whole. All columns are kept, whatever their
    names. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    hidden = [c for c in docs.columns if c.lower() == "_metadata"]  # the name of what files tell of their rows
    if hidden:
        (other,) = fresh(docs, "_metadata_")
        return one_of_each(docs.withColumnRenamed(hidden[0], other), id_col, text_col, words, least).withColumnRenamed(other, hidden[0])
    sig, file, at, its_file, its_at = fresh(docs, "_sig", "_file", "_at", "_its_file", "_its_at")
    rows = materialize(docs.withColumn(sig, signatures(col(text_col), words)))
    rows = rows.select(*[col(c) for c in rows.columns], F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(at))
    slim = rows.select(col(id_col).alias("id"), F.col(f"{sig}.same").alias("same"), F.col(f"{sig}.size").alias("size"), F.col(f"{sig}.keys").alias("keys"), F.col(f"{sig}.wide").alias("wide"), F.col(f"{sig}.fp").alias("fp"), F.xxhash64(col(text_col)).alias("h"), F.col(file).alias("file"), F.col(at).alias("at"))
    # Equal sets fold first; size, keys and wide come last, for they follow from the set.
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "file", "at", "size", "keys", "wide"))
    nodes = materialize(slim.groupBy("same").agg(best.alias("best")).select("same", F.col("best").dropFields("size", "keys", "wide").alias("best"), "best.size", "best.keys", "best.wide"))
    rooted = _roots(nodes, slim.select("fp", "same").distinct(), rows.select(F.col(file).alias("file"), F.col(at).alias("at"), col(text_col).alias("text")), words, least)
    wanted = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.file").alias(its_file), F.col("best.at").alias(its_at))
    return rows.join(wanted, (F.col(file) == F.col(its_file)) & (F.col(at) == F.col(its_at)), "left_semi").select(*[col(c) for c in docs.columns])
