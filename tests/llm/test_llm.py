"""The ten operators and the pipeline against brute force, on small and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import components, decontamination, language_id, license_scan, line_dedup, packing, quality_cnn, quality_rules, queries, simhash, url_filters, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = str.maketrans(UPPER, LOWER)
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000)) + "\nAn unusual line that repeats itself"
ODD = [
    (1, "One line here, one there\nshared line of text\nÉcole ABC", "en", "a"),
    (2, "  SHARED line of text \nshort\nshort\n\n", "en", "a"),
    (2, "  SHARED line of text \nshort\nshort\n\n", "en", "a"),
    (3, None, None, None),
    (4, "", "de", "b"),
    (None, "shared line of text\nonly here, with no id", "fr", None),
    (5, "\x0b\x1c odd \x85 blanks here " * 3, "fr", "c"),
    (6, LONG, "en", "a"),
    (7, LONG.replace("w5x5 ", "changed "), "en", "a"),
    (8, "12 34 !!", None, "b"),
    (9, "the same\r\nthe same\r\nthe same\r\n", "es", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, and columns with names that operators use."""
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"n_lines": F.lit("x"), "_id": F.lit(1), "_fp": F.lit(2), "score": F.lit("s"), "kept": F.lit("k"), "a": F.lit("1"), "doc": F.lit(3), "fp": F.lit(4), "u": F.lit("5"), "h": F.lit(6)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# -- line dedup


def dedup_brute(docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWERED)
    last = 1 << 63
    held = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            held[key(x)].add(last if d is None else d)
    out = []
    for d, t in docs:
        parts = (t or "").split("\n")
        kept = [x for x in parts if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == (last if d is None else d)]
        out.append((d, None if t is None else "\n".join(kept), len(parts), len(parts) - len(kept)))
    return out


@pytest.mark.parametrize("table", ["odd", "real"])
def test_line_dedup(spark, sf, odd, table):
    docs = odd if table == "odd" else documents(spark, sf)
    got = line_dedup.drop_repeated_lines(docs)
    assert set(got.columns) == {*docs.columns, "n_lines", "n_dropped"}
    want = dedup_brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert Counter(rows_of(got.select("doc_id", "text", "n_lines", "n_dropped"))) == Counter(want)


def test_line_dedup_of_nothing(none):
    assert line_dedup.drop_repeated_lines(none).count() == 0
    with pytest.raises(TypeError):
        line_dedup.drop_repeated_lines(none.withColumn("doc_id", F.col("doc_id").cast("string")))


# -- SimHash


def print_brute(text):
    w = [x.translate(LOWERED) for x in WORD.findall(text or "")]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components_brute(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(nodes)
    for i, x in enumerate(nodes):
        for y in nodes[:i]:
            if linked(x, y):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_simhash(spark, sf, odd):
    docs = documents(spark, sf).select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    got = rows_of(simhash.duplicate_groups(docs))
    prints = [(r["doc_id"], print_brute(r["text"])) for r in docs.collect()]
    assert Counter((d, fp % (1 << 64)) for d, fp, _ in got) == Counter(prints)
    root = components_brute({p for _, p in prints}, lambda x, y: (x ^ y).bit_count() <= 2)
    least = {}
    for d, p in prints:
        if d is not None:
            least[root[p]] = min(least.get(root[p], d), d)
    assert {(d, c) for d, _, c in got} == {(d, least.get(root[p])) for d, p in prints}


@pytest.mark.parametrize("largest", [2, 32])
def test_close_pairs_give_all_components(spark, largest):
    r = random.Random(3)
    fps = {0, -1}
    for _ in range(12):
        base = r.getrandbits(64)
        fps |= {base} | {base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(25)}
    fps = {x - (1 << 64) if x >> 63 and x > 0 else x for x in fps}
    edges = simhash.close_pairs(spark.createDataFrame([(x,) for x in fps], "fp long"), largest=largest)
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 2 for a, b in rows_of(edges))
    want = components_brute(fps, lambda x, y: ((x ^ y) % (1 << 64)).bit_count() <= 2)
    got = dict(rows_of(components.connected_components(edges)))
    assert {x: got.get(x, x) for x in fps} == want


@pytest.mark.parametrize(("bits", "largest"), [(1, 1), (3, 2), (3, 32), (4, 3)])
def test_close_pairs_of_more_or_fewer_bits(spark, bits, largest):
    r = random.Random(bits)
    fps = {0, -1}
    for _ in range(3):
        base = r.getrandbits(64)
        for _ in range(14):
            x = base
            for _ in range(r.randrange(bits + 2)):
                x ^= 1 << r.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    edges = simhash.close_pairs(spark.createDataFrame([(x,) for x in fps], "fp long"), bits, largest=largest)
    assert all(((a ^ b) % (1 << 64)).bit_count() <= bits for a, b in rows_of(edges))
    want = components_brute(fps, lambda x, y: ((x ^ y) % (1 << 64)).bit_count() <= bits)
    got = dict(rows_of(components.connected_components(edges)))
    assert {x: got.get(x, x) for x in fps} == want


def test_one_of_each(spark, odd, none):
    named = odd.withColumn("_metadata", F.lit("m"))
    kept = simhash.one_of_each(named)
    assert kept.columns == named.columns
    got = rows_of(kept.select("doc_id", "text"))
    groups = {(d, c) for d, _, c in rows_of(simhash.duplicate_groups(odd))}
    assert len(got) == len({c for _, c in groups}) and len({d for d, _ in got}) == len(got)
    assert all(any(c == d for x, c in groups if x == d) or d is None for d, _ in got)
    assert simhash.one_of_each(none).count() == 0 and simhash.duplicate_groups(none).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = dict(rows_of(components.connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}


# -- decontamination


def contamination_brute(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWERED))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        if w and i is not None:
            for k in range(max(1, len(w) - 12)):
                windows[tuple(w[k : k + 13])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        out.append((d, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_decontamination(spark, sf, odd, block):
    docs = documents(spark, sf).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    more = [(900, "w5x5 w6x6"), (901, None), (902, ""), (903, "!!"), (None, "shared line"), (904, "SHARED  line"), (900, "no id"), (905, "the same the same")]
    items = items.unionByName(spark.createDataFrame(more, "item_id long, text string"))
    found = decontamination.find(decontamination.build_index(docs, shard_tokens=20_000), items, block_chars=block)
    got = found.select(F.col("doc").cast("long"), "n_words", decontamination.n_hit(), "items", "span_start", "span_end").collect()
    want = contamination_brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert Counter((r[0], r[1], r[2], tuple(r[3])) for r in got) == Counter(x[:4] for x in want)
    assert any(x[4] for x in want)


def test_decontamination_in_bounded_memory(spark):
    """A block of benchmark text, a shard and the search of one stay small, however large the tables are."""
    import tracemalloc

    r = random.Random(3)
    names = [f"w{r.randrange(30_000)}" for _ in range(40_000)]
    items = [(str(i), " ".join(r.choices(names, k=2000))) for i in range(decontamination.BLOCK_CHARS // 12_000)]
    shard = decontamination._Open()
    for i in range(40):
        shard.add(str(i), decontamination.words(items[i][1] if i % 3 == 0 else " ".join(r.choices(names, k=1600))), i, i)
    tracemalloc.start()
    query = decontamination.Query(items, 13)
    query.ranked(np.ones(len(query.terms), np.int64))
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(query.windows) > 150_000 and held < 48 << 20 and peak < 160 << 20
    batch = shard.closed("s")
    assert batch.nbytes < 1 << 20
    row = batch.to_pylist()[0]
    tracemalloc.start()
    doc, lo, hi, _, _ = decontamination.Shard(row["terms"], row["ends"], row["positions"], row["starts"]).hits(query, None)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
    whole = {i for i in range(40) if i % 3 == 0}
    assert whole <= set(doc.tolist()) and all(hi[k] - lo[k] == 2000 for k in range(len(doc)) if doc[k] in whole)


def test_drop_contaminated(spark, sf, odd, none):
    items = spark.createDataFrame([(1, "12 34")], "item_id long, text string")
    kept = decontamination.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and Counter(rows_of(kept.select("doc_id"))) == Counter((x[0],) for x in ODD if x[0] != 8)
    assert decontamination.drop_contaminated(none, items).count() == 0
    assert decontamination.drop_contaminated(odd, items.limit(0)).count() == len(ODD)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "beta x x x x x alpha"), (3, "alpha"), (4, "beta alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    found = decontamination.find(decontamination.build_index(docs), items, slack=3).where(F.size("items") > 0)
    assert {r["doc"] for r in found.collect()} == {"1", "4"}


# -- packing

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def check_packing(spark, docs, got, sequence=1024):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for r in docs.collect():
        want[r["doc_id"], tuple(tok.encode(r["text"] or "", add_special_tokens=False).ids) + (0,)] += 1
    pieces = got.collect()
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
    for doc in {d for d, _ in want}:
        need = Counter()
        for (d, ids), n in want.items():
            if d == doc:
                for start, length, crc in {(p["start"], p["length"], p["ids_crc32"]) for p in by_doc[doc] if p["doc_tokens"] == len(ids)}:
                    assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) or len({i for x, i in want if x == doc}) > 1
                need[len(ids)] += n * len(ids)
        have = Counter()
        for p in by_doc[doc]:
            have[p["doc_tokens"]] += p["length"]
        assert have == need
    seqs = defaultdict(list)
    for p in pieces:
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
    short = 0
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= sequence
        short += at < sequence
    assert short <= 1 and len(pieces) == sum(map(len, seqs.values()))
    return seqs


@pytest.mark.parametrize("window", [1, 4, 64])
def test_packing(spark, sf, odd, none, window):
    docs = documents(spark, sf).unionByName(odd.select("doc_id", "text", "lang", "source"), allowMissingColumns=True)
    check_packing(spark, docs, packing.pack(docs, TOKENIZER, window=window))
    check_packing(spark, odd, packing.pack(odd, TOKENIZER, window=window, targets={"a": 0.9, "c": 0.1}))
    assert packing.pack(none, TOKENIZER).count() == 0


def test_packing_follows_targets():
    totals, want = [0, 10_000, 10_000, 10_000], [0, 0.5, 0.3, 0.2]
    plan = packing.Schedule(totals, 1000, want)
    credit = lambda q, k: int(plan.credit(q, np.array([k]))[0])
    for k in range(20):  # until the first queue is dry
        for q, share in enumerate(want):
            assert abs(credit(q, k + 1) - credit(q, k) - 1000 * share) <= 1
            assert -1e-6 <= (k + 1) * 1000 * share - credit(q, k + 1) < 1  # the deficit carried
    for k in range(20, 23):  # its share goes to the others as three to two
        assert abs(credit(2, k + 1) - credit(2, k) - 600) <= 1 and abs(credit(3, k + 1) - credit(3, k) - 400) <= 1
    for q in range(4):
        row, lo, hi, off = plan.place(q, np.array([0]), np.array([totals[q]]))
        assert int((hi - lo).sum()) == totals[q]
    spans = sorted((int(o), int(o + h - x)) for q in range(4) for _, x, h, o in zip(*plan.place(q, np.array([0]), np.array([10_000 if q else 0])), strict=True))
    assert spans[0][0] == 0 and spans[-1][1] == 30_000 and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))


def robin_brute(totals, window, weights):
    """Deficit round-robin window by window: tokens of each queue in each, with exact fractions."""
    from fractions import Fraction

    taken, left = [Fraction(0)] * len(totals), list(map(Fraction, totals))
    out = []
    while sum(left):
        before, room = list(taken), Fraction(window)
        while room and sum(left):
            live = [Fraction(w) if x else Fraction(0) for w, x in zip(weights, left, strict=True)]
            if not sum(live):
                live = [Fraction(n) if x else Fraction(0) for n, x in zip(totals, left, strict=True)]
            step = min(room / sum(live), *(x / w for x, w in zip(left, live, strict=True) if w))
            for q, w in enumerate(live):
                taken[q] += step * w
                left[q] -= step * w
            room -= step * sum(live)
        out.append([int(y) - int(x) for x, y in zip(before, taken, strict=True)])
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=6), st.integers(20, 200), st.randoms())
def test_schedules_equal_window_by_window(totals, window, r):
    weights = [r.choice([0, 1, 2, 5]) for _ in totals]
    plan = packing.Schedule(totals, window, [float(w) for w in weights])
    want = robin_brute(totals, window, weights)
    assert plan.windows == len(want)
    got = np.array([plan.credit(slice(None), k) for k in range(plan.windows + 1)])
    sums = np.cumsum(np.array([[0] * len(totals), *want]), axis=0)
    assert np.abs(got - sums).max() <= 1 and (got[-1] == totals).all()  # a fraction may round either way


def test_packing_reports_the_shares_of_windows(spark):
    docs = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(40)), "big" if i % 10 else "small") for i in range(800)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    got = packing.pack(docs, TOKENIZER, sequence=64, window=8, targets={"big": 0.8, "small": 0.2})
    shares = {(r["window"], r["source"]): r["share"] for r in packing.window_shares(got).collect()}
    dry = max(w for w, s in shares if s == "small")
    assert dry > 5 and all(abs(shares[w, "small"] - 0.2) < 0.02 for w in range(dry)) and all(shares.get((w, "big"), 0) > 0.99 for w in range(dry + 1, max(shares)[0] + 1))
    tempered = packing.window_shares(packing.pack(docs, TOKENIZER, sequence=64, window=8, targets=0.5)).where("window < 8 AND source = 'small'").collect()
    assert all(abs(r["share"] - 0.25) < 0.03 for r in tempered) and len(tempered) == 8


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 3000)), min_size=1, max_size=7), st.integers(1, 200), st.booleans(), st.randoms())
def test_schedules_place_each_token_once(totals, window, natural, r):
    plan = packing.Schedule(totals, window, None if natural else [r.choice([0, 0.1, 1, 3]) for _ in totals])
    seen = []
    for q, n in enumerate(totals):
        cuts = sorted({0, n, *(r.randint(0, n) for _ in range(4))})
        lo, hi = np.array(cuts[:-1], np.int64), np.array(cuts[1:], np.int64)
        row, a, b, off = plan.place(q, lo, hi)
        assert ((a >= lo[row]) & (b <= hi[row]) & (a < b)).all()
        assert sorted(x for s, e in zip(a, b, strict=True) for x in range(s, e)) == list(range(n))
        seen += [x for o, s, e in zip(off, a, b, strict=True) for x in range(o, o + e - s)]
    assert sorted(seen) == list(range(sum(totals)))


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(TOKENIZER), packing.Encoder(TOKENIZER)
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice(["a", "B", " ", "  ", "\n", "\t", "é", "1", "!", "<|endoftext|>", "'s", " ", " ", "\x1c", "\x85", "word", " the", "\0", "日本"]) for _ in range(r.randrange(14)))
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == [*tok.encode(text, add_special_tokens=False).ids, 0], repr(text)


# -- quality rules


def stats_brute(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    parts = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(parts) - len(set(parts)), len(hit)


def test_quality_rules(spark, sf, odd, none):
    for docs in (documents(spark, sf), odd):
        got = quality_rules.host_filtered(docs)
        assert Counter(rows_of(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) == Counter((r["doc_id"], *stats_brute(r["text"])) for r in docs.collect())
        for r in got.collect():
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert not (r["kept"] and r["base_failed"])
    assert quality_rules.host_filtered(none).count() == 0


def test_host_verdicts_shrink(spark):
    good, bad = "word " + " ".join(f"w{i}" for i in range(60)), "x"
    docs = [(i, bad if h == "bad" or i % 20 == 0 else good, h) for h, n in (("bad", 40), ("fine", 60), ("big", 200), ("tiny", 2), ("ok", 30)) for i in range(n)]
    got = quality_rules.host_filtered(spark.createDataFrame(docs, "doc_id int, text string, source string"))
    kept = {(r["source"], r["kept"]) for r in got.where("NOT base_failed").select("source", "kept").distinct().collect()}
    assert kept == {("fine", True), ("big", True), ("tiny", True), ("ok", True)}
    verdicts = {r["host"]: r["host_kept"] for r in quality_rules.host_verdicts(got, "source").collect()}
    assert verdicts == {"bad": False, "fine": True, "big": True, "tiny": True, "ok": True}


# -- language ID and quality network


def test_language_id(spark, sf, odd, none):
    docs = documents(spark, sf)
    got = queries.op4_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    assert len(got) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)
    model = language_id.fit(docs)
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.with_language(odd, model).collect()}
    assert out[3] == out[4] == out[8] == "und" and out[6] != "und"
    assert {r["lang_pred"] for r in language_id.with_language(odd, language_id.fit(none)).collect()} == {"und"}
    assert language_id.with_language(none, model).count() == 0


def test_quality_network(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op7_quality_cnn(spark, sf).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in got if r["quality"] == 1], [r["score"] for r in got if r["quality"] == 0]
    assert np.mean([x > y for x in good for y in bad]) > 0.9
    net = quality_cnn.fit(none, labels)
    assert {r["score"] for r in quality_cnn.with_quality(odd, net).collect()} == {0.5}


def vote_brute(model, text):
    """(language, score) by counting trigrams in a dict and asking every weight by itself."""
    import math

    b = b" " + text.encode().lower() + b" "
    counts = defaultdict(int)
    for i in range(max(1, len(b) - 2)):
        x = (b[i : i + 3] + b"   ")[:3]
        counts[(int.from_bytes(x, "big") * 2654435761 % (1 << 32)) >> 19] += 1
    n = sum(counts.values())
    odds = lambda w: 1 / (1 + math.exp(-model.steep * (sum(float(w[k]) * math.sqrt(v / n) for k, v in counts.items()) + float(w[-1]))))
    family, p = model.families[0], 1.0
    if model.family_weights is not None:
        each = [odds(w) for w in model.family_weights]
        family, p = model.families[each.index(max(each))], max(each) / sum(each)
    won = dict.fromkeys(model.members[family], 0.0)
    for (x, y), w in model.pair_weights.items():
        if x in won and y in won:
            won[x] += odds(w)
            won[y] += 1 - odds(w)
    best = max(sorted(won), key=won.get)
    return best, p * (won[best] / (len(won) - 1) if len(won) > 1 else 1)


def test_language_votes_equal_brute_force(spark, sf):
    docs = documents(spark, sf).where("text IS NOT NULL").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    assert set(model.members["germanic"]) == {"de", "en"} and set(model.members["romance"]) == {"es", "fr"}
    texts = [*(r["text"] for r in docs.limit(40).collect()), "a", "é", "ab c"]
    for text in texts:
        want = vote_brute(model, text)
        got = model.predict(text)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1], abs=1e-3)


def test_svm_separates():
    r = np.random.default_rng(2)
    x = [(np.sort(r.choice(language_id.DIM, 20, replace=False)).astype(np.uint16), r.random(20).astype(np.float32)) for _ in range(60)]
    truth = r.normal(size=language_id.DIM)
    y = np.array([1.0 if truth[at] @ v > 0 else -1.0 for at, v in x])
    w = language_id.train_svm(x, y, cost=100.0, rounds=200)
    assert all(np.sign(w[at] @ v + w[-1]) == k for (at, v), k in zip(x, y, strict=True))


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}q " * 12, f"l{i % 300:03d}") for i in range(1200)]
    model = language_id.fit(spark.createDataFrame([(i, t.replace("q", str(i % 300)), v) for i, t, v in rows], "doc_id long, text string, lang string"), families={f"l{i:03d}": f"f{i // 30}" for i in range(300)}, most_rows=900)
    assert sum(map(len, model.members.values())) == 300


def score_brute(net, text):
    """The network's formula, byte by byte."""
    import math

    raw, total, n, at = text.encode(), [0.0] * quality_cnn.FILTERS, 0, 0
    while True:
        chunk = raw[at : at + quality_cnn.CHUNK].ljust(quality_cnn.CHUNK, b"\0")
        for f in range(quality_cnn.FILTERS):
            best = max(sum(float(net.tables[k][chunk[i + k]][f]) for k in range(quality_cnn.WIDTH)) for i in range(quality_cnn.CHUNK - quality_cnn.WIDTH + 1))
            total[f] += math.tanh(best + float(net.bias[f]))
        n += 1
        if at + quality_cnn.CHUNK >= len(raw):
            break
        at += quality_cnn.CHUNK - quality_cnn.OVERLAP
    return 1 / (1 + math.exp(-(sum(t / n * float(w) for t, w in zip(total, net.out, strict=True)) + net.offset)))


@pytest.mark.parametrize("n", [0, 3, 511, 512, 513, 961, 1500])
def test_quality_scores_equal_brute_force(n):
    net = quality_cnn.Network.new(4)
    text = "".join(chr(97 + i * i % 26) for i in range(n))
    assert net.score(text) == pytest.approx(score_brute(net, text), abs=1e-4)


def test_quality_gradient():
    net, r = quality_cnn.Network.new(1), random.Random(1)
    texts = [quality_cnn.chunks("".join(r.choice("ab" if i % 2 else "yz") for _ in range(700))) for i in range(40)]
    y = np.array([i % 2 for i in range(40)], np.float32)
    net.train(texts, y, epochs=15)
    assert net.score("ab" * 300) > 0.8 and net.score("yz" * 300) < 0.2


def test_quality_of_nothing(spark, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "good"), (2, "bad"), (2, "bad"), (3, None)], "doc_id long, text string").withColumns({"id": F.lit("i"), "y": F.lit(3), "stratum": F.lit(0), "predicted": F.lit(1)})
    net = quality_cnn.fit(docs, labels, epochs=2)
    assert quality_cnn.with_quality(docs, net).count() == 4
    assert quality_cnn.with_quality(none, net).count() == 0
    assert quality_cnn.fit(docs, labels.limit(0)).score("x") == 0.5


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        c = quality_cnn.chunks("".join(chr(97 + i % 26) for i in range(n)))
        step = quality_cnn.CHUNK - quality_cnn.OVERLAP
        assert (len(c) - 1) * step + quality_cnn.CHUNK >= n and (len(c) == 1 or (len(c) - 2) * step + quality_cnn.CHUNK < n)
    net = quality_cnn.Network.new(1)
    z, _ = net.pooled(quality_cnn.chunks(LONG))
    want = 1 / (1 + np.exp(-(np.tanh(z).mean(axis=0) @ net.out + net.offset)))
    assert abs(net.score(LONG) - want) < 1e-4


# -- WARC


def test_warc(spark, sf):
    same = "<p>" + "x" * 1200
    odd = [(1, "http://a b/\r\nX: y", same), (2, None, same), (3, "http://a/", None), (4, "http://a/", ""), (5, "http://a/", "small"), (6, "http://a/", "small"), (None, "http://a/", same), (2, None, same), (7, "http://a/é", "é" * 700)]
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").withColumn("page_id", F.col("page_id") + 1000).unionByName(spark.createDataFrame(odd, "page_id long, url string, html string")).withColumn("digest", F.lit("clash"))
    got = warc.archive_and_read(pages, with_payload=True).collect()
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    top = {}
    for p, h in rows:
        top[h] = max(top.get(h, p or 0), p or 0)
    want = Counter()
    for p, h in rows:
        again = len(h) >= 1000 and p != top[h]
        want[p, len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", top[h] if again else None, None if again else h] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got) == want
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_warc_of_large_ids_repeats_and_long_payloads(spark):
    big, long = 1 << 53, "<p>é" * 700_000
    rows = [(big + i, f"http://a/{i}", long) for i in (1, 3, 5)] + [(None, "http://n/", long), (big + 7, "http://b/", "y" * 1000), (big + 7, "http://b/", "y" * 1000), (2, "http://c/", "y" * 1000), (3, "http://c/", "z"), (3, "http://c/", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "keeper": F.lit(1.5), "top": F.lit("t"), "n": F.lit(0)})
    got = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archive_and_read(pages).collect())
    size = 3 * 700_000 + 2 * 700_000
    assert got == Counter({
        (big + 5, "response", None, size): 1, (big + 3, "revisit", big + 5, size): 1, (big + 1, "revisit", big + 5, size): 1, (None, "revisit", big + 5, size): 1,
        (big + 7, "response", None, 1000): 2, (2, "revisit", big + 7, 1000): 1, (3, "response", None, 1): 2,
    })


def test_warc_revisits_can_be_resolved(spark, tmp_path):
    same = "q" * 1500
    rows = [(1, "http://a/1", same), (2, "http://a/2", same), (2, "http://a/2", "other"), (2, "http://a/2", "other"), *[(5, "http://r/", "r" * 1500)] * 2, (4, "http://r/", "r" * 1500)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), f"file://{tmp_path}")
    heads = [warc.parse(x)[0] for f in tmp_path.glob("part-*/*.warc.zst") for x in warc.read_records(f.read_bytes())]
    heads = [h for h in heads if h["warc-type"] != "warcinfo"]
    by_id = {h["warc-record-id"]: h for h in heads}
    assert len(by_id) == len(rows)
    for h in heads:
        if h["warc-type"] == "revisit":
            assert h["warc-refers-to-target-uri"] == {"1": "http://a/2", "4": "http://r/"}[h["x-page-id"]] and h["warc-refers-to-date"]
            assert ("warc-refers-to" in h) == (h["x-page-id"] == "1")
            if "warc-refers-to" in h:
                to = by_id[h["warc-refers-to"]]
                assert to["warc-type"] == "response" and to["x-page-id"] == "2" and to["warc-payload-digest"] == h["warc-payload-digest"]


def test_archive_has_a_dictionary_in_front():
    a = warc.Archive()
    records = [warc.record("response", i, f"http://a/{i}", f"<html><body>some page number {i} of many</body>".encode() * 20, "00" * 20) for i in range(3000)]
    for r in records:
        a.add(r)
    data = a.close()
    assert int.from_bytes(data[:4], "little") == warc.MAGIC
    assert [x for x in warc.read_records(data)][1:] == records


# -- URL filters and licences


def test_listed_as_of(spark):
    e = [("bad.com", "2024-01-10", True), ("bad.com", "2024-02-10", False), ("bad.com", "2024-02-10", None), ("x.bad.com", "2023-01-01", True), ("com", "2020-01-01", True), (None, "2020-01-01", True), ("odd.org", None, True), ("BAD.com", "2024-03-01", True), ("bad.com", "2024-03-01", False)]
    c = [(1, "http://bad.com/a", "2024-01-09"), (2, "http://bad.com/a", "2024-01-10"), (3, "https://u:p@Y.BAD.com:80/a", "2024-02-09"), (4, "http://bad.com", "2024-02-10"), (5, "http://z.x.bad.com/", "2024-01-15"), (6, "http://notbad.com", "2024-01-15"), (7, None, "2024-01-15"), (8, "http://bad.com", None), (9, "http://bad.com", "2030-01-01"), (2, "http://bad.com/a", "2024-01-10")]
    entries = spark.createDataFrame(e, "domain string, at string, active boolean").withColumn("at", F.to_timestamp("at"))
    caps = spark.createDataFrame(c, "page_id int, url string, fetched string").withColumns({"fetched": F.to_timestamp("fetched"), "domain": F.lit("clash"), "bucket": F.lit(0)})
    got = Counter(rows_of(url_filters.listed(caps, entries).select("page_id", "listed_by")))
    assert got == Counter([(1, None), (2, "bad.com"), (2, "bad.com"), (3, "bad.com"), (4, None), (5, "x.bad.com"), (6, None), (7, None), (8, None), (9, "bad.com")])
    assert url_filters.listed(caps.limit(0), entries).count() == 0 and url_filters.listed(caps, entries.limit(0)).where("listed_by IS NULL").count() == len(c)


def test_listed_with_outlying_times_and_long_urls(spark):
    r = random.Random(5)
    moment = lambda: r.choice([0, 1, 2_000_000_000, 253_402_300_799, -62_135_596_800, r.randrange(-(10**10), 2 * 10**11), r.randrange(10**9, 10**9 + 10**8)])
    entries = [(f"d{r.randrange(4)}.com", moment(), r.random() < 0.6) for _ in range(60)]
    caps = [(i, f"http://{r.choice(['', 'x.', 'y.x.'])}d{r.randrange(5)}.com/" + "p" * (100_000 if i == 3 else 3), moment()) for i in range(300)]
    caps += [(900 + i, f"http://{d}/", t + k) for i, (d, t, _) in enumerate(entries) for k in (0, -1)]
    as_time = lambda df, c: df.withColumn(c, F.timestamp_seconds(c))
    got = url_filters.listed(as_time(spark.createDataFrame(caps, "i int, url string, fetched long"), "fetched"), as_time(spark.createDataFrame(entries, "domain string, at long, active boolean"), "at"))
    want = []
    for i, url, t in caps:
        host, found = url.split("/")[2], None
        for k in range(host.count(".")):
            d = host.split(".", k)[-1]
            mine = [(at, on) for x, at, on in entries if x == d and at <= t]
            last = max((at for at, _ in mine), default=None)
            if found is None and any(on for at, on in mine if at == last):
                found = d
        want.append((i, found))
    assert Counter(rows_of(got.select("i", "listed_by"))) == Counter(want) and any(x for _, x in want)
    longest = url_filters.in_buckets(spark.createDataFrame([("d", -62_135_596_800_000_000, 1 << 62)], "domain string, since long, until long"))
    assert longest.count() < 200


def test_license_scan(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    GPL = next(t for n, t in license_scan.TEMPLATES if n == "GPL-3.0" and t.startswith("This program"))  # noqa: N806
    rows = [("r/LICENSE", f"{mit}"), ("r/a/x.py", "no words on it"), ("r/a/b/LICENSE.txt", GPL), ("r/a/b/y.py", f"# {apache}\ncode code"), ("r/a/b/c/z.py", "code"), ("r/a/b/c/z.py", "code"), ("other/q.py", "code"), (None, "code"), (None, mit), ("r/n.py", None), ("r/e.py", ""), ("s/LICENSE", "no licence text at all, only talk")]
    got = license_scan.scan(spark.createDataFrame(rows, "path string, text string").withColumns({"licence": F.lit(1), "via": F.lit(2), "given": F.lit(3)}))
    assert Counter(rows_of(got.select("path", "licence", "licence_via", "licence_from"))) == Counter([
        ("r/LICENSE", "MIT", "header", "r/LICENSE"), ("r/a/x.py", "MIT", "inherited", "r/LICENSE"), ("r/a/b/LICENSE.txt", "GPL-3.0", "header", "r/a/b/LICENSE.txt"), ("r/a/b/y.py", "Apache-2.0", "header", "r/a/b/y.py"),
        *[("r/a/b/c/z.py", "GPL-3.0", "inherited", "r/a/b/LICENSE.txt")] * 2, ("other/q.py", None, None, None), (None, None, None, None), (None, "MIT", "header", None), ("r/n.py", "MIT", "inherited", "r/LICENSE"), ("r/e.py", "MIT", "inherited", "r/LICENSE"), ("s/LICENSE", None, None, None),
    ])
    assert license_scan.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def wrapped(text, width, mark=""):
    import textwrap

    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_licences_in_wrapped_headers_and_whole_files(spark):
    mit, bsd = (next(t for n, t in license_scan.TEMPLATES if n == k and len(t) > 900) for k in ("MIT", "BSD-3-Clause"))
    grant, mpl = license_scan._GRANT_MIT, next(t for n, t in license_scan.TEMPLATES if n == "MPL-2.0" and "obtain" in t)
    code = "\n\nint main(void) {\n  return 0;\n}\n"
    rows = [
        ("a/x.c", "/*\n" + wrapped(grant, 70, " * ") + "\n */" + code), ("b/x.c", wrapped(mpl, 60, "// ") + code), ("c/x.py", wrapped("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", 45, "# ") + "\nimport os\nprint(os.name)"),
        ("d/LICENSE", "Copyright 2020 Somebody Unknown\n" + wrapped(bsd, 72)), ("d/deep/er/y.c", "code"), ("e/LICENSE.md", wrapped(mit, 75)), ("f/x.rs", "// SPDX-License-Identifier: Apache-2.0" + code), ("g/x.rs", "// SPDX-License-Identifier: Nobodys-1.0" + code),
        ("h/x.md", "We licensed the picture to a museum under the terms of a contract."), ("i/x.md", "Creative Commons Attribution 4.0 International"), ("j/x.md", "CC BY-NC 4.0"), ("k/x.txt", LONG + "\n" + "word " * 300_000), ("l/LICENSE", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n" + "other words that nobody knows " * 500),
    ]
    got = {r["path"]: (r["licence"], r["licence_via"]) for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {
        "a/x.c": ("MIT", "header"), "b/x.c": ("MPL-2.0", "header"), "c/x.py": ("MPL-2.0", "header"), "d/LICENSE": ("BSD-3-Clause", got["d/LICENSE"][1]), "d/deep/er/y.c": ("BSD-3-Clause", "inherited"), "e/LICENSE.md": ("MIT", got["e/LICENSE.md"][1]),
        "f/x.rs": ("Apache-2.0", "header"), "g/x.rs": (None, None), "h/x.md": (None, None), "i/x.md": ("CC-BY-4.0", "header"), "j/x.md": ("CC-BY-NC-4.0", "header"), "k/x.txt": (None, None), "l/LICENSE": ("GPL-3.0", "header"),
    }


def test_units_left_out_are_below_the_threshold(spark):
    """No run that signs and counts of terms rule out reaches the threshold when its cosine is worked out."""
    r, w = random.Random(9), license_scan.Weights(license_scan.TEMPLATES, 0.6)
    units = []
    for _ in range(400):
        words = r.choice(license_scan.TEMPLATES)[1].split()
        units.append(" ".join(r.sample(words, r.randint(1, len(words))) + r.choices(["zebra", "the", "of", "license", "quux", f"q{r.randrange(99)}"], k=r.choice([0, 1, 3, 9, 30]))))
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(units)], "u string, unit string")
    every = {x["u"] for x in license_scan.unit_verdicts(df, license_scan.TEMPLATES, w, 0.6).collect()}
    asked = {x["u"] for x in w.possible(df.where(F.rlike("unit", F.lit(w.signs)))).collect()}
    assert len(every) > 40 and every <= asked and len(asked) < 400


# -- the pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf)
        assert docs.columns == columns, name
        assert docs.count() <= before.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    check_packing(spark, docs, last)


def test_pipelines_in_two_threads(spark, sf):
    import os
    from concurrent.futures import ThreadPoolExecutor

    import corpus_pipeline
    from weftline.llm._common import scratch

    per_doc = lambda df: Counter(rows_of(df.groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens"))))

    def whole(_):
        with scratch(spark) as paths:
            got = per_doc(corpus_pipeline.run(spark, sf))
            left = [p for p in paths if os.path.exists(p.removeprefix("file:"))]
        return got, len(left), any(os.path.exists(p.removeprefix("file:")) for p in paths)

    with ThreadPoolExecutor(2) as pool:
        results = list(pool.map(whole, range(2)))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    want = per_doc(docs)
    assert all(got == want and 0 < left <= 4 and not after for got, left, after in results)


def test_shared_folder(spark):
    from unittest.mock import patch

    from weftline.llm import _common

    before = spark.sparkContext.getCheckpointDir()
    with _common.scratch(spark) as paths:
        assert _common.materialize(spark.range(3)).count() == 3 and len(paths) == 1
    assert spark.sparkContext.getCheckpointDir() == before
    if not before and not spark.conf.get("spark.checkpoint.dir", None):
        with patch.object(type(spark.sparkContext), "master", "spark://far:7077"), pytest.raises(RuntimeError):
            _common.shared_dir(spark)


def test_pipeline_on_odd_rows(spark, sf):
    import corpus_pipeline

    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({"n_chars": F.length("text").cast("long"), "fp": F.lit(1)})
    empty, unlabelled = docs.limit(0), corpus_pipeline.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), sf)
    assert Counter(rows_of(unlabelled.select("doc_id"))) == Counter((x[0],) for x in ODD if x[0] not in (3, 4, 8))
    for _, stage in corpus_pipeline.STAGES:
        docs, empty = stage(spark, docs, sf), stage(spark, empty, sf)
    assert docs.count() > 0 and empty.count() == 0


# -- the registered queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cursor = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    want = Counter(tuple(plain(r[names.index(x)]) for x in sorted(names)) for r in cursor.fetchall())
    assert Counter(tuple(plain(r[x]) for x in sorted(names)) for r in df.collect()) == want


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    """Tables in which each method's own path is taken: revisits, bad and tiny hosts, licence files, passages of the benchmark."""
    folder, r = tmp_path_factory.mktemp("hard"), random.Random(11)
    prose = lambda n: " ".join(f"{r.choice('bcdfgh')}{r.choice('aeiou')}{r.randrange(900)}" for _ in range(n))
    items = [(i, prose(30)) for i in range(6)] + [(6, "two words"), (7, None), (8, "...")]
    docs, n = [], 0
    for host, good, bad in (("spam", 3, 40), ("fine", 60, 2), ("tiny", 1, 2), ("one", 0, 1), ("mix", 20, 22), ("dup", 8, 30), (None, 2, 3)):
        for i in range(good + bad):
            text = prose(70) if i < good else r.choice([prose(20), "same old words " * 40, None, ""])
            if i < good and i % 4 == 0:
                text = f"{text}\n{items[n % 6][1] if i % 8 else items[n % 6][1][:60]}\n{prose(9)}\nTwo, words!"
            if host == "dup" and i >= good:
                text = "\n".join(["again and again the same line"] * 30 + [prose(60)])
            docs.append((n, text, "en" if n % 2 else None, host))
            n += 1
    licences = [x for _, x in license_scan.TEMPLATES if len(x) > 900]
    for k in range(-(-n // 64) * 64, 1100, 64):  # what the licence query takes for licence files, and their neighbours
        half = (words := r.choice(licences).split(" "))[: len(words) // 2]
        text = wrapped(" ".join(half), 70) + "\n\n" + wrapped(" ".join(words[len(half) :]), 70)
        docs += [(k, text if k % 128 else "Released under the MIT License.", "en", "fine"), (k + 1, prose(60), "en", "fine"), (k + 2, "# SPDX-License-Identifier: ISC\n" + prose(60), "en", "fine")]
    docs = [x for i, x in enumerate(docs) if x[0] not in {y[0] for y in docs[:i]}]
    pages = [(i, r.choice([f"http://h{i % 5}.com/{i}", None, "http://a.h2.com/"]), r.choice(["<p>" + "x" * 1200, "é" * 499, "é" * 500, "z" * 999, "z" * 1000, None, "", f"<b>{i}" * 300])) for i in range(300)]
    for name, rows, schema in (("documents", docs, SCHEMA), ("pages", pages, "page_id long, url string, html string"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql_on_hard_tables(spark, hard, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"create view {t} as select * from '{hard}/{t}.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, hard)
    cursor = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    rows = df.collect()
    want = Counter(tuple(plain(r[names.index(x)]) for x in sorted(names)) for r in cursor.fetchall())
    assert Counter(tuple(plain(r[x]) for x in sorted(names)) for r in rows) == want
    if name == "op1_warc":
        assert 50 < sum(r["record_type"] == "revisit" for r in rows) < 250
    if name == "op2_quality_rules":  # the host's verdict decides for documents that pass by themselves
        assert sum(not r["base_failed"] and not r["kept"] for r in rows) > 3 and sum(r["kept"] for r in rows) > 40
    if name == "op5_decontamination":
        assert 5 < sum(r["contaminated"] for r in rows) < len(rows) - 10 and any(r["n_hit"] and not r["contaminated"] for r in rows)
    if name == "op9_license_scan":
        assert {r["licence_via"] for r in rows} == {"file", "header", "inherited", None}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_has_a_row_for_each_row(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    if name == "op3_packing":
        check_packing(spark, documents(spark, sf), df)
        return
    table = "pages" if name in ("op1_warc", "op6_url_filters") else "documents"
    assert df.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


@pytest.mark.parametrize("size", [12, 90])
def test_near_dedup_stage(spark, sf, odd, size):
    import corpus_pipeline
    from weftline.llm.near_copies import shingles

    rnd = random.Random(size)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    texts = {}
    for i in range(size):  # edits that pile up: the ends of the chain differ
        base[rnd.randrange(200)] = f"x{i}"
        texts[i] = " ".join(base)
    for i in range(size):  # each one by itself: two of these are 0.8 to 0.95 alike
        w = [f"v{k}" for k in range(150)]
        for k in rnd.sample(range(150), rnd.randrange(1, 3)):
            w[k] = f"y{i}.{k}"
        texts[size + i] = " ".join(w)
    docs = spark.createDataFrame([(k, v, "en", "a") for k, v in texts.items()], SCHEMA).repartition(3)
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    sets, root = {k: shingles(v) for k, v in texts.items()}, {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {find(k) for k in texts} and len(got) < size
    left = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, odd, sf).collect()]
    assert len(left) == 8 and sorted(x for x in left if x is not None) == [1, 2, 3, 5, 6, 8, 9]


def near_brute(texts, least=0.8):
    from weftline.llm.near_copies import shingles

    sets, root = {k: shingles(v) for k, v in texts.items()}, {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in range(a):
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(k) for k in texts}


@pytest.mark.parametrize("seed", range(2))
def test_near_copies_of_one_text_in_every_way(spark, seed):
    """Edits, deletions, insertions and cuts of one text and of copies of it: near and not so near ones."""
    from weftline.llm import near_copies

    r = random.Random(seed)
    bases = [[f"w{r.randrange(10**6)}" for _ in range(r.choice([60, 90, 150]))]]
    texts = {}
    for i in range(260):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6])):
            k = r.randrange(len(w))
            how = r.random()
            if how < 0.4:
                w[k] = f"x{i}.{k}"
            elif how < 0.7:
                del w[k]
            elif how < 0.85:
                w.insert(k, f"z{i}")
            else:
                w = w[: len(w) - r.randrange(12)]
        if r.random() < 0.08:
            bases.append(w)  # copies of this copy share its edits
        texts[i] = " ".join(w)
    docs = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id long, text string").repartition(3)
    got = {x["doc_id"] for x in near_copies.one_of_each(docs).collect()}
    assert got == near_brute(texts) and 1 < len(got) < 250


def made(spark, what, after):
    """Rows that nodes of this name made in executions after that one, by node; and the last execution."""
    store = spark._jsparkSession.sharedState().statusStore()
    rows, last, runs = Counter(), after, store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(runs.size())):
        last = max(last, run)
        if run <= after:
            continue
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = node.metrics() if node.name() == what else None
            for m in (metrics.apply(i) for i in range(metrics.size())) if metrics else ():
                if m.name() == "number of output rows" and values.get(m.accumulatorId()).isDefined():
                    rows[node.desc()] += int(values.get(m.accumulatorId()).get().replace(",", ""))
    return rows, last


def test_near_dedup_tells_apart_far_members_in_few_rows(spark):
    """Copies with so many edits of their own that none is near another don't come as a row for each difference."""
    from weftline.llm import near_copies

    r, texts = random.Random(5), {}
    base = [f"w{k}" for k in range(150)]
    for i in range(150):  # a shorter text in the same groups, and many edits
        w = base[: 150 if i % 3 else 90]
        for k in r.sample(range(len(w)), 6 if i % 3 else 2):
            w[k] = f"x{i}.{k}"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    before = made(spark, "Generate", -1)[1]
    assert {x["doc_id"] for x in near_copies.one_of_each(docs).collect()} == near_brute(texts)
    rows = made(spark, "Generate", before)[0]
    most = max(n for what, n in rows.items() if "[a#" in what or "same#" in what and "keys" not in what)
    assert 100 < most < 5000


def test_near_dedup_needs_no_minhash(spark, sf, monkeypatch):
    """By SimHash's blocks alone, copies that are 0.85 alike and more go, far beyond two of 64 bits, and far texts stay."""
    import corpus_pipeline
    from weftline.llm import near_copies

    r, texts = random.Random(11), {}
    for g in range(20):
        base = [f"w{r.randrange(10**6)}" for _ in range(200)]
        for i in range(4):
            w = list(base)
            for k in r.sample(range(200), (0, 2, 3, 60)[i]):  # the last one is far from the others
                w[k] = f"x{g}.{i}.{k}"
            texts[4 * g + i] = " ".join(w)
    shingled = near_copies.signatures
    # MinHash's keys are digests of 64 bits, those of SimHash a choice's number and three bytes.
    monkeypatch.setattr(near_copies, "signatures", lambda c, words=5: (s := shingled(c, words)).withField("keys", F.filter(s["keys"], lambda k: k.between(0, (1 << 32) - 1))))
    docs = spark.createDataFrame([(k, v, "en", "a") for k, v in texts.items()], SCHEMA).repartition(3)
    got = {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    assert near_brute(texts) == {k for k in texts if k % 4 in (0, 3)} <= got
    assert len(got) <= 42  # of 40 copies all but two at most
    apart = [(simhash.fingerprint(texts[4 * g], 5) ^ simhash.fingerprint(texts[4 * g + i], 5)).bit_count() for g in range(20) for i in (1, 2)]
    assert sum(x > 2 for x in apart) > 30


def test_near_dedup_links_by_simhash(spark, sf, monkeypatch):
    """Without any MinHash band, what is within two bits and 0.8 alike is linked all the same, and nothing else."""
    import corpus_pipeline
    from weftline.llm import near_copies

    r, texts = random.Random(3), {}
    base = [f"w{r.randrange(10**6)}" for _ in range(4000)]
    for i in range(30):
        w = list(base)
        for k in r.sample(range(4000), i // 2):
            w[k] = f"x{i}.{k}"
        texts[i] = " ".join(w)
    texts |= {100 + i: f"tiny text{'s' * i}" for i in range(5)}
    texts |= {200: "a b c d e f", 201: " ".join(["a b c d e f"] * 9)}
    shingled = near_copies.signatures
    monkeypatch.setattr(near_copies, "signatures", lambda c, words=5: shingled(c, words).withField("keys", F.array().cast("array<long>")))
    docs = spark.createDataFrame([(k, v, "en", "a") for k, v in texts.items()], SCHEMA).repartition(3)
    got = {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    sets, prints, root = {k: near_copies.shingles(v) for k, v in texts.items()}, {k: simhash.fingerprint(v, 5) for k, v in texts.items()}, {k: k for k in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    assert got == set(root.values()) and len(got) < len(texts) - 3


def test_near_dedup_shares_keys_by_chance_in_proportion(spark, monkeypatch):
    """What shares blocks of a fingerprint by chance doesn't grow with the square of the texts."""
    from weftline.llm import near_copies

    n, choices, kept = 1 << 17, near_copies._CHOICES.tolist(), near_copies.KEPT

    def drawn(c, words=5):
        @F.pandas_udf("same long, size long, keys array<long>, wide array<long>, fp long")
        def of(s):
            ids = s.astype("int64").to_numpy()
            bits = np.random.default_rng(int(ids[0])).integers(0, 1 << 64, (len(ids), 9), np.uint64)
            blocks = np.ascontiguousarray(bits[:, :8]).view(np.uint8)
            keys = np.tile(np.arange(len(choices), dtype=np.int64), (len(ids), 1))
            for b in range(kept):
                keys = keys << 8 | blocks[:, [x[b] for x in choices]]
            return pd.DataFrame({"same": ids + 1, "size": 100, "keys": list(keys), "wide": list(bits[:, :8].view(np.int64)), "fp": bits[:, 8].view(np.int64)})

        return of(c)

    monkeypatch.setattr(near_copies, "signatures", drawn)
    docs = spark.range(0, n, 1, 4).select(F.col("id").alias("doc_id"), F.format_string("%d", "id").alias("text"))
    before = made(spark, "SortMergeJoin", -1)[1]
    assert near_copies.one_of_each(docs).count() == n
    joins = Counter()
    for what in ("SortMergeJoin", "ShuffledHashJoin", "BroadcastHashJoin"):
        joins |= made(spark, what, before)[0]
    rows = [v for k, v in joins.items() if "~k#" in k and "nk#" in k]
    assert rows and n // 16 < max(rows) < n // 4  # 84 choices of 24 bits: 86,000 rows of 131,072 texts


def test_near_dedup_with_longer_keys_loses_no_link(spark, monkeypatch):
    """Keys as long as for very many texts leave more to the bands; the result is the same."""
    from weftline.llm import near_copies

    r, texts = random.Random(17), {}
    for g in range(12):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.choice([60, 150, 400]))]
        for i in range(12):
            w = list(base)
            for k in r.sample(range(len(w)), r.randrange(1 + len(w) // 40)):
                w[k] = f"x{g}.{i}.{k}"
            texts[12 * g + i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert near_copies._further_bits(len(texts)) == 0 and near_copies._further_bits(15 * 10**6) == 9
    for chance in (near_copies.CHANCE, 1e-6, 1e-30):
        monkeypatch.setattr(near_copies, "CHANCE", chance)
        assert {x["doc_id"] for x in near_copies.one_of_each(docs).collect()} == near_brute(texts)


def test_priors_from_small_hosts(spark):
    hosts = [(f"large{i}", 80) for i in range(2) for _ in range(1000)] + [(f"small{i}", 10) for i in range(200) for _ in range(9)]
    measured = spark.createDataFrame([(h, n, 5 * n, 0, 0, 0) for h, n in hosts], "host string, " + quality_rules.STATS)
    kept = {r["host"]: r["host_kept"] for r in quality_rules.host_verdicts(measured, "host").collect()}
    assert len(kept) == 202 and all(v == k.startswith("large") for k, v in kept.items())
    single = spark.createDataFrame([(f"h{i}", 1, *[int(i < 5)] * 4) for i in range(10)], "host string, docs long, " + ", ".join(f"fail_{n} long" for n in quality_rules.RULES))
    assert all(x == pytest.approx((50, 50)) for x in quality_rules.beta_priors(single, list(quality_rules.RULES)).values())


def test_packing_gives_each_source_a_queue(spark):
    docs = spark.createDataFrame([(i, " ".join(f"word{i + j}" for j in range(12)), f"s{i % 300:03d}") for i in range(600)], "doc_id long, text string, source string").orderBy("source").coalesce(3)
    got = packing.pack(docs, queries.TOKENIZER, sequence=16, window=10).collect()
    at = defaultdict(list)
    for r in got:
        at[f"s{r['doc_id'] % 300:03d}"] += range(r["sequence_id"] * 16 + r["offset"], r["sequence_id"] * 16 + r["offset"] + r["length"])
    total = sum(map(len, at.values()))
    assert len(at) == 300 and sorted(x for v in at.values() for x in v) == list(range(total))
    slack = 2 * (160 + 300) / total
    for v in at.values():  # each source's tokens go evenly through the whole stream
        assert all(abs(x / total - j / len(v)) <= slack + 1 / len(v) for j, x in enumerate(sorted(v)))
