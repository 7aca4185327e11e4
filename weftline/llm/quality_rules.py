"""Quality rules by document and by host, with rates shrunk by an empirical beta prior."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import col, fresh, materialize, ship

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_WORD_LINE = re.compile(r"[^\x20\x09-\x0D]")

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words in windows of `size` words that the text holds twice or more, the first included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    if len(number) ** size < 1 << 62:
        key = ids[:n].copy()
        for k in range(1, size):
            key = key * len(number) + ids[k : n + k]
    else:
        key = np.unique(np.stack([ids[k : n + k] for k in range(size)]), axis=1, return_inverse=True)[1].reshape(-1)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.zeros(len(words), bool)
    for k in range(size):
        hit[k : n + k] |= again
    return int(hit.sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text; null: zeros."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, BLANKS))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if _WORD_LINE.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeat_words(words)


def stats(c: Column) -> Column:
    @F.pandas_udf(STATS)
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield pd.DataFrame([text_stats(x) for x in s], columns=[x.split()[0] for x in STATS.split(", ")], dtype="int64")

    return of(c)


#: Rules of a document whose failures count against its host, over the columns of STATS.
RULES = {
    "base": "n_words < 50 OR 100 * n_repeat_words > 50 * n_words",
    "symbols": "n_words > 0 AND 10 * n_symbols > 3 * n_words",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)",
    "lines": "n_dup_lines > 20",
}


def beta_priors(hosts: DataFrame, rules: list[str]) -> dict[str, tuple[float, float]]:
    """(alpha, beta) of each rule by the method of moments over all hosts.

    A rate over n documents varies by m (1 - m) (r + (1 - r) / n), where r = 1 / (1 +
    alpha + beta) is what hosts differ by themselves. Fewer than two hosts, hosts of one
    document only, or rates no wider than chance: one document's worth for each percent, 100.
    """
    asked = [F.sum("docs").alias("d"), F.count(F.lit(1)).alias("n"), F.avg(1 / F.col("docs")).alias("inv")]
    for name in rules:
        rate = F.col(f"fail_{name}") / F.col("docs")
        asked += [F.sum(f"fail_{name}").alias(f"f_{name}"), F.avg(rate).alias(f"m_{name}"), F.var_samp(rate).alias(f"v_{name}")]
    r, out = hosts.agg(*asked).first(), {}
    for name in rules:
        overall = ((r[f"f_{name}"] or 0) + 0.5) / ((r["d"] or 0) + 1)
        mean = min(max(r[f"m_{name}"] if r["n"] else overall, 1e-6), 1 - 1e-6)
        strength = 100.0
        if r["n"] > 1 and r["inv"] < 1:
            own = (r[f"v_{name}"] / (mean * (1 - mean)) - r["inv"]) / (1 - r["inv"])
            if own > 0:
                strength = min(max(1 / own - 1, 1.0), 10_000.0)
        out[name] = mean * strength, (1 - mean) * strength
    return out


def host_verdicts(measured: DataFrame, host_col: str, rules: dict[str, str] = RULES, most: float = 0.5) -> DataFrame:
    """(host, docs, and for each rule its failures and shrunk rate, host_kept) over STATS columns.

    A host is rejected if the shrunk failure rate of a rule is above `most`. The null
    host is nobody's and is left out.
    """
    fails = [F.sum(F.expr(f"CASE WHEN {rule} THEN 1 ELSE 0 END")).alias(f"fail_{name}") for name, rule in rules.items()]
    hosts = materialize(measured.where(col(host_col).isNotNull()).groupBy(col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("docs"), *fails))
    for name, (a, b) in beta_priors(hosts, list(rules)).items():
        hosts = hosts.withColumn(f"rate_{name}", (F.col(f"fail_{name}") + a) / (F.col("docs") + a + b))
    return hosts.withColumn("host_kept", F.greatest(*[F.col(f"rate_{n}") for n in rules], F.lit(0.0)) <= most)


def host_filtered(docs: DataFrame, text_col: str = "text", host_col: str = "source", rules: dict[str, str] = RULES, most: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """docs with the columns of STATS, base_failed and kept, replacing columns of these names.

    keep: the columns of docs to return (None: all); what is returned is written once to
    the shared folder, so leave out texts that aren't needed.

    kept is false if the document fails the base rule or its host is rejected. Hosts
    without a verdict (null) reject nothing. Null and empty texts have no words and fail.
    Repeated rows count each. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    names = [x.split()[0] for x in STATS.split(", ")]
    own = [c for c in docs.columns if c.lower() not in {*names, "base_failed", "kept"} and (keep is None or c in keep)]
    s, h, bad_host = fresh(docs, "_stats", "_host", "_bad_host")
    host = col(host_col) if host_col in docs.columns else F.lit(None).cast("string")
    measured = materialize(docs.select(*[col(c) for c in own], host.alias(h), stats(col(text_col)).alias(s)).select(*[col(c) for c in own], h, f"{s}.*"))
    bad = host_verdicts(measured, h, rules, most).where("NOT host_kept").select(F.concat(F.lit("h:"), F.col("host").cast("string")).alias(bad_host))
    # On another expression than the aggregate's key: a host with a third of the rows can be split.
    joined = measured.join(bad, F.concat(F.lit("h:"), F.col(h).cast("string")) == F.col(bad_host), "left")
    failed = F.expr(rules.get("base", "false"))
    return joined.select(*[col(c) for c in own], *names, failed.alias("base_failed"), (~failed & F.col(bad_host).isNull()).alias("kept"))
