"""Language ID in two steps: the family first, then linear SVMs within it, one against one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import col, fresh, ship

#: Families of language codes; a code that isn't here is a family of its own.
FAMILIES = {
    "de": "germanic", "en": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic", "af": "germanic",
    "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "gl": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic", "sr": "slavic", "hr": "slavic", "sl": "slavic",
    "hi": "indic", "bn": "indic", "mr": "indic", "ne": "indic", "fi": "uralic", "et": "uralic", "hu": "uralic", "tr": "turkic", "az": "turkic",
}
DIM = 1 << 13
#: Bytes of a text counted at a time.
BLOCK = 1 << 20
UND = "und"
_LETTER = regex.compile(r"\p{L}")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights): hashed counts of the byte trigrams of a whole text between two spaces, as roots of unit length."""
    b = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").lower() + b" ", np.uint8)
    counts = np.zeros(DIM, np.int64)
    for i in range(0, max(1, len(b) - 2), BLOCK):
        x = b[i : i + BLOCK + 2].astype(np.uint32)
        if len(x) < 3:
            x = np.concatenate([x, np.full(3 - len(x), 32, np.uint32)])
        h = ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 13)
        counts += np.bincount(h, minlength=DIM)
    at = np.flatnonzero(counts)
    return at.astype(np.uint16), np.sqrt(counts[at] / counts.sum()).astype(np.float32)


def train_svm(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 1.0, rounds: int = 30, seed: int = 0) -> np.ndarray:
    """Weights (with a bias last) of a linear SVM for y of -1 and 1 over sparse rows, by dual coordinate descent."""
    rows = [(np.append(at, DIM).astype(np.int64), np.append(v, 1).astype(np.float64)) for at, v in x]
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    top = cost * 0.5 / np.maximum(share, 1e-9)
    alpha, w, norm = np.zeros(len(y)), np.zeros(DIM + 1), [float(v @ v) for _, v in rows]
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            at, v = rows[i]
            g = y[i] * (w[at] @ v) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), top[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w.astype(np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """Families, with their weights one against all; pairs of languages of a family, with theirs."""

    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    family_weights: np.ndarray | None = None
    pair_weights: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    steep: float = 4.0

    @classmethod
    def fit(cls, x: list[tuple[np.ndarray, np.ndarray]], langs: list[str], families: dict[str, str] = FAMILIES) -> Model:
        of = [families.get(v, v) for v in langs]
        m = cls(sorted(set(of)))
        labels, kin = np.array(langs, object), np.array(of, object)
        for f in m.families:
            m.members[f] = sorted(set(labels[kin == f]))
            for a, b in combinations(m.members[f], 2):
                rows = np.flatnonzero((labels == a) | (labels == b))
                m.pair_weights[a, b] = train_svm([x[i] for i in rows], np.where(labels[rows] == a, 1.0, -1.0))
        if len(m.families) > 1:
            m.family_weights = np.stack([train_svm(x, np.where(kin == f, 1.0, -1.0)) for f in m.families])
        return m

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); und and 0 if there is no letter or nothing was learned."""
        if not text or not self.families or not _LETTER.search(text):
            return UND, 0.0
        at, v = features(text)
        p, f = 1.0, self.families[0]
        if self.family_weights is not None:
            odds = _sigmoid(self.steep * (self.family_weights[:, at] @ v + self.family_weights[:, -1]))
            i = int(np.argmax(odds))
            f, p = self.families[i], float(odds[i] / max(odds.sum(), 1e-12))
        langs = self.members[f]
        if len(langs) == 1:
            return langs[0], p
        won = dict.fromkeys(langs, 0.0)
        for a, b in combinations(langs, 2):
            w = self.pair_weights[a, b]
            q = float(_sigmoid(self.steep * (w[at] @ v + w[-1])))
            won[a] += q
            won[b] += 1 - q
        best = max(langs, key=won.__getitem__)
        return best, p * min(1.0, won[best] / (len(langs) - 1))


def fit(docs: DataFrame, per_lang: int = 300, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", families: dict[str, str] = FAMILIES, most_rows: int = 20_000) -> Model:
    """Learns every language from about per_lang labelled documents of it.

    most_rows bounds the whole sample: of more languages than most_rows / per_lang, each
    gives fewer. The sample is drawn by a hash of the id against a threshold from the
    language's count, so that no rows are shuffled; sparse features, not texts, come to the
    driver. Rows without language or text, or with a text without a letter, are not learned
    from. An empty table gives a model that says und of everything.
    """
    ship(docs.sparkSession)
    known = docs.where(col(lang_col).isNotNull())
    counts = {r["l"]: r["n"] for r in known.groupBy(col(lang_col).alias("l")).agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return Model()
    each = max(1, min(per_lang, most_rows // len(counts)))
    bound = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1 << 20, -(-each * (1 << 20) // n)))])[col(lang_col)]
    share = F.pmod(F.xxhash64(F.lit("sample"), col(id_col)), F.lit(1 << 20))
    known = known.where((share < bound) & col(text_col).isNotNull()).select(col(id_col).alias("id"), col(text_col).alias("text"), col(lang_col).alias("lang"))

    def featured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf = pdf[[bool(_LETTER.search(t)) for t in pdf["text"]]]
            found = [features(t) for t in pdf["text"]]
            yield pd.DataFrame({"lang": pdf["lang"], "id": pdf["id"].astype(str), "places": [x.tobytes() for x, _ in found], "weights": [x.tobytes() for _, x in found]})

    rows = sorted(known.mapInPandas(featured, "lang string, id string, places binary, weights binary").limit(4 * max(most_rows, len(counts))).collect(), key=lambda r: (r["lang"], r["id"], bytes(r["weights"])))
    if not rows:
        return Model()
    return Model.fit([(np.frombuffer(r["places"], np.uint16), np.frombuffer(r["weights"], np.float32)) for r in rows], [r["lang"] for r in rows], families)


def predicted(c: Column, model: Model, spark) -> Column:
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield pd.DataFrame([sent.value.predict(x) for x in s], columns=["lang_pred", "score"])

    return of(c)


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, replacing columns of these names.

    Texts that are null, empty or without a letter are und with score 0, and so are all if
    nothing was learned. Texts of any length are read as a whole; repeated rows are told
    each and alike, of equal votes the first language in order wins. An empty table gives an
    empty table.
    """
    ship(docs.sparkSession)
    own = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    (p,) = fresh(docs, "_p")
    return docs.select(*[col(c) for c in own], predicted(col(text_col), model, docs.sparkSession).alias(p)).select(*[col(c) for c in own], f"{p}.lang_pred", f"{p}.score")


def held_out(id_col: str = "doc_id", mod: int = 5, rest: int = 0) -> Column:
    """Whether crc32 of the id as text leaves this remainder; of a null id it doesn't."""
    return F.coalesce(F.crc32(F.encode(col(id_col).cast("string"), "UTF-8")) % mod == rest, F.lit(False))
