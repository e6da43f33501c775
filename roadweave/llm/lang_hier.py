"""Language identification in two steps: the language family by one linear SVM for each family against the rest, then one-versus-one
linear SVMs between the languages of that family, on hashed character n-grams of whole texts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import pieces, small_batches

DIMS = 1 << 13
#: Rows whose features, 32 kB each, are held at once.
SLICE = 256

#: Families of ISO 639-1 codes. A language that isn't here is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "uralic": ["et", "fi", "hu"],
    "celtic": ["br", "cy", "ga", "gd"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "semitic": ["am", "ar", "he", "mt"],
    "austronesian": ["id", "ms", "tl"],
}


def family_of(lang: str) -> str:
    code = lang.lower().split("-")[0].split("_")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes), f"only {lang}")


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether a code point is a letter, for all there are."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def features(text: str | None) -> np.ndarray | None:
    """Square roots of hashed 1- to 3-gram counts of the lower-cased letters, of unit length; None without a letter. Runs of other
    characters count as one space."""
    if not text:
        return None
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[c]
    if not is_letter.any():
        return None
    c = np.where(is_letter, c, 32)
    keep = is_letter | np.concatenate([[True], is_letter[:-1]])
    c = c[keep].astype(np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
    three = two[:-1] * np.uint32(0x85EBCA6B) + c[2:]
    counts = np.zeros(DIMS)
    for k, grams in enumerate((c[c != 32], two, three)):
        counts += np.bincount((grams * np.uint32(0xC2B2AE35) + np.uint32(k * 0x27D4EB2F)) >> np.uint32(32 - 13), minlength=DIMS)
    v = np.sqrt(counts)
    return (v / np.linalg.norm(v)).astype(np.float32)


def train_svm(x: np.ndarray, positive: np.ndarray, strength: float = 20.0, steps: int = 150) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, classes weighed alike, by accelerated gradient descent."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    w = past = np.zeros(x.shape[1], np.float32)
    rate = 1 / (1 + 4 * strength)
    for k in range(steps):
        ahead = w + (k / (k + 3)) * (w - past)
        short = np.maximum(0, 1 - y * (x @ ahead))
        past, w = w, ahead - rate * (ahead - 2 * strength * (x.T @ (share * short * y)))
    return w


@dataclass
class Model:
    """Learned languages by family, a weight vector for each family, one for each pair of languages of a family."""

    languages: dict[str, list[str]] = field(default_factory=dict)
    families: dict[str, np.ndarray] = field(default_factory=dict)
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and confidence of each row: the family's lead over the next, times the winner's weakest duel in it."""
        sure = lambda m: 1 / (1 + np.exp(-4.0 * m))
        names = list(self.languages)
        margin = np.stack([x @ self.families[f][:-1] + self.families[f][-1] for f in names], axis=1) if len(names) > 1 else np.zeros((len(x), 1), np.float32)
        best = margin.argmax(axis=1)
        if len(names) > 1:
            two = np.sort(margin, axis=1)[:, -2:]
            score = sure(two[:, 1] - two[:, 0])
        else:
            score = np.ones(len(x))
        out = np.empty(len(x), object)
        for k, name in enumerate(names):
            at, langs = np.flatnonzero(best == k), self.languages[name]
            if len(langs) == 1 or not len(at):
                out[at] = langs[0]
                continue
            votes, total, weakest = np.zeros((len(at), len(langs))), np.zeros((len(at), len(langs))), np.full((len(at), len(langs)), np.inf)
            for (i, a), (j, b) in combinations(enumerate(langs), 2):
                w = self.pairs[a, b]
                m = x[at] @ w[:-1] + w[-1]
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                total[:, i] += m
                total[:, j] -= m
                weakest[:, i] = np.minimum(weakest[:, i], m)
                weakest[:, j] = np.minimum(weakest[:, j], -m)
            won = np.lexsort((total, votes), axis=1)[:, -1]
            out[at] = np.array(langs, object)[won]
            score[at] = score[at] * sure(weakest[np.arange(len(at)), won])
        return out.tolist(), score


def fit(docs: DataFrame, learn: Column, rows_a_language: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from a sample of at most rows_a_language labelled rows of each language, those whose hash of id and text is lowest.

    The sample, 32 kB a row, is all that reaches the driver, besides one count for each language. Rows without a letter or a
    language teach nothing.
    """
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("mixed"))
    counts = {r["lang"]: r["count"] for r in docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).count().collect()}
    if not counts:
        return Model()
    # A hash below a bound that lets through somewhat more than is asked; the rest of the choice is among few rows.
    low = F.lit(False)
    for lang, n in counts.items():
        share = min(1.0, (1.3 * rows_a_language + 20) / n)
        low = low | ((F.col("lang") == lang) & (F.col("mixed") <= int(-(2**63) + share * (2**64 - 2**12))))

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, SLICE):
            found = [(a, m, v) for a, t, m in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) if (v := features(t)) is not None]
            yield pa.RecordBatch.from_pydict({"lang": [a for a, _, _ in found], "mixed": [m for _, m, _ in found], "v": [v.astype(np.float16).tobytes() for _, _, v in found]}, schema=pa.schema([("lang", pa.string()), ("mixed", pa.int64()), ("v", pa.binary())]))

    small_batches(docs.sparkSession)
    held = defaultdict(list)
    for r in rows.filter(low).mapInArrow(embed, "lang string, mixed long, v binary").collect():
        held[r["lang"]].append((r["mixed"], bytes(r["v"])))
    if not held:
        return Model()
    labels, vectors = [], []
    for lang in sorted(held):
        for _, v in sorted(held[lang])[:rows_a_language]:
            labels.append(lang)
            vectors.append(np.frombuffer(v, np.float16))
    x, labels = np.stack(vectors).astype(np.float32), np.array(labels, object)
    model = Model()
    for lang in sorted(held):
        model.languages.setdefault(family_of(lang), []).append(lang)
    family = np.array([family_of(lang) for lang in labels], object)
    if len(model.languages) > 1:
        model.families = {f: train_svm(x, family == f) for f in model.languages}
    for langs in model.languages.values():
        for a, b in combinations(langs, 2):
            at = (labels == a) | (labels == b)
            model.pairs[a, b] = train_svm(x[at], labels[at] == a)
    return model


def told(texts: pa.Array, model: Model) -> tuple[list[str], list[float]]:
    """Language and score of each text; `und` and 0 for null, for a text without a letter, and if nothing was learned."""
    found = [features(t) if model.languages else None for t in texts.to_pylist()]
    lang, score, at = ["und"] * len(found), [0.0] * len(found), [k for k, v in enumerate(found) if v is not None]
    if at:
        for k, a, s in zip(at, *model.predict(np.stack([found[k] for k in at])), strict=True):
            lang[k], score[k] = a, float(s)
    return lang, score


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, for each row of docs in place, without a shuffle. Only the text is an input; the whole of it counts.

    lang_pred is `und` with score 0 if the text is null or has no letter, or if nothing was learned. Other columns are left out.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, SLICE):
            lang, score = told(batch.column(1), model)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "lang_pred": lang, "score": score}, schema=pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())]))

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, text_col: str = "text", lang_to: str = "lang_pred", score_to: str = "score") -> DataFrame:
    """docs with the columns lang_to and score_to appended, rows and other columns as they are; names that docs has already are an error."""
    if {lang_to, score_to} & set(docs.columns):
        raise ValueError(f"docs has a column {lang_to} or {score_to} already")
    text = docs.columns.index(text_col)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, SLICE):
            lang, score = told(batch.column(text), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, lang_to, score_to])

    # Columns go in by place: a name with a dot would be taken for a field of a struct.
    names = docs.columns
    return docs.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(run, StructType([*docs.schema.fields, StructField(lang_to, StringType()), StructField(score_to, DoubleType())]))
