"""Quality rules by distribution divergence: a document's histograms of character classes and of common words against those of each
language, by Jensen-Shannon distance, with least lengths below which a distance says nothing."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches, written

CLASSES = ("lower", "upper", "other letter", "digit", "space", "line end", "stop", "symbol", "other")
STOPS, SYMBOLS, SPACES = ".,;:!?'\"()-", "#*$%&|<>", " \t\n\v\f\r"
COMMON_WORDS = 64
#: A common word makes up at least one in this many words of its language, so few words are candidates.
RARE = 2000
FLUSH = 200_000


@lru_cache(1)
def class_table() -> np.ndarray:
    def of(c: str) -> str:
        if c == "\n":
            return "line end"
        if c.isspace():
            return "space"
        if c.isascii() and c.isalpha():
            return "lower" if c.islower() else "upper"
        return "other letter" if c.isalpha() else "digit" if c.isdigit() else "stop" if c in STOPS else "symbol" if c in SYMBOLS or (c.isascii() and c.isprintable()) else "other"

    return np.array([CLASSES.index(of(chr(c))) for c in range(1 << 16)], np.uint8)


def class_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.bincount(class_table()[np.minimum(points, 0xFFFF)], minlength=len(CLASSES))


def words_of(text: str) -> list[bytes]:
    """Words between U+0020 and U+0009 to U+000D, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def repeat_words(words: list[bytes], window: int = 8) -> int:
    """Words that lie in a window found twice or more. Windows get exact ranks by doubling; texts without enough repeated pairs stop early."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    code = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    if len(seen) == n:
        return 0
    width = 1
    while width < window:
        _, code, times = np.unique(code[:-width] * n + code[width:], return_inverse=True, return_counts=True)
        width *= 2
        again = times[code] > 1
        if not again.any():
            return 0
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def base_counts(text: str | None) -> tuple[list[bytes], tuple[int, int, int, int, int]]:
    """Words, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return [], (0, 0, 0, 0, 0)
    words = words_of(text)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return words, (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2, of two histograms: 0 to 1; 1 where one is empty."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, d / 2)))


@dataclass
class Reference:
    """Of one language: counts of character classes; common words, and their counts with that of all other words last."""

    lang: str
    classes: np.ndarray
    words: list[bytes]
    counts: np.ndarray


@dataclass(frozen=True)
class Limits:
    """Distances above which a document goes, and the least lengths at which each is looked at."""

    classes: float = 0.25
    words: float = 0.4
    least_chars: int = 400
    least_words: int = 100


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[Reference]:
    """Histograms of each language over all its documents. Rows with a null text or language add nothing.

    Tasks send partial counts; words under one in RARE of their language are left behind before anything reaches the driver, which
    gets at most RARE rows a language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        words: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(a, "c", str(k), n) for (a, k), n in counts.items()] + [(a, "w", w.decode("utf-8", "replace"), n) for a, c in words.items() for w, n in c.items()]
            counts.clear()
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)] if rows else [pa.array([], t) for t in (pa.string(), pa.string(), pa.string(), pa.int64())], names=["lang", "kind", "key", "n"])

        for batch in pieces(batches, text=0):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, n in enumerate(class_counts(text).tolist()):
                    if n:
                        counts[lang, k] += n
                own = words_of(text.lower())
                words.setdefault(lang, Counter()).update(own)
                counts[lang, "words"] += len(own)
            if sum(map(len, words.values())) > FLUSH:
                yield out()
        yield out()

    small_batches(docs.sparkSession)
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counted = rows.mapInArrow(run, "lang string, kind string, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    counted = written(counted, "histograms")
    small = counted.filter(F.col("kind") == "c").collect()
    sizes = {r["lang"]: r["n"] for r in small if r["key"] == "words"}
    often = F.lit(False)
    for lang, n in sizes.items():
        often = often | ((F.col("lang") == lang) & (F.col("n") * RARE >= n))
    common = counted.filter((F.col("kind") == "w") & often).collect()
    found = []
    for lang in sorted(sizes):
        classes = np.zeros(len(CLASSES))
        for r in small:
            if r["lang"] == lang and r["key"] != "words":
                classes[int(r["key"])] = r["n"]
        top = sorted((-r["n"], r["key"]) for r in common if r["lang"] == lang)[:COMMON_WORDS]
        counts = [-n for n, _ in top]
        found.append(Reference(lang, classes, [w.encode() for _, w in top], np.array([*counts, sizes[lang] - sum(counts)], float)))
    return found


def judge(docs: DataFrame, refs: list[Reference], limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base counts of each row, and kept: false if base_failed, else whether some language is near enough in both histograms.

    A null or empty text has no words, fails the base rules and goes. The language is the one nearest in the sum of both
    distances; texts under the least lengths aren't held against a distance, and none are if there is no reference. Other columns
    are left out; no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [{w: k for k, w in enumerate(r.words)} for r in refs]
        for batch in pieces(batches, text=1):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, base = base_counts(text)
                failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
                lang, near, far = None, None, None
                if words and refs:
                    classes, seen = class_counts(text), Counter(words_of(text.lower()))
                    best = []
                    for r, place in zip(refs, places, strict=True):
                        hist = np.zeros(len(place) + 1)
                        for w in place.keys() & seen.keys():
                            hist[place[w]] = seen[w]
                        hist[-1] = len(words) - hist.sum()
                        best.append((distance(classes, r.classes), distance(hist, r.counts), r.lang))
                    near, far, lang = min(best, key=lambda x: x[0] + x[1])
                kept = not failed and (lang is None or ((len(text) < limits.least_chars or near <= limits.classes) and (len(words) < limits.least_words or far <= limits.words)))
                rows.append((doc_id, *base, failed, kept, lang, near, far))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    small_batches(docs.sparkSession)
    long, real = pa.int64(), pa.float64()
    schema = pa.schema([(n, long) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("nearest", pa.string()), ("class_distance", real), ("word_distance", real)])
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, nearest string, class_distance double, word_distance double"
    )
