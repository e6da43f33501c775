"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked list of symbols.

Reads a tokenizer file whose normalizer is NFC, white space to a space and lower case, whose text is split by one pattern into
byte-level words with a word-end suffix, and which has no decoder (decoding then puts a space between vocabulary strings).
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import pieces, small_batches

#: Chunks and words kept by a worker; at the bound they are forgotten and built anew.
CACHE_ENTRIES = 250_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def merge_symbols(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Applies merges by rank, leftmost first among equals. Entries whose symbols have changed since they were queued are skipped."""
    last = len(symbols) - 1
    if last < 1:
        return symbols
    symbols = list(symbols)
    left, right = list(range(-1, last)), [*range(1, last + 1), -1]
    queue = [(ranks[p], i, p) for i in range(last) if (p := (symbols[i], symbols[i + 1])) in ranks]
    heapq.heapify(queue)
    while queue:
        _, i, (a, b) = heapq.heappop(queue)
        j = right[i]
        if j < 0 or symbols[i] != a or symbols[j] != b:
            continue  # stale
        symbols[i], symbols[j] = a + b, ""
        after = right[i] = right[j]
        right[j] = -1
        if after >= 0:
            left[after] = i
            if (p := (symbols[i], symbols[after])) in ranks:
                heapq.heappush(queue, (ranks[p], i, p))
        if (before := left[i]) >= 0 and (p := (symbols[before], symbols[i])) in ranks:
            heapq.heappush(queue, (ranks[p], before, p))
    return [s for s in symbols if s]


class Codec:
    """Encodes and decodes by one tokenizer file. Words and chunks met before come from bounded caches."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = token
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.library = Tokenizer.from_file(path)
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.bytes = byte_symbols()
        self.known_words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {"": b""}

    def word(self, word: str) -> bytes:
        """Ids of one word, given as the characters that stand for its bytes, as little-endian unsigned 32-bit integers."""
        if (ids := self.known_words.get(word)) is None:
            symbols = list(word)
            symbols[-1] += self.suffix
            ids = np.array([self.vocab[s] for s in merge_symbols(symbols, self.ranks) if s in self.vocab], "<u4").tobytes()
            if len(self.known_words) >= CACHE_ENTRIES:
                self.known_words.clear()
            self.known_words[word] = ids
        return ids

    def chunk(self, chunk: str) -> bytes:
        """Ids of a stretch of text between spaces or line ends: no word, no merge and no special token reaches over those."""
        out = []
        for part in self.special_split.split(chunk) if self.special_split else [chunk]:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                out += map(self.word, self.split(part))
        return b"".join(out)

    def split(self, part: str) -> list[str]:
        """The words of a stretch. Its letters are told apart here where they are Latin; for all others the library's own normalizer
        and pattern are asked, as versions of Unicode differ in what they call a letter."""
        if max(part) < "\u0250":
            plain = unicodedata.normalize("NFC", part).lower()
            return ["".join([self.bytes[b] for b in w.encode()]) for w in self.words.findall(plain)]
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of a whole text; none for null."""
        known, out = self.known, []
        if len(known) >= CACHE_ENTRIES:
            known.clear()
        for c in (text or "").replace("\n", " ").split(" "):
            ids = known.get(c)
            if ids is None:
                ids = self.chunk(c)
                if len(c) <= 64:
                    known[c] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Vocabulary strings with a space between them, special tokens included."""
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


@lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Each text encoded and decoded: n_tokens, sha256 of the ids and of the decoded text; with keep_ids the ids and the text too.

    One row for each row of docs, repeated ids included. A null or empty text has no tokens and decodes to "". No shuffle: texts
    stay where they are read. Other columns are left out. path must lead to the tokenizer file on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in pieces(batches, text=1):
            rows = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if keep_ids else {})
            for text in batch.column(1).to_pylist():
                ids = own.encode(text)
                decoded = own.decode(ids)
                rows["n_tokens"].append(len(ids))
                rows["ids_sha256"].append(sha256(ids.tobytes()).hexdigest())
                rows["decoded_sha256"].append(sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    rows["ids"].append(ids.tolist())
                    rows["decoded"].append(decoded)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | rows, schema=schema)

    small_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int64())), ("decoded", pa.string())] if keep_ids else []))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * keep_ids)
