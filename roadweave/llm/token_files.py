"""Token-id files: independent zstandard frames with a checksum each, and a trailing seek table, so that a reader decompresses only the
frame that holds the document it wants.

A file is a row of zstandard frames, then a skippable frame with the seek table (for each frame its compressed size, its size and the
low 32 bits of the xxh64 of its content; then the number of frames, a flag byte and a closing magic number). The last frame is the
document index: for each document its id, frame, first byte, byte length and crc32. Ids take 2 bytes where the vocabulary fits, else 4.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, shared_path, small_batches, written

#: Fixed values of the seekable zstandard format.
SKIPPABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80

INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("at", "<u4"), ("length", "<u4"), ("crc32", "<u4")])
#: Parts of stretches that a worker keeps; at the bound they are forgotten and asked for anew.
CACHE_ENTRIES = 600_000
#: A Latin word with marks behind it: it splits into two parts that the tokenizer treats apart.
PLAIN = "^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,;:!?#$%&*()+=-]*)$"


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of values from each start on, one after another."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """The tokenizers library behind a bounded cache of the stretches between white space, which it treats independently.

    Arrow splits a slice of texts, numbers its stretches and cuts plain ones into a word and marks; only parts not met before are
    seen by Python. The ids of all parts lie in one array, from which whole texts are gathered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.width = "<u2" if self.lib.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.clear()

    def clear(self) -> None:
        self.parts = pa.array([], pa.string())
        self.ids, self.starts, self.lengths = np.empty(0, self.width), np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, new: pa.Array) -> None:
        """Asks the library for parts that aren't known."""
        found = [x.ids for x in self.lib.encode_batch_fast(new.to_pylist(), add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.parts = pa.concat_arrays([self.parts, new])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), self.width, int(lengths.sum()))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each text has. A null text has none."""
        split = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        own = words.dictionary
        cut = pc.extract_regex(own, PLAIN)
        word = pc.if_else(cut.is_null(), own, pc.utf8_lower(pc.struct_field(cut, "word")))
        parts = pa.concat_arrays([word, pc.fill_null(pc.struct_field(cut, "marks"), "")]).dictionary_encode()
        place = pc.index_in(parts.dictionary, value_set=self.parts)
        if len(self.parts) + place.null_count > CACHE_ENTRIES:
            self.clear()
            place = pc.index_in(parts.dictionary, value_set=self.parts)
        new = parts.dictionary.filter(place.is_null())
        place = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = len(self.parts) + np.arange(len(new))
        self.learn(new)
        # Of each distinct stretch its word, then its marks; of each stretch of the texts its distinct one.
        both = place[parts.indices.to_numpy()].reshape(2, -1).T.ravel()
        ids, sizes = gathered(self.ids, self.starts[both], self.lengths[both]), self.lengths[both].reshape(-1, 2).sum(axis=1)
        at = words.indices.to_numpy()
        n = sizes[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        return gathered(ids, (np.cumsum(sizes) - sizes)[at], n), np.diff(ends[np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])])


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class TokenFileWriter:
    """Collects documents and closes a frame when it holds frame_bytes. A document lies in one frame."""

    def __init__(self, out, frame_bytes: int = 1 << 18, level: int = 1):
        self.out, self.frame_bytes = out, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.held, self.held_bytes, self.index, self.table = [], 0, [], []

    def add(self, doc_id: int | None, data: bytes) -> None:
        self.index.append((doc_id or 0, doc_id is not None, len(self.table), self.held_bytes, len(data), zlib.crc32(data)))
        self.held.append(data)
        self.held_bytes += len(data)
        if self.held_bytes >= self.frame_bytes:
            self.flush(b"".join(self.held))

    def flush(self, data: bytes) -> None:
        packed = self.pack.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        if self.held:
            self.flush(b"".join(self.held))
        self.flush(np.array(self.index, INDEX).tobytes())
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class TokenFile:
    """Random access to one file. Raises ValueError where a checksum, the table or its magic number doesn't hold."""

    def __init__(self, file, width: str = "<u2"):
        self.file, self.width = file, width
        size = file.seek(0, 2)
        file.seek(max(0, size - 9))
        tail = file.read(9)
        if len(tail) < 9 or struct.unpack("<IBI", tail)[1:] != (WITH_CHECKSUMS, SEEKABLE):
            raise ValueError("no seek table")
        n = struct.unpack("<I", tail[:4])[0]
        file.seek(size - 9 - 12 * n)
        self.table = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        if self.starts[-1] + 8 + 12 * n + 9 != size:
            raise ValueError("the seek table doesn't fit the file")
        self.index = np.frombuffer(self.frame(n - 1), INDEX)

    def frame(self, k: int) -> bytes:
        self.file.seek(int(self.starts[k]))
        data = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.table[k, 0])))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def document(self, row: int) -> np.ndarray:
        """Ids of the document at a row of the index; one frame is read."""
        x = self.index[row]
        data = self.frame(int(x["frame"]))[int(x["at"]) : int(x["at"]) + int(x["length"])]
        if zlib.crc32(data) != x["crc32"]:
            raise ValueError(f"document {row} is damaged")
        return np.frombuffer(data, self.width)

    def find(self, doc_id: int) -> list[np.ndarray]:
        """Ids of each document with this id."""
        return [self.document(int(r)) for r in np.flatnonzero((self.index["doc_id"] == doc_id) & (self.index["known"] == 1))]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order; one frame is held at a time."""
        at, data = -1, b""
        for row in self.index:
            if row["frame"] != at:
                at = row["frame"]
                data = self.frame(int(at))
            part = data[int(row["at"]) : int(row["at"]) + int(row["length"])]
            if zlib.crc32(part) != row["crc32"]:
                raise ValueError("a document is damaged")
            yield int(row["doc_id"]) if row["known"] else None, np.frombuffer(part, self.width)


def write_token_files(docs: DataFrame, tokenizer_path: str, out_dir: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = 1 << 18) -> DataFrame:
    """Encodes whole texts and writes one file for each range of ids; returns the manifest (part, path, width, documents, tokens).

    Ids rise from file to file and within each; null ids come last, and rows with equal ids stand by their text. A null text is
    empty and keeps its end id. out_dir is a URI that every executor reaches. A task writes under a name of its own attempt and
    renames at its end, so a repeated task leaves one whole file. Empty ranges leave no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = encoder(tokenizer_path), TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(out_dir)
        end = b"" if end_id is None else np.array([end_id], own.width).tobytes()
        part, n, tokens, writer = task.partitionId(), 0, 0, None
        path = f"{root}/part-{part:07d}.tok"
        tried = f"{path}.{task.taskAttemptId()}"
        for batch in pieces(batches, text=1):
            if writer is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(tried)
                writer = TokenFileWriter(out, frame_bytes)
            ids, sizes = own.encode(batch.column(1))
            data, at, width = memoryview(ids.tobytes()), 0, ids.itemsize
            for doc_id, size in zip(batch.column(0).to_pylist(), (sizes * width).tolist(), strict=True):
                writer.add(doc_id, bytes(data[at : at + size]) + end)
                at += size
            n += len(sizes)
            tokens += len(ids) + len(sizes) * (len(end) // width)
        if writer:
            writer.close()
            out.close()
            fs.move(tried, path)
            yield pa.RecordBatch.from_pylist([{"part": part, "path": f"part-{part:07d}.tok", "width": own.width, "documents": n, "tokens": tokens}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("width", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    small_batches(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    order = [F.col("doc_id").asc_nulls_last()]
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    return written(ranged.mapInArrow(run, "part int, path string, width string, documents long, tokens long"), "manifest")


def read_token_files(manifest: DataFrame, out_dir: str) -> DataFrame:
    """Each document of the files of a manifest, in ranges of a file each: doc_id, start (ids of all documents before it), n_tokens, ids_crc32
    (of the ids as little-endian unsigned 32-bit integers), part and row in the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out_dir)
        for batch in batches:
            for x in batch.to_pylist():
                at, rows = x["before"], []
                with fs.open_input_file(f"{root}/{x['path']}") as f:
                    for k, (doc_id, ids) in enumerate(TokenFile(f, x["width"]).documents()):
                        rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), x["part"], k))
                        at += len(ids)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("row", pa.int64())])
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # One row a file: the running total is over some hundred bytes for each hundred megabytes of ids.
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("before", before).repartition(n, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, row long")


def token_file_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2) -> DataFrame:
    """Writes token files into the shared folder and reads them back. An empty table leaves no file and gives no rows."""
    out_dir = shared_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, tokenizer_path, out_dir, end_id), out_dir)
