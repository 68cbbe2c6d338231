"""Token-id files: each document compressed by itself with a shared zstandard dictionary, and an offset index.

Layout of a file: magic, dictionary hash (32 bytes), bytes of an id (one byte), then one zstandard frame for each document's ids
(little-endian unsigned 16-bit, or 32-bit where the vocabulary is larger), then the index (doc_id, frame's end, number of ids: three 64-bit integers a
document), then the number of documents and the magic again. The dictionary lies beside the files under
its hash. The manifest, a Parquet table written by Spark's committer, names the files that count: a lost
or repeated task leaves a file that no manifest names.

Defined results: null text counts as empty (the end id alone); null doc_id sorts first and reads back as null;
repeated doc_ids keep all their rows, in order of text hash; an empty table gives a manifest without files.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drop_path, file_system, scratch, spread, token_cache

MAGIC, NO_ID = b"MTOKENS1", -(1 << 63)
INDEX = np.dtype([("doc_id", "<i8"), ("end", "<u8"), ("n", "<u8")])
HEAD = len(MAGIC) + 32 + 1
#: Bytes of text for one file, and bytes that a scan reads at once.
FILE_BYTES, CHUNK = 64 << 20, 4 << 20


@dataclass(frozen=True)
class TokenStore:
    path: str
    dictionary: str
    files: list[tuple[int, str, int, int]]  # number, name, documents, ids


def train(docs: DataFrame, tokenizer_path: str, end_id: int, samples: int = 1_000, longest: int = 20_000, size: int = 64 << 10) -> bytes:
    """A dictionary from at most `samples` documents of at most `longest` code points, those of least id hash.

    It only shapes the files' size: every id of every document is stored. Too few samples give a raw-content
    dictionary, and none at all an empty one.
    """
    import zstandard

    cache = token_cache(tokenizer_path, False)
    end = np.array([end_id], cache.dtype).tobytes()
    short = docs.where(F.length("text") <= longest)
    found = [cache(r.text) + end for r in short.orderBy(F.xxhash64("doc_id", "text")).select("text").limit(samples).toLocalIterator()]
    try:
        return zstandard.train_dictionary(size, found).as_bytes()
    except zstandard.ZstdError:
        return b"".join(found)[-size:]


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, parts: int | None = None) -> TokenStore:
    """Write all documents in ascending doc_id order; files follow one another in that order.

    There are as many files as the texts' bytes ask for, and at least spark.sql.shuffle.partitions.
    """
    import zstandard

    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or scratch(spark, "tokens")
    dictionary = train(docs, tokenizer_path, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    fs, root = file_system(path)
    fs.create_dir(f"{root}/data", recursive=True)
    with fs.open_output_stream(f"{root}/{digest}.dict", compression=None) as out:
        out.write(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = token_cache(tokenizer_path, False)
        wide = cache.dtype.itemsize
        end = np.array([end_id], cache.dtype).tobytes()
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
        name, index, at, total, sink = f"{uuid.uuid4().hex}.tok", [], HEAD, 0, None
        fs, root = file_system(path)
        for batch in batches:
            if sink is None:
                sink = fs.open_output_stream(f"{root}/data/{name}", compression=None)
                sink.write(MAGIC + bytes.fromhex(digest) + bytes([wide]))
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = cache(text) + end
                frame = press.compress(raw)
                sink.write(frame)
                at += len(frame)
                total += len(raw) // wide
                index.append((NO_ID if doc_id is None else doc_id, at, len(raw) // wide))
        if sink is not None:
            sink.write(np.array(index, INDEX).tobytes() + struct.pack("<Q", len(index)) + MAGIC)
            sink.close()
            number = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"number": [number], "file": [name], "documents": [len(index)], "ids": [total]})

    if not parts:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(run, "number long, file string, documents long, ids long").write.parquet(f"{path}/manifest")
    return open_store(spark, path)


def open_store(spark: SparkSession, path: str) -> TokenStore:
    """The files that the manifest names: one row for each file, in order."""
    rows = spark.read.schema("number long, file string, documents long, ids long").parquet(f"{path}/manifest").orderBy("number").collect()
    fs, root = file_system(path)
    import pyarrow.fs as pafs

    found = [f.base_name for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".dict")]
    return TokenStore(path, found[0].removesuffix(".dict"), [tuple(r) for r in rows])


class TokenFile:
    """One file: the index is read once; then single documents or all of them."""

    def __init__(self, path: str, name: str, digest: str):
        import zstandard

        fs, root = file_system(path)
        with fs.open_input_file(f"{root}/{digest}.dict") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).hexdigest() != digest:
            raise ValueError("the dictionary is not the one of the store")
        self.file = fs.open_input_file(f"{root}/data/{name}")
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        head = self.file.read_at(HEAD, 0)
        if tail[8:] != MAGIC or head[:-1] != MAGIC + bytes.fromhex(digest):
            raise ValueError(f"{name} is no whole token file of this dictionary")
        (n,) = struct.unpack("<Q", tail[:8])
        self.wide = head[-1]
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, size - 16 - n * INDEX.itemsize), INDEX)
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def __len__(self) -> int:
        return len(self.index)

    def _ids(self, frame: bytes, k: int) -> np.ndarray:
        return np.frombuffer(self.unpack.decompress(frame, max_output_size=self.wide * int(self.index["n"][k])), f"<u{self.wide}")

    def ids(self, k: int) -> np.ndarray:
        """One document, by its own range."""
        start = int(self.index["end"][k - 1]) if k else HEAD
        return self._ids(self.file.read_at(int(self.index["end"][k]) - start, start), k)

    def scan(self) -> Iterator[np.ndarray]:
        """All documents in order, from reads of CHUNK bytes or one document, whichever is more."""
        ends = self.index["end"].astype(np.int64)
        at, k = HEAD, 0
        while k < len(ends):
            last = max(k + 1, int(np.searchsorted(ends, at + CHUNK, "right")))
            raw, base = self.file.read_at(int(ends[last - 1]) - at, at), at
            for k in range(k, last):
                yield self._ids(raw[at - base : int(ends[k]) - base], k)
                at = int(ends[k])
            k = last


def read_tokens(spark: SparkSession, store: TokenStore) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and the digest of the ids, one task for each file."""
    rows, base = [], 0
    for _, name, _, ids in store.files:
        rows.append((name, base))
        base += ids
    path, digest = store.path, store.dictionary
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file, out = TokenFile(path, name, digest), []
                for k, ids in enumerate(file.scan()):
                    doc_id = int(file.index["doc_id"][k])
                    out.append((None if doc_id == NO_ID else doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == 10_000 or k == len(file) - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        out = []

    return spread(spark, rows, "name string, base long").mapInArrow(run, schema)


def remove(spark: SparkSession, store: TokenStore) -> None:
    drop_path(spark, store.path)
