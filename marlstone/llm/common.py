"""Shared plumbing of the training-data operators: scratch folders, tables, Arrow batches, token caches."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; bounds what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20
_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _fallback:
            _fallback.append(tempfile.mkdtemp(prefix="marlstone-"))
            atexit.register(shutil.rmtree, _fallback[0], ignore_errors=True)
        found = "file://" + _fallback[0]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/marlstone/{tag}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system, whatever its scheme."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches small, as texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, columns: list[str], schema: str, start: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """One output row for each input row through Arrow batches; start() runs once per task and returns the row function."""
    bounded_batches(df.sparkSession)
    names = [part.split()[0] for part in schema.split(",")]
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = start()
        for batch in batches:
            if batch.num_rows:
                got = [row(*values) for values in zip(*(batch.column(i).to_pylist() for i in range(len(columns))), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(col, type=arrow.field(n).type) for n, col in zip(names, zip(*got, strict=True), strict=True)], names=names)

    return df.select(*columns).mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Python's view of a shared folder: file, hdfs, s3 and gs schemes."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def spread(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small driver-side list, one task for each row."""
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), kind)


#: The pre-tokenizing patterns of the two files, with their character classes spelled out for U+0000 to U+017F.
LETTERS, NUMBERS, BLANKS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
SPACED = re.compile(f"{ENDINGS}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
WORDS = re.compile(f"{ENDINGS}|[{LETTERS}]+|[{NUMBERS}]|[^{BLANKS}{LETTERS}{NUMBERS}]+")
BLANK_SPACE = [f"{c} " for c in "\t\n\x0b\x0c\r \x85\xa0"]
BEYOND = re.compile("[^\x00-\u012f\u0131-\u017f]")


#: One character of each kind that the patterns tell apart, and all others up to U+017F beside them.
KINDS = ["a", "Z", "\u00e9", "7", "\u00b2", " ", "\n", "\t", "\u00a0", "\x85", ".", "'", "-", "\u00b4", "s", "\x1f", "\x00"]


class TokenCache:
    """Ids of whole texts by a `tokenizers` file, as little-endian bytes of `dtype` (16 bits, or 32 for large vocabularies).

    A text is cut where the tokenizer's own pattern cuts it, and each piece is encoded once and remembered, as is
    each sequence of pieces between spaces (at most `limit` of both). spaced: the pattern joins a space to the following word (byte-level files);
    otherwise letters are lower-cased and white space is dropped. Whether the pattern is the file's own is tried on
    all triples of KINDS and on every character; with another file's pattern all texts go to the tokenizer whole.
    So do texts with characters beyond Latin letters, whose classes differ between libraries, and texts that hold
    an added token's content (in any case), which the tokenizer finds before it cuts.
    """

    def __init__(self, path: str, spaced: bool, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.spaced, self.limit = spaced, limit
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.sign = os.path.commonprefix(self.added)
        self.model = self.tokenizer.model
        self.alphabet = {k: self._spelt(chr(k)) for k in range(0x180) if not BEYOND.search(chr(k))}
        self.known: dict[str, bytes] = {}  # by pieces
        self.words: dict[str, bytes] = {}  # by what stands between spaces
        self.cuts = True
        tries = ["".join(x) for x in product(KINDS, repeat=3)] + [f"a{c}{c}b {c}c 1{c}" for c in map(chr, range(0x180)) if not BEYOND.search(c)]
        own = self.tokenizer.encode_batch(tries, add_special_tokens=False)
        self.cuts = all(self(t) == np.array(e.ids, self.dtype).tobytes() for t, e in zip(tries, own, strict=True))

    def _spelt(self, char: str) -> str:
        """A character as the tokenizer hands it to its model: normalised, in a byte-level file's letters."""
        normal, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        char = normal.normalize_str(char) if normal else char
        return "".join(part for part, _ in cut.pre_tokenize_str(char)) if cut else char

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.dtype.char}", *ids)

    def _fresh(self, piece: str) -> bytes:
        """Ids of one piece, by the file's model alone, as the piece is cut already."""
        return self._bytes([token.id for token in self.model.tokenize(piece.translate(self.alphabet))])

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        lower = text.lower()
        if not self.cuts or not text.isascii() and BEYOND.search(text) or self.sign in lower and any(content in lower for content in self.added):
            return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self.known) > self.limit:
            self.known.clear()
        if not self.spaced:
            return self._chunks(lower.split(" "), "")
        if any(blank in text for blank in BLANK_SPACE):
            return self._pieces(text)
        first, *rest = text.split(" ")
        return self._pieces(first) + self._chunks(rest, " ")

    def _chunks(self, chunks: list[str], before: str) -> bytes:
        """Ids of what stands between spaces, each with its space in `before`. A space that follows no blank always begins a piece."""
        known = self.words
        if len(known) > self.limit:
            known.clear()
        got = list(map(known.get, chunks))
        if None in got:
            new = {c: self._pieces(before + c) for c, ids in zip(chunks, got, strict=True) if ids is None}
            got = [new[c] if ids is None else ids for c, ids in zip(chunks, got, strict=True)]
            known.update((c, ids) for c, ids in new.items() if len(c) < 100)
        return b"".join(got)

    def _pieces(self, text: str) -> bytes:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        got = []
        for p in (SPACED if self.spaced else WORDS).findall(text):
            ids = known.get(p)
            if ids is None:
                ids = self._fresh(p)
                if len(p) < 100:
                    known[p] = ids
            got.append(ids)
        return b"".join(got)


@lru_cache(4)
def token_cache(path: str, spaced: bool) -> TokenCache:
    """One for each Python worker, kept between tasks."""
    return TokenCache(path, spaced)


@lru_cache(1)
def word_hashes(limit: int = 500_000) -> Callable[[list], np.ndarray]:
    """A function from words (text or UTF-8) to stable 64-bit hashes, remembered for at most `limit` words."""
    import xxhash

    known: dict[str, int] = {}

    def hashes(words: list) -> np.ndarray:
        if len(known) > limit:
            known.clear()
        get = known.get
        got = [get(w) for w in words]
        if None in got:
            for i, h in enumerate(got):
                if h is None:
                    got[i] = known[words[i]] = xxhash.xxh64_intdigest(words[i])
        return np.array(got, np.uint64)

    return hashes


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of n words; a shorter sequence is one run; none for no words."""
    if not len(hashes):
        return hashes
    size = max(1, len(hashes) - n + 1)
    run = np.full(size, len(hashes) if len(hashes) < n else n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(n, len(hashes))):
            run = mix(run * np.uint64(0xA24BAED4963EE407) + hashes[j : j + size])
    return run


def crc32_text(col: str) -> object:
    """crc32 of an id written as text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))
