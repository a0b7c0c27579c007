"""Token ids in raw binary shards, with a minimal perfect hash index from document keys to their place.

A store is a folder with, for shard NNNNN,

* ``shard-NNNNN.bin``: the ids alone, little-endian, 2 bytes each where the vocabulary allows, else 4;
* ``shard-NNNNN.idx``: header, keys, and where each document begins, in file order;
* ``shard-NNNNN.mph``: the minimal perfect hash over the shard's keys, with a fingerprint and a row for each slot;

and ``manifest``, a Parquet table of the shards in key order. Shards hold disjoint key ranges, so a key's shard
is found in the manifest and its place by one probe of the hash.
"""

from __future__ import annotations

import gc
import json
import os
import re
import string
import struct
import uuid
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import byte_letters
from .common import partitions_for, shared_dir, words

MAGIC = b"CFTOK\x00\x00\x01"
#: Distinct words that each of a Python worker's two generations keeps.
CACHE = 400_000
#: Text bytes in a shard, roughly.
SHARD_BYTES = 64 << 20


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 hash bits for each 64-bit key (the splitmix64 finaliser)."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """Distinct 64-bit keys to 0..n-1, by levels of bit arrays that keep the keys without a collision.

    ``words`` has all levels' bits and ``before`` the set bits before each word. What 32 levels do not place
    (practically never) is in ``rest``, sorted.
    """

    sizes: list[int] = field(default_factory=list)
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    before: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    rest: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        left, sizes, parts = keys.astype(np.int64), [], []
        while len(left) and len(sizes) < 32:
            size = -(-max(64, int(gamma * len(left))) // 64) * 64
            at = (mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            taken = np.bincount(at, minlength=size)
            parts.append(np.packbits(taken == 1, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[taken[at] != 1]
        bits = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        ones = np.bitwise_count(bits).astype(np.uint64)
        return cls(sizes, bits, np.concatenate([[0], np.cumsum(ones)]).astype(np.uint64), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for keys outside the set, any slot or -1."""
        keys = keys.astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = mix(keys[open_], level) % np.uint64(size)
            word = (at >> np.uint64(6)).astype(np.int64) + base
            bit = at & np.uint64(63)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (self.before[word] + np.bitwise_count(below)).astype(np.int64)[hit]
            open_, base = open_[~hit], base + size // 64
        if len(self.rest) and len(open_):
            i = np.searchsorted(self.rest, keys[open_]).clip(max=len(self.rest) - 1)
            found = self.rest[i] == keys[open_]
            out[open_[found]] = int(self.before[-1]) + i[found]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


def pack_index(keys: np.ndarray) -> bytes:
    """The .mph file of a shard's distinct keys with the row of each; repeated keys mean their first row."""
    distinct, rows = np.unique(keys, return_index=True)
    ph = PerfectHash.build(distinct)
    slot = ph.slots(distinct)
    prints, row = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<i8")
    prints[slot], row[slot] = fingerprints(distinct), rows
    head = MAGIC + struct.pack("<4q", len(distinct), len(ph.sizes), len(ph.words), len(ph.rest))
    sizes = np.array(ph.sizes, "<i8")
    return b"".join([head, *(np.ascontiguousarray(x).tobytes() for x in (sizes, ph.words, ph.before, ph.rest, row, prints))])


@dataclass
class Index:
    ph: PerfectHash
    row: np.ndarray
    prints: np.ndarray

    @classmethod
    def unpack(cls, data: bytes) -> Index:
        n, levels, words_, rest = struct.unpack_from("<4q", data, 8)
        at, got = 40, []
        for count, kind in ((levels, "<i8"), (words_, "<u8"), (words_ + 1, "<u8"), (rest, "<i8"), (n, "<i8"), (n, "<u4")):
            got.append(np.frombuffer(data, kind, count, at))
            at += got[-1].nbytes
        return cls(PerfectHash([int(x) for x in got[0]], *got[1:4]), got[4], got[5])

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key in the shard, -1 for keys whose fingerprint is not there."""
        if not len(self.row):
            return np.full(len(keys), -1, np.int64)
        slot = self.ph.slots(keys)
        safe = slot.clip(min=0)
        return np.where((slot >= 0) & (self.prints[safe] == fingerprints(keys)), self.row[safe], -1)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs) or of a plain local path, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _put(fs: pafs.FileSystem, path: str, data: bytes, attempt: str) -> None:
    """Whole or not at all: attempts of one task write apart, and the last rename wins with equal bytes."""
    with fs.open_output_stream(f"{path}.{attempt}") as out:
        out.write(data)
    fs.move(f"{path}.{attempt}", path)


class Recent(dict):
    """A dictionary of two generations: what is not asked for while ``most`` new keys come is forgotten."""

    def __init__(self, most: int) -> None:
        self.most, self.old = most, {}

    def turn(self) -> None:
        """Begin a new generation if the present one is full."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

    def absent(self, keys: set) -> list:
        """Those of ``keys`` that neither generation has; keys of the old one move to the new one."""
        out, get = [], self.old.get
        for k in keys:
            if k not in self:
                if (v := get(k)) is None:
                    out.append(k)
                else:
                    self[k] = v
        return out


class Made(Recent):
    """Recent values, of which a missing one is made when it is asked for."""

    def __init__(self, most: int, make: Callable[[bytes], bytes]) -> None:
        super().__init__(most)
        self.make = make

    def __missing__(self, key: bytes) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        self[key] = got
        return got


#: Fixed values of one tokenizer layout: pre-tokens of letters, single digits and the rest, without white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PUNCTUATION = string.punctuation.encode()


class WordCoder:
    """A `tokenizers` file applied word by word.

    White space ends every pre-token of such tokenizers and no normaliser joins across it, so a text's ids
    are those of its words in turn; frequent words are encoded once. That holds for whitespace-dropping
    vocabularies with word ends; for others pass ``whole=True``. Latin words of the layout above are cut into
    pre-tokens here, so that words share the library's BPE of their parts.
    """

    def __init__(self, path: str, end_id: int, dtype: str, whole: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model, self.dtype, self.whole = Tokenizer.from_file(path), dtype, whole
        self.end = np.array([end_id], dtype).tobytes()
        self.seen, self.parts = Made(CACHE, self._word), Made(CACHE // 2, self._bpe)
        layout = json.loads(self.model.to_str())
        steps = (layout.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.plain = None
        same = [x["type"] for x in (layout.get("normalizer") or {}).get("normalizers", [])] == NORMALIZERS
        if same and (steps[0].get("pattern") or {}).get("Regex") == SPLIT:
            # printable characters below U+0250, which NFC leaves alone; no special token within
            special = "|".join(re.escape(x["content"]) for x in layout.get("added_tokens", []))
            self.plain = re.compile(rf"(?!.*(?:{special or '(?!)'}))[!-~\xA1-\xAC\xAE-\u024F]+").fullmatch
            self.cut_plain = re.compile(SPLIT.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")).findall
            self.cut_latin = regex.compile(SPLIT).findall
        self.code = {2: "H", 4: "I"}[np.dtype(dtype).itemsize]
        self.table = dict(enumerate(byte_letters()))
        self.tokenize = self.model.model.tokenize

    def _cut(self, w: bytes) -> list[bytes] | None:
        """The lower-cased pre-tokens of a plain word; None for a word that the library must cut itself."""
        if not self.plain:
            return None
        t = w.decode("utf-8", "surrogatepass")
        if not self.plain(t):
            return None
        return [x.encode() for x in (self.cut_plain if len(t) == len(w) else self.cut_latin)(t.lower())]

    def _word(self, w: bytes) -> bytes:
        """The ids of a word as raw bytes: of its parts, most of which are known, or the library's."""
        if self.plain:
            # letters and what ASCII punctuation follows are a pre-token each; of bytes, isalpha means ASCII letters
            p, parts = w.rstrip(PUNCTUATION), self.parts
            if p.isalpha():
                got = parts[p.lower()]
            elif p and not p.isascii() and (t := p.decode("utf-8", "surrogatepass")).isalpha() and max(t) < "\u0250" and (t := t.lower()).isalpha():
                got = parts[t.encode()]
            else:
                got = None
            if got is not None:
                return got + parts[w[len(p) :]] if len(p) < len(w) else got
        if (cut := self._cut(w)) is not None:
            return b"".join([self.parts[p] for p in cut])
        coded = self.model.encode_batch_fast([w.decode("utf-8", "surrogatepass")], add_special_tokens=False)
        return array(self.code, coded[0].ids).tobytes()

    def _bpe(self, part: bytes) -> bytes:
        """The ids of one pre-token, of printable characters, as raw bytes; ASCII ones stand for themselves."""
        letters = part.decode() if part.isascii() else part.decode("latin-1").translate(self.table)
        return array(self.code, [x.id for x in self.tokenize(letters)]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text and the end id, as raw bytes; null is the empty text."""
        if self.whole:
            found = self.model.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return [np.array(x.ids, self.dtype).tobytes() + self.end for x in found]
        self.seen.turn()
        self.parts.turn()
        get = self.seen.__getitem__
        return [b"".join(map(get, words(t))) + self.end for t in texts]


@lru_cache(maxsize=2)
def word_coder(path: str, end_id: int, dtype: str, whole: bool) -> WordCoder:
    return WordCoder(path, end_id, dtype, whole)


def write_store(df: DataFrame, tokenizer: str, end_id: int, vocabulary: int, path: str | None = None, key: str = "doc_id", text: str = "text", whole: bool = False) -> str:
    """Encode all texts, write them in ascending key order, and return the store's folder.

    One range shuffle puts the texts in order; each task then writes one shard. Null texts are empty (the end
    id alone). Null keys come last, are in the files and not in the index. Rows with equal keys follow one
    another by a hash of their text, so that a key with many rows spreads over shards; a lookup by key gives
    the first. An empty frame gives an empty store.
    Further columns are ignored. Keys must be integers.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    order = [F.asc_nulls_last("k"), F.asc("h")]
    parts = partitions_for(df, SHARD_BYTES // 2)
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, F.asc_nulls_first("t")).drop("h")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, attempt = context.partitionId(), f"{context.taskAttemptId()}.tmp"
        coder = word_coder(tokenizer, end_id, dtype, whole)
        fs, root = filesystem(path)
        name = f"{root}/shard-{shard:05d}"
        keys, lengths, known, n = [], [], [], 0
        stream = None
        gc.disable()  # no cycles arise here, and the word tables are large
        try:
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256)
                    ids = part.column(0)
                    keys.append(ids.fill_null(0).to_numpy())
                    known.append(ids.is_valid().to_numpy(zero_copy_only=False))
                    coded = coder.encode(part.column(1).to_pylist())
                    lengths.append(np.array([len(x) for x in coded], np.int64) // np.dtype(dtype).itemsize)
                    stream = stream or fs.open_output_stream(f"{name}.bin.{attempt}")
                    stream.write(b"".join(coded))
                    n += len(coded)
        finally:
            gc.enable()
        if not n:
            return
        stream.close()
        fs.move(f"{name}.bin.{attempt}", f"{name}.bin")
        keys, known = np.concatenate(keys).astype("<i8"), np.concatenate(known)
        begins = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<i8")
        head = MAGIC + struct.pack("<2q", n, np.dtype(dtype).itemsize)
        _put(fs, f"{name}.idx", b"".join([head, keys.tobytes(), begins.tobytes(), known.astype(np.uint8).tobytes()]), attempt)
        _put(fs, f"{name}.mph", pack_index(keys[known]), attempt)
        own = keys[known]
        first, last = (int(own[0]), int(own[-1])) if len(own) else (None, None)
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "n_docs": [n], "n_ids": [int(begins[-1])], "first_key": pa.array([first], pa.int64()), "last_key": pa.array([last], pa.int64())}
        )

    shards = ordered.mapInArrow(write, "shard long, n_docs long, n_ids long, first_key long, last_key long")
    shards.write.mode("overwrite").parquet(f"{path}/manifest")
    return path


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each shard, with the ids in all shards before it as ``start``."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{path}/manifest").withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


class Shard:
    """One shard open for reading all of it."""

    def __init__(self, fs: pafs.FileSystem, name: str) -> None:
        with fs.open_input_stream(f"{name}.idx") as f:
            data = f.read()
        n, self.width = struct.unpack_from("<2q", data, 8)
        self.keys = np.frombuffer(data, "<i8", n, 24)
        self.begins = np.frombuffer(data, "<i8", n + 1, 24 + 8 * n)
        self.known = np.frombuffer(data, np.uint8, n, 32 + 16 * n).astype(bool)
        with fs.open_input_stream(f"{name}.mph") as f:
            self.index = Index.unpack(f.read())
        self.file = fs.open_input_file(f"{name}.bin")

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids of rows first to last, without last."""
        at, end = (int(self.begins[i]) * self.width for i in (first, last))
        self.file.seek(at)
        return np.frombuffer(self.file.read(end - at), f"<u{self.width}")

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key by the hash index; -1 for keys that are not in the shard."""
        row = self.index.rows(keys)
        return np.where((row >= 0) & (self.keys[row.clip(min=0)] == keys), row, -1) if len(self.keys) else row

    def keyed_rows(self) -> np.ndarray:
        """The rows of all documents, keys ascending: where the index leads a key, and the rows after it if it repeats.

        Documents without a key come last; the index does not have them.
        """
        own = self.keys[self.known]
        distinct, times = np.unique(own, return_counts=True)
        first = self.rows(distinct)
        if (first < 0).any():
            raise ValueError("the index lacks a key of its shard")
        after = np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
        return np.concatenate([np.repeat(first, times) + after, np.flatnonzero(~self.known)])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All documents: key, start, n_tokens and ids (binary, little-endian unsigned 32 bits).

    Each task opens shards, asks the hash index for every key's row and reads the raw ids of that row; rows that
    follow one another are read at once.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        for batch in batches:
            for number, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(fs, f"{root}/shard-{number:05d}")
                row = shard.keyed_rows()
                apart = (np.diff(row) != 1) | (np.diff(shard.begins[row] >> 20) != 0)
                cuts = np.concatenate([[0], np.flatnonzero(apart) + 1, [len(row)]])
                for a, b in zip(row[cuts[:-1]].tolist(), (row[cuts[1:] - 1] + 1).tolist(), strict=True):
                    ids = shard.ids(a, b).astype("<u4")
                    off = (shard.begins[a : b + 1] - shard.begins[a]) * 4
                    data = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(off.astype("<i4")), pa.py_buffer(ids)])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.keys[a:b], mask=~shard.known[a:b]),
                            pa.array(shard.begins[a:b] + start),
                            pa.array(np.diff(shard.begins[a : b + 1])),
                            data,
                        ],
                        names=["key", "start", "n_tokens", "ids"],
                    )

    shards = manifest(spark, path).select("shard", "start")
    n = shards.count()
    return shards.repartition(max(1, n), "shard").mapInArrow(read, "key long, start long, n_tokens long, ids binary")


class Probe:
    """One shard open for keyed reads: a few short reads at known places for each key, whatever the shard's size."""

    def __init__(self, fs: pafs.FileSystem, name: str) -> None:
        self.idx, self.mph, self.bin = (fs.open_input_file(f"{name}.{kind}") for kind in ("idx", "mph", "bin"))
        self.n, self.width = struct.unpack("<2q", self._read(self.idx, 8, 16))
        self.size, levels, words_, rest = struct.unpack("<4q", self._read(self.mph, 8, 32))
        self.words = 40 + 8 * levels
        self.before = self.words + 8 * words_
        self.rows = self.before + 8 * (words_ + 1) + 8 * rest
        self.prints = self.rows + 8 * self.size
        self.levels = np.frombuffer(self._read(self.mph, 40, 8 * levels), "<i8").tolist()
        self.rest = np.frombuffer(self._read(self.mph, self.rows - 8 * rest, 8 * rest), "<i8").tolist()

    @staticmethod
    def _read(file, at: int, size: int) -> bytes:
        file.seek(at)
        return file.read(size)

    def _number(self, file, at: int) -> int:
        return int.from_bytes(self._read(file, at, 8), "little")

    def slot(self, key: np.ndarray) -> int:
        """PerfectHash.slots of one key, by reads of single words."""
        base = 0
        for level, size in enumerate(self.levels):
            at = int(mix(key, level)[0] % np.uint64(size))
            word = self._number(self.mph, self.words + 8 * (base + at // 64))
            if word >> at % 64 & 1:
                return self._number(self.mph, self.before + 8 * (base + at // 64)) + (word & (1 << at % 64) - 1).bit_count()
            base += size // 64
        return self.size - len(self.rest) + self.rest.index(int(key[0])) if int(key[0]) in self.rest else -1

    def get(self, key: int) -> np.ndarray | None:
        k = np.array([key], np.int64)
        slot = self.slot(k)
        if slot < 0 or self._read(self.mph, self.prints + 4 * slot, 4) != fingerprints(k).tobytes():
            return None
        row = self._number(self.mph, self.rows + 8 * slot)
        if self._read(self.idx, 24 + 8 * row, 8) != k.astype("<i8").tobytes():  # a stranger with the same fingerprint
            return None
        begin, end = struct.unpack("<2q", self._read(self.idx, 24 + 8 * self.n + 8 * row, 16))
        return np.frombuffer(self._read(self.bin, begin * self.width, (end - begin) * self.width), f"<u{self.width}")


class TokenStore:
    """Keyed reads from any process: the manifest names the shard, its hash the row; ``most`` shards stay open."""

    def __init__(self, spark: SparkSession, path: str, most: int = 64) -> None:
        self.fs, self.root = filesystem(path)
        rows = spark.read.parquet(f"{path}/manifest").filter(F.col("first_key").isNotNull()).orderBy("shard").collect()
        self.shards = [(r.shard, r.first_key) for r in rows]
        self.last = [r.last_key for r in rows]
        self.probe = lru_cache(maxsize=most)(lambda number: Probe(self.fs, f"{self.root}/shard-{number:05d}"))

    def get(self, key: int) -> np.ndarray | None:
        """The ids of the document with this key, or None; of a repeated key, of its first document."""
        i = bisect_left(self.last, key)
        if i == len(self.shards) or self.shards[i][1] > key:
            return None
        return self.probe(self.shards[i][0]).get(key)
