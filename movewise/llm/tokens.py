"""Token-ID output (operator 5): raw id payloads with a minimal perfect hash index.

Documents are range-partitioned by doc_id; each partition writes one shard file: ids as little-endian
integers (16 bits where the vocabulary permits), then per record its doc_id and first id, then an
index from doc_id to record. The index is a minimal perfect hash (levels of bit arrays with ranks, as
Limasset et al., 2017), with a 32-bit fingerprint per slot: a lookup reads a handful of bits, one slot
and one offset, whatever the size of the shard, and a key that is not there is refused.

Encoding uses the tokenizers library. A tokenizer whose file declares the normaliser and pre-tokeniser
in FAST splits at white space, so a word's ids do not depend on its neighbours; a bounded memo per
worker keeps them. Its words of printable ASCII or Latin-1 letters are cut as the declared pattern cuts
them and looked up in the library's BPE model; other words, and whole texts that may hold an added
token, go through the whole library call, as do all texts of any other tokenizer.

Scale: texts are shuffled once (doc_id order needs it). A shard is written as it is encoded, and
another file begun after `most_ids` ids; only doc_ids and offsets of a file stay in memory, 16 bytes a
document. The driver sees one row per file. A task that is repeated writes files of its own; only files
of tasks that ended well are in the manifest.

Cases: null text is empty: the end id alone. A null doc_id comes first. Rows that repeat a doc_id
are neighbouring records (ordered by text hash) and are found together. A very long text is one record
of any length. An empty table has no records. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, identified, kept, map_arrow, mix, parts, real_id, shared_path

MAGIC = b"MWIDS001"
GAMMA = 2.0
#: Words in the memo of a worker; when it is full, those not used since the last time go.
MEMO_WORDS = 400_000
#: Ids of a shard file, after which a task begins another.
MOST_IDS = 1 << 26


class MinimalHash:
    """Distinct 64-bit keys to 0..n-1 without gaps."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray) -> None:
        self.levels, self.rest = levels, rest  # bit arrays (uint8 of 0 and 1); sorted keys that no level took
        self.before = np.r_[0, np.cumsum([int(x.sum()) for x in levels])].astype(np.int64)
        self.rank = [np.r_[0, np.cumsum(x)].astype(np.int64) for x in levels]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, most_levels: int = 32) -> MinimalHash:
        levels, left = [], keys
        while len(left) and len(levels) < most_levels:
            size = max(64, int(GAMMA * len(left)))
            at = cls._place(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            left = left[~alone[at]]
        return cls(levels, np.sort(left))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; a key that was never put in may get any slot, or -1."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            if not len(open_):
                return out
            at = self._place(keys[open_], k, len(bits))
            hit = bits[at] == 1
            out[open_[hit]] = self.before[k] + self.rank[k][at[hit]]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.before[-1] + at[hit]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.levels), len(self.rest), *[len(x) for x in self.levels]], np.int64)
        return head.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels) + self.rest.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> MinimalHash:
        n, m = np.frombuffer(raw, np.int64, 2)
        sizes = np.frombuffer(raw, np.int64, n, 16)
        at, levels = 16 + 8 * int(n), []
        for size in sizes.tolist():
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, size + 7 >> 3, at), count=size))
            at += size + 7 >> 3
        return cls(levels, np.frombuffer(raw, np.uint64, m, at))


def _key(doc_ids: np.ndarray) -> np.ndarray:
    return mix(doc_ids.astype(np.int64).view(np.uint64))


def _print(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)).astype(np.uint32)


class ShardWriter:
    """Appends documents in doc_id order; close() adds the index."""

    def __init__(self, uri: str, wide: bool) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.kind, self.out = uri, np.dtype("<u4" if wide else "<u2"), fs.open_output_stream(path)
        self.ids, self.starts = array("q"), array("q", [0])

    def add(self, doc_id: int, ids: bytes) -> None:
        self.out.write(ids)
        self.ids.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids) // self.kind.itemsize)

    def close(self) -> tuple[int, int]:
        """Records and ids written."""
        docs, starts = np.frombuffer(self.ids, np.int64) if self.ids else np.zeros(0, np.int64), np.frombuffer(self.starts, np.int64)
        head = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else np.zeros(0, np.int64)
        keys = _key(docs[head])
        index = MinimalHash.build(keys)
        slot = index.find(keys)
        prints, record, run = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        prints[slot], record[slot], run[slot] = _print(keys), head, np.diff(np.r_[head, len(docs)])
        raw = index.dump()
        sections = [docs.tobytes(), starts.tobytes(), prints.tobytes(), record.tobytes(), run.tobytes(), raw]
        tail = np.array([self.kind.itemsize, len(docs), len(keys), len(raw), int(starts[-1])], np.int64)
        for x in sections:
            self.out.write(x)
        self.out.write(tail.tobytes() + MAGIC)
        self.out.close()
        return len(docs), int(starts[-1])


class Shard:
    """Reads a shard file; get(doc_id) takes constant time after opening."""

    def __init__(self, uri: str) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(48, size - 48)
        if tail[40:] != MAGIC:
            raise ValueError(f"{uri} is not a shard file")
        width, n, k, m, ids = (int(x) for x in np.frombuffer(tail, np.int64, 5))
        self.kind = np.dtype(f"<u{width}")
        at = ids * width
        raw = self.file.read_at(size - 48 - at, at)
        cut = np.cumsum([0, 8 * n, 8 * (n + 1), 4 * k, 8 * k, 8 * k, m])
        take = lambda i, t: np.frombuffer(raw[cut[i] : cut[i + 1]], t)
        self.doc_ids, self.starts = take(0, np.int64), take(1, np.int64)
        self.prints, self.record, self.run = take(2, np.uint32), take(3, np.int64), take(4, np.int64)
        self.index = MinimalHash.load(raw[cut[5] :])

    def find(self, doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each doc_id; 0 records where the fingerprint says it is absent."""
        keys = _key(doc_ids)
        slot = self.index.find(keys)
        here = slot >= 0
        at = np.where(here, slot, 0)
        if len(self.prints):
            here &= self.prints[at] == _print(keys)
            return np.where(here, self.record[at], 0), np.where(here, self.run[at], 0)
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)

    def ids(self, record: int) -> np.ndarray:
        a, b = int(self.starts[record]), int(self.starts[record + 1])
        return np.frombuffer(self.file.read_at((b - a) * self.kind.itemsize, a * self.kind.itemsize), self.kind)

    def get(self, doc_id: int) -> list[np.ndarray]:
        first, n = self.find(np.array([doc_id], np.int64))
        return [self.ids(r) for r in range(int(first[0]), int(first[0] + n[0]))]


# The normaliser and pre-tokeniser whose words may be encoded one by one, and their pattern for printable ASCII in lower case.
FAST = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None, "truncation": None,
}
_CUT = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_PLAIN = re.compile(rb"[!-~]+")
#: Letters of Latin-1 and common marks: one code point each whatever the normal form, and lower-cased one by one.
_LATIN = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ.,;:!?]+")
_LATIN_CUT = re.compile("[a-zß-öø-ÿ]+|[.,;:!?]+")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE writes for bytes: printable Latin-1 as it is, the others from U+0100 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()


class WordMemo:
    """Encodes texts word by word as packed ids, remembering words."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            declared = json.load(f)
        self.by_word = declared["model"]["type"] == "BPE" and all(declared.get(k) == v for k, v in FAST.items())
        self.added = [x["content"].encode() for x in declared.get("added_tokens", [])]
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 65536
        self.kind = "<u4" if self.wide else "<u2"
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _piece(self, piece: bytes) -> bytes:
        if (out := self.pieces.get(piece)) is None:
            if len(self.pieces) > MEMO_WORDS:
                self.pieces.clear()
            letters = piece.decode() if piece.isascii() else "".join(map(_LETTERS.__getitem__, piece))
            self.pieces[piece] = out = self.pack([t.id for t in self.model.tokenize(letters)])
        return out

    def _word(self, word: bytes) -> bytes:
        if (out := self.older.get(word)) is None:
            if _PLAIN.fullmatch(word):
                out = b"".join(map(self._piece, _CUT.findall(word.lower())))
            elif _LATIN.fullmatch(text := word.decode()):
                out = b"".join([self._piece(x.encode()) for x in _LATIN_CUT.findall(text.lower())])
            else:
                out = self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self.words) > MEMO_WORDS:
            self.older, self.words = self.words, {}
        if len(word) < 64:
            self.words[word] = out
        return out

    def encode(self, text: bytes) -> bytes:
        if not self.by_word or any(x in text for x in self.added):
            return self.pack(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids)
        get, miss = self.words.get, self._word
        return b"".join([get(w) or miss(w) for w in text.split()])


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, shards: int | None = None, most_ids: int = MOST_IDS) -> list[tuple[str, int, int]]:
    """Writes docs as shard files in ascending doc_id order; returns (uri, records, ids) of each, in order."""
    spark = docs.sparkSession
    rows = identified(docs).repartitionByRange(shards or parts(spark), "_id", "_tk").sortWithinPartitions("_id", "_tk").select("_id", "text")
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(f"tokens {tokenizer}", lambda: WordMemo(tokenizer))
        end, shard, number = encoder.pack([end_id]), None, 0

        def closed() -> pa.RecordBatch:
            records, ids = shard.close()
            return pa.RecordBatch.from_arrays([pa.array([shard.uri]), pa.array([number], pa.int64()), pa.array([records], pa.int64()), pa.array([ids], pa.int64())], ["uri", "number", "records", "ids"])

        for batch in batches:
            for i, text in zip(batch["_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                if shard is not None and shard.starts[-1] >= most_ids and shard.ids[-1] != i:  # a doc_id stays in one file
                    yield closed()
                    shard, number = None, number + 1
                if shard is None:
                    shard = ShardWriter(f"{folder}/{run_id}/{uuid.uuid4().hex}.ids", encoder.wide)
                shard.add(i, encoder.encode(text) + end)
        if shard is not None:
            yield closed()

    done = map_arrow(rows, f"tokens {tokenizer}", run, "uri string, number long, records long, ids long").withColumn("shard", F.spark_partition_id()).collect()
    return [(r["uri"], r["records"], r["ids"]) for r in sorted(done, key=lambda r: (r["shard"], r["number"]))]


def read_ids(spark: SparkSession, manifest: list[tuple[str, int, int]]) -> DataFrame:
    """One row per record: doc_id, start, n_tokens, ids_crc32; each fetched by its key through the shard's index."""
    base, rows = 0, []
    for uri, records, ids in manifest:
        if records:
            rows.append((uri, base))
        base += ids
    table = spark.createDataFrame(rows, "uri string, base long").repartition(max(1, len(rows)), "uri") if rows else spark.createDataFrame([], "uri string, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch["uri"].to_pylist(), batch["base"].to_pylist(), strict=True):
                shard = Shard(uri)
                keys = np.unique(shard.doc_ids)
                for cut in range(0, len(keys), 4096):
                    some = keys[cut : cut + 4096]
                    first, n = shard.find(some)
                    at = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
                    crc = [zlib.crc32(shard.ids(r).astype("<u4").tobytes()) for r in at.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, n)), pa.array(base + shard.starts[at]), pa.array(shard.starts[at + 1] - shard.starts[at]), pa.array(crc, pa.int64())], ["_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(table, "tokens", run, "_id long, start long, n_tokens long, ids_crc32 long").select(real_id(), "start", "n_tokens", "ids_crc32")


def token_report(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encodes and writes docs into the shared folder, and reports what the files hold."""
    spark = docs.sparkSession
    return read_ids(spark, write_ids(docs, shared_path(spark, "ids"), tokenizer, end_id))


__all__ = ["NO_ID", "MinimalHash", "Shard", "ShardWriter", "WordMemo", "read_ids", "token_report", "write_ids"]
