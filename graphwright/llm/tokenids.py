"""Token-id files: one id array per file with Elias-Fano document boundaries.

A shard file holds, in ascending doc_id order: a header, the doc_ids, the
boundaries of the documents as an Elias-Fano sequence with select samples, and
the ids of all documents, two bytes each if the vocabulary allows it, else
four. A boundary costs about 2 + log2(mean length) bits instead of 64.

Layout, little-endian: magic ``GWT1``, id width (uint32), documents (uint64),
ids (uint64), low bits (uint64), words of high bits (uint64); doc_ids (int64
each), null flags (uint8 each); low parts (uint64 words); high parts (uint64
words); select samples (uint32 each, every 256th boundary's high position); ids.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import shared_folder
from .pieces import Memo, pieces, plain, portions

MAGIC = b"GWT1"
SAMPLE = 256
#: Ids after which a shard file is closed; a longer document has its own file.
SHARD_IDS = 4_000_000
_MANIFEST = "file string, part int, seq int, n_docs long, n_tokens long"


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(universe / n) bits a value."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        mask = np.uint64((1 << low_bits) - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        flags = (((values & mask)[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) + 1) if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, cls._words(flags), cls._words(high), ones[::SAMPLE].astype(np.uint32))

    @staticmethod
    def _words(flags: np.ndarray) -> np.ndarray:
        packed = np.packbits(flags, bitorder="little")
        return np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view(np.uint64)

    def select(self, i: int) -> int:
        """Value number i, from the nearest select sample."""
        at, rank = int(self.samples[i // SAMPLE]), i % SAMPLE
        word, bit = divmod(at, 64)
        current = int(self.high[word]) >> bit << bit
        while (count := current.bit_count()) <= rank:
            rank -= count
            word += 1
            current = int(self.high[word])
        for _ in range(rank):
            current &= current - 1
        high = word * 64 + (current & -current).bit_length() - 1 - i
        return (high << self.low_bits) | self._low(i)

    def _low(self, i: int) -> int:
        start = i * self.low_bits
        word, bit = divmod(start, 64)
        value = int(self.low[word]) >> bit if self.low_bits else 0
        if bit + self.low_bits > 64:
            value |= int(self.low[word + 1]) << (64 - bit)
        return value & ((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        """All values at once."""
        high = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        high = high - np.arange(self.n)
        if not self.low_bits:
            return high.astype(np.int64)
        flags = np.unpackbits(self.low.view(np.uint8), bitorder="little")
        flags = flags[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return (high << self.low_bits) + flags @ (1 << np.arange(self.low_bits, dtype=np.int64))


def packed(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """The bytes of one shard file; ids holds each document's ids as bytes."""
    ends = np.cumsum([len(x) // width for x in ids], dtype=np.int64)
    ef = EliasFano.of(ends)
    head = struct.pack(
        "<4sIQQQQ", MAGIC, width, len(ids), int(ends[-1]) if len(ends) else 0, ef.low_bits, len(ef.high)
    )
    known = np.array([x or 0 for x in doc_ids], "<i8")
    null = np.array([x is None for x in doc_ids], np.uint8)
    return b"".join(
        [head, known.tobytes(), null.tobytes(), ef.low.tobytes(), ef.high.tobytes(), ef.samples.tobytes(), *ids]
    )


class Shard:
    """Reads one shard file from its bytes, without a table of offsets."""

    def __init__(self, data: bytes | memoryview):
        view = memoryview(data)
        magic, self.width, self.n, self.n_tokens, low_bits, high_words = struct.unpack_from("<4sIQQQQ", view)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        at = struct.calcsize("<4sIQQQQ")

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(view, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.null = take(self.n, "<i8"), take(self.n, "u1")
        low = take((((self.n * low_bits + 7) // 8) + 7) // 8, "<u8")
        high = take(high_words, "<u8")
        samples = take(-(-self.n // SAMPLE), "<u4")
        self.ends = EliasFano(self.n, low_bits, low, high, samples)
        self.ids = take(self.n_tokens, f"<u{self.width}")

    def span(self, i: int) -> tuple[int, int]:
        """Start and end of document number i, by two selects."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        start, end = self.span(i)
        return self.ids[start:end]


def _store(folder: str, name: str, data: bytes) -> None:
    """Write a whole file or none, also when a task runs twice."""
    if folder.startswith(("file:", "/")):
        local = "/" + folder.removeprefix("file:").lstrip("/")
        os.makedirs(local, exist_ok=True)
        with open(f"{local}/.{name}", "wb") as f:
            f.write(data)
        os.replace(f"{local}/.{name}", f"{local}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/.{name}") as f:
        f.write(data)
    store.move(f"{path}/.{name}", f"{path}/{name}")


class _Encoder:
    """Encodes by the tokenizers library; ids come as little-endian bytes.

    The library looks for the tokenizer's added tokens, such as special ones,
    anywhere in a text, so a text that holds one goes to it whole. New pieces of a portion of texts go to the library together, one a line:
    in such a text each line feed between two pieces is a token of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.tokenizer = tokenizer
        self.memo = Memo(lambda piece: np.array(self._ids(piece), self.kind).tobytes(), entries=400_000)
        line_feed = self._ids("\n")
        self.line_feed = line_feed[0] if self._ids("a\n a\na") == (
            self._ids("a") + line_feed + self._ids(" a") + line_feed + self._ids("a")
        ) and len(line_feed) == 1 else None

    def _ids(self, text: str) -> list[int]:
        # this call of the library leaves out the offsets, which nothing here needs
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, new: list[str]) -> None:
        """Put the ids of new pieces of plain texts into the memo."""
        if self.line_feed is None or len(new) < 2:
            return
        ids = np.array(self._ids("\n".join(new)), self.kind)
        cuts = (np.flatnonzero(ids == self.line_feed) * self.width).tolist()
        if len(cuts) + 1 != len(new):
            return
        raw, start = ids.tobytes(), 0
        self.memo.room(len(new))
        for piece, end in zip(new, [*cuts, len(raw)], strict=True):
            self.memo[piece] = raw[start:end]
            start = end + self.width

    def all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        known, old, longest = self.memo.get, self.memo.old.get, self.memo.longest
        coded, open_at, new = [], [], {}
        for text in texts:
            if any(token in text for token in self.added):
                coded.append([np.array(self._ids(text), self.kind).tobytes()])
                continue
            own = pieces(text)
            ids = list(map(known, own))
            if None in ids:
                simple = plain(text)
                for k in [k for k, v in enumerate(ids) if v is None]:
                    piece = own[k]
                    ids[k] = old(piece)
                    if ids[k] is not None:
                        self.memo[piece] = ids[k]  # a common piece stays when the generation ends
                    else:
                        open_at.append((ids, k, piece))
                        if simple and piece and piece != "\n" and len(piece) <= longest:
                            new[piece] = None
            coded.append(ids)
        self._learn(list(new))
        for ids, k, piece in open_at:
            ids[k] = self.memo[piece]
        return [b"".join(ids) for ids in coded]


_encoders: dict[str, _Encoder] = {}


def encoder(path: str) -> _Encoder:
    """One encoder for each worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def write_token_ids(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, shard_ids: int = SHARD_IDS
) -> tuple[str, DataFrame]:
    """Write the ids of all texts as shard files; gives the folder and the manifest.

    tokenizer: path, on every machine, of a byte-level BPE tokenizer of the
    tokenizers library. Rows are dealt out by ranges of doc_id (and, among
    equal ones, a hash of the text), so files follow one another in ascending
    order; nulls come first. A null text is an empty one and has the end id
    only. The manifest (file, n_docs, n_tokens, base: ids in all files before
    it) is a table in the folder; files that it doesn't name, as a repeated
    task may leave, count for nothing.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = end_id.to_bytes(encode.width, "little")
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        size = 0

        def closed() -> pa.RecordBatch:
            name = f"{part:06d}-{seq:05d}-{uuid.uuid4().hex}.gwt"
            _store(f"{folder}/shards", name, packed(doc_ids, ids, encode.width))
            row = [[name], [part], [seq], [len(ids)], [size // encode.width]]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(row, kinds, strict=True)],
                ["file", "part", "seq", "n_docs", "n_tokens"],
            )

        for batch in batches:
            texts = (text.as_py() or "" for text in batch.column(1))
            coded = (x for portion in portions(texts) for x in encode.all(portion))
            for doc_id, own in zip(batch.column(0).to_pylist(), coded, strict=True):
                own += end
                if ids and size + len(own) > shard_ids * encode.width:
                    yield closed()
                    doc_ids, ids, size, seq = [], [], 0, seq + 1
                doc_ids.append(doc_id)
                ids.append(own)
                size += len(own)
        if ids:
            yield closed()

    tie = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    files = (
        rows.repartitionByRange(F.col("doc_id"), tie)
        .sortWithinPartitions("doc_id", tie)
        .mapInArrow(run, _MANIFEST)
    )
    files.write.parquet(f"{folder}/written")
    files = spark.read.schema(_MANIFEST).parquet(f"{folder}/written")
    # bases: sums over tasks first, so that the ordered window has a row for each task only
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    manifest = files.join(parts, "part").select(
        "file",
        "n_docs",
        "n_tokens",
        (F.col("part_base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("base"),
    )
    manifest.write.parquet(f"{folder}/manifest")
    return folder, read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("file string, n_docs long, n_tokens long, base long").parquet(
        f"{folder}/manifest"
    )


def read_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from its files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(content.as_buffer())
                ends = shard.ends.values()
                starts = np.r_[0, ends[:-1]] if len(ends) else ends
                ids = shard.ids.astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * shard.n, pa.string()),
                        pa.array(shard.doc_ids, mask=shard.null.astype(bool)),
                        pa.array(starts, pa.int64()),
                        pa.array(ends - starts, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["file", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.gwt")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .load(f"{folder}/shards")
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
        .mapInArrow(run, "file string, doc_id long, start long, n_tokens long, ids_crc32 long")
    )
    return found.join(read_manifest(spark, folder).select("file", "base"), "file").select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_ids(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the token-id files of docs (doc_id, text) and read them back.

    See write_token_ids for nulls; an empty table gives no rows, repeated rows
    give a row each, and other columns are not read.
    """
    spark = docs.sparkSession
    folder, manifest = write_token_ids(docs, tokenizer, end_id)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_ids(spark, folder)
