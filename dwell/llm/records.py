"""Token ids as length-delimited binary records with a separate offset index (operator 2).

A record is a frame::

    length of the payload   8 bytes, little-endian
    masked CRC-32C of it    4 bytes
    payload                 the ids, 2 bytes each, or 4 where the vocabulary needs them
    masked CRC-32C of it    4 bytes

which is the common record format of training readers.  Files are rolled at a fixed
size.  The offset index is a table with one row per record: file, offset, length, number
of ids before it.  It is also the commit record: every attempt of a task writes files
under names of its own, and only files that the index names count.  So lost executors,
retries and speculative tasks leave no half file in the data.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from dwell.llm.texts import LONG_WORD, piece_of, slices, word_keys

# A file is closed once it holds so many bytes.
FILE_BYTES = 16 << 20
# Fixed values of the record format: the reflected CRC-32C polynomial and the mask.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8
BLOCK = 256
# Bytes of the words that a worker process keeps with their ids.
KEPT_BYTES = 24 << 20
# Distinct pieces in one call of the tokenizer.
JOINED = 500


# ---- checksums -------------------------------------------------------------

@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


@lru_cache(maxsize=1)
def _pair_table() -> np.ndarray:
    """The effect of two bytes at once."""
    one = _byte_table()
    low = np.arange(65536, dtype=np.uint32)
    half = one[low & 0xFF] ^ (low >> 8)
    return one[half & 0xFF] ^ (half >> 8)


@lru_cache(maxsize=64)
def _shift(zeros: int) -> np.ndarray:
    """Tables that carry a checksum over so many zero bytes: one per byte of it."""
    if zeros == 1:
        one = _byte_table()
        out = np.empty((4, 256), np.uint32)
        for k in range(4):
            v = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
            out[k] = one[v & 0xFF] ^ (v >> np.uint32(8))
        return out
    half = _shift(zeros // 2)
    out = _carry(half, _carry(half, np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]))
    return _carry(_shift(1), out) if zeros % 2 else out


def _carry(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return (
        tables[0][crc & 0xFF] ^ tables[1][(crc >> 8) & 0xFF]
        ^ tables[2][(crc >> 16) & 0xFF] ^ tables[3][crc >> 24]
    )


def crc32c(payloads: list[bytes]) -> np.ndarray:
    """CRC-32C of every payload, worked out over all of their blocks at once.

    Payloads are filled up with zeros in front, which a checksum that starts at zero does
    not notice; the usual start value is added as its own linear part.
    """
    if not payloads:
        return np.zeros(0, np.uint32)
    sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
    blocks = np.maximum(1, -(-sizes // BLOCK))
    fill = blocks * BLOCK - sizes
    data = b"".join(x for p, f in zip(payloads, fill.tolist()) for x in (b"\0" * f, p))
    lanes = np.frombuffer(data, "<u2").reshape(-1, BLOCK // 2).T.copy()
    pairs = _pair_table()
    crc = np.zeros(lanes.shape[1], np.uint32)
    for step in lanes:
        crc = pairs[(crc ^ step) & 0xFFFF] ^ (crc >> np.uint32(16))
    # Join neighbouring blocks of a payload, twice as long in every round.
    span = BLOCK
    owner = np.repeat(np.arange(len(payloads)), blocks)
    while len(crc) > len(payloads):
        count = np.bincount(owner, minlength=len(payloads))
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        # An odd count keeps its first block alone, so that the others pair up at the end.
        place = np.arange(len(crc)) - first[owner] + (count[owner] % 2)
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < count[owner] + count[owner] % 2))
        keep = np.ones(len(crc), bool)
        crc[left + 1] ^= _carry(_shift(span), crc[left])
        keep[left] = False
        crc, owner = crc[keep], owner[keep]
        span *= 2
    start = np.array([_start(int(s)) for s in sizes], np.uint32)
    return crc ^ start ^ np.uint32(0xFFFFFFFF)


@lru_cache(maxsize=65536)
def _start(size: int) -> int:
    """What the start value of all ones adds to the checksum of so many bytes."""
    value = np.array([0xFFFFFFFF], np.uint32)
    for bit in range(size.bit_length()):
        if size >> bit & 1:
            value = _carry(_shift(1 << bit), value)
    return int(value[0])


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frames(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads = masked(crc32c(lengths)).astype("<u4").tobytes()
    tails = masked(crc32c(payloads)).astype("<u4").tobytes()
    return [
        n + heads[4 * i:4 * i + 4] + p + tails[4 * i:4 * i + 4]
        for i, (n, p) in enumerate(zip(lengths, payloads))
    ]


def payloads_of(data: bytes, offsets: list[int]) -> list[bytes]:
    """The payloads of the frames at these offsets; a wrong checksum is an error."""
    view = memoryview(data)
    lengths, out, heads, tails = [], [], [], []
    for at in offsets:
        head = bytes(view[at:at + 8])
        size = struct.unpack("<Q", head)[0]
        lengths.append(head)
        heads.append(bytes(view[at + 8:at + 12]))
        out.append(bytes(view[at + 12:at + 12 + size]))
        tails.append(bytes(view[at + 12 + size:at + 16 + size]))
    for parts, sums in ((lengths, heads), (out, tails)):
        if masked(crc32c(parts)).astype("<u4").tobytes() != b"".join(sums):
            raise ValueError("a record does not match its checksum")
    return out


# ---- encoding ----------------------------------------------------------------

class Ids:
    """Whole texts to ids with a tokenizer file, which sees distinct words that are not known."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # Known words and their ids: as Arrow arrays, far smaller than a dictionary.
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())
        # Cuts at spaces are safe only for a byte-level tokenizer without a prefix space,
        # and if no added token holds or swallows a space.
        added = self.tokenizer.get_added_tokens_decoder().values()
        kind = type(self.tokenizer.pre_tokenizer).__name__
        self.by_word = (
            kind == "ByteLevel" and not self.tokenizer.pre_tokenizer.add_prefix_space
            and self.tokenizer.normalizer is None
            and not any(" " in t.content or t.lstrip or t.rstrip or t.single_word for t in added)
        )
        # In a byte-level vocabulary every character stands for one byte of text.
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.bytes_of[i] = len(token.content.encode())

    def solve(self, keys: list[str]) -> list[bytes]:
        """Ids of distinct pieces: many to a library call, told apart by their bytes.

        What is no key of ``word_keys`` has none.
        """
        found = [b""] * len(keys)
        spaced = [i for i, k in enumerate(keys) if k and not k[0].isspace()]
        alone = [i for i, k in enumerate(keys) if k.startswith(" ")]
        for i, ids in zip(alone, self.encoded([piece_of(keys[i]) for i in alone])):
            found[i] = ids
        runs = [spaced[i:i + JOINED] for i in range(0, len(spaced), JOINED)]
        texts = ["".join([" " + keys[i] for i in run]) for run in runs]
        for run, encoding in zip(runs, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(encoding.ids, self.dtype)
            sizes = np.fromiter((len(keys[i].encode()) + 1 for i in run), np.int64, len(run))
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes)) + 1
            flat, width = ids.tobytes(), self.dtype.itemsize
            lo = 0
            for i, hi in zip(run, (ends * width).tolist()):
                found[i] = flat[lo:hi]
                lo = hi
        return found

    def encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def lookup(self, words: pa.StringArray) -> pa.BinaryArray:
        """Ids of distinct words; the tokenizer sees those that are not known yet."""
        at = pc.index_in(words, value_set=self.words)
        if not at.null_count:
            return self.ids.take(at)
        new = words.filter(pc.is_null(at))
        solved = pa.array(self.solve(new.to_pylist()), pa.binary())
        place = pc.fill_null(at, -1).to_numpy().copy()
        place[place < 0] = len(self.words) + np.arange(len(new), dtype=place.dtype)
        found = pa.concat_arrays([self.ids, solved]).take(pa.array(place))
        # Only speed depends on what is kept: a full table starts again from these words.
        full = self.words.nbytes + self.ids.nbytes + new.nbytes + solved.nbytes > KEPT_BYTES
        words, ids = (words, found) if full else (new, solved)
        short = pc.less_equal(pc.binary_length(words), LONG_WORD)
        words, ids = words.filter(short), ids.filter(short)
        if not full:
            words, ids = pa.concat_arrays([self.words, words]), pa.concat_arrays([self.ids, ids])
        elif words.nbytes + ids.nbytes > KEPT_BYTES // 2:
            words, ids = pa.array([], pa.string()), pa.array([], pa.binary())
        self.words, self.ids = words, ids
        return found

    def line_up(self, words: pa.StringArray) -> tuple[np.ndarray, memoryview]:
        """The ids of words one after another, and where those of each word begin and end."""
        coded = words.dictionary_encode()
        found = self.lookup(coded.dictionary).cast(pa.large_binary()).take(coded.indices)
        if not len(found):
            return np.zeros(1, np.int64), memoryview(b"")
        _, bounds, data = found.buffers()
        return np.frombuffer(bounds, np.int64)[:len(found) + 1], memoryview(data or b"")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, cut at spaces and put together in Arrow.

        The first word of a text is a key of its own kind.  A space that no word follows
        leaves something that is no key and has no ids; ``word_keys`` cuts such texts.
        """
        if not self.by_word:
            return self.encoded(texts)
        if not texts:
            return []
        cut = [t.partition(" ") for t in texts]
        rests = pc.split_pattern(pa.array([rest if space else None for _, space, rest in cut], pa.string()), " ")
        ends = np.cumsum(pc.fill_null(pc.list_value_length(rests), 0).to_numpy())
        firsts = pa.array([" " + first for first, _, _ in cut], pa.string())
        bounds, data = self.line_up(pa.concat_arrays([firsts, rests.flatten()]))
        none = np.flatnonzero(np.diff(bounds[len(texts):]) == 0)
        again = np.unique(np.searchsorted(ends, none, side="right")).tolist()
        at = bounds[:len(texts) + 1].tolist()
        to = bounds[len(texts) + np.concatenate([[0], ends])].tolist()
        out = [b"".join((data[at[i]:at[i + 1]], data[to[i]:to[i + 1]])) for i in range(len(texts))]
        if again:
            keys = [word_keys(texts[i]) for i in again]
            bounds, data = self.line_up(pa.array([k for ks in keys for k in ks], pa.string()))
            to = bounds[np.cumsum([0, *map(len, keys)])].tolist()
            for i, lo, hi in zip(again, to, to[1:]):
                out[i] = bytes(data[lo:hi])
        return out


@lru_cache(maxsize=2)
def _ids(path: str) -> Ids:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work over cores
    return Ids(path)


# ---- writing -------------------------------------------------------------------

INDEX = "file string, part int, file_seq int, record int, offset long, length long, id_bytes int, " \
        "n_tokens long, doc_id long"


class _Files:
    """Rolls the files of one task attempt."""

    def __init__(self, folder: str, part: int):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.part, self.attempt = part, uuid.uuid4().hex[:12]
        self.seq, self.out, self.at, self.record = -1, None, 0, 0

    def add(self, frame: bytes) -> tuple[str, int, int, int]:
        if self.out is None or self.at >= FILE_BYTES:
            self.close()
            self.seq += 1
            self.name = f"ids-{self.part:06d}-{self.seq:05d}-{self.attempt}.rec"
            self.out, self.at, self.record = self.fs.open_output_stream(f"{self.root}/{self.name}"), 0, 0
        place = self.name, self.seq, self.record, self.at
        self.out.write(frame)
        self.at += len(frame)
        self.record += 1
        return place

    def close(self):
        if self.out is not None:
            self.out.close()
            self.out = None


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts and write them as records in ascending document order.

    Each text (null: empty) is followed by ``end_id``.  Rows without a document id come
    first, and rows with the same id are ordered by a hash of their text.  Writes
    ``folder``/data and the offset index ``folder``/index, and returns the index.  An
    empty table writes an empty index.  ``folder`` must be shared by all executors.

    The texts are dealt into ranges of ids and sorted there, so the order is global
    without any task seeing more than its range, and each range is encoded and written
    in one pass.
    """
    spark = docs.sparkSession
    columns = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = columns.repartitionByRange(_parts(spark), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    numbered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    data = f"{folder}/data"
    names = [f.split()[0] for f in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(tokenizer_path)
        end = np.array([end_id], ids.dtype).tobytes()
        width = ids.dtype.itemsize
        files = None
        for batch in batches:
            for part in slices(batch, 2):
                number = part.column(0)[0].as_py()
                files = files or _Files(data, number)
                payloads = [p + end for p in ids.encode([t or "" for t in part.column(2).to_pylist()])]
                places = [files.add(f) for f in frames(payloads)]
                file, seq, record, offset = zip(*places)
                n = len(payloads)
                yield pa.RecordBatch.from_arrays([
                    pa.array(file), pa.array([number] * n, pa.int32()), pa.array(seq, pa.int32()),
                    pa.array(record, pa.int32()), pa.array(offset, pa.int64()),
                    pa.array([len(p) + 16 for p in payloads], pa.int64()),
                    pa.array([width] * n, pa.int32()),
                    pa.array([len(p) // width for p in payloads], pa.int64()), part.column(1),
                ], names=names)
        if files is not None:
            files.close()

    numbered.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The offset index with ``start``, the number of ids in all records before each one.

    The sum over all earlier ranges is made from one row per range.
    """
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = totals.select(
        "part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("part").orderBy("file_seq", "record").rowsBetween(Window.unboundedPreceding, -1)
    return index.join(F.broadcast(before), "part").select(
        *index.columns, (F.col("_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start")
    )


# ---- reading ---------------------------------------------------------------------

def read_records(index: DataFrame, folder: str, chunk: int = 256) -> DataFrame:
    """Add ``ids``: the ids behind rows of the offset index, as unsigned 32-bit integers.

    Rows that share a file are read together, in runs of at most ``chunk`` records by
    one range read each; checksums are verified.  Pass any part of the index.
    """
    columns = index.columns
    at = {c: columns.index(c) for c in ("file", "offset", "length", "id_bytes")}
    schema = StructType([*index.schema, StructField("ids", BinaryType())])
    data = f"{folder}/data"

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(data)
        name, source = None, None
        for batch in batches:
            rows = batch.num_rows
            for lo in range(0, rows, chunk):
                part = batch.slice(lo, min(chunk, rows - lo))
                file, offset, length = (part.column(at[c]).to_pylist() for c in ("file", "offset", "length"))
                width = part.column(at["id_bytes"]).to_pylist()
                found: list[bytes] = []
                i = 0
                while i < len(file):
                    j = i + 1
                    while j < len(file) and file[j] == file[i] and offset[j] == offset[j - 1] + length[j - 1]:
                        j += 1
                    if file[i] != name:
                        name, source = file[i], fs.open_input_file(f"{root}/{file[i]}")
                    source.seek(offset[i])
                    data_ = source.read(offset[j - 1] + length[j - 1] - offset[i])
                    found += payloads_of(data_, [o - offset[i] for o in offset[i:j]])
                    i = j
                found = [np.frombuffer(d, f"<u{w}").astype("<u4").tobytes() for d, w in zip(found, width)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=schema.names)

    return index.mapInArrow(run, schema)


def shuffled(index: DataFrame, seed: int, epoch: int = 0) -> DataFrame:
    """The index in a seeded random order, for one epoch of training reads."""
    order = F.xxhash64(F.lit(seed), F.lit(epoch), "start")
    return index.orderBy(order, "start")
