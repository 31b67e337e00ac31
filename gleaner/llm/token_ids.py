"""Token ids as binary shards with Elias-Fano document boundaries.

A shard file holds the ids of a run of documents, in order, and where each
document ends. Layout, all little-endian:

    8 bytes   magic ``GLTOKID1``
    7 x u64   documents, ids, low bits per boundary, bytes of the low part,
              bytes of the high part, documents per sample, bytes per id
    low part  the low bits of every boundary, packed
    high part the other bits in unary: boundary i sets bit (high(i) + i)
    u64 each  samples: bit position of every s-th set bit, for select
    u16 or u32 each  ids: 16 bits where all ids of the shard fit

Boundary i is read with one select in the high part, so no table of 64-bit
offsets is needed: about ``2 + log2(ids / documents)`` bits a document.

Files are written once, under a name of their own, by the task that holds the
range; the manifest lists the files of the attempts that succeeded, so a task
that runs again leaves no doubt about which file counts.

Defined results: null text is an empty document (only the end id); documents
are ordered by id, equal ids by text, null ids first; an empty table has no
shards; other columns are ignored.
"""
from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.words import BASE, BYTE, U64, mix, slices, text_bytes
from gleaner.session import ship_package

MAGIC = b"GLTOKID1"
SAMPLE = 256
SHARD_IDS = 8_000_000
CACHE_PIECES = 500_000  # about 20 MB, which a worker keeps between tasks
SLICE = 1 << 20  # bytes of text encoded at once


# ---------------------------------------------------------------- Elias-Fano
def ef_encode(ends: np.ndarray, sample: int = SAMPLE) -> tuple[int, bytes, bytes, np.ndarray]:
    """``ends`` never fall. Low-bit width, low part, high part, select samples."""
    n = len(ends)
    top = int(ends[-1]) if n else 0
    width = max(0, (top // n).bit_length() - 1) if n else 0
    ends = ends.astype(np.uint64)
    low = (ends[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    spot = (ends >> np.uint64(width)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(spot[-1]) + 1 if n else 0, np.uint8)
    high[spot] = 1
    return width, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), spot[::sample]


class EliasFano:
    """Boundaries of one shard, read in place."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray, sample: int = SAMPLE):
        self.n, self.width, self.low, self.high, self.samples, self.sample = n, width, low, high, samples, sample

    def __getitem__(self, i: int) -> int:
        """End of document ``i``: select the i-th set bit, then add its low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        left = i % self.sample
        at = int(self.samples[i // self.sample])  # bit of a set bit at most sample - 1 before
        byte, bit = at // 8, at % 8
        while True:
            word = int(self.high[byte]) >> bit << bit if bit else int(self.high[byte])
            ones = word.bit_count()
            if left < ones:
                for _ in range(left):
                    word &= word - 1
                at = byte * 8 + (word & -word).bit_length() - 1
                break
            left, byte, bit = left - ones, byte + 1, 0
        value = (at - i) << self.width
        for j in range(self.width):
            b = i * self.width + j
            value |= (int(self.low[b >> 3]) >> (b & 7) & 1) << j
        return value

    def all(self) -> np.ndarray:
        """Every boundary at once."""
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.width].reshape(self.n, self.width)
        low = (bits.astype(np.int64) << np.arange(self.width)).sum(1) if self.width else 0
        return (high << self.width) + low


def shard_parts(ends: np.ndarray, ids: list[np.ndarray]) -> Iterator[bytes]:
    """The bytes of a shard part by part; ``ids`` are never held a second time."""
    width, low, high, samples = ef_encode(ends)
    each = 2 if all(part.max(initial=0) < 65536 for part in ids) else 4
    yield MAGIC
    yield np.array([len(ends), sum(map(len, ids)), width, len(low), len(high), SAMPLE, each], "<u8").tobytes()
    yield from (low, high, samples.astype("<u8").tobytes())
    for part in ids:
        yield part.astype(f"<u{each}").tobytes()


def pack_shard(ends: np.ndarray, ids: np.ndarray) -> bytes:
    return b"".join(shard_parts(ends, [ids]))


def unpack_shard(data) -> tuple[EliasFano, np.ndarray]:
    """Boundaries and ids of a shard; views of ``data``, nothing is copied."""
    if bytes(data[:8]) != MAGIC:
        raise ValueError("not a token shard")
    n, total, width, n_low, n_high, sample, each = np.frombuffer(data, "<u8", 7, 8).tolist()
    at = 8 + 56
    low = np.frombuffer(data, np.uint8, n_low, at)
    high = np.frombuffer(data, np.uint8, n_high, at + n_low)
    at += n_low + n_high
    n_samples = -(-n // sample)
    samples = np.frombuffer(data, np.uint8, n_samples * 8, at).view("<u8")
    ids = np.frombuffer(data, np.uint8, total * each, at + n_samples * 8).view(f"<u{each}")
    return EliasFano(n, width, low, high, samples, sample), ids


# ------------------------------------------------------------------ tokenizing
def _of(codes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(codes)] = True
    return t


_SPACE, _POINT, _VISIBLE = _of(b" \t\n\r"), _of(b".,;:!?"), _of(range(0x21, 0x7F))
_LETTER = _of([*range(0x41, 0x5B), *range(0x61, 0x7B)])


def pieces(flat: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Bytes where a piece starts. Pieces tile the texts and never cut a token.

    The tokenizer splits a text into letters, digits, other marks and white
    space, each with at most one space before it. A split is certain (a) before
    ASCII white space that follows a visible character and (b) before one of
    ``.,;:!?`` that follows a letter. Only such places are used, and only after
    characters known to be visible or letters: ASCII, or two-byte Latin ones.
    """
    if not len(flat):
        return np.empty(0, np.int64)
    one, two = np.zeros(len(flat), np.uint8), np.zeros(len(flat), np.uint8)
    one[1:], two[2:] = flat[:-1], flat[:-2]
    latin = (two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7)
    cut = _SPACE[flat] & (_VISIBLE[one] | latin) | _POINT[flat] & (_LETTER[one] | latin)
    cut[rows[:-1][rows[:-1] < len(flat)]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of whole texts; each distinct piece is encoded by the library once.

    The ids of up to ``limit`` pieces are kept while the worker lives.
    """

    def __init__(self, path: str, limit: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        # sorted hashes of pieces, and their numbers
        self.known, self.number = np.empty(0, U64), np.empty(0, np.int64)
        self.ids, self.at = array("I"), array("q", [0])  # ids of piece i: ids[at[i]:at[i + 1]]

    def _learn(self, new: list[str], keys: np.ndarray, place: np.ndarray) -> None:
        for a in range(0, len(new), 4096):
            for e in self.tokenizer.encode_batch_fast(new[a : a + 4096], add_special_tokens=False):
                self.ids.extend(e.ids)
                self.at.append(len(self.ids))
        first = len(self.known)
        self.number = np.insert(self.number, place, np.arange(first, first + len(keys)))
        self.known = np.insert(self.known, place, keys)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the texts, and where each text's ids end."""
        flat, rows = text_bytes(texts)
        start = pieces(flat, rows)
        if not len(start):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        length = np.diff(start, append=len(flat))
        power = np.cumprod(np.full(int(length.max()), BASE, U64))
        spread = BYTE[flat] * power[np.arange(len(flat)) - np.repeat(start, length)]
        key = mix(np.add.reduceat(spread, start) + length.astype(U64))
        order = np.argsort(key)
        new = np.ones(len(key), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        first, which = order[new], np.empty(len(key), np.int64)
        which[order] = np.cumsum(new) - 1
        distinct = key[first]
        if len(self.known) + len(distinct) > self.limit:
            self._forget()
        place = np.searchsorted(self.known, distinct)
        old = place < len(self.known)
        fresh = ~old
        fresh[old] = self.known[place[old]] != distinct[old]
        if fresh.any():
            raw = flat.tobytes()
            spans = zip(start[first[fresh]].tolist(), length[first[fresh]].tolist())
            self._learn([raw[a : a + n].decode() for a, n in spans], distinct[fresh], place[fresh])
        number = self.number[np.searchsorted(self.known, distinct)]
        at = np.frombuffer(self.at, np.int64)
        begin, count = at[number][which], (at[number + 1] - at[number])[which]
        total = np.cumsum(count)
        ids = np.frombuffer(self.ids, np.uint32)[np.arange(total[-1]) + np.repeat(begin - total + count, count)]
        last = np.searchsorted(start, rows[1:])  # pieces up to the end of each text
        return ids, np.concatenate([[0], total])[last]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ------------------------------------------------------------------ files
def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if not urlparse(uri).scheme:
        uri = f"file://{uri}"
    return pafs.FileSystem.from_uri(uri)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share."""
    from gleaner.session import checkpoint_folder

    return f"{checkpoint_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"


def _write(batches, folder: str, tokenizer: str, end_id: int, shard_ids: int):
    from pyspark import TaskContext

    encode = encoder(tokenizer).encode
    part = TaskContext.get().partitionId()
    fs, root = file_system(folder)
    ids, ends, docs, total = [], [], [], 0

    def flush():
        name = f"shard-{part:06d}-{len(written):05d}-{uuid.uuid4().hex}.bin"
        with fs.open_output_stream(f"{root}/{name}") as out:
            for some in shard_parts(np.concatenate(ends), ids):
                out.write(some)
        # the doc ids of a shard are a file of their own, in the same order
        with fs.open_output_stream(f"{root}/{name}.docs") as out:
            with pa.ipc.new_stream(out, pa.schema([("doc_id", pa.int64())])) as w:
                w.write_batch(pa.record_batch([pa.concat_arrays(docs)], ["doc_id"]))
        written.append(name)
        return pa.RecordBatch.from_pylist(
            [{"part": part, "file": name, "seq": len(written) - 1, "n_docs": sum(map(len, ends)), "n_ids": total}],
            schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
        )

    written: list[str] = []
    for batch in slices(batches, "text", SLICE):
        own, stop = encode(batch.column("text"))
        ids.append(np.insert(own, stop, end_id))  # the end id after each text
        ends.append(total + stop + np.arange(1, batch.num_rows + 1))
        total += len(own) + batch.num_rows
        # a copy: the column itself would hold the texts of its whole batch
        docs.append(batch.column("doc_id").take(pa.array(np.arange(batch.num_rows))))
        if total >= shard_ids:
            yield flush()
            ids, ends, docs, total = [], [], [], 0
    if ends:
        yield flush()


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    shard_ids: int = SHARD_IDS,
) -> DataFrame:
    """Write shards in document order; the manifest ``(file, n_docs, n_ids, start)``.

    One range shuffle by id orders the texts. The manifest has a row a shard:
    its prefix sums give each shard's place among all ids.
    """
    from gleaner.session import checkpointed

    spark = docs.sparkSession
    ship_package(spark)
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = (
        rows.withColumn("text_key", F.xxhash64("text"))
        .repartitionByRange("doc_id", "text_key")
        .sortWithinPartitions("doc_id", "text_key")
        .drop("text_key")
    )
    shards = checkpointed(
        ordered.mapInArrow(
            lambda it: _write(it, folder, tokenizer, end_id, shard_ids),
            "part int, file string, seq int, n_docs long, n_ids long",
        )
    )
    # a row a shard of 8 million ids: small metadata, summed on the driver
    listed, start, out = shards.orderBy("part", "seq").toPandas(), 0, []
    for r in listed.itertuples():
        out.append((r.file, int(r.n_docs), int(r.n_ids), start))
        start += int(r.n_ids)
    return spark.createDataFrame(out, "file string, n_docs long, n_ids long, start long")


def _read(batches, folder: str):
    fs, root = file_system(folder)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for shard in batch.to_pylist():
            with fs.open_input_file(f"{root}/{shard['file']}") as f:
                bounds, ids = unpack_shard(f.read_buffer())
            with fs.open_input_stream(f"{root}/{shard['file']}.docs") as f:
                names = pa.ipc.open_stream(f).read_all()["doc_id"].combine_chunks()
            ends = bounds.all()
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(begins.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(begins + shard["start"]), pa.array(ends - begins), pa.array(crc, pa.int64())], schema=schema
            )


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document ``(doc_id, start, n_tokens, ids_crc32)`` from the files of a manifest."""
    spark = manifest.sparkSession
    ship_package(spark)
    parts = max(1, min(manifest.count(), 10_000))
    return manifest.repartition(parts).mapInArrow(
        lambda it: _read(it, folder), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards to the shared folder and read the documents back from them."""
    folder = shared_folder(docs.sparkSession)
    return read_tokens(write_tokens(docs, folder, tokenizer, end_id, doc_id, text), folder)
