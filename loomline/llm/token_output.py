"""Token ids as binary files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents.  Ids are cut into blocks of 128; a block stores its
minimum, the differences to it packed at the width that fits the 90th percentile, and the
differences that do not fit in an exception list (position and high bits).  Blocks are written as ids arrive; what describes
them stands behind them.  Layout, little-endian::

    magic "LPF2"
    blocks: u32 minimum | u8 width | u8 exceptions | packed bits | u8 positions | u32 high parts
    i64 doc_id of each document | u32 ids of each document
    u64 byte offset of each block start
    u64 where the doc_ids begin | u32 documents | u64 ids | u32 blocks | magic "LPF2"

A file of documents without doc_id has the magic "LPN2" and no doc_ids.

Files are named by their place in doc_id order, those without doc_id after all others, written under another name and then renamed, so that a
task that runs again replaces what it wrote with the same bytes.  A task holds some hundred thousand ids, whatever the length of a document.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, table, text_bytes
from .token_counts import ByteAlphabet, Remembered, vocabulary_path

MAGIC, MAGIC_NULL = b"LPF2", b"LPN2"
TRAILER = struct.Struct("<QIQI4s")
HEAD = struct.Struct("<IBB").pack
BLOCK = 128
PERCENTILE = 90
#: Any other character sends a text to the library whole.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
OTHER = re.compile(f"[^{LETTERS}\\x00-\\x7f]")
#: The pattern of the file, for those characters. Fixed value.
PIECES = re.compile(f" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[\\x00-\\x08\\x0e-\\x1f!-/:-@[-`{{-\\x7f]+| ?[0-9]+|[\\t-\\r ]+(?![^\\t-\\r ])|[\\t-\\r ]+")
#: A piece always begins at a lone space between other characters, so a long text may be cut there.
CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")
#: Characters of a text that are encoded at once, about.
CHARS = 1 << 19
#: Ids in a file, about, but for a document that has more; and ids that are packed at once.
FILE_IDS, PACKED_IDS = 4_000_000, 1 << 18
#: Bytes of the input to a partition, about; rows of a batch that are turned into Python objects at once.
PART_BYTES, ROWS = 64 << 20, 256
#: Partitions whose files are summed together.
PARTS_TOGETHER = 1024


def cuts(text: str):
    """``text`` in stretches of about CHARS characters, ended where the next piece begins."""
    at = 0
    while len(text) - at > CHARS and (m := CUT.search(text, at + CHARS)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class PieceEncoder:
    """Ids of texts as the library gives them, pieces looked up once known.

    The pieces are those of the file's own pattern; texts with characters on which regex libraries could differ, or with
    special strings, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = ByteAlphabet()
        self.model = self.tokenizer.model
        self.written = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known = Remembered(self._piece)

    def encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        return b"".join([self.written[t.id] for t in self.model.tokenize(piece.translate(self.alphabet))])

    def stretches(self, text: str):
        """Ids as little-endian unsigned 32-bit integers, a stretch of the text at a time."""
        if not text.isascii() and OTHER.search(text) or any(s in text for s in self.special):
            yield self.encode(text)
        else:
            for part in cuts(text):
                yield b"".join(self.known.all(PIECES.findall(part)))

    def ids(self, text: str) -> bytes:
        return b"".join(self.stretches(text))


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder_of(path: str) -> PieceEncoder:
    """The encoder of this worker process, which later tasks find with what it knows."""
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, PieceEncoder(path))


def _pack(values: np.ndarray, widths: np.ndarray) -> list[bytes]:
    """The low ``widths[i]`` bits of each row of 128 values, packed; rows of one width go together."""
    out: list[bytes] = [b""] * len(values)
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        for first in range(0, len(rows) if w else 0, 512):
            some = rows[first : first + 512]
            bits = ((values[some][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
            for i, b in zip(some, np.packbits(bits.reshape(len(some), -1), axis=1, bitorder="little")):
                out[i] = b.tobytes()
    return out


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of ``ids``; a last one that is not full repeats its last id."""
    rows = np.concatenate([ids, np.repeat(ids[-1:], -len(ids) % BLOCK)]).astype(np.uint32).reshape(-1, BLOCK)
    low = rows.min(axis=1) if len(rows) else np.empty(0, np.uint32)
    diff = rows - low[:, None]
    ranked = np.sort(diff, axis=1)[:, BLOCK * PERCENTILE // 100]
    widths = np.ceil(np.log2(ranked.astype(np.float64) + 1)).astype(np.uint32)
    over = (diff >> np.minimum(widths, 31)[:, None]) * (widths < 32)[:, None]
    lines, places = np.nonzero(over)
    edges = np.searchsorted(lines, np.arange(len(diff) + 1)).tolist()
    high, places = over[lines, places].astype("<u4").tobytes(), places.astype(np.uint8).tobytes()
    packed = _pack(diff, widths)
    heads = zip(low.tolist(), widths.tolist(), packed, edges, edges[1:])
    return [HEAD(m, w, b - a) + bits + places[a:b] + high[4 * a : 4 * b] for m, w, bits, a, b in heads]


class TokenFile:
    """Writes one file: documents in order, each as stretches of ids and then its end."""

    def __init__(self, out, null_ids: bool):
        self.out, self.magic, self.null_ids = out, MAGIC_NULL if null_ids else MAGIC, null_ids
        self.doc_ids, self.counts, self.starts, self.at = [], [], [], len(MAGIC)
        self.held, self.n, self.n_document = bytearray(), 0, 0
        out.write(self.magic)

    def add(self, ids: bytes) -> None:
        self.held += ids
        self.n_document += len(ids) // 4
        if len(self.held) >= 4 * PACKED_IDS:
            self._write(len(self.held) // (4 * BLOCK) * BLOCK)

    def end(self, doc_id: int | None) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(self.n_document)
        self.n, self.n_document = self.n + self.n_document, 0

    def _write(self, n: int) -> None:
        blocks = encode_blocks(np.frombuffer(bytes(self.held[: 4 * n]), "<u4"))
        del self.held[: 4 * n]
        for b in blocks:
            self.starts.append(self.at)
            self.at += len(b)
        self.out.write(b"".join(blocks))

    def close(self) -> None:
        if self.held:
            self._write(len(self.held) // 4)
        if not self.null_ids:
            self.out.write(np.array(self.doc_ids, "<i8").tobytes())
        self.out.write(np.array(self.counts, "<u4").tobytes() + np.array(self.starts, "<u8").tobytes())
        self.out.write(TRAILER.pack(self.at, len(self.counts), self.n, len(self.starts), self.magic))


def encode_file(doc_ids: np.ndarray | None, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The file image of documents ``doc_ids`` (None: they have no doc_id) with ``counts`` ids each, concatenated in ``ids``."""
    out = io.BytesIO()
    file, at = TokenFile(out, doc_ids is None), 0
    for i, n in enumerate(counts.tolist()):
        file.add(ids[at : at + n].astype("<u4").tobytes())
        file.end(None if doc_ids is None else int(doc_ids[i]))
        at += n
    file.close()
    return out.getvalue()


class TokenReader:
    """Reads a file (anything with ``seek`` and ``read``) some blocks at a time."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2)
        at, docs, self.n, blocks, magic = TRAILER.unpack(self._read(size - TRAILER.size, TRAILER.size))
        if magic not in (MAGIC, MAGIC_NULL):
            raise ValueError("not a token file")
        raw, ids = self._read(at, size - TRAILER.size - at), 0 if magic == MAGIC_NULL else 8 * docs
        self.doc_ids = np.frombuffer(raw, "<i8", docs) if magic == MAGIC else None
        self.counts = np.frombuffer(raw, "<u4", docs, ids)
        self.starts = np.append(np.frombuffer(raw, "<u8", blocks, ids + 4 * docs), np.uint64(at)).astype(np.int64)

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop - 1: only the blocks that hold them are read."""
        if stop <= start:
            return np.empty(0, "<u4")
        first, last = start // BLOCK, -(-stop // BLOCK)
        data = self._read(int(self.starts[first]), int(self.starts[last] - self.starts[first]))
        return decode_blocks(data, self.starts[first:last] - self.starts[first])[start - first * BLOCK : stop - first * BLOCK]


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that begin at ``starts`` (the last block of a file may hold padding)."""
    out, at = np.empty((len(starts), BLOCK), dtype="<u4"), starts.tolist()
    heads = np.frombuffer(b"".join([data[s : s + 6] for s in at]), [("low", "<u4"), ("width", "u1"), ("over", "u1")])
    widths = heads["width"].astype(np.int64)
    for w in np.unique(widths).tolist():
        rows, size = np.flatnonzero(widths == w), w * BLOCK // 8
        if not w:
            out[rows] = 0
            continue
        raw = b"".join([data[p : p + size] for p in (starts[rows] + 6).tolist()]) + bytes(8)
        values, kind = np.empty((len(rows) * BLOCK // 8, 8), dtype="<u4"), np.dtype("<u4" if w + 7 <= 32 else "<u8")
        mask = kind.type((1 << w) - 1)
        for j in range(8):  # eight values take w bytes; the j-th begins at bit j * w of them
            view = np.ndarray(len(values), kind, raw, j * w >> 3, (w,))
            values[:, j] = (view >> kind.type(j * w & 7)) & mask
        out[rows] = values.reshape(len(rows), BLOCK)
    out += heads["low"][:, None]
    n = heads["over"].astype(np.int64)
    first = starts + 6 + widths * BLOCK // 8
    places = np.frombuffer(b"".join([data[p : p + k] for p, k in zip(first.tolist(), n.tolist())]), np.uint8)
    high = np.frombuffer(b"".join([data[p : p + 4 * k] for p, k in zip((first + n).tolist(), n.tolist())]), "<u4")
    rows = np.repeat(np.arange(len(starts)), n)
    out[rows, places] += (high.astype(np.uint64) << widths[rows].astype(np.uint64)).astype(np.uint32)
    return out.reshape(-1)


def read_head(image: bytes) -> TokenReader:
    return TokenReader(io.BytesIO(image))


def decode_ids(image: bytes, start: int, stop: int) -> np.ndarray:
    return TokenReader(io.BytesIO(image)).ids(start, stop)


def document_sums(reader: TokenReader) -> list[int]:
    """crc32 of the ids of each document, some blocks at a time."""
    sums, ends = np.zeros(len(reader.counts), np.int64).tolist(), np.cumsum(reader.counts, dtype=np.int64)
    begins = ends - reader.counts
    for a in range(0, reader.n, PACKED_IDS):
        b = min(reader.n, a + PACKED_IDS)
        raw = memoryview(reader.ids(a, b).tobytes())
        first, last = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(begins, b, "left"))
        lows, highs = np.maximum(begins[first:last] - a, 0) * 4, np.minimum(ends[first:last] - a, b - a) * 4
        for i, (x, y) in enumerate(zip(lows.tolist(), highs.tolist()), first):
            sums[i] = zlib.crc32(raw[x:y], sums[i])
    return sums


FILES = "part int, nth int, file string, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int) -> DataFrame:
    """Encode every text, add ``end_id``, and write files in ascending doc_id order under ``folder``.

    Null texts count as empty; rows without doc_id follow all others, in files of their own.  Rows of one doc_id are ordered by a hash of
    their text, then by the text; as ranges are also split between equal rows, neither a frequent doc_id nor a frequent row makes a large task.
    Returns one row for each file, computed when it is read: part, nth (of the part), file, n_docs, n_ids.
    """

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        encoder, part, end = encoder_of(path), TaskContext.get().partitionId(), struct.pack("<I", end_id)
        found, file, tmp = [], None, ""

        def close():
            file.close()
            file.out.close()
            name = f"tokens-{part:06d}-{len(found):06d}.lpf"
            store.move(tmp, f"{root}/{name}")
            found.append((part, len(found), name, len(file.counts), file.n))

        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                some = batch.slice(a, ROWS)
                for doc_id, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist()):
                    if file and (file.n >= FILE_IDS or file.null_ids != (doc_id is None)):
                        close()
                        file = None
                    if not file:
                        tmp = f"{root}/_{uuid.uuid4().hex}"
                        file = TokenFile(store.open_output_stream(tmp), doc_id is None)
                    for ids in encoder.stretches(text or ""):
                        file.add(ids)
                    file.add(end)
                    file.end(doc_id)
        if file:
            close()
        cols = list(zip(*found)) if found else [()] * 5
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["part", "nth", "file", "n_docs", "n_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(rows) // PART_BYTES))
    last = F.col("doc_id").asc_nulls_last()
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts, last, "hash", "place").sortWithinPartitions(last, "hash", "text")
    return rows.select("doc_id", "text").mapInArrow(run, FILES)


def with_bases(files: DataFrame) -> DataFrame:
    """``files`` with ``base``, the ids of all files before: sums of some partitions first, so that one task sees a thousandth of the files."""
    group = F.floor(F.col("part") / PARTS_TOGETHER).cast("int")
    files = files.withColumn("group", group)
    within = F.sum("n_ids").over(Window.partitionBy("group").orderBy("part", "nth")) - F.col("n_ids")
    sums = files.groupBy(F.col("group").alias("g")).agg(F.sum("n_ids").alias("n"))
    sums = sums.select("g", (F.sum("n").over(Window.orderBy("g")) - F.col("n")).alias("before"))
    return files.withColumn("within", within).join(sums, F.col("group") == F.col("g")).select("file", (F.col("before") + F.col("within")).alias("base"))


def read_token_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Documents of the files under ``folder``: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with store.open_input_file(f"{root}/{name}") as source:
                    reader = TokenReader(source)
                    n = len(reader.counts)
                    counts = reader.counts.astype(np.int64)
                    ids = pa.nulls(n, pa.int64()) if reader.doc_ids is None else pa.array(reader.doc_ids)
                    sums = pa.array(document_sums(reader), pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.cumsum(counts) - counts + base), pa.array(counts), sums], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one file to a task, or a few: the list is short, the files are not
    parts = max(1, min(files.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return with_bases(files).repartition(parts).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write the token files into the shared folder and return what they hold, by document.

    One row for each row of ``docs``: null texts count as empty, repeated rows are written each, rows without doc_id come last; an empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    store_ready = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store_ready.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(store_ready)
    files = write_token_files(docs, path, folder, end_id)
    files.write.parquet(manifest := f"{folder}-files")
    return read_token_files(spark, folder, spark.read.schema(files.schema).parquet(manifest))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), end_id=2)
