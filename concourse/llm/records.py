"""Token ids as length-delimited binary records.

A file holds a range of doc_id in ascending order. A record is

    length of the payload    unsigned 64-bit
    masked checksum of those 8 bytes    unsigned 32-bit
    payload
    masked checksum of the payload    unsigned 32-bit

all little-endian. The checksum is CRC-32; masking rotates it right by 15 bits and adds a
constant, so that a file that holds checksums is not checked by its own. The payload is
1 byte of id width (2 or 4), 1 byte that tells whether there is a doc_id, 8 bytes of
doc_id, and the ids. Beside each file, ``.idx`` holds the records' byte offsets and the
file's length as unsigned 64-bit numbers, for reads in any order.

Each task writes its files under temporary names and renames them when whole, so a task that
runs again after a lost executor puts the same file in the same place. Reading checks every
length and checksum.

Defined results: null texts count as empty and give a record of the end id alone; null ids
come first; of rows with one doc_id the one of smaller text hash comes first; repeated
rows give a record each. Long texts are one record. An empty table gives no file and no row.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concourse.llm.common import staged, whole_text
from concourse.llm.ordering import order_key, range_of, range_starts
from concourse.llm.text_parts import PartEncoder
from concourse.session import scratch_path

FILE_ROWS = 4_000     # documents of a file, while there are fewer than MOST_FILES files
MOST_FILES = 20_000
END_ID = 0
MASK_ADD = 0xA282EAD8
KNOWN = 600_000       # parts of texts a worker keeps the ids of; cleared when it has more
HEAD = struct.Struct("<QI")
FIELDS = struct.Struct("<BBq")
WORKERS: dict = {}    # a worker's encoders, by vocabulary; workers outlive tasks


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_ADD) & 0xFFFFFFFF


def pack(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = FIELDS.pack(width, doc_id is not None, doc_id or 0) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def unpack(record: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of a record; ValueError if a length or checksum does not hold."""
    length, crc = HEAD.unpack_from(record)
    payload = record[HEAD.size:-4]
    if crc != masked(record[:8]) or length != len(payload) or masked(payload) != struct.unpack("<I", record[-4:])[0]:
        raise ValueError("damaged record")
    width, known, doc_id = FIELDS.unpack_from(payload)
    return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", offset=FIELDS.size)


class RecordFile:
    """Records of a file, by number."""

    def __init__(self, base: str):
        store, path = fs.FileSystem.from_uri(base + ".rec")
        self.file = store.open_input_file(path)
        with store.open_input_stream(path[:-4] + ".idx") as f:
            self.offsets = np.frombuffer(f.read(), "<u8")

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, i: int) -> tuple[int | None, np.ndarray]:
        start, end = int(self.offsets[i]), int(self.offsets[i + 1])
        return unpack(self.file.read_at(end - start, start))


class RecordWriter:
    """Writes one file and its index, renamed into place by ``close``."""

    def __init__(self, base: str):
        self.store, self.path = fs.FileSystem.from_uri(base + ".rec")
        self.store.create_dir(os.path.dirname(self.path), recursive=True)
        self.part = f"{self.path}.{os.getpid()}-{os.urandom(6).hex()}"
        self.out, self.offsets = self.store.open_output_stream(self.part), [0]

    def add(self, record: bytes) -> None:
        self.out.write(record)
        self.offsets.append(self.offsets[-1] + len(record))

    def close(self) -> None:
        self.out.close()
        index = self.path[:-4] + ".idx"
        with self.store.open_output_stream(self.part + ".idx") as f:
            f.write(np.array(self.offsets, "<u8").tobytes())
        self.store.move(self.part + ".idx", index)
        self.store.move(self.part, self.path)


def _worker(shared, mark: str) -> tuple[PartEncoder, int]:
    """The worker's encoder and its id width. ``shared`` is a broadcast of the tokenizer file."""
    if mark not in WORKERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer
        tok = Tokenizer.from_str(shared.value)
        tok.encode_special_tokens = True                # their strings are ordinary text here

        def encode(parts: list[str]) -> list[bytes]:
            return [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(parts, add_special_tokens=False)]

        WORKERS[mark] = (PartEncoder(lambda text: [text], encode, KNOWN),
                         2 if tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4)
    return WORKERS[mark]


def file_base(folder: str, file: int) -> str:
    return f"{folder}/part-{file:08d}"


def write_records(docs: DataFrame, tokenizer_path: str, folder: str) -> DataFrame:
    """Write ``docs`` (doc_id, text) into ``folder``, a URI that driver and executors share;
    returns the table (file, records, ids) of the files."""
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    shared, mark = docs.sparkSession.sparkContext.broadcast(text), hashlib.md5(text.encode()).hexdigest()
    starts = range_starts(docs, FILE_ROWS, MOST_FILES) or [0]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, width = _worker(shared, mark)
        done, now, out = [], None, None
        for b in batches:
            file, ids_ = b.column("file").to_numpy(), b.column("doc_id").to_pylist()
            row = 0
            for ids, end in encoder.slices(b.column("text")):
                begin = 0
                for stop in end.tolist():
                    if file[row] != now:
                        if out:
                            out.close()
                        now, out = int(file[row]), RecordWriter(file_base(folder, int(file[row])))
                        done.append([now, 0, 0])
                    out.add(pack(ids_[row], np.append(ids[begin:stop], END_ID), width))
                    done[-1][1] += 1
                    done[-1][2] += stop - begin + 1
                    begin, row = stop, row + 1
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64()) for i in range(3)],
                                         ["file", "records", "ids"])

    k = order_key()
    rows = (docs.select(range_of(k, starts).cast("long").alias("file"), F.col("doc_id").cast("long").alias("doc_id"),
                        whole_text().alias("text"))
            .repartition("file")
            .sortWithinPartitions("file", F.col("doc_id").asc_nulls_first(), F.xxhash64("text")))
    return staged(rows.mapInArrow(write, "file long, records long, ids long"), "files")


def read_records(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record of the files; ``start`` counts the
    ids of all records before it."""
    by = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    placed = files.select("file", F.coalesce(F.sum("ids").over(by), F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist()):
                records, rows = RecordFile(file_base(folder, file)), []
                for i in range(len(records)):
                    doc_id, ids = records[i]
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = placed.sparkSession.sparkContext.defaultParallelism
    return placed.repartition(4 * n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shared_uri(spark: SparkSession, folder: str) -> str:
    """``folder`` as a URI of the file system that Spark takes it for, so that executors write where Spark would."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def record_round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write ``docs`` into a new shared folder and read the files back."""
    folder = shared_uri(docs.sparkSession, scratch_path(docs.sparkSession, "records"))
    return read_records(write_records(docs, tokenizer_path, folder), folder)
