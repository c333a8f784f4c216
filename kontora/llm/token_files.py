"""Token ids as Arrow files of fixed-size lists, for random access to equal-length sequences without copying.

Documents are put in ascending order of their ids by a range partitioning; each partition writes one Arrow file of record
batches with two fixed-size-list columns, the ids and a mask (true where a token stands, false in the padding that ends
the file), and beside it an Arrow file that says where each document starts. Ids take two bytes where the vocabulary
allows. A task writes under a name of its own and moves the file to its place, so that repeated tasks do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Codec, default_vocabulary
from .common import scratch, stored
from .words import slices

SEQUENCE = 2048
BATCH = 128


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _schema(sequence: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


class _Writer:
    """One file; tokens are gathered until a batch of sequences is full."""

    def __init__(self, sink, sequence: int, batch: int, wide: bool):
        self.schema, self.sequence, self.size = _schema(sequence, wide), sequence, sequence * batch
        self.kind = np.uint32 if wide else np.uint16
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.count = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.count += len(ids)
        self.total += len(ids)
        if self.count >= self.size:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.size * self.size
            for k in range(0, whole, self.size):
                self._write(flat[k : k + self.size], self.size)
            self.held, self.count = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (flat, mask)], schema=self.schema))

    def close(self) -> None:
        if self.count:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.sequence) * self.sequence, self.kind)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self.out.close()


def write(docs: DataFrame, folder: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, sequence: int = SEQUENCE, batch: int = BATCH) -> DataFrame:
    """Encode docs into files below folder; one row per file: shard, path, n_tokens, n_docs, start (tokens before it).

    A null text counts as empty; end_id follows every document where given. Rows that repeat an id all are written, in
    the order of their texts. A table without rows gives no files. Other columns of docs are ignored. The folder is one
    that the workers' Arrow can open by its URI (local, HDFS, S3 and the like).
    """
    vocab = vocabulary or default_vocabulary()
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).repartitionByRange(parts, "id").sortWithinPartitions("id", "t")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocab)
        wide = len(codec.table) > 1 << 16
        tail = np.array([] if end_id is None else [end_id], "<u4")
        task = TaskContext.get()
        fs, root = _place(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/shard-{task.partitionId():06d}"
        own = f"{root}/.{task.partitionId():06d}-{task.taskAttemptId()}"
        writer = index = None
        docs_in = 0
        for b in batches:
            for some in slices(b, 1):
                if writer is None:
                    sink, index_sink = fs.open_output_stream(f"{own}.arrow"), fs.open_output_stream(f"{own}.index")
                    writer = _Writer(sink, sequence, batch, wide)
                    keys = pa.schema([("id", b.schema.field(0).type), ("offset", pa.int64()), ("n_tokens", pa.int64())])
                    index = pa.ipc.new_file(index_sink, keys)
                ids, at = codec.encode_array(some.column(1))
                ids, at = np.insert(ids, np.repeat(at[1:], len(tail)), np.tile(tail, len(some))), at + len(tail) * np.arange(len(at))
                columns = [some.column(0), pa.array(writer.total + at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64())]
                index.write_batch(pa.record_batch(columns, schema=keys))
                writer.add(ids)
                docs_in += len(some)
        codec.rest()
        if writer is None:
            return
        writer.close()
        index.close()
        sink.close()
        index_sink.close()
        for kind in ("index", "arrow"):
            fs.move(f"{own}.{kind}", f"{name}.{kind}")
        scheme = folder.partition(root)[0]
        kinds = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())])
        yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "path": [f"{scheme}{name}"], "n_tokens": [writer.total], "n_docs": [docs_in]}, schema=kinds)

    made = stored(rows.mapInArrow(shard, "shard int, path string, n_tokens long, n_docs long"), "token-shards")
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return made.withColumn("start", before)  # one row per file


class Shard:
    """Random access to one file. Local files are mapped into memory, and sequences are views of the map."""

    def __init__(self, path: str):
        fs, root = _place(path)
        local = fs.type_name == "local"
        self.source = pa.memory_map(f"{root}.arrow") if local else fs.open_input_file(f"{root}.arrow")
        self.file = pa.ipc.open_file(self.source)
        self.index = pa.ipc.open_file(fs.open_input_file(f"{root}.index")).read_all()
        self.sequence = self.file.schema.field("ids").type.list_size
        self.batch = len(self.file.get_batch(0)) if self.file.num_record_batches else 0

    def sequence_at(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of the k-th sequence."""
        b = self.file.get_batch(k // self.batch)
        i = k % self.batch * self.sequence
        ids, mask = b.column("ids").flatten(), b.column("mask").flatten()
        return ids.slice(i, self.sequence).to_numpy(), mask.slice(i, self.sequence).to_numpy(zero_copy_only=False)

    def tokens(self, start: int, count: int) -> np.ndarray:
        """Tokens start to start + count of the file, across sequences and batches."""
        out, step = [], self.batch * self.sequence
        while count:
            flat = self.file.get_batch(start // step).column("ids").flatten().to_numpy()
            part = flat[start % step : start % step + count]
            out.append(part)
            start, count = start + len(part), count - len(part)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def read_documents(shards: DataFrame, id_type: str = "bigint") -> DataFrame:
    """One row per document in the files: id, start, n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers)."""
    schema = f"id {id_type}, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(path)
                for part in shard.index.to_batches(max_chunksize=4096):
                    starts, counts = part.column(1).to_numpy(), part.column(2).to_numpy()
                    sums = [zlib.crc32(shard.tokens(int(s), int(n)).astype("<u4").tobytes()) for s, n in zip(starts, counts, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(starts + base), part.column(2), pa.array(sums, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    parts = max(1, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return shards.select("path", "start").repartition(parts, "path").mapInArrow(read, schema)


def new_folder(spark) -> str:
    return scratch(spark, "token-files")
