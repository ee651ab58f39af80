"""Flat files of token ids with 64-bit document offsets.

A folder holds shards ``tokens-00000.bin`` (unsigned integers, little endian, as narrow as the vocabulary allows),
``tokens-00000.idx`` and the table ``manifest``. An index holds: a magic word, the bytes per id and the number of
documents n (three uint64), n + 1 int64 offsets counted over all shards, n int64 document ids, n bytes that say
whether the id is set. Shards follow ascending document ids; the base of a shard is the sum of those before it.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainscope.llm.batches import offsets_of, slices_by_bytes
from grainscope.llm.wordtokens import END_OF_DOCUMENT, word_tokens
from grainscope.session import save_and_reload

MAGIC = 0x315844494B4F54   # fixed value: "TOKIDX1"
BLOCK = 1 << 20            # documents per block of rows read back


@dataclass(frozen=True)
class TokenFiles:
    spark: SparkSession
    folder: str

    @property
    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/manifest")


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _write(folder: str, name: str, parts: list[bytes | memoryview]) -> None:
    """Write beside the place and move: a task that is repeated replaces the file as a whole."""
    fs, path = _file_system(folder)
    part = f"{path}/.{name}.{os.getpid()}-{os.urandom(4).hex()}"
    with fs.open_output_stream(part) as out:
        for p in parts:
            out.write(p)
    fs.move(part, f"{path}/{name}")


def _map(folder: str, name: str, dtype: str, offset: int = 0, count: int = -1) -> np.ndarray:
    """Part of a file as an array: mapped where the file system is a local one, read otherwise."""
    fs, path = _file_system(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        size = os.path.getsize(f"{path}/{name}") - offset
        n = size // np.dtype(dtype).itemsize if count < 0 else count
        return np.memmap(f"{path}/{name}", dtype, "r", offset, n) if n else np.zeros(0, dtype)
    with fs.open_input_file(f"{path}/{name}") as f:
        f.seek(offset)
        return np.frombuffer(f.read() if count < 0 else f.read(count * np.dtype(dtype).itemsize), dtype)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end: int = END_OF_DOCUMENT,
                      id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encode every text, close it with ``end`` and write the ids in ascending order of ``id_col``.

    NULL and empty texts are the end id alone; NULL ids come first; rows with equal ids follow each other in an
    order given by their text. Other columns are ignored; an empty table gives an empty manifest. Texts are dealt
    out by ranges of (id, hash of the text), so that one id with very many rows spans several shards; each task
    writes one shard, file by file, and repeats safely. ``folder`` must be reachable by all executors.
    """
    fs, path = _file_system(folder)
    fs.create_dir(path, recursive=True)
    wide = word_tokens(tokenizer).size > 1 << 16
    dtype = "<u4" if wide else "<u2"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens(tokenizer)
        shard = TaskContext.get().partitionId()
        lengths, ids_of = [], []
        fs, path = _file_system(folder)
        name = f"tokens-{shard:05d}"
        part = f"{path}/.{name}.{os.getpid()}-{os.urandom(4).hex()}"
        with fs.open_output_stream(part) as out:
            for batch in batches:
                ids_of.append(batch.column(0))
                for a, b in slices_by_bytes(batch.column(1)):
                    ids, n = encoder.documents(batch.column(1).slice(a, b - a), end)
                    out.write(ids.astype(dtype).tobytes())
                    lengths.append(n)
        if not lengths:
            fs.delete_file(part)
            return
        fs.move(part, f"{path}/{name}.bin")
        n = np.concatenate(lengths)
        keys = pa.chunked_array(ids_of)
        _write(folder, f"{name}.len", [
            n.astype("<i8").tobytes(), keys.fill_null(0).to_numpy().astype("<i8").tobytes(),
            keys.is_valid().to_numpy().astype(np.uint8).tobytes()])
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int64()), "n_docs": pa.array([len(n)], pa.int64()),
            "n_tokens": pa.array([int(n.sum())], pa.int64())})

    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    dealt = keyed.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    shards = save_and_reload(dealt.mapInArrow(write, "shard long, n_docs long, n_tokens long"), f"{folder}/shards")

    # one row per shard: its base is the sum of the tokens before it
    table = shards.orderBy("shard").toPandas()
    base = offsets_of(table["n_tokens"].to_numpy(np.int64))[:-1]
    rows = [(int(s), int(b), int(d), int(t), np.dtype(dtype).itemsize) for s, b, d, t in zip(
        table["shard"], base, table["n_docs"], table["n_tokens"])]
    spark = docs.sparkSession
    manifest = save_and_reload(spark.createDataFrame(
        rows, "shard long, base long, n_docs long, n_tokens long, id_bytes int"), f"{folder}/manifest")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                name, n = f"tokens-{r['shard']:05d}", r["n_docs"]
                lengths = _map(folder, f"{name}.len", "<i8", 0, n)
                keys = _map(folder, f"{name}.len", "u1", 8 * n)
                _write(folder, f"{name}.idx", [
                    np.array([MAGIC, r["id_bytes"], n], "<u8").tobytes(),
                    (offsets_of(lengths) + r["base"]).astype("<i8").tobytes(), keys.tobytes()])
                yield pa.RecordBatch.from_pydict({"shard": pa.array([r["shard"]], pa.int64())})

    manifest.repartition(max(1, len(rows))).mapInArrow(index, "shard long").write.format("noop").mode("overwrite").save()
    return TokenFiles(spark, folder)


def read_token_files(files: TokenFiles, with_ids: bool = True, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the files: (id, start, n_tokens, ids_crc32[, ids array<long>]).

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is taken over unsigned 32-bit little-endian ids.
    """
    folder = files.folder
    extra = ", ids array<long>" if with_ids else ""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                name = f"tokens-{r['shard']:05d}"
                magic, id_bytes, n = (int(x) for x in _map(folder, f"{name}.idx", "<u8", 0, 3))
                if magic != MAGIC:
                    raise ValueError(f"{folder}/{name}.idx is not an index of token files")
                offsets = _map(folder, f"{name}.idx", "<i8", 24, n + 1)
                keys = _map(folder, f"{name}.idx", "<i8", 24 + 8 * (n + 1), n)
                valid = _map(folder, f"{name}.idx", "u1", 24 + 8 * (2 * n + 1), n)
                tokens = _map(folder, f"{name}.bin", f"<u{id_bytes}")
                for a in range(0, n, BLOCK if not with_ids else 1000):
                    b = min(n, a + (BLOCK if not with_ids else 1000))
                    cuts = (np.asarray(offsets[a:b + 1]) - offsets[0]).tolist()
                    ids = [tokens[x:y].astype("<u4") for x, y in zip(cuts, cuts[1:])]
                    columns = {
                        id_col: pa.array(np.asarray(keys[a:b]), pa.int64(), mask=np.asarray(valid[a:b]) == 0),
                        "start": pa.array(np.asarray(offsets[a:b]), pa.int64()),
                        "n_tokens": pa.array(np.diff(offsets[a:b + 1]), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64())}
                    if with_ids:
                        columns["ids"] = pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(columns)

    n = max(1, files.manifest.count())
    return files.manifest.select("shard").repartition(n).mapInArrow(
        read, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long{extra}")
