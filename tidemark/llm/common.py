"""What the operators of this folder share: tables, checkpoints and text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step in a Python worker takes together; a longer text is a step of its own.
CHUNK_BYTES = 1 << 19
#: Most rows of a step, so that short texts don't fill dense blocks of a row each to the brim.
CHUNK_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, which the cluster names in spark.checkpoint.dir.

    Only a local session, whose driver and executors share one machine, gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession) -> str:
    """A name in the shared folder for the tables of one run, to be given to clear() when its result is written."""
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


def stage(df: DataFrame, folder: str | None = None, compression: str | None = None) -> DataFrame:
    """Cut the lineage by a written table in the same shared folder: smaller than a checkpoint of many rows."""
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, folder: str) -> None:
    """Delete the tables of a run; nothing that is still to be read may come from them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def once(array: Column) -> Column:
    """The same value, which the optimiser takes to be computed where it stands.

    A filter on the size of an array that is exploded is moved below otherwise, with a copy of all that the array is made of.
    """
    return F.when(F.monotonically_increasing_id() >= 0, array)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins (one more offset at the end).

    A null is an empty text.
    """
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def text_slices(batches: Iterable[pa.RecordBatch], text: str = "text", chunk_bytes: int = CHUNK_BYTES, chunk_rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """Whole rows in slices of about chunk_bytes of text, so that what a worker holds stays bounded."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = utf8(batch.column(batch.schema.get_field_index(text)))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(at, at[begin] + chunk_bytes, side="right")) - 1
            end = min(max(end, begin + 1), begin + chunk_rows, batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: ASCII letters and digits, and every byte of a character beyond ASCII, belong to a word.
WORD_BYTE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def _beyond_ascii(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Takes marks beyond ASCII out of `inside`; gives where the characters begin that are words of their own.

    Marks are those of Latin-1, general and ideographic punctuation and the full-width ones. Ideographs, kana, Thai and
    Lao letters, whose scripts leave no spaces, are a word each.
    """
    lead = np.flatnonzero((data == 0xC2) | (data >= 0xE0))
    if not len(lead):
        return lead
    padded = np.append(data, np.zeros(2, np.uint8))
    one, two, three = data[lead], padded[lead + 1], padded[lead + 2]
    latin = lead[(one == 0xC2) & ~np.isin(two, (0xAA, 0xB5, 0xBA))]
    wide = (one == 0xE2) & (two <= 0x81) | (one == 0xE3) & (two == 0x80)
    wide |= (one == 0xEF) & ((two == 0xBC) & ((three <= 0x8F) | (three >= 0x9A) & (three <= 0xA0)) | (two == 0xBD) & (three >= 0x9B) & (three <= 0xA5))
    for at, length in ((latin, 2), (lead[wide], 3)):
        for k in range(length):
            inside[np.minimum(at + k, len(data) - 1)] = False
    return lead[~wide & ((one >= 0xE3) & (one <= 0xE9) | (one == 0xE0) & (two >= 0xB8) & (two <= 0xBB))]


def located_words(data: np.ndarray, at: np.ndarray, unspaced: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word in order, and where each begins.

    Words are runs of WORD_BYTE but for _beyond_ascii() (whose characters are words of their own if `unspaced`);
    the texts are to be in one case already. A polynomial prefix hash gives all words at once, with no loop over words.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = WORD_BYTE[data]
    alone = _beyond_ascii(data, inside)[: None if unspaced else 0]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    for cut in (alone, alone + 3):  # a word begins at either, and one before it ends
        cut = cut[(cut > 0) & (cut < n)]
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
    edge = at[(at > 0) & (at < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * power[:n], out=prefix[1:], dtype=np.uint64)
    hashes = mix64((prefix[stop] - prefix[start]) * inverse[start] + (stop - start).astype(np.uint64))
    return hashes, start


def words(data: np.ndarray, at: np.ndarray, unspaced: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word in order, and the index of the first word of each text (with an end)."""
    hashes, start = located_words(data, at, unspaced)
    return hashes, np.searchsorted(start, at)


def owners(at: np.ndarray) -> np.ndarray:
    """For runs that begin at `at` (with an end), the index of the run that holds each element."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def totals(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of `flags` over each run that begins at `at` (with an end); empty runs give 0."""
    running = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return running[at[1:]] - running[at[:-1]]


def trigram_counts(data: np.ndarray, at: np.ndarray, dims: int) -> np.ndarray:
    """Counts of each text's byte trigrams, hashed to `dims` places: one row of 32-bit floats a text."""
    n, rows = len(data), len(at) - 1
    if n < 3:
        return np.zeros((rows, dims), np.float32)
    wide = data.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    place = (code * np.uint32(2654435761)) >> np.uint32(32 - int(np.log2(dims)))
    owner = owners(at).astype(np.int32)
    same = (owner[:-2] == owner[2:]) & ~((data[:-2] == 32) & (data[1:-1] == 32))
    row = owner[:-2][same]
    cells = row * np.int64(dims) + place[same]
    out = np.empty((rows, dims), np.float32)
    # cells come in the order of rows, so a few rows at a time keep the whole numbers small
    for a in range(0, rows, 64):
        b = min(a + 64, rows)
        low, high = np.searchsorted(row, (a, b))
        out[a:b] = np.bincount(cells[low:high] - a * dims, minlength=(b - a) * dims).reshape(b - a, dims)
    return out
