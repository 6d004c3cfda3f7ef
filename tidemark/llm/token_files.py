"""Token ids as Huffman-coded binary files, and their reader."""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clear, new_folder, shared_folder, stage, text_slices

END_OF_TEXT = 0
#: Bits of the longest code; one more than the vocabulary needs if that is larger.
LIMIT = 16
#: Ids of a block, and ids between two bit offsets inside it.
BLOCK = 1 << 20
CHECKPOINT = 128
#: Bytes and rows of text whose pieces are numbered together, and distinct pieces that a worker keeps.
CHUNK_BYTES = 1 << 23
CHUNK_ROWS = 10_000
CACHE_PIECES = 1_000_000
MAGIC = b"TMTOK1\n"

# ---- tokens

#: White space beyond single spaces and line ends, stops and commas after anything but letters and digits, and what may be a
#: special token: texts that hold any are cut with more care.
_ODD = r"[\x00\t\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z|[^\p{L}\p{N}][.,]|\A[.,]|<\|"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: How byte-level vocabularies spell bytes: printable ones as themselves, the others from U+0100 on in order.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {b: chr(b) if b in _PRINTED else chr(256 + sum(c not in _PRINTED for c in range(b))) for b in range(256)}


class PieceTokens:
    """Token ids of texts from those of their distinct pieces.

    The byte-level tokenizer begins a token at a space, and around a line end, that stands alone between other characters,
    and at a stop or comma after a letter, so a text has the tokens of its pieces from one such place to the next. Every
    piece is tokenized by the library, once while it is kept.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.known: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.model = self.tokenizer.model

    def learn(self, pieces: list[str]) -> None:
        plain, others = [], []
        for piece in pieces:
            (plain if piece.removeprefix(" ").isalpha() else others).append(piece)
        # letters, perhaps after a space, need no pattern to part them: the library's model takes them as they are spelt in bytes
        spelt = "\n".join(plain).encode().decode("latin-1").translate(_BYTES).split(_BYTES[10])
        merge, known = self.model.tokenize, self.known
        for piece, word in zip(plain, spelt, strict=False):
            known[piece] = array("I", [t.id for t in merge(word)]).tobytes()
        coded = self.tokenizer.encode_batch_fast(others, add_special_tokens=False)
        self.known.update((p, array("I", e.ids).tobytes()) for p, e in zip(others, coded, strict=True))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by END_OF_TEXT, and where each begins (with an end)."""
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, _ODD)
        even = pc.replace_with_mask(texts, odd, pa.scalar("", pa.large_string())) if pc.any(odd).as_py() else texts
        for mark, cut in ((" ", "\0 "), (".", "\0."), (",", "\0,"), ("\n", "\0\n\0")):
            even = pc.replace_substring(even, mark, cut)
        pieces = pc.split_pattern(even, "\0")
        if pc.any(odd).as_py():
            cut = [_CUT.split(t.as_py()) if o else None for t, o in zip(texts, odd.to_pylist(), strict=True)]
            cut = pa.array(cut, pieces.type)
            pieces = pc.if_else(odd, cut, pieces)
        ends = np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False))
        coded = pieces.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        spelt = list(map(self.known.get, names))
        fresh = [k for k, ids in enumerate(spelt) if ids is None]
        if fresh:
            self.learn([names[k] for k in fresh])
            for k in fresh:
                spelt[k] = self.known[names[k]]
        spelt.append(END_OF_TEXT.to_bytes(4, "little"))
        sizes = np.fromiter(map(len, spelt), np.int32, len(spelt)) // 4
        begins = (np.cumsum(sizes) - sizes).astype(np.int32)
        pool = np.frombuffer(b"".join(spelt), "<u4")
        word = np.insert(coded.indices.to_numpy(zero_copy_only=False), ends, len(names))
        size = sizes[word]
        at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        place = np.repeat((begins[word] - at[:-1]).astype(np.int64), size)
        place += np.arange(at[-1], dtype=np.int64)
        return pool[place], at[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])]


_tokenizers: dict[str, PieceTokens] = {}


_IDS = "doc_id long, ids binary, width int, counts binary"


def _tokenize(path: str):
    """Rows of _IDS: a row a document, and last how often the task met each id, with no document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokenizers:  # kept for the tasks that the worker runs later
            _tokenizers[path] = PieceTokens(path)
        pieces = _tokenizers[path]
        names = [c.split()[0] for c in _IDS.split(", ")]
        counts = np.zeros(pieces.size, np.int64)
        width = 2 if pieces.size <= 1 << 16 else 4
        for batch in text_slices(batches, chunk_bytes=CHUNK_BYTES, chunk_rows=CHUNK_ROWS):
            ids, at = pieces.ids(batch.column(1))
            counts += np.bincount(ids, minlength=pieces.size)
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype(np.int64)), pa.py_buffer(ids.astype(f"<u{width}"))])
            n = len(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), data.cast(pa.binary()), pa.array(np.full(n, width, np.int32)), pa.nulls(n, pa.binary())], names)
        used = np.flatnonzero(counts)
        met = np.stack([used, counts[used]], 1).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.array([met])], names)

    return run


def tokenize(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """_IDS: each document's ids in little-endian integers of `width` bytes, END_OF_TEXT last; rows with `counts` are no documents."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenize(tokenizer_path), _IDS)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0):
            met = np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(met[:, 0]), pa.array(met[:, 1])], ["id", "n"])


# ---- the code


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code, none longer than `limit`, so that the coded total is least (package-merge).

    Symbols of count 0 get no code; a single symbol gets one bit.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError("more symbols than codes of that many bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    # at each level, from the longest codes up: the symbols among the packages of the level before, in order of weight
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        by = np.argsort(merged, kind="stable")
        merged = merged[by]
        levels.append(by < n)
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    bits, take = np.zeros(n, np.int64), 2 * n - 2
    for is_symbol in reversed(levels):
        symbols = int(is_symbol[:take].sum())
        bits[:symbols] += 1  # the lightest ones of that level
        take = 2 * (take - symbols)
    lengths[order] = bits
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length and then of symbol, so that the lengths alone give them."""
    codes, code, before = np.zeros(len(lengths), np.uint32), 0, 0
    symbols = np.flatnonzero(lengths)
    by = symbols[np.lexsort((symbols, lengths[symbols]))]
    sizes, firsts = np.unique(lengths[by], return_index=True)
    for size, a, b in zip(sizes.tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(by)], strict=True):
        code <<= size - before
        codes[by[a:b]] = code + np.arange(b - a, dtype=np.uint32)
        code, before = code + b - a, size
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits to look at, symbol, bits to go on) for every value of that many bits."""
    bits = int(lengths.max(initial=1))
    symbol, size = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.uint8)
    used = np.flatnonzero(lengths)
    by = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (bits - lengths[by].astype(np.int64))
    whole = int(spans.sum())  # canonical codes fill the table from its beginning
    symbol[:whole], size[:whole] = np.repeat(by, spans), np.repeat(lengths[by], spans)
    return bits, symbol, size


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """(bits, most significant first; the bit at which every CHECKPOINT-th id begins; bits in all)."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    begins = ends - size
    total = int(ends[-1]) if len(ids) else 0
    # codes of up to 32 bits touch two words of 32; those of one word don't overlap, so a sum is their union
    word, at = begins >> 5, begins & 31
    wide = codes[ids].astype(np.uint64) << (64 - at - size).astype(np.uint64)
    n = (total >> 5) + 2
    sums = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return sums.astype(np.uint32).astype(">u4").tobytes()[: (total + 7) // 8], begins[::CHECKPOINT], total


def decode_block(data: bytes, checkpoints: np.ndarray, n_ids: int, table: tuple[int, np.ndarray, np.ndarray], first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids from checkpoint `first` up to checkpoint `last`, all stretches between checkpoints in step."""
    bits, symbol, size = table
    lanes = checkpoints[first:last].astype(np.int64)
    n = min(n_ids - first * CHECKPOINT, len(lanes) * CHECKPOINT)
    if n <= 0:
        return np.zeros(0, np.uint32)
    padded = np.frombuffer(data + bytes(16), np.uint8)
    out = np.zeros((len(lanes), CHECKPOINT), np.uint32)
    # the 40 bits that begin at each byte
    wide = (padded[:-4].astype(np.uint64) << np.uint64(32)) | (padded[1:-3].astype(np.uint64) << np.uint64(24)) | (padded[2:-2].astype(np.uint64) << np.uint64(16))
    wide |= (padded[3:-1].astype(np.uint64) << np.uint64(8)) | padded[4:].astype(np.uint64)
    mask, top = np.uint64((1 << bits) - 1), 40 - bits
    limit = 8 * len(data)
    for k in range(min(CHECKPOINT, n)):
        seen = ((wide[lanes >> 3] >> (top - (lanes & 7)).astype(np.uint64)) & mask).astype(np.int64)
        out[:, k] = symbol[seen]
        lanes += size[seen]
        np.minimum(lanes, limit, out=lanes)  # the last stretch may end before the others
    return out.reshape(-1)[:n]


# ---- files: MAGIC, header, blocks, index, its place. All integers are little-endian.


def _uri(path: str) -> str:
    return re.sub("^file:/+", "file:///", path) if path.startswith("file:") else path


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(_uri(path)) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


class Writer:
    """One file: blocks of whole and partial documents, closed by an index of blocks and documents."""

    def __init__(self, sink, lengths: np.ndarray):
        self.sink, self.lengths, self.codes = sink, lengths, canonical_codes(lengths)
        self.waiting, self.n_waiting, self.n_ids = [], 0, 0
        self.blocks: list[tuple[int, int, int, int]] = []  # place, bytes of bits, bytes of checkpoints, ids
        self.docs: list[tuple[int | None, int]] = []
        head = zlib.compress(lengths.astype(np.uint8).tobytes(), 6)
        self.sink.write(MAGIC + struct.pack("<II", len(lengths), len(head)) + head)
        self.place = len(MAGIC) + 8 + len(head)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        for at in range(0, len(ids), BLOCK):
            self.waiting.append(ids[at : at + BLOCK])
            self.n_waiting += len(self.waiting[-1])
            while self.n_waiting >= BLOCK:
                self._block(BLOCK)

    def _block(self, n: int) -> None:
        ids = np.concatenate(self.waiting)
        self.waiting, self.n_waiting = ([ids[n:]] if len(ids) > n else []), len(ids) - n
        data, begins, _ = encode_block(ids[:n], self.lengths, self.codes)
        # a checkpoint is kept as its distance from the one before, of at most CHECKPOINT codes
        points = np.diff(begins, prepend=0).astype("<u2").tobytes()
        self.sink.write(data + points)
        self.blocks.append((self.place, len(data), len(points), min(n, len(ids))))
        self.place += len(data) + len(points)
        self.n_ids += min(n, len(ids))

    def close(self) -> None:
        if self.n_waiting:
            self._block(BLOCK)
        blocks = np.array(self.blocks, "<i8").reshape(-1, 4).tobytes()
        known = np.array([d is not None for d, _ in self.docs], np.uint8).tobytes()
        docs = np.array([(d or 0, n) for d, n in self.docs], "<i8").reshape(-1, 2).tobytes()
        index = zlib.compress(blocks + docs + known, 6)
        self.sink.write(index + struct.pack("<QQII", self.place, len(index), len(self.blocks), len(self.docs)) + MAGIC)


class Reader:
    """Random access to one file by its index; only the blocks asked for are read."""

    TAIL = 24 + len(MAGIC)

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = self._at(size - self.TAIL, self.TAIL)
        if tail[24:] != MAGIC or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of tokens, or cut short")
        place, length, n_blocks, n_docs = struct.unpack("<QQII", tail[:24])
        index = zlib.decompress(self._at(place, length))
        self.blocks = np.frombuffer(index, "<i8", 4 * n_blocks).reshape(-1, 4)
        docs = np.frombuffer(index, "<i8", 2 * n_docs, 32 * n_blocks).reshape(-1, 2)
        known = np.frombuffer(index, np.uint8, n_docs, 32 * n_blocks + 16 * n_docs)
        self.doc_ids = [d if k else None for d, k in zip(docs[:, 0].tolist(), known.tolist(), strict=True)]
        self.doc_starts = np.concatenate([[0], np.cumsum(docs[:, 1])])
        n_symbols, packed = struct.unpack("<II", self._at(len(MAGIC), 8))
        lengths = np.frombuffer(zlib.decompress(self._at(len(MAGIC) + 8, packed)), np.uint8)
        assert len(lengths) == n_symbols
        self.table = decoding_table(lengths)
        self.block_starts = np.concatenate([[0], np.cumsum(self.blocks[:, 3])])

    def _at(self, place: int, length: int) -> bytes:
        self.source.seek(place)
        return self.source.read(length)

    def ids(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """The ids from `start` to `stop`, block by block, decoded from the last checkpoint before."""
        for k in range(max(0, int(np.searchsorted(self.block_starts, start, "right")) - 1), len(self.blocks)):
            place, n_data, n_points, n_ids = self.blocks[k].tolist()
            a, b = max(start - int(self.block_starts[k]), 0), min(stop - int(self.block_starts[k]), n_ids)
            if b <= 0:
                return
            if a >= b:
                continue
            raw = self._at(place, n_data + n_points)
            points = np.cumsum(np.frombuffer(raw, "<u2", n_points // 2, n_data), dtype=np.int64)
            first, last = a // CHECKPOINT, -(-b // CHECKPOINT)
            found = decode_block(raw[:n_data], points, n_ids, self.table, first, last)
            yield found[a - first * CHECKPOINT : b - first * CHECKPOINT]


def _write(folder: str, lengths: np.ndarray):
    """Each partition to a file of its own; a task that runs again writes another, and only what it reports is read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer = TaskContext.get().partitionId(), None
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        files, root = _filesystem(folder)
        for batch in batches:
            for doc_id, raw, width in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if writer is None:
                    files.create_dir(root, recursive=True)
                    sink = files.open_output_stream(f"{root}/{name}")
                    writer = Writer(sink, lengths)
                writer.add(doc_id, np.frombuffer(raw.as_buffer(), f"<u{width}"))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([writer.n_ids], pa.int64()), pa.array([len(writer.docs)], pa.int64())], ["part", "file", "n_ids", "n_docs"])

    return run


def write_tokens(documents: DataFrame, tokenizer_path: str, folder: str | None = None) -> tuple[str, DataFrame]:
    """Writes the ids of all documents in ascending doc_id order; gives the folder and its list of files.

    Ids are kept in a table while they are counted. The counts of the vocabulary's ids, and so their code, are all that
    passes through the driver. Documents are sorted by range, and every partition is a file of independent blocks.
    The list (part, file, n_ids, n_docs) is a table beside the files; files that it doesn't name are no part of the output.
    """
    spark = documents.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    scratch = new_folder(spark)
    ids = stage(tokenize(documents, tokenizer_path), scratch, "zstd")
    counted = ids.where("counts is not null").select("counts").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 + max((r["id"] for r in counted), default=0), np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    needed = max(len(counted) - 1, 1).bit_length()
    lengths = code_lengths(counts, max(LIMIT, needed + 1))
    # equal doc_ids may span ranges too
    order = [F.col("doc_id").asc_nulls_first(), F.crc32("ids").asc()]
    sorted_ids = ids.where("ids is not null").select("doc_id", "ids", "width").repartitionByRange(*order).sortWithinPartitions(*order, "ids")
    written = sorted_ids.mapInArrow(_write(folder, lengths), "part int, file string, n_ids long, n_docs long")
    written.write.parquet(f"{folder}/files")
    clear(spark, scratch)
    return folder, spark.read.parquet(f"{folder}/files")


def _read(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        for batch in batches:
            for name, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_file(f"{root}/{name}") as source:
                    reader = Reader(source)
                    total, rows, k, crc = int(reader.doc_starts[-1]), [], 0, 0
                    stops = reader.doc_starts[1:].tolist()
                    at = 0
                    for block in reader.ids(0, total):
                        raw = memoryview(block.astype("<u4").tobytes())
                        end = at + len(block)
                        done = at
                        while k < len(stops) and stops[k] <= end:
                            crc = zlib.crc32(raw[4 * (done - at) : 4 * (stops[k] - at)], crc)
                            begin = int(reader.doc_starts[k])
                            rows.append((reader.doc_ids[k], offset + begin, stops[k] - begin, crc))
                            done, crc, k = stops[k], 0, k + 1
                        if done < end:
                            crc = zlib.crc32(raw[4 * (done - at) :], crc)
                        at = end
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = []

    return run


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files; start counts from the first file's first id.

    A file is a task. What lies before each file is a running sum over the list of files, one row a partition.
    """
    listed = spark.read.parquet(f"{folder}/files").orderBy("part").collect()
    starts, at = [], 0
    for row in listed:
        starts.append((row["file"], at))
        at += row["n_ids"]
    files = spark.createDataFrame(starts, "file string, start long").repartition(max(len(starts), 1))
    return files.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_range(spark: SparkSession, folder: str, start: int, length: int) -> np.ndarray:
    """The ids from `start` on, `length` of them at most: reads only the blocks that hold them."""
    out, at = [np.zeros(0, np.uint32)], 0
    files, root = _filesystem(folder)
    for row in spark.read.parquet(f"{folder}/files").orderBy("part").collect():
        if at < start + length and start < at + row["n_ids"]:
            with files.open_input_file(f"{root}/{row['file']}") as source:
                out += Reader(source).ids(max(start - at, 0), start + length - at)
        at += row["n_ids"]
    return np.concatenate(out)


def write_and_read(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per document, from the files that were written: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is END_OF_TEXT alone. Null doc_ids come first; rows of equal doc_id come in the order of a
    checksum of their ids and of those, and each is a document. A document may be longer than a block. An empty table gives no row. Other columns
    are not looked at.
    """
    folder, _ = write_tokens(documents, tokenizer_path)
    return read_documents(documents.sparkSession, folder)
