"""Packing of token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import text_slices

CAPACITY = 4096
END_OF_TEXT = 2
#: Pieces that are differenced together, and the longest piece among them (longer ones are cut evenly).
SHARD = 1024
LONGEST = 1024
#: Distinct words that a Python worker keeps the tokens of.
CACHE_WORDS = 1_000_000
#: Bytes of text whose pieces are numbered together.
CHUNK_BYTES = 1 << 23
#: Words that are tokenized as one text.
JOINED = 5000
#: A word of Latin-1 letters, perhaps with a full stop or comma: tokens of their own.
_WORD = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,]?)").fullmatch
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: the indices of `sizes` dealt into so many windows of near-equal sums.

    Each size starts as a partial partition with one filled window. The two partitions with the largest
    spread are merged, the fullest window of one with the emptiest of the other, until one is left.
    """
    into = np.arange(len(sizes))  # a window is named by one of its pieces; the others lead to it
    heap = []
    for k in range(len(sizes)):
        sums, names = np.zeros(windows, np.int64), np.full(windows, -1)
        sums[-1], names[-1] = sizes[k], k
        heap.append((-sizes[k], k, sums, names))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, k, sums, names = heapq.heappop(heap)
        _, _, more, others = heapq.heappop(heap)
        sums, others = sums + more[::-1], others[::-1]
        both = (names >= 0) & (others >= 0)
        into[others[both]] = names[both]
        names = np.where(names >= 0, names, others)
        by = np.argsort(sums, kind="stable")
        sums, names = sums[by] - sums[by[0]], names[by]
        heapq.heappush(heap, (-int(sums[-1]), k, sums, names))
    while (into[into] != into).any():
        into = into[into]
    found: dict[int, list[int]] = {}
    for k, name in enumerate(into.tolist()):
        found.setdefault(name, []).append(k)
    return list(found.values())


def pack_sizes(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most `capacity`; there is one more of them whenever the fullest exceeds it."""
    if not sizes:
        return []
    if max(sizes) > capacity:
        raise ValueError("a piece is longer than a window")
    windows = -(-sum(sizes) // capacity)
    while True:
        found = difference(sizes, windows)
        if max(sum(sizes[i] for i in w) for w in found) <= capacity:
            return found
        windows += 1


def cuts(tokens: int, capacity: int = CAPACITY, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows first, then the rest in even parts."""
    out = [(k * capacity, capacity) for k in range(tokens // capacity)]
    at, rest = tokens - tokens % capacity, tokens % capacity
    parts = -(-rest // longest)
    for k in range(parts):
        size = rest // parts + (k < rest % parts)
        out.append((at, size))
        at += size
    return out


class WordTokens:
    """Token ids of texts (little-endian 32-bit, as bytes), from the tokens of their distinct words.

    The tokenizer drops white space and never joins what it parts, so a text has the tokens of its
    pieces between spaces and line ends one after another. Pieces are tokenized once while they are kept;
    those of Latin-1 letters share the tokens of their lower case, which the tokenizer takes them to, and
    a full stop or comma after letters is a token of its own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        # a plain dict: a set's difference with any other kind would go through all that is known
        self.known: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        # words that are lower-case letters already need neither the normaliser nor the pattern that parts them
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytewise])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def learn(self, pieces: list[str]) -> None:
        spelt = {}
        stems, others = set(), [m for m in (".", ",") if m not in self.known]
        for piece in pieces:
            found = _WORD(piece)
            if found:
                stem, mark = found.groups()
                stem = stem.lower()
                stems.add(stem)
                spelt[piece] = stem, mark
            else:
                others.append(piece)
        letters = list(stems.difference(self.known))
        for at in range(0, len(letters), JOINED):
            self.learn_words(letters[at : at + JOINED])
        coded = self.tokenizer.encode_batch_fast(others, add_special_tokens=False)
        self.known.update((w, array("I", e.ids).tobytes()) for w, e in zip(others, coded, strict=True))
        self.known.update((piece, self.known[stem] + self.known[mark] if mark else self.known[stem]) for piece, (stem, mark) in spelt.items())

    def learn_words(self, letters: list[str]) -> None:
        """Tokens of words of letters alone, from one text of them all: each ends with the only token that ends a word."""
        ids = np.array(self.plain.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, np.uint32)
        stops = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
        raw = ids.tobytes()
        self.known.update(zip(letters, (raw[a:b] for a, b in zip([0, *stops], stops, strict=False)), strict=True))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the end id, and where each text begins (with an end).

        The pieces of all texts are numbered by Arrow, so that Python sees each distinct one once.
        """
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        texts = pc.replace_substring(texts.fill_null(""), "\n", " ")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # as the tokenizer does, but to special tokens
            texts = pc.ascii_lower(texts)
        pieces = pc.split_pattern(texts, " ")
        ends = np.cumsum(pc.list_value_length(pieces).to_numpy())
        coded = pieces.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh = set(names).difference(self.known)
        if fresh:
            self.learn(list(fresh))
        spelt = [*map(self.known.__getitem__, names), END_OF_TEXT.to_bytes(4, "little")]
        sizes = np.fromiter(map(len, spelt), np.int32, len(spelt)) // 4
        begins = (np.cumsum(sizes) - sizes).astype(np.int32)
        pool = np.frombuffer(b"".join(spelt), "<u4")
        word = np.insert(coded.indices.to_numpy(), ends, len(names))
        size = sizes[word]
        at = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat((begins[word] - at[:-1]).astype(np.int32), size)
        place += np.arange(at[-1], dtype=np.int32)
        return pool[place], at[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])]


_tokenizers: dict[str, WordTokens] = {}


def _packer(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 33
        if path not in _tokenizers:
            _tokenizers[path] = WordTokens(path)
        words = _tokenizers[path]
        rows: list[tuple] = []  # whole windows, ready to go
        open_pieces: list[tuple] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=list(COLUMNS))

        def close() -> list[tuple]:
            nonlocal sequence
            packed = []
            for window in pack_sizes([p[2] for p in open_pieces]):
                offset = 0
                for k in window:
                    packed.append((*open_pieces[k], sequence, offset))
                    offset += open_pieces[k][2]
                sequence += 1
            open_pieces.clear()
            return packed

        for batch in text_slices(batches, chunk_bytes=CHUNK_BYTES):
            ids, at = words.ids(batch.column(1))
            for k, (doc_id, tokens) in enumerate(zip(batch.column(0).to_pylist(), np.diff(at).tolist(), strict=True)):
                for start, length in cuts(tokens):
                    first = at[k] + start
                    piece = (doc_id, start, length, zlib.crc32(ids[first : first + length]), tokens)
                    if length == CAPACITY:
                        rows.append((*piece, sequence, 0))
                        sequence += 1
                    else:
                        open_pieces.append(piece)
                if len(open_pieces) >= SHARD:
                    rows += close()
            if rows:
                yield out(rows)
                rows = []
        rows += close()
        if rows:
            yield out(rows)

    return run


def pack(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its text's, followed by END_OF_TEXT; a null text is empty, so that every row of
    the table gives one token at least, repeated doc ids and null ones too. Documents are cut at multiples
    of CAPACITY; the rests, cut to LONGEST, are differenced in shards of at least SHARD pieces inside the
    partition that read them. So nothing is shuffled, a worker holds one shard of lengths, and a lost task
    gives the same sequences when it runs again. An empty table gives no row.
    """
    schema = ", ".join(f"{c} long" for c in COLUMNS)
    return documents.select("doc_id", "text").mapInArrow(_packer(tokenizer_path), schema)
