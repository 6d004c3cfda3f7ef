"""Mentions of a dictionary's names in texts: longest leftmost match, ambiguous names refused."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fulltext import words

#: Words of all names that are sent to every executor; a larger dictionary is joined.
BROADCAST_WORDS = 2_000_000
_FOUND = "doc_id long, start long, n_words long, entity_id long"


def dictionary(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, refused) of rows (entity_id, name): the words of each name that one entity bears, and of those that several bear.

    Names are compared as words, so case, marks and punctuation don't tell them apart. A name without a word is left out.
    """
    split = names.where("entity_id is not null").select(F.col("entity_id").cast("long").alias("entity_id"), words("name").alias("words")).where(F.size("words") > 0)
    borne = split.groupBy("words").agg(F.min("entity_id").alias("entity_id"), F.max("entity_id").alias("_other"))
    alone = F.col("entity_id") == F.col("_other")
    return borne.where(alone).drop("_other"), borne.where(~alone).select("words")


class Trie:
    """A token trie: every node is [entity or None, next nodes by word]."""

    def __init__(self, names: Iterable[tuple[list[str], int]]):
        self.root: list = [None, {}]
        for name, entity in names:
            node = self.root
            for word in name:
                node = node[1].setdefault(word, [None, {}])
            node[0] = entity

    def scan(self, text: list[str]) -> Iterator[tuple[int, int, int]]:
        """(start, words, entity) from left to right: at each word the longest name, then on after it."""
        at, n, top = 0, len(text), self.root[1]
        while at < n:
            node, length, entity, k = top.get(text[at]), 0, None, at
            while node is not None:
                k += 1
                if node[0] is not None:
                    length, entity = k - at, node[0]
                node = node[1].get(text[k]) if k < n else None
            if length:
                yield at, length, entity
            at += length or 1


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["doc_id", "start", "n_words", "entity_id"])


def _scanner(names):
    trie: list[Trie] = []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not trie:
            trie.append(Trie(names.value))
        for batch in batches:
            found = [(doc, *m) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in trie[0].scan(text or [])]
            if found:
                yield _rows(found)

    return run


def _leftmost(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a document's candidates in order of start and then of falling length, those that the scan would take."""
    for batch in batches:
        found = []
        for doc, matches in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            free = 0
            for m in matches:
                if m["start"] >= free:
                    found.append((doc, m["start"], -m["shorter"], m["entity_id"]))
                    free = m["start"] - m["shorter"]
        if found:
            yield _rows(found)


def mentions(docs: DataFrame, names: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, start, n_words, entity_id): where names (of dictionary()) stand in docs (doc_id, text); start counts words from 0.

    Matches don't overlap: the leftmost is taken, of those that begin there the longest, and the search goes on after it.
    A dictionary of up to `broadcast_words` words is a trie on every executor. Beyond it the names are dealt by their words
    and joined with the runs of words that are as long as some name; what meets is resolved document by document.
    """
    spark = docs.sparkSession
    text = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), words("text").alias("words"))
    size = names.agg(F.sum(F.size("words")).alias("n")).first()["n"] or 0
    if size <= broadcast_words:
        held = spark.sparkContext.broadcast([(r["words"], r["entity_id"]) for r in names.collect()])
        return text.mapInArrow(_scanner(held), _FOUND)
    lengths = sorted(r["n"] for r in names.select(F.size("words").alias("n")).distinct().collect())

    def runs_of(n: int):  # a second parameter of a lambda would be an index to Spark
        starts = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: i + (n - 1) <= F.size("words"))
        return F.transform(starts, lambda i: F.struct((i - 1).alias("start"), F.lit(-n).alias("shorter"), F.slice("words", i, F.lit(n)).alias("run")))

    runs = text.where(F.size("words") > 0).select("doc_id", F.explode(F.concat(*map(runs_of, lengths))).alias("m")).select("doc_id", "m.*")
    met = runs.join(names.select(F.col("words").alias("run"), "entity_id"), "run")
    by_doc = met.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("shorter").cast("long").alias("shorter"), "entity_id"))).alias("m"))
    return by_doc.mapInArrow(_leftmost, _FOUND)
