"""Held-out test passages inside a training corpus: an FM-index per shard, searched for every phrase of the passages."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilespark.llm.common import spread
from profilespark.llm.fmindex import FMIndex

WORDS = 12
#: Words a shard's index holds; a single longer text is still indexed whole.
SHARD_WORDS = 1_000_000
#: Test items whose phrases a task holds at once; of more, block after block is searched in the index of a shard.
ITEM_BLOCK = 20_000

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_MARKED_WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*")
_MARKS = regex.compile(r"\p{M}+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")


def words(text: str) -> list[str]:
    """Runs of letters or digits, without letter case and diacritics."""
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(_MARKS.sub("", unicodedata.normalize("NFD", text.casefold())))


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where the words stand in the text as it is."""
    return [m.span() for m in _MARKED_WORD.finditer(text)]


def phrases(items: list[tuple[int, str | None]], n: int) -> dict[tuple[str, ...], list[int]]:
    """Every run of n words of the passages, with the items that have it."""
    out: dict[tuple[str, ...], set[int]] = defaultdict(set)
    for item, passage in items:
        w = words(passage or "")
        for i in range(len(w) - n + 1):
            out[tuple(w[i : i + n])].add(item)
    return {p: sorted(s) for p, s in out.items()}


class Shard:
    """Texts (doc_id, text, words) with one index over all their words, built when a first block of phrases needs it."""

    def __init__(self, docs: list[tuple[int, str, list[str]]], n: int):
        self.docs, self.n = docs, n
        self.ids: dict[str, int] = defaultdict(itertools.count(2).__next__)
        self.starts, self.size, parts = [], 0, []
        for _, _, w in docs:
            self.starts.append(self.size)
            parts.append(np.fromiter(map(self.ids.__getitem__, w), np.int64, len(w)))
            parts.append(np.ones(1, np.int64))
            self.size += len(w) + 1
        self.sequence = np.concatenate([*parts, np.zeros(1, np.int64)])
        self.index: FMIndex | None = None

    def search(self, wanted: dict[tuple[str, ...], list[int]]) -> list[tuple[int, int, int, int, int]]:
        """(doc_id, item_id, first char, end char, words) of the merged spans that match the phrases."""
        known = [(tuple(self.ids[x] for x in p), items) for p, items in wanted.items() if all(x in self.ids for x in p)]
        if not known or self.size < self.n:
            return []
        if self.index is None:
            self.index = FMIndex(self.sequence)
        return _spans(self.index, known, self.docs, self.starts, self.n)


def _spans(index: FMIndex, known: list[tuple[tuple[int, ...], list[int]]], docs: list[tuple[int, str, list[str]]], starts: list[int], n: int) -> list[tuple[int, int, int, int, int]]:
    lo, hi = index.search(np.array([p for p, _ in known], np.int64))
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return []
    count = hi[found] - lo[found]
    which = np.repeat(found, count)
    rows = np.repeat(lo[found] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    places = index.locate(rows)
    spans: dict[tuple[int, int], list[int]] = defaultdict(list)
    owner = np.searchsorted(np.array(starts), places, side="right") - 1
    for k, d, p in zip(which.tolist(), owner.tolist(), places.tolist()):
        for item in known[k][1]:
            spans[d, item].append(p - starts[d])
    out = []
    where: dict[int, list[tuple[int, int]]] = {}
    for (d, item), first in spans.items():
        doc, text, _ = docs[d]
        if d not in where:
            where[d] = word_spans(text)
        at = where[d]
        first.sort()
        begin, end = first[0], first[0] + n
        for p in [*first[1:], 1 << 60]:
            if p <= end and p < 1 << 60:
                end = max(end, p + n)
            else:
                out.append((doc, item, at[begin][0], at[end - 1][1], end - begin))
                begin, end = p, p + n
    return out


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", n: int = WORDS) -> DataFrame:
    """doc_id, item_id, char_start, char_end, n_words: merged spans of a document that share n or more words with an item.

    Each task indexes the texts it scans in shards of SHARD_WORDS words, so no text is shuffled (but for a small
    input, see ``spread``) and the work grows with the corpus; all words of all texts are indexed. Null or empty
    texts and passages under n words give nothing. Copies of a row give their spans once.
    """
    spark = docs.sparkSession
    wanted_items = items.select(F.col(item_id).alias("i"), F.col(passage).alias("p")).where("i IS NOT NULL").distinct()
    total = wanted_items.count()
    source = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL"), "doc_id")
    blocks = max(1, -(-total // ITEM_BLOCK))
    shared = []
    for b in range(blocks):
        block = wanted_items if blocks == 1 else wanted_items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        shared.append(spark.sparkContext.broadcast(phrases([(r.i, r.p) for r in block.collect()], n)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, str, list[str]]] = []
        size = 0

        def flush() -> Iterator[pd.DataFrame]:
            shard = Shard(held, n)
            for wanted in shared:
                yield pd.DataFrame(shard.search(wanted.value), columns=["doc_id", "item_id", "char_start", "char_end", "n_words"])
                if len(shared) > 1:  # a worker holds the phrases of one block
                    wanted.__dict__.pop("_value", None)

        for batch in batches:
            for doc, t in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                w = words(t)
                if len(w) < n:
                    continue
                held.append((doc, t, w))
                size += len(w)
                if size >= SHARD_WORDS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return source.mapInPandas(run, "doc_id long, item_id long, char_start int, char_end int, n_words int").distinct()
