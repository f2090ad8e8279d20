"""Benchmark decontamination: approximate occurrences of test items in documents, by pigeonhole and Myers' algorithm.

Texts are compared as lower-cased words joined by single spaces, without punctuation.  An item of m characters may
differ from its occurrence by k = m * ERROR_RATE edits.  It is cut into k + 1 pieces, of
which at least one must then occur unchanged, so an Aho-Corasick automaton over the pieces of all items finds every
place where an item can be; hits of one item whose windows overlap are looked at once, and Myers' bit-parallel distance
settles each window.  All of each text is searched.

Items too short for an edit (below 1 / ERROR_RATE characters) must occur as they are, as whole words.  Items go to the tasks in blocks of a
bounded number of characters: one search of the documents per block, one block after another, so that neither a task nor the driver
holds more than a block.  Items without a letter or digit match nothing.  Null and empty texts match nothing; null ids stay; equal items are each
reported; repeated documents give repeated rows.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _base

ERROR_RATE = 0.08
#: Characters of items that a task holds at a time; with their pieces and masks each takes some 60 bytes.
BLOCK_CHARS = 2 << 20

_BREAKS = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _BREAKS.sub(" ", (text or "").lower()).strip()


def least_distance(pattern: str, masks: dict[str, int], text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of pattern to a part of text, and where the first such part ends; None beyond most."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, most + 1, -1
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | minus
        d0 = (((x & plus) + plus) ^ plus) | x
        hp = minus | ~(d0 | plus) & full
        hn = plus & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        if score < best:
            best, end = score, i + 1
            if not best:
                break
        hp = hp << 1 & full
        plus = (hn << 1 | ~(d0 | hp)) & full
        minus = hp & d0
    return (best, end) if end >= 0 else None


class Searcher:
    def __init__(self, items: list[tuple], error_rate: float = ERROR_RATE):
        """items: (item_id, text)."""
        import ahocorasick

        same: dict[str, list] = {}
        for name, text in items:
            same.setdefault(normal(text), []).append(name)
        self.items, pieces = [], {}
        for text, names in same.items():
            if not text:
                continue
            k = min(int(len(text) * error_rate), len(text) - 1)
            masks: dict[str, int] = {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            edges = [len(text) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(edges, edges[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((len(self.items), b))
            self.items.append((names, text, masks, k))
        self.pieces = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.pieces.add_word(piece, places)
        self.pieces.make_automaton()

    def search(self, text: str | None) -> list[tuple[list, int, int, int]]:
        """(ids of equal items, distance, k, end in the normal text) of each item that occurs: its best place."""
        text = normal(text)
        if not text or not self.items:
            return []
        windows: dict[int, list[list[int]]] = {}
        for last, places in self.pieces.iter(text):
            for item, piece_end in places:
                _, pattern, _, k = self.items[item]
                if not k and (last + 1 - len(pattern) > 0 and text[last - len(pattern)] != " " or text[last + 1 : last + 2] not in ("", " ")):
                    continue  # a part of a longer word
                start = last + 1 - piece_end - k
                end = last + 1 - piece_end + len(pattern) + k
                mine = windows.setdefault(item, [])
                if mine and start <= mine[-1][1]:
                    mine[-1][0], mine[-1][1] = min(mine[-1][0], start), max(mine[-1][1], end)
                else:
                    mine.append([start, end])
        out = []
        for item, mine in windows.items():
            names, pattern, masks, k = self.items[item]
            best = None
            for start, end in mine:
                start = max(start, 0)
                if (got := least_distance(pattern, masks, text[start:end], k)) and (best is None or got[0] < best[0]):
                    best = got[0], start + got[1]
            if best:
                out.append((names, best[0], k, best[1]))
        return out


def _blocks(items: DataFrame, block_chars: int) -> Iterator[tuple[list[tuple], bool]]:
    """(item_id as text, text) of all items, some block_chars at a time, and whether these are the last."""
    items = items.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-chars // block_chars)
    for b in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b).collect()], b + 1 == n


class _Block:
    """Items of a block, with a searcher that a worker makes when it first needs it."""

    def __init__(self, *args):
        self.args, self.made = args, None

    def search(self, text: str | None):
        if self.made is None:
            self.made = Searcher(*self.args)
        return self.made.search(text)


def _find(shared):
    def run(batches):
        search = shared.value.search
        for batch in batches:
            rows = [(doc, name, d, k, end) for doc, text in zip(batch["doc_id"], batch["text"], strict=True) for names, d, k, end in search(text) for name in names]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "budget", "end_char"])

    return run


def _clean(shared):
    @F.pandas_udf("boolean")
    def run(text: pd.Series) -> pd.Series:
        search = shared.value.search
        return text.map(lambda t: not search(t)).astype(bool)

    return run


def occurrences(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, budget, end_char: the best occurrence of each item in each document that holds it.

    end_char counts characters of the normal form.  docs: doc_id, text; items: item_id, text.
    """
    spark, kind, of = docs.sparkSession, docs.schema["doc_id"].dataType, items.schema["item_id"].dataType
    named = docs.where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = None
    for block, last in _blocks(items, block_chars):
        shared = spark.sparkContext.broadcast(_Block(block, error_rate))
        part = named.mapInPandas(_find(shared), "doc_id string, item_id string, distance int, budget int, end_char long")
        if not last:
            part = _base.cut(part)
            shared.unpersist()
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "doc_id string, item_id string, distance int, budget int, end_char long")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("item_id", F.col("item_id").cast(of))


def decontaminate(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that hold no item, with their columns."""
    for block, last in _blocks(items, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(_Block(block, error_rate))
        docs = docs.where(_clean(shared)("text"))
        if not last:
            docs = _base.cut(docs)
            shared.unpersist()
    return docs


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return occurrences(_base.table(spark, sf_dir, "documents"), _base.table(spark, sf_dir, "benchmark"))
