"""Best-fit packing of tokenized documents into sequences of fixed capacity, by large-item matching.

Documents longer than the capacity are cut into whole pieces.  Pieces above one third of the capacity are
large: at most two fit in one bin, so a greedy matching (the longest left, with the longest that
still fits beside it) pairs them.  Smaller pieces then go, longest first, into the tightest gap that
holds them; a new bin opens only where no gap does.

Only lengths matter for that, and there are at most as many lengths as the capacity.  So the plan is
made from the number of pieces of each length: bins with equal contents form a class, and each
class takes or leaves a length as a whole but for one split.  A gap that takes items of length s
drops below half, so a class is visited at most log2(capacity) times, and the plan stays
within some 100,000 entries at capacity 2048 whatever the corpus holds.  Each piece then finds its place from its rank
among the pieces of its length; ranks come from counts by bucket, without sorting a length's pieces in one task.

Null texts count as empty: one id, the end id.  Null and repeated doc_ids keep their rows.  An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import _base
from quire.llm._tokens import encoder, slices, vocabulary_path

CAPACITY = 2048
#: Pieces of a bucket, about.
BUCKET_ROWS = 20_000


def plan(counts: Iterable[tuple[int, int]], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """counts: (length, pieces).  Gives (length, first rank, first bin, pieces in each bin, offset) and the number of bins.

    The pieces of a length from one first rank up to the next fill consecutive bins, so many in each.
    """
    left = {int(n): int(c) for n, c in counts if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a length is outside the capacity")
    out: list[tuple[int, int, int, int, int]] = []
    rank = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first bin, bins)
    sizes: list[int] = []  # the gaps that exist, ascending
    bins = 0

    def put(length: int, first: int, n: int, each: int, gap: int) -> None:
        """each pieces of this length into each of n bins from first on, that have this gap."""
        out.append((length, rank[length], first, each, capacity - gap))
        rank[length] += n * each
        left[length] -= n * each
        if rest := gap - each * length:
            if rest not in gaps:
                gaps[rest] = []
                insort(sizes, rest)
            gaps[rest].append((first, n))

    def take(gap: int) -> tuple[int, int]:
        found = gaps[gap].pop()
        if not gaps[gap]:
            del gaps[gap]
            sizes.pop(bisect_left(sizes, gap))
        return found

    large = sorted(n for n in left if 3 * n > capacity)
    for length in reversed(large):
        while left[length]:
            fits = bisect_left(large, capacity - length + 1) - 1
            while fits >= 0 and left[large[fits]] <= (large[fits] == length):
                fits -= 1
            mate = large[fits] if fits >= 0 else None
            if mate is None:
                n = left[length]
                put(length, bins, n, 1, capacity)
            elif mate == length:
                n = left[length] // 2
                put(length, bins, n, 2, capacity)
            else:
                n = min(left[length], left[mate])
                put(length, bins, n, 1, capacity)
                take(capacity - length)
                put(mate, bins, n, 1, capacity - length)
            bins += n
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                each = capacity // length
                n = left[length] // each
                if n:
                    put(length, bins, n, each, capacity)
                else:
                    put(length, bins, n := 1, left[length], capacity)
                bins += n
                continue
            gap = sizes[at]
            first, n = take(gap)
            each = gap // length
            full = min(n, left[length] // each)
            some = left[length] - full * each if full < n else 0
            if full:
                put(length, first, full, each, gap)
            if some:
                put(length, first + full, 1, some, gap)
            if untouched := n - full - bool(some):
                if gap not in gaps:
                    gaps[gap] = []
                    insort(sizes, gap)
                gaps[gap].append((first + n - untouched, untouched))
    return out, bins


def pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of each document's ids and end id."""
    vocabulary = vocabulary or vocabulary_path()

    def cut_up(batches) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        enc = encoder(vocabulary)
        for batch in batches:
            for at, to in slices(batch.column("text"), 8 << 20):
                ids, lengths = enc.encode(batch.column("text").slice(at, to - at), end_id)
                each = -(-lengths // capacity)  # pieces of each document
                doc = np.repeat(np.arange(len(lengths)), each)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
                start = piece * capacity
                size = np.minimum(lengths[doc] - start, capacity)
                edges = (np.concatenate([[0], np.cumsum(size)]) * 4).tolist()  # pieces follow one another without gaps
                view = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(view[x:y]) for x, y in zip(edges, edges[1:], strict=False)]
                names = batch.column("doc_id").slice(at, to - at).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([names, pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut_up, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (doc_id, piece, length and any others) with sequence_id and offset added.  rows must read the same each time."""
    spark = rows.sparkSession
    counts = [(r["length"], r["n"]) for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()]  # at most one row per length
    entries, _ = plan(counts, capacity)
    total = sum(n for _, n in counts)
    buckets = max(_base.shuffle_partitions(spark), -(-total // BUCKET_ROWS))
    # numbers of rows that read the same each time, so that equal rows part, and keep their places
    dealt = rows.withColumn("_nth", F.monotonically_increasing_id()).withColumn("_bucket", F.pmod(F.xxhash64("_nth"), F.lit(buckets)))
    base = dealt.groupBy("_bucket", "length").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("_bucket", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_bucket", "length").orderBy("_nth")
    ranked = dealt.withColumn("_in", F.row_number().over(inside) - 1).join(base, ["_bucket", "length"]).withColumn("_rank", F.col("_base") + F.col("_in"))
    by_length: dict[int, list] = {}
    for length, rank, first, each, offset in entries:
        by_length.setdefault(length, []).append((rank, first, each, offset))
    # at most one row per length, with its entries in order of rank
    table = spark.createDataFrame([(n, sorted(v)) for n, v in by_length.items()], "length long, _plan array<struct<rank:long,first:long,each:long,offset:long>>")
    mine = F.element_at(F.filter("_plan", lambda e: e["rank"] <= F.col("_rank")), -1)
    return (
        ranked.join(F.broadcast(table), "length")
        .withColumn("_mine", mine)
        .withColumn("sequence_id", F.expr("_mine.first + (_rank - _mine.rank) div _mine.each"))
        .withColumn("offset", F.expr("_mine.offset + (_rank - _mine.rank) % _mine.each * length"))
        .select(*rows.columns, "sequence_id", "offset")
    )


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset.  docs: doc_id, text."""
    return place(_base.cut(pieces(docs, vocabulary, end_id, capacity)), capacity)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(_base.table(spark, sf_dir, "documents"))
