"""Token ids of a corpus as Huffman-shaped wavelet matrices, many in one file.

A shard keeps the ids of consecutive documents as bit-planes: an id's code is its Huffman code by the shard's own counts,
plane k holds the k-th bit of all codes that have one, and codes are dealt so that the ids that end on a plane stand behind all
others on it.  Each plane is cut into blocks of 65,536 bits that are compressed one by one, with the number of ones before
each block, so a shard answers token access, counting, occurrence lookup (rank and select) and whole decoding, and
opens only the blocks it needs.  A task writes its shards one behind another into files of FILE_TOKENS ids or so; a shard is read by its place
in the file, without the rest.

Shard: the 4 bytes QWM2, a 4-byte little-endian header length, the header as JSON, then the parts
that it places: code table, document table, blocks.

Null texts count as empty and give only the end id.  Null doc_ids sort first and stay null.
Repeated doc_ids keep their rows.  An empty table gives no file and no row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import _base
from quire.llm._tokens import encoder, slices, vocabulary_path

MAGIC = b"QWM2"
BLOCK_BITS = 1 << 16
#: Ids after which a shard is closed, which bounds a task's memory, and after which a file is.
SHARD_TOKENS, FILE_TOKENS = 2_000_000, 200_000_000


def code_lengths(counts) -> list[int]:
    """Lengths of the Huffman codes of symbols that occur so often; a lone symbol has one bit."""
    import heapq

    if len(counts) < 2:
        return [1] * len(counts)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    up, new = [0] * (2 * len(counts) - 1), len(counts)
    while len(heap) > 1:
        a, i = heapq.heappop(heap)
        b, j = heap[0]
        up[i] = up[j] = new
        heapq.heapreplace(heap, (a + b, new))
        new += 1
    depth = [0] * new
    for i in reversed(range(new - 1)):
        depth[i] = depth[up[i]] + 1
    return depth[: len(counts)]


def codes(lengths) -> tuple[list[int], list[list[int]]]:
    """Codes of symbols, as numbers of `lengths` bits, and by length the symbols that have it in the order in which they end a plane.

    Planes hold prefixes sorted by their last bit first; the last ones of a length are the codes of that length.
    """
    by: list[list[int]] = [[] for _ in range(max(lengths, default=0) + 1)]
    for i, n in enumerate(lengths):
        by[n].append(i)
    out, live = [0] * len(lengths), [0]
    for own in by[1:]:
        live = [2 * p for p in live] + [2 * p + 1 for p in live]
        if own:
            for symbol, code in zip(own, live[-len(own) :], strict=True):
                out[symbol] = code
            live = live[: -len(own)]
    return out, by


def build_shard(ids, doc_ids, lengths) -> bytes:
    """ids: unsigned 16-bit integers; doc_ids: integers or None; lengths: ids of each document."""
    import numpy as np
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    ids = np.asarray(ids, dtype="<u2")
    count = np.bincount(ids, minlength=1)
    symbols = np.flatnonzero(count)
    sizes = code_lengths(count[symbols].tolist())
    code, by = codes(sizes)
    levels = len(by) - 1
    left = np.zeros(len(count), dtype=np.uint32 if levels <= 32 else np.uint64)
    width = 8 * left.itemsize
    left[symbols] = np.array([c << (width - n) for c, n in zip(code, sizes, strict=True)], dtype=left.dtype)
    now = left[ids]
    top = left.dtype.type(1 << (width - 1))
    parts, blocks, ranks, zeros, held = [], [], [], [], []
    for level in range(levels):
        bit = now >= top
        plane = np.packbits(bit, bitorder="little").tobytes()
        starts = np.arange(0, len(now), BLOCK_BITS)
        ones = [int(np.count_nonzero(bit[a : a + BLOCK_BITS])) for a in starts.tolist()]
        ranks.append([0, *np.cumsum(ones).tolist()])
        some = [pack(plane[a // 8 : (a + BLOCK_BITS) // 8]) for a in starts.tolist()]
        parts += some
        blocks.append([len(x) for x in some])
        held.append(len(now))
        zeros.append(len(now) - ranks[-1][-1])
        now <<= 1
        ended = int(count[symbols[by[level + 1]]].sum())
        now = np.concatenate([now.compress(~bit), now.compress(bit)])[: len(now) - ended]
    known = np.array([d is not None for d in doc_ids], dtype=bool)
    docs = pack(np.array([d if d is not None else 0 for d in doc_ids], dtype="<i8").tobytes() + np.asarray(lengths, dtype="<i8").tobytes() + known.tobytes())
    table = pack(symbols.astype("<u2").tobytes() + np.array(sizes, dtype="u1").tobytes() + count[symbols].astype("<i8").tobytes())
    header = json.dumps({"n": len(ids), "docs": len(doc_ids), "symbols": len(symbols), "table_bytes": len(table), "docs_bytes": len(docs), "held": held, "zeros": zeros, "ranks": ranks, "blocks": blocks}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, table, docs, *parts])


class WaveletShard:
    """Reads what build_shard wrote."""

    def __init__(self, data: bytes):
        import numpy as np
        import zstandard

        if data[:4] != MAGIC:
            raise ValueError("not a shard")
        size = int.from_bytes(data[4:8], "little")
        self._data, head = memoryview(data), json.loads(data[8 : 8 + size])
        self.n, self.held, self.zeros, self._ranks = head["n"], head["held"], head["zeros"], head["ranks"]
        self._open = zstandard.ZstdDecompressor().decompress
        at, s, d = 8 + size, head["symbols"], head["docs"]
        raw = self._open(self._data[at : at + head["table_bytes"]])
        self._symbols, sizes, self._counts = np.frombuffer(raw[: 2 * s], "<u2").tolist(), list(raw[2 * s : 3 * s]), np.frombuffer(raw[3 * s :], "<i8")
        code, self._by = codes(sizes)
        self._code = {t: (c, n) for t, c, n in zip(self._symbols, code, sizes, strict=True)}
        self._symbol = {(c, n): t for t, (c, n) in self._code.items()}
        at += head["table_bytes"]
        raw = self._open(self._data[at : at + head["docs_bytes"]])
        ids, self.lengths, known = np.frombuffer(raw[: 8 * d], "<i8"), np.frombuffer(raw[8 * d : 16 * d], "<i8"), np.frombuffer(raw[16 * d :], bool)
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known, strict=True)]
        at += head["docs_bytes"]
        self._places = []
        for each in head["blocks"]:
            ends = (np.cumsum(each) + at).tolist()
            self._places.append(list(zip([at, *ends[:-1]], ends, strict=True)))
            at = ends[-1]
        self._kept: dict = {}

    def _block(self, level: int, k: int):
        import numpy as np

        if (level, k) not in self._kept:
            if len(self._kept) > 256:
                self._kept.clear()
            a, b = self._places[level][k]
            self._kept[level, k] = np.unpackbits(np.frombuffer(self._open(self._data[a:b]), "u1"), bitorder="little")
        return self._kept[level, k]

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits."""
        import numpy as np

        k, rest = divmod(i, BLOCK_BITS)
        return self._ranks[level][k] + (int(np.count_nonzero(self._block(level, k)[:rest])) if rest else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of this kind."""
        import bisect

        import numpy as np

        before = self._ranks[level] if bit else [min(b * BLOCK_BITS, self.held[level]) - r for b, r in enumerate(self._ranks[level])]
        b = bisect.bisect_right(before, k) - 1
        return b * BLOCK_BITS + int(np.flatnonzero(self._block(level, b) == bit)[k - before[b]])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level in range(len(self.held)):
            k, rest = divmod(i, BLOCK_BITS)
            bit = int(self._block(level, k)[rest])
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            code = code << 1 | bit
            if (found := self._symbol.get((code, level + 1))) is not None:
                return found
        raise ValueError("no such code")

    def _range(self, token: int, end: int) -> tuple[int, int]:
        if token not in self._code:
            return 0, 0
        a, b = 0, end
        code, size = self._code[token]
        for level in range(size):
            one_a, one_b = self._rank1(level, a), self._rank1(level, b)
            if code >> (size - 1 - level) & 1:
                a, b = self.zeros[level] + one_a, self.zeros[level] + one_b
            else:
                a, b = a - one_a, b - one_b
        return a, b

    def rank(self, token: int, end: int) -> int:
        """Occurrences of token before place end."""
        a, b = self._range(token, end)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        code, size = self._code[token]
        for level in reversed(range(size)):
            bit = code >> (size - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def find(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self):
        """All ids, in order."""
        import numpy as np

        symbols, now = np.array(self._symbols, dtype="<u2"), np.zeros(0, dtype="<u2")
        for level in reversed(range(len(self.held))):
            ended = self._by[level + 1]
            if ended:
                now = np.concatenate([now, np.repeat(symbols[ended], self._counts[ended])])
            plane = b"".join([self._open(self._data[a:b]) for a, b in self._places[level]])
            bit = np.unpackbits(np.frombuffer(plane, "u1"), count=len(now), bitorder="little").view(bool)
            was = np.empty_like(now)
            was[np.flatnonzero(~bit)] = now[: self.zeros[level]]
            was[np.flatnonzero(bit)] = now[self.zeros[level] :]
            now = was
        return now


#: A file's task and number, a shard's place in it.
_MANIFEST = "task int, file int, shard int, path string, first_byte long, n_bytes long, n_docs long, n_tokens long"


def write_shards(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 1, shard_tokens: int = SHARD_TOKENS, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the files in ascending doc_id order; one row per shard, kept in the shared folder.

    docs: doc_id, text.  Rows are dealt by ranges of doc_id, so each task writes consecutive documents; rows that repeat a
    doc_id, or have none, may go to several tasks, next to one another.
    """
    vocabulary = vocabulary or vocabulary_path()

    def write(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc, task = encoder(vocabulary), TaskContext.get().partitionId()
        out, file, rows = None, 0, []
        held, names, lengths = [], [], []

        def close_shard():
            nonlocal out
            path = f"{folder}/tokens-{task:06d}-{file:04d}.qwm"
            out = out or _base.NewFile(path)
            data = build_shard(np.concatenate(held), names, lengths)
            rows.append((task, file, len(rows), path, out.put(data), len(data), len(names), int(sum(lengths))))
            held.clear(), names.clear(), lengths.clear()

        def close_file():
            nonlocal out, file
            out.close()
            out, file = None, file + 1
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=columns)
            rows.clear()
            return got

        columns = [c.split()[0] for c in _MANIFEST.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4]
        for batch in batches:
            for a, b in slices(batch.column("text"), min(8 << 20, 4 * shard_tokens)):
                ids, own = enc.encode(batch.column("text").slice(a, b - a), end_id)
                held.append(ids)
                names += batch.column("doc_id").slice(a, b - a).to_pylist()
                lengths += own.tolist()
                if sum(map(len, held)) >= shard_tokens:
                    close_shard()
                if sum(r[-1] for r in rows) >= file_tokens:
                    yield close_file()
        if names:
            close_shard()
        if rows:
            yield close_file()

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("_nth"))
    dealt = named.repartitionByRange("doc_id", "_nth").sortWithinPartitions("doc_id", "_nth").select("doc_id", "text")
    return _base.cut(dealt.mapInArrow(write, _MANIFEST))


def read_shards(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) of each document, from the files.

    digest: ids_crc32 instead of ids.
    """
    last = "ids_crc32 long" if digest else "ids binary"
    schema, spark = f"doc_id long, start long, n_tokens long, {last}", manifest.sparkSession
    shards = manifest.count()
    if not shards:
        return spark.createDataFrame([], schema)
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per file meets in one task, then each file's shards
    files = manifest.groupBy("task", "file").agg(F.sum("n_tokens").alias("n_tokens"))
    files = files.select("task", "file", before(Window.orderBy("task", "file")).alias("base"))
    inside = manifest.withColumn("inside", before(Window.partitionBy("task", "file").orderBy("shard")))
    placed = inside.join(files, ["task", "file"]).select("path", "first_byte", "n_bytes", (F.col("base") + F.col("inside")).alias("start"))

    def read(batches) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                shard = WaveletShard(_base.get_bytes(r["path"], r["first_byte"], r["n_bytes"]))
                ids = shard.decode()
                ends = np.cumsum(shard.lengths)
                for a in range(0, len(ends), 2_000):
                    own, to = shard.lengths[a : a + 2_000], ends[a : a + 2_000]
                    some = ids[to[0] - own[0] : to[-1]].astype("<u4")
                    edges = (np.concatenate([[0], np.cumsum(own)]) * 4).tolist()
                    view = memoryview(some).cast("B")
                    each = [view[x:y] for x, y in zip(edges, edges[1:], strict=False)]
                    found = pa.array([zlib.crc32(x) for x in each], pa.int64()) if digest else pa.array([bytes(x) for x in each], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[a : a + 2_000], pa.int64()), pa.array(to - own + r["start"]), pa.array(own), found], names=["doc_id", "start", "n_tokens", last.split()[0]])

    return placed.repartition(shards).mapInArrow(read, schema)


def token_digests(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from files that are written and read back."""
    return read_shards(write_shards(docs, folder, vocabulary, end_id), digest=True)


def op9_wavelet_token_files(spark, sf_dir: str) -> DataFrame:
    return token_digests(_base.table(spark, sf_dir, "documents"), _base.new_folder(spark, "token-files"))
