"""Language-model scores: a word-frequency base, and a causal self-attention model over subword ids with a memory of the corpus.

All texts are split and encoded once; a table in the shared folder keeps them in blocks, as ids and as numbers of the block's distinct words.
Word counts cover all training rows (those whose crc32(doc_id) isn't a multiple of 10).  A word is known by its 64-bit hash: of ten
billion words a few would share one.  The commonest words, COMMON_WORDS at most by a histogram of the counts, go to every task; the others' counts are
joined to the documents that hold them.

The model (see _attention) has its leaves, its places and what it takes from the last id from counts over all training rows; its attention to
earlier ids is fitted on all windows of all training rows (FIT_SHARE: one in so many, by a hash of doc_id, ids and place).  Another hash deals them to shards of SHARD_WINDOWS or so; each
shard is fitted on its own, in the order of the hashes, and shards are averaged by how often they met an id.  So what is learned grows with the input, and
neither the layout of the table nor the number of tasks has a part in it.

The memory: where the hash of the last CONTEXT ids is one in ANCHORS, and behind the first CONTEXT ids of each text, the next SEGMENT ids are one choice, between what followed the same
ids elsewhere in the training rows and what the model says.  With n of the c other occurrences going on alike, the segment's probability
is (n + k p) / (c + k), p the model's own and k a number that makes 1 / (1 + k) the mean share n / c over the training rows.  A text's own
occurrences don't count for it, so training rows are judged as held-out ones are, and texts that the corpus holds twice stand out.

Null and empty texts are their end token alone.  Null doc_ids are scored and count as held out.  Repeated rows are scored one
by one; each is an occurrence elsewhere for the other.  Without training rows the base is that of empty counts and the model spreads evenly.  An empty
table gives no rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _base
from quire.llm._attention import GROUPS, INPUTS, MORE, RANKED, SLOTS, STRIDE, WINDOW, Attention, leaves_of, pair_places, ranking, window_ids
from quire.llm._tokens import encoder, slices, vocabulary_path, word_table

COMMON_WORDS = 1_000_000
FIT_SHARE, SHARD_WINDOWS, FIT_ROUNDS = 1, 24_000, 1
CONTEXT, ANCHORS, SEGMENT = 6, 64, 16
#: Bytes of text in a block, and ids that a task scores at a time.
BLOCK_BYTES, SCORE_IDS = 6 << 20, 1_000_000
#: Bytes of a row group of blocks.  It is written and read as a whole, in memory; and its size would be looked at after 100 rows only, which are 1.5 GB here.
GROUP_BYTES = 16 << 20
#: Bytes of windows from which they are compressed.
LEAST_COMPRESSED = 2_000
#: Places of a row of sums.
BLOCK_PLACES = 256
WIDTH = RANKED + 2


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(True))


#: A block: by text nth, doc_id as text, held_out, number of words and of ids; its distinct words' hashes, how often the training rows have them, and which
#: word follows which (32-bit numbers); ids (16-bit, end ids included); how often ids are in the training rows, and how many those are.
_BLOCK = (
    "nth array<long>, doc_id array<string>, held_out array<boolean>, n_words array<long>, n_ids array<long>, "
    "words array<long>, times array<long>, word_at binary, ids binary, seen_ids array<int>, id_times array<long>, ends long"
)


def store(docs: DataFrame, vocabulary: str, folder: str, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Writes docs as blocks, and reads them back; a row group is full with the block that brings it to group_bytes."""

    def run(batches) -> Iterator:
        import pyarrow as pa
        import xxhash

        enc = encoder(vocabulary)
        names = [c.split()[0] for c in _BLOCK.split(", ")]

        def block(*columns):
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) if isinstance(c, pa.Array) else pa.array([c]) for c in columns], names=names)

        for batch in batches:
            for a, b in slices(batch.column("text"), block_bytes):
                some = batch.slice(a, b - a)
                train = ~some.column("held_out").to_numpy(zero_copy_only=False)
                words, index, counts = word_table(some.column("text"))
                ids, lengths = enc.encode(some.column("text"), enc.end_id, (words, index, counts))
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), "<u8", len(words)).view("<i8")
                del words
                times = np.bincount(index, weights=np.repeat(train, counts), minlength=len(hashes)).astype(np.int64)
                by_id = np.bincount(ids, weights=np.repeat(train, lengths)).astype(np.int64)
                seen = np.flatnonzero(by_id)
                numbers = pa.array(counts), pa.array(lengths), pa.array(hashes), pa.array(times)
                yield block(*(some.column(c) for c in ("nth", "doc_id", "held_out")), *numbers, index.astype("<i4").tobytes(), ids.tobytes(), pa.array(seen.astype(np.int32)), pa.array(by_id[seen]), int(train.sum()))

    # doc_id goes to Python as text, whatever its type
    named = docs.select(F.monotonically_increasing_id().alias("nth"), F.col("doc_id").cast("string").alias("doc_id"), held_out().alias("held_out"), "text")
    checks = {f"parquet.page.size.row.check.{most}": "1" for most in ("min", "max")}  # pages' and row groups'
    named.mapInArrow(run, _BLOCK).write.options(compression="zstd", **{"parquet.block.size": str(group_bytes), "parquet.enable.dictionary": "false"}, **checks).parquet(folder)
    return docs.sparkSession.read.schema(_BLOCK).parquet(folder)


def word_counts(stored: DataFrame) -> DataFrame:
    """word, n of all training rows, one row per word; kept in the shared folder."""
    each = stored.select(F.explode(F.arrays_zip("words", "times")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.times").alias("n"))
    return _base.cut(each.where("n > 0").groupBy("word").agg(F.sum("n").alias("n")))


def id_counts(stored: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """Training rows, and how often each id occurs in them; at most one entry per id of the vocabulary comes to the driver."""
    each = stored.select(F.explode(F.arrays_zip("seen_ids", "id_times")).alias("x")).groupBy("x.seen_ids").agg(F.sum("x.id_times").alias("n"))
    out = np.zeros(size)
    for r in each.collect():
        out[r["seen_ids"]] = r["n"]
    return stored.agg(F.coalesce(F.sum("ends"), F.lit(0))).first()[0], out


def common_words(counts: DataFrame, most: int = COMMON_WORDS) -> tuple[int, np.ndarray, np.ndarray]:
    """The least count such that at most `most` words have it, from counts by steps of an eighth of an octave; those words, sorted, and their counts."""
    step = F.floor(F.log2("n") * 8).cast("int")
    least, total = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect(), reverse=True):
        total += r["words"]
        if total > most:
            break
        least = r["least"]
    if least is None:
        return 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = counts.where(F.col("n") >= least).toArrow()
    words, n = (got.column(c).to_numpy().astype(np.int64) for c in ("word", "n"))
    order = np.argsort(words)
    return least, words[order], n[order]


def word_ends(library) -> np.ndarray:
    """By id, whether it ends a word."""
    ends = np.zeros(library.get_vocab_size(), dtype=bool)
    ends[[i for token, i in library.get_vocab().items() if token.endswith("</w>")]] = True
    return ends


def _lists(column, kind=np.int64):
    """The lists of an Arrow column, as arrays."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b].astype(kind, copy=False) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _trained(batches) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Of each block with training rows: those's doc_ids as text, ids one after another, and number of ids."""
    for batch in batches:
        for names, held, lengths, ids in zip(batch.column("doc_id"), _lists(batch.column("held_out"), bool), _lists(batch.column("n_ids")), batch.column("ids"), strict=True):
            if not held.all():
                yield [n for n, h in zip(names.as_py(), held.tolist(), strict=True) if not h], np.frombuffer(ids.as_buffer(), "<u2")[np.repeat(~held, lengths)], lengths[~held]


def _summed(parts: DataFrame) -> Iterator:
    """(key, total) from rows of key, at and n (places and what to add there, as bytes): rows of a key meet in one task, which adds them up as they come."""

    def add(batches) -> Iterator:
        import pyarrow as pa

        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, size, at, n in zip(*(batch.column(c).to_pylist() for c in ("key", "size", "at", "n")), strict=True):
                total = totals.setdefault(key, np.zeros(size))
                total[np.frombuffer(at, "<i4") if at is not None else slice(None)] += np.frombuffer(n, "<f8")
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["key", "total"])

    for r in parts.repartition("key").mapInArrow(add, "key long, total binary").toLocalIterator():
        yield r["key"], np.frombuffer(r["total"], "<f8")


_PARTS = "key long, size int, at binary, n binary"


def _parts(found: list):
    import pyarrow as pa

    columns = zip(*found, strict=True) if found else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["key", "size", "at", "n"])


def pair_counts(stored: DataFrame, place, column) -> np.ndarray:
    """How often an id of each column follows one of each place, over all training rows; places and columns are bounded in number."""
    shared = stored.sparkSession.sparkContext.broadcast((place.astype(np.int32) * np.int32(WIDTH), column.astype(np.int32)))

    def count(batches) -> Iterator:
        row_of, column_of = shared.value
        table = np.zeros(INPUTS * WIDTH, dtype=np.int64)
        for _, ids, lengths in _trained(batches):
            key = column_of.take(ids)
            key[1:] += row_of.take(ids[:-1])
            begins = np.cumsum(lengths) - lengths
            key[begins] = (INPUTS - 1) * WIDTH + column_of.take(ids[begins])
            for a in range(0, len(key), 1 << 20):  # sorted, equal pairs meet the table once
                some = np.sort(key[a : a + (1 << 20)])
                edges = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1], [True]]))
                table[some[edges[:-1]]] += np.diff(edges)
        rows = table.reshape(INPUTS, WIDTH)
        yield _parts([(k, WIDTH, at.astype("<i4").tobytes(), rows[k, at].astype("<f8").tobytes()) for k in range(INPUTS) if len(at := np.flatnonzero(rows[k]))])

    out = np.zeros((INPUTS, WIDTH), dtype=np.int64)
    for key, total in _summed(stored.select("doc_id", "held_out", "n_ids", "ids").mapInArrow(count, _PARTS)):
        out[key] = total
    return out


def packed(sizes, ids, cuts) -> Iterator[tuple[int, bytes]]:
    """Windows, as window_ids() has them, from each cut to the next: size and bytes; a size of 0 if those aren't compressed, as few bytes are not."""
    import pyarrow as pa

    codec, ends = pa.Codec("zstd"), np.concatenate([[0], np.cumsum(sizes % MORE + (sizes >= MORE), dtype=np.int64)])
    sizes, low, high = sizes.tobytes(), (ids & 255).astype("u1").tobytes(), (ids >> 8).astype("u1").tobytes()
    for a, b in zip(cuts, cuts[1:], strict=False):
        at = slice(ends[a], ends[b])
        data = sizes[a:b] + low[at] + high[at]
        yield (len(data), codec.compress(data, asbytes=True)) if len(data) >= LEAST_COMPRESSED else (0, data)


def unpacked(data: bytes, size: int, n: int):
    """sizes and ids of n windows that packed() gave as size and data."""
    import pyarrow as pa

    data = np.frombuffer(pa.Codec("zstd").decompress(data, size) if size else data, "u1")
    low, high = data[n:].reshape(2, -1).astype(np.uint16)
    return data[:n], low | high << 8


def window_count(stored: DataFrame) -> int:
    """Windows of all training rows."""
    each = stored.select(F.explode(F.arrays_zip("n_ids", "held_out")).alias("x")).where("not x.held_out")
    return each.agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.ceil((F.col("x.n_ids") - WINDOW) / STRIDE)) + 1), F.lit(0)).cast("long")).first()[0]


def fit(stored: DataFrame, vocabulary: str, by_id, share: int = FIT_SHARE, shard_windows: int = SHARD_WINDOWS, rounds: int = FIT_ROUNDS) -> Attention:
    """The model; stored: blocks; by_id: how often each id occurs in their training rows; share: one window in so many is fitted on."""
    place, column = pair_places(by_id, word_ends(encoder(vocabulary).library))
    pairs = pair_counts(stored, place, column)
    leaf = leaves_of(pairs)
    model = Attention(place, leaf[column], INPUTS - 1)
    names = model.NAMES
    if not pairs.any():
        for name in (*names, "to_group", "group_offset", "to_slot", "slot_offset"):
            getattr(model, name)[...] = 0
        return model
    follow = np.zeros((INPUTS, GROUPS * SLOTS), dtype=np.float32)
    follow[:, leaf] = pairs
    del pairs
    model.set_pairs(follow[: len(model.own)])
    del follow
    # windows travel with ids by their rank: small numbers, of which the higher bytes pack to little
    shared = stored.sparkSession.sparkContext.broadcast((model, ranking(by_id).astype("<u2")))

    shards = max(1, round(window_count(stored) / (share * shard_windows)))

    def draw(batches) -> Iterator:
        """Windows by shard: a block's, with their hashes, in a row."""
        import pyarrow as pa
        import xxhash

        most, rank_of = np.uint64((2**64 - 1) // share), np.argsort(shared.value[1]).astype("<u2")
        for names, ids, lengths in _trained(batches):
            each = np.maximum(1, -(-(lengths - WINDOW) // STRIDE) + 1)
            ends = np.cumsum(lengths).tolist()
            # rows that differ in doc_id alone draw windows of their own, and equal ones go to different shards
            seeds = np.array([xxhash.xxh64_intdigest(f"{n}:".encode() + ids[b - k : b].tobytes()) for n, b, k in zip(names, ends, lengths.tolist(), strict=True)], dtype=np.uint64)
            k = (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)).astype(np.uint64)
            rank = _mixed(np.repeat(seeds, each) * np.uint64(0x9E3779B97F4A7C15) + k)
            some = np.flatnonzero(rank <= most)
            if len(some):
                shard = (_mixed(rank[some] + np.uint64(1)) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                shard, some = shard[order], some[order]
                cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1)).tolist()
                rows = zip(*packed(*window_ids(rank_of.take(ids), lengths, some), cuts), strict=True)
                ranks = pa.array([rank[some[a:b]].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]]), ranks, *[pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.binary()), strict=True)]], names=["shard", "ranks", "size", "windows"])

    def run(batches) -> Iterator:
        """Sums of a task's shards, each fitted on its own."""
        held, now, sums = [], None, {}
        for batch in batches:
            for shard, *row in (tuple(v.as_py() for v in r) for r in zip(*batch.columns, strict=True)):
                if shard != now:
                    add(sums, held)
                    held, now = [], shard
                held.append(row)
        add(sums, held)
        yield _parts([(key, len(total), None, total.tobytes()) for key, total in sums.items()])

    def add(sums, held) -> None:
        for key, total in fitted(held) if held else ():
            sums[key] = sums[key] + total if key in sums else total

    def fitted(held) -> list:
        """Tables of a shard's own fit, weighted by how often their places were met."""
        mine, ranked = pickle.loads(pickle.dumps(shared.value[0])), shared.value[1]
        ranks = np.frombuffer(b"".join(r for r, _, _ in held), "<i8")
        order = np.argsort(ranks, kind="stable")  # windows of a hash are equal
        each = [unpacked(data, size, len(r) // 8) for r, size, data in held]
        held.clear()
        sizes, ids = (np.concatenate(v) for v in zip(*each, strict=True))
        x, y, counts = mine.positions_of(sizes, ranked.take(ids))
        met = mine.fit(x[order], y[order], counts[order], rounds).astype(np.float64)
        met[met > 0] += 1e-3
        found = []
        for t, name in enumerate(names):
            table = np.atleast_2d(getattr(mine, name).T).T.astype(np.float64)
            weight = met if name != "bias" else np.full(len(table), float(len(x)))
            for b in range(0, len(table), BLOCK_PLACES):
                w = weight[b : b + BLOCK_PLACES]
                if w.any():
                    found.append((t * INPUTS + b, np.concatenate([(table[b : b + BLOCK_PLACES] * w[:, None]).ravel(), w])))
        return found

    drawn = stored.select("doc_id", "held_out", "n_ids", "ids").mapInArrow(draw, "shard long, ranks binary, size int, windows binary")
    # a number of its own: few bytes of windows are much to compute, so partitions aren't to be put together by their bytes
    dealt = drawn.repartition(min(shards, _base.shuffle_partitions(stored.sparkSession)), "shard").sortWithinPartitions("shard")
    for key, total in _summed(dealt.mapInArrow(run, _PARTS)):
        table = getattr(model, names[key // INPUTS])
        table = table[:, None] if table.ndim == 1 else table  # a view
        n = min(BLOCK_PLACES, len(table) - key % INPUTS)
        weight, rows = total[-n:], np.flatnonzero(total[-n:])
        table[key % INPUTS + rows] = total[:-n].reshape(n, -1)[rows] / weight[rows, None]
    return model


def _mixed(h):
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(ids, lengths, rate: int = ANCHORS):
    """Where remembered segments begin, where they end, the hash of the ids before them and their own; ids: of texts one after another.

    They begin where the hash of the ids before is one in `rate`, and behind each text's first CONTEXT ids.
    """
    end = np.cumsum(lengths)
    n, x, p = len(ids), ids.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
    if n <= CONTEXT:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    h = np.zeros(n - CONTEXT, dtype=np.uint64)
    for k in range(CONTEXT):
        h = h * p + x[k : n - CONTEXT + k]
    h = _mixed(h)
    chosen = h % np.uint64(rate) == 0
    chosen[(end - lengths)[lengths > CONTEXT]] = True
    at = np.flatnonzero(chosen)
    before, at = h[at], at + CONTEXT
    text = np.searchsorted(end, at, side="right")
    inside = at - CONTEXT >= (end - lengths)[text]
    at, before, last = at[inside], before[inside], np.minimum(at[inside] + SEGMENT, end[text[inside]])
    keep, free = [], 0
    for i, (a, b) in enumerate(zip(at.tolist(), last.tolist(), strict=True)):
        if a >= free:  # each id is in one segment at most
            keep.append(i)
            free = b
    at, before, last = at[keep], before[keep], last[keep]
    own = np.zeros(len(at), dtype=np.uint64)
    for k in range(SEGMENT):
        own = own * p + np.where(at + k < last, x[np.minimum(at + k, n - 1)], np.uint64(0))
    return at, last, before.view(np.int64), _mixed(own).view(np.int64)


def _times(texts, keys):
    """How often each key is in its text."""
    order = np.lexsort((keys, texts))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (texts[order][1:] != texts[order][:-1]) | (keys[order][1:] != keys[order][:-1])
    run = np.cumsum(new) - 1
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.bincount(run)[run] if len(run) else 0
    return out


def remembered(marks: DataFrame) -> DataFrame:
    """nth, more (what memory adds to a row's log10 probability).  marks: nth, before, segment, log_p, own_before, own_segment, train (0 or 1), one row per segment."""
    pairs = marks.groupBy("before", "segment").agg(F.sum("train").alias("n"), F.min("train").alias("train"))
    met = pairs.groupBy("before").agg(F.sum("n").alias("c"), F.min("train").alias("train")).where((F.col("c") > 1) | (F.col("c") > 0) & (F.col("train") == 0)).select("before", "c")
    known = marks.join(met, "before").join(pairs.select("before", "segment", "n"), ["before", "segment"])
    c, n = F.col("c") - F.col("train") * F.col("own_before"), F.col("n") - F.col("train") * F.col("own_segment")
    known = _base.stored(known.select("nth", "train", "log_p", c.alias("c"), n.alias("n")).where("c > 0"), "lm-known")
    share = known.where("train = 1").agg(F.avg(F.col("n") / F.col("c"))).first()[0]
    k = F.lit(1 / min(max(share or 0.0, 1e-3), 1 - 1e-3) - 1)
    more = F.when(F.col("n") > 0, F.log(F.col("n") + k * F.exp("log_p")) - F.col("log_p")).otherwise(F.log(k)) - F.log(F.col("c") + k)
    return known.groupBy("nth").agg((F.sum(more) / math.log(10)).alias("more"))


def score(docs: DataFrame, vocabulary: str | None = None, common: int = COMMON_WORDS, share: int = FIT_SHARE, shard_windows: int = SHARD_WINDOWS, rounds: int = FIT_ROUNDS, rate: int = ANCHORS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.  docs: doc_id, text; rate: the memory begins a segment at one place in so many."""
    vocabulary, spark = vocabulary or vocabulary_path(), docs.sparkSession
    stored = store(docs, vocabulary, _base.new_folder(spark, "lm-ids"))
    counts = word_counts(stored)
    ends, by_id = id_counts(stored, encoder(vocabulary).library.get_vocab_size())
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = row["n"] + ends, row["v"] + (ends > 0)
    whole = total + 0.1 * (distinct + 1)
    log = lambda c: math.log10((c + 0.1) / whole)
    least, frequent, times = common_words(counts, common)
    model = fit(stored, vocabulary, by_id, share, shard_windows, rounds)
    model.set_counts(by_id)
    shared = spark.sparkContext.broadcast((model, frequent, np.log10((times + 0.1) / whole)))

    def run(batches) -> Iterator:
        import pyarrow as pa

        model, frequent, logs = shared.value

        def lists(kind, values, sizes):
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))

        for batch in batches:
            for i, (words, n_words, n_ids) in enumerate(zip(*(_lists(batch.column(c)) for c in ("words", "n_words", "n_ids")), strict=True)):
                index, ids = np.frombuffer(batch.column("word_at")[i].as_buffer(), "<i4"), np.frombuffer(batch.column("ids")[i].as_buffer(), "<u2")
                names = [batch.column(c)[i].values for c in ("nth", "doc_id", "held_out")]
                at = np.searchsorted(frequent, words).clip(0, max(0, len(frequent) - 1))
                log_of = np.where(frequent[at] == words, logs[at], np.nan) if len(frequent) else np.full(len(words), np.nan)
                edges = np.searchsorted(np.cumsum(n_ids), np.arange(0, n_ids.sum(), SCORE_IDS), side="right").tolist()
                word_ends, id_ends = np.concatenate([[0], np.cumsum(n_words)]), np.concatenate([[0], np.cumsum(n_ids)])
                for a, b in zip(edges, [*edges[1:], len(n_ids)], strict=True):
                    if a < b:
                        yield part(lists, [c.slice(a, b - a) for c in names], n_words[a:b], n_ids[a:b], words, log_of, index[word_ends[a] : word_ends[b]], ids[id_ends[a] : id_ends[b]], model)

    def part(lists, names, n_words, n_ids, words, log_of, index, ids, model):
        """Rows of some of a block's texts."""
        import pyarrow as pa

        n, each = len(n_words), log_of.take(index)
        text, rare = np.repeat(np.arange(n), n_words), np.flatnonzero(np.isnan(each))
        base = np.bincount(text, weights=np.nan_to_num(each, copy=False), minlength=n)
        of_rare = text[rare]
        key, times = np.unique(of_rare * len(words) + index[rare], return_counts=True)  # by text, then word
        rare_of, rare_words = (key // len(words), words[key % len(words)]) if len(words) else (key, key)
        log_p = model.score(ids, n_ids)
        sums, ends = np.concatenate([[0.0], np.cumsum(log_p)]), np.cumsum(n_ids)
        at, last, before, segment = anchors(ids, n_ids, rate)
        of_mark = np.searchsorted(ends, at, side="right")
        marks = [(pa.int64(), before), (pa.int64(), segment), (pa.float64(), sums[last] - sums[at]), (pa.int64(), _times(of_mark, before)), (pa.int64(), _times(of_mark, before ^ segment))]
        columns = [pa.array(n_words), pa.array(n_words - np.bincount(of_rare, minlength=n)), pa.array(base)]
        columns += [lists(pa.int64(), x, np.bincount(rare_of, minlength=n)) for x in (rare_words, times)]
        columns += [pa.array((sums[ends] - sums[ends - n_ids]) / math.log(10)), *[lists(kind, x, np.bincount(of_mark, minlength=n)) for kind, x in marks]]
        return pa.RecordBatch.from_arrays([*names, *columns], names=[c.split()[0] for c in kinds])

    kinds = ["nth long", "doc_id string", "held_out boolean", "words long", "known long", "base double", "rare array<long>", "times array<long>", "score double"]
    kinds += ["before array<long>", "segment array<long>", "log_p array<double>", "own_before array<long>", "own_segment array<long>"]
    first = _base.stored(stored.select("nth", "doc_id", "held_out", "n_words", "n_ids", "words", "word_at", "ids").mapInArrow(run, ", ".join(kinds)), "lm-first")
    rare = first.select("nth", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("nth", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    met = rare.join(counts.where(F.col("n") < least) if least else counts, "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    each = F.col("times") * F.log10((F.col("c") + F.lit(0.1)) / F.lit(whole))
    known = F.when(F.col("c") > 0, F.col("times")).otherwise(0)
    marks = first.select("nth", (~F.col("held_out")).cast("long").alias("train"), F.explode(F.arrays_zip("before", "segment", "log_p", "own_before", "own_segment")).alias("x")).select("nth", "train", "x.*")
    # what is added to a row: from its rare words, and from memory
    more = met.select("nth", each.alias("base"), known.alias("known"), F.lit(0.0).alias("score")).union(remembered(marks).select("nth", F.lit(0.0), F.lit(0), "more"))
    more = more.groupBy("nth").agg(F.sum("base").alias("_base"), F.sum("known").alias("_known"), F.sum("score").alias("_score"))
    out = first.select("nth", F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "held_out", "words", "known", "base", "score").join(more, "nth", "left")
    return out.select(
        "doc_id",
        "held_out",
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("_known", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0)) + F.lit(log(ends))).alias("base_score"),
        (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score"),
    )


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(_base.table(spark, sf_dir, "documents"))
