"""Removes repeated passages of words, by super-k-mer partitioning.

A window is WINDOW consecutive words of one document.  A word goes if a window over it starts earlier, too: in a document with a smaller doc_id, or
earlier in its own.  Windows are judged on the input, not on what is left.

Each window has a minimiser: the least hash of its runs of MER words.  Consecutive windows that share it travel as one packed
string of words, with the document and place where it starts, to the bucket that the minimiser names; so a word travels some three times, not
twenty.  Equal windows have equal minimisers, so a bucket holds all of a window's places.  There windows are sorted by hash,
compared word by word with the first of their kind, and all but the first in the order of documents are reported as ranges.  A document
gets its ranges back by a join.

No bucket grows with one key.  A window that occurs several times in a slice of rows is sent once from there (the others are settled on the spot), so a passage that is
in a third of all documents gives one string for each slice.  Runs of MER words that hold more than a set share of all runs are
counted first, over all texts, and rank behind all others; windows of such runs only go to buckets by a hash of their own.  There are as many
buckets as the counted words need for each to fit in a task's memory.

A null text has no words.  Null doc_ids come after all others; documents with equal doc_ids are ordered by a hash of their texts, and of
rows that repeat both one is the first and all others lose every word that a window covers.  All rows stay; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _base
from quire.llm._tokens import slices

WINDOW, MER = 20, 4
#: Bytes of text that are cut up at a time, and words that a bucket is to hold.
SLICE_BYTES = 6 << 20
BUCKET_WORDS = 1_000_000
#: Windows of a packed string at most: a period of text can share one minimiser for ever.
RUN_WINDOWS = 256
#: Strings that words travel as, to a word of text, for the number of buckets.
SPREAD = 3.2
#: A run of words is counted in a slice from so many places on; it is frequent from a share of 1 / FREQUENT of all on, or one that follows the number of partitions.
COUNTED, FREQUENT = 8, 1_000_000
BASE = 0x9E3779B97F4A7C15
LAST = 2**64 - 1


def mix(x):
    """A permutation of unsigned 64-bit integers that spreads them."""
    import numpy as np

    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def rolling(h, n: int):
    """Hash of the n consecutive values from each place on, by doubling."""
    import numpy as np

    size, block, w, out, width = len(h), h, 1, None, 0
    while True:
        if n & w:
            m = size - width - w + 1
            out, width = (block, w) if out is None else (out[:m] * np.uint64(pow(BASE, w, 2**64)) + block[width : width + m], width + w)
        if 2 * w > n:
            return out
        m = size - 2 * w + 1
        block, w = block[:m] * np.uint64(pow(BASE, w, 2**64)) + block[w : w + m], 2 * w


def least(values, n: int):
    """The least of the n consecutive values from each place on."""
    import numpy as np

    size, m, w = len(values) - n + 1, values, 1
    while 2 * w <= n:
        m, w = np.minimum(m[:-w], m[w:]), 2 * w
    return np.minimum(m[:size], m[n - w : n - w + size])


def first_equal(ids, at, h, window: int):
    """For each of the places `at` (ascending; h: hashes of the windows there) the index of the first place with an equal window, word by word."""
    import numpy as np

    if not len(at):
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(h)
    starts = np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]]]))
    first = np.empty(len(at), dtype=np.int64)
    first[order] = np.repeat(np.minimum.reduceat(order, starts), np.diff(np.append(starts, len(at))))
    view = np.lib.stride_tricks.sliding_window_view(ids, window)
    again = np.flatnonzero(first != np.arange(len(at)))
    unlike = [some[(view[at[some]] != view[at[first[some]]]).any(axis=1)] for some in np.split(again, range(65_536, len(again), 65_536))]
    if len(unlike := np.concatenate(unlike)):  # different windows of one hash
        mixed = np.flatnonzero(np.isin(first, first[unlike]))
        _, lead, kind = np.unique(view[at[mixed]], axis=0, return_index=True, return_inverse=True)
        first[mixed] = mixed[lead[kind.ravel()]]
    return first


def stretches(places):
    """First and last of each stretch of consecutive ones among ascending places."""
    import numpy as np

    if not len(places):
        return places, places
    cut = np.flatnonzero(np.diff(places) != 1)
    return places[np.append(0, cut + 1)], places[np.append(cut, len(places) - 1)]


def _segments(text: bytes, overlap: int, size: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Words of a text in lists of some `size` bytes, with the number of words before; each list but the first begins with the last `overlap` words."""
    at, before, tail = 0, 0, []
    while at < len(text):
        to = at + size
        while to < len(text) and text[to] not in b" \t\n\x0b\x0c\r":
            to += 1
        words = text[at:to].split()
        at = to
        if words:
            yield before - len(tail), tail + words
            before += len(words)
            tail = (tail + words)[-overlap:] if overlap else []


class _Slice:
    """Texts in the order of documents, cut into words."""

    def __init__(self, words, counts, window: int, mer: int):
        """words: a flat Arrow array; counts: words of each text."""
        import numpy as np
        import xxhash

        self.words, self.window, self.mer = words, window, mer
        self.ends = np.cumsum(counts)
        coded = words.dictionary_encode()
        self.ids = coded.indices.to_numpy()
        known = coded.dictionary.cast("binary").to_pylist()
        self.h = np.fromiter(map(xxhash.xxh64_intdigest, known), dtype=np.uint64, count=len(known))[self.ids]
        self.lengths = np.fromiter(map(len, known), dtype=np.int64, count=len(known))[self.ids]

    def places(self, width: int):
        """Where runs of so many words start."""
        import numpy as np

        whole = np.ones(max(0, len(self.ids) - width + 1), dtype=bool)
        for back in range(1, width):
            edge = self.ends[:-1] - back
            whole[edge[(edge >= 0) & (edge < len(whole))]] = False
        return np.flatnonzero(whole)

    def mers(self):
        return mix(rolling(self.h, self.mer))

    def keys(self, frequent):
        """The minimiser of the window at each place; the window's own hash where all its runs are frequent."""
        import numpy as np

        order = self.mers()
        if len(frequent):
            found = np.minimum(np.searchsorted(frequent, order), len(frequent) - 1)
            order = np.where(frequent[found] == order, np.uint64(LAST), order)
        key = least(order, self.window - self.mer + 1)
        return np.where(key == np.uint64(LAST), mix(rolling(self.h, self.window)), key)

    def joined(self) -> tuple[bytes, list]:
        """All words with one space between, and where each starts."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = pa.ListArray.from_arrays(pa.array([0, len(self.words)], pa.int32()), self.words)
        return pc.binary_join(whole, " ")[0].as_buffer().to_pybytes(), np.concatenate([[0], np.cumsum(self.lengths + 1)])


def _cut_up(batches, window: int, mer: int) -> Iterator:
    """Slices of documents in order (none, doc_id, tag: arrays), with the number of words before each text; rows that repeat are left out."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        text = batch.column("text").cast(pa.string())
        none = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        doc = pc.fill_null(batch.column("doc_id").cast(pa.int64()), 0).to_numpy()
        tag = batch.column("tag").to_numpy()
        for a, b in slices(text, SLICE_BYTES):
            rows = a + np.lexsort((tag[a:b], doc[a:b], none[a:b]))
            same = np.concatenate([[False], (none[rows[1:]] == none[rows[:-1]]) & (doc[rows[1:]] == doc[rows[:-1]]) & (tag[rows[1:]] == tag[rows[:-1]])])
            rows = rows[~same]
            own = text.take(pa.array(rows))
            key = none[rows], doc[rows], tag[rows]
            if len(rows) == 1 and (pc.binary_length(own)[0].as_py() or 0) > SLICE_BYTES:
                for before, words in _segments(own[0].as_buffer().to_pybytes(), window - 1):
                    yield key, np.array([before]), _Slice(pa.array(words, pa.binary()).cast(pa.string()), np.array([len(words)]), window, mer)
                continue
            parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(own, "")))
            ends = parts.offsets.to_numpy().astype(np.int64)
            words = parts.values[ends[0] : ends[-1]]
            some = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # an empty text parts into one empty word
            before = np.concatenate([[0], np.cumsum(some)])
            yield key, np.zeros(len(rows), dtype=np.int64), _Slice(words.filter(pa.array(some)), np.diff(before[ends - ends[0]]), window, mer)


def _count(share: int, window: int, mer: int):
    """Runs of words that are frequent in a slice (mer, n); the words of a slice under a null mer."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for _, _, part in _cut_up(batches, window, mer):
            at = part.places(mer)
            found, n = np.unique(part.mers()[at], return_counts=True) if len(at) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = n >= max(COUNTED, len(at) / share)
            yield pa.RecordBatch.from_arrays([pa.array([None, *found[often].view(np.int64).tolist()], pa.int64()), pa.array([len(part.ids), *n[often].tolist()], pa.int64())], names=["mer", "n"])

    return run


#: What a packed string has beside its words: name and kind.
FIELDS = (("none", "u1"), ("doc", "<i8"), ("tag", "<i8"), ("start", "<i8"), ("windows", "<u2"), ("key", "<u4"))


def _send(buckets: int, frequent, window: int, mer: int):
    """Packed strings of a slice by bucket (compressed), and the windows that are settled there."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        hot = frequent.value
        for nth, (key, before, part) in enumerate(_cut_up(batches, window, mer)):
            at = part.places(window)
            if not len(at):
                continue
            text = np.searchsorted(part.ends, at, side="right")
            number = at - np.concatenate([[0], part.ends])[text] + before[text]
            first = first_equal(part.ids, at, rolling(part.h, window)[at], window)
            own = first == np.arange(len(at))
            a, b = stretches(at[~own])
            if len(a):
                i, j = np.searchsorted(at, a), np.searchsorted(at, b)
                data = b"".join(x.astype(t).tobytes() for x, t in zip([*[k[text[i]] for k in key], number[i], number[j]], ("u1", "<i8", "<i8", "<i8", "<i8"), strict=True))
                any_bucket = mix(part.h[:1] + np.uint64(nth)) % np.uint64(buckets)
                yield pa.RecordBatch.from_arrays([pa.array(any_bucket, pa.int32()), pa.array([len(a)], pa.int32()), pa.array([True]), pa.array([pack(data)], pa.binary())], names=["bucket", "n", "settled", "data"])
            key_at = part.keys(hot)[at]
            sent = np.flatnonzero(own)
            new = np.ones(len(sent), dtype=bool)
            new[1:] = (at[sent[1:]] != at[sent[:-1]] + 1) | (key_at[sent[1:]] != key_at[sent[:-1]])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(sent)), 0))
            new |= (np.arange(len(sent)) - lead) % RUN_WINDOWS == 0
            i = np.flatnonzero(new)
            count = np.diff(np.append(i, len(sent)))
            runs = sent[i]
            named = mix(key_at[runs] ^ np.uint64(BASE))
            bucket = (named % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            runs, count, bucket, named = runs[order], count[order], bucket[order], named[order]
            whole, starts = part.joined()
            x, y = starts[at[runs]].tolist(), (starts[at[runs] + count + window - 1] - 1).tolist()
            strings = [whole[p:q] for p, q in zip(x, y, strict=True)]
            columns = [*[k[text[runs]] for k in key], number[runs], count, named >> np.uint64(32)]
            columns = [c.astype(t) for c, (_, t) in zip(columns, FIELDS, strict=True)]
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            data = [pack(b"".join([*[c[p:q].tobytes() for c in columns], b" ".join(strings[p:q])])) for p, q in zip(edges, edges[1:], strict=False)]
            for p in range(0, len(data), 256):
                q = min(p + 256, len(data))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[edges[p:q]], pa.int32()), pa.array(np.diff(edges[p : q + 1]), pa.int32()), pa.array([False] * (q - p)), pa.array(data[p:q], pa.binary())], names=["bucket", "n", "settled", "data"]
                )

    return run


def _repeats(held: list, window: int):
    """The ranges of repeated windows in a bucket's packed strings: arrays none, doc, tag, first, last."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    columns: dict[str, list] = {name: [] for name, _ in FIELDS}
    strings = []
    for n, data in held:
        at = 0
        for name, kind in FIELDS:
            columns[name].append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        strings.append(data[at:])
    c = {name: np.concatenate(x) for name, x in columns.items()}
    _, kind, often = np.unique(c["key"], return_inverse=True, return_counts=True)
    some = often[kind] > 1  # equal windows have equal minimisers, and a slice sends a window once
    if not some.any():
        return None
    words = pc.split_pattern(pa.array([b" ".join(strings)], pa.large_binary()).cast(pa.large_string()), " ").values
    sizes = c["windows"].astype(np.int64) + window - 1
    words = words.filter(pa.array(np.repeat(some, sizes)))
    coded = words.dictionary_encode().indices.to_numpy()
    c, sizes = {k: v[some] for k, v in c.items()}, sizes[some]
    order = np.lexsort((c["start"], c["tag"], c["doc"], c["none"]))
    from_word = (np.cumsum(sizes) - sizes)[order]
    c, sizes = {k: v[order] for k, v in c.items()}, sizes[order]
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ids = coded[np.repeat(from_word, sizes) + within]
    at = np.flatnonzero(within < np.repeat(c["windows"].astype(np.int64), sizes))
    row = np.repeat(np.arange(len(sizes)), sizes)[at]
    first = first_equal(ids, at, rolling(mix(ids.astype(np.uint64) + np.uint64(1)), window)[at], window)
    number = c["start"][row] + within[at]
    same = (number == number[first]) & np.logical_and.reduce([c[k][row] == c[k][row[first]] for k in ("none", "doc", "tag")])
    gone = np.flatnonzero(~same)  # one place that came twice, from rows that repeat, is no repetition
    if not len(gone):
        return None
    a, b = stretches(at[gone])  # windows of two rows are never consecutive: a row ends with words that start none
    i, j = np.searchsorted(at, a), np.searchsorted(at, b)
    return [c[k][row[i]] for k in ("none", "doc", "tag")] + [number[i], number[j]]


def _ranges(window: int):
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress

        def out(none, doc, tag, first, last):
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=none.astype(bool)), pa.array(tag, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["doc_id", "tag", "first", "last"])

        held, now = [], None
        for batch in batches:
            for bucket, n, settled, data in zip(*[batch.column(k).to_pylist() for k in ("bucket", "n", "settled", "data")], strict=True):
                if bucket != now:
                    if held and (found := _repeats(held, window)):
                        yield out(*found)
                    held, now = [], bucket
                data = unpack(data)
                if settled:
                    doc, tag, first, last = (np.frombuffer(data, "<i8", n, n + 8 * n * k) for k in range(4))
                    yield out(np.frombuffer(data, "u1", n), doc, tag, first, last)
                else:
                    held.append((n, data))
        if held and (found := _repeats(held, window)):
            yield out(*found)

    return run


def _strike(window: int):
    """Texts without the words that windows in `gone` cover; from a repeated row (`again`) every window goes."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def strike(text: bytes, ranges, again: bool):
            n = removed = 0
            left = []
            for before, words in _segments(text, 0):
                n = before + len(words)
                gone = None
                if again:
                    gone = np.ones(len(words), dtype=bool)
                elif len(ranges[0]):
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edge, np.clip(ranges[0] - before, 0, len(words)), 1)
                    np.add.at(edge, np.clip(ranges[1] + window - before, 0, len(words)), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                if gone is not None and gone.any():
                    removed += int(gone.sum())
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                if words:
                    left.append(b" ".join(words))
            if again and n < window:
                return strike(text, (np.zeros(0, np.int64),) * 2, False)
            return n, removed, b" ".join(left)

        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE_BYTES):
                some = batch.slice(a, b - a)
                texts = some.column("text").cast(pa.binary()).to_pylist()
                gone = some.column("gone")
                ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(gone), 0).to_numpy())])
                flat = gone.flatten()
                first, last = (flat.field(k).to_numpy() for k in ("first", "last"))
                again = some.column("again").to_pylist()
                rows = [strike(t or b"", (first[p:q], last[p:q]), r) for t, p, q, r in zip(texts, ends, ends[1:], again, strict=False)]
                n, removed, left = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(left, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])

    return run


def repeated_ranges(docs: DataFrame, window: int = WINDOW, mer: int = MER, bucket_words: int = BUCKET_WORDS, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, tag, first, last: numbers of the first and last window of each stretch of windows that start earlier, too.  docs: doc_id (a long), tag (a long), text."""
    spark = docs.sparkSession
    parts = _base.shuffle_partitions(spark)
    share = min(frequent, 64 * parts)
    counted = docs.mapInArrow(_count(share, window, mer), "mer long, n long").groupBy("mer").agg(F.sum("n").alias("n"))
    counted = _base.cut(counted)
    total = counted.where("mer is null").select("n").first()
    words = total["n"] if total else 0
    # at most `share` of them, 8 bytes each
    hot = counted.where(F.col("mer").isNotNull() & (F.col("n") * share > words)).select("mer").toPandas()["mer"].to_numpy(dtype="int64").view("uint64")
    hot.sort()
    buckets = max(4 * parts, int(-(-SPREAD * words // bucket_words)))
    sent = docs.mapInArrow(_send(buckets, spark.sparkContext.broadcast(hot), window, mer), "bucket int, n int, settled boolean, data binary")
    dealt = sent.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_ranges(window), "doc_id long, tag long, first long, last long")


def remove_repeats(docs: DataFrame, window: int = WINDOW, mer: int = MER, bucket_words: int = BUCKET_WORDS, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, text (the words that stay, with one space between), n_words, n_removed.  docs: doc_id, text and any others."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    several = not rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    if several:  # rows get numbers, of which the least of equal rows names the first
        rows = _base.cut(rows.withColumn("tag", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id()))
    else:
        rows = rows.withColumn("tag", F.lit(0).cast("long"))
    found = repeated_ranges(rows.select("doc_id", "tag", "text"), window, mer, bucket_words, frequent)
    gone = found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "last")).alias("gone"))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.tag") == F.col(f"{b}.tag"))
    again = F.lit(False)
    joined = rows.alias("d").join(gone.alias("g"), same("d", "g"), "left")
    if several:
        lead = rows.groupBy("doc_id", "tag").agg(F.min("_row").alias("lead"))
        joined = joined.join(lead.alias("l"), same("d", "l"))
        again = F.col("d._row") != F.col("l.lead")
    out = joined.select("d.doc_id", "d.text", F.col("g.gone").alias("gone"), again.alias("again"))
    return out.mapInArrow(_strike(window), "doc_id long, text string, n_words long, n_removed long").withColumn("doc_id", F.col("doc_id").cast(kind))


def op13_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(_base.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
with words as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i
  from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents)),
sequences as (
  select doc_id, i, string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 19 following) as s,
         count(*) over (partition by doc_id order by i rows between current row and 19 following) as n
  from words),
ranked as (
  select doc_id, i, row_number() over (partition by s order by doc_id, i) as k from sequences where n = 20),
later as (select doc_id, i from ranked where k > 1),
judged as (
  select w.doc_id, w.i, w.word, l.i as back from words w asof left join later l on l.doc_id = w.doc_id and w.i >= l.i),
kept as (
  select doc_id, count(*) as n_words, count(*) filter (where back >= i - 19) as n_removed,
         coalesce(string_agg(word, ' ' order by i) filter (where back is null or back < i - 19), '') as text
  from judged group by doc_id)
select d.doc_id, coalesce(k.n_words, 0)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from documents d left join kept k using (doc_id)
"""
