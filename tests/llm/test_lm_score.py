import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import _attention, _base, lm_score
from quire.llm._attention import STRIDE, WINDOW, Attention
from quire.llm._tokens import encoder, vocabulary_path

SF = "/root/testdata/sf0.01"


def toy(n=50, seed=1):
    r = np.random.default_rng(seed)
    m = Attention(np.arange(n), r.permutation(_attention.GROUPS * _attention.SLOTS)[:n] // 3, n)
    m.bias[:] = r.normal(size=WINDOW)
    m.set_counts(r.integers(0, 9, n))
    return m


def text_scores(m, texts):
    lengths = [len(t) for t in texts]
    ends = np.cumsum(lengths)
    each = m.score(np.concatenate(texts), lengths)
    return np.array([each[e - n : e].sum() for e, n in zip(ends, lengths, strict=True)]) / math.log(10)


def plain_score(m, ids):
    """Position by position, as the definition says."""
    x, total = [m.start, *m.input_of[ids[:-1]]], 0.0
    for t in range(len(ids)):
        k = 0 if t < WINDOW else (t - WINDOW) // STRIDE + 1
        past = x[k * STRIDE : t + 1]
        a = np.array([float(m.query[x[t]].astype(float) @ m.key[j].astype(float) + m.bias[len(past) - 1 - i]) for i, j in enumerate(past)])
        a = np.exp(a - a.max())
        h = m.own[x[t]].astype(float) + (a / a.sum()) @ m.value[past].astype(float)
        group, slot = divmod(int(m.leaf_of[ids[t]]), _attention.SLOTS)
        for z, i in ((h @ m.to_group.astype(float) + m.group_offset, group), (h @ m.to_slot[group].astype(float) + m.slot_offset[group], slot)):
            total += z[i] - z.max() - np.log(np.exp(z - z.max()).sum())
        total += m.log_inside[ids[t]]
    return total / math.log(10)


@pytest.mark.parametrize("scale", [1, 400])
def test_each_id_is_scored_once_as_defined(scale):
    m, r = toy(), np.random.default_rng(2)
    m.query *= scale
    m.to_slot *= scale
    m.set_counts(np.ones(50))
    assert m.small == ((True, True) if scale == 1 else (False, False))
    texts = [r.integers(0, 50, n) for n in (1, 2, STRIDE, WINDOW - 1, WINDOW, WINDOW + 1, WINDOW + STRIDE, 333)]
    assert text_scores(m, texts) == pytest.approx([plain_score(m, t) for t in texts], rel=1e-4 if scale == 1 else 1e-3)
    assert text_scores(m, texts[-1:])[0] == pytest.approx(text_scores(m, texts)[-1], rel=1e-5)


def test_probabilities_sum_to_one():
    m, start = toy(), np.array([3, 7, 7, 1])
    m.leaf_of = np.repeat(np.arange(_attention.GROUPS * _attention.SLOTS), 2).astype(np.int32)  # two ids a leaf
    m.input_of = np.arange(len(m.leaf_of), dtype=np.int32) % 50
    m.set_counts(np.arange(len(m.leaf_of)))
    ends = np.array([m.score(np.append(start, i), [5])[-1] for i in range(0, len(m.leaf_of))])
    assert np.exp(ends).sum() == pytest.approx(1, rel=1e-4)


def test_fitting_learns():
    r = np.random.default_rng(4)
    texts = [np.tile([1, 2, 3, 4, 5], 12)[i % 5 :] for i in range(60)] + [np.tile([9, 3, 8, 4], 12) for _ in range(30)]
    m = Attention(np.arange(10), np.arange(10) * 41, 10)
    m.set_counts(np.ones(10))
    before = text_scores(m, texts).sum()
    m.fit(*m.positions(np.concatenate(texts), np.array([len(t) for t in texts])), rounds=12, batch=16)
    m.set_counts(np.ones(10))
    assert text_scores(m, texts).sum() > 0.3 * before
    assert text_scores(m, [np.tile([1, 2, 3, 4, 5], 12)])[0] > text_scores(m, [r.integers(1, 6, 60)])[0] + 10


def test_gradient_is_that_of_the_loss():
    m, r = toy(), np.random.default_rng(6)
    h, leaf = r.normal(size=(7, _attention.HIDDEN)), r.integers(0, _attention.GROUPS * _attention.SLOTS, 7)

    def loss(x):
        group, slot = leaf // _attention.SLOTS, leaf % _attention.SLOTS
        total = 0.0
        for i in range(7):
            for z, k in ((x[i] @ m.to_group.astype(float) + m.group_offset, group[i]), (x[i] @ m.to_slot[group[i]].astype(float) + m.slot_offset[group[i]], slot[i])):
                total += np.log(np.exp(z).sum()) - z[k]
        return total

    got = m._toward(h.astype(np.float32), leaf)
    for i, j in ((0, 0), (3, 5), (6, 23)):
        step = np.zeros_like(h)
        step[i, j] = 1e-5
        assert got[i, j] == pytest.approx((loss(h + step) - loss(h - step)) / 2e-5, rel=1e-3, abs=1e-4)


def plain_base(docs):
    split = {k: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for k, t in docs}
    train = [k for k, _ in docs if k is not None and zlib.crc32(str(k).encode()) % 10]
    count = Counter(w for k in train for w in [*split[k], None])
    n, v = sum(count.values()), len(count)
    return {k: (len(w) + 1, sum(count[x] > 0 for x in [*w, None]), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None])) for k, w in split.items()}


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_base(docs)
    rows = lm_score.op4_lm_scoring(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("common", [0, 3, 1000])
def test_hostile_rows(spark, common):
    docs = [(i, "A b c d e f a b " + "rare%d" % (i % 7)) for i in range(60)] + [(100, None), (101, ""), (None, "a B new"), (102, "word " * 60_000), (103, "É é x <|endoftext|>")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as base")
    want = plain_base(docs)
    rows = lm_score.score(df, common=common, share=2, shard_windows=20, rounds=1).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0 and math.isfinite(r["score"])
    assert lm_score.score(df.limit(0), rounds=1).count() == 0
    held = lm_score.score(df.where("doc_id is null"), rounds=1).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in held] == [(0, 0, 0.0)]


def encoded(texts):
    e = encoder(vocabulary_path())
    return [np.append(np.array(e.library.encode(t, add_special_tokens=False).ids, dtype=np.int64), e.end_id) for t in texts]


def test_leaves_and_pairs_come_from_all_rows(spark):
    """Whatever the windows are: a word of rows that they can't hold has a place and a leaf, and what follows it is known."""
    texts = ["one two three four"] * 30 + ["seven of nine"] * 30
    ids, e = encoded(texts), encoder(vocabulary_path())
    by_id = np.bincount(np.concatenate(ids), minlength=e.library.get_vocab_size()).astype(float)
    place, column = _attention.pair_places(by_id, lm_score.word_ends(e.library))
    want = np.zeros((_attention.INPUTS, _attention.RANKED + 2), dtype=np.int64)
    for t in ids:
        np.add.at(want, (np.append(_attention.INPUTS - 1, place[t[:-1]]), column[t]), 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("doc_id", F.lit(1)).repartition(3)  # 1 is a training row
    stored = lm_score.store(docs, vocabulary_path(), _base.new_folder(spark, "t"))
    assert (lm_score.pair_counts(stored, place, column) == want).all()
    assert lm_score.id_counts(stored, len(by_id))[1].tolist() == by_id.tolist()
    model = lm_score.fit(stored, vocabulary_path(), by_id, share=1000, rounds=1)
    model.set_counts(by_id)
    assert set(np.concatenate([ids[0], ids[-1]])) <= set(np.flatnonzero(model.input_of > 1))
    assert text_scores(model, [ids[0], ids[-1]]).min() > -7


def plain_anchors(ids, rate):
    """Of one text: (position, ids before, ids of the segment)."""
    out, free, most = [], 0, 2**64
    for t in range(lm_score.CONTEXT, len(ids)):
        h = 0
        for i in ids[t - lm_score.CONTEXT : t].tolist():
            h = (h * 0x9E3779B97F4A7C15 + i + 1) % most
        for _ in range(2):
            h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % most
        if (t == lm_score.CONTEXT or (h ^ h >> 32) % rate == 0) and t >= free:
            free = min(t + lm_score.SEGMENT, len(ids))
            out.append((t, tuple(ids[t - lm_score.CONTEXT : t]), tuple(ids[t:free])))
    return out


def test_memory_equals_brute_force(spark):
    r = np.random.default_rng(8)
    shared = r.integers(0, 30, 60)
    texts = [np.concatenate([r.integers(0, 9, r.integers(0, 50)), shared[: r.integers(0, 60)], r.integers(0, 3, r.integers(0, 90))]) for _ in range(40)]
    texts += [texts[3]] * 3 + [np.zeros(0, np.int64), np.tile([1, 2], 80)]
    train = [i % 7 != 0 for i in range(len(texts))]
    rows = [plain_anchors(t, 3) for t in texts]
    flat, lengths = np.concatenate(texts).astype("<u2"), np.array([len(t) for t in texts])
    at, last, before, segment = lm_score.anchors(flat, lengths, 3)
    begins = np.cumsum(lengths) - lengths
    assert [(int(begins[i]) + t, int(begins[i]) + t + len(s)) for i, row in enumerate(rows) for t, _, s in row] == list(zip(at.tolist(), last.tolist(), strict=True))
    of = np.searchsorted(np.cumsum(lengths), at, side="right")
    log_p = -r.random(len(at)) * 20
    own_before, own_segment = lm_score._times(of, before), lm_score._times(of, before ^ segment)
    marks = spark.createDataFrame([(int(of[i]), int(before[i]), int(segment[i]), float(log_p[i]), int(own_before[i]), int(own_segment[i]), int(train[of[i]])) for i in range(len(at))], "nth long, before long, segment long, log_p double, own_before long, own_segment long, train long")
    got = {x["nth"]: x["more"] for x in lm_score.remembered(marks).collect()}
    cases = []
    for i, row in enumerate(rows):
        for _, c, s in row:
            others = [(c2, s2) for j, row2 in enumerate(rows) if j != i and train[j] for _, c2, s2 in row2 if c2 == c]
            cases.append((i, len(others), sum(s2 == s for _, s2 in others)))
    share = np.mean([n / c for i, c, n in cases if c and train[i]])
    k = 1 / share - 1
    want = {}
    for (i, c, n), p in zip(cases, log_p, strict=True):
        if c:
            want[i] = want.get(i, 0) + (math.log10((n + k * math.exp(p)) / (c + k)) - p / math.log(10))
    assert len(want) > 5 and got == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_texts_that_occur_twice_stand_out(spark):
    """Each text twice in the corpus scores better than texts like it that are there once, in training rows and held-out ones."""
    r = np.random.default_rng(9)
    known = [b.decode() for b in {bytes(r.integers(97, 123, r.integers(2, 7)).astype("u1")) for _ in range(300)}]
    text = lambda: " ".join(r.choice(known, 300))
    twice = [text() for _ in range(15)]
    docs = [(i, text()) for i in range(150)] + [(1000 + i, t) for i, t in enumerate(twice * 2)]
    rows = lm_score.score(spark.createDataFrame(docs, "doc_id long, text string"), rounds=1).collect()
    gain = {x["doc_id"]: (x["score"] - x["base_score"]) / x["n_tokens"] for x in rows}
    in_train = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    once = [gain[i] for i in range(150)]
    # the other copy must be a training row for the memory to have it
    doubled = [gain[1000 + i] for i in range(30) if in_train(1000 + (i + 15) % 30)]
    assert min(doubled) > max(once)


def test_layout_has_no_part_in_scores(spark):
    """Scores of one table in 1, 12 and 40 parts, in another order of rows; shards are several."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = []
    for parts in (1, 12, 40):
        rows = lm_score.score(docs.repartition(parts, F.xxhash64("doc_id", F.lit(parts))), share=2, shard_windows=300).collect()
        found.append({r["doc_id"]: (r["score"], r["base_score"], r["n_known"]) for r in rows})
    assert found[0].keys() == found[1].keys() == found[2].keys()
    for other in found[1:]:
        for k, (score, base, known) in found[0].items():
            assert other[k] == (pytest.approx(score, rel=1e-3), pytest.approx(base, rel=1e-9), known)


def test_short_copies_and_rows_that_repeat(spark):
    """Texts of a few words that are there twice stand out; rows that repeat are scored one by one, alike."""
    r = np.random.default_rng(4)
    words = [f"word{i}" for i in range(400)]
    texts = [" ".join(r.choice(words, 15)) for _ in range(300)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i]) for i in range(40)] + [(5, texts[5])] * 3 + [(None, None)] * 2
    rows = lm_score.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), share=1).collect()
    assert len(rows) == len(docs)
    by = {}
    for x in rows:
        by.setdefault(x["doc_id"], []).append(x["score"])
    assert len(by[5]) == 4 and len({round(x, 6) for x in by[5]}) == 1 and len(set(by[None])) == 1
    single = sorted(by[i][0] for i in range(40, 300))
    # the corpus remembers training rows, so a text whose copy is one
    above = [by[i][0] > single[int(0.95 * len(single))] for i in range(40) if i != 5 and zlib.crc32(str(1000 + i).encode()) % 10]
    assert sum(above) > 0.9 * len(above)


def test_row_groups_hold_few_blocks(spark, tmp_path):
    """However many blocks a task writes: a row group is held in memory, when it is written and when it is read."""
    import pyarrow.parquet as pq

    r = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(map(str, r.integers(0, 10**9, 300)))) for i in range(600)], "doc_id long, text string").coalesce(1)
    stored = lm_score.store(docs, vocabulary_path(), str(tmp_path / "b"), block_bytes=50_000, group_bytes=300_000)
    (file,) = (tmp_path / "b").glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert meta.num_rows == stored.count() > 30 and meta.num_row_groups >= 4
    assert max(meta.row_group(k).num_rows for k in range(meta.num_row_groups)) <= 10
    assert stored.select(F.sum(F.size("doc_id"))).first()[0] == 600


def test_attention_is_fitted_on_every_window(spark):
    """Short texts of their own words: by default, whatever stands in any of them has had its vectors fitted."""
    texts = [f"{chr(97 + i % 26) * 3}{i * 7919} {i * 104729}" for i in range(60) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("doc_id", F.lit(1)).repartition(3)  # 1 is a training row
    stored = lm_score.store(docs, vocabulary_path(), _base.new_folder(spark, "t"))
    by_id = lm_score.id_counts(stored, encoder(vocabulary_path()).library.get_vocab_size())[1]
    model = lm_score.fit(stored, vocabulary_path(), by_id)
    fresh = Attention(model.input_of, model.leaf_of, model.start)
    before = np.unique(np.concatenate([model.input_of[t[:-1]] for t in encoded(texts)]))
    assert len(before) > 20 and (model.value[before] != fresh.value[before]).any(axis=1).all()


def test_windows_travel_as_their_ids():
    """Places, leaves and counted positions of windows that were packed, window by window as the definition says."""
    m, r = toy(), np.random.default_rng(12)
    lengths = np.array([1, 2, STRIDE, WINDOW - 1, WINDOW, WINDOW + 1, WINDOW + STRIDE, WINDOW + STRIDE + 1, 4000])
    ids = r.integers(0, 50, lengths.sum()).astype("<u2")
    want = []
    for t in np.split(ids, np.cumsum(lengths)[:-1]):
        for b in range(0, max(1, len(t) - WINDOW + STRIDE), STRIDE):
            at = [min(b + i, len(t) - 1) for i in range(WINDOW)]
            want.append(([m.input_of[t[i - 1]] if i else m.start for i in at], m.leaf_of[t[at]].tolist(), [b + i < len(t) and (not b or i >= WINDOW - STRIDE) for i in range(WINDOW)]))
    some = r.permutation(len(want))
    cuts = [0, 3, 4, len(want)]
    rows = list(lm_score.packed(*_attention.window_ids(ids, lengths, some), cuts))
    assert rows[1][0] == 0 < rows[2][0] and len(rows[2][1]) < 100 * (len(want) - 4)
    each = [lm_score.unpacked(data, size, b - a) for (size, data), a, b in zip(rows, cuts, cuts[1:], strict=False)]
    for got in (m.positions_of(*(np.concatenate(v) for v in zip(*each, strict=True))), [v[some] for v in m.positions(ids, lengths)]):
        assert [tuple(row.tolist() for row in rows) for rows in zip(*got, strict=True)] == [tuple(map(list, want[i])) for i in some]


def test_fit_ships_windows_small_and_a_sum_of_each_task(spark):
    """Bytes that the fit shuffles, by window and by table of the model: shards that meet in a task are summed there."""
    r = np.random.default_rng(13)
    known = sorted(b.decode() for b in {bytes(r.integers(97, 123, r.integers(2, 7)).astype("u1")) for _ in range(300)})
    docs = spark.createDataFrame([(1, " ".join(r.choice(known, 2000))) for _ in range(20)], "doc_id long, text string").coalesce(1)  # 1 is a training row
    stored = lm_score.store(docs, vocabulary_path(), _base.new_folder(spark, "t"))
    by_id = lm_score.id_counts(stored, encoder(vocabulary_path()).library.get_vocab_size())[1]
    windows, java = lm_score.window_count(stored), spark.sparkContext._jvm.java.util

    def moved():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(java.ArrayList(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), java.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    def fitted(shard_windows):
        before = moved()
        lm_score.fit(stored, vocabulary_path(), by_id, shard_windows=shard_windows)
        return moved() - before

    few, many = fitted(windows), fitted(20)
    assert windows > 1000 and few < many < 3_000_000  # 22 MB when each shard's tables went to be summed


def plain_fit(m, x_all, y_all, counted, batch, rate=0.01):
    """One round as the definition says, position by position, in 64 bits; returns the tables by name."""
    tables = {n: getattr(m, n).astype(float) for n in m.NAMES}
    first, second = ({n: np.zeros_like(t) for n, t in tables.items()} for _ in range(2))
    to_group, to_slot = m.to_group.astype(float), m.to_slot.astype(float)
    each, r = -(-len(x_all) // batch), np.random.default_rng(3)
    for step, some in enumerate(np.array_split(r.permutation(len(x_all)), each), 1):
        own, query, key, value, bias = (tables[n] for n in m.NAMES)
        g, met = {n: np.zeros_like(t) for n, t in tables.items()}, np.unique(x_all[some])
        for w in some:
            x = x_all[w]
            for t in np.flatnonzero(counted[w]):
                past = x[: t + 1]
                z = key[past] @ query[x[t]] + bias[t - np.arange(t + 1)]
                a = np.exp(z - z.max())
                a /= a.sum()
                mixed, (group, slot) = a @ value[past], divmod(int(y_all[w, t]), _attention.SLOTS)
                h, dh = own[x[t]] + mixed, 0
                for to, offset, at in ((to_group, m.group_offset, group), (to_slot[group], m.slot_offset[group], slot)):
                    p = h @ to + offset
                    p = np.exp(p - p.max())
                    p /= p.sum()
                    p[at] -= 1
                    dh = dh + to @ p
                dh = dh / counted[some].sum()
                dz = a * (value[past] @ dh - mixed @ dh)
                g["own"][x[t]] += dh
                g["query"][x[t]] += dz @ key[past]
                np.add.at(g["value"], past, a[:, None] * dh)
                np.add.at(g["key"], past, dz[:, None] * query[x[t]])
                np.add.at(g["bias"], t - np.arange(t + 1), dz)
        for n, t in tables.items():
            at = met if n != "bias" else np.arange(WINDOW)
            first[n][at] = 0.9 * first[n][at] + 0.1 * g[n][at]
            second[n][at] = 0.99 * second[n][at] + 0.01 * g[n][at] ** 2
            t[at] -= rate * min(1.0, 4 * (1 - step / (each + 1))) * (first[n][at] / (1 - 0.9**step)) / (np.sqrt(second[n][at] / (1 - 0.99**step)) + 1e-8)
    return tables


@pytest.mark.parametrize("shift", [0, 100])
def test_fit_equals_a_plain_one(shift):
    """Whole windows and later ones, texts of one id, ids that are there a hundred times; numbers that exp can't take as they are."""
    m, r = toy(), np.random.default_rng(14)
    m.bias += shift  # no part in what is right
    m.group_offset += shift
    m.slot_offset -= shift
    lengths = np.array([1, 3, WINDOW, WINDOW + 1, 3 * WINDOW, 2 * STRIDE])
    ids = np.minimum(r.integers(0, 50, lengths.sum()), r.integers(0, 50, lengths.sum()))
    x, y, counted = m.positions(ids, lengths)
    want = plain_fit(m, x, y, counted, 4)
    met = m.fit(x, y, counted, rounds=1, batch=4)
    assert met.tolist() == np.bincount(x.ravel(), minlength=len(m.own)).tolist()
    for name in m.NAMES:
        got = getattr(m, name)
        off = np.abs(got - want[name]) > 1e-4 + 1e-3 * np.abs(want[name])
        assert off.mean() < 0.01, name  # where a gradient is next to nothing, 32 bits may give it the other sign


def test_rows_that_no_position_needs_are_not_computed(monkeypatch):
    """exp is taken of what the positions that count look at: rows of attention from the first of them on, a row of groups and of slots."""
    m, taken = toy(), []

    class Counting:
        def __getattr__(self, name):
            return getattr(np, name)

        def exp(self, z, **how):
            taken.append(z.size)
            return np.exp(z, **how)

    x, y, counted = m.positions(np.arange(8 + STRIDE * 33) % 50, np.array([8 + STRIDE * 33]))
    monkeypatch.setattr(_attention, "np", Counting())
    m.fit(x, y, counted, rounds=1)
    windows = len(x)
    assert windows == 33 and counted.sum() == 8 + STRIDE * windows
    assert sum(taken) == WINDOW * (8 + STRIDE * windows) + (_attention.GROUPS + _attention.SLOTS) * (8 + STRIDE * windows)
