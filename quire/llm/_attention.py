"""A small causal self-attention model over subword ids, in numpy: fitting and scoring.

The softmax over ids has two levels: a group, then a place in it.  Groups hold ids that keep like company; the commonest ids have a leaf each, all
others share two leaves by their counts in the whole corpus.  A position's
hidden vector is its id's own vector plus an attention over the positions up to it in the window: queries, keys and
values are looked up by id, distances have a learned bias.  Long texts are scored in overlapping windows, of which each
scores the positions that no window before it has, so every id is scored once and, past the first window, with
`WINDOW - STRIDE` ids or more of context.
"""

from __future__ import annotations

import math

import numpy as np

WINDOW, STRIDE = 48, 40
#: Fixed value: what marks a window with an id before it; any number above WINDOW.
MORE = 128
GROUPS, SLOTS, INPUTS = 64, 40, 4096
#: Ids with a leaf of their own; two more leaves are all others', by whether they end a word.
RANKED = GROUPS * SLOTS - 2
#: Commonest ids whose company tells groups apart.
MARKS = 250
KEY, HIDDEN = 8, 24
#: Windows that are scored at a time, positions whose groups are looked at as a window is fitted, so that they stay in a core's own cache, and positions whose slots are scored.
BLOCK, CHUNK, OUTPUTS = 64, 640, 20_000
#: Times up to which rows with the same number are added up turn by turn.
TURNS = 6


def windows(lengths):
    """For texts of so many positions, one after another: first position, end of the text, positions to skip and text of each window."""
    lengths = np.asarray(lengths, dtype=np.int64)
    each = np.maximum(1, -(-(lengths - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(lengths)), each)
    k = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    begins = np.cumsum(lengths) - lengths
    return begins[text] + k * STRIDE, (begins + lengths)[text], np.where(k > 0, WINDOW - STRIDE, 0), text


def window_ids(ids, lengths, some=slice(None)):
    """Of texts one after another, in some of their windows: by window its positions, and MORE besides if its first id is that before it; and the ids, window after window."""
    begin, end, skip, _ = (x[some] for x in windows(lengths))
    more, n = skip > 0, np.minimum(WINDOW, end - begin)
    each = n + more
    at = np.repeat(begin - more - np.cumsum(each) + each, each)
    at += np.arange(len(at))
    return (n + MORE * more).astype(np.uint8), ids.take(at)


def ranking(count):
    return np.argsort(-count, kind="stable")


def pair_places(count, ends_word):
    """By id, its place in the tables and its column among the ids that follow: the commonest have their own, others share two."""
    order = ranking(count)
    place, column = np.where(ends_word, 1, 0), RANKED + np.where(ends_word, 1, 0)
    top = order[: INPUTS - 3]
    top = top[count[top] > 1]
    place[top] = np.arange(len(top)) + 2
    column[order[:RANKED]] = np.arange(min(RANKED, len(order)))
    return place, column


def leaves_of(pairs):
    """A leaf for each column of pairs (places by columns): groups of equal size by company, by halving along the widest direction."""
    marks = np.arange(MARKS)
    before = pairs[marks + 2].T
    after = np.concatenate([pairs[2 : RANKED + 2][:, marks], pairs[:2][:, marks]])
    table = np.concatenate([before, (pairs.sum(axis=0) - before.sum(axis=1))[:, None], after], axis=1).astype(np.float64)
    table = np.sqrt(table / table.sum(axis=1, keepdims=True).clip(1)).astype(np.float32)
    parts = [np.arange(len(table))]
    while len(parts) < GROUPS:
        halves = []
        for own in parts:
            x = table[own] - table[own].mean(axis=0)
            along = np.ones(x.shape[1], np.float32)
            for _ in range(20):
                along = x.T @ (x @ along)
                along /= max(1e-9, float(np.linalg.norm(along)))
            order = own[np.argsort(x @ along, kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        parts = halves
    out = np.empty(len(table), dtype=np.int64)
    out[np.concatenate(parts)] = np.arange(len(table))
    return out


def _exp(z, least=None) -> None:
    """exp(z) in place, each row but for a factor of its own; least: of each row a number that its largest isn't below, or none.

    The largest is taken off only where numbers are too great or small for exp in 32 bits to do without.
    """
    if z.max(initial=0) > 40 or (z if least is None else least).min(initial=0) < -40:
        z -= z.max(axis=-1, keepdims=True)
    np.exp(z, out=z)


def _with_ones(x):
    """x with a column of ones: it adds up rows, or takes an offset, in the same product."""
    out = np.empty((*x.shape[:-1], x.shape[-1] + 1), np.float32)
    out[..., :-1], out[..., -1] = x, 1
    return out


def _sums(d, index):
    """Distinct numbers of index, and the sum of d's rows for each.  Most numbers are there a few times: those are added up turn by turn, all at once."""
    order = np.argsort(index.astype(np.uint16), kind="stable")
    index = index.take(order)
    starts = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    each = np.diff(starts, append=len(index))
    by = np.argsort(-each, kind="stable")
    starts, each = starts.take(by), each.take(by)
    out = d.take(order.take(starts), 0)
    for k in range(1, TURNS):
        n = int(np.searchsorted(-each, -k))
        if not n:
            break
        out[:n] += d.take(order.take(starts[:n] + k), 0)
    if n := int(np.searchsorted(-each, -TURNS)):
        rest = each[:n] - TURNS
        cuts = np.cumsum(rest) - rest
        at = np.repeat(starts[:n] + TURNS - cuts, rest)
        at += np.arange(len(at))
        # two columns at a time, as one of complex numbers
        out[:n] += np.add.reduceat(d.take(order.take(at), 0).view(np.complex64), cuts, axis=0).view(np.float32)
    return index.take(starts), out


class Attention:
    #: Tables that attention is fitted on, of which all but the last have a row for each place.
    NAMES = ("own", "query", "key", "value", "bias")

    def __init__(self, input_of, leaf_of, start: int, seed: int = 5):
        """input_of, leaf_of: by id, its place in the tables and its leaf; start: the place of the start."""
        r = np.random.default_rng(seed)
        self.input_of, self.leaf_of, self.start = np.asarray(input_of, np.int32), np.asarray(leaf_of, np.int32), start
        n = int(max(self.input_of.max(), start)) + 1
        new = lambda *shape, scale: (r.normal(size=shape) * scale).astype(np.float32)
        self.own, self.query, self.key = new(n, HIDDEN, scale=0.3), new(n, KEY, scale=0.3), new(n, KEY, scale=0.3)
        self.value, self.bias = new(n, HIDDEN, scale=0.1), np.zeros(WINDOW, np.float32)
        self.to_group, self.group_offset = new(HIDDEN, GROUPS, scale=0.2), np.zeros(GROUPS, np.float32)
        self.to_slot, self.slot_offset = new(GROUPS, HIDDEN, SLOTS, scale=0.2), np.zeros((GROUPS, SLOTS), np.float32)
        self.log_inside = np.zeros(len(self.input_of))
        self.small, self.summed = (False, False), None

    def _summed(self):
        """Values, with a column of ones."""
        return np.concatenate([self.value, np.ones((len(self.value), 1), np.float32)], axis=1)

    def set_counts(self, count) -> None:
        """Counts of ids over the corpus: how the ids of a leaf share its probability.  Scoring may follow."""
        mass = np.asarray(count, dtype=np.float64) + 0.1
        self.log_inside = np.log(mass / np.bincount(self.leaf_of, weights=mass, minlength=GROUPS * SLOTS)[self.leaf_of])
        # whether the tables are too small for exp to overflow, so that scoring needn't take off the largest: in attention, in outputs
        norm = lambda x: float(np.linalg.norm(x, axis=1).max())
        attention = norm(self.query) * norm(self.key) + float(np.abs(self.bias).max())
        self.small, self.summed = (attention < 80, self._most_output() < 80), self._summed()  # exp(80) times a window or a group fits in 32 bits

    def _most_output(self) -> float:
        """A bound of outputs' absolute values; attention mixes values, so it stays between their extremes."""
        high = low = 0.0
        for to, offset in [(self.to_group, self.group_offset), *zip(self.to_slot, self.slot_offset, strict=True)]:
            own, mixed = self.own @ to, self.value @ to
            high = max(high, float((own.max(axis=0) + mixed.max(axis=0) + offset).max()))
            low = min(low, float((own.min(axis=0) + mixed.min(axis=0) + offset).min()))
        return max(high, -low)

    def _bias(self):
        """By position and earlier position; later ones are out of reach."""
        i = np.arange(WINDOW)
        gap = i[:, None] - i[None, :]
        return np.where(gap >= 0, self.bias[np.maximum(gap, 0)], np.float32(-1e4))

    def hidden(self, x, bias=None, first: int = 0):
        """Hidden vectors, with a last column of ones, of windows x (places in the tables) from their position `first` on, and their attention before it is brought to sum 1."""
        asks = x[:, first:]
        a = np.matmul(self.query.take(asks, 0), self.key.take(x, 0).transpose(0, 2, 1))
        a += (self._bias() if bias is None else bias)[first:]
        if not self.small[0]:
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        summed = self._summed() if self.summed is None else self.summed
        h = np.matmul(a, summed.take(x, 0))  # the last column adds up a
        h /= h[..., -1:].copy()
        h[..., :-1] += self.own.take(asks, 0)
        return h, a

    def set_pairs(self, counts, rounds: int = 40, rate: float = 0.05, prior: float = 8.0) -> None:
        """Sets own vectors and outputs by how often each leaf follows each place: all of what the last id tells."""
        counts = np.asarray(counts, dtype=np.float32).reshape(len(counts), GROUPS, SLOTS)
        of_group = counts.sum(axis=2)
        share, mass = of_group.sum(axis=0) + 1.0, of_group.sum(axis=1)
        share /= share.sum()
        inside = counts.sum(axis=0) + 0.1
        inside /= inside.sum(axis=1, keepdims=True)
        self.group_offset, self.slot_offset = np.log(share).astype(np.float32), np.log(inside).astype(np.float32)
        weight = (mass / max(1.0, mass.sum())).astype(np.float32)
        names = ("own", "to_group", "group_offset", "to_slot", "slot_offset")
        moments = {n: [np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))] for n in names}
        some_places, r, step = np.flatnonzero(mass > 0), np.random.default_rng(7), 0
        size = 512
        steps = rounds * -(-len(some_places) // size)
        for _ in range(rounds):
            for some in np.array_split(r.permutation(some_places), -(-len(some_places) // size)):
                step += 1
                h, w = self.own[some], weight[some][:, None] * (len(some_places) / len(some))
                goal = (of_group[some] + prior * share) / (mass[some] + prior)[:, None]
                p = h @ self.to_group + self.group_offset
                p -= p.max(axis=1, keepdims=True)
                np.exp(p, out=p)
                p /= p.sum(axis=1, keepdims=True)
                p -= goal
                q = np.matmul(h, self.to_slot)  # group, place, slot
                q += self.slot_offset[:, None, :]
                q -= q.max(axis=2, keepdims=True)
                np.exp(q, out=q)
                q /= q.sum(axis=2, keepdims=True)
                q *= of_group[some].T[..., None] + prior
                q -= counts[some].transpose(1, 0, 2) + prior * inside[:, None, :]
                q /= (mass[some] + prior * GROUPS)[None, :, None]  # as much as its group is of all that follows
                g = {"own": p @ self.to_group.T + np.matmul(q, self.to_slot.transpose(0, 2, 1)).sum(axis=0)}
                p *= w
                q *= w
                g |= {"to_group": h.T @ p, "group_offset": p.sum(axis=0), "to_slot": np.matmul(h.T, q), "slot_offset": q.sum(axis=1)}
                now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
                for name in names:
                    at = some if name == "own" else slice(None)
                    m, s = moments[name]
                    m[at] = 0.9 * m[at] + 0.1 * g[name]
                    s[at] = 0.99 * s[at] + 0.01 * g[name] ** 2
                    getattr(self, name)[at] -= now * (m[at] / (1 - 0.9**step)) / (np.sqrt(s[at] / (1 - 0.99**step)) + 1e-8)
        scale = np.sqrt((weight[:, None] * self.own[: len(weight)] ** 2).sum(axis=0)).clip(1e-6) / 0.3  # as small as values are at first, so that those learn as fast
        self.own /= scale
        self.to_group *= scale[:, None]
        self.to_slot *= scale[None, :, None]

    def _outputs(self):
        """Outputs as products take them, offsets in the last row: of groups and of slots; then, with ones in the last column, back; and by leaf its own vector."""
        forth = np.concatenate([self.to_group, self.group_offset[None]]), np.concatenate([self.to_slot, self.slot_offset[:, None]], axis=1)
        back = _with_ones(self.to_group.T), _with_ones(self.to_slot.transpose(0, 2, 1))
        return *forth, *back, (back[1] + back[0][:, None])[..., :-1].reshape(-1, HIDDEN)

    def _toward(self, h, leaf, outputs=None):
        """By position: the gradient of -log p(leaf) in its hidden vector."""
        to_group, to_slot, from_group, from_slot, own = self._outputs() if outputs is None else outputs
        group = (leaf // SLOTS).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        h, ends = _with_ones(h.take(order, 0)), np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()
        back, mean = np.empty_like(h), np.empty((len(h), HIDDEN), np.float32)
        for a in range(0, len(h), CHUNK):
            p = h[a : a + CHUNK] @ to_group
            _exp(p)
            np.dot(p, from_group, out=back[a : a + CHUNK])
        np.divide(back[:, :-1], back[:, -1:], out=mean)
        q, spans, done = np.empty((len(h), SLOTS), np.float32), [], 0
        for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            if a < b:
                np.dot(h[a:b], to_slot[k], out=q[a:b])
                spans.append((k, a, b))
            if b - done >= CHUNK or k + 1 == GROUPS:
                _exp(q[done:b])
                for i, a, c in spans:
                    np.dot(q[a:c], from_slot[i], out=back[a:c])
                spans, done = [], b
        mean += back[:, :-1] / back[:, -1:]
        mean -= own.take(leaf.take(order), 0)
        out = np.empty_like(mean)
        out[order] = mean
        return out

    def positions(self, ids, lengths):
        """Of the windows of texts one after another: places of the positions, leaves that follow, and which of them count."""
        return self.positions_of(*window_ids(np.asarray(ids), lengths))

    def positions_of(self, sizes, ids):
        """As positions(), of windows as window_ids() has them."""
        more, n = sizes >= MORE, (sizes % MORE).astype(np.int64)
        first, span = np.cumsum(n + more) - n, np.arange(WINDOW)
        at = np.minimum(span, n[:, None] - 1)
        counts = (span < n[:, None]) & (span >= np.where(more, WINDOW - STRIDE, 0)[:, None])
        at += first[:, None]
        y = self.leaf_of.take(ids.take(at))
        at -= 1
        x = self.input_of.take(ids.take(at, mode="clip"))
        x[(at < first[:, None]) & ~more[:, None]] = self.start
        return [x, y, counts]

    def fit(self, x_all, y_all, counted, rounds: int = 3, batch: int = 64, rate: float = 0.01):
        """Fits NAMES to windows, as positions() has them; gives how often each place was met."""
        self.small, self.summed = (False, False), None
        gap = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
        back_in = gap >= 0
        # all but the bias lie side by side, so that a place's vectors are read, summed and written at once
        cuts = np.cumsum([0, HIDDEN, KEY, KEY, HIDDEN]).tolist()
        own, query, key, value = (slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False))
        table, outputs = np.concatenate([getattr(self, n) for n in self.NAMES[:-1]], axis=1), self._outputs()
        moments = [np.zeros_like(t) for t in (table, table, self.bias, self.bias)]
        r, step = np.random.default_rng(3), 0
        each = -(-len(x_all) // batch)
        for _ in range(rounds):
            for some in np.array_split(r.permutation(len(x_all)), each):
                step += 1
                # windows that count whole come last: of the others no row is needed before the first that counts
                some = some.take(np.argsort(counted.take(some, 0)[:, 0], kind="stable"))
                x, at = x_all.take(some, 0), np.flatnonzero(counted.take(some, 0))
                whole = len(some) - int(counted.take(some, 0)[:, 0].sum())
                t, bias, parts = table.take(x, 0), self._bias(), []
                h, dh = np.empty((*x.shape, HIDDEN), np.float32), np.zeros((*x.shape, HIDDEN), np.float32)
                for part, first in ((slice(0, whole), WINDOW - STRIDE), (slice(whole, len(some)), 0)):
                    if part.start < part.stop:
                        v = _with_ones(t[part, :, value])
                        e = np.matmul(t[part, first:, query], t[part, :, key].transpose(0, 2, 1))
                        e += bias[first:]
                        _exp(e, e[:, np.arange(WINDOW - first), np.arange(first, WINDOW)])
                        mixed = np.matmul(e, v)  # the last column adds up e
                        total = mixed[..., -1:].copy()
                        mixed /= total
                        np.add(mixed[..., :-1], t[part, first:, own], out=h[part, first:])
                        parts.append((part, first, v, e, mixed, total))
                toward = self._toward(h.reshape(-1, HIDDEN).take(at, 0), y_all.take(some, 0).ravel().take(at), outputs)
                toward *= np.float32(1 / max(1, len(at)))
                dh.reshape(-1, HIDDEN)[at] = toward
                d, of_gap = np.empty(t.shape, np.float32), np.zeros((WINDOW, WINDOW), np.float32)
                d[..., own] = dh
                for part, first, v, e, mixed, total in parts:
                    # e isn't brought to sum 1, so what comes back is; its last column takes off the mean
                    g = np.empty_like(mixed)
                    g[..., :-1] = dh[part, first:]
                    g[..., -1] = -np.einsum("bij,bij->bi", mixed[..., :-1], g[..., :-1])
                    g /= total
                    ds = np.matmul(g, v.transpose(0, 2, 1))
                    ds *= e
                    d[part, :, value] = np.matmul(e.transpose(0, 2, 1), g[..., :-1])
                    d[part, :first, query] = 0
                    d[part, first:, query] = np.matmul(ds, t[part, :, key])
                    d[part, :, key] = np.matmul(ds.transpose(0, 2, 1), t[part, first:, query])
                    of_gap[first:] += ds.sum(axis=0)
                of_bias = np.bincount(gap[back_in], weights=of_gap[back_in], minlength=WINDOW).astype(np.float32)
                rows, of_table = _sums(d.reshape(-1, d.shape[-1]), x.ravel())
                now = rate * min(1.0, 4 * (1 - step / (rounds * each + 1)))
                scale = math.sqrt(1 - 0.99**step)
                for to, g, m, s, at in ((table, of_table, *moments[:2], rows), (self.bias, of_bias, *moments[2:], np.arange(WINDOW))):
                    first, second = m.take(at, 0), s.take(at, 0)
                    first *= np.float32(0.9)
                    first += np.float32(0.1) * g
                    second *= np.float32(0.99)
                    g *= g
                    g *= np.float32(0.01)
                    second += g
                    m[at], s[at] = first, second
                    np.sqrt(second, out=g)
                    g += np.float32(1e-8 * scale)
                    np.divide(first, g, out=g)
                    g *= np.float32(now * scale / (1 - 0.9**step))
                    to[at] -= g
        for name, part in zip(self.NAMES, (own, query, key, value), strict=False):
            setattr(self, name, np.ascontiguousarray(table[:, part]))
        return np.bincount(x_all.ravel(), minlength=len(self.own))

    def _groups(self, h, group, to_group):
        """Log probability of each position's group."""
        own, ones = np.empty(len(h), np.float32), np.ones(GROUPS, np.float32)
        for a in range(0, len(h), CHUNK):
            p = h[a : a + CHUNK] @ to_group
            if not self.small[1]:
                p -= p.max(axis=1, keepdims=True)
            part = p.ravel().take(np.arange(0, p.size, GROUPS) + group[a : a + CHUNK])
            np.exp(p, out=p)
            own[a : a + CHUNK] = part - np.log(p @ ones)
        return own

    def _slots(self, h, group, slot, to_slot):
        """Log probability of each position's slot in its group."""
        order = np.argsort(group, kind="stable")
        h, own, total = h.take(order, 0), np.empty(len(order), np.float32), np.empty(len(order), np.float32)
        ends, ones, at = np.cumsum(np.bincount(group, minlength=GROUPS)).tolist(), np.ones(SLOTS, np.float32), np.arange(0, SLOTS * len(order), SLOTS)
        at += slot.take(order)
        for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            if a < b:
                q = np.dot(h[a:b], to_slot[k])
                if not self.small[1]:
                    q -= q.max(axis=1, keepdims=True)
                q.ravel().take(at[a:b] - SLOTS * a, out=own[a:b], mode="clip")
                np.exp(q, out=q)
                np.dot(q, ones, out=total[a:b])
        own -= np.log(total, out=total)
        out = np.empty_like(own)
        out[order] = own
        return out

    def score(self, ids, lengths):
        """Natural log probability of each id; ids: of texts one after another, end ids included."""
        ids, lengths = np.asarray(ids), np.asarray(lengths, dtype=np.int64)
        out = self.log_inside.take(ids)
        if not len(ids):
            return out
        flat = np.empty(len(ids), dtype=np.int32)
        flat[1:] = self.input_of.take(ids[:-1])
        flat[np.cumsum(lengths) - lengths] = self.start
        leaf = self.leaf_of.take(ids)
        group = (leaf // SLOTS).astype(np.uint8)
        slot = leaf - group * np.int32(SLOTS)
        begin, end, skip, _ = windows(lengths)
        to_group, to_slot = self._outputs()[:2]
        span, bias, held, places, n = np.arange(WINDOW), self._bias(), [], [], 0
        order = np.argsort(skip > 0, kind="stable")  # a text's first window counts whole, others from `skip` on
        firsts = int((skip == 0).sum())
        blocks = [order[a : min(a + BLOCK, b)] for a0, b in ((0, firsts), (firsts, len(order))) for a in range(a0, b, BLOCK)]
        for k, s in enumerate(blocks):
            at = begin[s, None] + span
            first = int(skip[s[0]])
            h, _ = self.hidden(flat.take(np.minimum(at, end[s, None] - 1)), bias, first)
            at = at[:, first:]
            counts = np.flatnonzero(at < end[s, None])
            h, at = h.reshape(-1, HIDDEN + 1).take(counts, 0), at.ravel().take(counts)
            out[at] += self._groups(h, group.take(at), to_group)
            held.append(h)
            places.append(at)
            n += len(at)
            if n >= OUTPUTS or k + 1 == len(blocks):
                at = np.concatenate(places)
                out[at] += self._slots(np.concatenate(held), group.take(at), slot.take(at), to_slot)
                held, places, n = [], [], 0
        return out
