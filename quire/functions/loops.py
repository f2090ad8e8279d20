"""Repeats within a line, found by the places of its parts instead of by a backreference.

What repeats three times starts with the same UNIT characters at three places.  All texts of a slice are hashed together, UNIT characters at a time, and sorted; only lines where
a hash occurs three times are looked at, and there only such places, from left to right, each with the distances to the others of its kind.  Every repeat is compared character by
character, so the result is that of the lazy pattern (.{15,}?)\\1{2,}, in about the time that sorting takes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.batches import by_slice

#: Characters of a part at least, and how often it must be there.
UNIT, TIMES = 15, 3
#: Places of a kind beyond which they are looked through as an array.
MANY = 64


def mend(line: str, starts: list[int]) -> str:
    """A line with one of each repeat; starts: the places, in order, whose UNIT characters are there TIMES times or more."""
    kinds: dict[str, list[int]] = {}
    for i in starts:
        kinds.setdefault(line[i : i + UNIT], []).append(i)
    at = dict.fromkeys(kinds, 0)
    arrays = {k: np.array(v) for k, v in kinds.items() if len(v) > MANY}
    out, done, n = [], 0, len(line)
    for i in starts:
        kind = line[i : i + UNIT]
        at[kind] += 1
        if i < done:
            continue
        later = kinds[kind][at[kind] :]
        if kind in arrays:  # those whose next one is there, too
            own = arrays[kind]
            found = own[at[kind] :]
            found = found[(found - i >= UNIT) & (TIMES * (found - i) <= n - i)]
            after = 2 * found - i
            later = found[own[np.searchsorted(own, after).clip(max=len(own) - 1)] == after].tolist()
        for p in later:
            size = p - i
            if size < UNIT:
                continue
            if TIMES * size > n - i:
                break
            if line[p - UNIT : p] == line[p + size - UNIT : p + size] and line.startswith(part := line[i:p], p) and line.startswith(part, p + size):
                end = p + 2 * size
                while line.startswith(part, end):
                    end += size
                out += [line[done:i], part]
                done = end
                break
    return "".join([*out, line[done:]])


def collapse(texts: list[str]) -> list[str]:
    """The texts with one of each repeat."""
    joined = "\n".join(texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    if len(code) < UNIT * TIMES:
        return texts
    line = np.cumsum(code == 10)
    h, size = code.astype(np.uint64) + np.uint64(1), 1
    p = 0x9E3779B97F4A7C15
    while size < UNIT:  # overlapping halves: the hash need only tell parts from one another
        step = min(size, UNIT - size)
        h, size = h[: len(h) - step] * np.uint64(pow(p, step, 2**64)) + (h[step:] ^ (h[step:] >> np.uint64(29))), size + step
    inside = np.flatnonzero(line[: len(h)] == line[UNIT - 1 :])
    key = h[inside] ^ (line[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    edges = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]], [True]])) if len(key) else np.zeros(1, np.int64)
    often = np.diff(edges) >= TIMES
    places = np.sort(inside[order[np.repeat(often, np.diff(edges))]]) if often.any() else np.zeros(0, np.int64)
    if not len(places):
        return texts
    lines = joined.split("\n")
    begins = np.concatenate([[0], np.flatnonzero(code == 10) + 1])
    of = line[places]
    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        k = int(of[a])
        lines[k] = mend(lines[k], (places[a:b] - begins[k]).tolist())
    out, k = [], 0
    for t in texts:
        n = t.count("\n") + 1
        out.append("\n".join(lines[k : k + n]))
        k += n
    return out


def _collapse(texts: list[str | None]) -> list[str | None]:
    found = iter(collapse([t for t in texts if t is not None]))
    return [None if t is None else next(found) for t in texts]


_collapsed = by_slice(_collapse)


def collapse_loops(text: Column, only: Column | None = None, spare: bool = False) -> Column:
    """Leaves one of three or more repeats of a part of 15 characters or more, within a line; where `only` doesn't hold, the text stays as it is, and isn't sent anywhere.

    spare: where Spark knows that `only` never holds, there is no Python step, nor a worker for it in each core.
    """
    long = F.length(text) >= UNIT * TIMES
    asked = long if only is None else long & only
    found = _collapsed(F.when(asked, text))
    return F.when(asked, found).otherwise(text) if spare else F.coalesce(found, text)
