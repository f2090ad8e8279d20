"""Fill-in-middle transformation, with cuts found by run-length class encoding.

A text is cut at two code points into prefix, middle and suffix, which change places under markers, so that a model learns to write the middle last.  UTF-8 is
not indexed by code point, so each text is kept as maximal runs of one character class, the class being the bytes that a code point takes, with the
code points and bytes before each run.  A cut is placed by binary search for the run that contains it and arithmetic inside:
the run's first byte, plus the code points into it times its class.  Plain ASCII is one run; no text is decoded, and the table is built in
blocks of bytes, so a very long text takes as much memory as its runs and itself.

Cuts and forms depend on doc_id alone (the hash of `key`:doc_id), so any run gives the same ones.  A null doc_id counts as an empty one, a null text as empty.
Empty texts stay plain, and so do texts that hold a marker, since they couldn't be rebuilt.  Repeated rows stay; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import _base
from quire.llm._tokens import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, so many change their form, and of 100 of those, so many put the suffix first.
RATE, SUFFIX_FIRST = 90, 20
KEY = 1
BLOCK_BYTES = 1 << 20
SLICE_BYTES = 8 << 20


class Runs:
    """Maximal runs of one character class in texts that stand one behind another in `data` from ends[0] to ends[-1]."""

    def __init__(self, data, ends, block: int = BLOCK_BYTES):
        """data: an array of bytes; ends: where each text starts, and where the last one ends."""
        import numpy as np

        classes = np.zeros(256, dtype=np.uint8)  # bytes of the code point that a byte begins; 0 inside one
        classes[:0x80], classes[0xC0:0xE0], classes[0xE0:0xF0], classes[0xF0:] = 1, 2, 3, 4
        at, units, kinds, before, last = [], [], [], 0, 0
        starts = np.unique(ends[:-1])
        for a in range(int(ends[0]), int(ends[-1]), block):
            b = min(a + block, int(ends[-1]))
            kind = classes[data[a:b]]
            lead = np.flatnonzero(kind)
            kind = kind[lead]
            new = kind != np.concatenate([[last], kind[:-1]]) if len(kind) else np.zeros(0, dtype=bool)
            own = starts[np.searchsorted(starts, a) : np.searchsorted(starts, b)] - a
            new[np.searchsorted(lead, own[own < b - a])] = True  # a text begins a run
            at.append(lead[new] + a)
            units.append(np.flatnonzero(new) + before)
            kinds.append(kind[new])
            before += len(lead)
            last = kind[-1] if len(kind) else last
        self.at, self.units, self.kinds = (np.concatenate([*x, [end]]).astype(np.int64) for x, end in ((at, int(ends[-1])), (units, before), (kinds, 1)))
        self.first = self.units[np.searchsorted(self.at, ends)]  # units before each text, and before the end

    def lengths(self):
        """Code points of each text."""
        import numpy as np

        return np.diff(self.first)

    def bytes_at(self, text, unit):
        """Where in `data` the given code points of the given texts begin."""
        import numpy as np

        unit = self.first[text] + unit
        run = np.searchsorted(self.units, unit, side="right") - 1
        return self.at[run] + (unit - self.units[run]) * self.kinds[run]


def _draws(key: int, doc_id) -> list[int]:
    """Four numbers below 2^32."""
    import hashlib

    hexes = hashlib.sha256(f"{key}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(hexes[8 * k : 8 * k + 8], 16) for k in range(4)]


def _rearrange(key: int, rate: int, suffix_first: int):
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE_BYTES):
                docs = batch.column("doc_id").slice(a, b - a)
                text = pc.fill_null(batch.column("text").slice(a, b - a), "").cast(pa.large_string())
                _, offsets, buffer = text.buffers()
                ends = np.frombuffer(offsets, "<i8")[text.offset : text.offset + len(text) + 1]
                data = np.frombuffer(buffer or b"", "u1")
                runs = Runs(data, ends)
                n = runs.lengths()
                h = np.array([_draws(key, d) for d in docs.to_pylist()], dtype=np.int64).reshape(-1, 4)
                marked = pc.match_substring_regex(text, f"{PREFIX}|{SUFFIX}|{MIDDLE}").to_numpy(zero_copy_only=False)
                plain = (n == 0) | marked | (h[:, 2] % 100 >= rate)
                cuts = np.sort(h[:, :2] % (n[:, None] + 1), axis=1)
                rows = np.arange(len(n))
                x, y = runs.bytes_at(rows, cuts[:, 0]), runs.bytes_at(rows, cuts[:, 1])
                spm = h[:, 3] % 100 < suffix_first
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                whole = memoryview(data)
                out = []
                for kind, i, j, k, z in zip(form.tolist(), ends[:-1].tolist(), x.tolist(), y.tolist(), ends[1:].tolist(), strict=True):
                    if kind == "plain":
                        out.append(bytes(whole[i:z]))
                    elif kind == "psm":
                        out.append(b"".join((p, whole[i:j], s, whole[k:z], m, whole[j:k])))
                    else:
                        out.append(b"".join((s, whole[k:z], p, whole[i:j], m, whole[j:k])))
                counts = [pa.array(v, pa.int64(), mask=plain) for v in (cuts[:, 0], cuts[:, 1] - cuts[:, 0])]
                yield pa.RecordBatch.from_arrays([docs, pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), *counts, pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, key: int = KEY, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars, output.  docs: doc_id, text and any others."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_rearrange(key, rate, suffix_first), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    prefix, suffix = (F.when(form == "psm", part[a]).otherwise(part[b]) for a, b in ((1, 2), (2, 1)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, part[3], suffix))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(_base.table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = """
with texts as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, ''))::bigint as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
drawn as (
  select *, ('0x' || substr(h, 1, 8))::bigint % (n + 1) as a, ('0x' || substr(h, 9, 8))::bigint % (n + 1) as b,
         ('0x' || substr(h, 17, 8))::bigint % 100 as c, ('0x' || substr(h, 25, 8))::bigint % 100 as d from texts),
formed as (
  select *, least(a, b) as x, greatest(a, b) as y,
         case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or c >= 90 then 'plain' when d < 20 then 'spm' else 'psm' end as form from drawn),
parts as (
  select *, substring(t, 1, x) as p, substring(t, x + 1, y - x) as m, substring(t, y + 1, n - y) as s from formed)
select doc_id, n, form, case when form <> 'plain' then x end as prefix_chars, case when form <> 'plain' then y - x end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(case form when 'plain' then t else p || m || s end) as restored_sha256
from parts
"""
