"""Exact, cached encoding of whole texts with a word-splitting tokenizer.

The vocabulary used here drops white space before it merges, so a text's ids are the ids of its
white-space separated words in a row.  Words repeat far more often than texts do: a slice of texts is split by Arrow, its
distinct words are looked up in a bounded map that each Python worker keeps, the tokenizers library is asked for new words only,
and the ids of all words in turn are then taken from one table.  Texts that could hold a special token go to the library as they are.
"""

from __future__ import annotations

import codecs
import os
import sys
from array import array
from collections.abc import Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words of a generation, of which a worker keeps two (a word and its ids take about 200 bytes), and the longest that is kept.
CACHE_WORDS = 160_000
CACHE_WORD_CHARS = 48
#: Bytes of text that are split at a time.
SLICE_BYTES = 24 << 20

if sys.byteorder != "little":
    raise ImportError("ids are kept as this machine's 16-bit integers, which must be little-endian")

_ENCODERS: dict[str, "WordEncoder"] = {}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> "WordEncoder":
    """The worker's own encoder for this file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def slices(column, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow column of texts, each of some `size` bytes or of one row."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")))
        yield a, b
        a = b


def word_table(texts) -> tuple:
    """Words of an Arrow column of texts, A-Z lower-cased: the distinct ones, the number of each in turn, and words of each text.

    Words part at the six ASCII characters of white space.  Null texts count as empty.
    """
    import numpy as np
    import pyarrow.compute as pc

    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    ends = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.values[ends[0] : ends[-1]].dictionary_encode()
    words, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
    ends -= ends[0]
    if (none := pc.index(coded.dictionary, "").as_py()) >= 0:  # an empty text parts into one empty word
        some = index != none
        before = np.concatenate([[0], np.cumsum(some)])
        return words, index[some], np.diff(before[ends])
    return words, index, np.diff(ends)


class _Cache(dict):
    """Word to ids, as bytes; learns a word that it lacks."""

    def __init__(self, owner: "WordEncoder"):
        super().__init__()
        self.owner, self.before = owner, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            owner = self.owner
            if word.isascii() and word.isalpha() and word.islower():
                ids = array("H", [t.id for t in owner.tokenize(word)]).tobytes()
            elif (stop := owner.stops.get(word[-1:])) and (core := word[:-1]).isascii() and core.isalpha():
                return self[core] + stop  # a word and a stop: the word alone is kept
            else:
                ids = owner.learn(word)
        if len(word) <= CACHE_WORD_CHARS:
            if len(self) >= CACHE_WORDS:  # words in use come back from the generation before
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


class WordEncoder:
    """encode(texts) gives the ids of texts, and how many each has.

    A new word of small Latin letters, with ASCII punctuation behind it or not, needs no normalising
    and no further splitting, so it goes to the merges of the file's model alone; any other new
    word goes through the whole of the file's steps.
    """

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        #: The last special token, which ends texts where a caller names no other.
        self.end_id = max([i for i, t in self.library.get_added_tokens_decoder().items() if t.special], default=0)
        self.openers = {t.content[:2] for t in self.library.get_added_tokens_decoder().values() if t.special}
        self.tokenize = self.library.model.tokenize
        self.simple = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)\Z").match
        self.stops = {c: self._plain(c) for c in ".,;:!?"}
        self.runs: dict[str, bytes] = {}  # of ASCII punctuation behind a word, which the vocabulary's steps take as one piece
        byte_char = self.library.pre_tokenizer.pre_tokenize_str  # a byte's character in the model's alphabet
        letters = [chr(b) for b in range(256)]  # by byte of UTF-8; what `simple` lets through has these only
        for c in (*range(0xDF, 0xF7), *range(0xF8, 0x100)):
            pair = "".join(x for x, _ in byte_char(chr(c)))
            for b, x in zip(chr(c).encode(), pair, strict=True):
                letters[b] = x
        self.letters = "".join(letters)
        self.cache = _Cache(self)

    def _plain(self, text: str) -> bytes:
        return array("H", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, word: str) -> bytes:
        if not (m := self.simple(word)):
            return self._plain(word)
        core, run = m.groups()
        if run:
            if run not in self.runs:
                if len(self.runs) >= 10_000:
                    self.runs.clear()
                self.runs[run] = self._plain(run)
            return self.cache[core] + self.runs[run]
        return array("H", [t.id for t in self.tokenize(codecs.charmap_decode(core.encode(), "strict", self.letters)[0])]).tobytes()

    def encode(self, texts, end_id: int | None = None, table: tuple | None = None) -> tuple:
        """Ids (unsigned 16-bit) of an Arrow column of texts, one text after another, and the number of each text's; end_id, where given, ends each text.

        table: what word_table(texts) gave, where that is known.  Null texts count as empty.
        """
        import numpy as np

        if table is not None and not self._special(texts).any():
            return self.encode_words(*table, end_id)
        got = [self._slice(texts.slice(a, b - a), end_id) for a, b in slices(texts)]
        if len(got) == 1:
            return got[0]
        return np.concatenate([np.zeros(0, "<u2"), *[g[0] for g in got]]), np.concatenate([np.zeros(0, np.int64), *[g[1] for g in got]])

    def _special(self, texts):
        """Which texts could hold a special token."""
        import functools

        import pyarrow.compute as pc

        return pc.fill_null(functools.reduce(pc.or_, [pc.match_substring(texts, o) for o in self.openers]), False).to_numpy(zero_copy_only=False)

    def _slice(self, texts, end_id: int | None) -> tuple:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        special = self._special(texts)
        if special.any():
            return self._mixed(texts, np.flatnonzero(special), pc.if_else(pa.array(special), "", texts), end_id)
        return self.encode_words(*word_table(texts), end_id)

    def encode_words(self, words: list[str], index, counts, end_id: int | None = None) -> tuple:
        """As encode(), from what word_table() gives."""
        import numpy as np

        found = [self.cache[w] for w in words]
        if end_id is not None:  # a word of its own behind each text
            index = np.insert(index, np.cumsum(counts), len(found))
            counts = counts + 1
            found.append(array("H", [end_id]).tobytes())
        table = np.frombuffer(b"".join(found), "<u2")
        sizes = np.fromiter(map(len, found), np.int32, len(found)) >> 1
        first = np.cumsum(sizes, dtype=np.int32) - sizes
        edges = np.concatenate([[0], np.cumsum(counts)])  # of texts, in words; then in ids
        parts, before, done = [], 0, np.zeros(len(edges), dtype=np.int64)
        for a in range(0, len(index), 1 << 19):
            some = index[a : a + (1 << 19)]
            each = sizes[some]
            ends = np.cumsum(each, dtype=np.int32)
            at = np.repeat(first[some] - (ends - each), each)
            at += np.arange(len(at), dtype=np.int32)
            parts.append(table[at])
            here = slice(*np.searchsorted(edges, [a, a + len(some)], side="right"))
            done[here] = before + ends[edges[here] - a - 1]
            before += len(at)
        done[edges == 0] = 0
        return np.concatenate([table[:0], *parts]), np.diff(done)

    def _mixed(self, texts, special, rest, end_id: int | None) -> tuple:
        """Where the numbered texts go to the library whole."""
        import numpy as np

        ids, lengths = self.encode_words(*word_table(rest), end_id)
        ends = np.cumsum(lengths)
        parts, at = [], 0
        for i in special.tolist():
            own = np.frombuffer(self._plain(texts[i].as_py()), "<u2")
            begin = int(ends[i] - lengths[i])
            parts += [ids[at:begin], own]
            at = begin
            lengths[i] += len(own)
        return np.concatenate([*parts, ids[at:]]), lengths
