"""Whole-text encoding with the tokenizers library, each distinct piece once per worker.

The pre-tokenizers used here never join characters across certain blanks, so a
text's ids are the ids of its blank-separated pieces, one after the other.  A
worker therefore hands the library only pieces it has not met lately and joins
the stored ids.  The store holds about ``CAPACITY`` bytes at most;
results never depend on what it holds.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CAPACITY = 64 << 20
#: Bytes of a stored piece besides its characters and ids: two objects and a place in the table.
OVERHEAD = 180
_DOUBLE_BLANK = re.compile(r"\s\s")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def byte_level_pieces(text: str) -> list[str]:
    """Cut at single spaces between two non-blanks; every piece but the first stands for ' ' + piece.

    A byte-level pre-token is an optional space with non-blanks, or blanks only,
    and looks ahead only from blanks.  So a space between two non-blanks always
    begins a pre-token, and what comes before it cannot depend on it.
    """
    if _DOUBLE_BLANK.search(text) or text[:1].isspace() or text[-1:].isspace():
        return _SINGLE_SPACE.split(text)
    return text.split(" ")


def blank_free_words(texts: pa.StringArray) -> pa.ListArray:
    """Cut at every space and line feed, for tokenizers that lower-case letters and drop blanks.

    A-Z are lower-cased here so that words differ less, unless a special token
    might be spelled in the text.
    """
    texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
    return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")


def closes(word: str) -> bool:
    """Whether a word ends in a letter and a point or comma, which is then a pre-token of its own."""
    return word[-1:] in (".", ",") and "a" <= word[-2:-1] <= "z" and "<|" not in word


class Store(dict):
    """Values by piece in two generations: when the young one is full it replaces the old one."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}
        self.held = 0

    def missing(self, pieces: set[str]) -> list[str]:
        """Make room, bring back pieces of the old generation, and return those that are in neither."""
        wanted = pieces.difference(self)
        size = sum(map(len, wanted)) * 4 + OVERHEAD * len(wanted)
        if self.held + size > CAPACITY // 2:
            self.old = dict(self)
            self.clear()
            wanted, self.held = pieces, 0
            size = sum(map(len, wanted)) * 4 + OVERHEAD * len(wanted)
        self.held += size
        unknown, old = [], self.old
        for p in wanted:
            if p in old:
                self[p] = old[p]
            else:
                unknown.append(p)
        return unknown


class PieceEncoder:
    """Encode texts by byte-level pieces; ``value(ids)`` says what is stored for a piece."""

    def __init__(self, tokenizer, value):
        self.tokenizer, self.value = tokenizer, value
        self.first, self.rest = Store(), Store()

    def _learn(self, store: Store, pieces: set[str], lead: str) -> None:
        missing = store.missing(pieces)
        for i in range(0, len(missing), 4096):
            part = missing[i:i + 4096]
            coded = self.tokenizer.encode_batch_fast([lead + p for p in part], add_special_tokens=False)
            for p, e in zip(part, coded):
                store[p] = self.value(e.ids)

    def encode(self, texts: list[str]) -> list[list]:
        """For each text the stored values of its pieces, in order.  An empty text has none."""
        cut = [byte_level_pieces(t) if t else [] for t in texts]
        self._learn(self.first, {p[0] for p in cut if p}, "")
        self._learn(self.rest, set().union(*(p[1:] for p in cut)), " ")
        first, rest = self.first, self.rest
        return [[first[p[0]], *map(rest.__getitem__, p[1:])] if p else [] for p in cut]


class WordEncoder:
    """Encode columns of texts by words, for tokenizers that drop blanks.

    Arrow cuts a column into words and numbers the distinct ones; known words and
    their ids are columns too, so only words that aren't known become Python objects.
    ``word_end``: the suffix that a word's last token has.  Words of letters only
    are encoded many at a time and cut apart after tokens with it; should their number not agree, one by one.
    """

    #: Bytes of known words and ids; beyond that only those of the last texts are kept.
    CAPACITY = 24 << 20

    def __init__(self, tokenizer, word_end: str):
        self.tokenizer = tokenizer
        self.last = np.zeros(tokenizer.get_vocab_size(), bool)
        self.last[[i for token, i in tokenizer.get_vocab().items() if token.endswith(word_end)]] = True
        self._forget()

    def _forget(self) -> None:
        self.words, self.bounds, self.ids = pa.array([], pa.string()), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _add(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> range:
        """Where the added words are."""
        begin = len(self.words)
        self.words = pa.concat_arrays([self.words, pa.array(words, pa.string())])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes, dtype=np.int64)])
        self.ids = np.concatenate([self.ids, ids])
        return range(begin, len(self.words))

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where each of the distinct ``words`` is, -1 for one that isn't known."""
        met = pc.index_in(self.words, value_set=words)  # the shorter side is the one that's hashed
        out = np.full(len(words), -1)
        out[met.drop_null().to_numpy()] = np.flatnonzero(met.is_valid().to_numpy(zero_copy_only=False))
        return out

    def _encode(self, words: list[str], together: int = 64) -> dict[str, int]:
        """Add words that aren't known."""
        letters, single = [w for w in words if w.isalpha()], [w for w in words if not w.isalpha()]
        groups = [letters[i:i + together] for i in range(0, len(letters), together)]
        added, sizes, ids = [], [], []
        for i in range(0, len(groups), 64):
            part = groups[i:i + 64]
            for group, e in zip(part, self.tokenizer.encode_batch_fast([" ".join(g) for g in part], add_special_tokens=False)):
                own = np.array(e.ids, np.uint32)
                stops = np.flatnonzero(self.last[own]) + 1
                if len(stops) == len(group) and stops[-1] == len(own):
                    added += group
                    sizes.append(np.diff(stops, prepend=0)), ids.append(own)
                else:
                    single += group
        for i in range(0, len(single), 4096):
            part = single[i:i + 4096]
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            added += part
            sizes.append(np.array([len(x) for x in coded])), ids.append(np.array([x for one in coded for x in one], np.uint32))
        return dict(zip(added, self._add(added, np.concatenate(sizes), np.concatenate(ids)))) if added else {}

    def _learn(self, words: list[str]) -> list[int]:
        """Add words that aren't known and say where they are; a closing word's ids are those of the word and of its point or comma."""
        closing = [w for w in words if closes(w)]
        plain = list(dict.fromkeys([*(w for w in words if not closes(w)), *(w[:-1] for w in closing), *([".", ","] if closing else [])]))
        places = dict(zip(plain, self._places(pa.array(plain, pa.string())).tolist()))
        places |= self._encode([w for w, at in places.items() if at < 0])
        if closing:
            ids, ends = self._gather(np.array([places[x] for w in closing for x in (w[:-1], w[-1])]))
            places |= zip(closing, self._add(closing, np.diff(ends[::2]), ids))
        return [places[w] for w in words]

    def _gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at ``places``, one after the other, and their bounds."""
        begins = self.bounds[places]
        held = self.bounds[places + 1] - begins
        ends = np.concatenate([[0], np.cumsum(held)])
        return self.ids[np.repeat(begins - ends[:-1], held) + np.arange(ends[-1])], ends

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the bounds of each text's."""
        lists = blank_free_words(texts)
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary
        places = self._places(distinct)
        if (places < 0).any() and self.words.nbytes + self.ids.nbytes + self.bounds.nbytes > self.CAPACITY:
            self._forget()
            places[:] = -1
        unknown = np.flatnonzero(places < 0)
        if len(unknown):
            places[unknown] = self._learn(distinct.take(pa.array(unknown)).to_pylist())
        ids, ends = self._gather(places[words.indices.to_numpy()])
        offsets = lists.offsets.to_numpy()
        return ids, ends[offsets - offsets[0]]


def packed(ids) -> bytes:
    """Ids (a list or an array of this type) as little-endian unsigned 32-bit integers."""
    return ids.tobytes() if isinstance(ids, np.ndarray) else struct.pack(f"<{len(ids)}I", *ids)


_ENCODERS: dict[tuple, PieceEncoder | WordEncoder] = {}


def worker_encoder(key: tuple, make) -> PieceEncoder | WordEncoder:
    """The worker's encoder for ``key``; tasks that reuse the worker reuse its store."""
    if key not in _ENCODERS:
        _ENCODERS[key] = make()
    return _ENCODERS[key]
