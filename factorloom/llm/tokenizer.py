"""Token ids by the tokenizers library, with each distinct stretch of text encoded once per worker.

Neither public vocabulary lets a token cross the place before a single space or line feed between
two visible characters, nor the place between a letter and ASCII punctuation, so a text may be cut
there and its parts encoded apart.  Parts are told apart by 64-bit hashes.  A special string of the vocabulary is one token wherever it stands
in a text, as the library has it by default; no cut is made in or beside it.  Parts repeat a lot;
their ids are kept in a cache of at most CACHE_BYTES per worker, which has no influence on the result.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from .common import Texts, span_hashes, spread

#: Bytes of the cache; beyond them only the last batch's parts of up to LONGEST bytes stay.
CACHE_BYTES, LONGEST = 48 << 20, 256
_loaded: dict[tuple[str, bool], "PartEncoder"] = {}


def encoder(path: str, plain: bool = False) -> "PartEncoder":
    """The worker's encoder for a vocabulary file; it stays for the next task of the worker.

    `plain` takes special strings of a text as ordinary text, so that no special id can come from one.
    """
    if (path, plain) not in _loaded:
        # One encoder at a time: a worker that goes on to another vocabulary frees the former.
        _loaded.clear()
        _loaded[path, plain] = PartEncoder(path, plain)
    return _loaded[path, plain]


def vocabulary(name: str) -> str:
    """Path of a vocabulary file of the installed `public_tokenizers` package."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PartEncoder:
    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [] if plain else [str(t.content).encode() for t in added]
        self.clear()

    def clear(self) -> None:
        # Hashes of the parts in order; where each one's ids begin, and how many they are.
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.starts.nbytes + self.lengths.nbytes + self.ids.nbytes

    def _learn(self, keys: np.ndarray, parts: list[str]) -> None:
        encoded = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        lists = [e.ids for e in encoded]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum()))
        begin = len(self.ids) + np.cumsum(lengths) - lengths
        # Two sorted lists, which the stable sort merges.
        keys = np.concatenate((self.keys, keys))
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.starts = np.concatenate((self.starts, begin))[order]
        self.lengths = np.concatenate((self.lengths, lengths))[order]
        self.ids = np.concatenate((self.ids, flat))

    def _keep(self, at: np.ndarray) -> None:
        """Forget all parts but those at these places."""
        lengths = self.lengths[at]
        self.ids = self.ids[spread(self.starts[at], lengths)]
        self.keys, self.lengths, self.starts = self.keys[at], lengths, np.cumsum(lengths) - lengths

    def encode(self, texts: Texts, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the n + 1 borders between texts; `end` closes each text."""
        buf, offsets = texts.buf, texts.offsets
        whole = buf.tobytes()
        starts = _cuts(buf, offsets, _places(whole, self.special))
        ends = np.append(starts[1:], len(buf))
        owner = np.searchsorted(offsets, starts, "right") - 1
        keys, first, which = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        new = np.flatnonzero(~known)
        if len(new):
            own = first[new]
            self._learn(keys[new], [whole[s:e].decode() for s, e in zip(starts[own].tolist(), ends[own].tolist())])
            at = np.searchsorted(self.keys, keys)
        lengths = self.lengths[at][which]
        ids = self.ids[spread(self.starts[at][which], lengths)]
        if self.nbytes > CACHE_BYTES:
            self._keep(at[(ends - starts)[first] <= LONGEST])
            if self.nbytes > CACHE_BYTES:
                self.clear()
        count = np.bincount(owner, weights=lengths, minlength=len(texts)).astype(np.int64)
        borders = np.concatenate(([0], np.cumsum(count)))
        if end is None:
            return ids, borders
        closed = np.full(len(ids) + len(texts), end, np.uint32)
        closed[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), count)] = ids
        return closed, borders + np.arange(len(texts) + 1)


def _places(whole: bytes, special: list[bytes]) -> list[tuple[int, int]]:
    """Where special strings stand."""
    out = []
    for string in special:
        at = whole.find(string)
        while at >= 0:
            out.append((at, at + len(string)))
            at = whole.find(string, at + 1)
    return out


def _cuts(buf: np.ndarray, offsets: np.ndarray, special: list[tuple[int, int]] = ()) -> np.ndarray:
    """Starts of the parts: text starts, and away from `special` places before a lone space or line feed, and ends of words."""
    n = len(buf)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    if n < 3:
        return np.flatnonzero(first)
    ascii_visible = (buf > 32) & (buf < 127)
    latin_lead = buf == 0xC3
    before = np.zeros(n, bool)
    before[1:] = ascii_visible[:-1]
    before[2:] |= ((buf[1:-1] & 0xC0) == 0x80) & latin_lead[:-2]
    after = np.zeros(n, bool)
    after[:-1] = ascii_visible[1:] | latin_lead[1:]
    # A neighbour must be of the same text.
    after[:-1] &= ~first[1:]
    before &= ~first
    letter = np.zeros(n, bool)
    folded = buf | 32
    letter[1:] = ((folded >= 97) & (folded <= 122))[:-1]
    # U+00D7 and U+00F7 are the two symbols among the letters U+00C0 to U+00FF.
    letter[2:] |= ((buf[1:-1] & 0xC0) == 0x80) & ((buf[1:-1] & 0xDF) != 0x97) & latin_lead[:-2]
    mark = ascii_visible & ~((folded >= 97) & (folded <= 122)) & ~((buf >= 48) & (buf <= 57))
    blank = (buf == 32) | (buf == 10)
    cut = (blank & before & after) | (mark & letter)
    for a, b in special:
        cut[max(0, a - 1) : b + 2] = False
    return np.flatnonzero(first | cut)
