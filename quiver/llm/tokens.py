"""Token ids of whole texts by a public byte-pair vocabulary, fast enough for a corpus.

The tokenizer lower-cases, drops white space and splits at it, so the ids of a
text are those of its blank-separated pieces in order. Pieces repeat, hence their
ids are kept in a bounded cache. New pieces of printable ASCII and Latin-1 letters
are merged here, many at a time, by the vocabulary's own merge list; any other
piece, very long ones and those with ``<`` (special tokens), goes to the tokenizer
itself.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np

CACHED_PIECES = 600_000
LONGEST_CACHED = 48          # bytes; longer pieces are rare and not worth keeping
NO_MERGE = np.iinfo(np.int32).max
_SIMPLE = re.compile(r"^[!-;=-~À-ÖØ-öø-ÿ]+$", re.MULTILINE)
_PARTS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+")
_BREAK = b"\xff" * 4        # ids stay below 2**24, so no four such bytes meet in them


def _byte_symbols() -> list[str]:
    """Byte-level vocabularies write each byte as one printable character."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class MergeList:
    """The byte-pair merges of a vocabulary, applied to many words at once."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, suffix, symbols = model["vocab"], model["end_of_word_suffix"], _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        keys = np.array([vocab[x] << 17 | vocab[y] for x, y in pairs], np.int64)
        self.merged = np.array([vocab[x + y] for x, y in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 17 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NO_MERGE)

    def ids(self, words: list[str]) -> dict[str, bytes]:
        """word -> its ids as little-endian unsigned 32-bit bytes; words aren't empty."""
        found, by_length = {}, defaultdict(list)
        for word in words:
            by_length[len(word.encode())].append(word)
        for length, same in by_length.items():
            for at in range(0, len(same), 8192):
                group = same[at: at + 8192]
                raw = np.frombuffer("".join(group).encode(), np.uint8).reshape(len(group), length)
                ids = self.inner[raw]
                ids[:, -1] = self.final[raw[:, -1]]
                sizes = self._merge(ids)
                packed, step = ids.astype("<u4").tobytes(), 4 * length
                for i, (word, size) in enumerate(zip(group, sizes.tolist())):
                    found[word] = packed[i * step: i * step + 4 * size]
        return found

    def _merge(self, ids: np.ndarray) -> np.ndarray:
        """Merge in place, the lowest rank first and of equal ranks the leftmost; returns the final sizes."""
        n, length = ids.shape
        sizes = np.full(n, length)
        if length == 1:
            return sizes
        places = np.arange(length)[None, :]
        ranks = np.full((n, length), NO_MERGE, np.int32)
        ranks[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        live, work = np.arange(n), ids.copy()
        while True:
            best = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(live)), best]
            done = rank == NO_MERGE
            if done.any():
                ids[live[done]] = work[done]
                keep = ~done
                live, work, ranks, best, rank = live[keep], work[keep], ranks[keep], best[keep], rank[keep]
            if not len(live):
                return sizes
            rows = np.arange(len(live))
            shift = np.minimum(places + (places > best[:, None]), length - 1)
            work, ranks = np.take_along_axis(work, shift, 1), np.take_along_axis(ranks, shift, 1)
            work[rows, best] = self.merged[rank]
            sizes[live] -= 1
            last = sizes[live] - 1
            ranks[rows, last] = NO_MERGE
            inside = best < last
            r, b = rows[inside], best[inside]
            ranks[r, b] = self.rank(work[r, b], work[r, b + 1])
            r, b = rows[best > 0], best[best > 0]
            ranks[r, b - 1] = self.rank(work[r, b - 1], work[r, b])


class PieceIds:
    """Ids of texts; keeps the ids of up to CACHED_PIECES blank-separated pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.merges = Tokenizer.from_file(path), MergeList(path)
        self.known: dict[bytes, bytes] = {}

    def _learn(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """Put the ids of new pieces into the cache; returns those too long to be kept."""
        lines = b"\n".join([p for p in pieces if len(p) <= LONGEST_CACHED]).decode()
        simple = _SIMPLE.findall(lines)
        for piece in set(lines.split("\n")).difference(simple, ("",)):
            self.known[piece.encode()] = self._by_tokenizer(piece)
        if simple:
            lines = "\n".join(simple)
            parts = _PARTS.findall(lines.lower())
            ids_of = self.merges.ids(list(set(parts) - {"\n"}))
            ids_of["\n"] = _BREAK
            packed = b"".join(map(ids_of.__getitem__, parts)).split(_BREAK)
            self.known.update(zip(lines.encode().split(b"\n"), packed))
        return {p: self._by_tokenizer(p.decode()) for p in pieces if len(p) > LONGEST_CACHED}

    def _by_tokenizer(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
        split = [t.split() for t in texts]
        new = set().union(*split).difference(self.known)
        unkept = self._learn(new)
        if unkept:
            known = self.known
            return [b"".join([known[p] if p in known else unkept[p] for p in s]) for s in split]
        get = self.known.__getitem__
        return [b"".join(map(get, s)) for s in split]


@lru_cache(maxsize=2)
def piece_ids(path: str | None) -> PieceIds:
    """The cache of this Python worker; None: the public 49k word vocabulary of the installation."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    return PieceIds(path)


def in_slices(texts: list[bytes], most: int = 2_000_000):
    """Consecutive (first, last) slices of about ``most`` bytes, so that a batch is split into words bit by bit."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
