"""Byte-pair encoding with a public vocabulary, and where its files are.

Short pieces are merged on a contiguous rank array: part boundaries and the ranks of adjacent
pairs lie side by side; the least rank is found by a scan, its boundary deleted and the two
neighbouring ranks renewed. Long pieces, where scanning would be quadratic, use the same merge
order from a heap over a linked list; both give the same ids.
"""

from __future__ import annotations

import base64
import heapq
import os
from functools import lru_cache

import regex

#: Folder of the public vocabulary files; a parameter of every operator that encodes.
VOCABULARIES = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Pre-splitting pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longest piece, in bytes, that is merged by scanning.
SCAN_LIMIT = 96
#: Distinct pieces a worker keeps; beyond that the cache starts anew (results do not change).
CACHE_PIECES = 300_000
_NONE = 1 << 60


class Encoder:
    """Encoder for one vocabulary file of ranks."""

    def __init__(self, folder: str = VOCABULARIES, name: str = NAME) -> None:
        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern = regex.compile(PATTERN)
        self.cache: dict[str, list[int]] = {}

    def pieces(self, text: str) -> list[str]:
        """Pre-split text; lone surrogates, which no encoding has, become replacement marks."""
        return self.pattern.findall(text)

    def piece_ids(self, piece: str) -> list[int]:
        ids = self.cache.get(piece)
        if ids is None:
            raw = piece.encode("utf-8", "replace")
            whole = self.ranks.get(raw)
            ids = [whole] if whole is not None else self._scan(raw) if len(raw) <= SCAN_LIMIT else self._heap(raw)
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts have no ids, that is an empty list."""
        if not text:
            return []
        out: list[int] = []
        known, ids = self.cache, self.piece_ids
        for piece in self.pattern.findall(text):
            out += known.get(piece) or ids(piece)
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, ids = self.cache, self.piece_ids
        return sum(len(known.get(piece) or ids(piece)) for piece in self.pattern.findall(text))

    def _scan(self, raw: bytes) -> list[int]:
        get = self.ranks.get
        bounds = list(range(len(raw) + 1))
        pairs = [get(raw[i : i + 2], _NONE) for i in range(len(raw) - 1)]
        while pairs:
            least = min(pairs)
            if least == _NONE:
                break
            at = pairs.index(least)
            del bounds[at + 1], pairs[at]
            if at < len(pairs):
                pairs[at] = get(raw[bounds[at] : bounds[at + 2]], _NONE)
            if at:
                pairs[at - 1] = get(raw[bounds[at - 1] : bounds[at + 1]], _NONE)
        return [self.ranks[raw[a:b]] for a, b in zip(bounds, bounds[1:])]

    def _heap(self, raw: bytes) -> list[int]:
        get, n = self.ranks.get, len(raw)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = bytearray(b"\1" * n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, at, to = heapq.heappop(heap)
            if not alive[at] or end[at] >= n or end[end[at]] != to or not alive[end[at]]:
                continue
            gone = end[at]
            alive[gone] = 0
            end[at] = to
            if to < n:
                before[to] = at
                if (r := get(raw[at : end[to]])) is not None:
                    heapq.heappush(heap, (r, at, end[to]))
            if (left := before[at]) >= 0 and (r := get(raw[left:to])) is not None:
                heapq.heappush(heap, (r, left, to))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[raw[at : end[at]]])
            at = end[at]
        return out


@lru_cache(4)
def encoder(folder: str = VOCABULARIES, name: str = NAME) -> Encoder:
    """The encoder of this worker, built once."""
    return Encoder(folder, name)
