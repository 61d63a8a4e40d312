"""Byte pair merging of text slices with a cache of slices seen before."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np

from .pretokenize import slices

#: Slices kept per worker, and characters handled at once (a longer text is handled alone).
CACHE_SLICES = 400_000
CHUNK_CHARS = 2_000_000


def parse_ranks(file: bytes) -> dict[bytes, int]:
    """The token bytes and ranks of a rank file (base64, blank, rank per line)."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines()) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids after merging, again and again, the leftmost of the adjacent pairs with the lowest rank."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or after[j] != end:
            continue
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
            longer = after[end]
            if (rank := ranks.get(piece[i:longer])) is not None:
                heapq.heappush(heap, (rank, i, longer))
        if (p := before[i]) >= 0 and (rank := ranks.get(piece[p:end])) is not None:
            heapq.heappush(heap, (rank, p, end))
    return [ranks[piece[i : after[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes lists of texts; slices merged once are kept as rows of one ragged id table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.widths = np.zeros(max(ranks.values()) + 1, np.int32)
        for token, rank in ranks.items():
            self.widths[rank] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.ids, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.size = np.empty(1 << 15, np.int64), np.empty(1 << 15, np.int64)

    def _add(self, piece: str) -> None:
        ids = merge(piece.encode(), self.ranks)
        row = len(self.rows)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        if row >= len(self.start):
            self.start, self.size = (np.concatenate([a, np.empty_like(a)]) for a in (self.start, self.size))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[row], self.size[row] = self.used, len(ids)
        self.used += len(ids)
        self.rows[piece] = row

    def _lookup(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of all slices, and slices per text."""
        joined, starts, ends, counts = slices(texts)
        pieces = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        if len(self.rows) > CACHE_SLICES:
            self._clear()
        for piece in set(pieces).difference(self.rows):
            self._add(piece)
        return np.fromiter(map(self.rows.__getitem__, pieces), np.int64, len(pieces)), counts

    @staticmethod
    def _chunks(texts: list[str]) -> Iterator[list[str]]:
        chunk, size = [], 0
        for text in texts:
            if chunk and size + len(text) > CHUNK_CHARS:
                yield chunk
                chunk, size = [], 0
            chunk.append(text)
            size += len(text)
        if chunk:
            yield chunk

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per chunk of texts: all ids on end, and the number of ids of each text."""
        for chunk in self._chunks(texts):
            rows, counts = self._lookup(chunk)
            sizes = self.size[rows]
            upto = np.cumsum(sizes)
            total = int(upto[-1]) if len(upto) else 0
            ids = self.ids[np.repeat(self.start[rows] - upto + sizes, sizes) + np.arange(total)]
            yield ids, _sums(sizes, counts)

    def count(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Per chunk of texts: the number of ids of each text."""
        for chunk in self._chunks(texts):
            rows, counts = self._lookup(chunk)
            yield _sums(self.size[rows], counts)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset behind each token of one text."""
        return np.cumsum(self.widths[ids], dtype=np.int64)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values)])
    borders = np.concatenate([[0], np.cumsum(counts)])
    return upto[borders[1:]] - upto[borders[:-1]]
