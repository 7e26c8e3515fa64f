"""Piece lattices of many short strings at once: edges from a trie, best paths, and log-space forward and backward sums.

Strings of about the same length are the columns of an array, and a recursion steps over its rows: at most ``longest`` earlier rows are
looked at, whatever the length, and each step handles all strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Strings are padded to the next of these lengths; longer ones are left to the callers' own windows.
LENGTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16, 20, 24, 32, 48, 64, 128, 256, 512, 1024, 2048, 4096])
SIGNS = 1 << 17
#: Stands for U+2581 in a text, which isn't a blank there; no text has this sign.
LITERAL = "\ud800"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PieceTrie:
    """Pieces over numbered signs; a move from a node by a sign is a lookup in a hash table of (node, sign)."""

    def __init__(self, pieces: dict[str, int]) -> None:
        signs = sorted({c for p in pieces for c in p})
        self.code = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.code[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
        self.width = len(signs) + 1
        self.longest = max(map(len, pieces))
        nodes, moves = {"": 0}, {}
        for p in pieces:
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    moves[nodes[p[: k - 1]] * self.width + int(self.code[ord(p[k - 1])])] = nodes[p[:k]] = len(nodes)
        self.piece = np.full(len(nodes), -1, np.int32)
        for p, i in pieces.items():
            self.piece[nodes[p]] = i
        bits = max(4, (8 * len(moves)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        for key, to in moves.items():
            slot = int(self._slot(np.array([key]))[0])
            while self.keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.to[slot] = key, to
        self.single = np.zeros(self.width, bool)
        for p in pieces:
            if len(p) == 1:
                self.single[self.code[ord(p)]] = True

    def find(self, text: str) -> int:
        """The piece that is this text, or -1."""
        node = np.zeros(1, np.int32)
        for c in text:
            hit, node = self.moved(node, self.code[[ord(c)]])
            if not hit[0]:
                return -1
        return int(self.piece[node[0]])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MULTIPLIER) >> self.shift).view(np.int64)

    def moved(self, node: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes have a move by the sign, and where it leads."""
        keys = node.astype(np.int64) * self.width + code
        slot = self._slot(keys)
        there = self.keys[slot]
        hit = there == keys
        open_ = np.flatnonzero(~hit & (there >= 0))
        while len(open_):  # slots that others hold
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.keys[slot[open_]]
            hit[open_] = there == keys[open_]
            open_ = open_[(there != keys[open_]) & (there >= 0)]
        return hit, self.to[slot]


@dataclass
class Block:
    """Strings of up to n signs as columns; edges has, by size, the places (start * columns + column) where pieces of that size start, and the pieces."""

    which: np.ndarray  # the strings' places in the caller's list
    signs: np.ndarray  # (n, columns) code points, 0 beyond the end
    sizes: np.ndarray
    edges: dict[int, tuple[np.ndarray, np.ndarray]]
    bare: np.ndarray  # (n, columns) signs that are no piece of their own

    @property
    def n(self) -> int:
        return len(self.signs)

    def weights(self, of_piece: np.ndarray, of_bare: np.ndarray | float) -> dict[int, np.ndarray]:
        """By size, the weights of the edges by start and column, -inf where there is none."""
        out = {}
        for size, (at, piece) in self.edges.items():
            out[size] = np.full(self.signs.shape, -np.inf)
            out[size].ravel()[at] = of_piece[piece]
        out[1][self.bare] = of_bare
        return out

    def ends(self, x: np.ndarray) -> np.ndarray:
        """Of an array by place, the entries at the strings' ends."""
        return x[self.sizes, np.arange(len(self.sizes))]


def blocks(trie: PieceTrie, strings: list[str], longest: int = 64) -> Iterator[Block]:
    """The lattices of the strings that are not longer than ``longest``, one of LENGTHS; empty ones are left out."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    kind = np.searchsorted(LENGTHS, sizes)
    order = np.argsort(kind, kind="stable")
    order = order[(sizes[order] > 0) & (sizes[order] <= longest)]
    bounds = [0, *(np.flatnonzero(np.diff(kind[order])) + 1), len(order)] if len(order) else [0]
    for a, b in zip(bounds, bounds[1:], strict=False):
        n = int(LENGTHS[kind[order[a]]])
        step = max(1, SIGNS // n)
        for k in range(a, b, step):
            yield _block(trie, strings, order[k : min(b, k + step)], sizes, n)


def _block(trie: PieceTrie, strings: list[str], which: np.ndarray, sizes: np.ndarray, n: int) -> Block:
    own, columns = sizes[which], len(which)
    flat = np.frombuffer("".join([strings[i] for i in which]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lane = np.repeat(np.arange(columns), own)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(own) - own, own)
    signs = np.zeros((n, columns), np.uint32)
    signs[place, lane] = flat
    most = min(trie.longest, n)
    codes = np.zeros((n + most, columns), np.int32)
    codes[:n] = trie.code[signs]
    codes = codes.ravel()
    edges = {1: (np.zeros(0, np.int64), np.zeros(0, np.int32))}
    at = np.flatnonzero(codes)
    node = np.zeros(len(at), np.int32)
    for size in range(1, most + 1):
        hit, to = trie.moved(node, codes[at + (size - 1) * columns])
        at, node = at[hit], to[hit]
        if not len(at):
            break
        found = trie.piece[node]
        there = found >= 0
        if there.any():
            edges[size] = at[there], found[there]
    bare = (signs > 0) & ~trie.single[codes[: n * columns].reshape(n, columns)]
    return Block(which, signs, own, edges, bare)


def best_paths(block: Block, of_piece: np.ndarray, of_bare: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pieces of all strings, one after the other; their numbers; sum of weights); a sign without a piece is -1.

    The path with the largest sum of weights; of equal ones that with the longer last piece, from the end to the front.
    """
    w, columns = block.weights(of_piece, of_bare), len(block.which)
    best = np.full((block.n + 1, columns), -np.inf)
    back = np.zeros((block.n + 1, columns), np.int32)
    best[0] = 0
    for e in range(1, block.n + 1):
        for size in sorted((k for k in w if k <= e), reverse=True):
            total = best[e - size] + w[size][e - size]
            better = total > best[e]
            np.copyto(best[e], total, where=better)
            np.copyto(back[e], size, where=better)
    piece = np.full((max(w) + 1, block.n * columns), -1, np.int32)
    for size, (at, own) in block.edges.items():
        piece[size, at] = own
    lane, at, steps = np.arange(columns), block.sizes.copy(), []
    while at.any():
        size = back[at, lane]
        steps.append(np.where(at > 0, piece[size, (at - size) * columns + lane], -2))
        at = at - size
    paths = np.array(steps[::-1], np.int32).T
    real = paths != -2
    return paths[real], real.sum(axis=1), block.ends(best)


def _logsum(terms: list[np.ndarray]) -> np.ndarray:
    if len(terms) == 1:
        return terms[0]
    t = np.array(terms)
    top = t.max(axis=0)
    top[np.isneginf(top)] = 0.0
    t -= top
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(t, out=t).sum(axis=0))


def forward(block: Block, w: dict[int, np.ndarray]) -> np.ndarray:
    """Log of the sum over all segmentations of each string up to each place, for the edges' log weights."""
    alpha = np.full((block.n + 1, len(block.which)), -np.inf)
    alpha[0] = 0
    for e in range(1, block.n + 1):
        alpha[e] = _logsum([alpha[e - k] + x[e - k] for k, x in w.items() if k <= e])
    return alpha


def expected(block: Block, of_piece: np.ndarray, w: dict[int, np.ndarray]) -> np.ndarray:
    """Expected numbers of each piece over the strings' segmentations."""
    columns = len(block.which)
    alpha, beta = forward(block, w), np.full((block.n + 1, columns), -np.inf)
    beta[block.sizes, np.arange(columns)] = 0
    for s in range(block.n - 1, -1, -1):
        sums = _logsum([x[s] + beta[s + k] for k, x in w.items() if k <= block.n - s])
        beta[s] = np.where(s < block.sizes, sums, beta[s])
    total, out = block.ends(alpha), np.zeros(len(of_piece))
    alpha, beta = (alpha - total).ravel(), beta.ravel()
    for size, (at, piece) in block.edges.items():
        share = np.exp(alpha[at] + of_piece[piece] + beta[at + size * columns])
        out += np.bincount(piece, share, len(of_piece))
    return out
