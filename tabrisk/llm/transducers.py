"""Count transducers: acyclic automata that read an n-gram word by word and give its number of occurrences.

A transducer keeps its words sorted in byte order and its states level by level, each level in the order of its n-grams.
An arc is an entry of a level: the state it leaves (its place in the level above), its word, and the weight of the n-gram read so
far; weight 0 marks a prefix that is only passed through. Building from sorted n-grams appends level to level and never goes
back to an earlier one; union, pruning, cutting and composition go through the levels once, as array operations.

N-grams are ordered word by word, so a prefix comes before what it begins. All n-grams between two bounds in that order
are a prefix range: transducers cut at the same bounds can be united range by range.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left

import numpy as np

#: an n-gram as a tuple of words in UTF-8
Gram = tuple[bytes, ...]


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _sums(of: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Exact sums by group (bincount adds floating-point numbers, which are exact below 2^53 only)."""
    if int(weights.sum()) < 1 << 53:
        return np.bincount(of, weights, size).astype(np.int64)
    out = np.zeros(size, np.int64)
    np.add.at(out, of, weights)
    return out


class Transducer:
    def __init__(self, words: list[bytes], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.words, self.levels = words, levels

    def __len__(self) -> int:
        return sum(len(w) for _, _, w in self.levels)

    @classmethod
    def of_tokens(cls, tokens: np.ndarray, words: list[bytes], longest: int) -> Transducer:
        """All n-grams of 1 to `longest` neighbouring tokens; a token is a place in `words` (any order, all different) or -1, which parts."""
        order = sorted(range(len(words)), key=words.__getitem__)
        rank = np.empty(len(words) + 1, np.int64)
        rank[order], rank[-1] = np.arange(len(words)), -1
        seq = rank[tokens]
        at, levels = np.flatnonzero(seq >= 0), []
        parent = np.zeros(len(at), np.int64)
        for d in range(longest):
            key, name, count = np.unique(parent * (len(words) + 1) + seq[at + d], return_inverse=True, return_counts=True)
            levels.append((key // (len(words) + 1), key % (len(words) + 1), count.astype(np.int64)))
            go = at + d + 1 < len(seq)
            go[go] = seq[at[go] + d + 1] >= 0
            at, parent = at[go], name[go]
        return cls([words[i] for i in order], levels)

    @classmethod
    def of_grams(cls, grams: list[Gram], longest: int) -> Transducer:
        """An acceptor of different n-grams: weight 1 for each of them, 0 for their prefixes."""
        words = sorted({w for g in grams for w in g})
        at = {w: i for i, w in enumerate(words)}
        rows = np.full((len(grams), longest), -1, np.int64)
        for i, g in enumerate(grams):
            rows[i, :len(g)] = [at[w] for w in g]
        here, parent, levels = np.arange(len(grams)), np.zeros(len(grams), np.int64), []
        for d in range(longest):
            on = rows[here, d] >= 0
            here, parent = here[on], parent[on]
            key, name = np.unique(parent * (len(words) + 1) + rows[here, d], return_inverse=True)
            ends = np.ones(len(here), bool) if d + 1 == longest else rows[here, d + 1] < 0
            levels.append((key // (len(words) + 1), key % (len(words) + 1), np.bincount(name[ends], minlength=len(key)).astype(np.int64)))
            parent = name
        return cls(words, levels)

    @classmethod
    def union(cls, parts: list[Transducer]) -> Transducer:
        """The transducer of all n-grams of `parts`, with the sums of their weights."""
        words = sorted(set().union(*(p.words for p in parts)))
        at = {w: i for i, w in enumerate(words)}
        labels = [np.array([at[w] for w in p.words], np.int64) for p in parts]
        names, levels = [np.zeros(1, np.int64)] * len(parts), []
        for d in range(max((len(p.levels) for p in parts), default=0)):
            here = [p.levels[d] for p in parts]
            keys = np.concatenate([n[parent] * (len(words) + 1) + lab[label] for n, lab, (parent, label, _) in zip(names, labels, here, strict=True)])
            key, name = np.unique(keys, return_inverse=True)
            levels.append((key // (len(words) + 1), key % (len(words) + 1), _sums(name, np.concatenate([w for _, _, w in here]), len(key))))
            names = np.split(name, np.cumsum([len(w) for _, _, w in here])[:-1])
        return cls(words, levels)

    def pruned(self, least: int) -> Transducer:
        """Without n-grams of a weight below `least`; their states stay only as far as others need them."""
        keep = [w >= least for _, _, w in self.levels]
        for d in range(len(keep) - 1, 0, -1):
            keep[d - 1][self.levels[d][0][keep[d]]] = True
        new, levels = np.zeros(1, np.int64), []
        for (parent, label, weight), on in zip(self.levels, keep, strict=True):
            levels.append((new[parent[on]], label[on], np.where(weight[on] >= least, weight[on], 0)))
            new = np.cumsum(on) - 1
        used = np.unique(np.concatenate([label for _, label, _ in levels]))
        return Transducer([self.words[i] for i in used], [(p, np.searchsorted(used, label), w) for p, label, w in levels])

    def place(self, bound: Gram) -> list[int]:
        """For each level the number of its n-grams that come before `bound`."""
        found, lo, hi, exact = [], 0, len(self.levels[0][0]), True
        for d, (parent, label, _) in enumerate(self.levels):
            if d:
                # below: the n-grams that go on from `cut`, or all that go on from an n-gram before it
                lo = int(np.searchsorted(parent, cut))
                hi = int(np.searchsorted(parent, cut, "right")) if exact else lo
            if exact and d < len(bound):
                w = bisect_left(self.words, bound[d])
                cut = lo + int(np.searchsorted(label[lo:hi], w))
                exact = cut < hi and w < len(self.words) and self.words[w] == bound[d] and label[cut] == w
            else:
                cut, exact = lo, False
            # a proper prefix of the bound comes before it
            found.append(cut + (exact and d + 1 < len(bound)))
        return found

    def cut(self, bounds: list[Gram]) -> list[Transducer]:
        """The parts before, between and from the sorted `bounds` on; prefixes of a part's first n-gram get weight 0."""
        edges = [[0] * len(self.levels), *map(self.place, bounds), [len(w) for _, _, w in self.levels]]
        return [self._between(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def _between(self, lo: list[int], hi: list[int]) -> Transducer:
        first = [min(a, b) for a, b in zip(lo, hi, strict=True)]
        for d in range(len(first) - 1, 0, -1):
            if first[d] < hi[d]:
                first[d - 1] = min(first[d - 1], int(self.levels[d][0][first[d]]))
        levels = []
        for d, (parent, label, weight) in enumerate(self.levels):
            part = slice(first[d], max(first[d], hi[d]))
            w = weight[part].copy()
            w[:max(0, lo[d] - first[d])] = 0
            levels.append((parent[part] - (first[d - 1] if d else 0), label[part], w))
        used = np.unique(np.concatenate([label for _, label, _ in levels]))
        return Transducer([self.words[i] for i in used], [(p, np.searchsorted(used, label), w) for p, label, w in levels])

    def composed(self, counts: Transducer) -> Transducer:
        """Composition: this acceptor's n-grams with the weights that `counts` gives them (0 for those it doesn't read)."""
        at = {w: i for i, w in enumerate(counts.words)}
        to = np.array([at.get(w, -1) for w in self.words], np.int64)
        reach, levels = np.zeros(1, np.int64), []
        base = len(counts.words) + 1
        for d, (parent, label, weight) in enumerate(self.levels):
            if d >= len(counts.levels):
                levels.append((parent, label, np.zeros(len(label), np.int64)))
                continue
            cp, cl, cw = counts.levels[d]
            have, up, want = cp * base + cl, reach[parent], to[label]
            key = up * base + want
            i = np.minimum(np.searchsorted(have, key), max(0, len(have) - 1))
            ok = (up >= 0) & (want >= 0) & ((have[i] == key) if len(have) else False)
            reach = np.where(ok, i, -1)
            levels.append((parent, label, np.where(ok & (weight > 0), cw[i] if len(cw) else 0, 0)))
        return Transducer(self.words, levels)

    def grams(self) -> list[tuple[bytes, int]]:
        """Words joined by spaces, and weight, of every n-gram that has one."""
        out, above = [], [b""]
        for d, (parent, label, weight) in enumerate(self.levels):
            here = [(above[p] + b" " + self.words[x]) if d else self.words[x] for p, x in zip(parent.tolist(), label.tolist(), strict=True)]
            out += [(g, w) for g, w in zip(here, weight.tolist(), strict=True) if w]
            above = here
        return out

    def dump(self) -> bytes:
        """Words, then of each level the number of arcs of every state above, words and weights, in the narrowest types."""
        parts, above = [b" ".join(self.words)], 1
        for parent, label, weight in self.levels:
            parts += [b.dtype.str.encode()[1:] + b.tobytes() for b in (_narrow(np.bincount(parent, minlength=above)), _narrow(label), _narrow(weight))]
            above = len(label)
        return zlib.compress(struct.pack(f"<{len(parts) + 1}Q", len(parts), *map(len, parts)) + b"".join(parts), 1)

    @classmethod
    def load(cls, data: bytes) -> Transducer:
        data = zlib.decompress(data)
        n = struct.unpack_from("<Q", data)[0]
        sizes, at, parts = struct.unpack_from(f"<{n}Q", data, 8), 8 * (n + 1), []
        for size in sizes:
            parts.append(data[at:at + size])
            at += size
        arrays = [np.frombuffer(p[2:], np.dtype(p[:2].decode())).astype(np.int64) for p in parts[1:]]
        levels = [(np.repeat(np.arange(len(n)), n), label, weight) for n, label, weight in zip(arrays[::3], arrays[1::3], arrays[2::3], strict=True)]
        return cls(parts[0].split(b" ") if parts[0] else [], levels)
