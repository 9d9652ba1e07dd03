"""Linear-chain conditional random field with two tags, trained and applied in numpy.

All texts of a slice form one chain; at a text's first token the transition does not depend on the
tag before it, so texts stay independent. The chain is folded into blocks that step in parallel:
first every block's product of transition matrices, then the few products one after another, then
all tokens of all blocks.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np

BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6)
BLOCK = 256
CLIP = 25.0
MEMO_ENTRIES = 500_000
LONG_CHUNK = 64
WORD = re.compile(r"\w+")


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself, its prefixes, a constant."""
    names = ["=" + word, "*", *(f"{k}{word[:k]}" for k in PREFIXES if len(word) >= k)]
    return [zlib.crc32(n.encode("utf-8", "replace")) & (BUCKETS - 1) for n in names]


@dataclass
class Chain:
    """Emission weights by feature, and potentials of the tags' transitions and starts."""

    weights: np.ndarray
    transition: np.ndarray
    start: np.ndarray


def _folded(x: np.ndarray, fill) -> np.ndarray:
    rows = -(-len(x) // BLOCK)
    out = np.full(rows * BLOCK, fill, dtype=x.dtype)
    out[: len(x)] = x
    return np.ascontiguousarray(out.reshape(rows, BLOCK).T)


def forward_backward(
    emission: np.ndarray, first: np.ndarray, chain: Chain, pairs: bool = False
) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginal of tag 1 per token; with ``pairs`` also the expected counts of tag pairs.

    ``emission`` is the score of tag 1 over tag 0; ``first`` marks the first token of each text.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((2, 2)) if pairs else None
    e = np.exp(np.clip(_folded(emission.astype(np.float64), 0.0), -CLIP, CLIP))
    s = _folded(first, True)
    t, b = np.exp(chain.transition), np.exp(chain.start)
    m00, m10 = np.where(s, b[0], t[0, 0]), np.where(s, b[0], t[1, 0])
    m01, m11 = np.where(s, b[1], t[0, 1]) * e, np.where(s, b[1], t[1, 1]) * e
    rows, blocks = e.shape
    p00, p01, p10, p11 = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for i in range(rows):
        q00, q01 = p00 * m00[i] + p01 * m10[i], p00 * m01[i] + p01 * m11[i]
        q10, q11 = p10 * m00[i] + p11 * m10[i], p10 * m01[i] + p11 * m11[i]
        scale = 1.0 / (q00 + q01 + q10 + q11)
        p00, p01, p10, p11 = q00 * scale, q01 * scale, q10 * scale, q11 * scale
    enter, leave = np.empty((2, blocks)), np.empty((2, blocks))
    products = list(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist(), strict=True))
    x, y = 1.0, 0.0
    for c, (a00, a01, a10, a11) in enumerate(products):
        enter[0, c], enter[1, c] = x, y
        x, y = x * a00 + y * a10, x * a01 + y * a11
        x, y = x / (x + y), y / (x + y)
    x, y = 0.5, 0.5
    for c in range(blocks - 1, -1, -1):
        leave[0, c], leave[1, c] = x, y
        a00, a01, a10, a11 = products[c]
        x, y = a00 * x + a01 * y, a10 * x + a11 * y
        x, y = x / (x + y), y / (x + y)
    a0, a1 = np.empty_like(e), np.empty_like(e)
    x, y = enter
    for i in range(rows):
        u, v = x * m00[i] + y * m10[i], x * m01[i] + y * m11[i]
        scale = 1.0 / (u + v)
        x, y = u * scale, v * scale
        a0[i], a1[i] = x, y
    p = np.empty_like(e)
    counts = np.zeros((2, 2)) if pairs else None
    x, y = leave
    for i in range(rows - 1, -1, -1):
        zero, one = a0[i] * x, a1[i] * y
        p[i] = one / (zero + one)
        if pairs:
            f0, f1 = (a0[i - 1], a1[i - 1]) if i else enter
            joint = np.stack([f0 * m00[i] * x, f0 * m01[i] * y, f1 * m10[i] * x, f1 * m11[i] * y])
            joint /= joint.sum(axis=0)
            counts += (joint * ~s[i]).sum(axis=1).reshape(2, 2)
        u, v = m00[i] * x + m01[i] * y, m10[i] * x + m11[i] * y
        scale = 1.0 / (u + v)
        x, y = u * scale, v * scale
    return np.ascontiguousarray(p.T).ravel()[:n], counts


class Lexicon:
    """Distinct lower-case words of a sample, their features, and the texts as word numbers."""

    def __init__(self, texts: list[str]):
        known: dict[str, int] = {}
        number = lambda w: known.setdefault(w.lower(), len(known))
        self.texts = [np.array([number(w) for w in WORD.findall(t)], dtype=np.int32) for t in texts]
        self.words = list(known)
        # A row per word; BUCKETS stands for no feature.
        self.features = np.full((len(self.words), 2 + len(PREFIXES)), BUCKETS, dtype=np.int32)
        for row, word in zip(self.features, self.words, strict=True):
            found = features(word)
            row[: len(found)] = found


def _stretches(sizes: list[int], most: int = 400_000) -> list[tuple[int, int]]:
    """Runs of whole texts, of about ``most`` tokens each."""
    out, begin, end = [], 0, 0
    for size in sizes:
        if end > begin and end + size - begin > most:
            out.append((begin, end))
            begin = end
        end += size
    return [*out, (begin, end)] if end > begin else out


def train(lexicon: Lexicon, tags: list[np.ndarray], steps: int = 40, rate: float = 0.4, decay: float = 1e-5) -> Chain:
    """Maximum likelihood of the tags by full-batch Adagrad."""
    sizes = [len(t) for t in lexicon.texts if len(t)]
    if not sizes:
        return Chain(np.zeros(BUCKETS, dtype=np.float32), np.zeros((2, 2)), np.zeros(2))
    ids = np.concatenate(lexicon.texts)
    y = np.concatenate(tags).astype(np.float32)
    first = np.zeros(len(ids), dtype=bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    chain = Chain(np.zeros(BUCKETS + 1), np.zeros((2, 2)), np.zeros(2))
    whole = y.astype(np.int8)
    seen = np.bincount((2 * whole[:-1] + whole[1:])[~first[1:]], minlength=4).reshape(2, 2)
    begun = np.bincount(whole[first], minlength=2)
    past = [np.full(BUCKETS + 1, 1e-8), np.full((2, 2), 1e-8), np.full(2, 1e-8)]
    total, words = len(ids), len(lexicon.words)
    for _ in range(steps):
        by_word = chain.weights[lexicon.features].sum(axis=1)
        error, pair, opened = np.zeros(words), np.zeros((2, 2)), np.zeros(2)
        for a, b in _stretches(sizes):
            p, own = forward_backward(by_word[ids[a:b]], first[a:b], chain, pairs=True)
            error += np.bincount(ids[a:b], weights=y[a:b] - p, minlength=words)
            pair += own
            start = p[first[a:b]]
            opened += (1 - start).sum(), start.sum()
        slope = np.zeros(BUCKETS + 1)
        for column in lexicon.features.T:
            slope += np.bincount(column, weights=error, minlength=BUCKETS + 1)
        slope[BUCKETS] = 0
        slopes = [
            slope / total - decay * chain.weights,
            (seen - pair) / total - decay * chain.transition,
            (begun - opened) / total - decay * chain.start,
        ]
        for value, gradient, square in zip((chain.weights, chain.transition, chain.start), slopes, past, strict=True):
            square += gradient * gradient
            value += rate * gradient / np.sqrt(square)
    chain.weights = chain.weights[:BUCKETS].astype(np.float32)
    return chain


class Tagger:
    """Emissions and marginals of texts, with a memo of chunks between white space."""

    def __init__(self, chain: Chain):
        self.chain = chain
        self._memo: dict[str, bytes] = {}

    def _emissions(self, chunk: str) -> bytes:
        weights = self.chain.weights
        found = [weights[features(w.lower())].sum() for w in WORD.findall(chunk)]
        return np.array(found, dtype=np.float32).tobytes()

    def tag(self, texts: list[str | None]) -> list[np.ndarray]:
        """Marginals of tag 1, one array per text, one number per match of WORD."""
        memo, raw, new = self._memo, [], []
        for text in texts:
            chunks = (text or "").split()
            fresh = {c for c in chunks if c not in memo}
            for chunk in fresh:
                memo[chunk] = self._emissions(chunk)
            raw.append(np.frombuffer(b"".join(map(memo.__getitem__, chunks)), dtype=np.float32))
            new += fresh
        full = len(memo) > MEMO_ENTRIES
        for chunk in new:
            if full or len(chunk) > LONG_CHUNK:
                memo.pop(chunk, None)
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        ends = np.cumsum(sizes)
        first = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=bool)
        first[(ends - sizes)[sizes > 0]] = True
        emission = np.concatenate([np.zeros(0, dtype=np.float32), *raw])
        marginals, _ = forward_backward(emission, first, self.chain)
        return np.split(marginals, ends[:-1]) if len(ends) else []
