"""Modified Kneser-Ney smoothing by its definition, dense and in memory, on
characters folded to 32 classes: what the operator's tables are held against."""

import unicodedata

import numpy as np

from eddyline.llm.quality import _discounts_from

ORDER, CLASSES, PAD = 4, 32, 31
GRAMS = CLASSES ** ORDER


def _class_of(cp: int) -> int:
    c = chr(cp)
    if c == "\n":
        return 27
    if c.isspace() or cp < 32:
        return 26
    if c.isdigit():
        return 28
    if c in ".,;:!?'\"-()¡¿«»":
        return 29
    if not c.isalpha():
        return 30
    base = unicodedata.normalize("NFD", c.lower())[0]
    return ord(base) - 97 if "a" <= base <= "z" else cp % 26


_TABLE = np.array([30 if 0xD800 <= cp < 0xE000 else _class_of(cp) for cp in range(0x10000)] + [30], dtype=np.uint8)


def _gram_codes(cps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Code of the 4-gram of folded classes that ends at each character;
    before a text, padding."""
    c = _TABLE[cps].astype(np.int32)
    code = c.copy()
    pos = np.arange(len(c)) - np.repeat(starts[:-1], np.diff(starts))
    for back in range(1, ORDER):
        prev = np.full(len(c), PAD, dtype=np.int32)
        prev[back:] = c[:-back] if len(c) > back else prev[back:]
        prev[pos < back] = PAD
        code |= prev << (5 * back)
    return code


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Discount for counts 0, 1, 2 and 3 or more."""
    return _discounts_from([float((counts == k).sum()) for k in range(1, 5)])


def kneser_ney(counts: np.ndarray) -> list[tuple]:
    """The definition, dense and in memory, on folded classes.  4-gram counts → per order (shortest first) the observed grams'
    codes, their log10 probability, and the log10 back-off weight of every
    context code.  Lower orders count distinct left neighbours; probabilities
    interpolate with the next shorter order, the shortest with the uniform
    distribution over all classes but the padding."""
    levels = [counts.reshape((CLASSES,) * ORDER).astype(np.float64)]
    for _ in range(ORDER - 1):
        levels.insert(0, (levels[0] > 0).sum(axis=0).astype(np.float64))
    lower = np.full(CLASSES, 1.0 / (CLASSES - 1))
    lower[PAD] = 0.0
    out = []
    for c in levels:
        d = _discounts(c)[np.minimum(c, 3).astype(int)]
        total = c.sum(axis=-1, keepdims=True)
        left = d.sum(axis=-1, keepdims=True)          # mass the discounts set free
        safe = np.where(total > 0, total, 1.0)
        gamma = np.where(total > 0, left / safe, 1.0)
        p = np.maximum(c - d, 0.0) / safe + gamma * lower
        seen = np.flatnonzero(c.ravel() > 0)
        with np.errstate(divide="ignore"):
            out.append((seen.astype(np.int64), np.log10(p.ravel()[seen]), np.log10(gamma.ravel())))
        lower = p
    return out


def _hash(codes: np.ndarray) -> np.ndarray:
    """32-bit mix of a gram code (a bijection, so grams never collide)."""
    x = codes.astype(np.uint32)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return x ^ (x >> np.uint32(16))


class HashArrays:
    """The levels of :func:`kneser_ney` as sorted hash arrays, one pair for
    each order."""

    def __init__(self, levels: list[tuple]):
        self.levels = []
        for codes, logp, backoff in levels:
            h = _hash(codes)
            order = np.argsort(h)
            self.levels.append((h[order], logp[order].astype(np.float32), backoff.astype(np.float32)))

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each 4-gram's last character."""
        out = np.zeros(len(codes), dtype=np.float32)
        open_ = np.arange(len(codes))
        for n in range(ORDER, 0, -1):
            h, logp, backoff = self.levels[n - 1]
            code = codes[open_] & (CLASSES ** n - 1)
            want = _hash(code)
            at = np.minimum(np.searchsorted(h, want), max(0, len(h) - 1))
            hit = h[at] == want if len(h) else np.zeros(len(want), bool)
            out[open_[hit]] += logp[at[hit]]
            open_, code = open_[~hit], code[~hit]
            out[open_] += backoff[code >> 5]
        out[open_] += np.float32(-np.log10(CLASSES - 1))
        return out

    def dense(self) -> np.ndarray:
        """Every gram looked up once."""
        return self.lookup(np.arange(GRAMS, dtype=np.int64))
