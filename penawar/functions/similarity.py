"""Numpy kernels used inside Arrow tasks (mapInPandas / applyInPandas).

word_similarity(q, n): the greatest c / (|T(q)| + u - c) over contiguous extents of
the ordered trigram sequence of ``n``, with u the distinct trigrams of the extent and
c those of them that are also in T(q). Trigrams come from the words (runs of letters
and digits) of the lower-cased text, each padded with two blanks before and one after.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

_WORD = regex.compile(r"[\p{L}\p{N}]+")


@lru_cache(maxsize=65_536)
def word_trigrams(w: str) -> tuple[str, ...]:
    p = "  " + w + " "
    return tuple(p[i:i + 3] for i in range(len(w) + 1))


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def trigram_seq(text: str | None) -> list[str]:
    out: list[str] = []
    for w in words(text):
        out.extend(word_trigrams(w))
    return out


class Numbered:
    """Trigram sequences as numbers, given out as trigrams come up; a word is cut once."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self._words: dict[str, tuple[int, ...]] = {}

    def of(self, trigrams) -> list[int]:
        return [self.number.setdefault(t, len(self.number)) for t in trigrams]

    def seq(self, text: str | None) -> list[int]:
        out: list[int] = []
        for w in words(text):
            ids = self._words.get(w)
            if ids is None:
                ids = self._words[w] = tuple(self.of(word_trigrams(w)))
            out.extend(ids)
        return out


def prev_positions(ids: np.ndarray) -> np.ndarray:
    """For each position the previous position holding the same id, else -1."""
    prev = np.full(len(ids), -1, dtype=np.int32)
    last: dict[int, int] = {}
    for k, t in enumerate(ids.tolist()):
        prev[k] = last.get(t, -1)
        last[t] = k
    return prev


def extent_scores(matched: np.ndarray, prev: np.ndarray, length: np.ndarray, m: np.ndarray,
                  last: np.ndarray | None = None) -> np.ndarray:
    """Exact word similarity for P pairs at once.

    matched[P, L]: trigram at k of the name is in the query set;
    prev[P, L]: previous position of the same trigram in the name (-1 none);
    length[P]: sequence length of the name; m[P]: distinct query trigrams;
    last[P, L] (optional): position k holds the last occurrence of its trigram.

    Only extents starting on a matched trigram are scanned, and of those only
    starts whose left neighbour is not a matched trigram absent from the rest of
    the name: adding such a neighbour raises c and u by one, which never lowers
    c / (m + u - c), so the run start dominates.
    """
    P, L = matched.shape
    best = np.zeros(P, dtype=np.float64)
    if P == 0 or L == 0:
        return best
    k = np.arange(L, dtype=np.int32)[None, :]
    inside = k < length[:, None]
    mf = m.astype(np.float64)[:, None]
    if last is None:
        last = np.ones_like(matched)
    for a in range(L):
        starts = matched[:, a] & (a < length)
        if a > 0:
            starts &= ~(matched[:, a - 1] & last[:, a - 1])
        if not starts.any():
            continue
        rows = np.nonzero(starts)[0]
        pv = prev[rows, a:]
        ins = inside[rows, a:]
        first = (pv < a) & ins  # first occurrence of its trigram inside [a, k]
        u = np.cumsum(first, axis=1, dtype=np.int32)
        c = np.cumsum(first & matched[rows, a:], axis=1, dtype=np.int32)
        sc = c / (mf[rows] + (u - c))
        best[rows] = np.maximum(best[rows], np.where(ins, sc, 0.0).max(axis=1))
    return best


def extent_scores_unique(matched: np.ndarray, prev: np.ndarray, length: np.ndarray, m: np.ndarray,
                         last: np.ndarray) -> np.ndarray:
    """``extent_scores`` computed once per distinct (matched pattern, repeat
    structure of the name, length, |T(q)|): the score depends on nothing else,
    and many candidate pairs of a block share them."""
    P = matched.shape[0]
    if P < 64:
        return extent_scores(matched, prev, length, m, last)
    key = np.concatenate([np.packbits(matched, axis=1),
                          np.ascontiguousarray(prev.astype(np.int32)).view(np.uint8).reshape(P, -1),
                          length.astype(np.int32).view(np.uint8).reshape(P, -1),
                          m.astype(np.int32).view(np.uint8).reshape(P, -1)], axis=1)
    first, inverse = _distinct_rows(key)
    uniq = extent_scores(matched[first], prev[first], length[first], m[first], last[first])
    return uniq[inverse]


def _distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of a row for each distinct row of bytes, number of each row's distinct row)."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, :rows.shape[1]] = rows
    wide = wide.view(np.uint64)
    # grouped by a hash, which is then checked: sorting whole rows is far slower
    odd = np.random.default_rng(5).integers(0, 2**63, wide.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    code = np.zeros(len(wide), dtype=np.uint64)
    for j in range(wide.shape[1]):
        code = (code ^ (code >> np.uint64(29))) * odd[j] + wide[:, j]
    _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    inverse = inverse.ravel()
    if not np.array_equal(wide[first][inverse], wide):
        _, first, inverse = np.unique(wide, axis=0, return_index=True, return_inverse=True)
    return first, inverse.ravel()


def last_positions(prev: np.ndarray, length: np.ndarray) -> np.ndarray:
    """last[P, L]: True where no later position repeats the trigram."""
    P, L = prev.shape
    last = np.ones((P, L), dtype=bool)
    rows, cols = np.nonzero(prev >= 0)
    last[rows, prev[rows, cols]] = False
    return last


def word_similarity(q: str | None, n: str | None) -> float:
    """Single pair (helper for small batches and tests)."""
    tq = set(trigram_seq(q))
    seq = trigram_seq(n)
    if not tq or not seq:
        return 0.0
    vocab = {t: i for i, t in enumerate(dict.fromkeys(seq))}
    ids = np.array([vocab[t] for t in seq], dtype=np.int32)
    matched = np.array([t in tq for t in seq])[None, :]
    prev = prev_positions(ids)[None, :]
    length = np.array([len(seq)])
    return float(extent_scores(matched, prev, length, np.array([len(tq)]), last_positions(prev, length))[0])


def word_similarity_many(qs, ns) -> np.ndarray:
    """word_similarity for many (query, name) pairs: Python only cuts trigrams,
    the extent search runs once, vectorised over the padded batch."""
    P = len(qs)
    seqs, matched_rows, m = [], [], np.zeros(P, dtype=np.int64)
    for i, (q, n) in enumerate(zip(qs, ns)):
        tq = set(trigram_seq(q))
        seq = trigram_seq(n) if tq else []
        m[i] = len(tq)
        seqs.append(seq)
        matched_rows.append([t in tq for t in seq])
    lens = np.array([len(x) for x in seqs], dtype=np.int64)
    L = int(lens.max()) if P else 0
    out = np.zeros(P)
    if L == 0:
        return out
    matched = np.zeros((P, L), dtype=bool)
    prev = np.full((P, L), -1, dtype=np.int32)
    for i, (seq, mr) in enumerate(zip(seqs, matched_rows)):
        if not seq:
            continue
        matched[i, :len(seq)] = mr
        last: dict[str, int] = {}
        for j, t in enumerate(seq):
            prev[i, j] = last.get(t, -1)
            last[t] = j
    ok = (m > 0) & (lens > 0)
    idx = np.nonzero(ok)[0]
    if len(idx):
        out[idx] = extent_scores_unique(matched[idx], prev[idx], lens[idx], m[idx], last_positions(prev[idx], lens[idx]))
    return out


def word_similarity_brute(q: str | None, n: str | None) -> float:
    """Definition-level brute force over every extent (for tests only)."""
    tq = set(trigram_seq(q))
    seq = trigram_seq(n)
    best = 0.0
    for a in range(len(seq)):
        for b in range(a, len(seq)):
            ext = set(seq[a:b + 1])
            c = len(ext & tq)
            if tq:
                best = max(best, c / (len(tq) + len(ext) - c))
    return best
