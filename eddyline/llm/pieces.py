"""SentencePiece encoding by Gumbel top-k without replacement, and decoding.

A text is a lattice of vocabulary pieces.  Each piece of merge rank ``r``
weighs 1 / (r + 1); a path's probability is the product of its weights over
the sum of all paths'.  ``sample_pieces`` emits the ``k`` paths with the
largest Gumbel-perturbed log-probabilities, that is a sample of ``k`` distinct
segmentations without replacement, by a perturbed A* search:

* backward sums over the lattice give every edge its exact conditional
  probability; a path drawn from them is the best of the whole set;
* the rest of a set falls into one subset for each step of that path (same
  pieces before the step, another piece at it).  Every subset's mass is known,
  so its best perturbed value is drawn as a Gumbel truncated at its parent's;
* the queue of subsets is the search frontier: the best is taken off, its best
  path drawn, its own rest queued, until ``k`` paths are out.  The best value
  left over is the threshold behind the inclusion scores.

All random numbers are hashes of (row key, sample, place), so results depend
neither on partitions nor on batches.  No piece spans a word mark in its
inside, so lattices are built once for each distinct word of a slice of text,
and those of words that a slice repeats are kept for the task's later slices;
everything below is arrays over such a slice, whatever the text's length.

``decode_pieces`` turns ids back into text.  The round trip is exact but for a
literal U+2581, which is the word mark and decodes as a space.

Defined cases: null and empty texts have one segmentation, without pieces and
with probability 1; a text with fewer than ``k`` segmentations gives fewer
rows; rows with equal keys and texts get equal samples; null keys hash as
null; an empty table gives an empty result; other columns are carried.
"""

from __future__ import annotations

import heapq
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddyline.llm.common import bound_batches, fresh, load_table, mix64, prepare, text_ranges

MARK = "▁"
SEED = 20240607
SLICE = 540_000         # characters held at once by a worker
ROWS = 512              # lists decoded at once by a worker
KEEP = 1 << 20          # places of frequent words that a worker keeps for later slices
NEAR = 64               # steps of a path looked at first
SPREAD = 41.0           # Gumbels of 53-bit numbers between 0 and 1 are within -3.7 and 36.8


def default_model() -> str:
    """Path of the public 32k model where the tokenizer files are installed."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces of a SentencePiece model file as a byte trie (read on the
    driver; bounded by the vocabulary, and sent to the workers)."""

    def __init__(self, model_file: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        self.unk = sp.unk_id()
        self.byte_id = np.full(256, self.unk, dtype=np.int32)
        self.text = [b""] * n
        rank = np.zeros(n)
        edges: dict[tuple[int, int], int] = {}
        node_id = [-1]
        self.longest = 1
        cut = True
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            if sp.is_byte(i):
                b = int(piece[1:-1], 16)
                self.byte_id[b] = i
                self.text[i] = bytes([b])
                continue
            if MARK in piece.lstrip(MARK):
                raise ValueError("a piece spans two words")
            cut &= "\n" not in piece
            raw = piece.encode()
            self.text[i] = raw
            self.longest = max(self.longest, len(raw))
            rank[i] = -sp.get_score(i)
            node = 0
            for b in raw:
                if (node, b) not in edges:
                    edges[node, b] = len(node_id)
                    node_id.append(-1)
                node = edges[node, b]
            node_id[node] = i
        self.logw = -np.log(np.maximum(rank, 0) + 1.0)
        self.logw_byte = float(self.logw.min() - 1.0)
        self.node_id = np.array(node_id, dtype=np.int32)
        self.edges = np.array([(a, b, c) for (a, b), c in edges.items()], dtype=np.int32).reshape(-1, 3)
        self.cut = cut
        self.chunk = re.compile(rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if cut else rf"{MARK}*[^{MARK}]+|{MARK}+")
        self.size = np.array([len(t) for t in self.text], dtype=np.int32)
        self._next = None

    def next(self) -> np.ndarray:
        if self._next is None:
            self._next = np.zeros(len(self.node_id) * 256,
                                  dtype=np.uint16 if len(self.node_id) < 65536 else np.int32)
            self._next[self.edges[:, 0] * 256 + self.edges[:, 1]] = self.edges[:, 2]
        return self._next

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words of many texts end to end, as UTF-8 bytes, and the place of each
        text's first (one place more than texts): what ``chunk`` finds, by
        comparing bytes."""
        texts = texts.cast(pa.large_binary())
        lead = pc.if_else(pc.equal(pc.binary_length(texts), 0), b"", MARK.encode())
        texts = pc.binary_join_element_wise(lead.cast(pa.large_binary()), pc.replace_substring(texts, " ", MARK),
                                            pa.scalar(b"", pa.large_binary()))
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        if ends[0] == ends[-1]:
            return pa.array([], pa.large_binary()), np.zeros(len(ends), dtype=np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[:ends[-1]]
        first = np.zeros(len(raw) + 1, dtype=bool)
        mark = np.flatnonzero(raw[:-2] == 0xE2)
        mark = mark[(raw[mark + 1] == 0x96) & (raw[mark + 2] == 0x81)]
        first[mark[np.diff(mark, prepend=-9) != 3]] = True
        if self.cut:
            line = np.flatnonzero(raw == 10)
            first[line] = first[line + 1] = True
        first[ends] = True
        cuts = np.flatnonzero(first)
        words = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), data])
        return words, np.searchsorted(cuts, ends)

    def chunks(self, text: str) -> list[str]:
        return [w.decode() for w in self.split(pa.array([text], pa.string()))[0].to_pylist()]


class Lattice:
    """Edges of the lattices of many words, grouped by start position, longer
    pieces first, with conditional log-probabilities.  Words that a slice has
    more than once stay for the next slices, until they fill ``KEEP`` places;
    the others' places are used again.  A word's edges depend on it alone."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.known: dict[bytes, int] = {}                      # kept words, and what they take
        self.places = self.edges = 0
        self.buf = np.zeros(0, dtype=np.uint8)                 # by place
        self.off = self.deg = np.zeros(0, dtype=np.int32)
        self.src = self.dst = self.pid = np.zeros(0, dtype=np.int32)     # by edge
        self.logq = self.cum = np.zeros(0)

    def add(self, words: pa.Array, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First places and ends of ``words``, until the next call; those
        ``often`` stay."""
        if self.places > KEEP:
            self.known, self.places, self.edges = {}, 0, 0
        size = pc.binary_length(words).to_numpy(zero_copy_only=False)
        words = words.to_numpy(zero_copy_only=False)
        start = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(start < 0)
        if len(new):
            new = new[np.argsort(~often[new], kind="stable")]
            own = words[new].tolist()
            start[new] = self._build(own, size[new], self.places, self.edges)
            stay = int(often[new].sum())
            if stay:
                self.known.update(zip(own[:stay], start[new[:stay]].tolist()))
                end = start[new[stay - 1]] + size[new[stay - 1]] + 1
                self.places = int(end)
                self.edges = int(self.off[end - 1])            # an end has no edges
        return start, start + size

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """``values`` into an array from ``at`` on; it grows and shrinks with what it holds."""
        have, need = getattr(self, name), at + len(values)
        if not need <= len(have) <= 4 * need:
            setattr(self, name, np.empty(need + need // 4, dtype=have.dtype))
            getattr(self, name)[:at] = have[:at]
        getattr(self, name)[at:need] = values

    def _build(self, words: list[bytes], size: np.ndarray, place: int, edge: int) -> np.ndarray:
        """Lattices of ``words`` behind the kept places and edges; their first places."""
        vocab = self.vocab
        start = np.cumsum(size + 1) - (size + 1)
        ends = start + size
        padded = np.frombuffer(b"\0".join(words) + b"\0" * (vocab.longest + 1), dtype=np.uint8)
        buf = padded[:int(ends[-1]) + 1]
        inside = np.ones(len(buf), dtype=bool)
        inside[ends] = False
        head = np.flatnonzero(inside & ((buf & 0xC0) != 0x80))
        remain = np.repeat(ends, size + 1) - np.arange(len(buf))
        after = np.r_[head[1:], len(buf)]
        step = np.minimum(after - head, remain[head])          # bytes of the character
        trie, node_id = vocab.next(), vocab.node_id
        head = head.astype(np.int32)                           # positions fit: a slice is bounded
        alive, state = head, np.zeros(len(head), dtype=np.int32)
        found = []                                             # by depth: starts and piece ids
        single = np.zeros(len(buf), dtype=bool)
        width = np.zeros(len(buf), dtype=np.int32)
        width[head] = step
        for depth in range(1, vocab.longest + 1):
            state = trie[state * 256 + padded[alive + (depth - 1)]].astype(np.int32)
            live = np.flatnonzero(state)                       # no piece has the byte 0 between words
            alive, state = alive[live], state[live]
            if not len(alive):
                break
            pid = node_id[state]
            hit = np.flatnonzero(pid >= 0)
            at = alive[hit]
            found.append((at, pid[hit]))
            if depth <= 4:
                single[at[width[at] == depth]] = True
        bare = head[~single[head]]
        deg = np.bincount(np.concatenate([*(at for at, _ in found), bare]), minlength=len(buf)).astype(np.int32)
        off = (np.cumsum(deg) - deg).astype(np.int32)
        n = int(deg.sum())
        src = np.repeat(np.arange(len(buf), dtype=np.int32), deg)
        pid = np.full(n, -1, dtype=np.int32)
        cursor = off.copy()
        for at, found_id in reversed(found):
            e = cursor[at]
            pid[e] = found_id
            cursor[at] = e + 1
        dst, w = src + vocab.size[pid], vocab.logw[pid]
        e = cursor[bare]
        dst[e], w[e] = bare + width[bare], width[bare] * vocab.logw_byte
        # backward sums, from the words' ends: beta = log of the mass of all paths to the end
        beta = np.full(len(buf), -np.inf)
        beta[ends] = 0.0
        many = head[np.argsort(-deg[head].astype(np.int16), kind="stable")]      # most edges first
        left = remain[many]
        order = np.argsort(left.astype(np.uint16) if len(left) and left.max() < 65536 else left, kind="stable")
        heads, left = many[order], left[order]
        e, more = off[heads], deg[heads]
        w0, dst0 = w[e], dst[e]
        bounds = np.r_[np.flatnonzero(np.r_[True, left[1:] != left[:-1]]), len(left)] if len(left) else [0]
        for a, b in zip(bounds[:-1], bounds[1:]):
            acc = w0[a:b] + beta[dst0[a:b]]
            ej, less = e[a:b], -more[a:b]
            for j in range(1, more[a]):
                ej = ej[:np.searchsorted(less, -j)] + 1
                acc[:len(ej)] = np.logaddexp(acc[:len(ej)], w[ej] + beta[dst[ej]])
            beta[heads[a:b]] = acc
        logq = w + beta[dst] - beta[src]
        q = np.exp(np.minimum(logq, 0.0))
        cum = q.copy()                                         # summed place by place, so that
        e, less = off[many], -deg[many]                        # rounding never depends on the slice
        acc = q[e]
        for j in range(1, -less[0] if len(less) else 0):
            e = e[:np.searchsorted(less, -j)] + 1
            acc = acc[:len(e)] + q[e]
            cum[e] = acc
        cum[off[head] + deg[head] - 1] = np.inf
        for name, values in (("buf", buf), ("off", off + edge), ("deg", deg)):
            self._put(name, place, values)
        for name, values in (("src", src + place), ("dst", dst + place), ("pid", pid), ("logq", logq), ("cum", cum)):
            self._put(name, edge, values)
        return start + place

    def log_rest(self, e: np.ndarray) -> np.ndarray:
        """Log-probability of the other edges from the places of ``e``."""
        with np.errstate(divide="ignore"):
            rest = np.log(np.maximum(-np.expm1(np.minimum(self.logq[e], 0.0)), 1e-300))
        return np.where(self.deg[self.src[e]] == 1, -np.inf, rest)


def _unit(h: np.ndarray) -> np.ndarray:
    """Hashes to numbers strictly between 0 and 1."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def _draw(lat: Lattice, pos: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One path from each ``pos`` to ``end``: edges of all paths end to end,
    and the number of edges of each."""
    rounds, count = [], np.zeros(len(pos), dtype=np.int64)
    act, it = np.flatnonzero(pos < end), 0
    pos, end, key = pos[act], end[act], key[act]
    while len(act):
        u = _unit(mix64(key + np.uint64(it)))
        e = lat.off[pos]
        lag = np.flatnonzero(u > lat.cum[e])
        while len(lag):
            e[lag] += 1
            lag = lag[u[lag] > lat.cum[e[lag]]]
        rounds.append((act, e))
        count[act] += 1
        pos = lat.dst[e]
        go = np.flatnonzero(pos < end)
        act, pos, end, key = act[go], pos[go], end[go], key[go]
        it += 1
    off = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), dtype=np.int64)
    for it, (act, e) in enumerate(rounds):
        out[off[act] + it] = e
    return out, count


class _Slice:
    """The search over the texts of one slice."""

    def __init__(self, vocab: Vocabulary, texts: pa.Array | list[str], keys: np.ndarray, k: int,
                 lat: Lattice | None = None):
        words, self.first = vocab.split(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        self.k, self.vocab = k, vocab
        self.n_words = np.diff(self.first)
        words = words.dictionary_encode()
        self.word = words.indices.to_numpy(zero_copy_only=False)
        self.lat = Lattice(vocab) if lat is None else lat
        self.start, self.end = self.lat.add(words.dictionary, np.bincount(self.word, minlength=1) > 1)
        self.keys = keys.view(np.uint64)

    def _key(self, doc, sample: int, kind: int):
        with np.errstate(over="ignore"):
            return mix64(self.keys[doc] + np.uint64(sample * 4 + kind))

    def search(self) -> list[list[tuple]]:
        """Per text: (edges, log-probability, perturbed value, threshold), best first."""
        n, k, lat = len(self.n_words), self.k, self.lat
        out: list[list] = [[] for _ in range(n)]
        docs = np.arange(n)
        root = -np.log(-np.log(_unit(self._key(docs, 0, 0))))
        if not len(self.word):
            return [[(np.zeros(0, np.int64), 0.0, float(root[d]), -np.inf)] for d in range(n)]
        owner = np.repeat(docs, self.n_words)
        place = np.arange(len(self.word)) - np.repeat(self.first[:-1], self.n_words)
        paths, queue, shut = [dict() for _ in range(n)], [[] for _ in range(n)], {}
        # what to draw next: per text its sample, prefix, step and subset's best value
        todo = [(d, np.zeros(0, np.int64), np.zeros(0, np.int64), -1, float(root[d])) for d in docs]
        for sample in range(k):
            if not todo:
                break
            ds = np.array([t[0] for t in todo])
            occ, pos = [], []
            for d, edges, words, turn, _ in todo:
                if turn < 0:
                    occ.append(np.arange(self.first[d], self.first[d + 1]))
                    pos.append(self.start[self.word[occ[-1]]])
                else:                                # go on behind the turn's edge, in its word
                    occ.append(np.arange(words[turn], self.first[d + 1]))
                    p = self.start[self.word[occ[-1]]]
                    p[0] = lat.dst[edges[turn]]
                    pos.append(p)
            occ_all = np.concatenate(occ)
            ends = self.end[self.word[occ_all]]
            with np.errstate(over="ignore"):
                key = mix64(self._key(docs, sample, 1)[owner[occ_all]] + place[occ_all].astype(np.uint64))
            drawn, count = _draw(lat, np.concatenate(pos), ends, key)
            drawn_word = np.repeat(occ_all, count)
            cut = np.r_[0, np.cumsum(np.add.reduceat(np.r_[count, 0], np.r_[0, np.cumsum([len(o) for o in occ])][:-1])
                                     * (np.array([len(o) for o in occ]) > 0))]
            full, words_of, turns, bounds = [], [], [], []
            for j, (d, edges, words, turn, best) in enumerate(todo):
                e = np.concatenate([edges, drawn[cut[j]:cut[j + 1]]])
                w = np.concatenate([words, drawn_word[cut[j]:cut[j + 1]]])
                paths[d][sample] = (e, w)
                full.append(e)
                words_of.append(w)
                turns.append(turn)
                bounds.append(best)
            self._queue_rest(sample, ds, full, np.array(turns), np.array(bounds), queue, shut, out)
            todo = []
            for d in ds:
                if not queue[d]:
                    continue
                best, s, t = queue[d][0]
                if sample + 1 == k:
                    continue
                heapq.heappop(queue[d])
                edges, words = paths[d][s]
                closed = shut.get((d, s, t), [edges[t]])
                pick = self._other(d, sample + 1, edges[t], closed)
                shut[d, sample + 1, t] = closed + [pick]
                todo.append((d, np.r_[edges[:t], pick], words[:t + 1], t, -best))
        for d in range(n):
            left = -queue[d][0][0] if queue[d] else -np.inf
            out[d] = [(*x, left) for x in out[d]]
        return out

    def _free(self, pos: int, closed: list) -> np.ndarray:
        lo = int(self.lat.off[pos])
        return np.array([e for e in range(lo, lo + int(self.lat.deg[pos])) if e not in closed], dtype=np.int64)

    def _other(self, d: int, sample: int, edge: int, closed: list) -> int:
        """An edge from the same place, none of ``closed``, by probability."""
        lat = self.lat
        p = lat.src[edge]
        e = self._free(p, closed)
        q = np.exp(lat.logq[e] - lat.logq[e].max())
        u = _unit(self._key(np.array([d]), sample, 2))[0] * q.sum()
        return int(e[min(int(np.searchsorted(np.cumsum(q), u, side="right")), len(e) - 1)])

    def _queue_rest(self, sample, ds, full, turns, bounds, queue, shut, out) -> None:
        """Report the paths, and queue the subsets that each leaves."""
        lat = self.lat
        size = np.array([len(e) for e in full], dtype=np.int64)
        start = np.cumsum(size) - size
        e = np.concatenate(full)
        logq = np.minimum(lat.logq[e], 0.0)
        before = np.zeros(len(e))
        for a, n in zip(start.tolist(), size.tolist()):              # each text by itself
            if n > 1:
                np.cumsum(logq[a:a + n - 1], out=before[a + 1:a + n])
        lo = np.maximum(turns, 0)
        turned = np.flatnonzero(turns >= 0)
        others = np.full(len(ds), -np.inf)
        for j in turned:
            free = self._free(lat.src[full[j][turns[j]]], shut[ds[j], sample, int(turns[j])])
            if len(free):
                others[j] = np.log(np.exp(lat.logq[free]).sum())

        def masses(n):
            """Of ``n`` subsets of each path, from its turn on; their steps; where each path's begin."""
            cut = np.cumsum(n) - n
            step = np.arange(n.sum()) - np.repeat(cut - lo, n)
            at = step + np.repeat(start, n)
            mass = before[at] + lat.log_rest(e[at])
            mass[cut[turned]] = before[at[cut[turned]]] + others[turned]
            return mass, step, cut

        # Gumbels differ by less than SPREAD, and no mass is above ``before``, which never rises: behind
        # the step where it is below the k-th largest mass less SPREAD, no subset is among the k best
        near = np.minimum(size - lo, NEAR)
        mass, _, cut = masses(near)
        floor = np.full(len(ds), -np.inf)
        for j, (a, n) in enumerate(zip(cut.tolist(), near.tolist())):
            if n >= self.k:
                floor[j] = np.partition(mass[a:a + n], n - self.k)[n - self.k] - SPREAD
        above = np.r_[0, np.cumsum(before >= np.repeat(floor, size))]
        n = above[start + size] - above[start] - lo
        mass, step, cut = masses(n)
        with np.errstate(over="ignore", divide="ignore"):
            h = mix64(np.repeat(self._key(ds, sample, 3), n) + step.astype(np.uint64))
            g = mass - np.log(-np.log(_unit(h)))
            g = -np.logaddexp(-np.repeat(bounds, n), -g)
        for j, d in enumerate(ds):
            out[d].append((full[j], float(logq[start[j]:start[j] + size[j]].sum()), float(bounds[j])))
            own = g[cut[j]:cut[j] + n[j]]
            top = np.arange(len(own)) if len(own) <= self.k else np.argpartition(-own, self.k - 1)[:self.k]
            for t in top:
                if own[t] > -np.inf:
                    heapq.heappush(queue[d], (-float(own[t]), sample, int(t + lo[j])))

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of a path; a character outside the vocabulary gives its bytes."""
        return self.ids_of([edges])[0]

    def ids_of(self, paths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of many paths end to end, and the number of each."""
        count = np.array([len(p) for p in paths], dtype=np.int64)
        if not count.sum():
            return np.zeros(0, np.int32), count
        lat, edges = self.lat, np.concatenate(paths)
        pid = lat.pid[edges]
        bare = np.flatnonzero(pid < 0)
        if not len(bare):
            return pid, count
        size, src = np.ones(len(pid), dtype=np.int64), lat.src[edges[bare]]
        size[bare] = lat.dst[edges[bare]] - src
        end = np.r_[0, np.cumsum(size)]
        off, cut = end[:-1], np.r_[0, np.cumsum(count)]
        out = np.zeros(int(end[-1]), dtype=np.int32)
        out[off] = pid
        for j in range(4):
            b = np.flatnonzero(size[bare] > j)
            out[off[bare[b]] + j] = self.vocab.byte_id[lat.buf[src[b] + j]]
        return out, np.diff(end[cut])


def log_inclusion(logp: float, threshold: float) -> float:
    """log(1 - exp(-exp(logp - threshold))): how likely a path of this
    probability beats the threshold; 0 if no path was left over."""
    if threshold == -np.inf:
        return 0.0
    x = logp - threshold
    return x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 700.0)))))


def sample_pieces(docs: DataFrame, k: int = 2, key_col: str = "doc_id", text_col: str = "text",
                  carry: list[str] | None = None, model_file: str | None = None,
                  seed: int = SEED) -> DataFrame:
    """``carry`` columns (the key by default), ``rank`` (1 to k), ``ids``,
    ``n_pieces``, ``log_prob``, ``perturbed``, ``log_inclusion``: the k
    segmentations of each row, best perturbed value first.  Added names that
    clash with a carried column get underscores."""
    carry = [key_col] if carry is None else carry
    bound_batches(docs.sparkSession)
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_file or default_model()))
    src = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)],
                      F.xxhash64(F.lit(seed), F.col(f"`{key_col}`")).alias("_key"),
                      F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    added = [("rank", T.IntegerType()), ("ids", T.ArrayType(T.IntegerType())), ("n_pieces", T.LongType()),
             ("log_prob", T.DoubleType()), ("perturbed", T.DoubleType()), ("log_inclusion", T.DoubleType())]
    schema = T.StructType([src.schema[i] for i in range(len(carry))]
                          + [T.StructField(f"a{i}", t) for i, (_, t) in enumerate(added)])

    def run(batches):
        lat = Lattice(vocab.value)
        for batch in batches:
            texts = batch.column("_text")
            keys = batch.column("_key").to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in text_ranges(pc.utf8_length(texts).to_numpy(zero_copy_only=False), SLICE):
                part = _Slice(vocab.value, texts.slice(lo, hi - lo), keys[lo:hi], k, lat)
                rows, paths, cols = [], [], ([], [], [], [])
                for d, found in enumerate(part.search()):
                    for r, (edges, logp, value, threshold) in enumerate(found):
                        rows.append(lo + d)
                        paths.append(edges)
                        for c, v in zip(cols, (r + 1, logp, value, log_inclusion(logp, threshold))):
                            c.append(v)
                ids, count = part.ids_of(paths)
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(count)].astype(np.int32), ids.astype(np.int32))
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).take(rows) for i in range(len(carry))]
                    + [pa.array(cols[0], pa.int32()), lists, pa.array(count, pa.int64())]
                    + [pa.array(c, pa.float64()) for c in cols[1:]], names=schema.names)

    own = [fresh(n, carry) for n, _ in added]
    return src.mapInArrow(run, schema).toDF(*carry, *own)


def _text(raw: bytes) -> str:
    text = raw.decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def decode_ids(pieces: list[bytes], ids) -> str:
    """Text of one list of piece ids."""
    return _text(b"".join([pieces[i] for i in ids]))


def decode_lists(pieces: pa.Array, ids: pa.Array) -> pa.Array:
    """Texts of many lists of piece ids, ``ROWS`` lists at a time; null for null."""
    out = []
    for lo in range(0, len(ids), ROWS):
        part = ids.slice(lo, ROWS)
        raw = pieces.take(part.flatten())                  # the lists' bytes, end to end
        at = np.frombuffer(raw.buffers()[1], dtype=np.int32, count=len(raw) + 1, offset=4 * raw.offset)
        data = raw.buffers()[2].to_pybytes() if raw.buffers()[2] is not None else b""
        cut = at[np.r_[0, np.cumsum(part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]].tolist()
        out.append(pa.array([_text(data[a:b]) if there else None for a, b, there
                             in zip(cut, cut[1:], part.is_valid().to_pylist())], pa.string()))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def decode_pieces(rows: DataFrame, ids_col: str = "ids", out_col: str = "decoded",
                  model_file: str | None = None) -> DataFrame:
    """``rows`` with the text of ``ids_col`` (null ids give null) in place of it."""
    bound_batches(rows.sparkSession)
    pieces = rows.sparkSession.sparkContext.broadcast(
        pa.array(Vocabulary(model_file or default_model()).text, pa.binary()))

    @F.arrow_udf(T.StringType())
    def text_of(ids: pa.Array) -> pa.Array:
        return decode_lists(pieces.value, ids)

    return rows.withColumn(out_col, text_of(F.col(ids_col)))


def op3_sentencepiece_gumbel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segmentations of every document, encoded, decoded and compared."""
    prepare(spark)
    docs = load_table(spark, sf_dir, "documents").withColumn(
        "h", F.xxhash64(F.coalesce(F.replace("text", F.lit(MARK), F.lit(" ")), F.lit(""))))
    got = sample_pieces(docs, k=2, carry=["doc_id", "h"])
    return decode_pieces(got).select(
        "doc_id", "rank", "n_pieces", "log_prob", "perturbed", "log_inclusion",
        F.xxhash64("ids").alias("ids_hash"), (F.xxhash64("decoded") == F.col("h")).alias("round_trip"))
