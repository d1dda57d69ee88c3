"""LM scoring: a gated recurrent model in numpy with a class-factored softmax and state carried across windows.

Frequent words have classes by frequency, in families of classes, and a softmax within their class; all other words, unknown ones too, have
classes by shape and their smoothed share of the class within it.  A word is frequent from a count that grows with the
square root of the training tokens, so the model's vocabulary grows with the corpus, up to what may be broadcast.

1. Words are counted over all training documents.
2. Texts are coded once: the inputs of the model, what the broadcast counts say of a document, and its rare words.
3. A warm-up on a bounded sample finds the place from where every learner then runs truncated backpropagation over all
   its training documents.  The learners' moves are averaged, each block of words by the task that it goes to.
4. Every document is scored from its first to its last token.

A word is known by its 64-bit hash (xxh3) from the counts on.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C

#: Words counted at least sqrt(training tokens) / HEAD_SHARE times have an output and an input of their own: HEAD_SHARE *
#: sqrt(training tokens) words at most, and of these the BROADCAST_WORDS most frequent.
HEAD_SHARE = 32
#: Words whose counts are broadcast (20 bytes each), the model's among them (65 float32 each); the rest join by shuffle.
BROADCAST_WORDS = 262_144
HIDDEN, STREAMS, WINDOW = 16, 1024, 16
#: Words of texts that run together; of a window of scoring; and of a text that is scored with others as long.
CHUNK_WORDS, SCORED, LONG_WORDS = 2_500_000, 16_384, 2048
#: Windows that learn from a chunk, at least: a small one has fewer streams.
WINDOWS = 64
#: About as many training tokens are read by the warm-up, WARM_PASSES times, and never more than twice as many.
WARM_TOKENS, WARM_PASSES = 400_000, 2
#: Step and least scale of Adagrad.
RATE, LEAST = 0.3, 0.1
#: A learner for so many square roots of the training tokens, at most: what learners send grows as the corpus does.
LEARNER_ROOTS = 100
#: Parameters that all words share.
SHARED = ("u", "wf", "wc")
#: Rows whose softmax over families is taken at once.
ROWS = 256
#: Words of a block of the model.
BLOCK = 1024
SMOOTH, SEED, END = 0.1, 5, b""
SHAPES = 24
#: Texts whose words are told apart at once.
BATCH = 2048
#: Words that a task keeps codes or counts of.
CACHE_WORDS = 600_000


def shape(word: bytes) -> int:
    """The class of an infrequent word: last byte's kind, any non-ASCII byte, length."""
    last = word[-1] if word else 0
    kind = 0 if 97 <= last <= 122 or last >= 128 else 1 if 48 <= last <= 57 else 2 if last in b".,;:" else 3 if last in b"!?" else 4 if last in b"#$%&*" else 5
    return kind * 4 + 2 * (not word.isascii()) + (len(word) > 9)


class Codes(dict):
    """Words to their rank by count, or beyond the broadcast ones to a number of their own while this holds them."""

    def __init__(self, hashes: np.ndarray):
        super().__init__()
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.beyond = len(hashes)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.code = np.zeros(0, np.int64)
        self.hashes, self.shapes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self.code) + len(self.new)
        self.new.append(word)
        return k

    def of(self, words: list[bytes]) -> np.ndarray:
        """Ranks, or ``beyond`` plus a place in ``hashes`` and ``shapes``."""
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, self.new), np.uint64, len(self.new)).view(np.int64)
            if self.beyond:
                k = np.minimum(np.searchsorted(self.sorted, h), self.beyond - 1)
                known = self.sorted[k] == h
                code = np.where(known, self.order[k], 0)
            else:
                known, code = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
            rare = np.flatnonzero(~known)
            code[rare] = self.beyond + len(self.hashes) + np.arange(len(rare))
            self.hashes = np.r_[self.hashes, h[rare]]
            self.shapes = np.r_[self.shapes, np.fromiter((shape(self.new[i]) for i in rare.tolist()), np.int64, len(rare))]
            self.code = np.r_[self.code, code]
            self.new = []
        return self.code[at]


def balanced(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each item, where each group starts): items by falling count in ranges of equal mass of roots.

    A softmax over k groups and one within a group cost k + root.sum() ** 2 / counts.sum() / k values: the least of it.
    """
    if not len(counts):
        return np.zeros(0, np.int64), np.zeros(2, np.int64)
    root = np.sqrt(counts)
    k = max(1, round(float(root.sum() / np.sqrt(max(1e-9, counts.sum())))))
    mass = np.cumsum(root) / max(1e-9, root.sum())
    group = np.maximum(0, np.minimum((mass * k - 1e-9).astype(np.int64), k - 1))
    return group, np.searchsorted(group, np.arange(k + 1))


def _sums(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, the sum of each one's rows); keys ascend."""
    if not len(keys):
        return keys, rows
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[cut], np.add.reduceat(rows, cut)


class Gru:
    """Parameters and passes.  Inputs: a word's id below ``head``, head + shape, or head + SHAPES at a text's start.

    A word's probability is that of its family of classes, times that of its class in it, times its own in the class; a
    shape is a family by itself.  Every output has its bias as the weight of a constant last unit.
    """

    def __init__(self, counts: np.ndarray, shape_counts: np.ndarray, seed: int = SEED):
        r = np.random.default_rng(seed)
        n, h, f = len(counts), HIDDEN, np.float32
        self.head = n
        word_class, self.words = balanced(counts)
        mass = np.bincount(word_class, counts, len(self.words) - 1)
        class_family, self.classes = balanced(mass)
        families = len(self.classes) - 1
        top = np.r_[np.bincount(class_family, mass, families), shape_counts] + 0.5
        self.class_of = word_class.astype(np.int32)
        self.family_of = np.r_[class_family[word_class], families + np.arange(SHAPES)].astype(np.int32)
        out = lambda bias: np.c_[np.zeros((len(bias), h)), np.log(bias)].astype(f)
        self.p = {
            "x": (r.standard_normal((n + SHAPES + 1, 3 * h)) * 0.1).astype(f),
            "u": (r.standard_normal((h, 3 * h)) / np.sqrt(h) * np.r_[np.full(2 * h, 0.5), np.ones(h)]).astype(f),
            "wf": out(top / top.sum()), "wc": out((mass + 0.5) / top[class_family]), "ww": out((counts + 0.5) / (mass[word_class] + 0.5)),
        }
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.fed = np.zeros(n + SHAPES + 1, f)

    def forward(self, fed: np.ndarray, reset: np.ndarray, h: np.ndarray, keep: bool):
        """(states with the constant unit, what ``backward`` needs if it is to be kept, the last state) of fed (time, stream).

        Gates are half of one and a hyperbolic tangent, their inputs and weights being half of a sigmoid's.  Within a
        step a row is a unit, and a column a stream.
        """
        wide, live = fed.shape
        k, x, half = HIDDEN, self.p["x"], np.float32(0.5)
        ut = np.ascontiguousarray(self.p["u"].T)
        zr, hu, n, before = (np.empty((wide if keep else 1, m, live), np.float32) for m in (2 * k, 3 * k, k, k))
        out = np.ones((wide, live, k + 1), np.float32)
        some = reset.any(1)
        new = np.empty((k, live), np.float32)
        for t in range(wide):
            i = t if keep else 0
            own, g, m, b = zr[i], hu[i], n[i], before[i]
            b[:] = h
            if some[t]:
                b[:, reset[t]] = 0
            xt = np.ascontiguousarray(x.take(fed[t], 0).T)
            np.dot(ut, b, out=g)
            np.add(xt[: 2 * k], g[: 2 * k], out=own)
            np.tanh(own, out=own)
            own *= half
            own += half
            np.multiply(own[k:], g[2 * k :], out=m)
            m += xt[2 * k :]
            np.tanh(m, out=m)
            np.subtract(b, m, out=new)
            new *= own[:k]
            new += m
            out[t, :, :k] = new.T
            h = new
        return out, (zr, hu, n, before, reset, some), new.copy()

    def backward(self, every: np.ndarray, kept: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of inputs and of u from those of the states; no further back than the window."""
        zr, hu, n, before, reset, some = kept
        wide, k, live = n.shape
        one, two = np.float32(1), np.float32(2)
        u, du = self.p["u"], np.zeros_like(self.p["u"])
        dx = np.empty((wide, live, 3 * k), np.float32)
        carry = np.zeros((k, live), np.float32)
        a, c, back = (np.empty((m, live), np.float32) for m in (k, 2 * k, 3 * k))
        for t in range(wide - 1, -1, -1):
            own, m = zr[t], n[t]
            d = every[t].T + carry
            np.subtract(one, own, out=c)
            np.multiply(m, m, out=a)
            np.subtract(one, a, out=a)
            a *= c[:k]
            a *= d  # of the candidate's input
            c *= own
            c *= two
            gates = back[: 2 * k]
            np.subtract(before[t], m, out=back[:k])
            back[:k] *= d
            np.multiply(a, hu[t, 2 * k :], out=back[k : 2 * k])
            gates *= c
            dx[t, :, : 2 * k] = gates.T
            dx[t, :, 2 * k :] = a.T
            np.multiply(a, own[k:], out=back[2 * k :])
            du += before[t] @ back.T
            np.dot(u, back, out=carry)
            d *= own[:k]
            carry += d
            if some[t]:
                carry[:, reset[t]] = 0
        return dx.reshape(-1, 3 * k), du

    def output(self, hs: np.ndarray, target: np.ndarray, gw: np.ndarray | None = None, safe: bool = False):
        """Natural log probabilities of targets, which ascend; with gw, gradients of minus their sum too.

        Fills gw, of "ww", and returns those of "wf", "wc" and of hs.  safe: rows are shifted by their greatest first.
        """
        family, wf = self.family_of.take(target), self.p["wf"]
        own = wf.take(family, 0)  # take is twice as fast as an index
        out = np.einsum("ij,ij->i", hs, own)
        dh = np.empty_like(hs) if gw is not None else None
        flip, gf = np.ascontiguousarray(wf.T), np.zeros_like(wf)
        ones, room = np.ones(len(wf), np.float32), np.empty((ROWS, len(wf)), np.float32)
        for i in range(0, len(hs), ROWS):  # as many rows at once as the cache holds
            hc = hs[i : i + ROWS]
            e = np.dot(hc, flip, out=room[: len(hc)])
            if safe:
                top = e.max(1)
                e -= top[:, None]
                out[i : i + ROWS] -= top
            np.exp(e, out=e)
            s = e @ ones
            out[i : i + ROWS] -= np.log(s)
            if gw is not None:
                s = (1 / s)[:, None]
                gf += e.T @ (hc * s)
                d = np.dot(e, wf, out=dh[i : i + ROWS])
                d *= s
                d -= own[i : i + ROWS]
        known = int(np.searchsorted(target, self.head))
        rows = hs[:known], out[:known], dh[:known] if gw is not None else None
        gc = np.zeros_like(self.p["wc"]) if gw is not None else None
        self._within(self.p["wc"], self.classes, self.class_of.take(target[:known]), *rows, gc, safe)
        self._within(self.p["ww"], self.words, target[:known], *rows, gw, safe)
        if not safe and not np.isfinite(out).all():
            return self.output(hs, target, gw, True)
        if gw is None:
            return out
        # The targets' own part: sums of states by target, by class from those, and by family.
        item, sums = _sums(target, hs)
        words = int(np.searchsorted(item, self.head))
        gw[item[:words]] -= sums[:words]
        for g, groups, n in ((gc, self.class_of[item[:words]], words), (gf, self.family_of[item], len(item))):
            own, total = _sums(groups, sums[:n])
            g[own] -= total
        return out, gf, gc, dh

    @staticmethod
    def _within(w: np.ndarray, starts: np.ndarray, item: np.ndarray, hs: np.ndarray, out: np.ndarray, dh: np.ndarray | None, g: np.ndarray | None, safe: bool) -> None:
        """A softmax over each item's group: adds to out and dh, and fills g but for the items' own part.  Items ascend, so a group's rows are a slice."""
        cuts, starts = np.searchsorted(item, starts).tolist(), starts.tolist()
        total = np.ones(len(hs), np.float32)
        ones = np.ones(max(1, *(z - a for a, z in zip(starts, starts[1:]))), np.float32)
        for a, z, i, j in zip(starts, starts[1:], cuts, cuts[1:]):
            if i == j:
                if g is not None:
                    g[a:z] = 0
                continue
            hc, own = hs[i:j], w[a:z]
            e = hc @ own.T
            if safe:
                top = e.max(1)
                e -= top[:, None]
                out[i:j] -= top
            np.exp(e, out=e)
            s = e @ ones[: z - a]
            total[i:j] = s
            if g is not None:
                s = (1 / s)[:, None]
                np.dot(e.T, hc * s, out=g[a:z])
                e = e @ own
                e *= s
                dh[i:j] += e
        its = w.take(item, 0)
        out += np.einsum("ij,ij->i", hs, its) - np.log(total)
        if g is not None:
            dh -= its

    def run(self, texts: list[np.ndarray], rate: float | None = None) -> np.ndarray:
        """Log probability of each text (ids with the end); with a rate, learns from each window after scoring it.

        Texts lie end to end in streams that advance together; a text's start resets its stream's state, and
        nothing else does, so a text of any length is read in windows with its state carried across.  To learn from,
        the texts are cut into streams of one length: a text that goes on in another stream starts there without state.
        Memory is some bytes a token, however long a text is.
        """
        lengths = np.array([len(x) for x in texts], np.int64)
        size = int(lengths.sum())
        if rate is None:
            k = max(1, min(STREAMS, int((lengths > 0).sum())))
            order, starts, sizes = self._placed(lengths, k)
        else:
            k = max(1, min(STREAMS, size // (WINDOW * WINDOWS)))
            order, sizes = np.arange(len(texts)), np.full(k, size // k, np.int64)
            sizes[: size % k] += 1
            starts = np.cumsum(sizes) - sizes
        first = np.cumsum(lengths[order]) - lengths[order]
        some = lengths[order] > 0
        target = np.concatenate([texts[i] for i in order.tolist()] or [np.zeros(0)]).astype(np.int32)
        fed, begins = np.empty(size, np.int32), np.zeros(size, bool)
        fed[1:] = target[:-1]
        fed[first[some]] = self.head + SHAPES
        begins[first[some]] = True
        begins[starts[sizes > 0]] = True
        logs = np.zeros(size, np.float32)
        h = np.zeros((HIDDEN, k), np.float32)
        gw = np.zeros_like(self.p["ww"]) if rate is not None else None
        longest, at = int(sizes.max(initial=0)), 0
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            while at < longest:
                live = int(np.searchsorted(-sizes, -at, "left"))
                wide = WINDOW if rate is not None else min(512, max(WINDOW, SCORED // live))
                wide = min(wide, longest - at)
                # The first ``whole`` streams go on to the window's end; of the others what lies beyond theirs is left out.
                flat = np.minimum(starts[None, :live] + np.arange(at, at + wide)[:, None], size - 1)
                whole = int(np.searchsorted(-sizes, -(at + wide), "right"))
                f = fed.take(flat)
                hs, kept, h = self.forward(f, begins.take(flat), h[:, :live], rate is not None)
                hs, flat = hs.reshape(-1, HIDDEN + 1), flat.ravel()
                goal = target.take(flat)
                if whole == live:
                    rows = np.argsort(goal)
                else:
                    rows = np.flatnonzero((np.arange(at, at + wide)[:, None] < sizes[None, :live]).ravel())
                    rows = rows[np.argsort(goal[rows])]
                found = self.output(hs.take(rows, 0), goal.take(rows), gw)
                if rate is None:
                    logs[flat[rows]] = found
                else:
                    out, gf, gc, dh = found
                    logs[flat[rows]] = out
                    place = np.full(len(hs), len(rows))
                    place[rows] = np.arange(len(rows))
                    every = np.r_[dh, np.zeros((1, HIDDEN + 1), np.float32)] if whole < live else dh
                    dx, du = self.backward(every.take(place, 0).reshape(wide, live, -1)[:, :, :HIDDEN], kept)
                    words = f.ravel()
                    by = np.argsort(words)
                    own, gx = _sums(words.take(by), dx.take(by, 0))
                    self.fed += np.bincount(words, minlength=len(self.fed))
                    # A window of few tokens moves the model as little.
                    self.update(np.float32(rate * min(1.0, len(rows) / (k * WINDOW))), {"wf": gf, "wc": gc, "ww": gw, "u": du}, own, gx)
                at += wide
        total = np.zeros(len(texts))
        if size:
            total[order[some]] = np.add.reduceat(logs.astype(np.float64), first[some])
        return total

    @staticmethod
    def _placed(lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whole texts in k streams, the longest first and each to the shortest stream: (order of texts, where streams start, their sizes), the longest stream first."""
        heap = [(0, s) for s in range(k)]
        streams: list[list[int]] = [[] for _ in range(k)]
        for i in np.argsort(-lengths, kind="stable").tolist():
            size, s = heapq.heappop(heap)
            streams[s].append(i)
            heapq.heappush(heap, (size + int(lengths[i]), s))
        sizes = np.array([sum(int(lengths[i]) for i in s) for s in streams], np.int64)
        by = np.argsort(-sizes, kind="stable")
        return np.array([i for s in by.tolist() for i in streams[s]], np.int64), np.cumsum(sizes[by]) - sizes[by], sizes[by]

    def update(self, rate: np.float32, grads: dict[str, np.ndarray], fed: np.ndarray, gx: np.ndarray) -> None:
        """Adagrad; of the inputs only the rows that were fed move."""
        p, v = self.p, self.v
        for k, g in grads.items():
            for at in range(0, len(g), BLOCK):
                own, moments, to = g[at : at + BLOCK], v[k][at : at + BLOCK], p[k][at : at + BLOCK]
                s = own * own
                moments += s
                np.sqrt(moments, out=s)
                s += np.float32(LEAST)
                np.divide(own, s, out=s)
                s *= rate
                to -= s
        own = v["x"].take(fed, 0)
        own += gx * gx
        v["x"][fed] = own
        np.sqrt(own, out=own)
        own += np.float32(LEAST)
        np.divide(gx, own, out=own)
        own *= rate
        p["x"][fed] = p["x"].take(fed, 0) - own

    def move(self, block: int, by: np.ndarray) -> None:
        """Adds what ``_averaged`` gives of a block."""
        if block < 0:
            for k in SHARED:
                own, by = by[: self.p[k].size], by[self.p[k].size :]
                self.p[k] += own.reshape(self.p[k].shape)
            return
        own = slice(block * BLOCK, (block + 1) * BLOCK)
        x, w = self.p["x"][own], self.p["ww"][own]
        x += by[: x.size].reshape(x.shape)
        w += by[x.size :].reshape(w.shape)

    def pack(self, learning: bool = True) -> bytes:
        return pickle.dumps((self.head, self.words, self.classes, self.class_of, self.family_of, self.p, self.v if learning else {}))

    @classmethod
    def unpack(cls, data: bytes) -> Gru:
        g = cls.__new__(cls)
        g.head, g.words, g.classes, g.class_of, g.family_of, g.p, g.v = pickle.loads(data)
        g.fed = np.zeros(len(g.p["x"]), np.float32)
        return g


def _weighted(g: Gru, was: Gru, n: int):
    """The rows that a learner sends: (block, tokens, fed, moves): of shared parameters first, then of each block of words."""
    move = {k: (g.p[k] - was.p[k]).astype(np.float32) for k in g.p}
    yield -1, n, b"", np.concatenate([move[k].ravel() for k in SHARED]).tobytes()
    for b, at in enumerate(range(0, len(move["x"]), BLOCK)):
        own = slice(at, at + BLOCK)
        yield b, n, g.fed[own].astype("<f4").tobytes(), np.concatenate([move["x"][own].ravel(), move["ww"][own].ravel()]).astype("<f2").tobytes()


def _averaged(it):
    """Adds up the moves of each block: an input's by how often it was fed, all others by tokens."""
    sums: dict[int, list] = {}
    for batch in it:
        for b, n, fed, data in zip(*(c.to_pylist() for c in batch.columns)):
            x = np.frombuffer(data, "<f4" if b < 0 else "<f2").astype(np.float64)
            w = np.full(len(x), float(n))
            if b >= 0:
                own = np.frombuffer(fed, "<f4") + 1e-6 * n
                w[: 3 * HIDDEN * len(own)] = np.repeat(own, 3 * HIDDEN)
            if b not in sums:
                sums[b] = [w * x, w]
            else:
                sums[b][0] += w * x
                sums[b][1] += w
    if sums:
        schema = pa.schema([("block", pa.int32()), ("data", pa.binary())])
        yield C.table(schema, list(sums), [(s / np.maximum(w, 1e-30)).astype("<f4").tobytes() for s, w in sums.values()])


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int | None = None, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    The model's words are those frequent enough (HEAD_SHARE), or the ``head`` most frequent ones if that is given, and
    never more than ``broadcast_words``.  A-Z are lower-cased; a text's tokens are its words and one end.  Documents
    whose crc32(doc_id as text) mod 10 is 0 are held out from counts and model.  Words are told apart by a 64-bit hash.
    Null text counts as empty: its end only; a null id counts as held out; repeated rows count each; a text of any
    length is scored as a whole; if nothing is left to learn from, base_score is 0 and score that of the untrained
    model; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    held = F.pmod(F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)), F.lit(10)) == 0
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))

    def count(it):
        schema = pa.schema([("w", pa.int64()), ("shape", pa.int32()), ("c", pa.int64())])
        own: Counter = Counter()

        def out():
            return C.table(schema, np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)).view(np.int64), list(map(shape, own)), list(own.values()))

        for b in C.batches(it, BATCH):
            at, _, words = C.words_of(b.column(0))
            own.update(dict(zip(words, np.bincount(at, minlength=len(words)).tolist())))
            own[END] += b.num_rows
            if len(own) > CACHE_WORDS:
                yield out()
                own.clear()
        if own:
            yield out()

    train = slim.where(~F.col("held_out")).select("text")
    counts = C.materialize(train.mapInArrow(count, "w long, shape int, c long").groupBy("w").agg(F.first("shape").alias("shape"), F.sum("c").alias("c")), "lm-counts")
    by_shape = {r["shape"]: (r["v"], r["n"]) for r in counts.groupBy("shape").agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()}
    vocabulary, tokens = sum(v for v, _ in by_shape.values()), sum(n for _, n in by_shape.values())
    enough = math.sqrt(tokens) / HEAD_SHARE
    # The least count whose words, with all more frequent ones, are within the bound: ties go in or stay out together.
    least, size = None, 0
    for r in counts.groupBy("c").agg(F.count("*").alias("k")).orderBy(F.col("c").desc()).toLocalIterator():
        size += r["k"]
        if size > broadcast_words:
            break
        least = r["c"]
    top = counts.where(F.col("c") >= least if least is not None else F.lit(False)).toPandas().sort_values(["c", "w"], ascending=[False, True])
    hashes, shapes, top_c = (np.array(top[k], np.int64) for k in ("w", "shape", "c"))
    n_head = min(head, len(hashes)) if head is not None else int((top_c >= enough).sum())
    tail_v, tail_n = np.zeros(SHAPES), np.zeros(SHAPES)
    for s, (v, n) in by_shape.items():
        tail_v[s], tail_n[s] = v, n
    tail_v -= np.bincount(shapes[:n_head], minlength=SHAPES)
    tail_n -= np.bincount(shapes[:n_head], top_c[:n_head], SHAPES)
    base_low = np.log10(tokens + SMOOTH * (vocabulary + 1))
    tail_low = np.log10(tail_n + SMOOTH * (tail_v + 1))
    words = spark.sparkContext.broadcast((hashes, shapes, top_c))

    def code(it):
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("within", pa.float64()), ("ids", pa.binary()), ("w", pa.int64()), ("shape", pa.int32()), ("n", pa.int64())])
        h, s, c = words.value
        codes, top_n = Codes(h), len(h)
        base_of = np.log10(c + SMOOTH) - base_low
        within_of = np.where(np.arange(top_n) < n_head, 0.0, np.log10(c + SMOOTH) - tail_low[s]) if top_n else np.zeros(0)
        inputs = np.where(np.arange(top_n) < n_head, np.arange(top_n), n_head + s)
        row = TaskContext.get().partitionId() << 40
        for b in C.batches(it, BATCH):
            if not b.num_rows:
                continue
            at, sizes, words_ = C.words_of(b.column(2))
            each = codes.of([*words_, END])
            ids = np.insert(each[at], np.cumsum(sizes), each[-1])
            sizes = sizes + 1
            starts = np.cumsum(sizes) - sizes
            rare = np.flatnonzero(ids >= top_n)
            common = ids < top_n
            at = np.where(common, ids, 0)
            fed = inputs[at] if top_n else np.zeros(len(ids), np.int64)
            known = np.add.reduceat(common.astype(np.int64), starts)
            base, within = (np.add.reduceat(np.where(common, x[at], 0.0) if top_n else np.zeros(len(ids)), starts) for x in (base_of, within_of))
            own = ids[rare] - top_n
            fed[rare] = n_head + codes.shapes[own]
            data, ends = fed.astype("<i4").tobytes(), 4 * (starts + sizes)
            rows = row + np.arange(len(sizes))
            yield C.table(schema, rows, b.column(0), b.column(1), sizes, known, base, within, [data[4 * a : z] for a, z in zip(starts.tolist(), ends.tolist())], *(pa.nulls(len(rows), t) for t in (pa.int64(), pa.int32(), pa.int64())))
            if len(rare):
                pair, n = np.unique((np.searchsorted(starts, rare, "right") - 1 << 32) | own, return_counts=True)
                own = pair & 0xFFFFFFFF
                types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
                yield C.table(schema, row + (pair >> 32), *(pa.nulls(len(pair), t) for t in types), codes.hashes[own], codes.shapes[own].astype(np.int32), n)
            row += len(sizes)
            if len(codes) > CACHE_WORDS:
                codes.forget()

    coded = C.materialize(slim.mapInArrow(code, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, within double, ids binary, w long, shape int, n long"), "lm-coded")
    texts = coded.where("w is null")
    train_ids = texts.where(~F.col("held_out"))

    def chunks(batches, column: int, apart: bool):
        """(rows, arrays of ids), together about CHUNK_WORDS; apart: long texts with others as long, else in their order."""
        held: list[tuple[list, list, int]] = [([], [], 0), ([], [], 0)]
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                long = pc.greater(pc.binary_length(part.column(column)), 4 * LONG_WORDS)
                for kind, own in ((0, part.filter(pc.invert(long))), (1, part.filter(long))) if apart else ((0, part),):
                    rows, ids, size = held[kind]
                    rows.append(own.drop_columns([own.schema.names[column]]))
                    new = [np.frombuffer(x, "<i4") for x in own.column(column).to_pylist()]
                    ids += new
                    held[kind] = rows, ids, size + sum(map(len, new))
                    if held[kind][2] > CHUNK_WORDS:
                        yield rows, ids
                        held[kind] = [], [], 0
        for rows, ids, _ in held:
            if ids:
                yield rows, ids

    model = Gru(top_c[:n_head].astype(np.float64), tail_n)

    def warm(it):
        held_texts: list[np.ndarray] = []
        size = 0
        for _, own in chunks(it, 0, False):
            for x in own:
                x = x[: 2 * WARM_TOKENS - size]
                held_texts.append(x)
                size += len(x)
        if size:
            for _ in range(WARM_PASSES):
                model.run(held_texts, RATE)
            yield pa.RecordBatch.from_pydict({"model": [model.pack()]})

    if tokens:
        million = 1_000_000
        sample = train_ids.where(F.pmod(F.xxhash64("row"), F.lit(million)) < max(1, math.ceil(million * min(1.0, WARM_TOKENS / tokens))))
        found = sample.select("row", "ids").repartition(1).sortWithinPartitions("row").select("ids").mapInArrow(warm, "model binary").collect()
        model = Gru.unpack(found[0][0]) if found else model
        begun = spark.sparkContext.broadcast(model.pack())

        def learn(it):
            was = Gru.unpack(begun.value)
            g, seen = Gru.unpack(begun.value), 0
            for _, own in chunks(it, 0, False):
                g.run(own, RATE)
                seen += sum(map(len, own))
            if seen:
                for b, n, fed, data in _weighted(g, was, seen):
                    yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "n": [seen], "fed": [fed], "data": [data]})

        learners = max(1, math.ceil(math.sqrt(tokens) / LEARNER_ROOTS))
        moves = train_ids.select("ids").coalesce(learners).mapInArrow(learn, "block int, n long, fed binary, data binary")
        blocks = len(model.p["x"]) // BLOCK + 2
        for r in moves.repartition(min(C.parts(spark), blocks), "block").mapInArrow(_averaged, "block int, data binary").toLocalIterator():
            model.move(r["block"], np.frombuffer(r["data"], "<f4"))
    shared = spark.sparkContext.broadcast(model.pack(False))

    def score(it):
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
        g = Gru.unpack(shared.value)
        for rows, own in chunks(it, 7, True):
            t = pa.Table.from_batches(rows).combine_chunks()
            total = t.column(6).to_numpy() + g.run(own) / math.log(10)
            yield C.table(schema, *(t.column(k).combine_chunks() for k in range(6)), total)

    own = texts.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "within", "ids").mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    rare = coded.where("w is not null").select("row", "w", "shape", "n").join(counts.select("w", "c").hint("shuffle_hash"), "w", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    low = F.element_at(F.array(*[F.lit(float(x)) for x in tail_low]), F.col("shape") + 1)
    share = F.log10(F.col("c") + F.lit(SMOOTH))
    sums = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * (share - F.lit(float(base_low)))).alias("b"), F.sum(F.col("n") * (share - low)).alias("s"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return own.join(sums, "row", "left").select("doc_id", "held_out", "n_tokens", plus("n_known", "k").cast("long").alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), plus("base", "b").alias("base_score"), plus("score", "s").alias("score"))
