"""Document log-likelihoods by a gated recurrent language model.

Token counts are taken over all training documents. The most frequent words form the model's vocabulary, ordered by
frequency and cut into classes of CLASS words; the output is a class softmax times a softmax within the class. All other
words are one unknown token, times the word's own share among the unknown ones by its corpus count, so that the model
gives every text a probability. Training is truncated backpropagation in numpy and sees every training document once: in
each of ROUNDS rounds, Spark's tasks train on their share of one part of the documents from the common weights, which are
then averaged, by the tokens seen, in a tree of tasks. Scoring carries the state through each whole document.

Counts of the HEAD most frequent words travel to the tasks; the counts of all other words are joined by a shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import _text
from ._spark import Scratch, blocks

HEAD = 1 << 18
VOCABULARY, CLASS, STATE = 1024, 32, 16
ROUNDS, STREAMS, STEPS, RATE = 2, 256, 16, 0.1
#: Tokens over which a state is carried in training.
PIECE = 512
#: Weights that one task of the averaging adds up, and the most that reach the driver.
FAN = 32
_BLOCK = 16 << 20
_END, _UNKNOWN = 0, 1
#: No weight or bias goes over the first, none under minus the second: no sum of STATE + 1 of them overflows exp().
_BOUND, _FLOOR = 4.0, 1e4


def held_out_column():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    np.seterr(over="ignore")
    for b in blocks(batches, size=_BLOCK // 2):
        h = _text.many_words(b.column("text").to_pylist())[0]
        words, n = np.unique(h, return_counts=True)
        for k in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[k : k + 50_000].view(np.int64)), pa.array(n[k : k + 50_000])], names=["word", "n"])


class Gru:
    """Input table, gates, recurrent weights and class-factored output; float32, states as columns."""

    def __init__(self, share: np.ndarray, seed: int = 11):
        """share: probabilities of the vocabulary, in its order."""
        self.classes = -(-len(share) // CLASS)
        full = np.zeros(self.classes * CLASS)
        full[: len(share)] = share
        full = full.reshape(self.classes, CLASS)
        rng = np.random.default_rng(seed)
        near = lambda scale, *n: (rng.standard_normal(n) * scale).astype(np.float32)
        total = full.sum(axis=1)
        self.w = {
            "input": near(0.3, self.classes * CLASS, STATE), "gates": near(0.25, 3 * STATE, STATE), "state": near(0.1, 3 * STATE, STATE), "bias": np.repeat(np.float32([1, 0, 0]), STATE)[:, None],
            "class": near(0.1, self.classes, STATE), "class_bias": np.log(total + 1e-12).astype(np.float32)[:, None],
            "word": near(0.1, self.classes, CLASS, STATE), "word_bias": np.where(full > 0, np.log(np.maximum(full, 1e-30) / np.maximum(total, 1e-30)[:, None]), -1e4).astype(np.float32)[:, :, None],
        }

    def packed(self) -> np.ndarray:
        return np.concatenate([np.ascontiguousarray(x, np.float32).ravel() for x in self.w.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, x in self.w.items():
            self.w[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def gates(self, token: np.ndarray) -> np.ndarray:
        return self.w["gates"] @ self.w["input"][token].T + self.w["bias"]

    def step(self, h: np.ndarray, gates: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next states, and what the way back needs."""
        back = self.w["state"] @ h
        zr = gates[: 2 * STATE] + back[: 2 * STATE]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r, u = zr[:STATE], zr[STATE:], back[2 * STATE :]
        n = r * u
        n += gates[2 * STATE :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, u

    def log_probabilities(self, h: np.ndarray, target: np.ndarray, grad: bool = False):
        """Natural log of each target's probability after the states in the rows of h; with grad, also what the loss sends
        back to h and the output."""
        w, at = self.w, np.arange(len(h))
        owner = (target // CLASS).astype(np.int16)
        order = np.argsort(owner, kind="stable")
        x, inside, owner = h[order], (target % CLASS)[order], owner[order]
        p = w["class"] @ x.T
        p += w["class_bias"]  # weights are bounded, so that exp() is
        value = p[owner, at]
        np.exp(p, out=p)
        total = p.sum(axis=0)
        value -= np.log(total)
        if grad:
            p /= total
            p[owner, at] -= 1
            back = p.T @ w["class"]
            grads = {"class": p @ x, "class_bias": p.sum(axis=1, keepdims=True), "word": {}}
        edge = np.searchsorted(owner, np.arange(self.classes + 1)).tolist()
        for c in range(self.classes):
            lo, hi = edge[c], edge[c + 1]
            if lo == hi:
                continue
            own, k = x[lo:hi], at[: hi - lo]
            q = w["word"][c] @ own.T
            q += w["word_bias"][c]
            picked = q[inside[lo:hi], k]
            np.exp(q, out=q)
            total = q.sum(axis=0)
            value[lo:hi] += picked - np.log(total)
            if grad:
                q /= total
                q[inside[lo:hi], k] -= 1
                back[lo:hi] += q.T @ w["word"][c]
                grads["word"][c] = (q @ own, q.sum(axis=1, keepdims=True))
        out = np.empty_like(value)
        out[order] = value
        if not grad:
            return out
        sent = np.empty_like(back)
        sent[order] = back
        return out, sent, grads


class _Trainer:
    """Adagrad steps of truncated backpropagation; rows of the input table and classes that a window lacks stay as they are."""

    def __init__(self, model: Gru):
        self.model = model
        self.seen = {k: np.full(x.shape, 1e-6, np.float32) for k, x in model.w.items()}

    def _apply(self, name: str, where, grad: np.ndarray) -> None:
        grad = np.clip(grad, -1, 1)
        seen = self.seen[name]
        seen[where] += grad * grad
        self.model.w[name][where] = np.clip(self.model.w[name][where] - RATE * grad / np.sqrt(seen[where]), -_FLOOR, _BOUND)

    def window(self, h: np.ndarray, inputs: np.ndarray, targets: np.ndarray, reset: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Steps x streams of tokens, from the states in the columns of h; the states after them."""
        m, w = self.model, self.model.w
        steps, lanes = inputs.shape
        gates = m.gates(inputs.ravel()).reshape(3 * STATE, steps, lanes)
        kept, states = [], np.empty((steps, lanes, STATE), gates.dtype)
        live = ~reset
        for t in range(steps):
            h = h * live[t]
            new, z, r, n, u = m.step(h, gates[:, t])
            kept.append((h, z, r, n, u))
            states[t] = new.T
            h = new
        flat = valid.ravel()
        if not flat.any():
            return h
        _, back, grads = m.log_probabilities(states.reshape(-1, STATE)[flat], targets.ravel()[flat], grad=True)
        scale = gates.dtype.type(1.0 / flat.sum())
        into = np.zeros((flat.size, STATE), gates.dtype)
        into[flat] = back * scale
        into = np.ascontiguousarray(into.reshape(steps, lanes, STATE).transpose(0, 2, 1))
        carry = np.zeros_like(h)
        d_gates = np.empty_like(gates)
        d_state = np.zeros_like(w["state"])
        through = np.empty((3 * STATE, lanes), gates.dtype)
        for t in range(steps - 1, -1, -1):
            before, z, r, n, u = kept[t]
            d = into[t] + carry
            open_ = d * (1 - z)
            dn = open_ * (1 - n * n)
            through[:STATE] = (before - n) * z * open_
            through[STATE : 2 * STATE] = dn * u * r * (1 - r)
            through[2 * STATE :] = dn
            d_gates[:, t] = through
            through[2 * STATE :] *= r
            d_state += through @ before.T
            carry = (d * z + w["state"].T @ through) * live[t]
        d_gates = d_gates.reshape(3 * STATE, -1)
        token = inputs.ravel()
        d_input = d_gates.T @ w["gates"]
        self._apply("gates", slice(None), d_gates @ w["input"][token])
        self._apply("state", slice(None), d_state)
        self._apply("bias", slice(None), d_gates.sum(axis=1, keepdims=True))
        self._apply("class", slice(None), grads["class"] * scale)
        self._apply("class_bias", slice(None), grads["class_bias"] * scale)
        own = list(grads["word"])
        self._apply("word", own, np.stack([g for g, _ in grads["word"].values()]) * scale)
        self._apply("word_bias", own, np.stack([bias for _, bias in grads["word"].values()]) * scale)
        order = np.argsort(token.astype(np.int16) if len(w["input"]) < 1 << 15 else token, kind="stable")
        rows, start = np.unique(token[order], return_index=True)
        self._apply("input", rows, np.add.reduceat(d_input[order], start, axis=0))
        return h


def _streams(ids: np.ndarray, at: np.ndarray, most: int, piece: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents laid out as streams: step x stream of the position in ids (-1: none), documents' starts, longest first.

    Returns place, reset, and the tokens that go in and come out. With `piece`, documents are cut into pieces of so many
    tokens, and the state starts anew at each.
    """
    first = np.zeros(len(ids), bool)
    first[at[:-1]] = True
    if piece:
        cuts = [np.arange(lo, hi, piece) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        at = np.concatenate([*cuts, at[-1:]])
    n = np.diff(at)
    lanes = int(np.clip(n.sum() // max(1, n.max()), 1, most)) if len(n) else 1
    heap = [(0, k) for k in range(lanes)]
    held: list[list[int]] = [[] for _ in range(lanes)]
    for doc in np.argsort(-n, kind="stable").tolist():
        load, k = heapq.heappop(heap)
        held[k].append(doc)
        heapq.heappush(heap, (load + int(n[doc]), k))
    held.sort(key=lambda own: -int(n[own].sum()) if own else 0)
    steps = int(n[held[0]].sum()) if held[0] else 0
    place = np.full((lanes, steps), -1, np.int32)
    reset = np.zeros((lanes, steps), bool)
    for k, own in enumerate(held):
        t = 0
        for doc in own:
            place[k, t : t + n[doc]] = np.arange(at[doc], at[doc + 1])
            reset[k, t] = True
            t += int(n[doc])
    place, reset = place.T.copy(), reset.T.copy()
    out = np.where(place >= 0, ids[np.maximum(place, 0)], _END)
    into = np.where((place < 0) | first[place], _END, ids[np.maximum(place - 1, 0)])
    return place, reset, into, out


class Vocabulary:
    """Sorted word hashes with their network ids, and the counts of the head words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, documents: int):
        """words by descending count."""
        own = words[: VOCABULARY - 2]
        order = np.argsort(own, kind="stable")
        self.sorted, self.ids = own[order], (order + 2).astype(np.int32)
        order = np.argsort(words, kind="stable")
        self.head, self.head_counts = words[order], counts[order]
        self.size = len(own) + 2
        self.counts = counts[: len(own)]
        self.documents = documents

    def lookup(self, h: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(h), _UNKNOWN, np.int32)
        k = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[k] == h, self.ids[k], _UNKNOWN).astype(np.int32)

    def head_count(self, h: np.ndarray) -> np.ndarray:
        """Counts of head words; -1 for the others."""
        if not len(self.head):
            return np.full(len(h), -1, np.int64)
        k = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        return np.where(self.head[k] == h, self.head_counts[k], -1)


def _tokens(texts: list[str | None], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Network ids with an end after each text, tokens before each text; word hashes, words before each text."""
    h, first = _text.many_words(texts)
    at = first + np.arange(len(first))
    ids = np.full(at[-1], _END, np.int32)
    ids[np.arange(len(h)) + np.repeat(np.arange(len(texts)), np.diff(first))] = vocabulary.lookup(h)
    return ids, at, h, first


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the rows of a task: their weights, each already multiplied by its tokens, and tokens, added up."""
    total, seen, task = None, 0.0, 0
    for b in batches:
        for w, n, task in zip(*(b.column(c).to_pylist() for c in ("weights", "seen", "task")), strict=True):
            own = np.frombuffer(w, np.float64)
            total, seen = own.copy() if total is None else total + own, seen + n
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([seen]), pa.array([task], pa.int32())], names=["weights", "seen", "task"])


def _train(training: DataFrame, vocabulary: Vocabulary, model: Gru) -> None:
    """Round k learns from the documents whose hash has the remainder k, all of which together are all documents."""
    context = training.sparkSession.sparkContext
    shared = context.broadcast(vocabulary)
    flat = model.packed()
    for k in range(ROUNDS):
        weights = context.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            np.seterr(over="ignore", under="ignore")
            own = Gru(np.full(shared.value.size, 1.0))
            own.load(weights.value)
            trainer, seen = _Trainer(own), 0
            for b in blocks(batches, size=_BLOCK // 4):
                ids, at, *_ = _tokens(b.column("text").to_pylist(), shared.value)
                place, reset, into, out = _streams(ids, at, STREAMS, PIECE)
                seen += len(ids)
                h = np.zeros((STATE, place.shape[1]), np.float32)
                for t in range(0, len(place), STEPS):
                    live = int((place[t] >= 0).sum())  # streams are sorted, so these are the first
                    s = slice(t, t + STEPS)
                    h[:, :live] = trainer.window(h[:, :live], into[s, :live], out[s, :live], reset[s, :live], place[s, :live] >= 0)
            if seen:
                whole = (own.packed().astype(np.float64) * seen).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([whole], pa.binary()), pa.array([float(seen)]), pa.array([TaskContext.get().partitionId()], pa.int32())], names=["weights", "seen", "task"])

        part = training.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == k)
        parts = part.mapInArrow(run, _WEIGHTS)
        tasks = part.rdd.getNumPartitions()
        while tasks > FAN:
            tasks = -(-tasks // FAN)
            parts = parts.repartition(tasks, "task").mapInArrow(_sum, _WEIGHTS)
        got = parts.collect()
        if got:
            flat = (sum(np.frombuffer(r["weights"], np.float64) for r in got) / sum(r["seen"] for r in got)).astype(np.float32)
        weights.unpersist()
    model.load(flat)


_WEIGHTS = "weights binary, seen double, task int"


def _score_block(texts: list[str | None], vocabulary: Vocabulary, model: Gru) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Natural log probability of each text with unknown words as one token; word hashes, words before each text."""
    ids, at, h, first = _tokens(texts, vocabulary)
    place, reset, into, out = _streams(ids, at, STREAMS)
    state = np.zeros((STATE, place.shape[1]), np.float32)
    value = np.zeros(len(ids))
    steps = 32
    for t in range(0, len(place), steps):
        live = int((place[t] >= 0).sum())
        some = place[t : t + steps, :live]
        gates = model.gates(into[t : t + steps, :live].ravel()).reshape(3 * STATE, *some.shape)
        kept = np.empty((*some.shape, STATE), np.float32)
        now = state[:, :live]
        for k in range(len(some)):
            now = model.step(now * ~reset[t + k, :live], gates[:, k])[0]
            kept[k] = now.T
        state[:, :live] = now
        valid = some >= 0
        value[some[valid]] = model.log_probabilities(kept[valid], out[t : t + steps, :live][valid])
    return np.add.reduceat(value, at[:-1]) if len(texts) else value, h, first


_SCORED = "row long, doc_id long, n_tokens long, head_known long, head_log double, rare_log double, rare long, network double, tail array<struct<word:long,n:int>>"


def _scorer(shared, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        vocabulary = shared.value
        model = Gru(np.full(vocabulary.size, 1.0))
        model.load(weights.value)
        serial = TaskContext.get().partitionId() << 40
        for b in blocks(batches, size=_BLOCK):
            value, h, first = _score_block(b.column("text").to_pylist(), vocabulary, model)
            n = b.num_rows
            owner = np.repeat(np.arange(n), np.diff(first))
            count = vocabulary.head_count(h)
            known = count >= 0
            unknown = vocabulary.lookup(h) == _UNKNOWN
            logs = np.log10(np.maximum(count, 0) + 0.1)
            total = lambda mask, w=None: np.bincount(owner[mask], weights=None if w is None else w[mask], minlength=n)
            # Words outside the head, with how often they occur in their document.
            pair = np.flatnonzero(~known)
            order = pair[np.lexsort((h[pair], owner[pair]))]
            new = np.ones(len(order), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
            start = np.flatnonzero(new)
            times = np.diff(np.append(start, len(order))).astype(np.int32)
            offsets = np.zeros(n + 1, np.int32)
            np.cumsum(np.bincount(owner[order][start], minlength=n), out=offsets[1:])
            tail = pa.StructArray.from_arrays([pa.array(h[order][start].view(np.int64)), pa.array(times)], names=["word", "n"])
            end = np.log10(vocabulary.documents + 0.1)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(serial, serial + n)), b.column("doc_id"), pa.array(np.diff(first) + 1), pa.array((total(known) + (vocabulary.documents > 0)).astype(np.int64)), pa.array(total(known, logs) + end),
                pa.array(total(known & unknown, logs).astype(float)), pa.array(total(unknown).astype(np.int64)), pa.array((value / np.log(10)).astype(float)), pa.ListArray.from_arrays(pa.array(offsets), tail),
            ], names=["row", "doc_id", "n_tokens", "head_known", "head_log", "rare_log", "rare", "network", "tail"])
            serial += n

    return run


def _head(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words and counts of the most frequent words, HEAD at most, by descending count.

    The least count is found from a histogram of eighths of powers of two, so that nothing is sorted in one task. Of the
    step that goes over HEAD, as where all words occur once, the words with the smallest hashes are taken.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    many = sorted(((r["step"], r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    total, chosen = 0, F.lit(False)
    for k, n in many:
        if total + n > HEAD:
            top = F.shiftrightunsigned("word", 48)
            fine = sorted((r["top"], r["count"]) for r in counts.where(step == k).groupBy(top.alias("top")).count().collect())
            limit = 0
            for value, more in fine:
                if total + more > HEAD:
                    break
                total, limit = total + more, value + 1
            chosen = (step > k) | ((step == k) & (top < limit))
            break
        total, chosen = total + n, step >= k
    head = counts.where(chosen).toArrow()
    words, n = head.column("word").to_numpy().astype(np.int64).view(np.uint64), head.column("n").to_numpy().astype(np.int64)
    order = np.lexsort((words, -n))
    return words[order], n[order]


def score_documents(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row.

    A null text is empty: one end token. Documents with crc32 of the id divisible by 10 are held out; a null id is
    neither held out nor learned from. Repeated rows count and score once each. Texts of any length are whole; of words with
    equal counts the one with the smaller hash comes first. Without training documents every
    token's base share is one. Extra columns are not read; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = docs.where(~held_out_column())
    counts = scratch.keep(training.select("text").mapInArrow(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    documents = training.count()
    facts = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    total, distinct = facts["n"] + documents, facts["v"] + (documents > 0)
    vocabulary = Vocabulary(*_head(counts), documents)

    rare_n = total - documents - int(vocabulary.counts.sum())
    rare_v = facts["v"] - len(vocabulary.counts)
    share = np.concatenate(([documents + 0.1, rare_n + 0.1], vocabulary.counts + 0.1)) if total else np.ones(2)
    model = Gru(share / share.sum())
    _train(training, vocabulary, model)

    context = spark.sparkContext
    scored = docs.mapInArrow(_scorer(context.broadcast(vocabulary), context.broadcast(model.packed())), _SCORED)
    scored = scratch.keep(scored, "scored")
    tail = scored.select("row", F.inline("tail")).withColumnRenamed("n", "times").join(counts, "word", "left")
    tail = tail.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("tail_log"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("tail_known"))
    out = scored.drop("tail").join(tail, "row", "left")
    tail_log, tail_known = F.coalesce("tail_log", F.lit(0.0)), F.coalesce("tail_known", F.lit(0))
    return out.select(
        "doc_id", F.coalesce(held_out_column(), F.lit(False)).alias("held_out"), "n_tokens", (F.col("head_known") + tail_known).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_log") + tail_log - F.col("n_tokens") * float(np.log10(total + 0.1 * (distinct + 1)))).alias("base_score"),
        (F.col("network") + F.col("rare_log") + tail_log - F.col("rare") * float(np.log10(rare_n + 0.1 * (rare_v + 1)))).alias("score"),
    )
