"""Toxicity: a bidirectional gated recurrent network with attention pooling, over character and word inputs, in numpy."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import hashed_sample

#: A word is at most this many characters; longer runs are several words.
WORD = re.compile(r"\w{1,24}")
#: Words in a window, and from one window to the next; every word is in two windows, and all windows are scored.
SPAN, STEP = 32, 16
#: The network is fitted on about this many labelled documents of each class, those with the smallest hashes of doc_id
#: among the ones of up to SAMPLE_CHARS characters.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1000, 2000, 100_000
VOCABULARY, ALPHABET = 20_000, 96
WORD_DIM, CHAR_DIM, FILTERS, WIDTH, HIDDEN, ATTEND = 12, 8, 16, 5, 8, 8
EPOCHS, BATCH, RATE = 7, 64, 0.01
REMEMBERED = 200_000
SEED = 11
#: Column that a score is put in.
SCORE = "_toxicity"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def windows(n: int) -> list[tuple[int, int]]:
    """Bounds of all windows over n words; the last one ends with the last word, and none lies within another."""
    if n <= SPAN:
        return [(0, n)] if n else []
    starts = [*range(0, n - SPAN, STEP), n - SPAN]
    return [(a, a + SPAN) for a in starts]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Parameters by name, with the vocabulary of words and the alphabet that they are for."""

    words: dict[str, int]
    letters: dict[str, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, words: dict[str, int], letters: dict[str, int], rng: np.random.Generator) -> Network:
        x = WORD_DIM + FILTERS
        shapes = {
            "word": (len(words) + 1, WORD_DIM), "char": (len(letters) + 4, CHAR_DIM), "conv": (WIDTH * CHAR_DIM, FILTERS), "conv_b": (FILTERS,),
            "wx": (2, x, 3 * HIDDEN), "bx": (2, 1, 3 * HIDDEN), "uzr": (2, HIDDEN, 2 * HIDDEN), "uc": (2, HIDDEN, HIDDEN),
            "wa": (2 * HIDDEN, ATTEND), "ba": (ATTEND,), "va": (ATTEND,), "wo": (2 * HIDDEN,), "bo": (1,),
        }
        zero = {"conv_b", "bx", "ba", "bo"}
        scale = {k: 0.3 if k in ("word", "char") else 1 / np.sqrt(s[-2] if len(s) > 1 else s[-1]) for k, s in shapes.items()}
        return cls(words, letters, {k: np.zeros(s, np.float32) if k in zero else (rng.standard_normal(s) * scale[k]).astype(np.float32) for k, s in shapes.items()})

    def spelled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids (0: not in the vocabulary) and letters, with marks for begin and end and zeros around them."""
        ids = np.fromiter((self.words.get(w, 0) for w in words), np.int64, len(words))
        longest = max(map(len, words), default=0)
        out = np.zeros((len(words), longest + 2 + WIDTH - 1), np.int64)
        get, pad = self.letters.get, WIDTH // 2
        for i, w in enumerate(words):
            out[i, pad : pad + len(w) + 2] = [2, *[get(c, 1) for c in w], 3]
        return ids, out

    def inputs(self, ids: np.ndarray, letters: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """A row for each word: its embedding, and the maximum of each character filter over its places."""
        p = self.p
        places = letters.shape[1] - WIDTH + 1
        cols = np.concatenate([p["char"][letters[:, i : i + places]] for i in range(WIDTH)], axis=2)
        raw = np.tanh(cols @ p["conv"] + p["conv_b"])
        raw = np.where((letters[:, WIDTH // 2 : WIDTH // 2 + places] == 0)[:, :, None], np.float32(-1), raw)
        at = raw.argmax(axis=1)
        pooled = np.take_along_axis(raw, at[:, None, :], axis=1)[:, 0]
        if keep is not None:
            keep.update(ids=ids, letters=letters, cols=cols, at=at, filtered=pooled)
        return np.concatenate([p["word"][ids], pooled], axis=1)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """(2, words, 3 * HIDDEN): what each word adds to the gates of either direction."""
        return np.matmul(x[None], self.p["wx"]) + self.p["bx"]

    def forward(self, gates: np.ndarray, at: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; at (n, SPAN) has rows of gates, of which the first lengths[i] count."""
        p, n, steps = self.p, len(at), int(lengths.max())
        t = np.arange(steps)[:, None]
        turned = np.where(t < lengths[None, :], lengths[None, :] - 1 - t, t)  # a place's counterpart read from the end
        rows = np.arange(n)[None, :]
        order = np.stack([at[:, :steps].T, at.T[turned, rows]])
        real = (t < lengths[None, :]).astype(np.float32)
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((2, steps, n, HIDDEN), np.float32)
        trail = []
        for i in range(steps):
            g = np.stack([gates[0][order[0, i]], gates[1][order[1, i]]])
            zr = _sigmoid(g[:, :, : 2 * HIDDEN] + np.matmul(h, p["uzr"]))
            z, r = zr[:, :, :HIDDEN] * real[i][None, :, None], zr[:, :, HIDDEN:]
            c = np.tanh(g[:, :, 2 * HIDDEN :] + np.matmul(r * h, p["uc"]))
            if keep is not None:
                trail.append((h, zr, r, c))
            h = h + z * (c - h)
            states[:, i] = h
        both = np.concatenate([states[0], states[1][turned, rows]], axis=2)
        hidden = np.tanh(both @ p["wa"] + p["ba"])
        score = np.where(real > 0, hidden @ p["va"], np.float32(-1e9))
        score = np.exp(score - score.max(axis=0))
        weight = score / score.sum(axis=0)
        pooled = (weight[:, :, None] * both).sum(axis=0)
        if keep is not None:
            keep.update(order=order, turned=turned, real=real, trail=trail, both=both, hidden=hidden, weight=weight, pooled=pooled)
        return pooled @ p["wo"] + p["bo"][0]

    def backward(self, k: dict, x: np.ndarray, gates: np.ndarray, d_logit: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        g = {name: np.zeros_like(v) for name, v in p.items()}
        steps, n = k["real"].shape
        rows = np.arange(n)[None, :]
        g["wo"], g["bo"][0] = k["pooled"].T @ d_logit, d_logit.sum()
        d_pooled = d_logit[:, None] * p["wo"][None, :]
        d_both = k["weight"][:, :, None] * d_pooled[None]
        d_weight = (k["both"] * d_pooled[None]).sum(axis=2)
        d_score = k["weight"] * (d_weight - (k["weight"] * d_weight).sum(axis=0))
        g["va"] = (k["hidden"] * d_score[:, :, None]).sum(axis=(0, 1))
        d_in = d_score[:, :, None] * p["va"] * (1 - k["hidden"] ** 2)
        g["wa"], g["ba"] = np.tensordot(k["both"], d_in, ((0, 1), (0, 1))), d_in.sum(axis=(0, 1))
        d_both = d_both + d_in @ p["wa"].T
        d_states = np.stack([d_both[:, :, :HIDDEN], d_both[:, :, HIDDEN:][k["turned"], rows]])
        d_gates = np.zeros_like(gates)
        d_h = np.zeros((2, n, HIDDEN), np.float32)
        for i in range(steps - 1, -1, -1):
            h, zr, r, c = k["trail"][i]
            real = k["real"][i][None, :, None]
            z = zr[:, :, :HIDDEN] * real
            d_h = d_h + d_states[:, i]
            d_c = d_h * z * (1 - c * c)
            d_rh = np.matmul(d_c, p["uc"].transpose(0, 2, 1))
            d_z = d_h * (c - h) * real
            d_zr = np.concatenate([d_z, d_rh * h], axis=2) * zr * (1 - zr)
            g["uc"] += np.matmul((r * h).transpose(0, 2, 1), d_c)
            g["uzr"] += np.matmul(h.transpose(0, 2, 1), d_zr)
            d_g = np.concatenate([d_zr, d_c], axis=2)
            for side in (0, 1):
                np.add.at(d_gates[side], k["order"][side, i], d_g[side] * real[0])
            d_h = d_h * (1 - z) + d_rh * r + np.matmul(d_zr, p["uzr"].transpose(0, 2, 1))
        g["bx"] = d_gates.sum(axis=1, keepdims=True)
        g["wx"] = np.matmul(x.T[None], d_gates)
        d_x = np.matmul(d_gates, p["wx"].transpose(0, 2, 1)).sum(axis=0)
        np.add.at(g["word"], k["ids"], d_x[:, :WORD_DIM])
        d_pool = d_x[:, WORD_DIM:] * (1 - k["filtered"] ** 2)
        w = np.arange(len(x))[:, None]
        cols = k["cols"][w, k["at"]]  # (words, FILTERS, WIDTH * CHAR_DIM)
        g["conv"] = np.einsum("wfd,wf->df", cols, d_pool)
        g["conv_b"] = d_pool.sum(axis=0)
        d_cols = (d_pool[:, :, None] * p["conv"].T[None]).reshape(len(x), FILTERS, WIDTH, CHAR_DIM)
        for i in range(WIDTH):
            np.add.at(g["char"], k["letters"][w, k["at"] + i], d_cols[:, :, i])
        return g


class Scorer:
    """Largest window logit of texts, remembering the gates of words that it has met."""

    def __init__(self, net: Network):
        self.net = net
        self.known: dict[str, int] = {}
        self.gates = np.zeros((2, 0, 3 * HIDDEN), np.float32)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if not new:
            return
        blocks = [self.gates[:, : len(self.known)]]
        for at in range(0, len(new), 2048):
            part = sorted(new[at : at + 2048], key=len)
            for w in part:
                self.known[w] = len(self.known)
            for i in range(0, len(part), 512):
                blocks.append(self.net.gates(self.net.inputs(*self.net.spelled(part[i : i + 512]))))
        self.gates = np.concatenate(blocks, axis=1)

    def window_logits(self, docs: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, first word, logit) of all windows, some thousands at a time."""
        flat = np.fromiter((i for words in docs for i in map(self.known.__getitem__, words)), np.int64)
        sizes = np.array([len(d) for d in docs], np.int64)
        begin = np.cumsum(sizes) - sizes
        spans = [(d, a, b) for d, n in enumerate(sizes.tolist()) for a, b in windows(n)]
        for i in range(0, len(spans), 4096):
            owner, start, stop = np.array(spans[i : i + 4096], np.int64).T
            at = (begin[owner] + start)[:, None] + np.arange(SPAN)
            yield owner, start, self.net.forward(self.gates, flat[np.minimum(at, len(flat) - 1)], stop - start)

    def score(self, docs: list[list[str]]) -> np.ndarray:
        """Probability that each document is toxic, by its most toxic window; without words, that of an empty window."""
        found = set().union(*docs) if docs else set()
        if len(self.known) > REMEMBERED:
            self.known, self.gates = {}, self.gates[:, :0]
        self.learn(found)
        best = np.full(len(docs), -np.inf, np.float64)
        for owner, _, logits in self.window_logits(docs):
            np.maximum.at(best, owner, logits.astype(np.float64))
        best[np.isinf(best)] = float(self.net.p["bo"][0])
        return 1 / (1 + np.exp(-np.clip(best, -60, 60)))


def train(texts: list[str], toxic: list[int], epochs: int | None = None, seed: int = SEED) -> Network:
    """A network fitted to whole documents, of which the label holds if any window is toxic.

    Each round takes steps for the most toxic window of each document and random ones of clean documents. What is most
    toxic comes from scoring all windows with the network so far; in the first rounds, from the word that the toxic
    documents have more often than the clean ones with the most significance, which also starts a component of the
    word's embedding. Deterministic for the same rows.
    """
    rng = np.random.default_rng(seed)
    docs = [words_of(t) for t in texts]
    y = np.array(toxic, np.float32)
    df = Counter(w for d in docs for w in set(d))
    words = {w: i + 1 for i, (w, n) in enumerate(sorted(df.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY]) if n > 2}
    chars = Counter(c for w in df for c in w)
    letters = {c: i + 4 for i, (c, _) in enumerate(sorted(chars.items(), key=lambda x: (-x[1], x[0]))[:ALPHABET])}
    net = Network.fresh(words, letters, rng)
    hits, total = Counter(w for d, t in zip(docs, toxic, strict=True) if t for w in set(d)), max(1, len(docs))
    n_toxic, n_clean = max(1, int(y.sum())), max(1, len(docs) - int(y.sum()))

    def excess(w: str) -> float:
        pooled = (df[w] + 1) / (total + 2)
        z = (hits[w] / n_toxic - (df[w] - hits[w]) / n_clean) / np.sqrt(pooled * (1 - pooled) * (1 / n_toxic + 1 / n_clean))
        return float(np.clip(z / 4, -3, 3))

    lean = {w: excess(w) for w in words}
    for w, i in words.items():
        net.p["word"][i, 0] = lean[w]
    net.p["word"][0, 0] = 0
    some = [i for i, d in enumerate(docs) if d]
    if not some or len({int(v) for v in y}) < 2:
        net.p["wo"][:] = 0
        net.p["bo"][0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0.0
        return net
    # Few documents: more rounds, so that there are some hundreds of steps in all.
    epochs = epochs or EPOCHS + min(30, 6000 // len(some))
    share = float(y[some].mean())
    net.p["bo"][0] = np.log(share / (1 - share)) if 0 < share < 1 else 0
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        best: dict[int, tuple[float, int]] = {}
        if epoch > 1:
            scorer = Scorer(net)
            scorer.learn(set(df))
            for owner, start, logits in scorer.window_logits(docs):
                for d, a, v in zip(owner.tolist(), start.tolist(), logits.tolist(), strict=True):
                    if d not in best or v > best[d][0]:
                        best[d] = (v, a)
        chosen: list[tuple[int, int, int]] = []
        for d in some:
            spans = windows(len(docs[d]))
            if d in best:
                a = best[d][1]
                chosen.append((d, a, min(a + SPAN, len(docs[d]))))
            else:
                most = max(range(len(docs[d])), key=lambda i, d=d: lean.get(docs[d][i], 0))
                chosen.append((d, *next(s for s in spans if s[0] <= most < s[1])))
            for _ in range(int(y[d] == 0)):
                chosen.append((d, *spans[rng.integers(len(spans))]))
        rate = RATE * min(1.0, 2 * (epochs - epoch) / epochs)
        for at in range(0, len(order := rng.permutation(len(chosen))), BATCH):
            picked = [chosen[i] for i in order[at : at + BATCH]]
            vocabulary = sorted({w for d, a, b in picked for w in docs[d][a:b]})
            local = {w: i for i, w in enumerate(vocabulary)}
            lengths = np.array([b - a for _, a, b in picked])
            index = np.array([[local[w] for w in docs[d][a:b]] + [0] * (SPAN - b + a) for d, a, b in picked])
            keep: dict = {}
            x = net.inputs(*net.spelled(vocabulary), keep)
            gates = net.gates(x)
            logits = net.forward(gates, index, lengths, keep)
            slope = ((_sigmoid(logits) - y[[d for d, _, _ in picked]]) / len(picked)).astype(np.float32)
            step += 1
            for k, grad in net.backward(keep, x, gates, slope).items():
                grad = np.clip(grad, -1, 1)
                m, v = moment[k]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def held_out(doc_id: str) -> Column:
    """Whether crc32 of the id as text leaves no rest by 5; such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """A network fitted on the documented sample of the labelled rows that aren't held out."""
    marks = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(marks, "doc_id").where(F.length("text") <= SAMPLE_CHARS)
    sample = [r for toxic, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)) for r in hashed_sample(rows.where(F.col("toxic") == toxic), "doc_id", n)]
    return train([r.text for r in sample], [r.toxic for r in sample])


def _score(net: Network):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in batches:
            texts, scores = batch.column("text"), []
            docs, size = [], 0
            for x in texts:
                docs.append(words_of(x.as_py()))
                size += len(docs[-1])
                if size > 400_000:
                    scores.append(scorer.score(docs))
                    docs, size = [], 0
            if docs:
                scores.append(scorer.score(docs))
            out = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, SCORE])

    return score


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """docs (text and any other columns) with SCORE: the largest over all windows of the whole text, between 0 and 1."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_score(net), f"{fields}, {SCORE} double")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all their columns as they are, whose score is under 0.5."""
    return scored(docs, fit(docs, labels)).where(F.col(SCORE) < 0.5).drop(SCORE)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Null and empty texts, and those without any word, get the score of an empty window. A null doc_id isn't held out.
    Repeated rows are scored each. Labels other than 0 and 1 are ignored; of repeated ones the largest counts; without
    labels of both kinds every document gets the labelled share. Other columns are ignored.
    """
    net = fit(docs, labels)
    rows = scored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), net)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= 0.5).cast("int").alias("predicted"))
