"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word: a learned vector by hashed word, the mean of learned vectors of its hashed character
runs (at the word's start and inside, word ends marked), and four fixed polarities (z-scored log-odds of the word, the
largest of the runs at its start, of those inside, and the mean) counted on the training rows, a row's own
count left out.  A forward and a backward GRU read
a window of ``WINDOW`` words, attention weights their states into one vector, and a linear layer
gives the window's logit.  A text is cut into overlapping windows every ``STRIDE`` words, all of them are
scored, and the text's score is that of its highest window.

Training knows only labels of whole texts, so each round scores all windows of every training text, takes
the highest one of each, and back-propagates through it (through time, Adam).  The executors read the training texts: they
count the polarities over whole texts and, round after round, return the highest window of each text, so what reaches
the driver is ``WINDOW`` words a labelled row and the polarity counts (a fixed number of rows), however long the texts are.  In half of the
training windows the polarities are blanked, so that the learned inputs carry the score too.  At most ``max_toxic``
toxic and three times as many other labelled rows are used; this bound on rows is the only one.  Rows held out (crc32 of the doc_id as
text, modulo 5, is 0) are never used.

Nulls: a null or empty text is one window of padding and gets that window's score; null labels are not
used; a null doc_id counts as "" for the split.  Without both classes every score is the share of toxic training
rows (0 without any).  Repeated rows score alike; rows that share a doc_id teach once, with the least text.  Empty tables give empty results; other columns are ignored, also clashing ones.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm.common import table, written

WINDOW, STRIDE = 32, 24
HIDDEN, EMBED, ATTEND = 8, 8, 8
WORD_ROWS = RUN_ROWS = 1 << 14          # learned rows
STAT_ROWS = 1 << 18                     # polarity rows
PIECE = 24                              # characters of a word read together; longer words go on as more words
PREFIXES, INNER = (3, 5, 6, 7, 8, 9), 4     # characters of the runs read at a word's start, and anywhere
CACHE = 150_000
TABLE_RATE = 0.3                        # the learned rows move slower than the network
DECAY = 0.1                             # share of a weight lost a step, in units of the rate
LEAST_TEXTS = 6                         # training texts a learned word or run stands in
BLANKED = 0.25                          # share of training windows that don't see the polarities
FIXED = 4                               # polarities of a word
TOKEN = re.compile(r"[^\W_]{1,%d}" % PIECE)
F32 = np.float32


def words_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def window_starts(n: int) -> range:
    """Every window start; consecutive windows share WINDOW - STRIDE words and cover all words."""
    return range(0, max(n - (WINDOW - STRIDE), 1), STRIDE)


# ---------------------------------------------------------------- inputs
def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: a hash of the word, hashes of its character runs, and which of those exist."""
    width = PIECE + 2
    chars = np.frombuffer("".join(f"^{w}$".ljust(width, "\0") for w in words).encode("utf-32-le"), "<u4").reshape(-1, width).astype(np.uint64)
    power = np.cumprod(np.full(width, 0x100000001B3, np.uint64))
    mix = lambda h: (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
    word = mix((chars * power).sum(axis=1))
    runs, real = [], []
    for n, starts in [(n, [0]) for n in PREFIXES] + [(INNER, range(width - INNER + 1))]:
        for i in starts:
            runs.append(mix((chars[:, i:i + n] * power[:n]).sum(axis=1) + np.uint64(n if i or n != INNER else 2 * n)))
            real.append(chars[:, i + n - 1] != 0)
    return word, np.stack(runs, axis=1), np.stack(real, axis=1)


def polarity(hit: np.ndarray, miss: np.ndarray, hits: int, misses: int) -> np.ndarray:
    """z-scored log-odds of presence counts, smoothed towards the class shares: 0 for what was never seen."""
    a, b = hits / (hits + misses), misses / (hits + misses)
    odds = np.log((hit + a) / hits) - np.log((miss + b) / misses) - np.log(a / hits) + np.log(b / misses)
    return (np.clip(odds / np.sqrt(1 / (hit + a) + 1 / (miss + b)), -6, 10) / 4).astype(F32)


def inputs(words: list[str], stats: dict) -> tuple:
    """(word row, word weight, run rows, run weights, polarities) of words, for the network's first layer.  Words and runs that stand
    in too few training texts have weight 0."""
    word, runs, real = hashed(words)
    at, each = (word % STAT_ROWS).astype(np.int64), (runs % STAT_ROWS).astype(np.int64)
    z = np.where(real, stats["runs"][each], 0)
    n, head = real.sum(axis=1), len(PREFIXES)
    fixed = np.stack([stats["words"][at], z[:, :head].max(axis=1), z[:, head:].max(axis=1), z.sum(axis=1) / n], axis=1).astype(F32)
    weight = (real & stats["known_runs"][each]) / n[:, None]
    return (word % WORD_ROWS).astype(np.int64), stats["known_words"][at].astype(F32), (runs % RUN_ROWS).astype(np.int64), weight.astype(F32), fixed


def first_layer(p: dict, x: tuple) -> np.ndarray:
    word, known, runs, weight, fixed = x
    chars = np.zeros((len(word), EMBED), F32)
    for i in range(runs.shape[1]):
        chars += p["runs"][runs[:, i]] * weight[:, i:i + 1]
    return np.concatenate([p["words"][word] * known[:, None], chars, fixed], axis=1)


# ---------------------------------------------------------------- network
def new_parameters(seed: int) -> dict:
    rng = np.random.default_rng(seed)
    d, h = 2 * EMBED + FIXED, HIDDEN
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(F32)
    p = {"words": init(WORD_ROWS, EMBED) * 0, "runs": (rng.standard_normal((RUN_ROWS, EMBED)) * 0.05).astype(F32), "A": init(2 * h, ATTEND), "a": init(ATTEND),
         "o": init(2 * h), "b": np.zeros(1, F32)}
    for k in "fb":
        p[f"W{k}"], p[f"U{k}"], p[f"c{k}"] = init(d, 3 * h), init(h, 3 * h), np.zeros(3 * h, F32)
    return p


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gru(gates: np.ndarray, u: np.ndarray, keep: bool = False):
    """States (T, N, H) of a GRU over input gates (T, N, 3H): update, reset, candidate."""
    t, n, _ = gates.shape
    states, h = np.empty((t, n, HIDDEN), F32), np.zeros((n, HIDDEN), F32)
    trace = []
    uzr, uc = u[:, :2 * HIDDEN], u[:, 2 * HIDDEN:]
    for i in range(t):
        zr = sigmoid(gates[i][:, :2 * HIDDEN] + h @ uzr)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(gates[i][:, 2 * HIDDEN:] + (r * h) @ uc)
        if keep:
            trace.append((h, z, r, c))
        h = c + z * (h - c)
        states[i] = h
    return states, trace


def gru_back(d_states: np.ndarray, trace: list, u: np.ndarray):
    """Gradients of the input gates (T, N, 3H) and of u."""
    uzr, uc = u[:, :2 * HIDDEN], u[:, 2 * HIDDEN:]
    d_gates = np.empty((*d_states.shape[:2], 3 * HIDDEN), F32)
    du, dh = np.zeros_like(u), np.zeros_like(d_states[0])
    for i in range(len(trace) - 1, -1, -1):
        h, z, r, c = trace[i]
        dh = dh + d_states[i]
        dc = dh * (1 - z) * (1 - c * c)
        drh = dc @ uc.T
        dz, dr = dh * (h - c) * z * (1 - z), drh * h * r * (1 - r)
        dzr = np.concatenate([dz, dr], axis=1)
        d_gates[i] = np.concatenate([dzr, dc], axis=1)
        du[:, :2 * HIDDEN] += h.T @ dzr
        du[:, 2 * HIDDEN:] += (r * h).T @ dc
        dh = dh * z + drh * r + dzr @ uzr.T
    return d_gates, du


def closed(gates: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Padding keeps the state: its update gate is shut."""
    gates[~real, :HIDDEN] = 30
    return gates


def pooled(p: dict, states: np.ndarray, real: np.ndarray):
    """Attention over the states (T, N, 2H) of the real words."""
    u = np.tanh(states @ p["A"])
    score = np.where(real, u @ p["a"], -30)
    e = np.exp(score - score.max(axis=0))
    alpha = e / e.sum(axis=0)
    return (alpha[:, :, None] * states).sum(axis=0), alpha, u


def logits(p: dict, gf: np.ndarray, gb: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Window logits from the forward and backward input gates (T, N, 3H)."""
    sf = gru(gf, p["Uf"])[0]
    sb = gru(gb[::-1], p["Ub"])[0][::-1]
    return pooled(p, np.concatenate([sf, sb], axis=2), real)[0] @ p["o"] + p["b"]


def gradients(p: dict, x: tuple, ids: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Gradients of the weighted log loss of windows ``ids`` (N, T; -1 pads) into the inputs ``x``."""
    used, place = np.unique(np.where(ids.T < 0, 0, ids.T), return_inverse=True)
    place = place.reshape(ids.T.shape)
    real = ids.T >= 0
    part = tuple(a[used] for a in x)
    inp = first_layer(p, part)
    d = inp[place]                                                       # (T, N, D)
    gf, gb = (closed(d @ p[f"W{k}"] + p[f"c{k}"], real) for k in "fb")
    sf, tf = gru(gf, p["Uf"], True)
    sb, tb = gru(gb[::-1], p["Ub"], True)
    states = np.concatenate([sf, sb[::-1]], axis=2)
    v, alpha, u = pooled(p, states, real)
    dl = ((sigmoid(v @ p["o"] + p["b"]) - y) * weight).astype(F32)
    g = {"o": v.T @ dl, "b": dl.sum(keepdims=True)}
    dv = dl[:, None] * p["o"]
    d_alpha = (states * dv).sum(axis=2)
    d_score = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
    du = d_score[:, :, None] * p["a"] * (1 - u * u)
    g["a"] = (u * d_score[:, :, None]).sum(axis=(0, 1))
    g["A"] = np.einsum("tnh,tna->ha", states, du)
    ds = alpha[:, :, None] * dv + du @ p["A"].T
    gates_f, g["Uf"] = gru_back(ds[:, :, :HIDDEN], tf, p["Uf"])
    gates_b, g["Ub"] = gru_back(ds[::-1, :, HIDDEN:], tb, p["Ub"])
    gates_b = gates_b[::-1]
    dx = np.zeros_like(d)
    for k, gate in (("f", gates_f), ("b", gates_b)):
        gate = np.where(real[:, :, None], gate, 0).astype(F32)
        g[f"W{k}"] = np.einsum("tnd,tng->dg", d, gate)
        g[f"c{k}"] = gate.sum(axis=(0, 1))
        dx += gate @ p[f"W{k}"].T
    per_word = np.zeros((len(used), dx.shape[2]), F32)
    np.add.at(per_word, place.reshape(-1), dx.reshape(-1, dx.shape[2]))
    g["words"], g["runs"] = np.zeros_like(p["words"]), np.zeros_like(p["runs"])
    np.add.at(g["words"], part[0], per_word[:, :EMBED] * part[1][:, None])
    for i in range(part[2].shape[1]):
        np.add.at(g["runs"], part[2][:, i], per_word[:, EMBED:2 * EMBED] * part[3][:, i:i + 1])
    return g


# ---------------------------------------------------------------- fitting and scoring
def word_gates(p: dict, x: tuple) -> tuple[np.ndarray, np.ndarray]:
    inp = first_layer(p, x)
    return tuple((inp @ p[f"W{k}"] + p[f"c{k}"]).astype(F32) for k in "fb")


def window_logits(p: dict, gates: tuple, ids: np.ndarray, step: int = 2048) -> np.ndarray:
    """Logits of windows (N, T) of rows of the word gates; -1 pads."""
    out = np.empty(len(ids), F32)
    for at in range(0, len(ids), step):
        w = np.ascontiguousarray(ids[at:at + step].T)
        real = w >= 0
        out[at:at + step] = logits(p, *(closed(g[w], real) if len(g) else closed(np.zeros((*w.shape, 3 * HIDDEN), F32), real) for g in gates), real)
    return out


def windows_of(n: int, first: int) -> np.ndarray:
    """Windows over positions first .. first + n - 1, padded with -1."""
    start = np.array(window_starts(n))
    at = start[:, None] + np.arange(WINDOW)
    return np.where(at < n, at + first, -1)


def tables(count: np.ndarray, hits: int, misses: int) -> dict:
    """Polarities and known rows of presence counts (kind, class, row)."""
    known = count.sum(axis=1) >= LEAST_TEXTS
    return {"words": polarity(count[0, 1], count[0, 0], hits, misses), "runs": polarity(count[1, 1], count[1, 0], hits, misses),
            "known_words": known[0], "known_runs": known[1]}


def without(count: np.ndarray, y: int) -> np.ndarray:
    """The counts without one text of class ``y``, at every row that it has."""
    return np.maximum(count - np.array([1 - y, y])[None, :, None], 0)


def blank(stats: dict) -> dict:
    """The same without polarities."""
    return {k: v if k.startswith("known") else np.zeros_like(v) for k, v in stats.items()}


def batch_rows(windows: list[list[str]], labels: np.ndarray, stats: list[dict]) -> tuple[tuple, np.ndarray, int]:
    """Inputs of all words of the windows as clean and toxic texts see them, then both without polarities; the windows' rows in the first
    two; and how many rows further (twice that number) a row's blanked one is."""
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for win in windows for w in win))}
    n = len(vocabulary)
    x = tuple(np.concatenate(part) for part in zip(*(inputs(list(vocabulary), s) for s in (*stats, *map(blank, stats)))))
    ids = np.full((len(windows), WINDOW), -1)
    for r, win in enumerate(windows):
        ids[r, :len(win)] = [vocabulary[w] for w in win]
    return x, np.where(ids >= 0, ids + n * labels[:, None], -1), n


def fit(labels: np.ndarray, count: np.ndarray, highest, seed: int = 5, rounds: int = 6, passes: int = 4, rate: float = 0.02) -> dict:
    """Fits the network to texts with labels 0 and 1.  ``count``: presence counts (kind, class, row) of their words and runs;
    ``highest(model)``: the words of each text's highest window, scored as a model's ``stats`` by class and ``p`` (None: by polarity) do."""
    rng = np.random.default_rng(seed)
    hits, misses = int((labels == 1).sum()), int((labels == 0).sum())
    if not hits or not misses or not count.any():
        return {"constant": hits / max(hits + misses, 1)}
    # in training a text's own count is left out of the polarities it sees
    stats = [tables(without(count, y), hits, misses) for y in (0, 1)]
    p = new_parameters(seed)
    p["Wf"][2 * EMBED:], p["Wb"][2 * EMBED:] = np.abs(p["Wf"][2 * EMBED:]), np.abs(p["Wb"][2 * EMBED:])
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for turn in range(rounds):
        windows = highest({"p": p if turn else None, "stats": stats})     # the first round starts from the polarities
        x, ids, n = batch_rows(windows, labels, stats)
        if not n:
            break
        n_batches = -(-len(ids) // 128)
        for _ in range(max(passes, -(-60 // n_batches))):                # few texts are seen more often
            for batch in np.array_split(rng.permutation(len(ids)), n_batches):
                y = labels[batch]
                hide = (rng.random(len(batch)) < BLANKED)[:, None] & (ids[batch] >= 0)
                g = gradients(p, x, ids[batch] + np.where(hide, 2 * n, 0), y, np.full(len(batch), 1 / len(batch)))
                step += 1
                for k, d in g.items():
                    m, v = moment[k]
                    m += 0.1 * (d - m)
                    v += 0.01 * (d * d - v)
                    pace = rate * TABLE_RATE if k in ("words", "runs") else rate
                    if DECAY and k not in ("b", "cf", "cb"):
                        p[k] *= F32(1 - pace * DECAY)
                    p[k] -= (pace * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)).astype(F32)
    return {"p": p, "stats": tables(count, hits, misses)}


class Scorer:
    """Scores texts; keeps the input gates of words already seen (bounded).  Without a network a word counts by its polarity and
    a window by its loudest word."""

    def __init__(self, model: dict):
        self.model = model
        self.reset()

    def reset(self):
        self.rows: dict[str, int] = {}
        width = 3 * HIDDEN if self.model.get("p") else 1
        self.gates = tuple(np.zeros((0, width), F32) for _ in "fb")

    def word_values(self, words: list[str]) -> tuple:
        x = inputs(words, self.model["stats"])
        return word_gates(self.model["p"], x) if self.model["p"] else (x[-1][:, :2].max(axis=1, keepdims=True),) * 2

    def look_up(self, words: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(w for w in words if w not in self.rows))
        if new:
            if len(self.rows) + len(new) > CACHE and self.rows:
                self.reset()
                new = list(dict.fromkeys(words))
            for at in range(0, len(new), 4096):
                some = new[at:at + 4096]
                fresh = self.word_values(some)
                self.grow(len(self.rows) + len(some))
                for g, f in zip(self.gates, fresh):
                    g[len(self.rows):len(self.rows) + len(some)] = f
                self.rows.update(zip(some, range(len(self.rows), len(self.rows) + len(some))))
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def grow(self, n: int):
        if n > len(self.gates[0]):
            self.gates = tuple(np.concatenate([g, np.zeros((max(n, 2 * len(g)) - len(g), g.shape[1]), F32)]) for g in self.gates)

    def window_scores(self, ids: np.ndarray) -> np.ndarray:
        if self.model["p"]:
            return window_logits(self.model["p"], self.gates, ids)
        values = np.append(self.gates[0][:, 0], F32(-9))                 # -1, the padding, is the last
        return values[ids].max(axis=1)

    def best(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[str]]]:
        """The logit and the words of each text's highest window (ties: the first); long texts are looked up and scored in runs of windows."""
        best = np.full(len(texts), -np.inf, F32)
        where: list[list[str]] = [[] for _ in texts]
        held, owners, size = [], [], 0

        def flush():
            nonlocal size
            rows = self.look_up([w for ws in held for w in ws])
            wins, first = [], 0
            for ws in held:
                wins.append(windows_of(len(ws), first))
                first += len(ws)
            at = np.concatenate(wins)
            score = self.window_scores(np.where(at >= 0, rows[at], -1) if len(rows) else at)
            part = np.repeat(np.arange(len(held)), [len(w) for w in wins])
            begin = np.cumsum([0] + [len(w) for w in wins])
            order = np.lexsort((np.arange(len(score)), -score, part))
            for i in order[np.r_[True, part[order][1:] != part[order][:-1]]].tolist():
                k, d = int(part[i]), owners[part[i]]
                if score[i] > best[d]:
                    best[d] = score[i]
                    start = (i - int(begin[k])) * STRIDE
                    where[d] = held[k][start:start + WINDOW]
            held.clear()
            owners.clear()
            size = 0

        for d, text in enumerate(texts):
            words = words_of(text)
            starts = window_starts(len(words))
            for at in range(0, len(starts), 2000):                       # whole windows of one text at a time
                piece = words[starts[at]:starts[min(at + 2000, len(starts)) - 1] + WINDOW]
                held.append(piece)
                owners.append(d)
                size += len(piece)
                if size >= 50_000:
                    flush()
        if held:
            flush()
        return best, where

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores 0 to 1 of whole texts."""
        if "constant" in self.model:
            return np.full(len(texts), float(self.model["constant"]))
        return 1 / (1 + np.exp(-self.best(texts)[0].astype(np.float64)))


def held_out(id_col):
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, max_toxic: int, seed: int) -> DataFrame:
    """(id, y, text) of at most ``max_toxic`` toxic texts and three times as many others, whole, written to the shared folder."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).filter(~held_out(F.col("id")) & F.col("id").isNotNull()).distinct()
    some = known.filter("y = 1").orderBy(order).limit(max_toxic).unionByName(known.filter("y = 0").orderBy(order).limit(3 * max_toxic))
    chosen = written(some, "sample")
    body = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).join(chosen, "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    return written(body.repartition("id"), "training")


def presence(rows: DataFrame) -> np.ndarray:
    """Counts (kind, class, row) of the texts in which a hashed word (kind 0) or run (kind 1) stands, over whole texts."""
    def run(batches):
        import pandas as pd

        count = np.zeros((2, 2, STAT_ROWS), np.int64)
        for b in batches:
            for y, t in zip(b.y, b.text):
                words = list(dict.fromkeys(words_of(t)))
                seen = [np.zeros(0, np.int64)] * 2
                for at in range(0, len(words), 4096):
                    word, runs, real = hashed(words[at:at + 4096])
                    seen = [np.unique(np.concatenate([s, (h % STAT_ROWS).astype(np.int64)])) for s, h in zip(seen, (word, runs[real]))]
                for kind in (0, 1):
                    count[kind, y, seen[kind]] += 1
        cell = np.flatnonzero(count)
        yield pd.DataFrame({"cell": cell, "n": count.reshape(-1)[cell]})

    got = rows.select("y", "text").mapInPandas(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(4 * STAT_ROWS, np.int64)                                # as many rows at most
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.reshape(2, 2, STAT_ROWS)


def highest_windows(rows: DataFrame, model: dict) -> dict:
    """id -> words of the highest window of each training text, scored on the executors."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pandas as pd

        of = [Scorer({"p": sent.value["p"], "stats": s}) for s in sent.value["stats"]]
        for b in batches:
            out = [None] * len(b)
            for y in (0, 1):
                at = np.flatnonzero(b.y == y)
                for i in range(0, len(at), 256):
                    for k, words in zip(at[i:i + 256], of[y].best([b.text.iloc[j] for j in at[i:i + 256]])[1]):
                        out[k] = " ".join(words)
            yield pd.DataFrame({"id": b.id, "window": out})

    got = {r.id: r.window.split() for r in rows.mapInPandas(run, "id bigint, window string").collect()}
    sent.unpersist()
    return got


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_toxic: int = 700, seed: int = 5) -> dict:
    """The model of the labelled rows not held out."""
    rows = training_rows(docs, labels, id_col, text, label, max_toxic, seed)
    known = sorted((r.id, r.y) for r in rows.select("id", "y").collect())    # 4 * max_toxic at most
    order = [i for i, _ in known]

    def highest(model):
        got = highest_windows(rows, model)
        return [got[i] for i in order]

    return fit(np.array([y for _, y in known], np.int64), presence(rows), highest, seed)


def toxicity(docs: DataFrame, labels: DataFrame, keys: list[str], id_col: str = "doc_id", text: str = "text", label: str = "toxic",
             max_toxic: int = 700, seed: int = 5) -> DataFrame:
    """(keys..., score) for every row of ``docs``; the model is fitted to the labelled rows not held out."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, id_col, text, label, max_toxic, seed))
    src = docs.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]] + ["score double"])

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(model.value)
        for b in batches:
            for at in range(0, max(b.num_rows, 1), 512):
                part = b.slice(at, 512)
                score = scorer.scores(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), pa.array(score)], [*keys, "score"])

    return src.mapInArrow(run, schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
