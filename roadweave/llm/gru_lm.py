"""LM scoring by a gated recurrent network in numpy: truncated backpropagation through time, an output softmax factored by classes, and a
state carried from window to window, so a score is the log-likelihood of a complete document.

Words are bytes between white space, A-Z lower-cased. The corpus gives counts of all words. Its most frequent ones, HEAD of them at
most, go to every task; the network knows the first TOP of them one by one, in classes of WIDTH, and the rest in BANDS of equal
counts, inside which a word has its share of the counts. All other words are one class to the network, and their share in it comes
from a join on the word, so the vocabulary may be of any size.

Texts are read twice: to count words, and to write each document as network inputs with the words outside the head. Training and
scoring read those.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches, written

#: Head words and their longest length in bytes (together 8 MB at most), words with a row of their own, words in a class, bands, units.
HEAD, LONGEST, TOP, WIDTH, BANDS, UNITS = 1 << 17, 64, 2048, 64, 8, 24
TAIL_IN, END_IN = TOP + BANDS, TOP + BANDS + 1
TAIL_CLASS = TOP // WIDTH + BANDS
INPUTS, CLASSES = END_IN + 1, TAIL_CLASS + 2
#: Documents side by side; steps that are learned from, or scored, at a time, at least and, where few documents run, at most.
LANES, WINDOW, LONG_WINDOW, SCORE_WINDOW = 384, 16, 128, 16
#: Tokens of a window that a learner's rate is for.
RATED = 4096
#: Documents of up to so many tokens wait together, until there are so many tokens of them: lanes then end at about the same step.
POOLS = ((1024, 400_000), (4096, 1_600_000), (1 << 62, 4_000_000))
FLUSH = 600_000
#: A word's row holds its weights, then its bias.
SHAPES = {"gates": (INPUTS, 3 * UNITS), "state": (3 * UNITS, UNITS), "classes": (CLASSES, UNITS + 1), "words": (TOP, UNITS + 1)}
#: Rows of an input in a window from which on they are summed by a product.
MANY = 32
#: Logits are held within this, so that no exponent leaves the range of single precision.
STEEPEST = 60.0


def start_weights(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in SHAPES.items()}
    w["classes"][:, -1] = w["words"][:, -1] = 0
    return w


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of some texts, as numbers into the distinct ones, and the text of each. A null text has none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten()
    owner = np.repeat(np.arange(len(split)), split.value_lengths().to_numpy())
    real = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(real).dictionary_encode(), owner[real.to_numpy(zero_copy_only=False)]


@dataclass
class Vocabulary:
    """Head words by falling count; of each: input row, log10 of its base probability, and log10 of its share in a band (0 in TOP). One more
    entry stands for words outside the head (base 0: it comes from the join), and a last one for the end.
    n, v: all training tokens and distinct ones; tail_n, tail_v: those outside the head; ends: training documents."""

    words: list[str]
    inputs: np.ndarray
    base: np.ndarray
    share: np.ndarray
    n: int
    v: int
    tail_n: int
    tail_v: int
    ends: int

    @classmethod
    def of(cls, head: list[tuple[str, int]], n: int, v: int, ends: int) -> Vocabulary:
        counts = np.array([c for _, c in head], float)
        rest = counts[TOP:]
        edge = np.cumsum(rest) / max(1.0, rest.sum())
        band = np.minimum((edge * BANDS - 1e-9).astype(int), BANDS - 1) if len(rest) else np.empty(0, int)
        sums = np.bincount(band, weights=rest, minlength=BANDS)
        inputs = np.concatenate([np.arange(min(TOP, len(head))), TOP + band, [TAIL_IN, END_IN]]).astype(np.uint16)
        whole = n + 0.1 * (v + 1)
        base = np.concatenate([np.log10((counts + 0.1) / whole), [0.0, np.log10((ends + 0.1) / whole)]])
        share = np.concatenate([np.zeros(min(TOP, len(head))), np.log10(rest / sums[band]), [0.0, 0.0]])
        return cls([w for w, _ in head], inputs, base, share, n, v, int(n - ends - counts.sum()), v - len(head) - bool(ends), ends)

    def codes(self, distinct: pa.Array) -> np.ndarray:
        """Place in the head of each word; the number of head words for one outside it."""
        return pc.index_in(distinct, value_set=pa.array(self.words, pa.string())).fill_null(len(self.words)).to_numpy(zero_copy_only=False)


class Lanes:
    """Documents laid end to end in lanes of like length, longest lane first, so a step is one operation over all that still run."""

    def __init__(self, docs: list[np.ndarray]):
        sizes = [len(d) for d in docs]
        n = max(1, min(LANES, len(docs), -(-sum(sizes) // max(sizes))))
        loads, mine = [(0, k) for k in range(n)], [[] for _ in range(n)]
        for d in sorted(range(len(docs)), key=lambda d: -sizes[d]):
            load, k = heapq.heappop(loads)
            mine[k].append(d)
            heapq.heappush(loads, (load + sizes[d], k))
        mine.sort(key=lambda ds: -sum(sizes[d] for d in ds))
        self.docs = mine
        lengths = np.array([sum(sizes[d] for d in ds) for ds in mine])
        steps = int(lengths.max())
        self.target = np.zeros((steps, n), np.uint16)
        self.source = np.full((steps, n), END_IN, np.uint16)
        self.keep = np.ones((steps, n), bool)
        self.starts = []
        for k, ds in enumerate(mine):
            row = np.concatenate([docs[d] for d in ds])
            self.target[: len(row), k] = row
            self.source[1 : len(row), k] = row[:-1]
            at = np.cumsum([0, *(sizes[d] for d in ds)])[:-1]
            self.source[at, k] = END_IN
            self.keep[at, k] = False
            self.starts.append(at)
        self.active = np.searchsorted(-lengths, -np.arange(steps), side="left")

    def windows(self, length: int) -> Iterator[Window]:
        for a in range(0, len(self.target), length):
            yield Window(self, a, min(a + length, len(self.target)))


class Window:
    """Steps a to b - 1 of all lanes that run, one after another; cuts are where each step begins, keep is 0 where a document does."""

    def __init__(self, lanes: Lanes, a: int, b: int):
        sizes = lanes.active[a:b]
        self.a, self.cuts = a, np.concatenate([[0], np.cumsum(sizes)]).tolist()
        runs = np.arange(lanes.target.shape[1]) < sizes[:, None]
        self.source, self.target, self.keep = lanes.source[a:b][runs], lanes.target[a:b][runs], lanes.keep[a:b][runs].astype(np.float32)


def forward(w: dict[str, np.ndarray], x: Window, h: np.ndarray, learn: bool = True) -> tuple[np.ndarray, dict]:
    """The state after a window (units by lanes), its steps' states (units, then ones, by tokens), and, with learn, what each step did. In memory tokens come
    first and each gate is an array of its own, so a step works on short whole stretches and nothing is turned over."""
    n = len(x.source)
    signs = np.array([-1, -1, 1], np.float32)[:, None, None]  # a gate is 1 / (1 + exp of the negative)
    inputs = (w["gates"].reshape(INPUTS, 3, UNITS).swapaxes(0, 1) * signs).take(x.source, axis=1)
    turned = np.ascontiguousarray(w["state"].reshape(3, UNITS, UNITS).swapaxes(1, 2) * signs)
    states, steps, h = np.ones((n, UNITS + 1), np.float32), [], h.T
    for s, e in zip(x.cuts, x.cuts[1:]):
        before = h[: e - s] * x.keep[s:e, None]
        u = before @ turned
        zr = inputs[:2, s:e]
        zr += u[:2]
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r, u = zr[0], zr[1], u[2]
        new = r * u
        new += inputs[2, s:e]
        new *= -2  # its tanh is 2 / (1 + exp of minus twice it) - 1, faster than np.tanh
        np.exp(new, out=new)
        new += 1
        np.divide(2, new, out=new)
        new -= 1
        h = before - new
        h *= z
        h += new
        if learn:
            steps.append((before, z, r, new, u))
        states[s:e, :UNITS] = h
    return h.T, {"states": states.T, "steps": steps}


def softmax(logits: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural log of the probability that each row gives its picked column, and each row's sum; logits become probabilities times that sum."""
    np.clip(logits, -STEEPEST, STEEPEST, out=logits)
    own = logits[np.arange(len(logits)), picked]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], np.float32)
    return own - np.log(total), total


def outputs(w: dict[str, np.ndarray], states: np.ndarray, target: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray | None, dict]:
    """log probability (natural) of each target's class and word; with learn, the gradients of the sum's negative, by state (tokens by units) and by
    weight."""
    states = states.T
    cls = np.where(target < TOP, target // WIDTH, target - (TOP - TOP // WIDTH)).astype(np.intp)
    e = states @ w["classes"].T
    logp, e_sum = softmax(e, cls)
    order = np.flatnonzero(target < TOP)
    order = order[np.argsort(target[order], kind="stable")]
    own = target[order]
    cuts = np.searchsorted(own, np.arange(0, TOP + 1, WIDTH)).tolist()
    s, place = states[order], (own % WIDTH).astype(np.intp)
    f = np.empty((len(order), WIDTH), np.float32)
    spans = [(slice(c * WIDTH, (c + 1) * WIDTH), slice(a, b)) for c, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    for rows, at in spans:
        np.matmul(s[at], w["words"][rows].T, out=f[at])
    inside, f_sum = softmax(f, place)
    logp[order] += inside
    if not learn:
        return logp, None, {}
    for x, total, picked in ((e, e_sum, cls), (f, f_sum, place)):
        x *= np.reciprocal(total)[:, None]
        x[np.arange(len(x)), picked] -= 1
    grads = {"classes": e.T @ states, "words": np.zeros(SHAPES["words"], np.float32)}
    back, part = e @ w["classes"][:, :-1], np.empty((len(order), UNITS), np.float32)
    for rows, at in spans:
        np.matmul(f[at], w["words"][rows, :-1], out=part[at])
        np.matmul(f[at].T, s[at], out=grads["words"][rows])
    back[order] += part
    return logp, back, grads


class Learner:
    """Adam on windows of a group of lanes; the state runs through every window, and each is learned from. mean: the weights on the way,
    averaged by tokens. rate is for windows of up to RATED tokens; longer ones, whose mean gradient is steadier, move as much further."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.w = {k: v.copy() for k, v in weights.items()}
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.rate, self.steps, self.tokens = rate, 0, 0

    def learn(self, docs: list[np.ndarray]) -> None:
        lanes = Lanes(docs)
        h = np.zeros((UNITS, lanes.target.shape[1]), np.float32)
        for x in lanes.windows(min(LONG_WINDOW, WINDOW * LANES // h.shape[1])):
            h, past = forward(self.w, x, h)
            self.update(gradients(self.w, x, past), len(x.target))

    def update(self, grads: dict[str, np.ndarray], tokens: int) -> None:
        self.steps, self.tokens = self.steps + 1, self.tokens + tokens
        part = np.float32(tokens / self.tokens)
        size = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values())) / tokens
        scale = np.float32(min(1.0, 1.0 / (size + 1e-9)) / tokens)
        rate = np.float32(self.rate * max(1.0, tokens / RATED) * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps))
        for k, g in grads.items():
            g = g * scale
            m, v = self.m[k], self.v[k]
            m += 0.1 * (g - m)
            g *= g
            g -= v
            g *= np.float32(0.01)
            v += g
            root = np.sqrt(v)
            root += np.float32(1e-8)
            np.divide(m, root, out=root)
            root *= rate
            self.w[k] -= root
            np.subtract(self.w[k], self.mean[k], out=root)
            root *= part
            self.mean[k] += root


def gradients(w: dict[str, np.ndarray], x: Window, past: dict) -> dict[str, np.ndarray]:
    """Gradients of a window's negative log probability, backwards through its steps and no further."""
    _, back, grads = outputs(w, past["states"], x.target, True)
    n, state, later = len(x.target), w["state"].reshape(3, UNITS, UNITS), None
    through, to_new, before = np.empty((3, n, UNITS), np.float32), np.empty((n, UNITS), np.float32), np.empty((n, UNITS), np.float32)
    for s, e, (held, z, r, new, u) in zip(x.cuts[-2::-1], x.cuts[:0:-1], past["steps"][::-1]):
        d, (dz, dr, du), dn = back[s:e], through[:, s:e], to_new[s:e]
        before[s:e] = held
        if later is not None:
            d[: len(later)] += later
        kept = d * z
        np.subtract(held, new, out=dz)  # of z: d (before - new) z (1 - z)
        dz *= kept
        np.subtract(d, kept, out=dn)  # of the new state: d (1 - z) (1 - new new)
        new *= new
        np.subtract(1, new, out=new)
        np.subtract(1, z, out=z)
        dz *= z
        dn *= new
        np.multiply(dn, r, out=du)
        np.subtract(1, r, out=r)
        np.multiply(du, u, out=dr)  # of r: dn u r (1 - r)
        dr *= r
        a, b, c = through[:, s:e] @ state
        later = kept
        for part in (a, b, c):
            later += part
        later *= x.keep[s:e, None]
    order = np.argsort(x.source, kind="stable")
    source = x.source[order]
    cuts = np.append(np.flatnonzero(np.diff(source.astype(np.int32), prepend=-1)), n)
    gates, sizes = np.concatenate([through[0], through[1], to_new], axis=1)[order], np.diff(cuts)
    grads["gates"], ones = np.zeros(SHAPES["gates"], np.float32), np.ones(sizes.max(), np.float32)
    few = sizes <= MANY
    rare = gates[np.repeat(few, sizes)]
    if len(rare):
        grads["gates"][source[cuts[:-1][few]]] = np.add.reduceat(rare, np.cumsum(sizes[few]) - sizes[few], axis=0)
    for a, k in zip(cuts[:-1][~few].tolist(), sizes[~few].tolist()):  # inputs of many rows are summed one by one
        grads["gates"][source[a]] = ones[:k] @ gates[a : a + k]
    grads["state"] = (through.swapaxes(1, 2) @ before).reshape(SHAPES["state"])
    return grads


def score_documents(w: dict[str, np.ndarray], docs: list[np.ndarray]) -> np.ndarray:
    """log10 of class and word probabilities summed over each document (input rows, the end included)."""
    lanes = Lanes(docs)
    h = np.zeros((UNITS, lanes.target.shape[1]), np.float32)
    logp = np.zeros(lanes.target.shape, np.float32)
    for x in lanes.windows(SCORE_WINDOW):
        h, past = forward(w, x, h, learn=False)
        found, _, _ = outputs(w, past["states"], x.target, False)
        for t, (s, e) in enumerate(zip(x.cuts, x.cuts[1:])):
            logp[x.a + t, : e - s] = found[s:e]
    out = np.zeros(len(docs))
    for k, (ds, starts) in enumerate(zip(lanes.docs, lanes.starts, strict=True)):
        out[ds] = np.add.reduceat(logp[:, k].astype(float), starts)
    return out / np.log(10)


def keep_freed() -> None:
    """Lets a Python process keep up to some 62 MB of what it frees: glibc raises its own bounds when an array of this size is freed. A window's arrays
    then take memory that is there, not new pages each time."""
    np.empty(31 << 20, np.uint8)


def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """The first column's values and the second's network inputs, in groups of documents of like length."""
    held: list[tuple[list[int], list[np.ndarray]]] = [([], []) for _ in POOLS]
    sizes = [0] * len(POOLS)
    for batch in batches:
        for uid, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(data, np.uint16)
            k = next(k for k, (longest, _) in enumerate(POOLS) if len(x) <= longest)
            held[k][0].append(uid)
            held[k][1].append(x)
            sizes[k] += len(x)
            if sizes[k] >= POOLS[k][1]:
                yield held[k]
                held[k], sizes[k] = ([], []), 0
    yield from (x for x in held if x[0])


def count_words(docs: DataFrame) -> DataFrame:
    """word and n over all rows of the column text. Tasks add up what they can hold before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        total = lambda: pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
        for batch in pieces(batches, text=0):
            words, _ = split_words(batch.column(0))
            found = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            held.append(pa.table({"word": words.dictionary, "n": found.astype(np.int64)}))
            rows += len(found)
            if rows > 2 * FLUSH:
                whole = total()
                held, rows = [whole.rename_columns(["word", "n"])], len(whole)
                if rows > FLUSH:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from total().rename_columns(["word", "n"]).to_batches()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(counts: DataFrame, most: int = HEAD) -> list[tuple[str, int]]:
    """The most frequent words of at most LONGEST bytes and their counts, by falling count; most of them at most.

    Counts fall into classes, an eighth of an octave each. Whole classes are taken from the top; of the first that is too large
    those words whose hash is low. So what reaches the driver is a few hundred numbers and the head itself.
    """
    rows = counts.filter(F.octet_length("word") <= LONGEST).withColumn("class", F.floor(F.log2("n") * 8).cast("int"))
    left, whole, some, share = most, 1 << 30, None, 0.0
    for r in rows.groupBy("class").count().orderBy(F.desc("class")).collect():
        if r["count"] > left:
            some, share = r["class"], left / r["count"]
            break
        left, whole = left - r["count"], r["class"]
    low = F.xxhash64("word") <= int(-(2**63) + max(0.0, share - 3 * (share / max(1, left)) ** 0.5 * share**0.5) * (2**64 - 2**12))
    chosen = rows.filter((F.col("class") >= whole) | ((F.col("class") == some) & low) if some is not None else F.col("class") >= whole)
    return sorted(((r["word"], r["n"]) for r in chosen.select("word", "n").collect()), key=lambda x: (-x[1], x[0]))[:most]


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES])


def shaped(x: np.ndarray) -> dict[str, np.ndarray]:
    cuts = np.cumsum([int(np.prod(s)) for s in SHAPES.values()])[:-1]
    return {k: v.reshape(s).astype(np.float32) for (k, s), v in zip(SHAPES.items(), np.split(x, cuts), strict=True)}


def coded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """uid, doc_id and learn as they are, n_tokens, known (tokens of the head that were learned from), base and share (sums over them), inputs
    (of the network, two bytes each), and the words outside the head with their times."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        tail = len(v.words)
        for batch in pieces(batches, text=3):
            n = batch.num_rows
            words, owner = split_words(batch.column(3))
            place = words.indices.to_numpy()
            codes = v.codes(words.dictionary)[place]
            sizes = np.bincount(owner, minlength=n)
            ends = np.cumsum(sizes)
            base, share = (np.bincount(owner, x[codes], n) for x in (v.base, v.share))
            inputs = np.insert(v.inputs[codes], ends, END_IN)
            starts = np.concatenate([[0], ends + np.arange(1, n + 1)]).astype(np.int32) * 2
            out = np.flatnonzero(codes == tail)
            pairs, times = np.unique(owner[out] * len(words.dictionary) + place[out], return_counts=True)
            lists = pa.array(np.concatenate([[0], np.cumsum(np.bincount(pairs // max(1, len(words.dictionary)), minlength=n))]).astype(np.int32))
            known = sizes - np.bincount(owner[out], minlength=n) + bool(v.ends)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2), pa.array(sizes + 1), pa.array(known), pa.array(base + v.base[-1]), pa.array(share),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(starts.tobytes()), pa.py_buffer(inputs.tobytes())]),
                    pa.ListArray.from_arrays(lists, words.dictionary.take(pa.array(pairs % max(1, len(words.dictionary))))), pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int64))),
                ], names=["uid", "doc_id", "learn", "n_tokens", "known", "base", "share", "inputs", "tail", "times"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "learn", "text")
    return rows.mapInArrow(run, "uid long, doc_id long, learn boolean, n_tokens long, known long, base double, share double, inputs binary, tail array<string>, times array<long>")


def averaged(parts: DataFrame, fan_in: int = 16) -> DataFrame:
    """One row of parts (tokens, weights): the mean of weights by tokens, in a tree of tasks of fan_in rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = 0, 0.0
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens, total = tokens + n, total + np.frombuffer(data, np.float32).astype(np.float64) * n
        if tokens:
            yield weights_row(tokens, total / tokens)

    n = parts.count()
    while n > 1:
        n = -(-n // fan_in)
        parts = parts.repartition(n).mapInArrow(run, "tokens long, weights binary")
    return parts


def weights_row(tokens: int, weights: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([weights.astype(np.float32).tobytes()], pa.binary())], names=["tokens", "weights"])


def train(codes: DataFrame, documents: int, warm_rows: int = 1000) -> dict[str, np.ndarray]:
    """Weights learned from all rows of the column inputs, documents many: a start from some warm_rows of them in one task, then every
    partition goes on from there over all its documents, and the results are averaged by tokens. Every window is learned from. Only
    averaged weights, under a megabyte, reach the driver."""
    rows = codes.select(F.lit(0).alias("uid"), "inputs")

    def learner(weights: dict[str, np.ndarray], rate: float, passes: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep_freed()
            own, tokens = Learner(weights, rate), 0
            for _, docs in pooled(batches):
                for _ in range(passes):
                    own.learn(docs)
                tokens += sum(map(len, docs))
            if tokens:
                yield weights_row(tokens, flat(own.mean))

        return run

    def mean(parts: DataFrame, otherwise: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        found = parts.collect()
        return shaped(np.frombuffer(found[0]["weights"], np.float32)) if found else otherwise

    share = min(1.0, 1.2 * warm_rows / max(1, documents))
    few = rows.filter(F.xxhash64("inputs") <= int(-(2**63) + share * (2**64 - 2**12))).limit(2 * warm_rows)
    weights = mean(few.coalesce(1).mapInArrow(learner(start_weights(), 0.01, 2), "tokens long, weights binary"), start_weights())
    return mean(averaged(written(rows.mapInArrow(learner(weights, 0.01, 1), "tokens long, weights binary"), "weights")), weights)


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs, learning from rows where learn holds (null: not).

    A null or empty text is one end token. Repeated ids are scored row by row. If nothing is learned from, all words are unknown and
    the network is untrained. Scores are log10 and finite. Other columns are left out.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    lessons = docs.filter("learn")
    counts = written(count_words(lessons), "word-counts")
    ends = lessons.count()
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    v = Vocabulary.of(head_words(counts), totals[0] + ends, totals[1] + bool(ends), ends)
    codes = written(coded(docs, v), "coded")
    weights = train(codes.filter("learn"), ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        for uids, rows in pooled(batches):
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(score_documents(weights, rows))], names=["uid", "score"])

    # The network's sum, the document's own sums, and those over its words outside the head, each of which comes from a join on the word;
    # words of the head never come up there, so no word is frequent in it.
    fields = ["doc_id", "n_tokens", "known", "base", "score", "tails", "logs"]
    empty = {"doc_id": "long", "n_tokens": "long", "known": "long", "base": "double", "score": "double", "tails": "long", "logs": "double"}
    sums = lambda df, **own: df.select("uid", *(own.get(k, F.lit(None).cast(t)).alias(k) for k, t in empty.items()))
    network = sums(codes.select("uid", "inputs").mapInArrow(run, "uid long, score double"), score=F.col("score"))
    plain = sums(codes, doc_id=F.col("doc_id"), n_tokens=F.col("n_tokens"), known=F.col("known"), base=F.col("base"), score=F.col("share"))
    tail = codes.select("uid", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("uid", F.col("x.tail").alias("word"), F.col("x.times").alias("times")).join(counts, "word", "left")
    c = F.coalesce("n", F.lit(0))
    tail = sums(tail, known=F.when(c > 0, F.col("times")), tails=F.col("times"), logs=F.col("times") * F.log10(c + F.lit(0.1)))
    whole, rest = float(np.log10(v.n + 0.1 * (v.v + 1))), float(np.log10(v.tail_n + 0.1 * (v.tail_v + 1)))
    of = {k: F.coalesce(F.sum(k), F.lit(0)) if k != "doc_id" else F.max(k) for k in fields}
    out = network.unionByName(plain).unionByName(tail).groupBy("uid").agg(*(of[k].alias(k) for k in fields))
    return out.select(
        "doc_id", "n_tokens", F.col("known").alias("n_known"), F.lit(v.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("logs") - F.col("tails") * F.lit(whole)).alias("base_score"), (F.col("score") + F.col("logs") - F.col("tails") * F.lit(rest)).alias("score"),
    )
