"""Gated recurrent language model over words, scored over whole documents.

Words are counted over all training documents.  The most frequent ones are the
model's own words, dealt to classes of equal size by rank; all others belong to
tail classes by their first letters, inside which a word's probability comes
from its count.  The network (one gated recurrent layer, class-factored output
softmax) is trained in numpy by truncated backpropagation: each partition trains
a copy from the same start on its share, and the copies are averaged by tokens.
Scoring carries the state across windows from a document's first token to its
end, so a score is the log-likelihood of the complete text.

Counts of words beyond the ``KNOWN`` most frequent never go to every task: the
scoring pass emits such words, and they are joined with the table of counts.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm.common import fold_of, materialize
from churnscope.session import fresh_path

HIDDEN = 16
CLASS_WORDS = 64
CLASSES = 64                   # the model's own words: CLASSES * CLASS_WORDS
TAIL_CLASSES = 32
KNOWN = 262_144                # words whose counts every task has (bounded: about 20 MB)
TRAIN_LANES, TRAIN_WINDOW = 64, 16
SCORE_LANES, SCORE_WINDOW = 256, 32
BUFFER_TOKENS = 2_000_000      # a task scores or trains on so many tokens at a time
COUNTED_WORDS = 500_000        # a task's word counts are handed on when they reach so many words
RATE, CLIP, PASSAGE = 1.0, 5.0, 512
COPY_TOKENS = 2_000_000        # training tokens a copy of the network, on average
LIMIT = 4.0                    # of every weight: HIDDEN of them cannot overflow an exponent
END = b""                      # the end of a text; no word is empty
# Token numbers of the network: own words by rank, then the tail classes.
_OWN = CLASSES * CLASS_WORDS
_ALL_CLASSES = CLASSES + TAIL_CLASSES


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[:3]) % TAIL_CLASSES


def _words(raw: bytes) -> list[bytes]:
    return raw.lower().split()


@dataclass(frozen=True)
class Vocabulary:
    """``known``: word -> (token number, count); totals of training and of each tail class."""

    known: dict[bytes, tuple[int, int]]
    own_counts: np.ndarray
    tail_tokens: np.ndarray
    tail_words: np.ndarray
    tokens: int
    words: int

    @property
    def base_log(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.words + 1)))

    @property
    def tail_log(self) -> np.ndarray:
        """log10 of each tail class's denominator: half a count for each of its words and for all unseen ones."""
        return np.log10(self.tail_tokens + 0.5 * (self.tail_words + 1))


def training_fold() -> F.col:
    return fold_of("doc_id", 5) != 1


def count_words(texts: DataFrame) -> DataFrame:
    """``word binary, c long`` over all rows of ``texts`` (``raw`` binary), ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                              names=["word", "c"])
            seen.clear()
            return made

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                seen.update(_words(raw))
                seen[END] += 1
                if len(seen) > COUNTED_WORDS:
                    yield flush()
        if seen:
            yield flush()

    return texts.select("raw").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, known: int = KNOWN) -> Vocabulary:
    """What every task gets of the table of counts: the most frequent words, at most ``known``, and totals."""
    step = F.floor(F.log2("c") * 8)
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(step).count().collect()), reverse=True)  # a few hundred rows
    least, n = None, 0
    for size, words in sizes:
        n += words
        if n > known:
            break
        least = size
    top = counts.filter(step >= least if least is not None else F.lit(False)).toArrow()
    top = sorted(zip(top.column("c").to_pylist(), top.column("word").to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
    in_tail = F.pmod(F.crc32(F.substring("word", 1, 3)), F.lit(TAIL_CLASSES)).alias("tail")
    totals = counts.groupBy(in_tail).agg(F.sum("c"), F.count("*")).collect()  # TAIL_CLASSES rows
    tail_tokens, tail_words = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for tail, c, n in totals:
        tail_tokens[tail], tail_words[tail] = c, n
    tokens, words = int(tail_tokens.sum()), int(tail_words.sum())
    listed = {}
    own = np.zeros(_OWN)
    for number, (c, word) in enumerate(top):
        tail = tail_class(word)
        if number < len(own):
            own[number] = c
            tail_tokens[tail] -= c
            tail_words[tail] -= 1
            listed[word] = (number, c)
        else:
            listed[word] = (_OWN + tail, c)
    return Vocabulary(listed, own, tail_tokens, tail_words, tokens, words)


# --- the network -------------------------------------------------------------------------------------------------

class Network:
    """Parameters by name."""

    SHAPES = {"inputs": (_OWN + TAIL_CLASSES, 3 * HIDDEN), "recurrent": (HIDDEN, 3 * HIDDEN),
              "classes": (HIDDEN, _ALL_CLASSES), "class_bias": (_ALL_CLASSES,),
              "words": (CLASSES, HIDDEN, CLASS_WORDS), "word_bias": (CLASSES, CLASS_WORDS)}

    def __init__(self, parameters: dict[str, np.ndarray]) -> None:
        self.p = parameters

    @classmethod
    def start(cls, own_counts: np.ndarray, tail_tokens: np.ndarray, seed: int = 3) -> Network:
        """Small random weights; biases that give the unigram model."""
        random = np.random.default_rng(seed)
        p = {name: (random.standard_normal(shape) * 0.1).astype(np.float32) for name, shape in cls.SHAPES.items()}
        by_class = own_counts.reshape(CLASSES, CLASS_WORDS)
        p["class_bias"] = np.log(np.append(by_class.sum(axis=1), tail_tokens) + 0.5).astype(np.float32)
        p["class_bias"] -= p["class_bias"].max()
        p["word_bias"] = np.where(by_class > 0, np.log(np.maximum(by_class, 1)), -30).astype(np.float32)
        p["word_bias"] -= p["word_bias"].max(axis=1, keepdims=True)
        return cls(p)

    def flat(self) -> bytes:
        return b"".join(self.p[name].astype("<f4").tobytes() for name in self.SHAPES)

    @classmethod
    def unflat(cls, values: np.ndarray) -> Network:
        p, at = {}, 0
        for name, shape in cls.SHAPES.items():
            size = int(np.prod(shape))
            p[name] = np.array(values[at:at + size], np.float32).reshape(shape)
            at += size
        return cls(p)

    def run(self, h: np.ndarray, tokens: np.ndarray, fresh: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States after each step (steps, lanes, HIDDEN); steps marked ``fresh`` (steps, lanes) end in the empty state."""
        inputs, recurrent, n = self.p["inputs"], self.p["recurrent"], HIDDEN
        out = np.empty((len(tokens), *h.shape), np.float32)
        fed, kept = inputs[tokens], _kept(fresh)
        for t in range(len(tokens)):
            x, u = fed[t], h @ recurrent
            gates = x[:, :2 * n] + u[:, :2 * n]
            np.maximum(gates, -30, out=gates)
            np.minimum(gates, 30, out=gates)
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.divide(1, gates, out=gates)
            z, r = gates[:, :n], gates[:, n:]
            candidate = r * u[:, 2 * n:]
            candidate += x[:, 2 * n:]
            np.tanh(candidate, out=candidate)
            new = h - candidate
            new *= z
            new += candidate
            new *= kept[t]
            if trace is not None:
                trace.append((h, u[:, 2 * n:], z, r, candidate))
            out[t] = h = new
        return out

    def log_probabilities(self, states: np.ndarray, targets: np.ndarray, gradients: dict | None = None) -> np.ndarray:
        """Natural log probability of each target's class, and of the word in it for own words.

        With ``gradients``, the loss's gradients of the output layer are put there, under ``states`` that of the states.
        Weights are kept within ``LIMIT``, so no exponent overflows.
        """
        p, n = self.p, len(targets)
        own = targets < _OWN
        classes = np.where(own, targets // CLASS_WORDS, targets - _OWN + CLASSES)
        out = np.einsum("ij,ij->i", states, p["classes"].T[classes]).astype(np.float64) + p["class_bias"][classes]
        back = np.empty_like(states) if gradients is not None else None
        if gradients is not None:
            gradients["classes"], gradients["class_bias"] = np.zeros_like(p["classes"]), np.zeros_like(p["class_bias"])
            gradients["words"], gradients["word_bias"] = np.zeros_like(p["words"]), np.zeros_like(p["word_bias"])
        ones = np.ones(_ALL_CLASSES, states.dtype)
        for at in range(0, n, 2048):  # as much as stays in a core's cache
            some = slice(at, at + 2048)
            weights = states[some] @ p["classes"]
            weights += p["class_bias"]
            np.exp(weights, out=weights)
            total = weights @ ones
            out[some] -= np.log(total)
            if gradients is not None:
                weights /= total[:, None]
                weights[np.arange(len(total)), classes[some]] -= 1
                gradients["classes"] += states[some].T @ weights
                gradients["class_bias"] += weights.sum(axis=0)
                back[some] = weights @ p["classes"].T
        at = np.flatnonzero(own)
        at = at[np.argsort(classes[at].astype(np.uint8), kind="stable")]
        bounds = np.searchsorted(classes[at], np.arange(CLASSES + 1)).tolist()
        inside, place, own_classes = states[at], targets[at] % CLASS_WORDS, classes[at]
        ones, found = np.ones(CLASS_WORDS, states.dtype), np.empty(len(at))
        used = [c for c in range(CLASSES) if bounds[c] < bounds[c + 1]]
        # a class's products are its own; what is done number by number is done for runs of classes at once
        for run in _runs(used, bounds, 2048):
            low, high = bounds[run[0]], bounds[run[-1] + 1]
            weights, total = np.empty((high - low, CLASS_WORDS), states.dtype), np.empty(high - low, states.dtype)
            parts = [(c, slice(bounds[c] - low, bounds[c + 1] - low), inside[bounds[c]:bounds[c + 1]]) for c in run]
            for c, part, held in parts:
                np.matmul(held, p["words"][c], out=weights[part])
            weights += p["word_bias"][own_classes[low:high]]
            target = np.arange(high - low), place[low:high]
            logits = weights[target]
            np.exp(weights, out=weights)
            for _, part, _ in parts:
                np.matmul(weights[part], ones, out=total[part])
            found[low:high] = logits - np.log(total)
            if gradients is not None:
                weights /= total[:, None]
                weights[target] -= 1
                passed = np.empty((high - low, HIDDEN), states.dtype)
                for c, part, held in parts:
                    np.matmul(held.T, weights[part], out=gradients["words"][c])
                    np.add.reduce(weights[part], axis=0, out=gradients["word_bias"][c])
                    np.matmul(weights[part], p["words"][c].T, out=passed[part])
                back[at[low:high]] += passed
        out[at] += found
        if gradients is not None:
            gradients["states"] = back
        return out

    def backward(self, trace: list, tokens: np.ndarray, fresh: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the recurrent matrix and of each step's input rows (steps * lanes, 3 * HIDDEN)."""
        recurrent, n = self.p["recurrent"], HIDDEN
        d_recurrent, d_inputs = np.zeros_like(recurrent), np.empty((*tokens.shape, 3 * n), np.float32)
        d_next, kept = np.zeros_like(back[0]), _kept(fresh)
        before, u, z, r, candidate = (np.stack(part) for part in zip(*trace, strict=True))
        moved, not_z, not_r, slope = before - candidate, 1 - z, 1 - r, 1 - candidate * candidate
        d_u = np.empty((tokens.shape[1], 3 * n), back.dtype)
        d_z, d_r = d_u[:, :n], d_u[:, n:2 * n]
        for t in range(len(tokens) - 1, -1, -1):
            d = back[t] + d_next
            d *= kept[t]
            d_candidate = d * not_z[t]
            d_candidate *= slope[t]
            np.multiply(d, moved[t], out=d_z)
            np.multiply(d_z, z[t], out=d_z)
            np.multiply(d_z, not_z[t], out=d_z)
            np.multiply(d_candidate, u[t], out=d_r)
            np.multiply(d_r, r[t], out=d_r)
            np.multiply(d_r, not_r[t], out=d_r)
            d_inputs[t, :, :2 * n], d_inputs[t, :, 2 * n:] = d_u[:, :2 * n], d_candidate
            np.multiply(d_candidate, r[t], out=d_u[:, 2 * n:])
            d_recurrent += before[t].T @ d_u
            d_next = d * z[t]
            d_next += d_u @ recurrent.T
        return d_recurrent, d_inputs.reshape(-1, 3 * n)


def _kept(fresh: np.ndarray) -> np.ndarray:
    """1 where a state goes on, 0 where it is emptied, to multiply states with."""
    return (~fresh).astype(np.float32)[..., None]


def _runs(classes: list[int], bounds: list[int], rows: int) -> Iterator[list[int]]:
    """Neighbouring classes of together at most ``rows`` rows, or one larger class."""
    run: list[int] = []
    for c in classes:
        if run and bounds[c + 1] - bounds[run[0]] > rows:
            yield run
            run = []
        run.append(c)
    if run:
        yield run


def _lanes(documents: list[np.ndarray], lanes: int, in_order: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents dealt to lanes of near equal length: targets, previous tokens and document numbers (steps, lanes).

    A document's first step has previous token -1; document -1 fills up.  The
    longest are dealt first, or they are dealt as they come.
    """
    load = [(0, lane) for lane in range(lanes)]
    dealt: list[list[int]] = [[] for _ in range(lanes)]
    for n in range(len(documents)) if in_order else sorted(range(len(documents)), key=lambda n: -len(documents[n])):
        length, lane = heapq.heappop(load)
        dealt[lane].append(n)
        heapq.heappush(load, (length + len(documents[n]), lane))
    steps = max(length for length, _ in load)
    targets, previous = np.zeros((steps, lanes), np.int32), np.full((steps, lanes), -1, np.int32)
    number = np.full((steps, lanes), -1, np.int32)
    for lane, own in enumerate(dealt):
        at = 0
        for n in own:
            tokens = documents[n]
            targets[at:at + len(tokens), lane] = tokens
            previous[at + 1:at + len(tokens), lane] = tokens[:-1]
            number[at:at + len(tokens), lane] = n
            at += len(tokens)
    return targets, previous, number


def score_documents(network: Network, documents: list[np.ndarray]) -> np.ndarray:
    """log10 probability of the classes, and of own words in them, summed over each document's tokens."""
    lanes = max(1, min(SCORE_LANES, sum(map(len, documents)) // 512, len(documents)))
    targets, previous, number = _lanes(documents, lanes)
    totals, h = np.zeros(len(documents)), np.zeros((lanes, HIDDEN), np.float32)
    for at in range(0, len(targets), SCORE_WINDOW):
        before, window = previous[at:at + SCORE_WINDOW], number[at:at + SCORE_WINDOW]
        # step t feeds the token before the target; a document's first target is predicted from the empty state
        states = network.run(h, np.maximum(before, 0), before < 0)
        h = states[-1]
        live = window >= 0
        logs = network.log_probabilities(states[live], targets[at:at + SCORE_WINDOW][live])
        totals += np.bincount(window[live], weights=logs, minlength=len(documents))
    return totals / np.log(10)


def train(network: Network, documents: list[np.ndarray], rate: float = RATE) -> None:
    """One pass of truncated backpropagation, in place.

    Documents are cut into passages of ``PASSAGE`` tokens, in a fixed random
    order, so that no long document is learned alone at the end.  The loss is
    summed over a window's steps and averaged over the lanes, so lanes that
    have ended weigh nothing; its gradient is scaled to ``CLIP``.
    """
    passages = [d[at:at + PASSAGE] for d in documents for at in range(0, len(d), PASSAGE)]
    passages = [passages[k] for k in np.random.default_rng(len(passages)).permutation(len(passages))]
    lanes = max(1, min(TRAIN_LANES, len(passages)))
    targets, previous, number = _lanes(passages, lanes, in_order=True)
    h, p = np.zeros((lanes, HIDDEN), np.float32), network.p
    for at in range(0, len(targets), TRAIN_WINDOW):
        before, live = previous[at:at + TRAIN_WINDOW], number[at:at + TRAIN_WINDOW] >= 0
        trace: list = []
        first = before < 0
        states = network.run(h, np.maximum(before, 0), first, trace)
        h = states[-1]
        gradients: dict = {}
        network.log_probabilities(states[live], targets[at:at + TRAIN_WINDOW][live], gradients)
        back = np.zeros_like(states)
        back[live] = gradients["states"]
        d_recurrent, d_inputs = network.backward(trace, before, first, back)
        steps = [("recurrent", ..., d_recurrent), *((name, ..., gradients[name]) for name in ("classes", "class_bias", "words", "word_bias"))]
        fed = np.flatnonzero(~first.reshape(-1) & live.reshape(-1))
        if len(fed):
            tokens = before.reshape(-1)[fed].astype(np.uint16)
            order = np.argsort(tokens, kind="stable")
            tokens = tokens[order]
            starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
            steps.append(("inputs", tokens[starts], np.add.reduceat(d_inputs[fed[order]], starts, axis=0)))
        squares = 0.0
        for name, _, gradient in steps:
            for part in gradient if name in ("words", "word_bias") else (gradient,):
                squares += float(np.vdot(part, part))
        norm = np.sqrt(squares) / lanes
        scale = np.float32(rate / lanes * min(1.0, CLIP / max(norm, 1e-9)))
        for name, place, gradient in steps:
            p[name][place] -= scale * gradient
    for name in ("inputs", "recurrent", "classes", "words"):
        np.clip(p[name], -LIMIT, LIMIT, out=p[name])


def train_network(texts: DataFrame, words: Vocabulary) -> Network:
    """The average of copies trained once over their share of ``texts`` (``doc_id, raw``), weighed by tokens.

    The number of copies follows the training tokens, and a document's copy and
    place there the hash of its id and text, so the same rows train the same
    network however the table is split into files and partitions.
    """
    start = Network.start(words.own_counts, words.tail_tokens)
    numbers = {word: number for word, (number, _) in words.known.items()}
    begin = start.flat()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network.unflat(np.frombuffer(begin, "<f4"))
        documents: list[np.ndarray] = []
        seen = waiting = 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                split = [*_words(raw), END]
                tokens = np.fromiter(map(numbers.get, split, repeat(-1)), np.int32, len(split))
                for place in np.flatnonzero(tokens < 0).tolist():
                    tokens[place] = _OWN + tail_class(split[place])
                documents.append(tokens)
                seen, waiting = seen + len(tokens), waiting + len(tokens)
                if waiting > BUFFER_TOKENS:
                    train(network, documents)
                    documents, waiting = [], 0
        if documents:
            train(network, documents)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(seen)]), pa.array([network.flat()], pa.binary())],
                names=["copy", "tokens", "flat"])

    def averaged(rows: pa.Table) -> pa.Table:
        listed = sorted(zip(rows.column("copy").to_pylist(), rows.column("tokens").to_pylist(), rows.column("flat").to_pylist(), strict=True))
        total = sum(r[1] for r in listed)
        mean = sum(np.frombuffer(r[2], "<f4").astype(np.float64) * (r[1] / total) for r in listed)
        return pa.table({"copy": pa.array([listed[0][0] // 16], pa.int64()), "tokens": pa.array([total], pa.float64()),
                         "flat": pa.array([mean.astype("<f4").tobytes()], pa.binary())})

    schema = "copy long, tokens double, flat binary"
    n_copies = max(1, -(-words.tokens // COPY_TOKENS))
    dealt = (texts.select("raw", F.xxhash64("doc_id", "raw").alias("deal")).repartition(n_copies, "deal")
             .sortWithinPartitions("deal", "raw"))
    copies = materialize(dealt.select("raw").mapInArrow(run, schema))
    while copies.count() > 1:  # groups of at most 16 copies, level by level
        copies = materialize(copies.groupBy(F.floor(F.col("copy") / 16)).applyInArrow(averaged, schema))
    made = copies.first()
    return Network.unflat(np.frombuffer(made["flat"], "<f4")) if made else start


def score_texts(docs: DataFrame, known: int = KNOWN) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    Null text is empty (its end alone).  Rows with a null id are in the fold of
    the empty text's remainder.  Without training tokens every base score is 0.
    Repeated rows each get their own row.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~training_fold()).alias("held_out"),
                        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    learned = texts.filter(~F.col("held_out"))
    counts = materialize(count_words(learned))
    words = vocabulary(counts, known)
    network = train_network(learned, words)
    flat = network.flat()
    place_of = {w: k for k, w in enumerate(words.known)}
    number_of = np.array([n for n, _ in words.known.values()], np.int32)
    log_of = np.log10(np.array([c for _, c in words.known.values()], np.float64) + 0.5)
    base_log, tail_log, tokens = words.base_log, words.tail_log, words.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network.unflat(np.frombuffer(flat, "<f4"))
        first_row = TaskContext.get().partitionId() << 33
        rows = 0
        pending: list[tuple] = []
        documents: list[np.ndarray] = []
        waiting = 0
        # a row's number: its task and its place there; the result is written before it is used

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows, waiting
            classes = score_documents(model, documents)
            numbered = np.arange(first_row + rows, first_row + rows + len(pending))
            rows += len(pending)
            lengths = np.array([len(d) for d in documents])
            known_tokens, count_log, own_log = (np.array([p[k] for p in pending]) for k in (2, 3, 4))
            tails = np.array([float(tail_log[d[d >= _OWN] - _OWN].sum()) for d in documents])
            table = {"row": pa.array(numbered), "doc_id": pa.array([p[0] for p in pending], pa.int64()),
                     "held_out": pa.array([p[1] for p in pending], pa.bool_()), "word": pa.nulls(len(pending), pa.binary()),
                     "n": pa.array(lengths, pa.int64()), "n_known": pa.array(known_tokens, pa.int64()),
                     "base": pa.array(count_log - base_log * lengths), "score": pa.array(classes + count_log - own_log - tails)}
            yield from pa.table(table).to_batches(max_chunksize=100_000)
            rare = [p[5] for p in pending]
            total = sum(map(len, rare))
            if total:
                nothing = {name: pa.nulls(total, table[name].type) for name in ("doc_id", "held_out", "n_known", "base", "score")}
                words_in_rows = {"row": pa.array(np.repeat(numbered, [len(r) for r in rare])),
                                 "word": pa.array([w for r in rare for w in r], pa.binary()),
                                 "n": pa.array([n for r in rare for n in r.values()], pa.int64())} | nothing
                yield from pa.table({name: words_in_rows[name] for name in table}).to_batches(max_chunksize=100_000)
            pending.clear()
            documents.clear()
            waiting = 0

        for batch in batches:
            for doc_id, held_out, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                split = [*_words(raw), END]
                places = np.fromiter(map(place_of.get, split, repeat(-1)), np.int32, len(split))
                ids = np.empty(len(split), np.int32)
                hit = places >= 0
                ids[hit] = number_of[places[hit]]
                logs = log_of[places[hit]]
                unknown = [split[k] for k in np.flatnonzero(~hit).tolist()]
                ids[~hit] = [_OWN + tail_class(w) for w in unknown]
                pending.append((doc_id, held_out, len(logs), float(logs.sum()), float(logs[ids[hit] < _OWN].sum()), Counter(unknown)))
                documents.append(ids)
                waiting += len(ids)
                if waiting > BUFFER_TOKENS:
                    yield from flush()
        if documents:
            yield from flush()

    path = fresh_path(docs.sparkSession, "lm-score")
    texts.mapInArrow(run, "row long, doc_id long, held_out boolean, word binary, n long, n_known long, base double, score double") \
        .write.parquet(path)
    scored = docs.sparkSession.read.parquet(path)
    rare = scored.filter("word is not null").select("row", "word", "n").join(counts, "word", "left")
    log = F.col("n") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)
    added = rare.groupBy("row").agg(F.sum(log).alias("log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"))
    more = F.coalesce(F.col("log"), F.lit(0.0))
    return (scored.filter("word is null").drop("word").join(added, "row", "left")
            .select("doc_id", "held_out", F.col("n").alias("n_tokens"),
                    (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
                    (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score")))
