"""Hidden Markov language model, trained by Baum-Welch, scored by the forward recursion.

Words emit through classes: the ``top_words`` most frequent training words are classes of their own,
all other words fall into ``tail_classes`` classes by a hash of their last three bytes, and the text
end is one more class.  P(word | state) = P(class | state) * P(word | class), where the second factor
is (c + 0.5) / (N_class + 0.5 (V_class + 1)) with exact counts of every training word; so the
emission tables stay bounded while the vocabulary grows with the corpus.

Training: each task runs forward-backward over its documents and returns expected counts; Spark sums
them and the driver renormalises tables of fixed size (states x classes).  All ``rounds`` rounds read
all training documents, written once as class numbers.  In training a document is cut into stretches
of ``stretch`` words; a later stretch starts from its own learned start distribution.

Scoring is exact for a whole text of any length: all texts of a batch carry their state vector along
together over their first ``head`` words; later pieces of longer texts become scaled state-transfer
matrices, which are then applied in order.

Word counts of rare words never travel to the driver or a broadcast: tail words of each document are
joined with the count table and summed per document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_fold, kth_largest, materialize, text_bytes


@dataclass(frozen=True)
class Params:
    start: np.ndarray     # (K,) first word of a text
    cont: np.ndarray      # (K,) first word of a later stretch (training only)
    move: np.ndarray      # (K, K)
    emit: np.ndarray      # (K, C)


class Vocabulary:
    """Class of each word: own class for top words, else by the last three bytes."""

    def __init__(self, hot: list[tuple[bytes, int]], top_words: int, tail_classes: int):
        self.tail_classes = tail_classes
        self.first_tail = min(top_words, len(hot))
        self.end = self.first_tail + tail_classes
        self.classes = self.end + 1
        self.place = {w: i for i, (w, _) in enumerate(hot)}
        self.by_place = np.array([i if i < self.first_tail else self.tail(w) for i, (w, _) in enumerate(hot)] + [0], np.int32)

    def tail(self, word: bytes) -> int:
        return self.first_tail + zlib.crc32(word[-3:]) % self.tail_classes

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Classes (with the end), places among the hot words (-1: not one of them), and the words that are not."""
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int32, len(words))
        out = np.empty(len(words) + 1, np.int32)
        out[:-1] = self.by_place[at]
        out[-1] = self.end
        miss = np.flatnonzero(at < 0)
        others = [words[i] for i in miss.tolist()]
        crc, first, n = zlib.crc32, self.first_tail, self.tail_classes
        out[miss] = [first + crc(w[-3:]) % n for w in others]
        return out, at, others

    def sequence(self, words: list[bytes]) -> np.ndarray:
        return self.look_up(words)[0]

    @property
    def kind(self) -> type:
        """Smallest type that holds every class, for written sequences."""
        return np.uint16 if self.classes <= 1 << 16 else np.int32


# --------------------------------------------------------------------------- counts

def count_words(train: DataFrame) -> DataFrame:
    """(word, c) over all training texts; each task adds up in memory and flushes at a bound."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()),
                                              pa.array(list(counts.values()), pa.int64())], ["word", "c"])
            counts.clear()
            return out

        for b in batches:
            for text in b.column(0).to_pylist():
                counts.update(text.lower().split())
                if len(counts) > 250_000:
                    yield flush()
        yield flush()

    return train.select("_text").mapInArrow(work, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _tail_totals(counts: DataFrame, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each tail class."""
    own = {w for w, i in vocab.place.items() if i < vocab.first_tail}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(vocab.tail_classes, np.int64), np.zeros(vocab.tail_classes, np.int64)
        for b in batches:
            words = b.column(0).to_pylist()
            keep = np.array([w not in own for w in words], bool)
            k = np.array([zlib.crc32(w[-3:]) % vocab.tail_classes for w in words], np.int64)[keep]
            c = b.column(1).to_numpy()[keep]
            n += np.bincount(k, weights=c, minlength=vocab.tail_classes).astype(np.int64)
            v += np.bincount(k, minlength=vocab.tail_classes)
        used = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(v[used])], ["k", "n", "v"])

    rows = counts.mapInArrow(work, "k bigint, n bigint, v bigint").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n, v = np.zeros(vocab.tail_classes), np.zeros(vocab.tail_classes)
    for r in rows:
        n[r["k"]], v[r["k"]] = r["n"], r["v"]
    return n, v


# --------------------------------------------------------------------------- Baum-Welch

def expected_counts(seqs: list[np.ndarray], fresh: np.ndarray, p: Params, every: int = 4) -> tuple:
    """Expected start, continued-start, move and emission counts and the log-likelihood of stretches.

    ``seqs`` are sorted by falling length; at step t only the first ``alive[t]`` of them go on.
    Vectors are rescaled at each ``every``-th step and where a stretch ends; the scales cancel.
    """
    states, classes = p.emit.shape
    lens = np.array([len(s) for s in seqs])
    steps, n = int(lens[0]), len(seqs)
    alive = np.searchsorted(-lens, -np.arange(steps + 1), side="left")
    rows = np.zeros((n, steps), np.int32)
    for i, s in enumerate(seqs):
        rows[i, :lens[i]] = s
    grid = np.ascontiguousarray(rows.T)
    seen = np.ascontiguousarray(p.emit.T)[grid]
    back_move, ones = np.ascontiguousarray(p.move.T), np.ones(states)
    alpha = np.empty((steps, n, states))
    shrink: dict[int, np.ndarray] = {}
    loglik = 0.0
    np.multiply(np.where(fresh[:, None], p.start, p.cont), seen[0], out=alpha[0])
    for t in range(steps):
        cur = alpha[t, :alive[t]]
        if t:
            np.matmul(alpha[t - 1, :alive[t]], p.move, out=cur)
            cur *= seen[t, :alive[t]]
        if t % every == every - 1 or alive[t + 1] < alive[t]:
            size = cur @ ones
            shrink[t] = (1.0 / size)[:, None]
            cur *= shrink[t]
            loglik += float(np.log(size).sum())
    xi = np.zeros((states, states))
    beta = np.ones((n, states))
    gamma = alpha  # turned into posteriors from the back
    for t in range(steps - 1, 0, -1):
        a = alive[t]
        back = seen[t, :a]
        back *= beta[:a]
        if t in shrink:
            back *= shrink[t]
        xi += alpha[t - 1, :a].T @ back
        gamma[t, :a] *= beta[:a]
        np.matmul(back, back_move, out=beta[:a])
    gamma[0] *= beta
    mask = np.arange(steps)[:, None] < lens[None, :]
    flat = grid[mask]
    g = gamma[mask]
    out = np.stack([np.bincount(flat, weights=g[:, k], minlength=classes) for k in range(states)])
    return gamma[0][fresh].sum(axis=0), gamma[0][~fresh].sum(axis=0), p.move * xi, out, loglik


def _pack(start, cont, xi, emit, loglik) -> np.ndarray:
    return np.concatenate([start, cont, xi.ravel(), [loglik], emit.ravel()])


def _unpack(v: np.ndarray, states: int) -> tuple:
    k = states
    return v[:k], v[k:2 * k], v[2 * k:2 * k + k * k].reshape(k, k), v[2 * k + k * k], v[2 * k + k * k + 1:].reshape(k, -1)


def class_sequences(train: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``_seq`` (class numbers, as bytes) of each training text, written once for all rounds."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = [vocab.sequence(text.lower().split()).astype(vocab.kind).tobytes() for text in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.binary())], ["_seq"])

    return materialize(train.select("_text").mapInArrow(work, "_seq binary"), "lm-seqs")


def baum_welch_round(train: DataFrame, vocab: Vocabulary, p: Params, stretch: int, batch_words: int) -> tuple[Params, float]:
    """One round: expected counts per task, summed by Spark, renormalised here.  Without text ``p`` stays."""
    states = p.emit.shape[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, fresh, words = None, [], [], 0

        def run(total):
            order = sorted(range(len(held)), key=lambda i: -len(held[i]))
            got = _pack(*expected_counts([held[i] for i in order], np.array([fresh[i] for i in order], bool), p))
            return got if total is None else total + got

        for b in batches:
            for seq in b.column(0).to_pylist():
                s = np.frombuffer(seq, vocab.kind)
                for at in range(0, len(s), stretch):
                    held.append(s[at:at + stretch])
                    fresh.append(at == 0)
                    words += len(held[-1])
                    if words >= batch_words:
                        total = run(total)
                        held, fresh, words = [], [], 0
        if held:
            total = run(total)
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["i", "v"])

    rows = (train.select("_seq").mapInArrow(work, "i bigint, v double").groupBy("i")
            .agg(F.sum("v").alias("v")).toPandas())
    if rows.empty:
        return p, 0.0
    vec = np.zeros(2 * states + states * states + 1 + states * vocab.classes)
    vec[rows["i"]] = rows["v"]
    start, cont, xi, loglik, emit = _unpack(vec, states)
    norm = lambda x, floor: (x + floor) / (x + floor).sum(axis=-1, keepdims=True)
    shared = norm(emit.sum(axis=0), 0.5)  # every class keeps some mass in every state
    emit = (emit + 50.0 * shared) / (emit.sum(axis=1, keepdims=True) + 50.0)
    return Params(norm(start, 0.1), norm(cont, 0.1), norm(xi, 0.1), emit), loglik


def initial_params(vocab: Vocabulary, states: int, unigram: np.ndarray, seed: int = 5) -> Params:
    rng = np.random.default_rng(seed)
    emit = unigram * np.exp(0.5 * rng.standard_normal((states, vocab.classes)))
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    flat = np.full(states, 1.0 / states)
    return Params(flat, flat.copy(), move, emit / emit.sum(axis=1, keepdims=True))


# --------------------------------------------------------------------------- forward scoring

def _grid(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of falling length side by side, and how many go on at each step."""
    lens = np.array([len(x) for x in pieces])
    rows = np.zeros((len(pieces), int(lens[0])), np.int32)
    for i, x in enumerate(pieces):
        rows[i, :len(x)] = x
    return np.ascontiguousarray(rows.T), np.searchsorted(-lens, -np.arange(lens[0] + 1), side="left")


def _carry(pieces: list[np.ndarray], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """State vector after each first piece, with its scale's logarithm."""
    order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
    grid, alive = _grid([pieces[i] for i in order])
    emit, ones = np.ascontiguousarray(p.emit.T), np.ones(p.emit.shape[0])
    vec = p.start * emit[grid[0]]
    logs = np.zeros(len(pieces))
    for t in range(len(grid)):
        cur = vec[:alive[t]]
        if t:
            cur[:] = (cur @ p.move) * emit[grid[t, :alive[t]]]
        if t % 8 == 7 or alive[t + 1] < alive[t]:
            size = cur @ ones
            cur /= size[:, None]
            logs[:alive[t]] += np.log(size)
    back = np.argsort(order)
    return vec[back], logs[back]


def _transfer(pieces: list[np.ndarray], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Scaled state-transfer matrix of each later piece, with its scale's logarithm."""
    states = p.emit.shape[0]
    order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
    grid, alive = _grid([pieces[i] for i in order])
    emit = np.ascontiguousarray(p.emit.T)
    prod = p.move * emit[grid[0]][:, None, :]
    logs = np.zeros(len(pieces))
    for t in range(len(grid)):
        a = alive[t]
        if t:
            prod[:a] = (prod[:a].reshape(-1, states) @ p.move).reshape(a, states, states) * emit[grid[t, :a]][:, None, :]
        if t % 8 == 7 or alive[t + 1] < a:
            size = prod[:a].sum(axis=(1, 2))
            prod[:a] /= size[:, None, None]
            logs[:a] += np.log(size)
    back = np.argsort(order)
    return prod[back], logs[back]


def log_likelihoods(seqs: list[np.ndarray], p: Params, stretch: int, head: int | None = None) -> np.ndarray:
    """Exact natural-log likelihood of each whole sequence.

    The first ``head`` words (default ``stretch``) are a vector recursion; the pieces of ``stretch``
    words after them are matrices, so that one very long text does not go on alone, word by word.
    """
    head = head or stretch
    vec, out = _carry([s[:head] for s in seqs], p)
    later = [(i, at) for i, s in enumerate(seqs) for at in range(head, len(s), stretch)]
    if later:
        prod, logs = _transfer([seqs[i][at:at + stretch] for i, at in later], p)
        for j, (i, _) in enumerate(later):
            nxt = vec[i] @ prod[j]
            size = nxt.sum()
            vec[i] = nxt / size
            out[i] += np.log(size) + logs[j]
    return out


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 1, folds: int = 5,
                states: int = 5, top_words: int = 8192, hot_words: int = 65_536, tail_classes: int = 1024,
                rounds: int = 10, stretch: int = 256, head: int = 512, batch_words: int = 100_000,
                score_words: int = 200_000) -> DataFrame:
    """One row per input row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Learns from rows whose id is not in fold ``fold`` (a NULL id is in none).  NULL and empty texts are
    one token, the text end.  Without training rows all counts are 0 and the model is uniform.
    Repeated rows count, and are scored, each; other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("_id"), text_bytes(F.col(text_col)).alias("_text"),
                      F.coalesce(id_fold(F.col(id_col), folds) == fold, F.lit(False)).alias("_out"))
    train = src.where(~F.col("_out"))
    counts = materialize(count_words(train), "lm-counts")
    tot = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = train.count()
    n_all = (tot["n"] or 0) + ends
    v_all = tot["v"] + (ends > 0)
    # words over the hot_words-th count: fewer than hot_words, so they may travel
    cut = kth_largest(counts, "c", hot_words + 1) if tot["v"] > hot_words else 0
    hot = sorted(((bytes(r["word"]), r["c"]) for r in counts.where(F.col("c") > F.lit(cut)).collect()), key=lambda x: (-x[1], x[0]))
    vocab = Vocabulary(hot, top_words, tail_classes)
    tail_n, tail_v = _tail_totals(counts, vocab)
    denominator = tail_n + 0.5 * (tail_v + 1)

    unigram = np.concatenate([[c for _, c in hot[:vocab.first_tail]], tail_n, [ends]]).astype(float) + 0.5
    p = initial_params(vocab, states, unigram / unigram.sum())
    if ends:
        seqs = class_sequences(train, vocab)
        for _ in range(rounds):
            p, _loglik = baum_welch_round(seqs, vocab, p, stretch, batch_words)

    log_end = np.log10(ends + 0.5)
    log_den = np.log10(denominator)
    base_den = float(np.log10(n_all + 0.5 * (v_all + 1)))
    log_count = np.array([float(np.log10(c + 0.5)) for _, c in hot] + [0.0])  # by place, the last for other words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids, outs, seqs, sums):
            ll = log_likelihoods(seqs, p, stretch, head) / np.log(10)
            tails = [s >= vocab.first_tail for s in seqs]
            adjust = np.array([-log_den[s[t][:-1] - vocab.first_tail].sum() for s, t in zip(seqs, tails)])
            return pa.RecordBatch.from_arrays([
                pa.array(ids), pa.array(outs, pa.bool_()), pa.array([len(s) for s in seqs], pa.int64()),
                pa.array([x[0] for x in sums], pa.int64()), pa.array([x[1] for x in sums], pa.float64()),
                pa.array(ll + adjust + np.array([x[2] for x in sums])),
                pa.array([list(x[3].keys()) for x in sums], pa.list_(pa.binary())),
                pa.array([list(x[3].values()) for x in sums], pa.list_(pa.int64()))],
                ["id", "held_out", "n_tokens", "known", "base", "score", "words", "times"])

        for b in batches:
            ids, outs, seqs, sums, words = [], [], [], [], 0
            for doc_id, out, text in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                ws = text.lower().split()
                s, at, others = vocab.look_up(ws)
                got = log_count[at]
                # the text end is a class of its own and is always counted from the training rows
                sums.append((len(ws) - len(others) + (ends > 0), float(got.sum()) + log_end,
                             float(got[at >= vocab.first_tail].sum()), Counter(others)))
                ids.append(doc_id), outs.append(out), seqs.append(s)
                words += len(s)
                if words >= score_words:
                    yield flush(pa.array(ids, b.schema.field(0).type), outs, seqs, sums)
                    ids, outs, seqs, sums, words = [], [], [], [], 0
            if seqs:
                yield flush(pa.array(ids, b.schema.field(0).type), outs, seqs, sums)

    id_type = src.schema["_id"].dataType.simpleString()
    rows = src.select("_id", "_out", "_text").mapInArrow(
        work, f"id {id_type}, held_out boolean, n_tokens bigint, known bigint, base double, score double, "
              "words array<binary>, times array<bigint>")
    rows = materialize(rows.withColumn("_rid", F.monotonically_increasing_id()), "lm-rows")
    rare = (rows.select("_rid", F.explode(F.arrays_zip("words", "times")).alias("x"))
            .select("_rid", F.col("x.words").alias("word"), F.col("x.times").alias("t")))
    c = F.coalesce("c", F.lit(0))
    rare = (rare.join(counts, "word", "left").groupBy("_rid")
            .agg(F.sum(F.col("t") * F.log10(c + 0.5)).alias("_log"), F.sum(F.when(c > 0, F.col("t"))).alias("_known")))
    log_rare = F.coalesce("_log", F.lit(0.0))
    return rows.drop("words", "times").join(rare, "_rid", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + log_rare - F.col("n_tokens") * F.lit(base_den)).alias("base_score"),
        (F.col("score") + log_rare).alias("score"))
