"""Language model scoring by a hidden Markov model.

Tokens are lower-cased words and an end token.  The model walks over ``STATES`` latent states; each emits every word of
the training texts with a probability of its own, the end, or a word never seen.

The ``HEAD`` most counted words, if counted ``OFTEN`` times, have a fixed place in an array that is sent to the executors.  All others are emitted
through one of ``SHAPES`` word shapes: a state's probability of the shape times the word's share in the shape under
that state.  The shares come from the word's own expected counts in each state, which are kept for every word in a
distributed table and joined to the texts' words by hash; ``PRIOR`` tokens of the shape's division over states are
added to a word's.  A shape has one place for all words never seen.  So the model is a distribution over all texts.

Texts are coded once, in blocks: symbols, and the block's distinct words outside the head.  Baum-Welch: in each round
every partition runs the scaled forward and backward recursions over segments of its training texts, side by side as
numpy arrays, and hands on expected counts of starts, moves and emissions, which are summed to the next model; words
outside the head have factors drawn by hash, so that they tell states apart from the first, and count for their shape.  Under the last model the recursions run once more for the expected counts of
every word outside the head.  A word's division over states travels as six bytes.  Scoring is exact for whole texts:
the first segment of a text runs forward from the model's start; for later ones all ``STATES`` start vectors run
forward, which gives the segment's transition product, and the products are applied in order.

Expected counts are summed with a fixed point, as integers, so sums don't depend on the order of tasks.

Defined cases: a null or empty text is the end token alone; without training texts all words are unseen; a null id
counts as the empty text when texts are dealt into learned and held out; rows that repeat an id are rows of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.llm import blocksum
from narrascope.llm.rows import bound_batches
from narrascope.llm.textbatch import LOWER, SPACED, U, blocks, mix, span_hashes, word_spans
from narrascope.session import Scratch

STATES = 6
HEAD = 65536
#: Rarer words are left outside the head.
OFTEN = 12
ROUNDS = 3
#: Probability of staying in a state before training.
STAY = 0.99
SEGMENT = 256
SHAPES = 64
END = np.int64(-(1 << 62))
#: Weight of the unigram distribution in every state's emissions.
FLOOR = 0.05
#: Tokens of its shape's division over states that are added to the counts of a word outside the head.
PRIOR = 10.0
#: Binary places of expected counts behind the point.
PLACES = 16
#: Bytes of text in a coded block.
BLOCK = 1 << 21


def _shapes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Word shapes: sixteen lengths by the kind of the last byte (letter, digit, other ASCII, beyond ASCII)."""
    last = low[ends - 1]
    kind = np.where(last >= 128, 3, np.where((last >= 97) & (last <= 122), 0, np.where((last >= 48) & (last <= 57), 1, 2)))
    return kind * 16 + np.minimum(ends - starts, 16) - 1


def _words(col: pa.Array):
    """Yield ``(lo, hi, hashes, shapes, bounds)`` of the words of blocks of texts."""
    for lo, hi, data, bounds in blocks(col, BLOCK):
        low = LOWER[data]
        starts, ends, per = word_spans(low, bounds, SPACED)
        h = mix(span_hashes(low, starts, ends) + U(3)).view(np.int64)
        yield lo, hi, np.where(h == END, END + 1, h), _shapes(low, starts, ends), per


@dataclass
class Vocabulary:
    """Symbols: 0 the end, 1.. the head words in the order of their hash, then the shapes."""

    keys: np.ndarray
    counts: np.ndarray
    end_count: int
    total: int
    distinct: int
    shape_mass: np.ndarray

    @property
    def size(self) -> int:
        return 1 + len(self.keys) + SHAPES

    def symbols(self, h: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, whether the word is in the head)."""
        if not len(self.keys):
            return 1 + shapes, np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        head = self.keys[at] == h
        return np.where(head, 1 + at, 1 + len(self.keys) + shapes), head

    def unigram(self) -> np.ndarray:
        mass = np.concatenate([[self.end_count], self.counts, self.shape_mass]).astype(float) + 0.5
        return mass / mass.sum()


@dataclass
class Hmm:
    start: np.ndarray
    go_on: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol x state

    @classmethod
    def initial(cls, unigram: np.ndarray) -> Hmm:
        """Uneven emissions and states that are rarely left, so that a text's words settle on its state together."""
        rng = np.random.default_rng(5)
        emit = unigram[:, None] * rng.gamma(1.0, 1.0, (len(unigram), STATES))
        move = np.full((STATES, STATES), (1 - STAY) / (STATES - 1))
        np.fill_diagonal(move, STAY)
        return cls(np.full(STATES, 1 / STATES), np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))

    def refit(self, counts: np.ndarray, unigram: np.ndarray) -> Hmm:
        """The model that expected counts (as ``expectations`` lays them out) make."""
        k = STATES
        start, go_on = counts[:k] + 0.1, counts[k : 2 * k] + 0.1
        move = counts[2 * k : 2 * k + k * k].reshape(k, k) + 0.1
        emit = counts[2 * k + k * k :].reshape(-1, k)
        emit = (1 - FLOOR) * (emit + 1e-9) / (emit + 1e-9).sum(axis=0) + FLOOR * unigram[:, None]
        return Hmm(start / start.sum(), go_on / go_on.sum(), move / move.sum(axis=1, keepdims=True), emit)


def packed(n: np.ndarray) -> np.ndarray:
    """Each row's division over states as bytes of one number, the largest part being 255."""
    part = np.rint(n * (255 / np.maximum(n.max(axis=1, keepdims=True), 1e-300))).astype(np.int64)
    return (part << 8 * np.arange(STATES)).sum(axis=1)


def unpacked(q: np.ndarray) -> np.ndarray:
    """Rows of shares that sum to 1, or of zeros."""
    part = (q[:, None] >> 8 * np.arange(STATES) & 255).astype(float)
    return part / np.maximum(part.sum(axis=1, keepdims=True), 1)


@dataclass
class Shares:
    """Shares of the words outside the head in their shapes, by state."""

    divided: np.ndarray  # shape x state: the shape's division over states
    mass: np.ndarray  # shape x state: counts of the shape's words and the one place for words never seen
    prior: float

    @classmethod
    def of(cls, emit: np.ndarray, table: DataFrame) -> Shares:
        """From expected counts of the shapes (shape x state) and the table of words (shape, c, q)."""
        divided = emit + 0.1
        divided /= divided.sum(axis=1, keepdims=True)
        prior = PRIOR

        def add(batches):
            total = np.zeros((SHAPES, STATES), np.int64)
            for batch in batches:
                shapes, c, q = (batch.column(j).to_numpy() for j in range(3))
                np.add.at(total, shapes, _fixed(_weights(divided[shapes], c, q, prior)))
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "cells"])

        total = blocksum.summed(table.select("shape", "c", "q").mapInArrow(add, blocksum.SCHEMA), SHAPES * STATES, np.int64)
        return cls(divided, 0.5 * divided + total.reshape(SHAPES, STATES) / (1 << PLACES), prior)

    def __call__(self, shapes: np.ndarray, c: np.ndarray, q: np.ndarray) -> np.ndarray:
        """word x state; words never seen have c = 0 and q = 0."""
        return _weights(self.divided[shapes], c, q, self.prior) / self.mass[shapes]


def _weights(d: np.ndarray, c: np.ndarray, q: np.ndarray, prior: float) -> np.ndarray:
    return ((c + 0.5) / (c + prior))[:, None] * (c[:, None] * unpacked(q) + prior * d)


def _fixed(x: np.ndarray) -> np.ndarray:
    return np.rint(x * (1 << PLACES)).astype(np.int64)


def uneven(keys: np.ndarray, spread: float) -> np.ndarray:
    """Factors of words outside the head before they have counts: drawn by hash, their logarithms scaled by ``spread``."""
    u = np.stack([mix(keys.view(U) + U(97 + j)) >> U(11) for j in range(STATES)], axis=1)
    return (-np.log((u + 0.5) / 2.0**53)) ** spread


def with_words(model: Hmm, ratio: np.ndarray, shapes: np.ndarray) -> Hmm:
    """The model with a block's words outside the head as further symbols."""
    at = len(model.emit) - SHAPES + shapes
    return Hmm(model.start, model.go_on, model.move, np.vstack([model.emit, model.emit[at] * ratio]))


def _cut(per: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, number in its text) of segments of at most ``size`` entries, text by text."""
    n = np.maximum(1, -(-np.diff(per) // size))
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(per[:-1], n) + nth * size
    return start, np.minimum(size, np.repeat(per[1:], n) - start), nth


def _lanes(obs: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(step x lane symbols with the longest lanes first, lanes that are active at each step, order)."""
    order = np.argsort(-length, kind="stable")
    length = length[order]
    steps = int(length[0])
    grid = np.zeros((steps, len(order)), np.int64)
    active = np.searchsorted(-length, -np.arange(steps), side="left")
    for t in range(steps):
        grid[t, : active[t]] = obs[start[order[: active[t]]] + t]
    return grid, active, order


def expectations(model: Hmm, obs: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Expected counts of starts, segment starts, moves and emissions over texts of symbols."""
    k, size = STATES, len(model.emit)
    start, length, nth = _cut(per, SEGMENT)
    grid, active, order = _lanes(obs, start, length)
    first = (nth == 0)[order]
    alpha = np.zeros((*grid.shape, k))
    scale = np.ones(grid.shape)
    for t, n in enumerate(active):
        a = np.where(first[:, None], model.start, model.go_on) if t == 0 else alpha[t - 1, :n] @ model.move
        a = a * model.emit[grid[t, :n]]
        c = a.sum(axis=1)
        alpha[t, :n] = a / c[:, None]
        scale[t, :n] = c
    move = np.zeros((k, k))
    beta = np.ones((grid.shape[1], k))
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        if t + 1 < len(active) and (m := active[t + 1]):
            ahead = model.emit[grid[t + 1, :m]] * beta[:m] / scale[t + 1, :m, None]
            move += alpha[t, :m].T @ ahead
            beta[:m] = ahead @ model.move.T
        alpha[t, :n] *= beta[:n]  # now the states' posterior
    begin = alpha[0]
    symbols = np.concatenate([grid[t, :n] for t, n in enumerate(active)])
    states = np.concatenate([alpha[t, :n] for t, n in enumerate(active)])
    emit = np.stack([np.bincount(symbols, states[:, j], size) for j in range(k)], axis=1)
    return np.concatenate([begin[first].sum(axis=0), begin[~first].sum(axis=0), (move * model.move).ravel(), emit.ravel()])


def log_likelihoods(model: Hmm, obs: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Exact natural log-likelihood of each whole text of symbols."""
    start, length, nth = _cut(per, SEGMENT)
    text = np.searchsorted(per, start, side="right") - 1
    later = np.flatnonzero(nth > 0)
    lane_start = np.concatenate([start[nth == 0], np.repeat(start[later], STATES)])
    lane_length = np.concatenate([length[nth == 0], np.repeat(length[later], STATES)])
    unit = np.tile(np.eye(STATES), (len(later), 1))
    grid, active, order = _lanes(obs, lane_start, lane_length)
    n_first = int((nth == 0).sum())
    a = np.concatenate([np.tile(model.start, (n_first, 1)), unit @ model.move])[order]
    log = np.zeros(len(order))
    for t, n in enumerate(active):
        a[:n] = (a[:n] if t == 0 else a[:n] @ model.move) * model.emit[grid[t, :n]]
        if t % 4 == 3 or t + 1 == len(active) or active[t + 1] < n:
            c = a[:n].sum(axis=1)
            a[:n] /= c[:, None]
            log[:n] += np.log(c)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    a, log = a[back], log[back]
    state, total = a[:n_first].copy(), log[:n_first].copy()
    rows, logs = a[n_first:].reshape(-1, STATES, STATES), log[n_first:].reshape(-1, STATES)
    rank = nth[later]
    for r in range(1, int(rank.max(initial=0)) + 1):
        which = np.flatnonzero(rank == r)
        t = text[later[which]]
        top = logs[which].max(axis=1)
        v = np.einsum("ij,ijk->ik", state[t] * np.exp(logs[which] - top[:, None]), rows[which])
        c = v.sum(axis=1)
        state[t] = v / c[:, None]
        total[t] += top + np.log(c)
    return total


def _with_end(symbols: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of symbols with the end's symbol after each."""
    out = np.zeros(len(symbols) + len(per) - 1, np.int64)
    text = np.repeat(np.arange(len(per) - 1), np.diff(per))
    out[np.arange(len(symbols)) + text] = symbols
    return out, per + np.arange(len(per))


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _count_words(batches):
    """(key, shape, c) of the words of texts; keys are summed as far as a bounded buffer holds them."""
    names = ["key", "shape", "c"]

    def merged(parts):
        keys, first, back = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        shape = np.concatenate([p[1] for p in parts])[first]
        return keys, shape, np.bincount(back, np.concatenate([p[2] for p in parts])).astype(np.int64)

    def out(parts):
        keys, shape, c = merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(shape.astype(np.int32)), pa.array(c)], names)

    held, size, texts = [], 0, 0
    for batch in batches:
        texts += batch.num_rows
        for _, _, h, shapes, _ in _words(batch.column(0)):
            held.append(merged([(h, shapes, np.ones(len(h)))]))
            size += len(held[-1][0])
            if size > 600_000:
                held = [merged(held)]
                size = len(held[0][0])
                if size > 300_000:
                    yield out(held)
                    held, size = [], 0
    if held:
        yield out(held)
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.int64()), pa.array([0], pa.int32()), pa.array([texts], pa.int64())], names)


def _code(words):
    """Blocks of texts as symbols; words outside the head are numbered in the order of the block's ``keys``."""
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)

    def run(batches):
        v = words.value
        for batch in batches:
            for held in (False, True):
                part = batch.filter(pc.equal(batch.column(2), held))
                for lo, hi, h, shapes, per in _words(part.column(1)):
                    symbols, head = v.symbols(h, shapes)
                    keys, first, back = np.unique(h[~head], return_index=True, return_inverse=True)
                    symbols[~head] = v.size + back
                    symbols, per = _with_end(symbols, per)
                    packs = [pa.array([x.tobytes()], pa.binary()) for x in (per, symbols.astype(np.int32), shapes[~head][first].astype(np.int8))]
                    yield pa.RecordBatch.from_arrays([pa.array([held]), one(part.column(0).slice(lo, hi - lo)), one(pa.array(keys)), *packs], ["held", "ids", "keys", "per", "symbols", "shapes"])

    return run


def _arrays(data: pa.StructArray, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, per, shapes) of a coded block."""
    get = lambda name, kind: np.frombuffer(data.field(name)[i].as_buffer(), kind).astype(np.int64)
    return get("symbols", np.int32), get("per", np.int64), get("shapes", np.int8)


#: Rows that are packed at a time.
PACKED = 1 << 20


def _packs(batches):
    """One row for each block, of its places and their c and q, from many rows; several if there are more than ``PACKED`` rows."""

    def packs(held):
        block, *cols = [np.concatenate(x) for x in zip(*held)]
        order = np.argsort(block, kind="stable")
        block, cut = np.unique(block[order], return_index=True)
        parts = [[x.tobytes() for x in np.split(col[order], cut[1:])] for col in cols]
        return pa.RecordBatch.from_arrays([pa.array(block), *(pa.array(x, pa.binary()) for x in parts)], ["block", "place", "c", "q"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in range(4)])
            n += batch.num_rows
        if n >= PACKED:
            yield packs(held)
            held, n = [], 0
    if held:
        yield packs(held)


def _meet(coded: DataFrame, table: DataFrame) -> DataFrame:
    """Each block behind (place, c, q) of those of its words that the table has, packed by the tasks that have found them."""
    own = coded.select("block", F.posexplode("keys").alias("place", "key"))
    found = own.join(table.select("key", "c", "q"), "key").select("block", "place", "c", "q").mapInArrow(_packs, "block long, place binary, c binary, q binary")
    rows = found.unionByName(coded.select("block", F.struct("ids", "per", "symbols", "shapes").alias("data")), allowMissingColumns=True)
    return rows.repartition("block").sortWithinPartitions("block", F.col("data").isNotNull())


def _met(batches):
    """Yield ``(data, i, c, q)`` of the blocks that ``_meet`` has lined up; c and q follow the block's words."""
    held = []
    for batch in batches:
        data = batch.column(4)
        for i in range(batch.num_rows):
            if not data[i].is_valid:
                held.append([np.frombuffer(batch.column(1 + j)[i].as_buffer(), np.int64) for j in range(3)])
                continue
            c, q = np.zeros((2, len(data.field("shapes")[i].as_buffer())), np.int64)
            for place, *found in held:
                c[place], q[place] = found
            yield data, i, c, q
            held = []


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    spark = docs.sparkSession
    work = Scratch(spark, "hmm")
    bound_batches(spark)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    learned = texts.where(~held_out("id")).select("text")

    counted = learned.mapInArrow(_count_words, "key long, shape int, c long").groupBy("key").agg(F.min("shape").alias("shape"), F.sum("c").alias("c"))
    counted = work.save(counted, "counts")
    size = counted.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.expr(f"if(key = {END}, c, 0)")).alias("ends")).first()
    words = counted.where(F.col("key") != int(END))
    top = words.where(F.col("c") >= OFTEN).orderBy(F.desc("c"), "key").limit(HEAD).select("key", "c").toPandas().sort_values("key")
    shape_mass = np.zeros(SHAPES, np.int64)
    outside = words.join(F.broadcast(spark.createDataFrame(top[["key"]], "key long")), "key", "left_anti") if len(top) else words
    for r in outside.groupBy("shape").agg(F.sum("c").alias("c")).collect():
        shape_mass[r["shape"]] = r["c"]
    vocabulary = Vocabulary(top["key"].to_numpy(np.int64), top["c"].to_numpy(np.int64), int(size["ends"] or 0), int(size["n"] or 0), int(size["v"]), shape_mass)
    work.drop("counts")
    work.release()

    unigram = vocabulary.unigram()
    model = Hmm.initial(unigram)
    shared_words = spark.sparkContext.broadcast(vocabulary)
    id_type = texts.schema["id"].dataType.simpleString()
    coded_schema = f"held boolean, ids array<{id_type}>, keys array<bigint>, per binary, symbols binary, shapes binary"
    coded = texts.withColumn("held", held_out("id")).mapInArrow(_code(shared_words), coded_schema)
    coded = work.save(coded.withColumn("block", F.monotonically_increasing_id()), "coded")
    k, n_symbols = STATES, vocabulary.size
    learned = coded.where("not held").select("keys", F.struct("per", "symbols", "shapes").alias("data"))
    length = 2 * k + k * k + n_symbols * k

    fixed = 2 * k + k * k
    spread = float(shape_mass.sum() / max(1, vocabulary.total))  # the less the head holds, the more the others must tell states apart

    def block_counts(m, row, i):
        """(shapes, times, expected counts) of a coded block and its words."""
        numbers, per, shapes = _arrays(row.column(1), i)
        counts = expectations(with_words(m, uneven(row.column(0)[i].values.to_numpy(), spread), shapes), numbers, per)
        return shapes, np.bincount(numbers[numbers >= n_symbols] - n_symbols, minlength=len(shapes)), counts

    def round_of(shared):
        def run(batches):
            total = np.zeros(length, np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    shapes, _, counts = block_counts(shared.value, batch, i)
                    emit = counts[fixed:].reshape(-1, k)
                    np.add.at(emit, n_symbols - SHAPES + shapes, emit[n_symbols:])
                    total += _fixed(counts[:length])
            numbers, cells = blocksum.to_rows(total)
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(cells, pa.binary())], ["block", "cells"])

        return run

    for _ in range(ROUNDS):
        counts = learned.mapInArrow(round_of(spark.sparkContext.broadcast(model)), blocksum.SCHEMA)
        counts = blocksum.summed(counts, length, np.int64) / (1 << PLACES)
        model = model.refit(counts, unigram)
    shared_model = spark.sparkContext.broadcast(model)

    def expected(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shapes, times, counts = block_counts(shared_model.value, batch, i)
                n = counts[fixed:].reshape(-1, k)[n_symbols:]
                columns = [batch.column(0)[i].values, pa.array(shapes, pa.int32()), pa.array(times, pa.int64()), pa.array(packed(n))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "shape", "c", "q"])

    found = learned.mapInArrow(expected, "key long, shape int, c long, q long")
    parts = [F.shiftright("q", 8 * j).bitwiseAND(255) for j in range(k)]
    whole = sum(parts[1:], parts[0])
    sums = found.groupBy("key").agg(F.min("shape").alias("shape"), F.sum("c").alias("c"), *[F.sum(F.floor(F.col("c") * p * 4096 / whole)).alias(f"n{j}") for j, p in enumerate(parts)])
    most = F.greatest(*[F.col(f"n{j}") for j in range(k)])
    q = sum((F.shiftleft(F.floor(F.col(f"n{j}") * 255 / most + 0.5), 8 * j) for j in range(1, k)), F.floor(F.col("n0") * 255 / most + 0.5))
    table = work.save(sums.select("key", "shape", "c", q.cast("long").alias("q")), "words")
    work.release()
    ratio = Shares.of(counts[fixed:].reshape(-1, k)[-SHAPES:], table)
    shared = spark.sparkContext.broadcast((model, ratio))
    denominator = vocabulary.total + 0.5 * (vocabulary.distinct + 1)

    def measure(batches):
        m, share = shared.value
        v = shared_words.value
        head = np.concatenate([[v.end_count], v.counts, np.zeros(SHAPES)])
        for data, i, c, q in _met(batches):
            symbols, per, shapes = _arrays(data, i)
            hmm = log_likelihoods(with_words(m, share(shapes, c, q), shapes), symbols, per) / np.log(10)
            count = np.concatenate([head, c])[symbols]
            text = np.repeat(np.arange(len(per) - 1), np.diff(per))
            known = np.bincount(text, count > 0, len(per) - 1).astype(np.int64)
            base = np.bincount(text, np.log10((count + 0.5) / denominator), len(per) - 1)
            yield pa.RecordBatch.from_arrays([data.field("ids")[i].values, pa.array(np.diff(per)), pa.array(known), pa.array(base), pa.array(hmm)], ["id", "n_tokens", "n_known", "base", "hmm"])

    measured = _meet(coded, table).mapInArrow(measure, f"id {id_type}, n_tokens long, n_known long, base double, hmm double")
    return measured.select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), F.col("hmm").alias("score"),
    )
