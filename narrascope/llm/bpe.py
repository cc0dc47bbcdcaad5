"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

A text's bytes become an array of codepoint classes.  Each class is a transition function of a small automaton that
knows what kind of slice it stands in; composing functions is associative and all compositions that can arise form
a small table.  So the automaton runs as a scan: lanes of the text are composed side by side, the lanes' results
are composed by doubling, and every position's state follows from both.  States give the slice boundaries.  The
slices are those of the usual pattern for such vocabularies: contractions, runs of letters, of digits and of other
signs with one leading space, and white space.

Slices are looked up by their 64-bit hash in a table of slices merged before and held against its bytes; new ones go
through pair merging by rank.  Token lengths give each token's byte offset, by which decoding puts the tokens' bytes in place.

Defined cases: null and empty texts have no tokens; special tokens don't exist, their strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from narrascope.llm.rows import map_texts
from narrascope.llm.textbatch import U, blocks, codepoints, eights, same_spans, span_hashes

LANE = 256
SLOTS_BITS = 18
#: Slices kept as merged before, and their bytes; beyond either the table starts anew.
MOST_SLICES = 400_000
MOST_BYTES = 16 << 20

LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, SPACE, LONE = range(8)
#: States: what kind of slice the last character belongs to, and what it expects.
_START, _IN_LETTERS, _IN_NUMBERS, _IN_OTHERS, _IN_BLANKS, _LED, _ONE_MORE, _TWO_MORE, _CLOSED = range(9)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """(next state, whether a slice starts at this character)."""
    if kind == LETTER:
        if state in (_ONE_MORE, _TWO_MORE):
            return (_CLOSED if state == _ONE_MORE else _ONE_MORE), False
        return _IN_LETTERS, state not in (_IN_LETTERS, _LED)
    if kind == NUMBER:
        return _IN_NUMBERS, state not in (_IN_NUMBERS, _LED)
    if kind in (OTHER, SHORT, LONG):
        inside = state in (_IN_OTHERS, _LED)
        if kind == OTHER or inside:
            return _IN_OTHERS, not inside
        return (_ONE_MORE if kind == SHORT else _TWO_MORE), True
    if kind == BLANK:  # white space before white space or the end
        return _IN_BLANKS, state != _IN_BLANKS
    return (_LED if kind == SPACE else _CLOSED), True  # the last white space before something else


class _Automaton:
    """Composition tables; kinds 8..15 are kinds 0..7 at the start of a text."""

    def __init__(self):
        kinds = [tuple(_step(s, k)[0] for s in range(9)) for k in range(8)]
        kinds += [(_step(_START, k)[0],) * 9 for k in range(8)]
        self.starts = np.array([[_step(s, k)[1] for k in range(8)] + [True] * 8 for s in range(9)])
        known = {tuple(range(9)): 0}
        queue = [tuple(range(9))]
        while queue:
            f = queue.pop()
            for g in kinds:
                fg = tuple(g[x] for x in f)
                if fg not in known:
                    known[fg] = len(known)
                    queue.append(fg)
        functions = sorted(known, key=known.get)
        self.value = np.array(functions, np.uint8)
        self.extend = np.array([[known[tuple(g[x] for x in f)] for g in kinds] for f in functions], np.uint16)
        self.compose = np.array([[known[tuple(g[x] for x in f)] for g in functions] for f in functions], np.uint16)

    def boundaries(self, kinds: np.ndarray) -> np.ndarray:
        n = len(kinds)
        lanes = -(-n // LANE)
        grid = np.full(lanes * LANE, BLANK, np.uint8)
        grid[:n] = kinds
        grid = np.ascontiguousarray(grid.reshape(lanes, LANE).T)
        after = np.empty((LANE, lanes), np.uint16)
        cur = np.zeros(lanes, np.uint16)
        for j in range(LANE):
            cur = after[j] = self.extend[cur, grid[j]]
        whole, step = cur.copy(), 1
        while step < lanes:  # inclusive scan of the lanes' compositions by doubling
            whole[step:] = self.compose[whole[:-step], whole[step:]]
            step *= 2
        begin = np.zeros(lanes, np.uint8)
        begin[1:] = self.value[whole[:-1], _START]
        before = np.empty((LANE, lanes), np.uint8)
        before[0] = begin
        before[1:] = self.value[after[:-1], begin]
        return self.starts[before, grid].T.reshape(-1)[:n]


_automaton: list[_Automaton] = []
_kinds: list[np.ndarray] = []


def _kind_table() -> np.ndarray:
    if not _kinds:
        by = {"L": LETTER, "N": NUMBER}
        table = np.array([by.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        for c in [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
            table[c] = LONE
        table[32] = SPACE
        _kinds.append(table)
    return _kinds[0]


def slices(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Byte offsets at which the slices of the texts start; every text that isn't empty starts one."""
    if not len(data):
        return np.zeros(0, np.int64)
    if not _automaton:
        _automaton.append(_Automaton())
    c, at = codepoints(data)
    n = len(c)
    kind = _kind_table()[c]
    heads = np.searchsorted(at, bounds[:-1][np.diff(bounds) > 0])
    blank = kind >= SPACE
    ahead = np.ones(n, bool)  # whether white space or the end follows
    ahead[:-1] = blank[1:]
    ahead[heads[1:] - 1] = True
    kind[blank & ahead] = BLANK
    mark = np.flatnonzero(c == 39)
    if len(mark):
        head = np.zeros(n + 3, bool)
        head[heads] = True
        head[n:] = True
        pad = np.concatenate([c, np.zeros(3, c.dtype)])
        one, two = pad[mark + 1], pad[mark + 2]
        in1, in2 = ~head[mark + 1], ~(head[mark + 1] | head[mark + 2])
        kind[mark[in1 & np.isin(one, [ord(x) for x in "stmd"])]] = SHORT
        pair = one * 128 + two
        kind[mark[in2 & (one < 128) & (two < 128) & np.isin(pair, [ord(x[0]) * 128 + ord(x[1]) for x in ("re", "ve", "ll")])]] = LONG
    kind[heads] += 8
    return at[_automaton[0].boundaries(kind)]


_NONE = 1 << 40


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    get = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
    while pairs and (low := min(pairs)) != _NONE:
        i = pairs.index(low)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], _NONE)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], _NONE)
    return [ranks[x] for x in parts]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Tokens of one slice: adjacent parts are joined, the lowest rank first, the leftmost among equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n <= 64:
        return _merge_short(piece, ranks)
    ends = list(range(1, n + 1))  # of the part that starts here
    prior = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = ends[i]
        if j >= n or not alive[j] or ends[j] != end:
            continue
        alive[j] = False
        ends[i] = end
        if end < n:
            prior[end] = i
            if (r := ranks.get(piece[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        p = prior[i]
        if p >= 0 and (r := ranks.get(piece[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


def _gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The ranges start..start+count of ``flat``, one after the other."""
    to = np.cumsum(count)
    return flat[np.repeat(start - (to - count), count) + np.arange(to[-1] if len(to) else 0)]


class Encoder:
    """Encoding and decoding of Arrow columns with one vocabulary of (token bytes, rank) lines in base64."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_len = np.array([len(x) for x in tokens], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        digits = [b"%d," % k for k in range(size)]
        self.digit_len = np.array([len(x) for x in digits], np.int64)
        self.digit_at = np.cumsum(self.digit_len) - self.digit_len
        self.digit_bytes = np.frombuffer(b"".join(digits), np.uint8)
        self._reset()

    def _reset(self) -> None:
        self.slot_key = np.zeros(1 << SLOTS_BITS, U)
        self.slot_no = np.full(1 << SLOTS_BITS, -1, np.int32)
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.used = 0
        self.text = np.zeros(1 << 20, np.uint8)
        self.text_at = np.zeros(1 << 14, np.int64)
        self.text_used = 0

    def _number(self, piece: bytes) -> int:
        """The number of a slice in the table, which it joins if it is new."""
        k = self.known.get(piece)
        if k is not None:
            return k
        ids = merge(piece, self.ranks)
        k = len(self.known)
        if k + 1 == len(self.at):
            self.at, self.count, self.text_at = (np.concatenate([x, x]) for x in (self.at, self.count, self.text_at))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        while self.text_used + len(piece) + 8 > len(self.text):
            self.text = np.concatenate([self.text, self.text])
        self.flat[self.used : self.used + len(ids)] = ids
        self.text[self.text_used : self.text_used + len(piece)] = np.frombuffer(piece, np.uint8)
        self.at[k], self.count[k], self.text_at[k] = self.used, len(ids), self.text_used
        self.used += len(ids)
        self.text_used += len(piece)
        self.text_at[k + 1] = self.text_used
        self.known[piece] = k
        return k

    def _differ(self, no: np.ndarray, ahead: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Slices whose bytes aren't those of the number that their hash has led to."""
        own = self.text_at[no]
        bad = self.text_at[no + 1] - own != size
        more = np.flatnonzero(~bad & (size > 8))  # up to eight bytes, equal hashes and lengths mean equal bytes
        kept = np.ndarray(len(self.text) - 7, "<u8", self.text, strides=(1,))
        bad[more] = ~same_spans(ahead, starts[more], kept, own[more], size[more])
        return np.flatnonzero(bad)

    def encode_block(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds of each text's ids) of the texts in ``data``."""
        if len(self.known) > MOST_SLICES or self.text_used > MOST_BYTES:
            self._reset()
        starts = slices(data, bounds)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        ahead = eights(data)
        h = span_hashes(data, starts, ends, ahead)
        slot = (h >> U(64 - SLOTS_BITS)).astype(np.int64)
        no = np.where(self.slot_key[slot] == h, self.slot_no[slot], -1).astype(np.int64)
        miss = np.flatnonzero(no < 0)
        if len(miss):
            _, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            no[miss] = np.array([self._number(data[starts[i] : ends[i]].tobytes()) for i in miss[first].tolist()])[back]
            self.slot_key[slot[miss]] = h[miss]
            self.slot_no[slot[miss]] = no[miss]
        for i in self._differ(no, ahead, starts, ends - starts).tolist():
            no[i] = self._number(data[starts[i] : ends[i]].tobytes())
        count = self.count[no]
        ids = _gather(self.flat, self.at[no], count)
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, total[np.searchsorted(starts, bounds)]

    def decode_block(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bounds of each text's bytes) of texts given as ids."""
        size = self.token_len[ids]
        offset = np.concatenate([[0], np.cumsum(size)])
        return _gather(self.token_bytes, self.token_at[ids], size), offset[bounds]

    def decimal_block(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bounds) of each text's ids in decimal, a comma after each."""
        size = self.digit_len[ids]
        offset = np.concatenate([[0], np.cumsum(size)])
        return _gather(self.digit_bytes, self.digit_at[ids], size), offset[bounds]


_encoders: dict[bytes, Encoder] = {}


def _encoder(lines: bytes) -> Encoder:
    key = hashlib.sha256(lines).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(lines)
    return _encoders[key]


def _vocabulary(spark: SparkSession, path: str):
    """The vocabulary file's bytes, sent to the executors: about a megabyte, whatever the input."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _lists(bounds: list[np.ndarray], values: list[np.ndarray], kind) -> pa.Array:
    size = np.concatenate([np.diff(b) for b in bounds]) if bounds else np.zeros(0, np.int64)
    flat = np.concatenate(values) if values else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat, kind))


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``ids`` and ``offsets``: the byte of the text at which each token starts."""
    lines = _vocabulary(docs.sparkSession, vocabulary)

    def run(col):
        coder = _encoder(lines.value)
        ids, bounds, offsets = [], [], []
        for _, _, data, b in blocks(col):
            i, t = coder.encode_block(data, b)
            size = coder.token_len[i]
            start = np.cumsum(size) - size
            ids.append(i)
            bounds.append(t)
            offsets.append((start - np.repeat(b[:-1], np.diff(t))).astype(np.int32))
        return [_lists(bounds, ids, pa.int32()), _lists(bounds, offsets, pa.int32())]

    kind = T.ArrayType(T.IntegerType())
    return map_texts(docs, text_col, keep, [T.StructField("ids", kind), T.StructField("offsets", kind)], run)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """All columns and ``decoded``, the bytes that the ids stand for; null ids give no bytes."""
    lines = _vocabulary(encoded.sparkSession, vocabulary)
    names = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([*(encoded.schema[c] for c in names), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        coder = _encoder(lines.value)
        for batch in batches:
            col = batch.column(names.index(ids_col))
            size = np.array([0 if x is None else x for x in col.value_lengths().to_pylist()], np.int64)
            data, bounds = coder.decode_block(col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]))
            out = pa.Array.from_buffers(pa.binary(), len(col), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*names, "decoded"])

    return encoded.select(*names).mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``n_tokens`` and the digests ``ids_sha256`` and ``decoded_sha256`` of encoding and then decoding."""
    lines = _vocabulary(docs.sparkSession, vocabulary)

    def digests(buf: np.ndarray, bounds: np.ndarray, cut: int) -> list[str]:
        view = memoryview(np.ascontiguousarray(buf))
        return [hashlib.sha256(view[a : max(a, b - cut)]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def run(col):
        coder = _encoder(lines.value)
        n, ids_digest, text_digest = [], [], []
        for _, _, data, b in blocks(col):
            ids, bounds = coder.encode_block(data, b)
            n += np.diff(bounds).tolist()
            ids_digest += digests(*coder.decimal_block(ids, bounds), 1)
            text_digest += digests(*coder.decode_block(ids, bounds), 0)
        return [pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_texts(docs, text_col, keep, fields, run)
