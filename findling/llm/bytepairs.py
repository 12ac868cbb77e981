"""Byte-level byte-pair encoding and decoding with vectorised pre-tokenisation.

Texts are split without a regex. Each code point has a class (letter, number, space, other white space, other), taken
once from the tokenizer library itself for all code points; what the pattern looks ahead for (a contraction's letters,
a run of white space that goes on) is folded into the class of the character that asks. A character is then a
transition function on eight states: what kind of piece is open. The functions that arise by composition are some
hundred, so that they are numbers with a composition table, and an associative scan of these numbers (columns of
blocks, then block totals) gives every character's state, and with it whether a piece starts there. The slices' bytes
are merged by rank, lowest first and leftmost of equals, with a worker's cache of pieces; token ends are kept as byte
offsets beside the ids, and decoding concatenates the ids' bytes.

Defined cases: null text is empty; an empty text has no token; texts of any length are encoded whole, scanned in
windows that hand their state on; a piece of any length is merged with a heap, in n log n; repeated rows are
encoded each; an empty table gives no rows; columns named besides the text are passed through, others ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findling.llm.shared import table

LETTER, NUMBER, OTHER, MARK2, MARK3, SPACE_ON, SPACE_END, WHITE_ON, WHITE_END, STOP = range(10)  # symbols: MARK is an apostrophe before a contraction of two or three characters; ON: white space or the end follows
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, GLUE, IN_WHITE, ONE_MORE, TWO_MORE = range(8)  # states: GLUE is a space that the next character joins
SYMBOLS, STATES = 10, 8
WINDOW, COLUMNS, SLICE, BOUNDS = 1 << 18, 256, 1 << 22, 1 << 19
CACHED, LONGEST_CACHED, SHORT = 400_000, 64, 48
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  #: what the states stand for


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """By symbol and state: the next state, and whether the character starts a piece."""
    to, starts = np.zeros((SYMBOLS, STATES), np.uint8), np.ones((SYMBOLS, STATES), bool)
    for symbol, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        to[symbol] = run
        starts[symbol, [run, GLUE]] = False
    to[LETTER, [ONE_MORE, TWO_MORE]] = CLOSED, ONE_MORE
    starts[LETTER, [ONE_MORE, TWO_MORE]] = False
    for symbol, state in ((MARK2, ONE_MORE), (MARK3, TWO_MORE)):  # in a run of others, or after a space, an apostrophe is one of them
        to[symbol] = state
        to[symbol, [IN_OTHERS, GLUE]] = IN_OTHERS
        starts[symbol, [IN_OTHERS, GLUE]] = False
    for symbol in (SPACE_ON, WHITE_ON):
        to[symbol] = IN_WHITE
        starts[symbol, IN_WHITE] = False
    to[SPACE_END], to[WHITE_END], to[STOP] = GLUE, CLOSED, CLOSED  # the last of a run stands apart, and a space joins what follows
    return to, starts


TO, STARTS = _transitions()


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray]:
    """All functions that symbols compose to, the symbols' own first, and (f, g) -> first f, then g."""
    known = {bytes(row): i for i, row in reversed(list(enumerate(TO)))}
    order = [bytes(row) for row in TO]
    for f in order:
        for g in TO:
            made = bytes(g[s] for s in f)
            if made not in known:
                known[made] = len(order)
                order.append(made)
    functions = np.array([list(f) for f in order], np.uint8)
    table = np.array([[known[bytes(g[f])] for g in functions] for f in functions], np.uint16)
    return functions, table


def states(symbols: np.ndarray, state: int) -> np.ndarray:
    """The state before each symbol and, last, after all, by an associative scan of the symbols' functions."""
    functions, then = _monoid()
    n = len(symbols)
    rows = -(-n // COLUMNS)
    blocks = np.full(rows * COLUMNS, STOP, np.uint16)
    blocks[:n] = symbols
    blocks = np.ascontiguousarray(blocks.reshape(rows, COLUMNS).T)  # a block for each row, position by position
    for k in range(1, COLUMNS):
        blocks[k] = then[blocks[k - 1], blocks[k]]
    totals, width = blocks[-1].copy(), 1
    while width < rows:  # inclusive scan of the blocks' functions
        totals[width:] = then[totals[:-width], totals[width:]]
        width *= 2
    before = np.empty(rows, np.uint8)
    before[:1], before[1:] = state, functions[totals[:-1], state]
    after = functions[blocks, before].T.ravel()[:n]
    return np.append(np.uint8(state), after)


def classes_of(pattern: str) -> np.ndarray:
    """LETTER, NUMBER, SPACE_ON, WHITE_ON or OTHER of every code point, as the tokenizer library has them: it drops what a pattern does not match."""
    import tiktoken

    if pattern != PATTERN:
        raise ValueError("states are those of another pattern")
    ranks = {bytes([b]): b for b in range(256)}
    points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    for k, (kind, symbol) in enumerate(((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE_ON))):
        known = tiktoken.Encoding(f"class{k}", pat_str=f"{kind}+", mergeable_ranks=ranks, special_tokens={})
        out[_points(bytes(known.encode_ordinary(points)).decode())] = symbol
    out[32] = SPACE_ON
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def symbols_of(points: np.ndarray, kinds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of code points, looking ahead. ends: places that belong to no text."""
    out = kinds[points]
    out[ends] = STOP
    following = np.append(out[1:], STOP)
    white = (out == SPACE_ON) | (out == WHITE_ON)
    last = white & (following <= OTHER)  # something other than white space follows
    one = np.append(points[1:], 0)
    mark = np.flatnonzero((points == ord("'")) & (following == LETTER))
    if len(mark):
        a, b = one[mark], np.append(points[2:], [0, 0])[mark]
        two = np.isin(a, [ord(c) for c in "stmd"])
        three = (np.isin(a, [ord(c) for c in "rv"]) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        out[mark[two]], out[mark[three]] = MARK2, MARK3
    out[last] += 1
    return out


def starts_of(points: np.ndarray, kinds: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The places where a piece starts, and the ends. Windows look two characters ahead and hand their state on."""
    found, state, marks = [], CLOSED, np.zeros(len(points), bool)
    marks[ends] = True
    for i in range(0, len(points), window):
        some = points[i : i + window + 2]
        symbols = symbols_of(some, kinds, np.flatnonzero(marks[i : i + window + 2]))[:window]
        at = states(symbols, state)
        state = int(at[-1])
        found.append(np.flatnonzero(STARTS[symbols, at[:-1]]) + i)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def merged(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one piece: the pair of the lowest rank is joined until none has one, the leftmost of equals first."""
    if piece in ranks:
        return (ranks[piece],)
    n = len(piece)
    if n <= SHORT:
        return merged_short(piece, ranks)
    stop, back = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at a place: its end, the part before
    waiting = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(waiting)
    while waiting:
        _, i, middle, end = heapq.heappop(waiting)
        if stop[i] != middle or middle >= n or stop[middle] != end:  # joined otherwise since
            continue
        stop[i], stop[middle] = end, 0
        if end < n:
            back[end] = i
            if (r := ranks.get(piece[i : stop[end]])) is not None:
                heapq.heappush(waiting, (r, i, end, stop[end]))
        if (b := back[i]) >= 0 and (r := ranks.get(piece[b:end])) is not None:
            heapq.heappush(waiting, (r, b, i, end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : stop[i]]])
        i = stop[i]
    return tuple(ids)


def merged_short(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same without a heap: the lowest of all pairs is looked for again after every join."""
    n, rank, none = len(piece), ranks.get, 1 << 62
    at = list(range(n + 1))
    pairs = [rank(piece[i : i + 2], none) for i in range(n - 1)]
    while pairs and (low := min(pairs)) < none:
        k = pairs.index(low)
        del at[k + 1], pairs[k]
        if k < len(pairs):
            pairs[k] = rank(piece[at[k] : at[k + 2]], none)
        if k:
            pairs[k - 1] = rank(piece[at[k - 1] : at[k + 1]], none)
    return tuple([ranks[piece[a:b]] for a, b in zip(at, at[1:], strict=False)])


class Codec:
    """A rank file's encoder and decoder. The cache holds at most CACHED short pieces."""

    def __init__(self, ranks: dict[bytes, int], kinds: np.ndarray):
        self.ranks, self.kinds, self.known = ranks, kinds, {}  # the cache's values are tuples, which the garbage collector need not look into
        self.words = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.sizes = np.zeros(max(self.words) + 1, np.int32)
        self.sizes[list(self.words)] = list(map(len, self.words.values()))

    def ids(self, piece: bytes) -> tuple[int, ...]:
        found = self.known.get(piece)
        if found is None:
            found = merged(piece, self.ranks)
            if len(piece) <= LONGEST_CACHED:
                if len(self.known) >= CACHED:
                    self.known.clear()
                self.known[piece] = found
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        joined = "\n".join([*texts, ""])
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1
        points, data = _points(joined), pa.py_buffer(joined.encode())
        places = starts_of(points, self.kinds, ends)
        bounds = np.append(np.append(0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int32))[places], data.size).astype(np.int32)
        ids, counts = [np.zeros(0, np.int32)], np.zeros(len(places) + 1, np.int64)
        for i in range(0, len(places), BOUNDS):
            at = bounds[i : i + BOUNDS + 1]
            slices = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), data]).dictionary_encode()
            known = [self.ids(piece) for piece in slices.dictionary.to_pylist()]
            sizes, which = np.fromiter(map(len, known), np.int64, len(known)), slices.indices.to_numpy()
            starts, flat = np.cumsum(sizes) - sizes, np.fromiter(chain.from_iterable(known), np.int32)
            own = sizes[which]
            own[np.isin(np.arange(i, i + len(own)), np.searchsorted(places, ends))] = 0  # an end is a slice of its own
            counts[i + 1 : i + 1 + len(own)] = own
            ids.append(flat[np.repeat(starts[which] - (np.cumsum(own) - own), own) + np.arange(own.sum())])
        ids, total = np.concatenate(ids), np.cumsum(counts)
        stops = total[np.searchsorted(places, ends)]
        return [ids[a:b] for a, b in zip([0, *stops.tolist()], stops.tolist(), strict=False)]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where tokens end in the text's bytes."""
        return np.cumsum(self.sizes[ids], dtype=np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        return joined(ids, self.words)


def joined(ids: np.ndarray, words: dict[int, bytes]) -> bytes:
    return b"".join(b"".join(map(words.__getitem__, ids[i : i + BOUNDS].tolist())) for i in range(0, len(ids), BOUNDS))


def rank_file(path: str | None = None) -> bytes:
    """A rank file; by default the public byte-level one."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


def read_ranks(file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines())}


_codecs: dict[bytes, Codec] = {}  #: of a worker, by the files' digests


def _codec(file: bytes, kinds: np.ndarray) -> Codec:
    name = hashlib.sha256(file).digest()
    if name not in _codecs:
        _codecs[name] = Codec(read_ranks(file), kinds)
    return _codecs[name]


def _arrays(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate(values) if values else [], kind))


def encode(docs: DataFrame, file: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",), pattern: str = PATTERN) -> DataFrame:
    """The columns keep with ids and ends, the byte offset in the text's UTF-8 where each token ends. file: the ranks, which every task is sent with the classes of all code points (2 MB)."""
    rows = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast((file, classes_of(pattern)))
    names = [*keep, "ids", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*sent.value)
        for batch in batches:
            sizes, start = np.cumsum(pa.compute.binary_length(batch.column(len(keep))).to_numpy(zero_copy_only=False)), 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + SLICE, "right")))
                part = batch.slice(start, stop - start)
                found = codec.encode(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], _arrays(found, pa.int32()), _arrays([codec.offsets(ids) for ids in found], pa.int64())], names)
                start = stop

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, ids array<int>, ends array<bigint>")


def decode(tokens: DataFrame, file: bytes, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """tokens with the bytes that their ids stand for; null ids are null."""
    sent, at = tokens.sparkSession.sparkContext.broadcast(file), tokens.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {i: w for w, i in read_ranks(sent.value).items()}
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                data = [joined(v.values.to_numpy(), words) if v.is_valid else None for v in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], [*part.schema.names, to])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(run, f"{fields}, `{to}` binary")


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    file = rank_file()
    tokens = encode(table(spark, sf_dir, "documents"), file, pattern=public_tokenizers.PATTERN)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    told = tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids")
    return decode(told, file).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
