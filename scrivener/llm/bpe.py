"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

A token sequence is the BPE encoding of its bytes exactly when every two neighbours are
the encoding of their own concatenation. So the last token of a prefix is the one vocabulary
suffix that may follow the encoding of what stands before it. A state of the transducer
holds, for each place where a token may still be open, the trie node reached since and
the token before it; a step by a byte gives the last token of the prefix that ends there.
Walking back over those gives the tokens. All places that are open lie within the longest
token's length, so tokens before the last boundary that they share are settled and can be
emitted. States and steps are made when first needed and kept. The new pieces of a batch
of texts step together, a byte of each at a time, through arrays of the steps made so far.

Decoding maps identifiers to bytes and bytes to text by a UTF-8 state machine that keeps
an unfinished character from one call to the next.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

#: States that a transducer keeps, and pieces whose tokens it remembers, before it starts anew.
MAX_STATES = 1 << 18
MAX_PIECES = 1 << 19
MAX_NEIGHBOURS = 1 << 19
#: Bytes of a piece after which settled tokens are emitted.
WINDOW = 1 << 12
ROWS_OUT = 1000
#: Characters of texts whose pieces are looked up together, and of a piece that is remembered.
CHARS_TOGETHER = 1 << 20
MAX_KEPT = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file at ``path``: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class _Steps:
    """Steps by state and byte as arrays, open addressing: many are looked up or added at once."""

    def __init__(self, bits: int = 12):
        self.bits, self.used = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int64)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of every key, -1 where there is none."""
        places, top = self._places(keys), (1 << self.bits) - 1
        there = self.keys[places]
        out = np.where(there == keys, self.values[places], -1)
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            places[rest] = at = (places[rest] + 1) & top
            there, wanted = self.keys[at], keys[rest]
            same = there == wanted
            out[rest[same]] = self.values[at[same]]
            rest = rest[~same & (there >= 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keep the values of keys that are all different and not there yet."""
        self.used += len(keys)
        if 2 * self.used > len(self.keys):
            kept = self.keys >= 0
            keys, values = np.concatenate([self.keys[kept], keys]), np.concatenate([self.values[kept], values])
            self.__init__((2 * len(keys)).bit_length())
            self.used = len(keys)
        places, top = self._places(keys), (1 << self.bits) - 1
        while len(keys):
            free = self.keys[places] < 0
            self.keys[places[free]] = keys[free]
            won = self.keys[places] == keys
            self.values[places[won]] = values[won]
            keys, values, places = keys[~won], values[~won], (places[~won] + 1) & top


class BytePairTransducer:
    """Encode byte strings by ranks, as repeated merging of the lowest-ranked pair would."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for the single bytes {missing}")
        self.size_of = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size_of[list(ranks.values())] = list(map(len, ranks))
        # the trie: children by node and byte, and the token that ends at a node
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int | None] = [None]
        self.depth = [0]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(None)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token_at[node] = rank
        # merging may never arrive at a token; such a token only stands for a whole piece
        self.reached: dict[int, bool] = {}
        self.may_follow: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        # nodes and the tokens before them by turns: flat, so that the collector has little to visit
        start = (0, None)
        self.states: dict[tuple, int] = {start: 0}
        self.keys: list[tuple] = [start]
        # steps by state and byte, for a piece alone and for pieces together
        self.steps: dict[int, tuple[int, int]] = {}
        self.together = _Steps()

    def _merge(self, text: bytes) -> list[int]:
        """Tokens by merging, for the short strings that settle which tokens may be neighbours."""
        rank, none = self.ranks.get, 1 << 60
        parts = [text[i : i + 1] for i in range(len(text))]
        pairs = [rank(text[i : i + 2], none) for i in range(len(text) - 1)]
        while pairs and (least := min(pairs)) < none:
            at = pairs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            # only the pairs beside the merged part have another rank now
            for i in (at - 1, at):
                if 0 <= i < len(pairs):
                    pairs[i] = rank(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def _fits(self, before: int | None, token: int) -> bool:
        if before is None:
            if token not in self.reached:
                self.reached[token] = self._merge(self.bytes_of[token]) == [token]
            return self.reached[token]
        pair = before << 32 | token
        if pair not in self.may_follow:
            if len(self.may_follow) >= MAX_NEIGHBOURS:
                self.may_follow.clear()
            self.may_follow[pair] = self._merge(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
        return self.may_follow[pair]

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """Make the step from a state by a byte: the next state, and the last token of the prefix."""
        alive, ended = [], None
        key = self.keys[state]
        for node, before in zip(key[::2], key[1::2], strict=True):
            nxt = self.children[node].get(byte)
            if nxt is None:
                continue
            if self.children[nxt]:
                alive += (nxt, before)
            token = self.token_at[nxt]
            if ended is None and token is not None and self._fits(before, token):
                ended = token
        alive += (0, ended)
        key = tuple(alive)
        nxt = self.states.setdefault(key, len(self.keys))
        if nxt == len(self.keys):
            self.keys.append(key)
        return nxt, ended

    def _step_alone(self, state: int, byte: int) -> tuple[int, int]:
        """The step of a single piece, which may be the one that starts the states anew."""
        step = self.steps[state << 8 | byte] = self._step(state, byte)
        if len(self.keys) > self.max_states:
            key = self.keys[step[0]]
            self._reset()
            step = (self.states.setdefault(key, len(self.keys)), step[1])
            if step[0]:
                self.keys.append(key)
        return step

    def _steps_together(self, keys: np.ndarray) -> np.ndarray:
        """For each state and byte the next state and the last token, as one number."""
        found = self.together.find(keys)
        if len(new := np.flatnonzero(found < 0)):
            wanted, where = np.unique(keys[new], return_inverse=True)
            made = np.array([nxt << 32 | token for nxt, token in (self._step(k >> 8, k & 255) for k in wanted.tolist())], np.int64)
            self.together.add(wanted, made)
            found[new] = made[where]
        return found

    def _back(self, last: list[int], end: int) -> list[int]:
        """Tokens up to ``end``, given the last token of every prefix."""
        out = []
        while end:
            token = last[end - 1]
            out.append(token)
            end -= len(self.bytes_of[token])
        out.reverse()
        return out

    def _settled(self, last: list[int], state: int) -> list[int]:
        """The tokens that no further byte can change: those that all open places have before them."""
        ways = [self._back(last, len(last) - self.depth[node]) for node in self.keys[state][::2]]
        least = min(map(len, ways))
        shared = next((k for k in range(least) if any(w[k] != ways[0][k] for w in ways)), least)
        return ways[0][:shared]

    def encode(self, text: bytes) -> tuple[int, ...]:
        """The tokens of a piece; a piece that is a token is that token."""
        if not text:
            return ()
        if (whole := self.ranks.get(text)) is not None:
            return (whole,)
        out: list[int] = []
        last: list[int] = []
        state, steps = 0, self.steps
        for start in range(0, len(text), WINDOW):
            if start:
                settled = self._settled(last, state)
                out += settled
                del last[: sum(len(self.bytes_of[t]) for t in settled)]
            for byte in text[start : start + WINDOW]:
                step = steps.get(state << 8 | byte)
                if step is None:
                    step = self._step_alone(state, byte)
                    steps = self.steps
                state, token = step
                last.append(token)
        return (*out, *self._back(last, len(last)))

    def encode_together(self, texts: list[bytes]) -> list[tuple[int, ...]]:
        """The tokens of every piece, as ``encode`` gives them; for many short pieces."""
        out: list[tuple[int, ...]] = [() if not t else (whole,) if (whole := self.ranks.get(t)) is not None else None for t in texts]
        # longest first, so that those not yet at their end are always the first ones
        todo = sorted((i for i, tokens in enumerate(out) if tokens is None), key=lambda i: -len(texts[i]))
        size = np.fromiter((len(texts[i]) for i in todo), np.int64, len(todo))
        ends = np.cumsum(size)
        # states are only started anew between groups, so a group has a quarter of them in bytes at most
        first = 0
        while first < len(todo):
            before = ends[first] - size[first]
            n = max(1, int(np.searchsorted(ends[first:], before + max(1, self.max_states // 4), "right")))
            if len(self.keys) >= self.max_states:
                self._reset()
            part = todo[first : first + n]
            for i, tokens in zip(part, self._group([texts[i] for i in part], size[first : first + n]), strict=True):
                out[i] = tokens
            first += n
        return out

    def _group(self, texts: list[bytes], size: np.ndarray) -> Iterator[tuple[int, ...]]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(size)
        starts = ends - size
        last = np.empty(len(data), np.int64)
        state = np.zeros(len(texts), np.int64)
        # pieces longer than j are the first ``open_at[j]``
        open_at = np.searchsorted(-size, -np.arange(int(size[0])), "left")
        for j, n in enumerate(open_at.tolist()):
            at = starts[:n] + j
            step = self._steps_together(state[:n] << 8 | data[at])
            state[:n] = step >> 32
            last[at] = step & 0xFFFFFFFF
        # walk back over last tokens, all pieces at once; a token stands where its last byte does
        stands = np.zeros(len(data), bool)
        at, floor = ends - 1, starts
        while len(at):
            stands[at] = True
            at = at - self.size_of[last[at]]
            open_ = at >= floor
            at, floor = at[open_], floor[open_]
        upto = np.cumsum(stands)[ends - 1].tolist()
        tokens = last[stands].tolist()
        return (tuple(tokens[a:b]) for a, b in zip([0, *upto], upto))


class _Pieces(dict):
    """Tokens by piece, made by the transducer when first asked for.

    Two generations of ``most`` pieces each: a piece of the older one that is met again
    moves to the newer, so frequent pieces outlive the turn of generations.
    """

    def __init__(self, transducer: BytePairTransducer, most: int = MAX_PIECES):
        super().__init__()
        self.transducer, self.older, self.most = transducer, {}, most

    def __missing__(self, piece: str) -> tuple[int, ...]:
        tokens = self.older.get(piece)
        if tokens is None:
            tokens = self.transducer.encode(piece.encode("utf-8", "surrogatepass"))
        self._keep(piece, tokens)
        return tokens

    def _keep(self, piece: str, tokens: tuple[int, ...]) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if len(piece) <= MAX_KEPT:
            self[piece] = tokens

    def of_all(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """The tokens of every piece; short ones not met before are made together."""
        out, new = {}, []
        for piece in pieces:
            tokens = self.get(piece)
            if tokens is None:
                if len(piece) <= MAX_KEPT and piece not in self.older:
                    new.append(piece)
                    continue
                tokens = self[piece]
            out[piece] = tokens
        made = self.transducer.encode_together([p.encode("utf-8", "surrogatepass") for p in new])
        for piece, tokens in zip(new, made, strict=True):
            out[piece] = tokens
            self._keep(piece, tokens)
        return out


#: Code points for which ``narrow`` spells out the classes of a pattern.
NARROW_TOP = 0x250


def narrow(pattern: str) -> str | None:
    r"""The pattern for Python's own regular expressions, for texts below ``NARROW_TOP``.

    There ``\p{L}``, ``\p{N}`` and ``\s`` are short lists of ranges, and that engine is the
    faster one. None if the pattern has other Unicode classes.
    """
    points = range(NARROW_TOP)

    def ranges(cls: str) -> str:
        inside = [bool(regex.match(cls, chr(i))) for i in points]
        edges = [i for i in points if inside[i] != (i > 0 and inside[i - 1])] + [NARROW_TOP] * inside[-1]
        return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2], strict=True))

    known = {cls: ranges(cls) for cls in (r"\p{L}", r"\p{N}", r"\s")}
    known[r"\S"] = None
    out, in_set = [], False
    for part in regex.findall(r"\\p\{\w+\}|\\.|.", pattern, regex.S):
        if part in known:
            if part == r"\S":
                if in_set:
                    return None
                out.append(f"[^{known[chr(92) + 's']}]")
            else:
                out.append(known[part] if in_set else f"[{known[part]}]")
            continue
        if regex.match(r"\\[a-zA-Z]", part):
            return None
        in_set = part == "[" or in_set and part != "]"
        out.append(part)
    return "".join(out)


class StreamingDecoder:
    """Text from tokens that arrive in parts; a character split between parts waits for its rest.

    Bytes that are no UTF-8 become U+FFFD, as they do when all bytes are decoded at once.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.rest = bytes_of, b""

    @staticmethod
    def _open(data: bytes) -> int:
        """How many bytes at the end begin a character that may still be completed."""
        for k in range(1, min(4, len(data) + 1)):
            b = data[-k]
            if 0x80 <= b < 0xC0:
                continue
            need = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
            if need <= k:
                return 0
            if k > 1:  # the first continuation byte decides on overlong forms, surrogates and the last plane
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
                if not low <= data[-k + 1] <= high:
                    return 0
            return k
        return 0

    def feed(self, tokens: Iterable[int]) -> str:
        data = self.rest + b"".join(map(self.bytes_of.__getitem__, tokens))
        k = self._open(data)
        self.rest = data[len(data) - k :]
        return data[: len(data) - k].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.rest = self.rest.decode("utf-8", "replace"), b""
        return out


class Tokenizer:
    """Pieces by pattern, tokens by transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = MAX_PIECES, max_states: int = MAX_STATES):
        self.transducer = BytePairTransducer(ranks, max_states)
        self.pieces = _Pieces(self.transducer, max_pieces)
        #: The decimal form of every identifier, for digests.
        self.decimal = {rank: str(rank) for rank in ranks.values()}
        self.findall = regex.compile(pattern).findall
        simple = narrow(pattern)
        self.findall_narrow = re.compile(simple).findall if simple else self.findall
        self.is_wide = re.compile(f"[^\x00-\\u{NARROW_TOP - 1:04x}]").search

    def _split(self, text: str | None) -> list[str]:
        text = text or ""
        return (self.findall if self.is_wide(text) else self.findall_narrow)(text)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self._split(text))))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """The tokens of every text, in their order; pieces of several texts are looked up together."""
        held: list[list[str]] = []
        chars = 0
        for text in texts:
            held.append(self._split(text))
            chars += len(text or "")
            if chars >= CHARS_TOGETHER:
                yield from self._joined(held)
                held, chars = [], 0
        yield from self._joined(held)

    def _joined(self, held: list[list[str]]) -> Iterator[list[int]]:
        known = self.pieces.of_all(set(chain.from_iterable(held)))
        for pieces in held:
            yield list(chain.from_iterable(map(known.__getitem__, pieces)))

    def decode(self, tokens: list[int], part: int = 1 << 16) -> str:
        decoder = StreamingDecoder(self.transducer.bytes_of)
        return "".join([decoder.feed(tokens[i : i + part]) for i in range(0, len(tokens), part)]) + decoder.finish()


#: The tokenizer that this Python worker has compiled, by broadcast.
_COMPILED: dict[tuple, Tokenizer] = {}


def _compiled(name: tuple, ranks: Callable[[], dict[bytes, int]]) -> Tokenizer:
    """The worker's own tokenizer of that name.

    Closures reach the workers by value and would bring a cache of their own to every task;
    this function is pickled by name, so what it keeps outlives a task.
    """
    if name not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[name] = Tokenizer(ranks(), *name[2:])
        # the compiled tables stay as long as the worker: the collector need not visit them
        gc.freeze()
    return _COMPILED[name]


def _tokenizer(docs: DataFrame, ranks_path: str, pattern: str, max_pieces: int = MAX_PIECES, max_states: int = MAX_STATES, keep: bool = False) -> Callable[[], Tokenizer]:
    """Read the ranks once on the driver; each task compiles them once, or with ``keep`` each Python worker.

    What a worker keeps stays in its memory beside whatever runs there next, such as a
    pipeline's first stages when it runs again.
    """
    ranks = read_ranks(ranks_path)
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)
    # a worker outlives the query, so a file that has changed since has another name
    digest = hashlib.sha256(b"".join(b"%d:%d:%b" % (rank, len(token), token) for token, rank in ranks.items())).hexdigest()
    name = (ranks_path, digest, pattern, max_pieces, max_states)
    if keep:
        return lambda: _compiled(name, lambda: shipped.value)

    def get() -> Tokenizer:
        own = Tokenizer(shipped.value, pattern, max_pieces, max_states)
        gc.freeze()
        return own

    return get


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids", verify_col: str | None = None, max_pieces: int = MAX_PIECES, max_states: int = MAX_STATES) -> DataFrame:
    """``docs`` with an array of token identifiers; a null text has none.

    Null and empty texts have an empty array; repeated rows each get theirs; columns of
    ``docs`` that have the name of a new one are replaced; an empty table stays empty.

    ``verify_col`` names a further column: whether decoding the identifiers gives the
    text back (a null text counts as empty).
    """
    docs = docs.drop(out_col, *([verify_col] if verify_col else []))
    tokenizer = _tokenizer(docs, ranks_path, pattern, max_pieces, max_states)
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields]).add(out_col, ArrayType(IntegerType()))
    if verify_col:
        schema = schema.add(verify_col, "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer()
        for whole in batches:
            # token lists are larger than texts, so batches go out in smaller parts
            for i in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(i, ROWS_OUT)
                texts = [t.as_py() or "" for t in batch.column(at)]
                ids = list(own.encode_all(texts))
                arrays = [*batch.columns, pa.array(ids, pa.list_(pa.int32()))]
                if verify_col:
                    arrays.append(pa.array([own.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of their token identifiers; null for null, U+FFFD for bytes that are no text.

    A column that has the name of the new one is replaced; an unknown identifier is an
    error; an empty table stays empty.
    """
    rows = rows.drop(out_col)
    tokenizer = _tokenizer(rows, ranks_path, ".")
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer()
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out_col])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add(out_col, "string"))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode the result, and return digests of both.

    Returns the identifier, n_tokens, ids_sha256 (of the decimal identifiers joined by one
    space) and decoded_sha256 (of the decoded bytes). Both run in one pass, so identifiers
    are not shipped between them. A null or empty text has no tokens and the digest of
    nothing; repeated rows count each; an empty table gives no rows.
    """
    tokenizer = _tokenizer(docs, ranks_path, pattern, keep=True)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer()
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for ids in own.encode_all(text.as_py() for text in batch.column(1)):
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(" ".join(map(own.decimal.__getitem__, ids)).encode()).hexdigest())
                out[2].append(hashlib.sha256(own.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
