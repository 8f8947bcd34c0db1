"""Operator 12: byte-level BPE by a lazily determinised transducer, and streaming decoding by a UTF-8 state machine."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import worker_cache


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ids of a rank file: a line a token, its bytes in base64 and its id."""
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))}


class _State:
    """A set of readings of the bytes so far: (last token, trie node of the bytes after it, tokens not emitted yet)."""

    __slots__ = ("readings", "rest", "arcs")

    def __init__(self, readings: tuple):
        self.readings = readings
        self.rest = readings[-1][2]  # the reading that ends here: what is still to emit at the end of input
        self.arcs: dict[int, tuple] = {}


class Transducer:
    """Merges compiled to a finite-state transducer from bytes to token ids.

    A sequence of tokens is the BPE encoding of its bytes exactly if merging the bytes of each two
    neighbours gives these two tokens again, so the encoding of every prefix is known from its last token
    and the bytes before that.  Reading nondeterministically, a state guesses how far the next token
    reaches in a trie of all tokens; a token may follow another if the two are such neighbours.  Every prefix has one encoding,
    so a set of states holds one reading for each place of the last few bytes where a token may have
    ended: no more than the longest token has bytes.  Sets are made when first met, with the tokens on
    which all readings agree as the output of the arc; the rest waits in the readings until other bytes
    rule all but one out.  most_states bounds the sets and pairs kept at a time: beyond it they are made anew.
    """

    def __init__(self, ranks: dict[bytes, int], most_states: int = 300_000):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for byte {missing[0]}")
        self.ranks, self.most_states = ranks, most_states
        self.spelling = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for spelled, i in ranks.items():
            node = 0
            for byte in spelled:
                key = node << 8 | byte
                at = self.child.get(key)
                if at is None:
                    at = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner[node] = True
                    self.inner.append(False)
                node = at
            self.token[node] = i
        self.edges = {i: self.unfolded(spelled, i) for spelled, i in ranks.items()}
        self.forget()

    def forget(self) -> None:
        for state in getattr(self, "states", {}).values():
            state.arcs.clear()  # arcs lead in circles
        start = (-1, 0, ())
        self.start = _State((start,))
        self.states = {self.start.readings: self.start}
        self.pairs: dict[int, bool] = {}

    def merged(self, spelled: bytes, steps: list | None = None) -> list[int]:
        """Ids after merging neighbours, the lowest id first and of equal ones the leftmost, until no two form a token.

        steps collects the id of each merge, with the first and last part as they were before it.
        """
        ranks = self.ranks
        parts = [spelled[k : k + 1] for k in range(len(spelled))]
        ids = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            known = [i for i in ids if i is not None]
            if not known:
                return [ranks[p] for p in parts]
            low = min(known)
            if steps is not None:
                steps.append((low, parts[0], parts[-1]))
            at = ids.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ids[at]
            if at < len(ids):
                ids[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                ids[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def unfolded(self, spelled: bytes, i: int) -> tuple[list, list]:
        """What a token begins and ends with while its bytes merge: (part, id of the merge that takes it in) each."""
        steps: list = []
        never = 1 << 62
        if self.merged(spelled, steps) != [i]:
            raise ValueError(f"no merges lead to token {i}")
        if any(a[0] > b[0] for a, b in zip(steps, steps[1:])):
            raise ValueError(f"token {i} has a part with a higher id")
        heads, tails = [(spelled, never)], [(spelled, never)]
        for low, head, tail in reversed(steps):
            if head != heads[-1][0]:
                heads.append((head, low))
            if tail != tails[-1][0]:
                tails.append((tail, low))
        return heads[::-1], tails[::-1]

    def neighbours(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives both again: no merge crosses from one to the other.

        Merges go by rising id, so a part that left ends with and one that right begins with lie side by
        side until the lower of the ids that take them in; of equal ids the leftmost merge is first.
        """
        known = self.pairs.get(left << 32 | right)
        if known is None:
            heads, tails = self.edges[right][0], self.edges[left][1]
            h = t = 0
            known = True
            while True:
                (tail, tail_end), (head, head_end) = tails[t], heads[h]
                crossing = self.ranks.get(tail + head)
                if crossing is not None and crossing < tail_end and crossing <= head_end:
                    known = False
                    break
                if t + 1 == len(tails) and h + 1 == len(heads):
                    break
                if tail_end <= head_end:
                    t += 1
                    h += tail_end == head_end
                else:
                    h += 1
            self.pairs[left << 32 | right] = known
        return known

    def arc(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        """The next set of readings after byte, and the tokens that are sure by then."""
        going, ended = [], None
        for last, node, waiting in state.readings:
            at = self.child.get(node << 8 | byte)
            if at is None:
                continue
            token = self.token[at]
            if ended is None and token >= 0 and (last < 0 or self.neighbours(last, token)):
                ended = (token, 0, (*waiting, token))
            if self.inner[at]:
                going.append((last, at, waiting))
        going.append(ended)
        first, sure = going[0][2], 0  # the reading with the longest open token, so the fewest tokens
        while sure < len(first):
            token = first[sure]
            for reading in going:
                if len(reading[2]) <= sure or reading[2][sure] != token:
                    break
            else:
                sure += 1
                continue
            break
        readings = tuple((last, at, waiting[sure:]) for last, at, waiting in going) if sure else tuple(going)
        found = self.states.get(readings)
        if found is None:
            found = self.states[readings] = _State(readings)
        state.arcs[byte] = out = (found, first[:sure])
        return out

    def encode(self, spelled: bytes) -> list[int]:
        """Ids of one stretch of bytes, in one pass over it."""
        if len(self.states) > self.most_states:
            self.forget()
        if len(self.pairs) > 2 * self.most_states:
            self.pairs.clear()
        state, out = self.start, []
        for byte in spelled:
            arc = state.arcs.get(byte)
            state, sure = arc if arc is not None else self.arc(state, byte)
            if sure:
                out += sure
            if len(self.states) > 2 * self.most_states:  # one very long stretch: keep where it stands, drop the rest
                self.forget()
                state = self.states.setdefault(state.readings, _State(state.readings))
        out += state.rest
        return out


class TextEncoder:
    """Ids of whole texts: each match of the pattern goes through the transducer by itself.

    Stretches of up to 64 bytes that were read before are looked up; when most_known are kept, those not met
    since the last time go.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_known: int = 400_000):
        import regex

        self.split, self.transducer = regex.compile(pattern), Transducer(ranks)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most_known = most_known

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit words."""
        from itertools import batched

        if len(text) <= 1 << 20:
            return self._read(self.split.findall(text))
        parts = batched((m.group() for m in self.split.finditer(text)), 1 << 16)  # a very long text by parts
        return b"".join(map(self._read, parts))

    def _read(self, pieces) -> bytes:
        found = list(map(self.known.get, pieces))
        for at in [k for k, ids in enumerate(found) if ids is None]:
            found[at] = self.known.get(pieces[at]) or self._new(pieces[at])
        return b"".join(found)

    def _new(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = b"".join([i.to_bytes(4, "little") for i in self.transducer.encode(piece.encode())])
        if len(piece) <= 64:
            if len(self.known) >= self.most_known // 2:
                self.known, self.older = {}, self.known
            self.known[piece] = found
        return found


# What UTF-8 allows (fixed values of the encoding): (lowest lead, highest lead, lowest and highest second byte, bytes after it).
_LEADS = [(0xC2, 0xDF, 0x80, 0xBF, 0), (0xE0, 0xE0, 0xA0, 0xBF, 1), (0xE1, 0xEC, 0x80, 0xBF, 1), (0xED, 0xED, 0x80, 0x9F, 1), (0xEE, 0xEF, 0x80, 0xBF, 1), (0xF0, 0xF0, 0x90, 0xBF, 2), (0xF1, 0xF3, 0x80, 0xBF, 2), (0xF4, 0xF4, 0x80, 0x8F, 2)]
WHOLE = (0, 0, 0)  # the state between characters; any other is (lowest, highest next byte, bytes after it)
_BROKEN = "�".encode()


def utf8_step(state: tuple, byte: int) -> tuple | None:
    """The state after byte, or None where UTF-8 does not allow it."""
    low, high, more = state
    if state == WHOLE:
        if byte < 0x80:
            return WHOLE
        return next(((a, b, n) for first, last, a, b, n in _LEADS if first <= byte <= last), None)
    if not low <= byte <= high:
        return None
    return (0x80, 0xBF, more - 1) if more else WHOLE


class StreamDecoder:
    """Text of a stream of ids, whole characters as soon as their bytes are there.

    The state machine of UTF-8 runs over tokens: what a token does in a state is worked out when first met.
    Bytes that are no UTF-8 become U+FFFD, one for each longest beginning of a character.
    """

    def __init__(self, spelling: dict[int, bytes]):
        import numpy as np

        self.spelling = spelling
        self.alone = np.zeros(max(spelling, default=-1) + 1, bool)  # tokens of whole characters: between characters they change no state
        self.bytes = np.zeros(len(self.alone), object)
        for token, spelled in spelling.items():
            self.bytes[token] = spelled
            try:
                self.alone[token] = bool(spelled.decode()) or not spelled
            except UnicodeDecodeError:
                pass
        self.steps: dict[tuple, dict[int, tuple]] = {}
        self.state, self.held = WHOLE, b""

    def step(self, state: tuple, token: int) -> tuple[tuple, bool | None, bytes, bytes]:
        """(state after, what becomes of the held bytes: joined (True), replaced (False), still held (None); bytes to give out; bytes to hold)."""
        fate, out, held, now = (True if state == WHOLE else None), bytearray(), bytearray(), state
        for byte in self.spelling[token]:
            after = utf8_step(now, byte)
            if after is None:
                if now != WHOLE:
                    out += _BROKEN if fate is not None else b""
                    fate = False if fate is None else fate
                    held.clear()
                    after = utf8_step(WHOLE, byte)
                if after is None:
                    out += _BROKEN
                    now = WHOLE
                    continue
            now = after
            held.append(byte)
            if now == WHOLE:
                fate = True if fate is None else fate
                out += held
                held.clear()
        found = self.steps.setdefault(state, {})[token] = (now, fate, bytes(out), bytes(held))
        return found

    def feed(self, ids: Iterable[int]) -> bytes:
        """The characters, in UTF-8, that these ids complete."""
        import numpy as np

        ids = np.asarray(ids, np.int64)
        known = (ids >= 0) & (ids < len(self.alone))
        parts = np.nonzero(~(known & self.alone[np.where(known, ids, 0)]))[0].tolist() if len(self.alone) else range(len(ids))
        out: list[bytes] = []
        at = 0
        for part in [*parts, len(ids)]:
            if at < part and self.held:  # what is held turns out to be cut short, or not, by the next token
                out.append(self._one(int(ids[at])))
                at += 1
            if at < part:
                out.append(b"".join(self.bytes[ids[at:part]]))
            if part < len(ids):
                out.append(self._one(int(ids[part])))
            at = part + 1
        return b"".join(out)

    def _one(self, token: int) -> bytes:
        known = self.steps.get(self.state, {}).get(token) or self.step(self.state, token)
        self.state, fate, given, held = known
        if fate is None:
            self.held += held
            return b""
        out = (self.held if fate else _BROKEN) + given if self.held else given
        self.held = held
        return out

    def finish(self) -> bytes:
        """What is left at the end of the stream: U+FFFD for a character cut short."""
        left, self.state, self.held = self.held, WHOLE, b""
        return _BROKEN if left else b""


def _files(ranks: str | None, pattern: str | None) -> tuple[str, str]:
    if ranks and pattern:
        return ranks, pattern
    import public_tokenizers

    return ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, text: str = "text", out: str = "ids", ranks: str | None = None, pattern: str | None = None, packed: bool = False) -> DataFrame:
    """docs with the ids of each whole text in place of the text, in a last column.

    ranks: a rank file's place on the executors, pattern: what is encoded separately; by default the public
    multilingual vocabulary and its pattern.  packed: ids as little-endian unsigned 32-bit words in one
    binary value, instead of an array of int.

    Null and empty texts have no ids; bytes that are no UTF-8 count as U+FFFD; rows are never changed in
    number, so repeated rows and null ids stay; other columns are kept, and one named like out is
    replaced.  An empty table gives an empty result.
    """
    plain, schema, run = _encoding(docs, text, out, ranks, pattern, packed)
    return plain.mapInArrow(run, schema)


def _encoding(docs: DataFrame, text: str, out: str, ranks: str | None, pattern: str | None, packed: bool):
    """What encode() runs on: the rows with the text first, the schema and the function over batches."""
    import pyarrow as pa

    kept = [f for f in docs.schema if f.name not in (text, out)]
    schema = T.StructType([*kept, T.StructField(out, T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        import numpy as np

        gc.set_threshold(200_000, 20, 100)  # states are many, long-lived and freed by forget()
        places = _files(ranks, pattern)
        encoder = worker_cache("bpe_encoder", str(places), lambda: TextEncoder(read_ranks(places[0]), places[1]))
        names = [f.name for f in schema]
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                piece = batch.slice(k, 256)
                found = [encoder.packed(t.as_py() or "") for t in piece.column(0)]
                if packed:
                    ids = pa.array(found, pa.binary())
                else:
                    ends = np.cumsum([0, *(len(f) // 4 for f in found)])
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*piece.columns[1:], ids], names=names)

    valid = F.make_valid_utf8(F.col(f"`{text}`").cast("string")).alias("_text")
    return docs.select(valid, *[F.col(f"`{f.name}`") for f in kept]), schema, run


def decode(encoded: DataFrame, ids: str = "ids", out: str = "decoded", ranks: str | None = None) -> DataFrame:
    """encoded with the text of its ids (array of int, or packed) in a last column.

    Null ids give an empty text; bytes that are no UTF-8 become U+FFFD; an id without a token raises.
    """
    schema, run = _decoding(encoded.schema, ids, out, ranks)
    return encoded.select(*[F.col(f"`{f.name}`") for f in encoded.schema if f.name != out]).mapInArrow(run, schema)


def round_trip(docs: DataFrame, text: str = "text", ids: str = "ids", out: str = "decoded", ranks: str | None = None, pattern: str | None = None, packed: bool = False) -> DataFrame:
    """decode(encode(docs)), batch by batch in one worker."""
    plain, schema, first = _encoding(docs, text, ids, ranks, pattern, packed)
    schema, then = _decoding(T.StructType([f for f in schema if f.name != out]), ids, out, ranks)
    if out in plain.columns[1:]:
        return decode(encode(docs, text, ids, ranks, pattern, packed), ids, out, ranks)
    return plain.mapInArrow(lambda batches: then(first(batches)), schema)


def _decoding(given: T.StructType, ids: str, out: str, ranks: str | None):
    """What decode() runs: the schema and the function over batches."""
    import pyarrow as pa

    kept = [f for f in given if f.name != out]
    at = [f.name for f in kept].index(ids)
    packed = isinstance(kept[at].dataType, T.BinaryType)
    schema = T.StructType([*kept, T.StructField(out, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        place = _files(ranks, "-")[0]
        decoder = worker_cache("bpe_decoder", place, lambda: StreamDecoder({i: t for t, i in read_ranks(place).items()}))
        names = [f.name for f in schema]
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                piece = batch.slice(k, 256)
                texts = []
                for value in piece.column(at):
                    words = (np.frombuffer(value.as_py() or b"", "<u4") if packed else value.values.to_numpy() if value.is_valid else np.empty(0))
                    texts.append(decoder.feed(words) + decoder.finish())
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=names)

    return schema, run
