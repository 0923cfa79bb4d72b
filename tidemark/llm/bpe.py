"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding.

Method. A sequence of tokens is the byte-pair encoding of its bytes exactly when every token is its
own encoding and every two neighbours encode to themselves. A non-deterministic transducer therefore
guesses where each token starts, walks the token trie, and keeps a guess only if the token fits its
left neighbour. At every byte just one guess ends in a complete encoding, so the guesses alive are
bounded by the longest token. Subset construction is done lazily: a state is the set of live guesses;
states and transitions are memoised as they are met. A token is emitted once all chains of live
guesses share it, which takes a lookahead of the longest token at most. Whether two tokens may stand
together is decided by undoing their merges, once for each pair met.

Decoding is a table look-up followed by an incremental UTF-8 state machine, so ids can arrive in
chunks that cut a character; encode_documents digests what this decoder makes of its ids.

Nulls and empty texts encode to no token; an empty table gives an empty one. The vocabulary is a parameter (a file path); its size, not
the data's, bounds what is broadcast.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, map_batches, rows_of

#: Memoised pieces, and transducer states; beyond it a memo is cleared and built again.
MEMO, STATES = 120_000, 200_000


def ranks_of(raw: bytes) -> dict[bytes, int]:
    """Content of a .tiktoken file: base64 token and rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return ranks_of(f.read())


class Transducer:
    """Bytes to ids.

    A guess is (token to its left, trie node), packed into one integer; a state is the tuple of live
    guesses. Reading a byte moves to another state and says which token the encoding of the bytes so
    far ends in.
    """

    NONE = (1 << 24) - 1  # no token to the left

    def __init__(self, ranks: dict[bytes, int]):
        if max(sum(map(len, ranks)), max(ranks.values(), default=0)) >= self.NONE:  # of nodes and ranks, 24 bits each
            raise ValueError(f"a vocabulary of {self.NONE} bytes or ranks and more isn't supported")
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.pairs: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.own: dict[int, bool] = {}
        #: trie: node << 8 | byte -> node; node 0 is the root
        self.next: dict[int, int] = {}
        self.ends: list[int] = [-1]
        self.inner: list[bool] = [True]
        for t, i in ranks.items():
            node = 0
            for b in t:
                to = self.next.get(node << 8 | b)
                if to is None:
                    to = self.next[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                    self.inner[node] = True
                    self.inner.append(False)
                node = to
            self.ends[node] = i
        self.clear()

    def clear(self) -> None:
        start = (self.NONE << 24,)
        self.ids = {start: 0}
        self.states = [start]
        #: token in which the encoding ends, by state
        self.last_of = [-1]
        #: state << 8 | byte -> state
        self.moves: dict[int, int] = {}

    def merge(self, raw: bytes, parts_wanted: int = 1) -> list[int]:
        """The merges themselves: the neighbours of lowest rank join first, the leftmost at ties."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        ranks = self.ranks
        while len(parts) > parts_wanted:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def is_own(self, t: int) -> bool:
        found = self.own.get(t)
        if found is None:
            found = self.own[t] = self.merge(self.token[t]) == [t]
        return found

    def halves(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes t last; None for a single byte."""
        found = self.split.get(t, 0)
        if found == 0:
            parts = self.merge(self.token[t], 2)
            found = self.split[t] = (parts[0], parts[1]) if len(parts) == 2 else None
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' bytes is the two tokens.

        The merges are undone from the border outwards, the latest first: the border holds unless at
        some moment the two parts that touch it would have merged before the next merge undone.
        """
        key = a << 24 | b
        found = self.pairs.get(key)
        if found is None:
            found = self.pairs[key] = self._fits(a, b)
            if len(self.pairs) > 4 * STATES:
                self.pairs.clear()
        return found

    def _fits(self, a: int, b: int) -> bool:
        limit, token, ranks = 1 << 60, self.token, self.ranks
        while True:
            joined = ranks.get(token[a] + token[b])
            if joined is not None and joined < limit:
                return False
            left, right = self.halves(a), self.halves(b)
            if left is None and right is None:
                return True
            if right is None or (left is not None and a > b):
                limit, a = a, left[1]  # at equal rank the leftmost merge comes first
            else:
                limit, b = b + 1, right[0]

    def step(self, state: int, byte: int) -> int:
        """Next state, of a transition that isn't known yet."""
        new, last, none = [], -1, self.NONE
        next_of, inner, ends, pairs = self.next, self.inner, self.ends, self.pairs
        for guess in self.states[state]:
            to = next_of.get((guess & none) << 8 | byte)
            if to is None:
                continue
            left = guess >> 24
            if inner[to]:
                new.append(left << 24 | to)
            if last < 0:
                t = ends[to]
                if t >= 0:
                    if not self.is_own(t):
                        ends[to] = -1  # never a token of an encoding
                    elif left == none:
                        last = t
                    else:
                        fits = pairs.get(left << 24 | t)
                        if self.fits(left, t) if fits is None else fits:
                            last = t
        if last < 0:
            raise ValueError("a byte without a token of its own")
        new.append(last << 24)
        key = tuple(new)
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
            self.last_of.append(last)
        self.moves[state << 8 | byte] = to
        return to

    def encode(self, raw: bytes) -> tuple[int, ...]:
        """Ids of one piece. A piece that is itself in the vocabulary is that token; a long one is streamed."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return (whole,)
        if len(raw) > 64 * self.longest:
            return tuple(self.stream(raw))
        if len(self.states) > STATES:
            self.clear()
        state, moves, last_of, length = 0, self.moves, self.last_of, self.length
        passed = []
        for byte in raw:
            to = moves.get(state << 8 | byte)
            state = self.step(state, byte) if to is None else to
            passed.append(state)
        out, at = [], len(passed)
        while at:
            t = last_of[passed[at - 1]]
            out.append(t)
            at -= length[t]
        out.reverse()
        return tuple(out)

    def stream(self, raw: Iterable[int]) -> Iterator[int]:
        """Ids of a piece, each as soon as no later byte can change it.

        Live guesses start within the longest token's length, so what their chains share is final.
        """
        if len(self.states) > STATES:
            self.clear()
        lasts: list[int] = []
        state, moves, room = 0, self.moves, 64 * self.longest
        for byte in raw:
            to = moves.get(state << 8 | byte)
            state = self.step(state, byte) if to is None else to
            lasts.append(self.last_of[state])
            if len(lasts) > room:
                at = self.settled(lasts)
                yield from self.chain(lasts[:at])
                del lasts[:at]
        yield from self.chain(lasts)

    def settled(self, lasts: list[int]) -> int:
        """The greatest place at which the chains of all places that may yet be a start meet."""
        low = {len(lasts) - k for k in range(self.longest + 1)}
        while len(low) > 1:
            top = max(low)
            low.remove(top)
            low.add(top - self.length[lasts[top - 1]])
        return low.pop()

    def chain(self, lasts: list[int]) -> list[int]:
        out, at, length = [], len(lasts), self.length
        while at:
            t = lasts[at - 1]
            out.append(t)
            at -= length[t]
        out.reverse()
        return out


class Encoder:
    """Texts to ids: split by a pattern, then the transducer on each piece, with a bounded memo."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.machine = Transducer(ranks)
        self.decimal = {i: str(i) for i in ranks.values()}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo = self.memo
        pieces = self.split(text)
        found = list(map(memo.get, pieces))
        if not all(found):  # a piece's ids are never none
            encode, old = self.machine.encode, self.old
            for k in [k for k, ids in enumerate(found) if ids is None]:
                piece = pieces[k]
                ids = memo.get(piece)
                if ids is None:
                    ids = old.get(piece) or encode(piece.encode())
                    if len(piece) <= 64:  # a long piece hardly comes again
                        memo[piece] = ids
                found[k] = ids
            if len(memo) > MEMO:
                self.old, self.memo = memo, {}
        return list(chain.from_iterable(found))


#: Byte -> (bytes still wanted, least and greatest next byte); others are not a first byte.
def _first(byte: int) -> tuple[int, int, int] | None:
    if byte < 0x80:
        return 0, 0, 0
    if 0xC2 <= byte < 0xE0:
        return 1, 0x80, 0xBF
    if 0xE0 <= byte < 0xF0:
        return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
    if 0xF0 <= byte < 0xF5:
        return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
    return None


FIRST = [_first(b) for b in range(256)]


class Utf8:
    """Incremental UTF-8: feed() returns the text that is complete; close() what was cut off.

    Only the tail of a chunk, 3 bytes at most, goes through the state machine byte by byte; what is
    before it ends on a character and is decoded at once. Bad bytes become U+FFFD.
    """

    def __init__(self) -> None:
        self.tail = b""

    @staticmethod
    def _open(raw: bytes) -> int:
        """Bytes at the end that begin a character which is not complete."""
        for back in range(1, min(3, len(raw)) + 1):
            byte = raw[-back]
            if byte & 0xC0 == 0x80:
                continue
            first = FIRST[byte]
            if first is None or first[0] < back:
                return 0
            if back > 1 and not first[1] <= raw[-back + 1] <= first[2]:
                return 0
            return back
        return 0

    def feed(self, raw: bytes) -> str:
        raw = self.tail + raw
        n = self._open(raw)
        self.tail = raw[len(raw) - n :] if n else b""
        return (raw[:-n] if n else raw).decode("utf-8", "replace")

    def close(self) -> str:
        out, self.tail = self.tail.decode("utf-8", "replace"), b""
        return out


def decode_stream(chunks: Iterable[Iterable[int]], token: dict[int, bytes]) -> Iterator[str]:
    """Texts of chunks of ids, whole characters only."""
    machine = Utf8()
    for ids in chunks:
        yield machine.feed(b"".join(map(token.__getitem__, ids)))
    yield machine.close()


#: Ids that are decoded at once.
CHUNK = 8192


def decoded_digest(ids: list[int], token: dict[int, bytes]) -> str:
    """SHA-256 of the text that ids stand for, decoded chunk by chunk."""
    digest = hashlib.sha256()
    for part in decode_stream((ids[at : at + CHUNK] for at in range(0, len(ids), CHUNK)), token):
        digest.update(part.encode())
    return digest.hexdigest()


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of encoded (doc_id, token_ids); a null list is a null text, bytes that are no UTF-8 become U+FFFD.

    One pass without a shuffle; an id that the vocabulary lacks is an error.
    """
    with open(vocabulary, "rb") as f:
        raw = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        token = kept(("tokens", hashlib.sha256(raw.value).digest()), lambda: {i: t for t, i in ranks_of(raw.value).items()})
        chunks = lambda ids: (ids[at : at + CHUNK] for at in range(0, len(ids), CHUNK))
        texts = [None if ids is None else "".join(decode_stream(chunks(ids), token)) for ids in rows_of(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    narrow = encoded.selectExpr("cast(doc_id as bigint) doc_id", "cast(token_ids as array<int>) token_ids")
    return map_batches(narrow, run, "doc_id bigint, text string")


def encoder_of(raw: bytes, pattern: str) -> Encoder:
    """Encoder for a rank file's content; kept by a worker."""

    return kept(("encoder", hashlib.sha256(raw).digest(), pattern), lambda: Encoder(ranks_of(raw), pattern))


ENCODED = "doc_id bigint, token_ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_documents(
    docs: DataFrame, vocabulary: str, pattern: str, keep_ids: bool = True, digests: bool = True
) -> DataFrame:
    """doc_id, token_ids, n_tokens, and digests of the ids and of what they decode to.

    One pass without a shuffle. vocabulary is the path of a rank file, read on the driver and sent
    with the task (under 1 MB for 50,000 tokens, whatever the data's size). keep_ids=False leaves
    token_ids null, digests=False the two digests. A null or empty text has no token; extra columns
    of docs are ignored; repeated rows are encoded each for itself.
    """
    with open(vocabulary, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = encoder_of(raw.value, pattern)
        decimal, token = encoder.decimal.__getitem__, encoder.machine.token
        lists_of, counts, ids_sha, text_sha = [], [], [], []
        for text in rows_of(batch.column(1)):
            ids = encoder.encode(text)
            counts.append(len(ids))
            if keep_ids:
                lists_of.append(pa.array(ids, pa.int32()))
            if digests:
                ids_sha.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                text_sha.append(decoded_digest(ids, token))
        none = pa.nulls(batch.num_rows, pa.string())
        if keep_ids:
            offsets = [0]
            for n in counts:
                offsets.append(offsets[-1] + n)
            flat = pa.concat_arrays(lists_of) if lists_of else pa.array([], pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
        else:
            lists = pa.nulls(batch.num_rows, pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                lists,
                pa.array(counts, pa.int64()),
                pa.array(ids_sha, pa.string()) if digests else none,
                pa.array(text_sha, pa.string()) if digests else none,
            ],
            names=["doc_id", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    narrow = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return map_batches(narrow, run, ENCODED)
