"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

Encoding reads one byte at a time. The encoding of a prefix is fixed by its last token: a token may
follow another if the two, joined and merged by rank, come out as the same two, and a row of tokens
is the encoding just if each neighbouring pair may stand so. A state is the last token given out for
good and the bytes read since. After each byte, the places where a token still to come may begin are
those whose rest is a proper prefix of some token; what all their chains have in common can't change
any more and is emitted, so the lookahead is bounded by the longest token. States and transitions
are made when first needed and kept in bounded memos, shared by all rows of a worker.

Decoding carries a UTF-8 state (the bytes of an unfinished character) across tokens and chunks.

Documents are encoded FLUSH pieces at a time: the distinct ones go through the transducer, their ids
are laid out by numpy, and what is hashed are stretches of Arrow buffers. Work is per row: no shuffle;
a lost executor costs a task's rows.

Cases: null text is read as empty and gives no ids and empty bytes; repeated rows are encoded alike;
ties between merges go to the leftmost pair; an empty table gives an empty table; a very long text
passes through in stretches of FLUSH pieces, only its ids are held (where asked for); further columns
of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import pickle
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import hand_back, id_text, text_slices

#: Bound of the memos of states, of word pieces and (half as much again) of token pairs: about a
#: kilobyte each. Emptying a full one costs time but never changes a result.
MEMO = 400_000
CHUNK = 1 << 16
#: Pieces that are laid out at once, and bytes of text of the rows taken together for that.
FLUSH, SLICE = 1 << 18, 1 << 20


class Tables:
    """What the merges compile to: a trie of the tokens with suffix links, and the parts of each token.
    Nodes are numbered breadth first, the root is 0."""

    def __init__(self, vocabulary: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = [len(t) for t in self.tokens]
        self._grow()
        # the last merge that makes each token, and the tokens by their two parts
        self.left, self.right = list(range(len(self.tokens))), list(range(len(self.tokens)))
        self.joined: dict[int, int] = {}
        for token, rank in self.ranks.items():
            if len(token) > 1 and len(parts := self._merged(token, rank)) == 2:
                self.left[rank], self.right[rank] = parts
                self.joined[parts[0] << 24 | parts[1]] = rank

    def _grow(self) -> None:
        """child: by node * 256 + byte; fail: the node of the longest proper suffix; over: the tokens that
        end a node's string, longest first; live: the lengths of its suffixes that a token goes on from,
        as bits."""
        self.child: dict[int, int] = {}
        self.fail, self.over, self.live = [0], [()], [1]
        level = [(0, b"", sorted(self.ranks))]
        while level:
            below = []
            for node, prefix, tokens in level:
                depth = len(prefix)
                groups = groupby((t for t in tokens if len(t) > depth), lambda t: t[depth])
                for byte, some in [(k, list(g)) for k, g in groups]:
                    new = self.child[node << 8 | byte] = len(self.fail)
                    to = self.goto(self.fail[node], byte) if node else 0
                    spelt = prefix + bytes((byte,))
                    self.fail.append(to)
                    self.over.append(((self.ranks[spelt],) if spelt in self.ranks else ()) + self.over[to])
                    self.live.append(self.live[to] | (len(some[-1]) > depth + 1) << depth + 1)
                    below.append((new, spelt, some))
            level = below

    def goto(self, node: int, byte: int) -> int:
        while True:
            to = self.child.get(node << 8 | byte)
            if to is not None:
                return to
            if not node:
                return 0
            node = self.fail[node]

    def _merged(self, raw: bytes, below: int) -> list[int]:
        """raw merged by the tokens of a rank under `below`."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            costs = [self.ranks.get(a + b, below) for a, b in zip(parts, parts[1:], strict=False)]
            least = min(costs)
            if least >= below:
                break
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def seam_holds(self, a: int, b: int) -> bool:
        """Whether a and b come out as themselves where they meet: undoing their merges from the last
        one on, no two parts that touch at the seam would have merged before their own merges did."""
        made_a, made_b = 1 << 30, 1 << 30  # ranks of the merges that end the parts at the seam
        while True:
            rank = self.joined.get(a << 24 | b)
            # a merge at the seam wins against a later one on either side; of equal ones the leftmost does
            if rank is not None and rank < made_a and rank <= made_b:
                return False
            whole_a, whole_b = self.right[a] == a, self.left[b] == b
            if whole_a and whole_b:
                return True
            if whole_b or not whole_a and a > b:
                made_a, a = a, self.right[a]
            else:
                made_b, b = b, self.left[b]


class State:
    __slots__ = ("ends", "last", "next", "node", "pending", "tail")

    def __init__(self, last: int, pending: bytes, ends: tuple[int, ...], node: int):
        self.last, self.pending = last, pending
        self.ends = ends  # of each prefix of pending (from one byte on), the last token
        self.node = node  # the longest suffix read that a token begins with, so where tokens to come may begin
        self.next: dict[int, tuple[State, tuple[int, ...]]] = {}
        self.tail: tuple[int, ...] | None = None


class Transducer:
    def __init__(self, tables: Tables, memo: int = MEMO):
        self.tables, self.memo, self.sizes = tables, memo, tables.sizes
        self.pairs: dict[int, bool] = {}
        self.states: dict[tuple[int, bytes], State] = {}
        self._forget()

    def _forget(self) -> None:
        for state in self.states.values():  # states refer to one another: without this only the collector frees them
            state.next.clear()
        self.start = State(-1, b"", (), 0)
        self.states = {(-1, b""): self.start}

    def may_follow(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        key = a << 24 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.memo * 3 // 2:
                self.pairs.clear()
            known = self.pairs[key] = self.tables.seam_holds(a, b)
        return known

    def _step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        node, ends, sizes, pairs = self.tables.goto(state.node, byte), state.ends, self.sizes, self.pairs
        n = len(ends) + 1
        for token in self.tables.over[node]:
            j = n - sizes[token]
            if j >= 0:
                before = ends[j - 1] if j else state.last
                if pairs.get(before << 24 | token) or self.may_follow(before, token):
                    break
        ends = (*ends, token)
        # the places where a token may begin, as distances from the end: the nearest goes back to where
        # the token before it begins, until all agree
        places = self.tables.live[node]
        while (near := places & -places) != places:
            places = places ^ near | near << sizes[ends[n - near.bit_length()]]
        root = n + 1 - places.bit_length()
        out = self._chain(ends, root) if root else ()
        key = (out[-1] if out else state.last, (state.pending + bytes((byte,)))[root:])
        found = self.states.get(key)
        if found is None:
            if len(self.states) >= self.memo:
                self._forget()
            found = self.states[key] = State(key[0], key[1], ends[root:], node)
        state.next[byte] = found, out
        return found, out

    def _chain(self, ends: tuple[int, ...], at: int) -> tuple[int, ...]:
        out = []
        while at:
            out.append(ends[at - 1])
            at -= self.sizes[ends[at - 1]]
        return tuple(reversed(out))

    def encode(self, raw: bytes) -> tuple[int, ...]:
        """The ids of one piece."""
        state, out = self.start, []
        for byte in raw:
            moved = state.next.get(byte)
            state, ids = moved if moved is not None else self._step(state, byte)
            if ids:
                out.extend(ids)
        if state.tail is None:
            state.tail = self._chain(state.ends, len(state.pending))
        out.extend(state.tail)
        return tuple(out)


class Pieces(dict):
    """Piece to ids; short pieces are kept, in two generations of which the older one is dropped."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.transducer.encode(piece.encode())
        if len(piece) <= 32:
            if len(self) >= self.transducer.memo:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, tables: Tables, pattern: str, memo: int = MEMO):
        self.pieces = Pieces(Transducer(tables, memo))
        self.pattern = regex.compile(pattern)
        self.tables = tables
        self.tokens = tokens = tables.tokens
        self.said = pa.array([f" {i}".encode() for i in range(len(tokens))], pa.large_binary())
        self.spelt = pa.array(tokens, pa.large_binary())
        whole = [advance(b"", token) for token in tokens]
        self.texts = [text if not rest and text.encode() == token else None for (text, rest), token in zip(whole, tokens, strict=True)]
        self.whole = np.array([text is not None for text in self.texts])
        self.moves: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}

    def encode_stream(self, text: str) -> Iterator[list[int]]:
        """Lists of ids; their concatenation is the encoding of the whole text."""
        if len(text) <= CHUNK:
            yield list(chain.from_iterable(map(self.pieces.__getitem__, self.pattern.findall(text))))
            return
        matches = self.pattern.finditer(text)
        while some := [m.group() for m in islice(matches, CHUNK // 4)]:
            yield list(chain.from_iterable(map(self.pieces.__getitem__, some)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_stream(text)))

    def decode_stream(self, chunks: Iterable[list[int]]) -> Iterator[str]:
        """Texts whose concatenation is the decoded text; a character may span tokens and chunks."""
        state = b""
        for ids in chunks:
            if not state:  # most tokens are whole characters
                out = [self.texts[i] for i in ids]
                if None not in out:
                    yield "".join(out)
                    continue
            out = []
            table = self.moves.setdefault(state, {})
            for i in ids:
                moved = table.get(i)
                if moved is None:
                    moved = table[i] = advance(state, self.tokens[i])
                if moved[1] != state:
                    state = moved[1]
                    table = self.moves.setdefault(state, {})
                out.append(moved[0])
            yield "".join(out)
        if state:
            yield "�"

    def decode(self, ids: list[int]) -> str:
        return "".join(self.decode_stream([ids]))


def advance(pending: bytes, raw: bytes) -> tuple[str, bytes]:
    """The UTF-8 state machine: from the bytes of an unfinished character, over raw; gives the
    finished characters (one U+FFFD for each broken sequence) and the new unfinished bytes."""
    out = []
    for byte in raw:
        if pending:
            if _low(pending) <= byte <= _high(pending):
                pending += bytes((byte,))
                if len(pending) == _width(pending[0]):
                    out.append(pending.decode())
                    pending = b""
                continue
            out.append("�")
            pending = b""
        if byte < 0x80:
            out.append(chr(byte))
        elif _width(byte):
            pending = bytes((byte,))
        else:
            out.append("�")
    return "".join(out), pending


def _width(lead: int) -> int:
    return 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0


def _low(pending: bytes) -> int:
    return {b"\xe0": 0xA0, b"\xf0": 0x90}.get(pending, 0x80)


def _high(pending: bytes) -> int:
    return {b"\xed": 0x9F, b"\xf4": 0x8F}.get(pending, 0xBF)


def codec(tables: Tables, pattern: str, memo: int) -> Codec:
    """The codec of a worker, made anew for other settings; its tasks share the memos. It is kept with the
    tables, so both go when a task of another query finds their broadcast over."""
    known = getattr(tables, "codec", None)
    if known is None or (known.pattern.pattern, known.pieces.transducer.memo) != (pattern, memo):
        known = tables.codec = Codec(tables, pattern, memo)
    return known


class Row:
    """What is gathered of one document: how many ids, the digests, and the ids themselves if asked for."""

    __slots__ = ("ids", "n", "said", "text")

    def __init__(self):
        self.n, self.said, self.text, self.ids = 0, hashlib.sha256(), hashlib.sha256(), []


def _encoded(c: Codec, part: pa.RecordBatch, with_ids: bool) -> pa.RecordBatch:
    rows = [Row() for _ in range(part.num_rows)]
    pieces: list[str] = []
    segments: list[tuple[Row, int]] = []
    for row, text in zip(rows, part.column("text").to_pylist(), strict=True):
        matches = [c.pattern.findall(text)] if len(text) <= SLICE else _stretches(c.pattern.finditer(text))
        for found in matches:
            pieces += found
            segments.append((row, len(found)))
            if len(pieces) >= FLUSH:
                _lay_out(c, pieces, segments, with_ids)
                pieces, segments = [], []
    _lay_out(c, pieces, segments, with_ids)
    columns = [part.column("doc_id"), pa.array([r.n for r in rows], pa.int64()), pa.array([r.said.hexdigest() for r in rows]), pa.array([r.text.hexdigest() for r in rows])]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if with_ids:
        ids = [x for r in rows for x in r.ids]
        flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
        columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[r.n for r in rows]]), pa.int32()), flat))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names=names)


def _stretches(matches: Iterator[regex.Match]) -> Iterator[list[str]]:
    while some := [m.group() for m in islice(matches, FLUSH)]:
        yield some


def _lay_out(c: Codec, pieces: list[str], segments: list[tuple[Row, int]], with_ids: bool) -> None:
    """Adds the ids of the pieces to the rows whose segments they are; each distinct piece is encoded once."""
    if not pieces:
        return
    coded = pa.array(pieces, pa.string()).dictionary_encode()
    known = [c.pieces[p] for p in coded.dictionary.to_pylist()]
    which = coded.indices.to_numpy()
    size = np.fromiter(map(len, known), np.int64, len(known))
    flat = np.fromiter(chain.from_iterable(known), np.int32, int(size.sum()))
    first, n = np.cumsum(size) - size, size[which]
    ends = np.cumsum(n)
    ids = flat[np.repeat(first[which] - ends + n, n) + np.arange(ends[-1])]
    said, said_at = _joined(c.said, ids)
    text, text_at = _joined(c.spelt, ids)
    odd = np.flatnonzero(~c.whole[ids])
    cut = np.concatenate(([0], ends))[np.cumsum([0, *[k for _, k in segments]])].tolist()
    for (row, _), a, b in zip(segments, cut, cut[1:], strict=False):
        if a < b:
            row.said.update(said[said_at[a] + (not row.n) : said_at[b]])  # no blank before the first
            at = text_at[a]
            for lo, hi in _unfinished(odd, a, b):
                row.text.update(text[at : text_at[lo]])
                row.text.update(c.decode(ids[lo:hi].tolist()).encode())
                at = text_at[hi]
            row.text.update(text[at : text_at[b]])
            row.n += b - a
            if with_ids:
                row.ids.append(ids[a:b])


def _joined(names: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The names of all ids on end, and where each begins."""
    out = names.take(pa.array(ids))
    return memoryview(out.buffers()[2] or b""), np.frombuffer(out.buffers()[1], np.int64, len(out) + 1, out.offset * 8)


def _unfinished(odd: np.ndarray, a: int, b: int) -> list[tuple[int, int]]:
    """The stretches from a to b of ids that don't spell whole characters: the state machine goes over
    them, as it does nothing but copy where a character ends with each token."""
    mine = odd[np.searchsorted(odd, a) : np.searchsorted(odd, b)]
    if not len(mine):
        return []
    new = np.flatnonzero(np.diff(mine) > 1) + 1
    return list(zip(mine[np.append(0, new)].tolist(), (mine[np.append(new - 1, -1)] + 1).tolist(), strict=True))


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = True, memo: int = MEMO, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, unless left out, the ids themselves. `memo`
    bounds what a worker keeps; smaller ones suit executors whose memory other operators share. Without
    `keep` tables and memos go with each task: idle workers, of which an executor may have more than
    cores, then hold four megabytes of packed tables."""
    with open(path, "rb") as f:  # a fixed vocabulary of the installation, under a megabyte
        tables = Tables(f.read())
    shared = docs.sparkSession.sparkContext.broadcast(tables if keep else pickle.dumps(tables, pickle.HIGHEST_PROTOCOL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern, memo) if keep else Codec(pickle.loads(shared.value), pattern, memo)
        gc.disable()  # states are many and freed by hand: going over them again and again takes a quarter of the time
        try:
            for batch in batches:
                for part, _, _ in text_slices(batch, SLICE):
                    yield _encoded(c, part, with_ids)
        finally:
            gc.enable()
        del c
        hand_back()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return id_text(docs).mapInArrow(run, schema)


def op5_byte_bpe(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
