"""Byte-level BPE as a lazily determinised transducer, and streaming decoding."""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from bisect import bisect_left
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from vektorloom.llm.common import kept, map_rows

#: States of the transducer, moves that they are made of (100 to 200 bytes each; a state takes 500), and chunks of text
#: that a Python worker remembers; it starts anew beyond.
MOST_STATES = 180_000
MOST_MOVES = 700_000
MOST_CHUNKS = 400_000

#: The move of an open token that neither goes on nor ends with a byte.
DEAD = (-1, -1, -1)

#: Bytes after which the tokens that are certain are emitted.
WINDOW = 1_024


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids from a rank file (base64 and number per line)."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


class Merges:
    """The merge rules of a rank table: which tokens a piece is merged to, and which two tokens stay apart."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.edges: dict[tuple[bytes, bool], tuple] = {}
        #: per token the ranks of the merges in which it is the left part, in order
        self.across: dict[bytes, list[int]] = {}
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            for cut in range(1, len(token)):
                if token[:cut] in ranks and token[cut:] in ranks:
                    self.across.setdefault(token[:cut], []).append(rank)

    def apply(self, piece: bytes, below: int = 1 << 40) -> list[bytes]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            joined = [self.ranks.get(a + b, below) for a, b in zip(parts, parts[1:])]
            best = min(joined)
            if best >= below:
                break
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: bytes, right: bool) -> tuple[tuple[bytes, int], ...]:
        """Parts that stand at one end of a token while it is merged, each with the rank of the merge that takes it."""
        known = self.edges.get((token, right))
        if known is None:
            out, part, taken = [], token, 1 << 40
            while True:
                out.append((part, taken))
                if len(part) == 1:
                    break
                taken = self.ranks[part]
                halves = self.apply(part, taken)
                if len(halves) != 2:
                    raise ValueError("the ranks are not those of byte pair merges")
                part = halves[1] if right else halves[0]
            known = self.edges[token, right] = tuple(out)
        return known

    def border(self, token: bytes) -> tuple[tuple[bytes, int], ...]:
        """What matters of a token for its right neighbour: the parts at its end that a merge across could take.

        The rank that ends a part's time is rounded up to the next rank that such a merge has, so that most tokens
        share their border with many others.
        """
        out = []
        for part, taken in self.edge(token, True):
            ranks = self.across.get(part, ())
            at = bisect_left(ranks, taken)
            if at:
                out.append((part, ranks[at] if at < len(ranks) else 1 << 40))
        return tuple(out)

    def stay_apart(self, border: tuple[tuple[bytes, int], ...], right: bytes) -> bool:
        """True if no merge across the border comes before the merges inside; merges come in the order of their ranks."""
        get = self.ranks.get
        for a, a_taken in border:
            for b, b_taken in self.edge(right, False):
                rank = get(a + b)
                if rank is not None and rank < a_taken and rank <= b_taken:
                    return False
        return True


class State(dict):
    """Ways in which the bytes read so far can go on: numbers of open tokens. Maps a byte to the state behind it and the
    id of the last token of all bytes up to there."""

    __slots__ = ("make", "open")

    def __init__(self, open_tokens: tuple[int, ...], make):
        self.open, self.make = open_tokens, make

    def __missing__(self, byte: int) -> tuple[State, int]:
        step = self[byte] = self.make(self, byte)
        return step


class Transducer:
    """Bytes of one pre-token to token ids.

    The encoding of every prefix of the bytes is the encoding of a shorter prefix and one more token, and tokens are
    an encoding exactly if every two neighbours stay apart when merged together. So the automaton of open tokens
    (bytes read since a token's end, and that end's border) gives all encodings; a state of the transducer is the set
    of its ways that are still open, the last of them with nothing read since its end. Each byte gives the last token of
    all bytes so far, and so where the token before it ends. Tokens that all open ways share are emitted, the others
    wait in a window over the last bytes. States and steps are made when first met.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.merges = Merges(ranks)
        self.begins = {t[:i] for t in ranks for i in range(1, len(t))}
        self.lengths = {rank: len(t) for t, rank in ranks.items()}
        self.states: dict[tuple, State] = {}
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.ways: list[tuple[bytes, tuple]] = []
        self.moves: dict[int, tuple[int, int, int]] = {}
        self.borders: dict[bytes, tuple] = {}
        self.forget()

    def forget(self) -> None:
        """Drop the states; new ones are soon made of the moves. States are emptied, as they hold each other in rings."""
        for state in self.states.values():
            state.clear()
        self.states = {}
        self.start = self.state((self.number(b"", ()),))

    def state(self, open_tokens: tuple[int, ...]) -> State:
        found = self.states.get(open_tokens)
        if found is None:
            found = self.states[open_tokens] = State(open_tokens, self.make_step)
        return found

    def number(self, begun: bytes, border: tuple) -> int:
        known = self.numbers.get((begun, border))
        if known is None:
            known = self.numbers[begun, border] = len(self.ways)
            self.ways.append((begun, border))
        return known

    def make_move(self, way: int, byte: int) -> tuple[int, int, int]:
        """One open token and one byte: the token still open, the border if it may end here, and its id (or -1)."""
        begun, border = self.ways[way]
        longer = begun + bytes((byte,))
        grown = self.number(longer, border) if longer in self.begins else -1
        token, end = self.ranks.get(longer, -1), -1
        if token >= 0:
            if self.merges.stay_apart(border, longer):
                after = self.borders.get(longer)
                if after is None:
                    after = self.borders[longer] = self.merges.border(longer)
                end = self.number(b"", after)
        move = self.moves[way << 8 | byte] = (grown, end, token) if grown >= 0 or end >= 0 else DEAD
        return move

    def make_step(self, state: State, byte: int) -> tuple[State, int]:
        ways, last, known = [], None, self.moves.get
        for way in state.open:
            grown, end, token = known(way << 8 | byte) or self.make_move(way, byte)
            if grown >= 0:
                ways.append(grown)
            if end >= 0 and last is None:
                last, ended = end, token
        if last is None:
            raise ValueError("the ranks are not those of byte pair merges")
        ways.append(last)
        return self.state(tuple(ways)), ended

    def path(self, last: list[int], end: int) -> list[int]:
        """Tokens of the first ``end`` bytes of the window, from the last one back."""
        out = []
        while end > 0:
            out.append(last[end - 1])
            end -= self.lengths[out[-1]]
        return out

    def shared(self, state: State, last: list[int]) -> list[int]:
        """Tokens at the window's begin that all open ways have."""
        paths = [self.path(last, len(last) - len(self.ways[way][0]))[::-1] for way in state.open]
        least = min(paths, key=len)
        count = 0
        while count < len(least) and all(p[count] == least[count] for p in paths):
            count += 1
        return least[:count]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.moves) > MOST_MOVES:
            self.reset()
        elif len(self.states) > MOST_STATES:
            self.forget()
        state, out, last = self.start, [], []
        for start in range(0, len(piece), WINDOW):
            if start:
                emitted = self.shared(state, last)
                out += emitted
                del last[: sum(map(self.lengths.__getitem__, emitted))]
            for byte in piece[start : start + WINDOW]:
                state, token = state[byte]
                last.append(token)
        return out + self.path(last, len(last))[::-1]


class Encoder:
    """Texts to packed token ids (little-endian unsigned 32-bit)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import re

        import regex

        self.transducer = Transducer(ranks)
        self.packed: dict[str, bytes] = {}
        self.split = regex.compile(pattern).findall
        # a space between two other characters always begins a pre-token; other white space is left to the pattern
        self.uneven = re.compile(r"\s\s|\A\s|\s\Z|\A\Z").search
        outer = self

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                if len(self) > MOST_CHUNKS:
                    self.clear()
                pieces = outer.split(" " + chunk)
                # a chunk of one piece is remembered here only
                one = len(pieces) == 1 and outer.packed.get(pieces[0])
                packed = self[chunk] = one or (outer.fresh(pieces[0]) if len(pieces) == 1 else outer.joined(pieces))
                return packed

        self.chunks = Chunks()

    def pieces(self, text: str) -> bytes:
        return self.joined(self.split(text))

    def joined(self, pieces: list[str]) -> bytes:
        return b"".join([self.packed.get(piece) or self.pack(piece) for piece in pieces])

    def fresh(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def pack(self, piece: str) -> bytes:
        if len(self.packed) > MOST_CHUNKS:
            self.packed.clear()
        packed = self.packed[piece] = self.fresh(piece)
        return packed

    def encode(self, text: str) -> bytes:
        if self.uneven(text):
            return self.pieces(text)
        first, *rest = text.split(" ")
        return self.pieces(first) + b"".join(map(self.chunks.__getitem__, rest))


class Utf8State(dict):
    """A state of the decoder: the bytes of a character that is not complete. Maps a token to (text, next state)."""

    def __init__(self, decoder: Decoder, held: bytes):
        self.decoder, self.held = decoder, held

    def __missing__(self, token: int) -> tuple[str, Utf8State]:
        step = self[token] = self.decoder.step(self.held + self.decoder.tokens[token])
        return step


class Decoder:
    """Token ids to text, token by token. Bytes that cannot begin or continue a character become U+FFFD."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {i: t for t, i in ranks.items()}
        self.states: dict[bytes, Utf8State] = {}
        self.start = self.state(b"")

    def state(self, held: bytes) -> Utf8State:
        if held not in self.states:
            self.states[held] = Utf8State(self, held)
        return self.states[held]

    def step(self, data: bytes) -> tuple[str, Utf8State]:
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC0:
                needs = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                cut = len(data) - back if needs > back and self.may_grow(data[-back:]) else cut
                break
            if lead < 0x80:
                break
        return data[:cut].decode("utf-8", "replace"), self.state(data[cut:])

    @staticmethod
    def may_grow(held: bytes) -> bool:
        try:
            held.decode("utf-8")
        except UnicodeDecodeError as error:
            return error.reason == "unexpected end of data"
        return False

    def decode(self, ids) -> str:
        out, state = [], self.start
        for token in ids:
            text, state = state[token]
            out.append(text)
        out.append(state.held.decode("utf-8", "replace"))
        return "".join(out)

    def raw(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _coders(packed_ranks: bytes, pattern: str) -> tuple[Encoder, Decoder]:
    """Kept by the worker process, so that later tasks find the states that earlier ones have made, until a task of another
    operator comes."""

    def make():
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, packed_ranks.splitlines())}
        return Encoder(ranks, pattern), Decoder(ranks)

    gc.set_threshold(500_000)  # states live long; looking them through again and again takes a quarter of the time
    return kept("bpe", (packed_ranks, pattern), make)


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per document: ``doc_id, ids`` (packed little-endian unsigned 32-bit), ``n_tokens``, ``decoded`` text.

    A null or empty text has no tokens. The rank file (a megabyte) is read once on the driver and sent with the
    tasks. Other columns are not read; repeated rows are encoded again; an empty table gives no rows.
    """
    ranks = Path(ranks_path).read_bytes()

    def make():
        encoder, decoder = _coders(ranks, pattern)

        def work(rows):
            ids = [encoder.encode(text or "") for text in rows["text"]]
            return {
                "doc_id": rows["doc_id"],
                "ids": ids,
                "n_tokens": [len(i) // 4 for i in ids],
                "decoded": [decoder.decode(np.frombuffer(i, "<u4").tolist()) for i in ids],
            }

        return work

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, ids binary, n_tokens long, decoded string", "bpe")


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every text encoded and decoded again, as digests.

    Nulls and empty texts have no tokens and the digest of no bytes.
    """
    ranks = Path(ranks_path).read_bytes()

    def make():
        encoder, decoder = _coders(ranks, pattern)

        def work(rows):
            out = {"doc_id": rows["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in rows["text"]:
                packed = encoder.encode(text or "")
                back = decoder.decode(np.frombuffer(packed, "<u4").tolist())
                out["n_tokens"].append(len(packed) // 4)
                out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
            return out

        return work

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(docs.select("doc_id", "text"), make, schema, "bpe")
