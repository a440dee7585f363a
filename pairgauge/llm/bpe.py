"""Byte-level BPE by prefix dynamic programming.

Every prefix of a byte string has one BPE encoding, and so one last token. ``PrefixTable`` stores
that token for each prefix: the last token of prefix i is the one token t ending at i for which the
last token of the prefix before t, followed by t, is itself what BPE makes of their joined bytes.
Appending bytes only adds entries; an edit keeps the entries before it and recomputes from there
until the table meets its old self again. Reading an encoding walks back from the end.

``encode_documents`` splits texts by the tokenizer's pattern, encodes each distinct match once a
worker (in a bounded store) and decodes the ids again. Null texts count as empty; rows are
handled one by one, so ties, repeated rows and empty tables need no care, and only the id and text
columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries a worker keeps of each of its stores before it starts anew.
STORE = 160_000


class Vocabulary:
    """Token bytes by rank, and which two tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._side: dict[tuple[int, int], bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        #: the tokens that BPE makes at all
        self.live = {t: i for t, i in ranks.items() if self.stands(i)}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merged(self, data: bytes) -> list[int]:
        """The definition itself: join the neighbours of lowest rank until none can be joined."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose join made t last; None for a byte and for what BPE never makes."""
        if t not in self._halves:
            token = self.tokens[t]
            cut = None
            if len(token) > 1:
                # of the cuts into two standing tokens at most one is where BPE's last join was
                for i in range(1, len(token)):
                    a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                    if a is not None and b is not None and max(a, b) < t and self.stands(a) and self.stands(b) and self.fits(a, b, t):
                        cut = (a, b)
                        break
            self._halves[t] = cut
        return self._halves[t]

    def stands(self, t: int) -> bool:
        """Whether BPE makes t of t's own bytes."""
        return len(self.tokens[t]) == 1 or self.halves(t) is not None

    def fits(self, a: int, b: int, below: int = 1 << 60) -> bool:
        """Whether BPE makes a, b of their joined bytes, if only joins of ranks under ``below`` are made.

        Looks back in time: the token of higher rank was made last, and before that its two halves
        stood there. If the parts that meet at the border could be joined before the last of the
        later steps, they would have been, and the border would be gone."""
        key = (a, b)
        if below == 1 << 60 and key in self._side:
            return self._side[key]
        ranks, tokens, x, y, cap = self.ranks, self.tokens, a, b, below
        while True:
            joint = ranks.get(tokens[x] + tokens[y])
            if joint is not None and joint < cap:
                ok = False
                break
            parts = self.halves(max(x, y))
            if parts is None:
                ok = True
                break
            if x > y:
                cap, x = x, parts[1]  # of two equal ranks the left one is joined first
            else:
                cap, y = y + 1, parts[0]
        if below == 1 << 60:
            if len(self._side) > 8 * STORE:
                self._side.clear()
            self._side[key] = ok
        return ok


def _extend(v: Vocabulary, data: bytes, last: list[int], stop: int) -> None:
    """Append to ``last`` the one token that can end the encoding of each longer prefix."""
    token, side, longest = v.live.get, v._side.get, v.longest
    for end in range(len(last), stop + 1):
        for start in range(end - longest if end > longest else 0, end):
            t = token(data[start:end])
            if t is not None:
                if start:
                    ok = side((last[start], t))
                    if ok is None:
                        ok = v.fits(last[start], t)
                    if not ok:
                        continue
                last.append(t)
                break
        else:
            raise ValueError("a byte is missing from the vocabulary")


class PrefixTable:
    """The last token of every prefix of ``data``; ``last[i]`` is that of the first i bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        _extend(self.v, self.data, self.last, len(self.data))

    def splice(self, start: int, end: int, new: bytes) -> int:
        """Replace data[start:end]; returns how many entries had to be computed."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[: start + 1]
        done, same = 0, 0
        for at in range(start + 1, len(self.data) + 1):
            _extend(self.v, self.data, self.last, at)
            done += 1
            beyond = at >= start + len(new) and at - shift <= len(old) - 1
            same = same + 1 if beyond and self.last[at] == old[at - shift] else 0
            # entries look back over the longest token only: that many equal ones settle the rest
            if same > self.v.longest:
                self.last += old[at - shift + 1 :]
                break
        return done

    def ids(self, end: int | None = None) -> list[int]:
        at, out = len(self.data) if end is None else end, []
        while at:
            out.append(self.last[at])
            at -= len(self.v.tokens[out[-1]])
        return out[::-1]


def encode_piece(v: Vocabulary, data: bytes) -> tuple[int, ...]:
    """The ids of one match of the pattern."""
    whole = v.live.get(data)
    if whole is not None:
        return (whole,)
    last = [-1]
    _extend(v, data, last, len(data))
    at, out = len(data), []
    while at:
        out.append(last[at])
        at -= len(v.tokens[last[at]])
    return tuple(out[::-1])


def encode_sorted(v: Vocabulary, pieces: list[str], store: dict[str, bytes]) -> None:
    """Add the packed ids of matches to a store. In order of their bytes, each goes on from the last tokens
    of the prefix that it shares with the one before."""
    last, before = [-1], b""
    for data, piece in sorted((p.encode(), p) for p in pieces):
        whole = v.live.get(data)
        if whole is not None:
            store[piece] = _pack((whole,))
            continue
        k, most = 0, min(len(data), len(before))
        while k < most and data[k] == before[k]:
            k += 1
        del last[k + 1 :]
        _extend(v, data, last, len(data))
        before, at, out = data, len(data), []
        while at:
            out.append(last[at])
            at -= len(v.tokens[last[at]])
        store[piece] = _pack(tuple(out[::-1]))


def _pack(ids: tuple[int, ...]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


#: White space in front of a space: there a cut at the space would part a run.
_RUN = re.compile(r"\s ")
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


# the one pattern that is also read by Python's own engine (fixed value), for texts below U+0180: letters, numbers, white space
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-\u017f", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_MATCH = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[\u0180-\U0010ffff]")
#: Matches of a text that are held at once, and characters of short texts.
MATCHES = 200_000
HELD = 1 << 19


class Encoder:
    """Encodes texts: no match crosses from other characters into white space, so chunks of one
    run of white space and what follows are encoded once and kept, packed. Of chunks and of matches the
    last STORE are kept, and those that were asked for again since."""

    def __init__(self, v: Vocabulary, pattern: str):
        import regex

        self.v, self.split = v, regex.compile(pattern).findall
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_chunks: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        self.known = pattern == KNOWN_PATTERN
        self.table = [v.tokens.get(i, b"") for i in range(max(v.tokens) + 1)]

    def _chunk(self, chunk: str) -> bytes:
        out = []
        for p in self.split(chunk):
            ids = self.pieces.get(p)
            if ids is None:
                if len(self.pieces) >= STORE:
                    self.old_pieces, self.pieces = self.pieces, {}
                ids = self.old_pieces.get(p)
                if ids is None:
                    ids = _pack(encode_piece(self.v, p.encode()))
                if len(p) <= 64:
                    self.pieces[p] = ids
            out.append(ids)
        return b"".join(out)

    def _matches(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of lists of matches of the pattern."""
        store = self.pieces
        new = set().union(*lists).difference(store)
        if len(store) + len(new) > STORE:
            self.old_pieces = store
            store = self.pieces = {}
            new = set().union(*lists)
        old, unknown = self.old_pieces.get, []
        for p in new:
            ids = old(p)
            if ids is None:
                unknown.append(p)
            else:
                store[p] = ids
        encode_sorted(self.v, unknown, store)
        out = [b"".join(map(store.__getitem__, parts)) for parts in lists]
        for p in unknown:
            if len(p) > 64:
                del store[p]
        return out

    def _all(self, parts: list[str], lead: str) -> bytes:
        """The ids of parts that each follow ``lead``; kept by the part itself if that is a space."""
        store = self.chunks
        new = set(parts).difference(store)
        if len(store) + len(new) > STORE:
            self.old_chunks = store
            store = self.chunks = {}
            new = set(parts)
        old = self.old_chunks.get
        for p in new:
            store[p] = old(p) or self._chunk(lead + p)
        out = b"".join(map(store.__getitem__, parts))
        for p in new:
            if len(p) > 64:
                del store[p]
        return out

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.known and not _BEYOND.search(text):
            if len(text) <= MATCHES:
                return self._matches([_MATCH.findall(text)])[0]
            found = (m[0] for m in _MATCH.finditer(text))
            return b"".join(self._matches([list(part)])[0] for part in batched(found, MATCHES))
        if _RUN.search(text):
            return b"".join(map(self._chunk, _CHUNK.findall(text)))
        first, *rest = text.split(" ")
        return self._chunk(first) + self._all(rest, " ")

    def packed_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The packed ids of each text. Short texts are taken up together, so that more of what is new to them shares prefixes."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            if self.known and len(text) <= MATCHES and not _BEYOND.search(text):
                held.append(_MATCH.findall(text))
                size += len(text)
                if size < HELD:
                    continue
                text = None
            yield from self._matches(held)
            held, size = [], 0
            if text is not None:
                yield self.packed(text)
        yield from self._matches(held)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(Vocabulary.read(path), pattern)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and token_ids if asked for) per row.

    ``path`` is a tokenizer file that is installed on every node."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            n, a, d, kept = [], [], [], []
            for packed in e.packed_all(text.as_py() or "" for text in b.column(1)):
                ids = np.frombuffer(packed, "<u4")
                n.append(len(ids))
                a.append(hashlib.sha256(packed).hexdigest())
                d.append(hashlib.sha256(e.decode(ids.tolist())).hexdigest())
                if with_ids:
                    kept.append(ids.astype("<i4"))
            cols = [b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            if with_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"][: 4 + with_ids])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, schema)


def add_token_ids(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The rows with a column ``token_ids``, which takes the place of one that is there; null texts have no ids.

    Decoding the ids must give the text again, or the job fails."""
    docs = docs.drop("token_ids")
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                sub, out = b.slice(lo, 256), []
                whole = sub.column(names.index(text)).to_pylist()
                for t, packed in zip(whole, e.packed_all(t or "" for t in whole), strict=True):
                    ids = np.frombuffer(packed, "<u4")
                    if e.decode(ids.tolist()) != (t or "").encode():
                        raise ValueError("the ids do not decode to the text")
                    out.append(ids.astype(np.int32))
                yield pa.RecordBatch.from_arrays([*sub.columns, pa.array(out, pa.list_(pa.int32()))], names=[*names, "token_ids"])

    return docs.mapInArrow(run, schema)
