"""BPE encoding by backtracking over longest tokens, and decoding by an offset table.

A piece (the vocabulary's own pre-tokenization) is encoded without merging step by step: an
Aho-Corasick automaton lists the longest token at every byte; walking from left to right, a token is
taken if it may stand after the one before it, else the next shorter prefix token is tried, and
where none fits the walk steps back.  Whether two tokens may stand side by side in an exact result
is read from the pair table, filled as pairs come up: they may unless a merge of earlier rank reaches
across their border while they are built.  Each byte is left behind at most once for good, so the time
is linear in the piece.  Decoding gathers slices of one byte array by the tokens' offsets.

Cases: null and empty texts have no tokens.  Any text that Spark can hold is encoded whole, very
long pieces included.  Rows are judged one by one, so repeated rows and extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, chunks, plain_names, ship

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker remembers; a full memory is emptied, which changes no result.
MEMORY_PIECES = 400_000
MEMORY_PAIRS = 400_000
#: Longer pieces are not remembered.
MEMORY_CHARS = 40


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files of this kind."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if b not in set(shown))
    table.update({chr(256 + k): b for k, b in enumerate(hidden)})
    return table


class _Memory(dict):
    """Piece to its ids as packed 32-bit numbers; what is missing is encoded."""

    def __init__(self, bpe: BytePairEncoder):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.bpe.encode_piece(piece.encode()), np.int32).tobytes()
        if len(piece) <= MEMORY_CHARS:
            if len(self) >= MEMORY_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class BytePairEncoder:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {t: k for t, k in spec["model"]["vocab"].items() if t not in self.special}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, k in vocab.items():
            self.tokens[k] = raw(token)
        for text, k in self.special.items():
            self.tokens[k] = text.encode()
        self.by_bytes = {self.tokens[k]: k for k in vocab.values()}
        # merges in rank order: what a token is made of, and at which rank a pair merges
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            self.merge.setdefault((a, b), rank)
            self.parts.setdefault(made, (a, b))
            self.rank.setdefault(made, rank)
        self.may_follow: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        # a token that its own merges do not yield never comes out of an exact encoding
        self.usable = {k for k in vocab.values() if len(self.tokens[k]) == 1 or k in self.parts}
        for k in self.usable:
            self.automaton.add_word(self.tokens[k].decode("latin-1"), k)
        self.automaton.make_automaton()
        self.shorter = [self._shorter(k) if k in self.usable else -1 for k in range(size)]
        ends = np.cumsum([0, *map(len, self.tokens)])
        self.offsets, self.buffer = ends, np.frombuffer(b"".join(self.tokens), np.uint8)
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(PATTERN)
        self.memory = _Memory(self)

    def _shorter(self, k: int) -> int:
        """The longest usable token that is a proper prefix of token k."""
        token = self.tokens[k]
        for n in range(len(token) - 1, 0, -1):
            found = self.by_bytes.get(token[:n], -1)
            if found in self.usable:
                return found
        return -1

    def _compatible(self, a: int, b: int) -> bool:
        """Whether a then b stays so under the merges in rank order.

        Undo the later merge of the two sides again and again: at each moment the pair at the border
        must not have a merge that comes before the merges that ended it.
        """
        known = self.may_follow.get((a, b))
        if known is None:
            if len(self.may_follow) >= MEMORY_PAIRS:
                self.may_follow.clear()
            known = self.may_follow[a, b] = self._check(a, b)
        return known

    def _check(self, a: int, b: int) -> bool:
        never = len(self.merge) + 1
        # ranks at which the token on each side of the border was merged away into a larger one
        gone_a = gone_b = never
        while True:
            rank = self.merge.get((a, b))
            # the pair at the border lives until the first of its sides is merged; on a tie of ranks the left comes first
            if rank is not None and (rank < gone_a and rank <= gone_b):
                return False
            rank_a, rank_b = self.rank.get(a, -1), self.rank.get(b, -1)
            if rank_a < 0 and rank_b < 0:
                return True
            # step back in time past the later of the merges that made the two sides
            if rank_a >= rank_b:
                gone_a, a = rank_a, self.parts[a][1]
            else:
                gone_b, b = rank_b, self.parts[b][0]

    def _longest(self, piece: str) -> list[int]:
        """The longest token from each byte on (every single byte is a token)."""
        best, size = [-1] * len(piece), [0] * len(piece)
        lengths = self.tokens
        for end, k in self.automaton.iter(piece):
            n = len(lengths[k])
            at = end - n + 1
            if n > size[at]:
                best[at], size[at] = k, n
        return best

    def encode_piece(self, data: bytes) -> list[int]:
        if len(data) == 1:
            return [self.by_bytes[data]]
        shown = data.decode("latin-1")
        # the walk's first tries, as the automaton finds them in one go; mostly they all fit
        out = [k for _, k in self.automaton.iter_long(shown)]
        fits, last = self.may_follow, -1
        for token in out:
            if last >= 0 and not (fits[last, token] if (last, token) in fits else self._compatible(last, token)):
                break
            last = token
        else:
            return out
        longest = self._longest(shown)
        out = []
        at, n = 0, len(data)
        dead = bytearray(n + 1)  # ends from which no way leads on
        token = longest[0]
        while at < n:
            while token >= 0:
                end = at + len(self.tokens[token])
                if not dead[end] and (not out or self._compatible(out[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError("the vocabulary cannot encode this text")
                dead[at] = 1
                token = out.pop()
                at -= len(self.tokens[token])
                token = self.shorter[token]
        return out

    def spans(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of the text, and whether each is a special token."""
        at = 0
        for m in self.split_special.finditer(text) if self.split_special else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def encode(self, text: str) -> list[int]:
        return self.encode_array(text).tolist()

    def encode_array(self, text: str) -> np.ndarray:
        out: list[bytes] = []
        for part, special in self.spans(text):
            if special:
                out.append(np.int32(self.special[part]).tobytes())
            else:
                out += map(self.memory.__getitem__, self.pieces.findall(part))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, gathered from one buffer."""
        ids = np.asarray(ids, np.int64)
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        total = int(size.sum())
        ends = np.cumsum(size)
        at = np.arange(total) + np.repeat(start - (ends - size), size)
        return self.buffer[at].tobytes()


_encoders: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """One encoder a worker for each vocabulary file."""
    if path not in _encoders:
        _encoders[path] = BytePairEncoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """`docs` plus ids (array<int>) and decoded (the text that the ids give back).

    `path` must be readable on every executor (vocabularies come with the workers' installation).
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for part in chunks(batch, text):
                texts = Texts(part.column(text))
                ids = [bpe.encode_array(texts.bytes(i).decode()) for i in range(texts.n)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                decoded = [bpe.decode(x).decode(errors="replace") for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), pa.array(decoded, pa.string())], [*part.schema.names, "ids", "decoded"])

    docs, names, (text,) = plain_names(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "decoded")]), "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema) + ", ids array<int>, decoded string"
    return docs.mapInArrow(run, schema).toDF(*names, "ids", "decoded")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids and texts are hashed where they are made."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        names = np.array([str(k) for k in range(len(bpe.tokens))], object)
        for batch in batches:
            for part in chunks(batch):
                texts = Texts(part.column("text"))
                count, ids_digest, text_digest = [], [], []
                for i in range(texts.n):
                    ids = bpe.encode_array(texts.bytes(i).decode())
                    count.append(len(ids))
                    ids_digest.append(hashlib.sha256(",".join(names[ids]).encode()).hexdigest())
                    text_digest.append(hashlib.sha256(bpe.decode(ids).decode(errors="replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids_digest), pa.array(text_digest)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
