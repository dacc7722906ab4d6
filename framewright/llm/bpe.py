"""Operator 8: byte-level BPE encoding and decoding in linear time.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds every token that
ends at each byte. A piece is then covered from the left by the longest token that fits; where two neighbours could not
stand beside each other in a BPE result, shorter tokens are tried and, failing these, the walk steps back. Whether two
tokens may be neighbours is memoised. Each position is left at most once, so the work is linear in the piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces kept in a worker's memo, and the longest piece that is kept.
MEMO, LONGEST = 200_000, 80
DEFAULT = "byte_bpe_multi_50k.tiktoken"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Bpe:
    """Encoder and decoder for one vocabulary. Ranks are merge priorities; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.text = {v: k for k, v in self.ranks.items()}
        self.raw = {v: k for k, v in ranks.items()}
        self.decimal = {v: str(v) for v in self.text}
        self.findall = regex.compile(pattern).findall
        self.finditer = regex.compile(pattern).finditer
        self.top = max(self.text, default=0) + 2  # over any rank
        self.machine = ahocorasick.Automaton()
        for piece, rank in self.ranks.items():
            self.machine.add_word(piece, rank)
        self.machine.make_automaton()
        self.beside: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank in sorted(self.text):
            self.halves[rank] = self._split(rank)
        self.pieces = _Pieces(self)

    def _split(self, rank: int) -> tuple[int, int]:
        """The two tokens that BPE merges last into this one; itself twice if it is a single byte or cannot be merged."""
        text = self.text[rank]
        for cut in range(len(text) - 1, 0, -1):
            left, right = self.ranks.get(text[:cut], rank), self.ranks.get(text[cut:], rank)
            if left < rank and right < rank and self._neighbours(left, right, rank):
                return left, right
        return rank, rank

    def _neighbours(self, left: int, right: int, below: int | None = None) -> bool:
        """Would BPE keep these two side by side? Undoes the merges at the seam, latest first, and looks for an earlier merge across it.

        below: take only merges of a lower rank as known.
        """
        limit = below if below is not None else self.top
        while True:
            merged = self.ranks.get(self.text[left] + self.text[right])
            if merged is not None and merged < limit:
                return False
            if left > right:
                limit, (_, inner) = left, self.halves[left]
                if inner != left:
                    left = inner
                    continue
                limit, (inner, _) = right + 1, self.halves[right]
                if inner == right:
                    return True
                right = inner
            else:
                limit, (inner, _) = right + 1, self.halves[right]
                if inner != right:
                    right = inner
                    continue
                limit, (_, inner) = left, self.halves[left]
                if inner == left:
                    return True
                left = inner

    def fits(self, left: int, right: int) -> bool:
        """Memoised _neighbours."""
        pair = left * self.top + right  # one number, which takes less room and time than a tuple
        got = self.beside.get(pair)
        if got is None:
            if len(self.beside) > MEMO:
                self.beside.clear()
            got = self.beside[pair] = self._neighbours(left, right)
        return got

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Tokens of one match of the pattern."""
        text = piece.decode("latin-1")
        whole = self.ranks.get(text)
        if whole is not None:
            return (whole,)
        size = len(text)
        starts: list[list[int]] = [[] for _ in range(size)]  # the tokens from each byte on, shortest first
        for end, rank in self.machine.iter(text):
            starts[end + 1 - len(self.text[rank])].append(rank)
        left = [len(x) for x in starts]  # tokens not yet tried at each byte
        open_ = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at = 0
        while at < size:
            k = left[at] - 1
            while k >= 0:
                token = starts[at][k]
                end = at + len(self.text[token])
                if open_[end] and (not out or self.fits(out[-1], token)):
                    break
                k -= 1
            if k >= 0:
                left[at] = k  # on coming back here, only shorter ones are tried
                out.append(token)
                at = end
                if at < size:
                    left[at] = len(starts[at])
            else:
                if not out:
                    raise ValueError("a byte is not in the vocabulary")
                open_[at] = 0
                at -= len(self.text[out.pop()])
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Tokens of a whole text, without special tokens."""
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of a list of tokens."""
        return b"".join(map(self.raw.__getitem__, ids))


class _Pieces(dict):
    """Memo of pieces' tokens; what is missing is encoded, and emptied when it is full."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> tuple[int, ...]:
        got = self.bpe.encode_piece(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= LONGEST:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = got
        return got


_LOADED: dict[bytes, Bpe] = {}


def loaded(data: bytes, pattern: str = public_tokenizers.PATTERN) -> Bpe:
    """The encoder for a vocabulary file's bytes, built once in each Python worker."""
    key = hashlib.sha256(data + pattern.encode()).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(read_ranks(data), pattern)
    return _LOADED[key]


def vocabulary(path: str | None = None) -> bytes:
    """A vocabulary file, read on the driver; about half a megabyte, whatever the corpus."""
    with open(path or public_tokenizers.path(DEFAULT), "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = False) -> DataFrame:
    """Encode and decode every text: (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]).

    docs needs doc_id and text; other columns are ignored. A null text counts as empty (no tokens, hashes of nothing).
    Repeated rows are encoded each, rows without doc_id too; an empty table gives an empty result. One narrow pass without a shuffle; a lost task is simply run again. Memory holds
    one Arrow batch and two bounded memos.
    """
    data = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(data.value, pattern)
        sha = hashlib.sha256
        for batch in batches:
            rows: list[list] = [[] for _ in fields]
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                row = [None, len(ids), sha(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest(), sha(bpe.decode(ids)).hexdigest(), ids]
                for column, value in zip(rows[1:], row[1:], strict=False):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(rows[1:], list(schema)[1:], strict=True))], schema=schema)

    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kinds)
