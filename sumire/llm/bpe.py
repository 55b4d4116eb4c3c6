"""Exact byte-pair encoding by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import table

#: Pieces within which merges stay: contractions, then runs of letters, numbers, others or white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
#: The same for texts below U+0100, where these classes are exact and the plain engine is faster.
LATIN = re.compile(rf" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
BEYOND = re.compile("[^\x00-\xff]")
#: Pieces whose ids a task remembers, twice: those seen of late and those before.
REMEMBERED = 200_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable bytes for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Merges of a byte-level vocabulary file in which a token's id follows its rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        raw = {t: bytes(letters[c] for c in t) for t in vocab}
        self.pairs: dict[tuple[int, int], int] = {}
        top = max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1
        self.split = [(i, i) for i in range(top)]
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.pairs[x, y] = z
            self.split[z] = (x, y)
            if z != 256 + rank:
                raise ValueError("token ids must follow the ranks of their merges")
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        table = [b""] * top
        for t, i in vocab.items():
            table[i] = raw[t]
        for t, i in self.added.items():
            table[i] = t.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in table])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.size = [len(t) for t in table]
        self.find = ahocorasick.Automaton()
        known = self.known = {raw[t]: i for t, i in vocab.items()}
        for t, i in known.items():
            self.find.add_word(t.decode("latin-1"), i)
        self.find.make_automaton()
        self.shorter = [-1] * top  # the longest token that begins a token and is shorter
        for t, i in known.items():
            self.shorter[i] = next((known[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in known), -1)
        self.fits: dict[tuple[int, int], bool] = {}
        self.names = [str(i) for i in range(top)]
        self.kind = np.dtype("<u2" if top <= 1 << 16 else "<u4")
        self.pieces = regex.compile(PIECES)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.memo = _Memo(self)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves tokens a and b side by side: no pair along their facing edges merges before both were made."""
        if (known := self.fits.get((a, b))) is not None:
            return known
        x, y, limit, pairs, split = a, b, 1 << 60, self.pairs, self.split
        while True:
            if pairs.get((x, y), limit) < limit:
                ok = False
                break
            if x > y:
                limit = x
                x = split[x][1]
                if x == limit:
                    limit = y + 1
                    y = split[y][0]
                    if y + 1 == limit:
                        ok = True
                        break
            else:
                limit = y + 1
                y = split[y][0]
                if y + 1 == limit:
                    limit = x
                    x = split[x][1]
                    if x == limit:
                        ok = True
                        break
        if len(self.fits) > 300_000:
            self.fits.clear()
        self.fits[a, b] = ok
        return ok

    def piece(self, text: bytes) -> tuple[int, ...]:
        """Ids of a piece: always the longest match that fits its forerunner, going back where none does."""
        if (whole := self.known.get(text)) is not None:
            return (whole,)  # the longest match of all, with no forerunner to fit
        n, size = len(text), self.size
        longest = [-1] * n
        for end, t in self.find.iter(text.decode("latin-1")):
            at = end + 1 - size[t]
            if longest[at] < 0 or size[longest[at]] < size[t]:
                longest[at] = t
        out: list[int] = []
        open_, at = bytearray(b"\1" * (n + 1)), 0
        token = longest[0]
        while at < n:
            last = out[-1] if out else -1
            while True:
                end = at + size[token]
                if open_[end] and (last < 0 or self.compatible(last, token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                if self.shorter[token] >= 0:
                    token = self.shorter[token]
                    continue
                open_[at] = 0
                out.pop()
                at -= size[last]
                token = last
                break
        return tuple(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        if self.cut and any(a in text for a in self.added):
            some = b"".join(np.array([self.added[part]], self.kind).tobytes() if part in self.added else self._plain(part) for part in self.cut.split(text) if part)
        else:
            some = self._plain(text)
        return np.frombuffer(some, self.kind)

    def _plain(self, text: str) -> bytes:
        self.memo.age()
        return b"".join(map(self.memo.__getitem__, (self.pieces if BEYOND.search(text) else LATIN).findall(text)))

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The tokens' bytes, laid end to end from the offset table, as UTF-8 (bytes that aren't become U+FFFD)."""
        if not len(ids):
            return ""
        at = np.asarray(ids, np.int32)
        parts = []
        for i in range(0, len(at), 1 << 18):
            start = self.offsets[at[i : i + (1 << 18)]]
            size = self.offsets[at[i : i + (1 << 18)] + 1] - start
            ends = np.cumsum(size)
            parts.append(self.bytes[np.arange(ends[-1]) + np.repeat(start - ends + size, size)].tobytes())
        return b"".join(parts).decode("utf-8", "replace")


class _Memo(dict):
    """Ids by piece, as bytes. When full it becomes the old half, from which pieces that are seen again come back."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.old = bpe, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = np.array(self.bpe.piece(piece.encode()), self.bpe.kind).tobytes()
        self[piece] = out
        return out

    def age(self) -> None:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One for each worker process, with what it remembers."""
    return Bpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _mapped(docs: DataFrame, vocabulary: str | None, made: list[tuple[T.StructField, pa.DataType]], row) -> DataFrame:
    """docs and what row(bpe, text) gives; a null text is an empty one. The vocabulary file must be at that path on every machine."""
    at, fields = docs.columns.index("text"), docs.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary or default_vocabulary())
        for b in batches:
            out = [row(bpe, x or "") for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[i] for r in out], kind) for i, (_, kind) in enumerate(made))], [*b.schema.names, *(f.name for f, _ in made)])

    return docs.mapInArrow(run, T.StructType([*fields, *(f for f, _ in made)]))


def encode(docs: DataFrame, vocabulary: str | None = None, column: str = "ids") -> DataFrame:
    """docs with the token ids of every whole text; a column of that name is replaced."""
    docs = docs.drop(column)
    return _mapped(docs, vocabulary, [(T.StructField(column, T.ArrayType(T.IntegerType())), pa.list_(pa.int32()))], lambda bpe, x: (bpe.encode(x),))


def decode(tokens: DataFrame, vocabulary: str | None = None, column: str = "ids", to: str = "text") -> DataFrame:
    """tokens with the text of the ids; null ids give an empty text."""
    tokens = tokens.drop(to)
    at, fields = tokens.columns.index(column), tokens.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary or default_vocabulary())
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([bpe.decode(x or []) for x in b.column(at).to_pylist()], pa.string())], [*b.schema.names, to])

    return tokens.mapInArrow(run, T.StructType([*fields, T.StructField(to, T.StringType())]))


def _digest(bpe: Bpe, text: str) -> tuple[int, str, str]:
    ids = bpe.encode(text)
    return len(ids), hashlib.sha256(",".join(map(bpe.names.__getitem__, ids.tolist())).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; a null text is an empty one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = [(T.StructField("n_tokens", T.LongType()), pa.int64()), (T.StructField("ids_sha256", T.StringType()), pa.string()), (T.StructField("decoded_sha256", T.StringType()), pa.string())]
    return _mapped(docs, None, made, _digest).drop("text")


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids and how many, beside all columns but the text; decoding the ids gives the text back."""
    return encode(docs).withColumn("n_tokens", F.size("ids").cast("long")).drop("text")
