"""Byte-level BPE encoding and decoding with forced boundaries.

A pair of bytes that stands next to each other in no vocabulary token can never be merged over, so
there is certainly a cut between them. Words that the pattern finds are cut at all such pairs, the
fragments are encoded independently of each other and their ids are concatenated. A fragment is
merged once for each worker and then remembered.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow

#: The word pattern of byte-level BPE vocabularies (fixed value of the published format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of remembered words and fragments per worker, by a rough count of what they take; then it starts anew.
REMEMBER_BYTES = 100_000_000
#: Words that are looked up at once.
AT_ONCE = 50_000


#: Unicode white space, spelled out as engines differ in the control characters U+001C to U+001F (fixed values).
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _pattern(letters: str, numbers: str) -> str:
    """PATTERN with its classes spelled out."""
    classes = {r"[^\s\p{L}\p{N}]": f"[^{_SPACES}{letters}{numbers}]", r"\s": f"[{_SPACES}]", r"\S": f"[^{_SPACES}]", r"\p{L}": f"[{letters}]", r"\p{N}": f"[{numbers}]"}
    return re.sub("|".join(map(re.escape, classes)), lambda m: classes[m[0]], PATTERN)


def _latin():
    """The same pattern over code points below U+0250, with letters and numbers from the Unicode categories."""
    letters, numbers = ("".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind) for kind in "LN")
    return re.compile(_pattern(letters, numbers)).findall, re.compile("[^\x00-\u024f]").search


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder and decoder over one tokenizer file (JSON of a byte-level BPE without normalizer)."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        vocab = spec["model"]["vocab"]
        self.table: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.table[i] = bytes(back[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.table[i] = content.encode()
        self.alphabet = dict(enumerate(alphabet))
        self.model = Tokenizer.from_file(path).model
        #: meets[a * 256 + b]: the bytes a, b stand side by side in some token
        meets = bytearray(65536)
        for token in (self.table[i] for i in vocab.values()):
            for a, b in zip(token, token[1:], strict=False):
                meets[a << 8 | b] = 1
        self.meets = meets
        self._words = regex.compile(_pattern(r"\p{L}", r"\p{N}")).findall
        self._latin_words, self._beyond = _latin()
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.known: dict[bytes, list[int]] = {}
        self.known_bytes = self.text_bytes = 0
        self.as_text: dict[str, tuple[str, bytes]] = {}
        self.as_array = _Arrays(self)

    def words(self, text: str) -> list[str]:
        """The pattern's matches; texts within Latin scripts take the standard library's faster engine."""
        return self._words(text) if self._beyond(text) else self._latin_words(text)

    def fragments(self, word: bytes) -> list[bytes]:
        """The pieces between forced boundaries."""
        meets, cuts = self.meets, []
        for i in range(1, len(word)):
            if not meets[word[i - 1] << 8 | word[i]]:
                cuts.append(i)
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)] if cuts else [word]

    def merge(self, fragment: bytes) -> list[int]:
        """Merges by rank within one fragment, by the library's model over the byte alphabet."""
        return [t.id for t in self.model.tokenize(fragment.decode("latin-1").translate(self.alphabet))]

    def word_ids(self, word: bytes) -> list[int]:
        fragments = self.fragments(word)
        if len(fragments) == 1:
            return self.merge(word)
        out: list[int] = []
        for fragment in fragments:
            ids = self.known.get(fragment)
            if ids is None:
                if self.known_bytes >= REMEMBER_BYTES // 4:
                    self.known.clear()
                    self.known_bytes = 0
                ids = self.merge(fragment)
                if len(fragment) <= 64:
                    self.known[fragment] = ids
                    self.known_bytes += 250 + 10 * len(fragment)
            out += ids
        return out

    def pieces(self, text: str) -> list[tuple[str, bytes]]:
        """For each word in turn: its ids as decimals joined by commas, and the bytes that they decode to."""
        known, out = self.as_text, []
        parts = self.special.split(text) if self.special and "<" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                i = self.added[part]
                out.append((str(i), self.table[i]))
                continue
            words = self.words(part)
            for lo in range(0, len(words), AT_ONCE):
                some = words[lo : lo + AT_ONCE]
                if self.text_bytes >= REMEMBER_BYTES:
                    known.clear()
                    self.text_bytes = 0
                for word in {*some}.difference(known):
                    known[word] = self.piece(word)
                    self.text_bytes += 300 + 10 * len(word)
                out += map(known.__getitem__, some)
        return out

    def piece(self, word: str) -> tuple[str, bytes]:
        if word in self.added:
            return str(self.added[word]), self.table[self.added[word]]
        ids = self.word_ids(word.encode("utf-8", "surrogatepass"))
        return ",".join(map(str, ids)), b"".join(map(self.table.__getitem__, ids))

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for ids, _ in self.pieces(text or "") for x in ids.split(",")]

    def encode_array(self, text: str) -> np.ndarray:
        """The ids as an array; words and their ids are remembered as in ``pieces``, in another form."""
        known, out = self.as_array, []
        parts = self.special.split(text) if self.special and "<" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(struct.pack("<I", self.added[part]))
                continue
            out += map(known.__getitem__, self.words(part))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


class _Arrays(dict):
    """Words and their ids as bytes of unsigned 32-bit integers, made by the library's model when first asked for."""

    def __init__(self, bpe: ForcedBoundaryBPE):
        super().__init__()
        self.tokenize, self.alphabet, self.bytes = bpe.model.tokenize, bpe.alphabet, 0

    def __missing__(self, word: str) -> bytes:
        if self.bytes >= REMEMBER_BYTES:
            self.clear()
            self.bytes = 0
        self.bytes += 180 + 8 * len(word)
        if word.isascii() and word.isprintable():
            letters = word.replace(" ", self.alphabet[0x20])  # other printable ASCII stands for itself
        else:
            letters = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet)
        ids = self[word] = array("I", [t.id for t in self.tokenize(letters)]).tobytes()
        return ids


_LOADED: dict[str, ForcedBoundaryBPE] = {}


def loaded(path: str) -> ForcedBoundaryBPE:
    """One encoder for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = ForcedBoundaryBPE(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_table(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded) of every row; path: a tokenizer file every worker has.

    A null text is an empty one: no ids and the digests of nothing. Null and repeated doc_ids are rows
    like others; an empty table gives an empty result; other columns are ignored. A text of any length
    is encoded whole.
    """
    path = path or default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            n, hashed, back, all_ids, texts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                pieces = bpe.pieces(text or "")
                ids = ",".join([p[0] for p in pieces])
                decoded = b"".join([p[1] for p in pieces]).decode("utf-8", "replace")
                n.append(ids.count(",") + 1 if ids else 0)
                hashed.append(hashlib.sha256(ids.encode()).hexdigest())
                back.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    all_ids.append([int(x) for x in ids.split(",")] if ids else [])
                    texts.append(decoded)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(hashed, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return map_arrow(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), encode, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: what the trainer reads, token ids by document, with the digests of op1."""
    return encode_table(docs)
