"""Operator 3: byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The alphabet of a byte-level BPE maps each byte to one printable character. `ByteBpe` holds the
library's model, that byte table in both directions, and a bounded cache from pre-token to ids:
each match of the split pattern is encoded separately, so equal matches have equal ids. A .json vocabulary may
have added tokens; a text that spells one goes to the library as it is, which gives the token's own id. A file of ranks has none.

Defined results: a null or empty text has no ids and decodes to no bytes; rows with a null doc_id,
repeated rows and extra columns of documents are allowed, every input row gives one output row.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, spread

#: The printable bytes that the byte-level alphabet keeps as they are.
PRINTABLE = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))

#: Pre-tokens kept per Python worker, and their bytes; beyond these bounds they are kept for a batch only (ids never depend on it).
CACHE_ENTRIES = 450_000
CACHE_BYTES = 1 << 25

#: In texts of these characters alone, Python's `re` classes agree with the Unicode classes of the pattern.
_UNUSUAL = re.compile("[^\t\n\x0b\x0c\r -~¡-©«-±´¶-¸»¿-ɏ‐-‧‰-⁞]")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def byte_table() -> list[str]:
    """The character of each byte: printable bytes are themselves, the others follow from U+0100 on."""
    kept = {b for r in PRINTABLE for b in r}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that each multi-byte token was merged from: its BPE with lower ranks stops at two parts."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                raise ValueError(f"token {token!r} cannot be built from lower ranks")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class ByteBpe:
    """Encoder and decoder over one vocabulary, from a tokenizers .json file or a file of ranks."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, cache_entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        table = byte_table()
        if path.endswith(".json"):
            whole = Tokenizer.from_file(path)
            back = {c: b for b, c in enumerate(table)}
            special = {t.content for t in whole.get_added_tokens_decoder().values()}
            vocab = {token: i for token, i in whole.get_vocab(with_added_tokens=False).items() if token not in special}
            self.bytes_of = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
            self.bytes_of |= {i: t.content.encode() for i, t in whole.get_added_tokens_decoder().items()}
            self.added = sorted(t.content for t in whole.get_added_tokens_decoder().values())
        else:
            ranks = read_ranks(path)
            spell = lambda raw: "".join(table[b] for b in raw)
            model = models.BPE({spell(t): r for t, r in ranks.items()}, [(spell(a), spell(b)) for a, b in merges_of(ranks)])
            whole = Tokenizer(model)
            whole.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.bytes_of = {r: t for t, r in ranks.items()}
            self.added = []
            whole.encode_special_tokens = True
        self.whole = whole
        self.model = whole.model
        #: from the character of each byte's number to that of the byte-level alphabet
        self.spell = dict(enumerate(table))
        self.width = np.dtype("u2" if max(self.bytes_of) < 1 << 16 else "u4")
        self.fast = pattern == public_tokenizers.PATTERN
        self.cache: dict[str, bytes] = {}
        self.cache_entries = cache_entries
        self.cache_bytes = 0
        self.pieces = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.decimals = [b"%d" % i for i in range(len(self.pieces))]

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The ids of each text, as arrays of unsigned integers."""
        texts = [t or "" for t in texts]
        out: list = [None] * len(texts)
        split, odd = {}, []
        for k, t in enumerate(texts):
            if self.fast and not _UNUSUAL.search(t) and not any(map(t.__contains__, self.added)):
                split[k] = _SPLIT.findall(t)
            else:
                odd.append(k)
        unseen: set[str] = set()
        for parts in split.values():
            unseen.update(parts)
        unseen.difference_update(self.cache)
        tokenize, spell, width = self.model.tokenize, self.spell, self.width.char
        passing = []  # kept for this batch only
        for part in unseen:  # merges of one pre-token; whole texts would be split again
            own = self.cache[part] = array(width, [t.id for t in tokenize(part.encode().decode("latin-1").translate(spell))]).tobytes()
            if len(self.cache) - len(passing) > self.cache_entries or self.cache_bytes + len(part) + len(own) > CACHE_BYTES:
                passing.append(part)
            else:
                self.cache_bytes += len(part) + len(own)
        find = self.cache.__getitem__
        for k, own in split.items():
            out[k] = np.frombuffer(b"".join(map(find, own)), dtype=self.width)
        for part in passing:
            del self.cache[part]
        for k, got in zip(odd, self.whole.encode_batch_fast([texts[k] for k in odd], add_special_tokens=False)):
            out[k] = np.array(got.ids, dtype=self.width)
        return out

    def offsets(self, text: str | None, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte and character (start, end) of every id in text.

        A character split over several ids is in the span of each of them: a span starts at the
        character of its first byte and ends after the character of its last byte.
        """
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        ends = np.cumsum([len(self.pieces[i]) for i in ids], dtype=np.int64) if len(ids) else np.zeros(0, np.int64)
        starts = np.concatenate([ends[:0] if not len(ends) else [0], ends[:-1]]).astype(np.int64)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
        spans = np.stack([char_of[starts], char_of[ends - 1] + 1], axis=1) if len(ids) else np.zeros((0, 2), np.int64)
        return np.stack([starts, ends], axis=1), spans

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """The bytes that the ids stand for; also right where ids split a character."""
        return b"".join(map(self.pieces.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids; bytes of a cut-off character become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text id by id; a character split over ids comes whole with its last id."""
        import codecs

        reader = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield reader.decode(self.pieces[i])
        yield reader.decode(b"", True)


_LOADED: dict[tuple, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """One coder a worker process and vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """(doc_id, ids, and with offsets: byte_spans and char_spans as flat start, end lists) of whole texts."""
    kind = docs.schema[id_col].dataType.simpleString()
    extra = ", byte_spans array<bigint>, char_spans array<bigint>" if offsets else ""

    def run(batches):
        coder = loaded(vocabulary)
        for part in bounded(batches, 1000, 4_000_000, text_col):
            texts = part.column(text_col).to_pylist()
            ids = coder.encode(texts)
            cols = [part.column(id_col), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))]
            names = [id_col, "ids"]
            if offsets:
                both = [coder.offsets(t, i) for t, i in zip(texts, ids)]
                cols += [pa.array([b.ravel() for b, _ in both], pa.list_(pa.int64())), pa.array([c.ravel() for _, c in both], pa.list_(pa.int64()))]
                names += ["byte_spans", "char_spans"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return spread(docs.select(id_col, text_col)).mapInArrow(run, f"{id_col} {kind}, ids array<int>{extra}")


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary, text) of lists of ids; null ids decode to no bytes."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = loaded(vocabulary)
        for part in batches:
            raw = [coder.decode_bytes(i or ()) for i in part.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw])], [id_col, "decoded", "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {kind}, decoded binary, text string")


def round_trip_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each whole text: n_tokens, and digests of the decimal ids and of the decoded bytes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = loaded(vocabulary)
        for part in bounded(batches, 500, 2_000_000, text_col):
            counts, told, back = [], [], []
            for ids in coder.encode(part.column(text_col).to_pylist()):
                ids = ids.tolist()
                counts.append(len(ids))
                told.append(hashlib.sha256(b" ".join(map(coder.decimals.__getitem__, ids))).hexdigest())
                back.append(hashlib.sha256(coder.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(counts, pa.int64()), pa.array(told), pa.array(back)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return spread(docs.select(id_col, text_col)).mapInArrow(run, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
