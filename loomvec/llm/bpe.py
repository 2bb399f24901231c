"""Byte-level BPE encoding and decoding over Arrow batches.

A byte-level vocabulary writes every byte as one printable character. Each batch
is split into pre-tokens; the distinct ones not met before go through the
tokenizers library once, and the documents are assembled from them by gathering
in NumPy, so repeated words cost no further merges. Decoding reverses the byte
table, joins the bytes of all tokens and only then reads UTF-8, so a character
split between tokens comes back whole.

A vocabulary whose normaliser, pre-tokens or model are of another kind is refused: its ids
would be others.

Defined results: a null text gives null lists, n_tokens 0 and round_trip true;
an empty text gives empty lists. Very long texts count whole; an empty table gives no rows. Strings of special tokens are ordinary text.
Extra columns are ignored; repeated rows give repeated results."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomvec.llm.textarrays import lean, text_slices

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bounds on a worker's store of encoded pre-tokens and on the bytes taken at once; they change no result.
STORE, SLICE = 400_000, 1_000_000

ENCODED = "n_tokens int, token_ids array<int>, char_start array<int>, char_end array<int>, round_trip boolean"


@lru_cache(1)
def byte_alphabet() -> dict[str, int]:
    """Character to byte of the byte-level alphabet: printable Latin-1 stands for
    itself, the other 68 bytes follow in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """One vocabulary with its byte table and the pre-tokens encoded so far."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        letters = byte_alphabet()
        vocabulary = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        special = {t["id"] for t in spec.get("added_tokens", [])}
        table = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            table[i] = piece.encode() if i in special else bytes(letters[c] for c in piece)
        self.sizes = np.array([len(b) for b in table], dtype=np.int32)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.split = regex.compile(PATTERN).findall
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.flat_from, self.flat_n = np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pre-tokens not met before. Those that begin with one space are
        split alike when joined, so they go through the library together."""
        spaced = [p for p in pieces if len(p) > 1 and p[0] == " " and not p[1].isspace()]
        rest = [p for p in pieces if not (len(p) > 1 and p[0] == " " and not p[1].isspace())]
        groups = [spaced[i : i + 2000] for i in range(0, len(spaced), 2000)]
        ids, n = [], []
        for group, e in zip(groups, self.library.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
            ids.append(np.array(e.ids, dtype=np.int32))
            first = np.flatnonzero(self.bytes[self.starts[ids[-1]]] == 0x20)  # the only spaces are those that begin a pre-token
            assert len(first) == len(group)
            n.append(np.diff(first, append=len(ids[-1])))
        for e in self.library.encode_batch_fast(rest, add_special_tokens=False):
            ids.append(np.array(e.ids, dtype=np.int32))
            n.append(np.array([len(e.ids)]))
        fresh = np.concatenate(n).astype(np.int64)
        self.known.update(zip(chain(spaced, rest), count(len(self.known))))
        self.flat_from = np.concatenate([self.flat_from, len(self.flat) + np.cumsum(fresh) - fresh])
        self.flat_n = np.concatenate([self.flat_n, fresh])
        self.flat = np.concatenate([self.flat, *ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All token ids one after another, and how many each text has."""
        pieces = [self.split(t) for t in texts]
        new = set().union(*pieces).difference(self.known) if pieces else set()
        if len(self.known) + len(new) > STORE:
            self._clear()
            new = set().union(*pieces)
        if new:
            self._learn(list(new))
        known = self.known
        per_text = np.fromiter(map(len, pieces), np.int64, len(pieces))
        which = np.fromiter(map(known.__getitem__, chain.from_iterable(pieces)), np.int64, int(per_text.sum()))
        ids = gather(self.flat, self.flat_from[which], self.flat_n[which])
        ends = np.concatenate([[0], np.cumsum(self.flat_n[which])])
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        return ids, np.diff(ends[bounds])

    def counts(self, texts: list[str]) -> np.ndarray:
        """How many tokens each text has."""
        return self.encode(texts)[1]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, joined."""
        return gather(self.bytes, self.starts[ids], self.sizes[ids].astype(np.int64))


def gather(source: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """source[start:start+n] of each pair, one after another."""
    total = int(n.sum())
    if not total:
        return source[:0]
    shift = start - (np.cumsum(n) - n)
    at = np.repeat(shift, n)
    at += np.arange(total)
    return source[at]


@lru_cache(2)
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


def _offsets(lead: np.ndarray, byte_n: np.ndarray, text_first: np.ndarray, token_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters that each token touches, counted from its text's start: one that
    begins or ends inside a character counts that character."""
    chars = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    end = np.cumsum(byte_n, dtype=np.int64)
    begin = end - byte_n
    base = np.repeat(chars[text_first], token_n)
    return (chars[begin + 1] - 1 - base).astype(np.int32), (chars[end] - base).astype(np.int32)


def encode_slice(bpe: ByteBpe, texts: list[str | None]) -> list[pa.Array]:
    """The columns of ENCODED for some texts."""
    null = np.array([t is None for t in texts], dtype=bool)
    ids, n = bpe.encode([t or "" for t in texts])
    joined = "".join(t or "" for t in texts).encode("utf-8", "surrogatepass")
    source = np.frombuffer(joined, dtype=np.uint8)
    decoded = bpe.decode(ids)
    byte_n = bpe.sizes[ids].astype(np.int64)
    token_end = np.concatenate([[0], np.cumsum(n)])
    byte_end = np.concatenate([[0], np.cumsum(byte_n)])[token_end]
    sizes = np.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    if len(decoded) == len(source) and np.array_equal(byte_end, first) and np.array_equal(decoded, source):
        same = np.ones(len(texts), dtype=bool)
    else:
        same = np.array([decoded[a:b].tobytes() == joined[c:d] for a, b, c, d in zip(byte_end, byte_end[1:], first, first[1:])], dtype=bool)
    start, end = _offsets((decoded & 0xC0) != 0x80, byte_n, byte_end[:-1], n)
    offsets = pa.array(token_end.astype(np.int32))
    mask = pa.array(null)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v), mask=mask) for v in (ids, start, end)]
    return [pa.array(n.astype(np.int32)), *lists, pa.array(same)]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """id_col, n_tokens, token_ids, char_start, char_end and round_trip per row.

    Token i covers characters char_start[i] to char_end[i] of its text; round_trip
    tells that decoding the ids gives back the very text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1), SLICE):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *encode_slice(bpe, texts)], names=names)

    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"`{id_col}` {dict(chosen.dtypes)['id']}, {ENCODED}"
    names = [id_col, "n_tokens", "token_ids", "char_start", "char_end", "round_trip"]
    return chosen.mapInArrow(run, schema)


def with_counts(docs: DataFrame, out_col: str, text_col: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """docs with the number of tokens of each text, 0 for null."""
    at = docs.columns.index(text_col)
    schema = docs.withColumn(out_col, F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for a, b, texts in text_slices(batch.column(at), SLICE):
                n = pa.array(bpe.counts([t or "" for t in texts]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, n], names=schema.names)

    return docs.mapInArrow(lean(run, vocabulary), schema)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """id_col and text. Null ids give a null text; bytes that form no character
    become U+FFFD; an id outside the vocabulary is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            lists = batch.column(1).to_pylist()
            texts = [None if x is None else bpe.decode(np.asarray(x, dtype=np.int64)).tobytes().decode("utf-8", "replace") for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    chosen = tokens.select(tokens[id_col].alias("id"), tokens[ids_col].alias("ids"))
    return chosen.mapInArrow(run, f"`{id_col}` {dict(chosen.dtypes)['id']}, text string")
