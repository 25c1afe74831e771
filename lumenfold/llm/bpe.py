"""Byte-level BPE encoding and decoding (operator 9).

A text is cut into pieces by the pre-tokeniser's pattern; the symbols of a piece form
a doubly linked list, and a priority queue of (merge rank, position) says which
neighbours to merge next. Entries whose symbols have changed since they were queued
are stale and skipped. Decoding concatenates the vocabulary's strings.

Null texts count as empty; an empty text has no tokens. Texts of any length are
encoded whole. The strings of added tokens in a text become those tokens, as the
tokenizers library does it. The vocabulary file is a parameter, read on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: The byte-level pre-tokeniser's pattern, with white space spelt out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Encoded pieces that a worker remembers, about 100 MB.
REMEMBERED = 1 << 19


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files: the byte's own
    character where that is printable in Latin-1, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def check_supported(data: dict) -> None:
    """Raises for parts of a tokenizers file that would change ids and aren't followed here."""
    model, pre = data["model"], data.get("pre_tokenizer") or {}
    faults = [f"model {model.get('type')}"] if model.get("type", "BPE") != "BPE" else []
    faults += [f"normalizer {data['normalizer'].get('type')}"] if data.get("normalizer") else []
    faults += [f"pre_tokenizer {pre.get('type')}"] if pre.get("type") != "ByteLevel" else []
    faults += [k for k, plain in (("add_prefix_space", False), ("use_regex", True)) if pre.get(k, plain) != plain]
    faults += [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
    faults += [f"{k} of token {t['content']!r}" for t in data.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip") if t.get(k)]
    if faults:
        raise ValueError("not supported: " + ", ".join(faults))


class Bpe:
    """encode() and decode() with the vocabulary of a tokenizers JSON file."""

    def __init__(self, spec: bytes):
        data = json.loads(spec)
        check_supported(data)
        vocab: dict[str, int] = data["model"]["vocab"]
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        self.byte_id = [vocab[c] for c in letters]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.strings = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for token, i in vocab.items():
            self.strings[i] = bytes(value[c] for c in token)
        for token, i in added.items():
            self.strings[i] = token.encode()
        self.added = added
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pieces = regex.compile(PATTERN).findall
        self.known: dict[str, bytes] = {}

    def merge_piece(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        ids = [self.byte_id[b] for b in piece]
        n, merges = len(ids), self.merges
        if n < 2:
            return ids
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapify(queue)
        while queue:
            _, i, left, right, new = heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: a neighbour was merged meanwhile
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heappush(queue, (m[0], i, new, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))):
                heappush(queue, (m[0], h, ids[h], new, m[1]))
        return [x for x in ids if x >= 0]

    def _packed(self, piece: str) -> bytes:
        out = np.array(self.merge_piece(piece.encode()), dtype="<u4").tobytes()
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(piece) < 64:
            self.known[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, packed = self.known.get, self._packed
        if self.split_added and any(t in text for t in self.added):
            parts = self.split_added.split(text)
            return b"".join(self.added[p].to_bytes(4, "little") if i % 2 else b"".join([known(w) or packed(w) for w in self.pieces(p)]) for i, p in enumerate(parts))
        return b"".join([known(w) or packed(w) for w in self.pieces(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[int, Bpe] = {}


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_tokens, ids (packed), decoded; row for row.

    vocabulary: path of a tokenizers JSON file, readable on the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as f:
        spec = f.read()
    sent, name = spark.sparkContext.broadcast(spec), hash(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _LOADED.get(name)
        if bpe is None:
            bpe = _LOADED[name] = Bpe(sent.value)
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < len(texts):
                ids, decoded, size = [], [], 0
                start = at
                while at < len(texts) and size < 1 << 23:
                    ids.append(bpe.encode(texts[at].as_py() or ""))
                    decoded.append(bpe.decode(ids[-1]))
                    size += len(decoded[-1])
                    at += 1
                text = pa.array([d.decode("utf-8", "replace") for d in decoded], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, at - start), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), text], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids binary, decoded string")


def digest(encoded: DataFrame) -> DataFrame:
    """The columns of query op9."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
