"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never lie inside an
encoded token, so a cut between its two bytes is certain.  Each pre-token is
cut at all such pairs, the fragments are merged independently (and remembered,
since short fragments recur far more often than whole words), and their ids
are concatenated.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from .base import small_batches

#: Fixed value: the pattern of byte-level BPE that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the same pattern for texts of the first 256 code points, with its classes written out.
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
NARROW_PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"

#: Entries that a memory of encoded pieces may hold before it is emptied.
MEMORY = 300_000
#: Longer pieces are not remembered.
LONGEST_KEPT = 64


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteBpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.new_of = [vocab[a + b] for a, b in pairs]
        self.no_rank = len(pairs)
        self.single = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.inside = np.zeros((256, 256), bool)
        for i, token in self.bytes_of.items():
            if len(token) > 1 and i not in self.special.values():
                raw = np.frombuffer(token, np.uint8)
                self.inside[raw[:-1], raw[1:]] = True
        self.inside_rows = [row.tobytes() for row in self.inside]
        self.split = regex.compile(PATTERN).findall
        self.split_narrow = re.compile(NARROW_PATTERN).findall
        self.by_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces: dict[str, bytes] = {}
        self.fragments: dict[bytes, bytes] = {}

    def cuts(self, raw: bytes) -> list[int]:
        """Places between two bytes that no token holds side by side."""
        rows = self.inside_rows
        return [k for k in range(1, len(raw)) if not rows[raw[k - 1]][raw[k]]]

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one fragment: merge the lowest-ranked adjacent pair, leftmost first, until none is left."""
        ids = [self.single[b] for b in raw]
        if len(ids) > 128:
            return self._merge_long(ids)
        get, none, new = self.ranks.get, self.no_rank, self.new_of
        ranks = [get(pair, none) for pair in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != none:
            k = ranks.index(best)
            ids[k : k + 2] = [new[best]]
            del ranks[k]
            if k:
                ranks[k - 1] = get((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = get((ids[k], ids[k + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for a long fragment, by a heap over linked neighbours, in n log n."""
        import heapq

        n, get = len(ids), self.ranks.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        live = [True] * n
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = after[k]
            if not live[k] or j < 0 or ids[k] != a or ids[j] != b:
                continue
            ids[k], live[j], after[k] = self.new_of[rank], False, after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (r := get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [i for i, on in zip(ids, live) if on]

    def _fragment(self, raw: bytes) -> bytes:
        ids = self.fragments.get(raw)
        if ids is None:
            ids = struct.pack(f"<{len(found := self.merge(raw))}I", *found)
            if len(raw) <= LONGEST_KEPT:
                if len(self.fragments) >= MEMORY:
                    self.fragments.clear()
                self.fragments[raw] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        at = [0, *self.cuts(raw), len(raw)]
        if len(at) == 2:
            ids = struct.pack(f"<{len(found := self.merge(raw))}I", *found)
        else:
            ids = b"".join([self._fragment(raw[a:b]) for a, b in zip(at, at[1:])])
        if len(raw) <= LONGEST_KEPT:
            if len(self.pieces) >= MEMORY:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        get, make = self.pieces.get, self._piece
        try:
            text.encode("latin-1")
            split = self.split_narrow
        except UnicodeEncodeError:
            split = self.split
        return b"".join([get(p) or make(p) for p in split(text)])

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.by_special is None or not self.by_special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.by_special.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """Text of the ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of (doc_id, text).

    ``path`` names the vocabulary file on every executor.  Null text is empty
    text (no tokens).  Rows stay as they are: null or repeated ids too.  With
    ``with_ids`` the columns ids (binary, little-endian 32 bits) and decoded
    follow.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = bpe.encode(text or "")
                decoded = bpe.decode(ids)
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append((*row, ids, decoded) if with_ids else row)
            out = pd.DataFrame(rows, columns=columns)
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    columns = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids
    return small_batches(docs.select("doc_id", "text")).mapInPandas(run, schema)
