"""Byte-level BPE: a priority queue of merge ranks over a doubly linked symbol list; decoding by concatenation.

Texts are split into special tokens and pre-tokens; each pre-token is a list of byte symbols, linked both
ways, whose adjacent pairs wait in a heap by merge rank. The lowest rank is merged first; a heap entry whose
pair has changed meanwhile is stale and skipped. Results are kept per pre-token in tables of at most
``CACHE`` entries for each worker, which changes speed but not results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 250_000
#: Rows whose ids and decoded texts a worker holds at once.
SLICE = 400
#: A vocabulary file above this many bytes is refused: it is sent to every executor.
MAX_VOCABULARY_BYTES = 64 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def refuse_others(d: dict) -> None:
    """An error for files that ask for more than this module does: byte-level pre-tokens, no normalizer, plain special tokens."""
    pre, model = d.get("pre_tokenizer") or {}, d["model"]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    flags = [t["content"] for t in d.get("added_tokens", []) if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or not t.get("special", True)]
    extra = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if d.get("normalizer") or not plain or flags or extra or model.get("type", "BPE") != "BPE":
        raise ValueError(f"not a plain byte-level vocabulary: normalizer {d.get('normalizer')}, pre-tokenizer {pre}, tokens {flags}, options {extra}")


class Mixed(Exception):
    """A text has white space other than single spaces around a chunk."""


class Vocabulary:
    """Merge ranks and byte strings of a vocabulary file in the tokenizers library's JSON form."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        refuse_others(d)
        to_byte = byte_alphabet()
        ids = d["model"]["vocab"]
        as_bytes = lambda t: bytes(to_byte[c] for c in t)
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for t, i in ids.items():
            if t not in self.special:
                self.pieces[i] = as_bytes(t)
        for t, i in self.special.items():
            self.pieces[i] = t.encode()
        self.of_byte = [ids[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(d["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[ids[a], ids[b]] = rank, ids[a + b]
        self.split = regex.compile(PRETOKEN)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # Two generations each: what is used again within one moves on to the next, the rest goes.
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.spaced_before: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        sym = [self.of_byte[b] for b in data]
        n, merges = len(sym), self.merges
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            if found := merges.get((sym[i], sym[i + 1])):
                queue.append((found[0], i, sym[i], sym[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, joined = heapq.heappop(queue)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # stale: one of the two has been merged since
            sym[i], sym[j] = joined, -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if found := merges.get((joined, sym[k])):
                    heapq.heappush(queue, (found[0], i, joined, sym[k], found[1]))
            if (h := left[i]) >= 0 and (found := merges.get((sym[h], joined))):
                heapq.heappush(queue, (found[0], h, sym[h], joined, found[1]))
        return [s for s in sym if s >= 0]

    def _learn(self, piece: str) -> bytes:
        out = self.known_before.get(piece)
        if out is None:
            out = np.asarray(self.merge(piece.encode()), "<u4").tobytes()
        if len(self.known) >= CACHE // 4:
            self.known_before, self.known = self.known, {}
        self.known[piece] = out
        return out

    def _pieces(self, text: str) -> bytes:
        get, learn = self.known.get, self._learn
        return b"".join([get(p) or learn(p) for p in self.split.findall(text)])

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a space and ``chunk``; ``Mixed`` if the chunk's pre-tokens depend on what stands around it."""
        if chunk == "" or chunk[0].isspace() or chunk[-1].isspace():
            raise Mixed
        out = self.spaced_before.get(chunk)
        if out is None:
            out = self._pieces(" " + chunk)
        if len(self.spaced) >= CACHE:
            self.spaced_before, self.spaced = self.spaced, {}
        self.spaced[chunk] = out
        return out

    def _plain(self, text: str) -> bytes:
        """Where single spaces part chunks without outer white space, each with its space is a run of whole pre-tokens."""
        head, *tail = text.split(" ")
        if tail and head and not head[-1].isspace():
            get, chunk = self.spaced.get, self._chunk
            try:
                return self._pieces(head) + b"".join([get(c) or chunk(c) for c in tail])
            except Mixed:
                pass
        return self._pieces(text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; strings of special tokens become their ids."""
        if not self.at_special or not self.at_special.search(text):
            return self._plain(text)
        parts = self.at_special.split(text)
        return b"".join(np.asarray([self.special[p]], "<u4").tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        """The text of ids: their byte strings in a row, read as UTF-8 (what is not UTF-8 becomes U+FFFD)."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _vocabulary(spec: str) -> Vocabulary:
    return Vocabulary(spec)


def read_vocabulary(path: str) -> str:
    """The vocabulary file's text, read once on the driver; its size is checked as it goes to every executor."""
    with open(path, encoding="utf-8") as f:
        spec = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(spec) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return spec


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", digests: bool = False, proof: bool = False) -> DataFrame:
    """Per row of ``docs``: the id, ids (array of int) and the decoded text, or with ``digests`` their counts and SHA-256.

    With ``proof`` only the ids return: every text is decoded and held against its source, and one that differs is an error.

    Null texts count as empty: no ids, empty decoded text. Repeated rows have equal results, null ids stay, other columns of
    ``docs`` play no part, an empty table gives no rows. No shuffle; rows stay in their partitions and are handled one by
    one, so that memory follows the longest text. Document ids pass as strings, as integers with nulls would become floats.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = "i string, " + ("n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>" + ", decoded string" * (not proof))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = _vocabulary(spec.value)
        for b in (whole.iloc[at : at + SLICE] for whole in batches for at in range(0, len(whole), SLICE)):
            ids = [v.encode(t or "") for t in b["t"]]
            back = [v.decode(i) for i in ids]
            out = {"i": b["i"]}
            if proof and (lost := [i for i, t, x in zip(b["i"], b["t"], back, strict=True) if x != (t or "")]):
                raise ValueError(f"{len(lost)} texts do not survive encoding and decoding, the first of {id_col} {lost[0]}")
            if digests:
                out |= {"n_tokens": [len(i) // 4 for i in ids], "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids], "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in back]}
            else:
                out |= {"ids": [np.frombuffer(i, "<i4") for i in ids]} | ({} if proof else {"decoded": back})
            yield pd.DataFrame(out)

    out = docs.select(F.col(id_col).cast("string").alias("i"), F.col("text").alias("t")).mapInPandas(run, schema)
    return out.select(F.col("i").cast(kind).alias(id_col), *out.columns[1:])
