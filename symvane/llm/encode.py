"""Encoding of a corpus with a public byte-level BPE vocabulary.

A text is split by the vocabulary's pattern; the distinct pieces of a batch that the task has
not met yet are encoded together. Their bytes lie in one linked token list, and an index maps
each adjacent pair's rank to all positions where the pair occurs. Ranks are applied in
ascending order from a heap; each merge updates the lists of the two neighbouring pairs. A
piece of n bytes costs O(n log n), however long it is.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symvane.runtime import spread

#: Where the vocabulary files of public tokenizers lie.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces a task keeps; when full the memory starts anew (results don't depend on it).
MEMORY = 400_000
#: Longest piece, in bytes, that is kept.
MEMORY_BYTES = 256


class Vocabulary:
    """Ranks of byte strings, from the lines `base64 rank` of a vocabulary file."""

    def __init__(self, lines: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line.strip())}
        self.bytes = {i: b for b, i in self.rank.items()}
        self.single = [self.rank[bytes([i])] for i in range(256)]
        self._pairs: dict[tuple[int, int], int] = {}

    def pair(self, a: int, b: int) -> int:
        """Rank of the merge of two tokens, -1 if there is none."""
        found = self._pairs.get((a, b))
        if found is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            found = self._pairs[a, b] = self.rank.get(self.bytes[a] + self.bytes[b], -1)
        return found

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece."""
        out: list[list[int]] = [[]] * len(pieces)
        todo = []
        for i, p in enumerate(pieces):
            whole = self.rank.get(p)
            if whole is not None:
                out[i] = [whole]
            elif p:
                todo.append(i)
        token: list[int] = []
        starts = []
        for i in todo:
            starts.append(len(token))
            token.extend(map(self.single.__getitem__, pieces[i]))
        n = len(token)
        starts.append(n)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        for s in starts[:-1]:
            before[s] = -1
        for s in starts[1:]:
            after[s - 1] = -1
        pair, where = self.pair, {}
        for i in range(n - 1):
            if after[i] >= 0:
                r = pair(token[i], token[i + 1])
                if r >= 0:
                    where.setdefault(r, []).append(i)
        active = list(where)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            places = where.pop(r, None)
            if places is None:
                continue
            places.sort()
            done, lower = 0, False
            while done < len(places) and not lower:
                i = places[done]
                done += 1
                j = after[i] if token[i] >= 0 else -1
                if j < 0 or pair(token[i], token[j]) != r:
                    continue  # an earlier merge took one of the two
                token[i], token[j] = r, -1
                prv, nxt = before[i], after[j]
                after[i] = nxt
                if nxt >= 0:
                    before[nxt] = i
                for left, right in ((prv, i), (i, nxt)):
                    if left >= 0 and right >= 0 and (q := pair(token[left], token[right])) >= 0:
                        if q not in where:
                            where[q] = []
                            heapq.heappush(active, q)
                        where[q].append(left)
                        lower |= q <= r
            if done < len(places):  # a pair of lower or equal rank came up: it may go first
                if r not in where:
                    where[r] = []
                    heapq.heappush(active, r)
                where[r] += places[done:]
        for i, (s, e) in zip(todo, zip(starts, starts[1:])):
            out[i] = [t for t in token[s:e] if t >= 0]
        return out


def vocabulary_file(path: str) -> bytes:
    """The bytes of a vocabulary file."""
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """Encodes texts; keeps the ids of pieces it has met."""

    def __init__(self, lines: bytes | None = None):
        self.vocabulary = Vocabulary(vocabulary_file(VOCABULARY) if lines is None else lines)
        self.find = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.find(t) if t else [] for t in texts]
        new = {p for pieces in split for p in pieces if p not in self.known}
        if new:
            order = sorted(new)
            if len(self.known) + len(order) > MEMORY:
                self.known.clear()
                order = sorted({p for pieces in split for p in pieces})
            met = dict(zip(order, self.vocabulary.merge([p.encode("utf-8", "surrogatepass") for p in order])))
        else:
            met = {}
        long = {p for p in met if len(p) > MEMORY_BYTES}
        self.known.update((p, ids) for p, ids in met.items() if p not in long)
        known, out = self.known, []
        for pieces in split:
            ids: list[int] = []
            for p in pieces:
                ids += met[p] if p in long else known[p]
            out.append(ids)
        return out


def encode(docs: DataFrame, id_col: str, text_col: str, as_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """One row (id, ids) per row of docs: the ids of the whole text, without special tokens.

    Empty and null texts have the empty list of ids. Strings of special tokens inside a text are ordinary
    text. Repeated rows come out as often as they are given, a null id stays null, other columns are left out.
    The vocabulary file is read by the driver and sent to the tasks (its size is fixed, below a megabyte).
    """
    slim = spread(docs.select(F.col(id_col), F.col(text_col).alias("__text")))
    schema = T.StructType([slim.schema[0], T.StructField(as_col, T.ArrayType(T.IntegerType(), False))])

    lines = slim.sparkSession.sparkContext.broadcast(vocabulary_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(lines.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = encoder.encode_batch(part.column(1).to_pylist())
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=ends[1:])
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, as_col])

    return slim.mapInArrow(run, schema)
