"""Packing of documents into sequences of a fixed window by best-fit decreasing.

A document is tokenised whole and cut into full windows and a rest; pieces are the unit of packing.
Pieces go to shards of bounded size, in which they are placed longest first: a segment tree indexed
by remaining capacity finds the tightest open window that still takes the piece.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import shipped, whole
from loglattice.plans.durable import written

PIECES = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long"
#: Words of which a Python worker remembers the ids; beyond, those that were not met since the last time are forgotten.
WORD_CACHE = 400_000
#: Pieces that one task packs at once.
SHARD_PIECES = 50_000


#: Texts whose only characters beyond ASCII are letters, and which ``lower`` maps letter by letter.
PLAIN = re.compile("[\0-\x7fÀ-ÖØ-öø-ɏ]*")
#: Bytes as letters and digits (l), white space (blank), and the rest (p).
KINDS = bytes(ord("l") if b >= 128 or chr(b).isalnum() else ord(" ") if b in b" \t\n\r\x0b\x0c" else ord("p") for b in range(256))
BEFORE_SIGN = re.compile("(?<=[0-9a-zß-ɏ])(?=[^\\s0-9a-zß-ɏ])")


def words(text: str) -> list[str]:
    """Parts of a text whose ids, one after the other, are those of the text.

    The tokenizer lower-cases, drops white space, and begins a new token where a letter or digit meets
    another sign.  So a text is cut at blanks, and, if it is plain, lower-cased and cut before signs.
    """
    if "<|" not in text and PLAIN.fullmatch(text):
        kinds = text.encode().translate(KINDS)
        text = text.lower()
        if b"pp" in kinds:
            text = BEFORE_SIGN.sub(" ", text)
        else:  # no run of signs that this would cut
            text = text.replace(",", " ,").replace(".", " .")
    return text.replace("\n", " ").split(" ")


class WordIds:
    """Ids of whole texts, put together from those of their parts, each of which is tokenised once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def learn(self, parts: set[str]) -> None:
        if len(self.known) + len(parts.difference(self.known)) > WORD_CACHE:
            self.older, self.known = self.known, {"": b""}
        new = parts.difference(self.known)
        again = new.intersection(self.older)
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        new = list(new.difference(again))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[w] = pack_ids(e.ids)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [words(t) for t in texts]
        self.learn(set().union(*split))
        for parts in split:
            yield b"".join(map(self.known.__getitem__, parts))


_BY_PATH: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _BY_PATH:
        _BY_PATH[path] = WordIds(path)
    return _BY_PATH[path]


def pieces(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Pieces of every row of ``docs`` (doc_id, text): full windows and the rest that is left over.

    A null text is empty and has the end id alone.  Repeated rows give repeated pieces.
    """
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_ids(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                out = []
                for doc, ids in zip(part["doc_id"], encoder.encode(part["text"].tolist())):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        own = ids[4 * start : 4 * (start + window)]
                        out.append((doc, start, len(own) // 4, own if with_ids else None, zlib.crc32(own), n))
                got = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens"])
                got["doc_id"] = got["doc_id"].astype("Int64")
                yield got

    return shipped(docs).select(F.col("doc_id").cast("long"), whole("text").alias("text")).mapInPandas(cut, PIECES)


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree of counts."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, change: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += change
            node >>= 1

    def put(self, capacity: int, name: int) -> None:
        self.at[capacity].append(name)
        self._add(capacity, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the window with the smallest capacity of at least ``need``."""
        count, node = self.count, need + self.size
        if not count[node]:
            while node > 1 and not (node % 2 == 0 and count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._add(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece, placed in decreasing order of length."""
    tree, opened = OpenWindows(window), 0
    where, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        found = tree.tightest(need)
        if found is None:
            found, opened = (window, opened), opened + 1
        capacity, name = found
        where[i], offset[i] = name, window - capacity
        if capacity > need:
            tree.put(capacity - need, name)
    return where, offset


def assign(cut: DataFrame, window: int = 2048, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to every piece; other columns are carried along.

    ``cut`` is read twice (its size, its rows), so pass a table.  Pieces are dealt out by a hash of all
    that identifies them; a shard holds about ``shard_pieces``.  Windows of a shard have numbers of
    their own: shard number plus a multiple of the number of shards.
    """
    shards = max(1, -(-cut.count() // shard_pieces))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        where, offset = best_fit(rows["length"].to_numpy(), window)
        return rows.assign(sequence_id=where * shards + rows["__shard"].iloc[0], offset=offset).drop(columns="__shard")

    key = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return shipped(cut).withColumn("__shard", key).groupBy("__shard").applyInPandas(place, out + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Packed pieces of every document, without their ids: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.  A sequence is padded to ``window`` unless its length is a power of two."""
    cut = pieces(docs, tokenizer, window, end_id, with_ids=False).drop("ids")
    return assign(written(cut, "packing-pieces"), window)


def pack_sequences(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, shard_pieces: int = 3_000) -> DataFrame:
    """One row per sequence: sequence_id, ids (array of ints, without padding), doc_ids, lengths, padding.

    A sequence is padded to ``window``, unless its length is a power of two.  Pieces travel once, with
    their ids; their shard places them and puts the sequences together.
    """
    cut = written(pieces(docs, tokenizer, window, end_id).select("doc_id", "start", "length", "ids", "ids_crc32"), "packing-pieces")
    shards = max(1, -(-cut.count() // shard_pieces))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        where, offset = best_fit(rows["length"].to_numpy(), window)
        order = np.lexsort((offset, where))
        edges = [*np.flatnonzero(np.append(True, np.diff(where[order]) != 0)).tolist(), len(order)]
        ids, doc_ids, lengths = rows["ids"].to_numpy(), rows["doc_id"].to_numpy(), rows["length"].to_numpy()
        shard, out = int(rows["__shard"].iloc[0]), []
        for lo, hi in zip(edges, edges[1:]):
            own = order[lo:hi]
            used = int(lengths[own].sum())
            tokens = np.frombuffer(b"".join(ids[own].tolist()), dtype="<u4").astype(np.int32)
            known = [None if pd.isna(d) else int(d) for d in doc_ids[own]]
            padding = 0 if used & (used - 1) == 0 else window - used
            out.append((int(where[own[0]]) * shards + shard, tokens, known, lengths[own].tolist(), padding))
        return pd.DataFrame(out, columns=["sequence_id", "ids", "doc_ids", "lengths", "padding"])

    key = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards))
    schema = "sequence_id long, ids array<int>, doc_ids array<long>, lengths array<int>, padding int"
    return shipped(cut).withColumn("__shard", key).groupBy("__shard").applyInPandas(build, schema)
