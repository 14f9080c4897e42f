"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes symbols (code points, the blank written as U+2581).  An agenda holds the adjacent pairs
whose concatenation is a piece, ordered by score and then by position; the best pair is merged and
its new neighbours enter the agenda, until none is left.  Symbols that are no piece become bytes.  Short
units go through it side by side: an agenda is then a row of ranks, whose first least entry is its top.

A merge never joins two characters that no piece has side by side.  So a text falls into units that can
be encoded one by one, and each distinct unit is encoded once and remembered: no piece has a blank after
another character, and none has a letter or digit before most punctuation, or anything beside a line end.  In each Arrow batch the units
that are new are checked against the sentencepiece library, ids and decoded text alike.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import shipped, whole

BLANK = "▁"
UNIT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: Marks a unit that does not begin with a blank.
GLUE = "\0"
ALPHANUMERIC = "0-9A-Za-zÀ-ɏ"
PUNCTUATION = ",.!?|%$#*&;:"
#: Units that a Python worker remembers; it starts anew beyond.
UNIT_CACHE = 1_200_000
#: Longer units go through an agenda of their own.
SHORT = 40
NEVER = 1 << 40


class MergeVocabulary:
    """Pieces, scores and the agenda of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.library = lib
        size = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(size)]
        self.unknown = lib.unk_id()
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(names) if not special[i]}
        order = {score: n for n, score in enumerate(sorted({lib.get_score(i) for i in self.ids.values()}, reverse=True))}
        self.rank = {p: order[lib.get_score(i)] for p, i in self.ids.items()}
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids):
            raise ValueError("a piece goes on after a blank: units cannot be encoded apart")
        side_by_side = {(a, b) for p in self.ids for a, b in zip(p, p[1:])}
        before = lambda c: {a for a, b in side_by_side if b == c}
        alone = [c for c in PUNCTUATION if not any(re.match(f"[{ALPHANUMERIC}]", a) for a in before(c))]
        self.cut = re.compile(f"([{ALPHANUMERIC}])([{re.escape(''.join(alone))}])") if alone else None
        self.lines = not any("\n" in pair for pair in side_by_side)
        self.byte = {int(names[i][3:5], 16): i for i in range(size) if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.names = names
        self.digits = [str(i) for i in range(size)]
        self._pairs(size)
        self.last_special = max((i for i in range(size) if special[i]), default=-1)
        self.hidden = {i for i in range(size) if lib.is_control(i)}
        # comma-joined ids of units, and the decoded text of those that do not decode to themselves
        self.known: dict[str, str] = {}
        self.decoded: dict[str, str] = {}

    def _pairs(self, size: int) -> None:
        """Tables of all pairs of symbols that make a piece; a character that is no piece has a number of its own."""
        self.other = size
        self.symbols = size + 0x110000
        number = np.arange(size, self.symbols, dtype=np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                number[ord(p)] = i
        self.of_char = number
        known = lambda p: int(number[ord(p)]) if len(p) == 1 else self.ids.get(p, -1)
        rows = []
        for p, i in self.ids.items():
            for at in range(1, len(p)):
                a, b = known(p[:at]), known(p[at:])
                if a >= 0 and b >= 0:
                    rows.append((a * self.symbols + b, self.rank[p], i))
        rows.sort()
        self.pair_key, pair_rank, self.pair_piece = (np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else (np.empty(0, np.int64),) * 3
        self.pair_rank = np.append(pair_rank, NEVER)

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of the pairs (a, b); that of no pair is the last."""
        key = a * self.symbols + b
        at = np.searchsorted(self.pair_key, key)
        none = len(self.pair_key)
        return np.where((a >= 0) & (b >= 0) & (self.pair_key[np.minimum(at, none - 1)] == key), at, none)

    def encode_side_by_side(self, units: list[str]) -> list[list[int]]:
        """Ids of units of the model's alphabet, all agendas one step at a time."""
        sizes = np.array([len(u) for u in units])
        codes = self.of_char[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        width = int(sizes.max()) + 1
        symbol = np.full((len(units), width), -1, dtype=np.int64)
        symbol[np.arange(width) < sizes[:, None]] = codes
        pair = self._lookup(symbol[:, :-1], symbol[:, 1:])
        out: list[list[int]] = [[] for _ in units]
        row = np.arange(len(units))
        columns = np.arange(width)
        while len(row):
            rank = self.pair_rank[pair]
            top = rank.argmin(axis=1)
            every = np.arange(len(row))
            open_ = rank[every, top] < NEVER
            for i in np.flatnonzero(~open_).tolist():
                out[row[i]] = symbol[i].tolist()
            row, symbol, pair, top = row[open_], symbol[open_], pair[open_], top[open_]
            if not len(row):
                break
            every = np.arange(len(row))
            symbol[every, top] = self.pair_piece[pair[every, top]]
            shift = np.minimum(columns + (columns > top[:, None]), width - 1)
            symbol = np.take_along_axis(symbol, shift, axis=1)
            symbol[:, -1] = -1
            pair = np.take_along_axis(pair, shift[:, :-1] - (shift[:, :-1] == width - 1), axis=1)
            pair[:, -1] = len(self.pair_key)
            pair[every, top] = self._lookup(symbol[every, top], symbol[every, np.minimum(top + 1, width - 1)])
            left = np.flatnonzero(top > 0)
            at = top[left] - 1
            pair[left, at] = self._lookup(symbol[left, at], symbol[left, at + 1])
        return [self._finish(x) for x in out]

    def _finish(self, symbols: list[int]) -> list[int]:
        ids = symbols[: symbols.index(-1)]
        if max(ids, default=0) < self.other:
            return ids
        done: list[int] = []
        for i in ids:
            if i < self.other:
                done.append(i)
            elif self.byte:
                done += [self.byte[b] for b in chr(i - self.other).encode("utf-8", "surrogatepass")]
            else:
                done.append(self.unknown)
        return done

    def encode_units(self, units: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(units)
        order = sorted(range(len(units)), key=lambda i: len(units[i]))
        for at in range(0, len(order), 2048):
            part = order[at : at + 2048]
            short = [i for i in part if len(units[i]) <= SHORT]
            for i, ids in zip(short, self.encode_side_by_side([units[i] for i in short]) if short else []):
                out[i] = ids
            for i in part[len(short) :]:
                out[i] = self.encode_unit(units[i])
        return out

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of a unit that is already in the model's alphabet.

        An entry of the agenda is a pair's rank and left position in one number.  It is out of date if
        the pair that now starts there has another rank.
        """
        rank, push, pop = self.rank.get, heapq.heappush, heapq.heappop
        symbol: list[str] = list(unit)
        n = len(symbol)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [r << 32 | i for i in range(n - 1) if (r := rank(unit[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            best = pop(agenda)
            i = best & 0xFFFFFFFF
            left, j = symbol[i], after[i]
            if not left or j >= n:
                continue
            pair = left + symbol[j]
            if rank(pair) != best >> 32:
                continue
            symbol[i], symbol[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(pair + symbol[k])) is not None:
                    push(agenda, r << 32 | i)
            k = before[i]
            if k >= 0 and (r := rank(symbol[k] + pair)) is not None:
                push(agenda, r << 32 | k)
        out: list[int] = []
        for s in symbol:
            if s:
                one = self.ids.get(s)
                if one is not None:
                    out.append(one)
                elif self.byte:
                    out += [self.byte[b] for b in s.encode("utf-8")]
                else:
                    out.append(self.unknown)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte pieces are gathered into code points, the first blank is dropped."""
        if ids and min(ids) > self.last_special:
            text = "".join([self.names[i] for i in ids])
            return (text[1:] if text.startswith(BLANK) else text).replace(BLANK, " ")
        out: list[str] = []
        raw = bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i is not None and i not in self.hidden:
                out.append(" ⁇ " if i == self.unknown else self.names[i])
        text = "".join(out)
        return (text[1:] if text.startswith(BLANK) else text).replace(BLANK, " ")

    def learn(self, units: set[str]) -> None:
        """Encodes and decodes units that are new, and checks both against the library."""
        new = [u for u in units if u not in self.known]
        if len(self.known) + len(new) > UNIT_CACHE:
            self.known, self.decoded = {}, {}
            new = list(units)
        blank, line = self.ids[BLANK], [self.ids[BLANK], self.byte[10]] if self.byte else []
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            # the library puts a blank before each text; behind a line end a unit stands without one
            shown = ["\n" + u[1:] if u[:1] == GLUE else u for u in part]
            said = self.library.encode(shown, num_threads=1)
            back = self.library.decode(said, num_threads=1)
            encoded = self.encode_units([u[1:] if u[:1] == GLUE else BLANK + u.replace(" ", BLANK) for u in part])
            for unit, text, want, got, ids in zip(part, shown, said, back, encoded):
                if not unit:
                    self.known[unit] = str(blank)  # a blank alone, if others follow
                    continue
                glued = unit[:1] == GLUE
                whole_ids = line + ids if glued else ids
                decoded = self.decode(whole_ids)
                if whole_ids != want or decoded != got:
                    raise ValueError(f"the agenda and the library differ on {unit!r}: {ids}, {want}")
                self.known[unit] = ",".join([self.digits[i] for i in ids])
                if decoded != text:
                    self.decoded[unit] = GLUE + decoded[1:] if glued else decoded

    def split(self, text: str) -> list[str]:
        """Units, without the blank they begin with; those that begin with none are marked."""
        if not text:
            return []
        if "  " in text or BLANK in text or text[0] == " " or text[-1] == " ":
            return [u[1:].replace(BLANK, " ") for u in UNIT.findall(BLANK + text.replace(" ", BLANK))]
        if self.byte:
            if self.lines and not ("\n\n" in text or "\n " in text or " \n" in text or text[0] == "\n" or text[-1] == "\n"):
                text = text.replace("\n", f" {GLUE}\n {GLUE}")
            if self.cut:
                text = self.cut.sub(rf"\1 {GLUE}\2", text)
        return text.split(" ")

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Comma-joined ids and decoded text of each text."""
        split = [None if GLUE in t else self.split(t) for t in texts]
        self.learn(set().union(*[u for u in split if u]))
        known, decoded = self.known, self.decoded
        for text, units in zip(texts, split):
            if units is None:
                yield self._with_mark(text)
                continue
            back = " ".join([decoded.get(u, u) for u in units] if decoded else units)
            yield ",".join([known[u] for u in units]), back.replace(" " + GLUE, "")

    def _with_mark(self, text: str) -> tuple[str, str]:
        """A text that has the mark of glued units among its own characters: nothing is remembered of it."""
        units = self.encode_units(UNIT.findall(BLANK + text.replace(" ", BLANK)))
        ids = [i for own in units for i in own]
        if ids != self.library.encode(text):
            raise ValueError("the agenda and the library differ on a text with NUL")
        return ",".join(map(str, ids)), self.decode(ids)


_BY_PATH: dict[str, MergeVocabulary] = {}


def vocabulary(path: str) -> MergeVocabulary:
    if path not in _BY_PATH:
        _BY_PATH[path] = MergeVocabulary(path)
    return _BY_PATH[path]


def _texts(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the ids of every whole text (array of ints) and the text they decode to.

    A null text is the empty text and has no ids.  Other columns, repeated rows and long texts stay as
    they are; columns named like the outputs are replaced.
    """
    rest = shipped(docs).drop(ids, decoded).withColumn(text, whole(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for whole_batch in batches:
            for b in _texts(whole_batch):
                got = list(v.encode_batch(b.column(text).to_pylist()))
                numbers = [[int(i) for i in g[0].split(",")] if g[0] else [] for g in got]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(numbers, pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.string())],
                    names=[*b.schema.names, ids, decoded],
                )

    return rest.mapInArrow(run, f"{schema}, `{ids}` array<int>, `{decoded}` string")


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, made where the ids are made."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for whole_batch in batches:
            for b in _texts(whole_batch):
                n, one, two = [], [], []
                for joined, back in v.encode_batch(b.column(1).to_pylist()):
                    n.append(joined.count(",") + 1 if joined else 0)
                    one.append(digest(joined))
                    two.append(digest(back))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return shipped(docs).select(F.col("doc_id").cast("long"), whole("text").alias("text")).mapInArrow(run, schema)
