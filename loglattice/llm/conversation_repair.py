"""Repair of the turn structure of conversations at least cost.

A good conversation's roles are an optional system turn and then pairs of user and assistant.  Each
row becomes one symbol: the initial of its role (``s``, ``u``, ``a``, else ``o``), upper case if the
text is truncated, or ``x`` if the row must go (blank, or a repeat).  The symbols of a conversation are
its signature, and what its repair costs depends on nothing else.

Signatures are solved from the end.  What remains to be done after some row depends only on the
symbols behind it, so all signatures that end alike share the nodes of their common ending: an
automaton read from the end, with one node for each distinct ending.  Distinct signatures are sorted
by their reversed text, ranges of them go to tasks, and a task holds the nodes of one signature as a
stack: the next signature keeps the nodes of the common ending and adds its own.  Every node is
solved once for each of the four grammar states (only the endings at a range's first signature are
solved again): its cheapest cost to go, and the first edit with a link to the node and state after
it, which is the best audit suffix, shared by all that end so.  An edit fixes the next state, so the
ASCII-least of the cheapest audits takes at each node the least letter among the cheapest edits.

One conversation is read in order by one task, which streams its rows: it holds a byte a row (the
signature, later the audit), no texts.  The texts are shuffled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from loglattice.llm.common import row_digest, shipped, table_batch
from loglattice.plans.durable import written

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"
#: tasks among which the conversations of one signature are dealt
CELLS = 64

START, SYSTEM, USER, ASSISTANT = range(4)
#: the state after a turn of that initial, where the grammar allows one
_NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: the state after a turn that an edit chooses: the assistant answers the user, else a user asks
_CHOSEN = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}

#: (cost, letter, state after it); a letter I stays at its node
Step = tuple[int, str, int]
Node = tuple[Step, Step, Step, Step]


def _with_inserts(plain: list[Step]) -> Node:
    """Lets each state also insert the turn the grammar needs; two inserts in a row can help only before a user's turn."""
    user = min(plain[USER], (plain[ASSISTANT][0] + INSERT_COST, INSERT, ASSISTANT))
    assistant = min(plain[ASSISTANT], (plain[USER][0] + INSERT_COST, INSERT, USER))
    asked = (user[0] + INSERT_COST, INSERT, USER)
    return min(plain[START], asked), min(plain[SYSTEM], asked), user, assistant


_NEVER = 1 << 60
#: behind the last row: nothing is owed at the start or after an assistant
END: Node = _with_inserts([(0, "", START), (_NEVER, "", SYSTEM), (_NEVER, "", USER), (0, "", ASSISTANT)])


def before(symbol: str, after: Node) -> Node:
    """The node of a symbol followed by the ending ``after``."""
    truncated = TRUNCATED_COST if symbol.isupper() else 0
    initial = symbol.lower()
    plain = []
    for state in range(4):
        best = (DELETE_COST + after[state][0], DELETE, state)
        if initial != "x":
            kept = _NEXT.get(initial, {}).get(state)
            if kept is not None:
                best = min(best, (truncated + after[kept][0], KEEP, kept))
            chosen = _CHOSEN[state]
            best = min(best, (REROLE_COST + truncated + after[chosen][0], REROLE, chosen))
        plain.append(best)
    return _with_inserts(plain)


def audit(nodes: list[Node]) -> str:
    """The edits from the last node of the stack, a conversation's first row, to its end."""
    letters, state, level = [], START, len(nodes) - 1
    while True:
        _, letter, state = nodes[level][state]
        if not letter:
            return "".join(letters)
        letters.append(letter)
        if letter != INSERT:
            level -= 1


def solve(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each distinct ``signature``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, last = [END], ""
        for batch in batches:
            found = []
            for backwards in batch.column(0).to_pylist():
                shared = 0
                for a, b in zip(last, backwards):
                    if a != b:
                        break
                    shared += 1
                del nodes[shared + 1 :]
                for symbol in backwards[shared:]:
                    nodes.append(before(symbol, nodes[-1]))
                last = backwards
                found.append((backwards[::-1], nodes[-1][START][0], audit(nodes)))
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                ["signature", "cost", "audit"],
            )

    backwards = signatures.select(F.reverse("signature").alias("backwards")).distinct()
    dealt = backwards.repartitionByRange("backwards").sortWithinPartitions("backwards")
    return shipped(dealt).mapInArrow(run, "signature string, cost long, audit string")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def _own_symbols(rows: DataFrame) -> DataFrame:
    """conv, turn, there, digest; the row's initial and whether its text by itself is (b)lank, (t)runcated or (w)hole."""
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    state = F.when(last == "", "b").when(last.isin(".", "!", "?"), "w").otherwise("t")
    digest = row_digest(F.col("role"), F.col("text"))
    return rows.select("conv", "turn", "there", digest.alias("digest"), F.concat(initial, state).alias("own"))


class _Signature:
    """One conversation as its rows come by."""

    def __init__(self, conv):
        self.conv = conv
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = ""
        self.symbols = bytearray()

    def add(self, turn, own: str, times: int) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        initial, state = own
        if self.initial and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if state == "b":
            self.blank += 1
            initial = "x"
        elif times > 1:
            self.duplicate += 1
            initial = "x"
        elif state == "t":
            self.truncated += 1
            initial = initial.upper()
        self.symbols.append(ord(initial))

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.symbols.decode()


def signatures(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, signature) of each conversation.

    ``rows`` has conv, turn, role, text (the last two not null) and ``there``; rows that are not there
    only say that the conversation exists.  Rows are taken by turn (null first), those of one turn in a fixed order.
    """
    kind = rows.schema["conv"].dataType
    schema = T.StructType([
        T.StructField("conv", kind), *[T.StructField(n, T.LongType()) for n in COUNTS], T.StructField("signature", T.StringType()),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            done = []
            for conv, turn, there, own, times in zip(*(c.to_pylist() for c in batch.columns)):
                if at is None or at.conv != conv:
                    if at is not None:
                        done.append(at.row())
                    at = _Signature(conv)
                if there:
                    at.add(turn, own, times)
            yield table_batch(done, arrow)
        if at is not None:
            yield table_batch([at.row()], arrow)

    seen = Window.partitionBy("conv", "there", "digest").orderBy(F.asc_nulls_first("turn"))
    # dealt by conversation once: neither the window nor the order below needs another shuffle
    dealt = _own_symbols(rows).repartition("conv").withColumn("times", F.row_number().over(seen))
    ordered = dealt.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "digest", "times")
    return shipped(ordered).select("conv", "turn", "there", "own", "times").mapInArrow(run, schema)


def audits(facts: DataFrame) -> DataFrame:
    """``facts`` (conv, signature, …) with cost and audit; a signature that very many conversations have is dealt among CELLS."""
    celled = facts.withColumn("cell", F.pmod(F.xxhash64("conv"), F.lit(CELLS)))
    distinct = celled.groupBy("signature").agg(F.collect_set("cell").alias("cells"))  # CELLS at most
    solved = solve(distinct).join(distinct, "signature").withColumn("cell", F.explode("cells")).drop("cells")
    return celled.join(solved, ["signature", "cell"]).drop("cell", "signature")


def _walk(rows: DataFrame, facts: DataFrame, schema: T.StructType, taker) -> DataFrame:
    """The rows of each conversation in order, its facts before them, through ``taker`` in one task."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taking = taker()
        for batch in batches:
            done: list[tuple] = []
            for conv, known, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                taking.take(conv, known, role, text, done)
            yield table_batch(done, arrow)
        done = []
        taking.end(done)
        yield table_batch(done, arrow)

    known = F.struct(*COUNTS, "cost", "audit")
    heads = facts.select("conv", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("binary").alias("digest"),
                         known.alias("known"), F.lit("").alias("role"), F.lit("").alias("text"))
    body = rows.filter("there").select(
        "conv", "turn", row_digest(F.col("role"), F.col("text")).alias("digest"), F.lit(None).cast(heads.schema["known"].dataType).alias("known"), "role", "text"
    )
    dealt = heads.unionByName(body).repartition("conv")
    ordered = dealt.sortWithinPartitions("conv", F.col("known").isNull(), F.asc_nulls_first("turn"), "digest")
    return shipped(ordered).select("conv", "known", "role", "text").mapInArrow(run, schema)


class _Edits:
    """Applies a conversation's audit to its rows as they come by."""

    def __init__(self):
        self.conv, self.known = None, None
        self.place, self.state = 0, START

    def take(self, conv, known, role, text, done) -> None:
        if known is not None:
            self.end(done)
            self.conv, self.known, self.place, self.state = conv, known, 0, START
            self.begin()
            return
        self._inserts(done)
        edit = self.known["audit"][self.place]
        self.place += 1
        if edit == KEEP:
            self.state = _NEXT[role[0]][self.state]
            self.turn(edit, role, text, done)
        elif edit == REROLE:
            self.state = _CHOSEN[self.state]
            self.turn(edit, _ROLE[self.state], text, done)

    def _inserts(self, done) -> None:
        while self.place < len(self.known["audit"]) and self.known["audit"][self.place] == INSERT:
            self.place += 1
            self.state = _CHOSEN[self.state]
            self.turn(INSERT, _ROLE[self.state], "", done)

    def end(self, done) -> None:
        if self.known is not None:
            self._inserts(done)
            self.finish(done)
        self.known = None


class _Rows(_Edits):
    def begin(self) -> None:
        self.n = 0

    def turn(self, edit, role, text, done) -> None:
        done.append((self.conv, self.n, edit, role, text))
        self.n += 1

    def finish(self, done) -> None:
        pass


class _Digests(_Edits):
    def begin(self) -> None:
        self.sha, self.first = hashlib.sha256(), True

    def turn(self, edit, role, text, done) -> None:
        self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def finish(self, done) -> None:
        done.append((self.conv, *(self.known[n] for n in COUNTS), self.known["cost"], self.known["audit"], self.sha.hexdigest()))


def normal(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, there: null roles and texts are one blank; no other column is read."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"), F.lit(True).alias("there")
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of :func:`normal` with the faults that ``crc32("conv:turn") % 20`` names; dropped rows stay, as not there."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    role = F.when(fault == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), (fault != 0).alias("there"), F.explode(copies).alias("copy")).drop("copy")


def analysed(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation, written out."""
    return written(audits(written(signatures(rows), "repair-signatures")), "repair-audits")


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, position, edit, role, text): the turns of each repaired conversation.

    Null roles and texts are one blank, null conversations are one conversation, null turns come first,
    rows of one turn and repeated rows are taken in an order of their contents.  A conversation whose best
    repair is empty has no rows; an empty table gives none.
    """
    rows = normal(conversations, conv, turn, role, text)
    schema = T.StructType([
        rows.schema["conv"], T.StructField("position", T.LongType()), T.StructField("edit", T.StringType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    ])
    return _walk(rows, analysed(rows), schema, _Rows)


def repair_digests(rows: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """(id_column, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of conversations in :func:`normal` form.

    A conversation none of whose rows is there has zeros, an empty audit and the digest of the empty text.
    """
    longs = [T.StructField(n, T.LongType()) for n in (*COUNTS, "cost")]
    texts = [T.StructField(n, T.StringType()) for n in ("audit", "repaired_sha256")]
    schema = T.StructType([T.StructField(id_column, rows.schema["conv"].dataType), *longs, *texts])
    return _walk(rows, analysed(rows), schema, _Digests)
