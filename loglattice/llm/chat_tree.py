"""Chat formatting over a prefix tree: what conversations share at their start is written once.

A turn becomes a segment of text by a :class:`Template`.  Conversations that begin with the same turns
share the nodes of those turns.  Every node belongs to the smallest conversation that passes through
it; the nodes a conversation owns are the end of its path, its *branch*.  A tree is written depth
first, a branch before the branches that leave it, later exits first, so that every branch and all
that hangs on a node are contiguous.  A character has

- an address in its tree's text (``start``),
- a position: the characters before it in its own conversation,
- the intervals of addresses it attends to: for each branch above the part up to the exit, and its
  own branch up to itself.

How it is spread: a task reads one conversation's rows in order, without their texts, and chains their
digests into node ids.  What a node or branch must tell the conversations through it goes to CELLS
parts of them, so that a node of very many conversations is not one task's.  The depth-first order is
a range sort of the branches by their exits, the addresses are sums over ranges.  Texts are shuffled
twice: to their nodes, where only the owner's copy stays, and into blocks of the depth-first order.
A reader of a block needs, besides it, only the path of its first branch: every node above any branch of the
block that lies before the block is above the first branch too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loglattice.llm.common import row_digest, shipped, table_batch
from loglattice.plans.durable import written
from loglattice.plans.ordered import into_blocks, running_sum

#: parts of the conversations of one node or branch
CELLS = 64
#: characters of a block of the depth-first order (a longer branch is a block of its own)
BLOCK_CHARS = 8_000_000
SPAN = "array<struct<at:bigint,start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Template:
    """Marks of a turn.  A control string inside a role or text gets the escape sign before it, as does the sign itself."""

    open: str = "### "
    role_end: str = ": "
    close: str = "</turn>\n"
    escape: str = "\\"
    trained: tuple[str, ...] = ("assistant",)

    @property
    def control(self) -> tuple[str, ...]:
        return (self.escape, self.open.strip(), self.close.strip())

    def _pattern(self, more: tuple[str, ...] = ()) -> str:
        return "|".join(re.escape(c) for c in self.control + more)

    def _escaped(self, c: Column, *more: str) -> Column:
        return F.regexp_replace(c, self._pattern(more), "\\" + self.escape + "$0")

    def head(self, role: Column) -> Column:
        return F.concat(F.lit(self.open), self._escaped(role, self.role_end.strip()), F.lit(self.role_end))

    def segment(self, role: Column, text: Column) -> Column:
        return F.concat(self.head(role), self._escaped(text), F.lit(self.close))

    def plain(self, escaped: str) -> str:
        return re.sub(re.escape(self.escape) + "(" + self._pattern((self.role_end.strip(),)) + ")", r"\1", escaped, flags=re.S)

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn of a formatted text."""
        sign, mark, end = re.escape(self.escape), re.escape(self.role_end.strip()), re.escape(self.close.strip())
        role = rf"(?:[^{sign}{mark}]++|{sign}.)*+"
        text = rf"(?:[^{sign}{end[0]}]++|{sign}.|(?!{end}).)*+"
        turn = re.compile(re.escape(self.open) + f"({role})" + re.escape(self.role_end) + f"({text})" + re.escape(self.close), re.S)
        at = 0
        while at < len(formatted):
            found = turn.match(formatted, at)
            if not found:
                raise ValueError(f"no turn begins at {at}")
            yield self.plain(found[1]), self.plain(found[2])
            at = found.end()


PLAIN = Template()


def normal(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, row: null roles and texts are empty, ``row`` stands for equal rows; no other column is read."""
    rows = conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    row = F.md5(F.concat(part("conv"), F.lit(":"), part("turn"), F.lit(":"), F.hex(row_digest(F.col("role"), F.col("text")))))
    return rows.withColumn("row", F.unhex(row))


def _cell() -> Column:
    return F.pmod(F.xxhash64("conv"), F.lit(CELLS))


def paths(rows: DataFrame, template: Template = PLAIN) -> DataFrame:
    """(conv, i, row, node, at, length, last): each conversation's nodes, ``at`` being the characters before.

    A node's id is a digest of all turns up to it, so equal beginnings have equal ids.  Turns come in the
    order of ``turn`` (null first), rows of one turn in a fixed order of their contents.
    """
    schema = T.StructType([
        rows.schema["conv"], T.StructField("i", T.LongType()), T.StructField("row", T.BinaryType()), T.StructField("node", T.BinaryType()),
        T.StructField("at", T.LongType()), T.StructField("length", T.LongType()), T.StructField("last", T.BooleanType()),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, until it is known to be the last or not
        for batch in batches:
            done = []
            for conv, row, digest, length in zip(*(c.to_pylist() for c in batch.columns)):
                same = held is not None and held[0] == conv
                if held is not None:
                    done.append((*held, not same))
                i, at, above = (held[1] + 1, held[4] + held[5], held[3]) if same else (0, 0, b"")
                held = (conv, i, row, hashlib.blake2b(above + digest, digest_size=16).digest(), at, length)
            yield table_batch(done, arrow)
        yield table_batch([(*held, True)] if held else [], arrow)

    segment = template.segment(F.col("role"), F.col("text"))
    digest = row_digest(F.col("role"), F.col("text"))
    lean = rows.select("conv", "turn", "row", digest.alias("digest"), F.length(segment).cast("long").alias("length"))
    ordered = lean.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "digest")
    return shipped(ordered).select("conv", "row", "digest", "length").mapInArrow(run, schema)


def owned(path: DataFrame) -> DataFrame:
    """``path`` with the owner of each node, whether several conversations pass it and whether one ends there."""
    celled = path.withColumn("cell", _cell())
    some = celled.groupBy("node", "cell").agg(F.min("conv").alias("owner"), F.count("*").alias("n"), F.max("last").alias("final"))
    facts = some.groupBy("node").agg(
        F.min("owner").alias("owner"), (F.sum("n") > 1).alias("shared"), F.max("final").alias("final"), F.collect_list("cell").alias("cells")
    )  # a cell is listed once: CELLS at most
    spread = facts.withColumn("cell", F.explode("cells")).drop("cells")
    return celled.join(spread, ["node", "cell"]).drop("cell")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def layout(own: DataFrame) -> DataFrame:
    """(conv, tree, spans, own_at, block, first) of each conversation.

    ``spans`` are its parts (at, start, end): from position ``at`` it reads on at address ``start`` up to
    ``end``.  ``tree`` is the address of its tree; ``own_at`` the position from which it owns its nodes (null: it
    owns none), ``block`` its branch's block, ``first`` whether that branch begins the block.
    """
    runs = own.groupBy("conv", "owner").agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("length")).alias("to"))
    # one entry for each branch on the way, not for each turn
    way = written(runs.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "to", "owner"))).alias("way")), "chat-ways")
    mine = F.element_at("way", -1)
    branches = way.filter(_same(mine["owner"], F.col("conv"))).select(
        "conv", mine["at"].alias("own_at"), (mine["to"] - mine["at"]).alias("size"),
        F.transform("way", lambda w: F.struct((-w["at"]).alias("exit"), w["owner"].alias("owner"))).alias("key"),
    )
    summed = running_sum(into_blocks(branches, [], ["key"]), F.col("size"), [], ["key"], "reach")
    start = F.col("reach") - F.col("size")
    placed = written(summed.select("conv", "own_at", start.alias("start"), F.floor(start / BLOCK_CHARS).alias("block")), "chat-branches")
    begins = placed.groupBy("block").agg(F.min_by(F.struct("conv"), "start")["conv"].alias("begin"))

    steps = way.select("conv", _cell().alias("cell"), F.explode("way").alias("w")).select("conv", "cell", "w.*")
    asked = steps.groupBy("owner").agg(F.collect_set("cell").alias("cells"))  # CELLS at most
    told = placed.select(F.col("conv").alias("b_conv"), "start")
    told = told.join(asked, _same(F.col("b_conv"), F.col("owner"))).select("b_conv", "start", F.explode("cells").alias("b_cell"))
    found = steps.join(told, _same(F.col("owner"), F.col("b_conv")) & (F.col("cell") == F.col("b_cell")))
    span = F.struct("at", "start", (F.col("start") + F.col("to") - F.col("at")).alias("end"))
    spans = found.groupBy("conv").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    ends = placed.join(begins, "block").select(
        F.col("conv").alias("b_conv"), "own_at", "block", _same(F.col("conv"), F.col("begin")).alias("first")
    )
    joined = spans.join(ends, _same(F.col("conv"), F.col("b_conv")), "left").drop("b_conv")
    return joined.select("conv", F.col("spans")[0]["start"].alias("tree"), "spans", "own_at", "block", "first")


def emitted(rows: DataFrame, own: DataFrame, plan: DataFrame, template: Template = PLAIN) -> DataFrame:
    """The nodes' texts with their places, each once for its block and again for blocks whose first branch is below it.

    Columns: block, above (written for the readers of that block only), node, shared, final, tree, start, end,
    position, attends, loss_start, loss_end, text.
    """
    plan = plan.select(F.col("conv").alias("p_conv"), "tree", "spans", "own_at", "block", "first")
    held = own.join(plan, _same(F.col("conv"), F.col("p_conv"))).withColumn("above", F.col("at") < F.col("own_at"))
    held = held.filter(F.col("own_at").isNotNull() & (~F.col("above") | F.col("first")))
    before = F.filter("spans", lambda s: s["at"] < F.col("at"))
    attends = F.transform(
        before, lambda s: F.struct(s["start"].alias("start"), F.least(s["end"], s["start"] + F.col("at") - s["at"]).alias("end"))
    )
    here = F.element_at(F.filter("spans", lambda s: s["at"] <= F.col("at")), -1)
    start = here["start"] + F.col("at") - here["at"]
    places = held.select("row", F.struct(
        "block", "above", "node", "shared", "final", "tree", start.alias("start"), (start + F.col("length")).alias("end"),
        F.col("at").alias("position"), attends.alias("attends"),
    ).alias("p"))
    # equal rows of one turn are nodes below each other: one text, several places
    texts = rows.select("row", "role", "text").dropDuplicates(["row"])
    found = texts.join(places, "row").select("role", "text", "p.*")
    role, trained = F.col("role"), F.col("role").isin(*template.trained)
    return found.select(
        *[c for c in found.columns if c not in ("role", "text")],
        F.when(trained, F.col("start") + F.length(template.head(role))).alias("loss_start"),
        F.when(trained, F.col("end") - len(template.close)).alias("loss_end"),
        template.segment(role, F.col("text")).alias("text"),
    )


@dataclass
class Tree:
    """Formatted conversations.

    ``nodes``: tree, start, end, position, attends, loss_start, loss_end, text; ``conversations``: conv, tree, spans.
    Addresses count characters over all trees; a tree's own begin at ``tree``.
    """

    nodes: DataFrame
    conversations: DataFrame


def format_conversations(conversations: DataFrame, template: Template = PLAIN, **columns: str) -> Tree:
    """Formats conversations; :func:`normal` says how nulls and clashing columns are taken.

    Repeated rows are turns of their own.  Equal conversations share all nodes.  An empty table gives empty tables.
    """
    rows = normal(conversations, **columns)
    own, plan = _placed(rows, template)
    nodes = emitted(rows, own, plan, template).filter(~F.col("above"))
    return Tree(
        nodes.select("tree", "start", "end", "position", "attends", "loss_start", "loss_end", "text"), plan.select("conv", "tree", "spans")
    )


def _placed(rows: DataFrame, template: Template) -> tuple[DataFrame, DataFrame]:
    own = written(owned(written(paths(rows, template), "chat-paths")), "chat-nodes")
    return own, written(layout(own), "chat-layout")


class _State:
    """What has been read along one path."""

    __slots__ = ("end", "turns", "sha", "loss", "loss_sha", "chars")

    def __init__(self):
        self.end = None
        self.turns = self.loss = self.chars = 0
        self.sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def copy(self) -> _State:
        out = _State.__new__(_State)
        out.end, out.turns, out.loss, out.chars = self.end, self.turns, self.loss, self.chars
        out.sha, out.loss_sha = self.sha.copy(), self.loss_sha.copy()
        return out


class _Reader:
    """Reads nodes in depth-first order, each once, and remembers the states at nodes that others may go on from."""

    def __init__(self, template: Template):
        self.template = template
        self.block, self.now, self.kept = None, _State(), []

    def read(self, block, after, start, end, loss_start, loss_end, shared, text) -> _State:
        if block != self.block or after is None:
            self.block, self.now, self.kept = block, _State(), []
        elif after != self.now.end:
            while self.kept and self.kept[-1].end > after:
                self.kept.pop()
            if not self.kept or self.kept[-1].end != after:
                raise ValueError(f"the text at {start} attends to nothing that was read")
            self.now = self.kept[-1].copy()
        now = self.now
        for role, said in self.template.turns(text):
            now.turns += 1
            now.sha.update(f"{role}\n{said}\n".encode())
        if loss_start is not None:
            learnt = self.template.plain(text[loss_start - start : loss_end - start])
            now.loss += len(learnt)
            now.loss_sha.update(learnt.encode())
        now.chars += len(text)
        now.end = end
        if shared:
            self.kept.append(now.copy())
        return now


def read_back(nodes: DataFrame, template: Template = PLAIN) -> DataFrame:
    """(node, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of the paths that end at ``final`` nodes.

    Only the emitted texts, addresses, attention intervals and loss intervals are read.  A node goes on from the last address
    it attends to; the states kept are those of the shared nodes above the present one.
    """
    names = ["node", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = ["binary", "long", "string", "long", "string", "long"]
    arrow = pa.schema([(n, {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}[k]) for n, k in zip(names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(template)
        for batch in batches:
            done = []
            for block, above, node, final, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                state = reader.read(block, *rest)
                if final and not above:
                    done.append((node, state.turns, state.sha.hexdigest(), state.loss, state.loss_sha.hexdigest(), state.chars))
            yield table_batch(done, arrow)

    after = F.element_at("attends", -1)["end"]
    lean = nodes.select(
        "block", "above", "node", "final", F.when(F.size("attends") > 0, after).alias("after"), "start", "end", "loss_start", "loss_end", "shared", "text"
    )
    ordered = lean.repartition("block").sortWithinPartitions("block", "start")
    return shipped(ordered).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def format_digests(conversations: DataFrame, template: Template = PLAIN, id_column: str = "conv_id", **columns: str) -> DataFrame:
    """(id_column, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, read back from the tree.

    Nulls, repeats, ties and empty tables as :func:`format_conversations` says; null ids are one conversation.
    """
    rows = normal(conversations, conv=id_column, **columns)
    own, plan = _placed(rows, template)
    read = read_back(emitted(rows, own, plan, template), template)
    ends = own.filter("last").select("conv", "node", _cell().alias("cell"))
    asked = ends.groupBy("node").agg(F.collect_set("cell").alias("cells"))  # CELLS at most
    told = read.join(asked, "node").withColumn("cell", F.explode("cells")).drop("cells")
    found = ends.join(told, ["node", "cell"]).withColumnRenamed("conv", id_column)
    return found.select(id_column, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
