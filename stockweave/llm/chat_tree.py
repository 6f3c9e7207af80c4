"""Chat formatting as prefix trees.

A conversation is a path of formatted turns. Conversations that begin alike share those turns: every distinct
prefix is one node, emitted once. The nodes of a tree (one first turn) follow each other depth-first, and the serialised tree is
kept in pages of bounded length, with position ids and the loss mask. Units are characters.

On a path every node stands after its ancestors in that order, so one list of intervals serves a whole conversation: the token at place x of
the tree attends to the intervals of its conversation as far as x, which are its ancestors and its own turn up to itself. The lists are streamed along
each conversation; no node gathers its ancestors, and what they hold grows with the forks of a path, as turns without a fork between them are one interval.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, short_batches, small_or_shuffled, stage, unstage

# Fixed values of the template: a turn is HEAD role SEP text TAIL; these strings inside a role or text get a backslash before each.
HEAD, SEP, TAIL = "### ", ": ", "</turn>\n"
#: Characters of a page of a serialised tree.
PAGE = 4096
_CONTROL = re.compile(r"\\|###|: |</turn>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: What ends a role and what ends a text, or a backslash before either.
_STOPS = (re.compile(r"\\|: "), re.compile(r"\\|</turn>\n"))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends in it."""
    head = HEAD + escape(role or "") + SEP
    body = escape(text or "")
    return head + body + TAIL, len(head), len(head) + len(body)


class TurnReader:
    """Reads formatted turns from pieces of any length. What is held back between pieces is shorter than a mark of the template, so a turn's length doesn't matter."""

    def __init__(self):
        self.held, self.place = "", 0  # place: 0 before a turn, 1 in its role, 2 in its text

    def feed(self, piece: str) -> Iterator[tuple[str, bool]]:
        """Parts of roles and texts as they follow, unescaped, with whether the role or text ends there; raises where the template is broken."""
        text, at = self.held + piece, 0
        while True:
            if self.place == 0:
                head = text[at : at + len(HEAD)]
                if not HEAD.startswith(head):
                    raise ValueError(f"no turn at {head!r}")
                if len(head) < len(HEAD):
                    break
                at, self.place = at + len(HEAD), 1
                continue
            m = _STOPS[self.place - 1].search(text, at)
            if not m:
                kept = max(at, len(text) - len((SEP, TAIL)[self.place - 1]) + 1)
                yield text[at:kept], False
                at = kept
                break
            if m[0] != "\\":
                part, at, self.place = text[at : m.start()], m.end(), (self.place + 1) % 3
                yield part, True
            elif m.end() < len(text):
                yield text[at : m.start()] + text[m.end()], False
                at = m.end() + 1
            else:
                yield text[at : m.start()], False
                at = m.start()
                break
        self.held = text[at:]

    def ended(self) -> bool:
        """Whether what was read is whole turns."""
        return not self.place and not self.held


def parse(formatted: str) -> list[tuple[str, str]]:
    """Formatted turns back to (role, text); raises where the template is broken."""
    reader, parts, fields = TurnReader(), [], []
    for part, ends in reader.feed(formatted):
        parts.append(part)
        if ends:
            fields.append("".join(parts))
            parts.clear()
    if not reader.ended():
        raise ValueError("the last turn is open")
    return list(zip(fields[::2], fields[1::2], strict=True))


def _paths(rows: DataFrame) -> DataFrame:
    """A row per turn, streamed in conversation order: node (hash of the turns so far), parent, root, depth, segment and its loss span, start on the path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, first, node, root, depth, start = None, True, "", "", 0, 0
        for batch in batches:
            out = []
            for c, role, text in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                if first or c != conv:
                    conv, first, node, root, depth, start = c, False, "", "", 0, 0
                segment, lo, hi = format_turn(role, text)
                parent, node = node, hashlib.sha256((node + "\0" + segment).encode("utf-8", "surrogatepass")).hexdigest()[:32]
                root = root or node
                loss = (lo, hi) if role == "assistant" else (0, 0)
                out.append((c, node, parent, root, depth, segment, *loss, start))
                depth, start = depth + 1, start + len(segment)
            if out:
                types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv_id", "node", "parent", "root", "depth", "segment", "loss_start", "loss_stop", "path_start"])

    ordered = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, node string, parent string, root string, depth int, segment string, loss_start long, loss_stop long, path_start long")


def _branches(turns: DataFrame, nodes: DataFrame) -> DataFrame:
    """node -> branch: the nodes at which its path forked, joined in order; runs without a fork share one, so it grows with forks, not with turns.

    Streamed again in conversation order; a branch is named by the node that begins it.
    """
    forks = stage(nodes.where("parent <> ''").groupBy("parent").agg(F.count("*").alias("children")).where("children > 1").select(F.col("parent").alias("fork")), "forks")
    rows = turns.select("conv_id", "node", "parent", "depth")
    # roots have no parent to look up, and a parent that very many turns share is split by the join
    deep = rows.where("depth > 0").join(small_or_shuffled(forks, 48), F.col("parent") == F.col("fork"), "left").select("conv_id", "node", "depth", F.col("fork").isNotNull().alias("begins"))
    marked = deep.unionByName(rows.where("depth = 0").select("conv_id", "node", "depth", F.lit(True).alias("begins")))
    ordered = marked.select("conv_id", "depth", "node", "begins").repartition("conv_id").sortWithinPartitions("conv_id", "depth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = ""
        for batch in batches:
            out = []
            for depth, node, begins in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
                if depth == 0:
                    path = ""
                if begins:
                    path += node[:16]
                out.append(path)
            yield pa.record_batch([batch.column(2), pa.array(out, pa.string())], names=["node", "branch"])

    return ordered.mapInArrow(run, "node string, branch string").groupBy("node").agg(F.min("branch").alias("branch"))


def build_trees(conversations: DataFrame, page: int = PAGE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """conversations (conv_id, turn, role, text, ...) -> (pages, nodes, leaves).

    pages: the serialised trees, each node once, depth-first: root, page, start, text (of at most `page` characters, from place start of its tree),
    runs (array of start, stop, position: position ids of its tokens count up from position), loss (array of start, stop: the texts of assistant turns).
    nodes: a row per distinct prefix: node, parent ('' at a root), root, depth, position (of its first character on its path), start, stop (in its tree).
    leaves: a row per conversation: conv_id, root, n_turns, attends (array of start, stop: the places of its tree that its last token
    attends to; a token at place x attends to them as far as x).

    Turns follow by turn, null first, ties by role and text. Null texts and roles are empty; rows of a null conv_id form one conversation; equal
    conversations share all nodes; repeated rows are further turns; other columns are not read; an empty table gives no rows.
    """
    spark = conversations.sparkSession
    short_batches(spark)
    turns = stage(_paths(conversations), "turns")
    size = F.length("segment").cast("long")
    nodes = turns.select("node", "parent", "root", "depth", "path_start", size.alias("chars")).groupBy("node").agg(*[F.min(c).alias(c) for c in ("parent", "root", "depth", "chars")], F.min("path_start").alias("position"))
    nodes = stage(nodes, "nodes")
    placed = nodes.join(_branches(turns, nodes), "node")
    # depth-first order is that of (root, branch, depth): range partitions, sums of partitions, then sums within each
    dealt = stage(placed.repartitionByRange(partitions(spark), "root", "branch", "depth").withColumn("slice", F.spark_partition_id()), "dealt")
    slices = dealt.groupBy("root", "slice").agg(F.sum("chars").alias("sum"))
    before = Window.partitionBy("root").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("root", "slice", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("slice_start"))
    within = Window.partitionBy("root", "slice").orderBy("branch", "depth").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.col("slice_start") + F.sum("chars").over(within)
    serial = dealt.join(slices, ["root", "slice"]).withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("chars"))
    serial = stage(serial.select("node", "parent", "root", "depth", "position", "start", "stop"), "serial")
    texts = turns.select("node", "segment", "loss_start", "loss_stop").groupBy("node").agg(*[F.min(c).alias(c) for c in ("segment", "loss_start", "loss_stop")])
    pieces = texts.join(serial.select("node", "root", "start", "position"), "node").select("root", "start", "position", "segment", "loss_start", "loss_stop")
    dealt_pieces = pieces.mapInArrow(lambda batches: _cut(batches, page), f"root string, page long, {PIECE}").repartition("root", "page").sortWithinPartitions("root", "page", "start")
    pages = stage(dealt_pieces.mapInArrow(_joined, "root string, page long, start long, text string, runs array<struct<start: long, stop: long, position: long>>, loss array<struct<start: long, stop: long>>"), "pages")
    on_path = turns.select("conv_id", "depth", "node").join(serial.select("node", "root", "start", "stop"), "node").select("conv_id", "depth", "root", "start", "stop")
    ordered = on_path.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    leaves = stage(ordered.mapInArrow(_attention, "conv_id long, root string, n_turns long, attends array<struct<start: long, stop: long>>"), "leaves")
    unstage(turns, nodes, dealt)
    return pages, serial, leaves


PIECE = "start long, position long, text string, loss_start long, loss_stop long"
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_RUN = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("position", pa.int64())])


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Nodes in their places -> their pieces by page; loss in places of the tree, empty where start is stop."""
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    names = ["root", "page", "start", "position", "text", "loss_start", "loss_stop"]
    for batch in batches:
        out, chars = [], 0
        for root, start, position, segment, lo, hi in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            at, stop = start, start + len(segment)
            while at < stop:
                page = at // size
                end = min(stop, (page + 1) * size)
                a, b = max(at, start + lo), min(end, start + hi)
                out.append((root, page, at, position + at - start, segment[at - start : end - start], *((a, b) if a < b else (at, at))))
                chars += end - at
                at = end
                if chars > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, chars = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by root, page and start -> a row per page."""
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(_RUN), pa.list_(_SPAN))
    names = ["root", "page", "start", "text", "runs", "loss"]
    out, page = [], None

    def rows() -> pa.RecordBatch:
        made = [(root, number, start, "".join(text), runs, loss) for root, number, start, text, runs, loss in out]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for root, number, start, position, text, lo, hi in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if page is None or (root, number) != page:
                page = (root, number)
                if len(out) >= 1000:
                    yield rows()
                out.append((root, number, start, [], [], []))
            out[-1][3].append(text)
            out[-1][4].append({"start": start, "stop": start + len(text), "position": position})
            if lo < hi:
                out[-1][5].append({"start": lo, "stop": hi})
    if out:
        yield rows()


def _attention(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in their places, sorted by conversation and depth -> a row per conversation; turns that follow each other in the tree are one interval."""
    types = (pa.int64(), pa.string(), pa.int64(), pa.list_(_SPAN))
    out = []

    def rows(keep: int) -> pa.RecordBatch:
        done = out[: len(out) - keep]
        del out[: len(out) - keep]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=["conv_id", "root", "n_turns", "attends"])

    for batch in batches:
        for conv, depth, root, start, stop in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if depth == 0:
                out.append([conv, root, 0, []])
            here = out[-1]
            here[2] += 1
            if here[3] and here[3][-1]["stop"] == start:
                here[3][-1]["stop"] = stop
            else:
                here[3].append({"start": start, "stop": stop})
        if len(out) > 5000:
            yield rows(1)
    if out:
        yield rows(0)


class _Reader:
    """One conversation read back from its text in order, piece by piece: everything is digested at once and nothing is kept."""

    def __init__(self, conv: int | None):
        self.conv, self.n, self.chars, self.loss_chars = conv, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.reader, self.bare = TurnReader(), ""  # bare: a backslash whose character is to come

    def take(self, text: str, loss: str) -> None:
        self.chars += len(text)
        parts, ended = [], 0
        for part, ends in self.reader.feed(text):
            parts.append(part + "\n" if ends else part)
            ended += ends and not self.reader.place
        self.turns.update("".join(parts).encode("utf-8", "surrogatepass"))
        self.n += ended
        loss = self.bare + loss
        odd = (len(loss) - len(loss.rstrip("\\"))) % 2
        self.bare = loss[len(loss) - odd :]
        loss = unescape(loss[: len(loss) - odd])
        self.loss_chars += len(loss)
        self.loss.update(loss.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        if not self.reader.ended() or self.bare:
            raise ValueError(f"conversation {self.conv} does not end with a turn")
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(pages: DataFrame, leaves: DataFrame, page: int = PAGE) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: every conversation read from the serialised trees alone; page as in build_trees.

    What a conversation's last token attends to is cut out of the pages, in order, and parsed by the template. turns_sha256 is over role,
    newline, text, newline of each turn; loss_sha256 over the unescaped text under the loss mask.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, reader = [], None
        for batch in batches:
            for conv, at, text, loss in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if reader is None or reader.conv != conv:
                    if reader:
                        out.append(reader.row())
                    reader = _Reader(conv)
                reader.take(text, "".join(text[s["start"] - at : s["stop"] - at] for s in loss))
            if len(out) > 10_000:
                yield _digests(out)
                out.clear()
        if reader:
            out.append(reader.row())
        if out:
            yield _digests(out)

    spans = leaves.select("conv_id", "root", F.explode("attends").alias("s")).select("conv_id", "root", F.col("s.start").alias("from"), F.col("s.stop").alias("upto"))
    asked = spans.withColumn("page", F.explode(F.sequence(F.expr(f"`from` div {page}"), F.expr(f"(upto - 1) div {page}"))))
    met = asked.join(pages.select("root", "page", F.col("start").alias("first"), "text", "loss"), ["root", "page"])
    lo, hi = F.greatest("from", "first"), F.least("upto", F.col("first") + F.length("text"))
    cut = met.withColumn("lo", lo).withColumn("hi", hi).where("lo < hi")
    clipped = F.filter(F.transform("loss", lambda s: F.struct(F.greatest(s["start"], F.col("lo")).alias("start"), F.least(s["stop"], F.col("hi")).alias("stop"))), lambda s: s["start"] < s["stop"])
    rows = cut.select("conv_id", F.col("lo").alias("at"), F.substring("text", (F.col("lo") - F.col("first") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("text"), clipped.alias("loss"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(out: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
