"""Chat formatting of reply trees: root-to-leaf paths by iterative self-joins, ranked, each one conversation."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import written

#: Fixed values of the template: control strings, and the mark that escapes one inside a text.
START, INST, END_INST, END = "<s>", "[INST]", "[/INST]", "</s>"
ROLE, END_ROLE = "[ROLE]", "[/ROLE]"
MARK = "\\"
_CONTROL = re.compile(r"\\|</?s>|\[/?(?:INST|ROLE)\]")
_ESCAPED = re.compile(r"\\(\\|<\\/?s>|<\\s>|\[\\/?(?:INST|ROLE)\])")


def escape(text: str) -> str:
    """Puts the mark before each mark, and before and inside each control string, so that no control string is left."""
    return _CONTROL.sub(lambda m: MARK + (m[0] if m[0] == MARK else m[0][0] + MARK + m[0][1:]), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] if m[1] == MARK else m[1][0] + m[1][2:], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of it that count for the loss (assistants' texts as escaped)."""
    out, loss, at = [START], [], len(START)
    for role, text in turns:
        body = escape(text)
        if role == "user":
            parts = (INST, " ", body, " ", END_INST)
        elif role == "assistant":
            parts = (" ", body, END)
            loss.append((at + 1, at + 1 + len(body)))
        else:
            parts = (ROLE, escape(role), END_ROLE, body, END)
        out.extend(parts)
        at += sum(map(len, parts))
    return "".join(out), loss


def parse(line: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], len(START)
    while at < len(line):
        if line.startswith(INST, at):
            stop = line.index(END_INST, at)
            turns.append(("user", unescape(line[at + len(INST) + 1 : stop - 1])))
            at = stop + len(END_INST)
        elif line.startswith(ROLE, at):
            mid = line.index(END_ROLE, at)
            stop = line.index(END, mid)
            turns.append((unescape(line[at + len(ROLE) : mid]), unescape(line[mid + len(END_ROLE) : stop])))
            at = stop + len(END)
        else:
            stop = line.index(END, at)
            turns.append(("assistant", unescape(line[at + 1 : stop])))
            at = stop + len(END)
    return turns


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def climbs(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(conv_id, node, depth, score) of the nodes that reach a root, and for each k the links (conv_id, node, up) over 2^k replies.

    Each round joins the table of upward links with itself, which doubles their length, so about log2 of the longest path
    rounds. A link carries its length and the sum of the scores that it passes, no path and no text. A node whose parent is
    null or not there is a root (depth 0). Nodes on or under a ring of replies never reach one: when the distance still to
    go is beyond the number of nodes of any tree, what is left are those.
    """
    ids = nodes.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"))
    own = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    x = nodes.join(ids, _same("conv_id", "_c") & (F.col("parent") == F.col("_n")), "left")
    x = written(x.select("conv_id", "node", F.col("_n").alias("up"), F.lit(1).cast("long").alias("far"), own.alias("score")), "links")
    at, levels = x, []
    total = x.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    ended = at.filter("up is null")
    while True:
        going = at.filter("up is not null")
        if not going.limit(1).count():
            break
        levels.append(going.select("conv_id", "node", "up"))
        if 1 << len(levels) - 1 > total:
            break
        over = at.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("far").alias("_far"), F.col("score").alias("_score"))
        grown = going.join(over, _same("conv_id", "_c") & (F.col("up") == F.col("_n")))
        grown = grown.select("conv_id", "node", F.col("_up").alias("up"), (F.col("far") + F.col("_far")).alias("far"), (F.col("score") + F.col("_score")).alias("score"))
        # links that have ended are not joined again, but end others
        at = written(grown.unionByName(at.filter("up is null")), "links")
        ended = at.filter("up is null")
    return ended.select("conv_id", "node", (F.col("far") - 1).alias("depth"), "score"), levels


def paths(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """(conv_id, leaf, rank, score, depth, node): the `best` root-to-leaf paths of each reply tree (conv_id, node, parent, score).

    Paths rank by score (the sum over their nodes), higher first, then leaf; only chosen ones are enumerated: from a leaf down
    the powers of two of climbs(), each round adds to every node found so far the one 2^k replies above it, so the rows of a
    round are part of the result. Nodes on or under a ring of replies belong to no path.
    """
    n = nodes.select("conv_id", "node", "parent", "score")
    at, levels = climbs(n)
    parents = n.filter("parent is not null").select(F.col("conv_id").alias("_c"), F.col("parent").alias("_p")).distinct()
    ends = at.join(parents, _same("conv_id", "_c") & (F.col("node") == F.col("_p")), "left_anti")
    ends = ends.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "node")))
    if best is not None:
        ends = ends.filter(F.col("rank") <= best)
    found = written(ends.select("conv_id", F.col("node").alias("leaf"), "rank", "score", "depth", "node"), "paths")
    for k in range(len(levels) - 1, -1, -1):
        up = levels[k].select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"), "up")
        more = found.join(up, _same("conv_id", "_c") & (F.col("node") == F.col("_n"))).select("conv_id", "leaf", "rank", "score", (F.col("depth") - (1 << k)).alias("depth"), F.col("up").alias("node"))
        found = written(found.unionByName(more), "paths")
    return found


def format_trees(rows: DataFrame, best: int | None = 1) -> DataFrame:
    """(conv_id, leaf, rank, score, turns, formatted, loss): the `best` paths of each tree (None: all), each formatted.

    rows: conv_id, node, parent, role, text, score. Paths rank by score, higher first, then leaf. turns are (role, text) in
    order; loss are spans of `formatted` in code points. A null role is "", a null text empty, a null score 0; a null conv_id is
    a tree of its own. Of rows that share conv_id and node the first by (parent, role, text, score) counts, the others go.
    Rows without a node id are in no path. An empty table gives no rows.
    """
    one = F.min(F.struct("parent", "role", "text", "score"))
    rows = written(rows.filter("node is not null").groupBy("conv_id", "node").agg(one.alias("x")).select("conv_id", "node", "x.*"), "nodes")
    p = paths(rows, best)
    texts = rows.select(F.col("conv_id").alias("_tc"), F.col("node").alias("_tn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    p = p.join(texts, _same("conv_id", "_tc") & (F.col("node") == F.col("_tn")))
    g = p.groupBy("conv_id", "leaf", "rank", "score").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    g = g.select("conv_id", "leaf", "rank", "score", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [render([(t["role"], t["text"]) for t in turns.as_py()]) for turns in b.column(4)]
            spans = pa.array([[{"start": a, "end": e} for a, e in loss] for _, loss in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m[0] for m in made], pa.string()), spans], [*b.schema.names, "formatted", "loss"])

    return g.mapInArrow(run, "conv_id long, leaf long, rank int, score double, turns array<struct<role:string,text:string>>, formatted string, loss array<struct<start:long,end:long>>")


def linear(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply trees of one branch: each row answers the one before it by turn.

    Equal turns follow each other by role, then text; repeated rows stay. Scores are 0.
    """
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    x = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    x = x.withColumn("node", F.row_number().over(by).cast("long"))
    return x.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the formatted text and its mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            out = []
            for line, loss in zip(b.column(1), b.column(2), strict=True):
                line = line.as_py()
                turns = parse(line)
                learnt = "".join(unescape(line[x["start"] : x["end"]]) for x in loss.as_py())
                out.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt), len(line)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
