"""Mixing sources to target weights by Pfair scheduling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import written

#: Rows of a source that one task ranks, and the most sources that a cycle takes.
SHARE, MOST = 2_000, 10_000


def shares(counts: DataFrame, slots: int, power: float, weights: dict[str | None, float] | None = None) -> DataFrame:
    """(source, n, quota): whole quotas that sum to about `slots`, in proportion to the target weights, each at least 1.

    weights gives a source's target weight (None: the null source); a source that it leaves out has weight 0, so quota 1.
    Without weights they are n ** power. Largest remainders get the slots that rounding down leaves. counts has one row for
    each source.
    """
    every = Window.partitionBy()  # of one row for each source
    told = F.pow(F.col("n").cast("double"), F.lit(power))
    if weights is not None:
        if any(not 0 <= x < float("inf") for x in weights.values()) or not sum(weights.values()):
            raise ValueError("weights must be finite, none below 0, and some above it")
        told = F.lit(0.0)
        for name, x in weights.items():
            told = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(x))).otherwise(told)
    w = counts.withColumn("p", told).withColumn("all", F.sum("p").over(every))
    w = w.withColumn("x", F.when(F.col("all") > 0, F.lit(slots) * F.col("p") / F.col("all")).otherwise(0.0)).withColumn("base", F.floor("x"))
    w = w.withColumn("r", F.row_number().over(Window.orderBy(F.desc(F.col("x") - F.col("base")), "source"))).withColumn("left", F.lit(slots) - F.sum("base").over(every))
    return w.select("source", "n", F.greatest(F.lit(1), F.col("base") + (F.col("r") <= F.col("left")).cast("long")).cast("int").alias("quota"))


def schedules(quotas: DataFrame, block: int) -> DataFrame:
    """(source, cycle_from, cycle_to, length, offset, nth, slot): the slot of each source's nth block in a cycle.

    In a cycle each source still holding blocks gives its quota, or what it has left. Block j of a source that gives a of a
    cycle's L blocks is released at floor((j - 1) * L / a) and due at ceil(j * L / a) (1-based j): its Pfair window. At each slot
    the released block with the earliest deadline runs, ties by source, found by a fold over the cycle's slots. Cycles change
    only where a source ends, so there are at most two kinds of cycle for each source, each one row of at most `slots` slots.
    """
    q = quotas.withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("whole", F.floor(F.col("blocks") / F.col("quota")))
    # a source gives its whole quota in cycles below `whole`, then its remainder in one
    own = F.array(F.lit(0).cast("long"), F.col("whole").cast("long"), F.col("whole").cast("long") + 1)
    starts = F.array_sort(F.array_distinct(F.flatten(F.collect_list(own).over(Window.partitionBy()))))
    span = lambda i: F.struct(F.get("starts", i - 1).alias("cycle_from"), F.get("starts", i).alias("cycle_to"))
    spans = F.filter(F.transform(F.sequence(F.lit(1), F.size("starts") - 1), span), lambda s: s["cycle_from"] * F.col("quota") < F.col("blocks"))
    each = q.withColumn("starts", starts).select("source", "quota", "blocks", F.inline(spans))
    gives = F.least(F.col("quota").cast("long"), F.col("blocks").cast("long") - F.col("cycle_from") * F.col("quota")).cast("int")
    each = each.withColumn("a", gives)
    kinds = each.groupBy("cycle_from", "cycle_to").agg(F.sum("a").cast("int").alias("length"), F.array_sort(F.collect_list(F.struct("source", "a"))).alias("all"))
    offset = F.sum((F.col("cycle_to") - F.col("cycle_from")) * F.col("length")).over(Window.orderBy("cycle_from").rowsBetween(Window.unboundedPreceding, -1))
    kinds = kinds.withColumn("offset", F.coalesce(offset, F.lit(0)).cast("long"))
    fold = """aggregate(
        sequence(0, length - 1),
        named_struct('given', transform(all, x -> 0), 'order', cast(array() as array<int>)),
        (s, t) -> transform(array(
            array_min(transform(
                filter(
                    transform(all, (x, i) -> named_struct(
                        'due', int(ceil((s.given[i] + 1) * length / x.a)), 'i', i,
                        'ready', s.given[i] < x.a and int(floor(s.given[i] * length / x.a)) <= t)),
                    y -> y.ready),
                y -> named_struct('due', y.due, 'i', y.i))).i),
            k -> named_struct('given', transform(s.given, (g, i) -> g + if(i = k, 1, 0)), 'order', array_append(s.order, k)))[0],
        s -> s.order)"""
    kinds = kinds.select("cycle_from", "cycle_to", "length", "offset", "all", F.posexplode(F.expr(fold)).alias("slot", "k"))
    nth = F.row_number().over(Window.partitionBy("cycle_from", "k").orderBy("slot")) - 1
    return kinds.select(F.expr("all[k].source").alias("source"), "cycle_from", "cycle_to", "length", "offset", nth.alias("nth"), "slot")


def ranked(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows (source, id, salt and others) with `place`: 0-based rank within the source by hash of id and salt, then both.

    Hash ranges of about SHARE rows are ranked apart and get the number of rows in lower ranges added, so that one source with
    most of the rows still spreads over many tasks. Repeated ids take successive places. The join with the ranges' counts is by
    the window's own keys, so rows are shuffled once.
    """
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))  # never null, and different for null and ""
    parts = counts.select(name.alias("of"), F.greatest(F.lit(1), F.ceil(F.col("n") / SHARE)).cast("long").alias("parts"))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(23), "id", "salt"), 33)  # 31 bits
    x = rows.withColumn("name", name).join(parts, F.col("name") == F.col("of")).drop("of").withColumn("h", h)
    x = x.withColumn("range", F.shiftright(F.col("h") * F.col("parts"), 31)).drop("parts")
    below = x.groupBy("name", "range").agg(F.count(F.lit(1)).alias("m"))
    below = below.withColumn("before", F.coalesce(F.sum("m").over(Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("within", F.row_number().over(Window.partitionBy("name", "range").orderBy("h", "id", "salt")) - 1)
    return x.join(below.drop("m"), ["name", "range"]).withColumn("place", F.col("before") + F.col("within")).drop("name", "range", "h", "within", "before")


def _placed(rows: DataFrame, counts: DataFrame, slots: int, power: float, block: int, weights: dict[str | None, float] | None) -> DataFrame:
    """rows (source, id, salt and others) with quota, cycle, block, slot, release, due and position."""
    counts = written(counts, "sources")
    if counts.count() > MOST:
        raise ValueError(f"more than {MOST} sources: a cycle is one row of all of them; group them first")
    quotas = written(shares(counts, slots, power, weights), "quotas")
    plan = written(schedules(quotas, block), "schedule")
    x = ranked(rows, counts).withColumn("block", F.floor(F.col("place") / block))
    q = quotas.select(F.col("source").alias("qs"), "quota")
    x = x.join(q, F.col("source").eqNullSafe(F.col("qs"))).drop("qs")
    x = x.withColumn("cycle", F.floor(F.col("block") / F.col("quota"))).withColumn("nth", (F.col("block") - F.col("cycle") * F.col("quota")).cast("int"))
    gives = Window.partitionBy("cycle_from", "source")
    p = plan.withColumn("a", F.count(F.lit(1)).over(gives)).withColumnsRenamed({"source": "ps", "nth": "pn", "slot": "at"})
    # quotas and plan grow with the number of sources only; Spark broadcasts them if their written size allows
    x = x.join(p, F.col("source").eqNullSafe(F.col("ps")) & (F.col("nth") == F.col("pn")) & (F.col("cycle") >= F.col("cycle_from")) & (F.col("cycle") < F.col("cycle_to")))
    start = F.col("offset") + (F.col("cycle") - F.col("cycle_from")) * F.col("length")
    slot = start + F.col("at")
    return x.withColumns({
        "slot": slot.cast("long"), "position": (slot * block + F.col("place") % block).cast("long"),
        "release": (start + F.floor(F.col("nth") * F.col("length") / F.col("a"))).cast("long"), "due": (start + F.ceil((F.col("nth") + 1) * F.col("length") / F.col("a"))).cast("long"),
    })


def mix(docs: DataFrame, slots: int = 1000, power: float = 0.5, block: int = 8, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(doc_id, source, quota, cycle, block, slot, release, due, position): every row's place in the mixture.

    Target weights are `weights`, or n ** power of the sources' sizes, as quotas of a cycle of `slots` blocks (shares()). While
    all sources last, after t slots a source has had less than one block more or less than its weight times t, and the same
    holds against the remaining sources' quotas once some have ended. A block is `block` consecutive rows of one source in hash
    order; `slot` counts blocks from 0; release <= slot < due is the block's window; position = slot * block + row within it is
    unique and rises with the mixture (a source's last block may be short, which leaves gaps). Nothing is dropped, capped or
    repeated.

    A null source is a source of its own; rows with null or repeated ids each get a place. An empty table gives no rows. More
    than MOST sources are an error.
    Ids are whole numbers, or texts of whole numbers; other texts are an error.
    """
    rows = docs.select(docs[source_col].cast("string").alias("source"), docs[id_col].cast("long").alias("id"), F.lit(0).alias("salt"))
    x = _placed(rows, rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")), slots, power, block, weights)
    return x.select(F.col("id").alias("doc_id"), "source", "quota", F.col("cycle").cast("long"), F.col("block").cast("long"), "slot", "release", "due", "position")


def mixed(docs: DataFrame, slots: int = 1000, power: float = 0.5, block: int = 8, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with the columns slot and position of mix() added; if docs have such columns, theirs go.

    Rows are packed into one column while they are placed, so no name can clash, and shuffled once. Rows that share an id or
    have none are told apart by a hash of all their columns; equal rows take successive places.
    """
    kept = [c for c in docs.columns if c.lower() not in ("slot", "position")]
    rows = docs.select(docs[source_col].cast("string").alias("source"), docs[id_col].cast("long").alias("id"), F.xxhash64(*(docs[c] for c in kept if not dict(docs.dtypes)[c].startswith("map"))).alias("salt"), F.struct(*(docs[c] for c in kept)).alias("row"))
    counts = docs.groupBy(docs[source_col].cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return _placed(rows, counts, slots, power, block, weights).select("row.*", "slot", "position")
