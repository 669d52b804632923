"""Mixing sources to target weights by entropy balancing.

Targets: sources in code point order (null last) weigh by a repeating cycle and
share a multiple of all words; no target exceeds ``cap`` times its source's
words, and what is over is shared again by weight (water filling, in closed form).

Rates: the rates nearest to 1 in relative entropy that meet every source's
target, none above ``cap``, are w = min(cap, exp(lambda_s * x)), where x is the
document's size over its source's mean size.  The dual is convex, with one
multiplier a source, and a document is in one source only, so its Hessian is
diagonal: every Newton step is one distributed sum by source, kept inside a
bracket.  A rate depends on (source, size) alone, so the sums run over the
histogram of sizes, which is exact and far smaller than the corpus.

Copies: in each source, by falling size, the running total of copies is the
rounded running total of rates; what a source's words then miss is made up by
one size in each power of two.  Within a size, copies go to documents in hash
order, counted in salted parts, so that a size that a third of all documents
share is not one task's work; nor is an id that very many rows share.

Only DataFrame operations run here.  Sources are a table as large as it may be,
dealt like any other; the driver sees a few totals and one row a Newton step.
Documents meet their source's row by a join that broadcasts the few sources with
very many documents.

Null and empty texts, and texts of white space only, have size 0: they are
returned with taken 0.  A null source is a source by itself.  Repeated rows are
documents of their own.  Very long texts are counted whole.  An empty table gives
an empty result.  A source that the steps leave unsolved is an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brakta.llm.common import WORD
from brakta.llm.components import FEW, SHARE, hub_join
from brakta.plans.order import in_order
from brakta.plans.staging import stage, unstage

ROW = "__row"


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """(doc_id, source, size): the number of words of each text; with ``row``, that column too."""
    return docs.select(*([row] if row else []), F.col(key).alias("doc_id"), source_key(F.col(source)).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_key(source: Column) -> Column:
    """A source as a text in code point order that is never null: null comes last."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(">"))


def targets(hist: DataFrame, cycle: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, src, source_size, n_docs, target): one row per source; ``src`` numbers them from 0.  Runs four jobs."""
    by = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    ranked = in_order(by, [F.col("source").asc()], "sources", "src")
    cap_words = F.lit(cap) * F.col("source_size")
    weighted = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("src") % len(cycle) + 1).cast("int"))).withColumn("ratio", cap_words / F.col("weight"))
    # Sources reach their caps in rising order of cap over weight; before the first that does not, all below it are full.
    filled = in_order(weighted, [F.col("ratio").asc(), F.col("src").asc()], "rising-sources", "place", {"full": cap_words, "closed": F.col("weight")})
    words, weights = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(share) * F.lit(words) - F.col("full")) / (F.lit(weights) - F.col("closed"))
    first = filled.withColumn("level", level).filter("level <= ratio").agg(F.min(F.struct("place", "level")).alias("f")).first()["f"] if words is not None else None
    target = F.least(cap_words, F.col("weight") * F.lit(first["level"])) if first else cap_words
    return stage(filled.select("source", "src", "source_size", "n_docs", target.cast("double").alias("target")), "targets")


def rate(tilt: Column, x: Column, cap: float) -> Column:
    """min(cap, exp(tilt * x)), without overflow; where all words are to be taken ``cap`` times, tilt is null."""
    return F.when(tilt.isNull(), F.lit(cap)).otherwise(F.exp(F.least(tilt * x, F.lit(math.log(cap)))))


def solve(cells: DataFrame, sources: DataFrame, cap: float, steps: int = 200, close: float = 1e-10) -> DataFrame:
    """(src, tilt): Newton's method on the dual of each source, all open sources in one job a step; the driver sees how many are open.

    cells: (src, x, w): sizes over the mean, with the words of each as a share of the source.
    sources: (src, source_size, target).  A source whose words are all taken ``cap`` times has no row.
    """
    goal = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(cap))
    infinite = float("inf")
    start = sources.select("src", goal.alias("goal")).filter(F.col("goal") < cap * (1 - 1e-12))
    state = stage(start.withColumns({"tilt": F.lit(0.0), "low": F.lit(-infinite), "high": F.lit(infinite), "done": F.lit(False)}), "newton")
    for _ in range(steps):
        if state.filter("not done").limit(1).count() == 0:
            return state.select("src", F.round("tilt", 9).alias("tilt"))
        r = rate(F.col("tilt"), F.col("x"), cap)
        sums = cells.join(state.filter("not done").select("src", "tilt"), "src").groupBy("src").agg(
            F.sum(F.col("w") * r).alias("value"), F.sum(F.when(F.col("tilt") * F.col("x") < math.log(cap), F.col("w") * F.col("x") * r).otherwise(0.0)).alias("slope"))
        miss = F.col("value") - F.col("goal")
        moved = state.join(sums, "src", "left").withColumns({
            "near": F.coalesce(F.abs(miss) <= close * F.col("goal"), F.lit(True)),
            "low": F.when(miss < 0, F.col("tilt")).otherwise(F.col("low")),
            "high": F.when(miss >= 0, F.col("tilt")).otherwise(F.col("high")),
        })
        reach = 2 * F.abs("tilt") + 1
        # Where doubles can tell the bracket's ends apart no more, the source is as solved as it can be.
        moved = moved.withColumns({
            "step": F.when(F.col("slope") > 1e-300, F.col("tilt") - miss / F.col("slope")),
            "from": F.greatest("low", F.col("tilt") - reach), "to": F.least("high", F.col("tilt") + reach),
            "done": F.col("done") | F.col("near") | (F.col("high") - F.col("low") <= 1e-14 * (1 + F.abs("tilt"))),
        })
        inside = F.coalesce((F.col("step") > F.col("from")) & (F.col("step") < F.col("to")), F.lit(False))
        tilt = F.when(F.col("done"), F.col("tilt")).when(inside, F.col("step")).otherwise((F.col("from") + F.col("to")) / 2)
        before, state = state, stage(moved.select("src", "goal", tilt.alias("tilt"), "low", "high", "done"), "newton")
        unstage(before)
    raise RuntimeError(f"sources left unsolved after {steps} steps")


def allot(cells: DataFrame, cap: float) -> DataFrame:
    """Adds ``copies``, whole copies for all documents of a (source, size) together; words come to within the smallest sizes of the target."""
    down = Window.partitionBy("src").orderBy(F.col("size").desc())
    total = F.round(F.sum(F.col("n") * F.col("rate")).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)), 0)
    before = F.round(F.coalesce(F.sum(F.col("n") * F.col("rate")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), 0)
    first = cells.withColumn("copies", F.least((total - before).cast("long"), F.lit(int(cap)) * F.col("n")))
    miss = F.sum(F.col("copies") * F.col("size")).over(Window.partitionBy("src"))
    first = first.withColumns({"miss": F.round("target", 0).cast("long") - miss, "band": F.floor(F.log2("size")).cast("int")})
    room = F.when(F.col("miss") > 0, F.lit(int(cap)) * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
    # The size with the most room in each power of two: at most 64 a source.
    chosen = first.groupBy("src", "band").agg(F.max(F.struct(room.alias("room"), F.col("size").alias("size"), F.col("miss").alias("miss"))).alias("c"))
    listed = chosen.groupBy("src").agg(F.first("c.miss").alias("miss"), F.sort_array(F.collect_list(F.struct("c.size", "c.room")), asc=False).alias("cs"))
    kind = "array<struct<size:bigint,change:bigint>>"

    def put(acc, c):
        wanted = F.when(c["size"] > F.abs(acc["left"]), F.lit(0).cast("long")).otherwise(F.floor(F.abs(acc["left"]) / c["size"]))
        used = F.least(wanted, c["room"]) * F.signum(acc["left"].cast("double")).cast("long")
        return F.struct((acc["left"] - used * c["size"]).alias("left"), F.concat(acc["put"], F.array(F.struct(c["size"].alias("size"), used.alias("change")))).alias("put"))

    zero = F.struct(F.col("miss").alias("left"), F.from_json(F.lit("[]"), kind).alias("put"))
    changes = listed.select("src", F.inline(F.aggregate("cs", zero, put, lambda a: a["put"])))
    return first.join(changes, ["src", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).select("src", "size", "n", "rate", "copies")


def placed(rows: DataFrame, total: int, parts: int) -> DataFrame:
    """Adds ``part``, by a hash of the id; rows with no id, or with one of the few that very many rows share, by their own."""
    cut = max(FEW, total // SHARE)
    shared = F.broadcast(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("doc_id").isNotNull() & (F.col("n") > cut)).select("doc_id", F.lit(True).alias("shared")))
    own = F.col("shared").isNotNull() | F.col("doc_id").isNull()
    place = F.when(own, F.xxhash64(ROW, F.lit(4))).otherwise(F.xxhash64("doc_id", F.lit(4)))
    return rows.join(shared, "doc_id", "left").withColumn("part", F.pmod(place, F.lit(parts)).cast("int")).drop("shared")


def mix(docs: DataFrame, cycle: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, key: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, rate) for every row of ``docs``.

    ``row`` names a key of each row that is carried through: ids may be null or repeated.
    Runs a job for the sizes, some for sources and one a Newton step.
    """
    sizes = stage(sized(docs, key, text, source, row).withColumn(ROW, F.col(row) if row else F.monotonically_increasing_id()), "sizes")
    hist = stage(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "size-hist")
    goals = targets(hist, cycle, float(share), float(cap))
    total = sizes.count()
    facts = goals.select("source", F.struct("src", "source_size", "target").alias("m"), F.col("n_docs").alias("n"))
    named = stage(hub_join(sizes, facts, "source", total).select(*(c for c in sizes.columns if c != "source"), "m.*"), "named-sizes")
    cells = hist.join(goals, "source").drop("source").filter("size > 0")
    x = F.col("size") * F.col("n_docs") / F.col("source_size")
    scaled = stage(cells.select("src", x.alias("x"), (F.col("size") * F.col("n") / F.col("source_size")).alias("w")), "size-cells")
    tilts = solve(scaled, goals, float(cap))
    unstage(scaled)
    tilted = cells.join(tilts, "src", "left").withColumn("rate", rate(F.col("tilt"), x, float(cap)))
    copies = stage(allot(tilted, cap), "copies")
    unstage(tilts)

    # Parts of at most some ten thousand documents that share source and size: copies are dealt to parts, then by rank.
    parts = max(64, math.ceil(total / 20_000))
    salted = stage(placed(named, total, parts), "salted-sizes")
    unstage(named)
    held = salted.filter("size > 0").groupBy("src", "size", "part").agg(F.count("*").alias("held"))
    upto = F.sum("held").over(Window.partitionBy("src", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    dealt = held.withColumn("upto", upto).join(copies, ["src", "size"]).select(
        "src", "size", "part", "held", "rate",
        (F.floor(F.col("copies") * F.col("upto") / F.col("n") + 0.5) - F.floor(F.col("copies") * (F.col("upto") - F.col("held")) / F.col("n") + 0.5)).alias("part_copies"))
    rank = F.row_number().over(Window.partitionBy("src", "size", "part").orderBy(F.xxhash64("doc_id"), "doc_id", ROW))
    whole = F.floor(F.col("part_copies") / F.col("held"))
    own = (whole + F.when(F.col("rank") <= F.col("part_copies") - whole * F.col("held"), 1).otherwise(0)).cast("long")
    out = salted.withColumn("rank", rank).join(dealt.withColumnRenamed("rate", "own_rate"), ["src", "size", "part"], "left").withColumn("copies", F.coalesce(own, F.lit(0).cast("long")))
    return out.select(*([row] if row else []), "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", F.coalesce("own_rate", F.lit(0.0)).alias("rate"))
