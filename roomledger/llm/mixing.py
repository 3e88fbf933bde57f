"""Mixing sources to target weights (operator 6): entropy balancing.

Each document gets a rate ``exp(lambda * size / scale)`` (at most ``cap``):
the rates closest in entropy to "each once" whose expected words per source
equal the source's target.  The dual is convex with one multiplier per
source; all sources take a Newton step per round, kept inside a bracket.
Documents of one source and size share their rate, so a round sums over the
table of (source, size, documents).  The sums are exact decimals: any order
of adding gives the same multipliers, and reruns agree.

Rates become whole copies by systematic rounding along each source's
documents from the largest down (copies add up to the running sum of rates),
and what a source then lacks or exceeds is evened out by one copy more or
less of its smallest documents.

DataFrame functions only; nothing per document reaches the driver.

Cases: a null text has size 0 and takes nothing; a null source is a source of
its own (last in order); empty sources have target 0; an empty table gives an
empty result; repeated rows are separate documents of equal rate; rows without
an id are told apart by their text; of a very long text only its number of
words counts; only the named columns are read, others are kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked
from .staging import apart, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
MAX_ROUNDS = 100


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, tie, src, source, size): ``src`` is the source with null told apart."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tie"), source_key(source_col).alias("src"),
                       F.col(source_col).alias("source"), size.alias("size"))


def source_key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))


def targets(sources: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(src, source_size, target) from one row per source (src, source,
    source_size).  ``weights`` repeat along the sources by code point, null
    last.  Targets above ``cap`` times the source are cut there and the
    excess goes to the others by weight: a source is cut when its cap per
    weight is at most the level that the sources from it on would share."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "src")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
                           / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    cut = F.col("most") <= F.col("weight") * F.col("level")
    rows = rows.withColumn("cut", cut).withColumn("level", F.max(F.when(~F.col("cut"), F.col("level"))).over(everything))
    return rows.select("src", "source_size", F.when(F.col("cut"), F.col("most")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def exact(c: Column) -> Column:
    """A term of a sum that does not depend on the order of adding."""
    return F.round(c, 6).cast("decimal(38,6)")


def rate(cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0))))


def multipliers(groups: DataFrame, goals: DataFrame, cap: int = CAP, tolerance: float = 1e-6) -> DataFrame:
    """(src, target, scale, lam): the dual's solution per source.  ``groups``
    has src, size, n."""
    moments = groups.groupBy("src").agg(F.sum((F.col("n") * F.col("size")).cast("decimal(38,0)") * F.col("size")).alias("squares"))
    state = goals.join(moments, "src").select(
        "src", "target", "source_size", F.greatest(F.col("squares").cast("double") / F.greatest("source_size", F.lit(1)), F.lit(1.0)).alias("scale"),
        # a target at the cap takes every document as often as allowed
        F.when((F.col("source_size") > 0) & (F.col("target") >= F.lit(float(cap)) * F.col("source_size") * F.lit(1 - 1e-9)), F.lit(1e6))
        .otherwise(F.lit(0.0)).alias("lam"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    state = staged(state.withColumn("done", (F.col("lam") > 0) | (F.col("source_size") == 0) | (F.col("target") <= 0)), "dual")
    for _ in range(MAX_ROUNDS):
        if state.where(~F.col("done")).isEmpty():
            break
        x, words = F.col("size") / F.col("scale"), F.col("n") * F.col("size")
        r = rate(cap)
        sums = groups.join(state.where(~F.col("done")).select("src", "scale", "lam"), "src").groupBy("src").agg(
            F.sum(exact(words * r)).cast("double").alias("f"),
            F.sum(exact(F.when(r < cap, words * x * r).otherwise(0.0))).cast("double").alias("slope"))
        gap = F.col("f") - F.col("target")
        rows = state.join(sums, "src", "left")
        near = F.col("done") | (F.abs(gap) <= F.lit(tolerance) * F.greatest("target", F.lit(1.0)))
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        rows = rows.select("src", "target", "source_size", "scale", "lam", low.alias("low"), high.alias("high"),
                           F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope")).alias("newton"), near.alias("done"))
        inside = F.col("newton").isNotNull() & (F.col("low").isNull() | (F.col("newton") > F.col("low"))) \
            & (F.col("high").isNull() | (F.col("newton") < F.col("high")))
        # away from the bracket: halve it, or double the step where it is open
        other = F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), (F.col("low") + F.col("high")) / 2) \
            .when(F.col("low").isNotNull(), F.col("lam") + F.greatest(F.abs("lam"), F.lit(1.0))) \
            .otherwise(F.col("lam") - F.greatest(F.abs("lam"), F.lit(1.0)))
        step = F.when(inside, F.least(F.greatest("newton", F.col("lam") - 20), F.col("lam") + 20)).otherwise(other)
        state = staged(rows.withColumn("lam", F.when(F.col("done"), F.col("lam")).otherwise(step)).drop("newton"), "dual")
    else:
        if not state.where(~F.col("done")).isEmpty():
            raise RuntimeError(f"the dual has not converged in {MAX_ROUNDS} rounds")
    return state.select("src", "target", "scale", "lam")


def copies(rows: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``rows`` (id, tie, src, source, size) with source_size, target, rate
    and copies (int)."""
    groups = staged(rows.groupBy("src", "source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    goals = staged(targets(groups.groupBy("src", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, cap), "targets")
    dual = multipliers(groups, goals, cap)
    down = Window.partitionBy("src").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    rated = groups.join(dual, "src").join(goals.select("src", "source_size"), "src").withColumn("rate", rate(cap)) \
        .withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(down), F.lit(0.0))) \
        .select("src", "size", "n", "source_size", "target", "rate", "before")
    rated = staged(rated, "rates")

    order = [F.col("id"), F.col("tie")]
    known = F.coalesce(F.col("id"), F.lit(-(1 << 63))).alias("known")  # rows without an id are joined too
    placed = ranked(rows, ["src", "size"], order, rated.select("src", "size", "n"), "place") \
        .join(rated.select("src", "size", "source_size", "target", "rate", "before"), ["src", "size"])
    upto = lambda k: F.floor(F.col("before") + (F.col("place") + k) * F.col("rate") + F.lit(0.5))
    placed = staged(placed.withColumn("copies", F.least(F.greatest(upto(1) - upto(0), F.lit(0)), F.lit(cap)).cast("int")).drop("before", "place"), "rounded")

    # What the sources still lack (or have too much), in one copy each of
    # their smallest documents that may take one (or give one).
    lacking = placed.groupBy("src", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")) \
        .select("src", F.round(F.col("target") - F.col("taken")).cast("long").alias("lack"))
    may = (F.col("size") > 0) & F.when(F.col("lack") > 0, F.col("copies") < cap).when(F.col("lack") < 0, F.col("copies") > 0).otherwise(F.lit(False))
    # by size and copies first: the rows of a large source do not meet
    able = placed.groupBy("src", "size", "copies").agg(F.count(F.lit(1)).alias("rows")) \
        .join(lacking.where("lack <> 0"), "src").where(may)
    up = Window.partitionBy("src").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    moved = able.groupBy("src", "size", "lack").agg(F.sum("rows").alias("n")) \
        .withColumn("spent", F.coalesce(F.sum(F.col("n") * F.col("size")).over(up), F.lit(0))) \
        .withColumn("moves", F.least("n", F.expr("(abs(lack) - spent) DIV size"))).where("moves > 0")
    moved = staged(moved.select("src", "size", "n", "moves", "lack"), "moves")
    numbered = ranked(placed.join(moved.select("src", "size", "lack", "moves"), ["src", "size"], "left").withColumn("able", F.coalesce(may, F.lit(False)))
                      .where("able"), ["src", "size"], order, moved.select("src", "size", "n"), "turn")
    changed = numbered.where("turn < moves").select("src", "size", known, "tie", F.signum("lack").cast("int").alias("change"), "copies")
    # equal rows (same id, text, source) may differ in copies: change as many of them as were numbered
    keys = ["src", "size", "known", "tie", "copies"]
    same = Window.partitionBy(*keys).orderBy(F.lit(0))
    left = placed.withColumn("known", known).withColumn("twin", F.row_number().over(same))
    right = changed.withColumn("twin", F.row_number().over(same))
    return left.join(right, [*keys, "twin"], "left") \
        .withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("twin", "change", "known")


def mixed(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """Per document: id, size, source_size, target, rate, copies, taken."""
    rows = staged(sized(docs, id_col, text_col, source_col), "sized")
    return copies(rows, weights, cap).select(F.col("id").alias(id_col), "size", "source_size", "target", "rate", "copies",
                                             (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source") -> DataFrame:
    """``docs``, each row as often as it has copies (none: it goes)."""
    rows = staged(sized(docs, id_col, text_col, source_col), "sized")
    same = ["id", "tie", "src"]
    per_text = copies(rows, weights, cap).groupBy(*same).agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("twins"))
    names = dict(zip([*same, "total", "twins", "turn", "copy"], apart(docs.columns, *same, "total", "twins", "turn", "copy")))
    plan = per_text.withColumnsRenamed(names)
    keyed = docs.withColumns({names["tie"]: F.xxhash64(F.col(text_col)), names["src"]: source_key(source_col)})
    joined = keyed.join(plan, F.col(id_col).eqNullSafe(F.col(names["id"])) & (keyed[names["tie"]] == plan[names["tie"]])
                        & (keyed[names["src"]] == plan[names["src"]])) \
        .select(*docs.columns, *(plan[names[c]] for c in (*same, "total", "twins"))).where(F.col(names["total"]) > 0)
    single = joined.where(F.col(names["twins"]) == 1)
    # repeated rows share their copies: the first of them takes all
    turn = F.row_number().over(Window.partitionBy(*(names[c] for c in same)).orderBy(F.lit(0)))
    twins = joined.where(F.col(names["twins"]) > 1).withColumn(names["turn"], turn).where(F.col(names["turn"]) == 1).drop(names["turn"])
    every = single.unionByName(twins)
    return every.withColumn(names["copy"], F.explode(F.sequence(F.lit(1), F.col(names["total"]).cast("int")))).select(*docs.columns)
