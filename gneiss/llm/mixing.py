"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share a budget of words by weight; a target ends at so many times its
source, and what is above goes to the others by weight until none is above
(one water level over sources in order of limit per weight). Whole epochs of a
source come first; the rest of its target is drawn: every document has an
exponential key, -ln(u) / quality with u from a hash of its doc_id and text,
keys are sorted within the source by range partitions, and prefix sums of sizes
say up to which key documents are drawn. That key, one row a source, goes back
to the documents, so texts are neither sorted nor shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.order import positions, running
from gneiss.sources.storage import materialize

#: Share of all words that the mix has, and epochs of a source at most.
SHARE, EPOCHS = 1.5, 2
WEIGHTS = (3, 1, 2)
SEED = 17
_WORDS = r"[^\x20\x09-\x0D]+"
_PLAN = ["size", "source_size", "target", "copies", "taken"]


def measure(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with ``size`` (words; null text: 0) and ``draw``, a number in (0, 1) that depends on seed, doc_id and text alone."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.concat(F.lit(f"{seed} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), text)
    # 52 bits, so that neither the sum nor the quotient rounds to 0 or 1
    draw = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))
    return docs.withColumns({"size": F.regexp_count(text, F.lit(_WORDS)).cast("long"), "draw": draw})


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of each source of ``sizes`` (source, source_size).

    ``weights`` go to sources by code point, null last, and repeat; they must
    be positive. Together the targets are ``share`` of all sizes, each at most
    ``epochs`` times its source (all at that limit, where share is above it).
    """
    ranked = positions(sizes, F.asc_nulls_last("source"), name="rank")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("ratio", F.lit(float(epochs)) * F.col("source_size") / F.col("weight"))
    level = running(ranked, [F.asc("ratio"), F.asc("rank")], {"sizes": F.col("source_size"), "weights": F.col("weight")})
    level = materialize(level, "levels")
    total, all_weights = level.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (total or 0)
    before = F.lit(float(epochs)) * (F.col("sizes") - F.col("source_size"))
    # what is left for this source and those after it reaches its limit
    full = F.col("ratio") * (F.lit(all_weights) - F.col("weights") + F.col("weight")) <= F.lit(budget) - before
    level = level.withColumn("full", full)
    held, free = level.agg(F.sum(F.when(F.col("full"), F.col("source_size"))), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
    height = (budget - epochs * (held or 0)) / free if free else 0.0
    return level.select("source", "source_size", F.when(F.col("full"), F.lit(float(epochs)) * F.col("source_size")).otherwise(F.col("weight") * F.lit(height)).alias("target"))


def plan(measured: DataFrame, quality: Column | None = None, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """``measured`` (see :func:`measure`) with its ``source_size``, ``target``, ``copies`` and ``taken`` (words).

    ``copies`` are the whole epochs of the source, and one more where the
    document is drawn for the rest: in order of its key, as long as the sum of
    sizes with it is at least as near to the rest as without. ``quality`` is
    the weight of a document in the draw (null: 1; 0 or less: drawn last).
    Rows that share doc_id and text have the same key; if only some of them
    are drawn, which ones is arbitrary. Documents of size 0 take nothing. A
    null source is a source. Clashing columns are replaced. An empty table
    gives an empty result.
    """
    weight = F.coalesce(quality.cast("double"), F.lit(1.0)) if quality is not None else F.lit(1.0)
    key = F.when(weight > 0, -F.log("draw") / weight).otherwise(F.lit(float("inf")))
    keyed = measured.drop("source_size", "target", "copies", "taken").withColumn("__key", key)
    # one row for rows of one key, so repeated rows don't meet in one task
    groups = materialize(keyed.groupBy("source", "__key", "size").agg(F.count("*").alias("n")), "mix_keys")
    sizes = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = materialize(targets(sizes, weights, share, epochs).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)), "mix_targets")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    wanted = groups.where("size > 0").join(goal.withColumn("rest", rest).where("rest > 0").select(F.col("source").alias("of"), "rest"), F.col("source").eqNullSafe(F.col("of")))
    # groups of running() must not be null
    wanted = wanted.withColumn("named", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
    summed = running(wanted, [F.asc("__key"), F.asc("size")], {"upto": F.col("size") * F.col("n")}, by=["named"])
    fits = F.floor((F.col("rest") - (F.col("upto") - F.col("size") * F.col("n"))) / F.col("size") + 0.5)
    some = summed.withColumn("drawn", F.greatest(F.lit(0), F.least(fits, F.col("n")))).where("drawn > 0")
    last = some.groupBy("source").agg(F.max(F.when(F.col("drawn") == F.col("n"), F.col("__key"))).alias("whole"), F.max(F.when(F.col("drawn") < F.col("n"), F.struct("__key", "drawn"))).alias("part"))
    cuts = goal.join(last.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left")
    cuts = materialize(cuts.select(F.col("source").alias("__of"), "source_size", "target", "epochs", "whole", F.col("part.__key").alias("part"), F.col("part.drawn").alias("drawn")), "mix_cuts")

    placed = keyed.join(cuts, F.col("source").eqNullSafe(F.col("__of")))
    extra = F.coalesce((F.col("size") > 0) & (F.col("__key") <= F.col("whole")), F.lit(False)).cast("long")
    if cuts.where("part is not null").first() is not None:
        # of the rows of this key some are drawn: rows are counted off by range partitions
        partly = F.coalesce((F.col("size") > 0) & (F.col("__key") == F.col("part")), F.lit(False))
        off = placed.where(partly).withColumn("named", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
        off = positions(off.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id())), F.asc("__salt"), by=["named"], name="__at").drop("named", "__salt")
        off = off.withColumn("__extra", (F.col("__at") < F.col("drawn")).cast("long")).drop("__at")
        placed = placed.where(~partly).withColumn("__extra", extra).unionByName(off)
    else:
        placed = placed.withColumn("__extra", extra)
    copies = F.col("epochs") + F.col("__extra")
    return placed.withColumns({"copies": copies, "taken": copies * F.col("size")}).select(*keyed.drop("__key").columns, "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, quality: Column | None = None, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: each document of ``docs`` as often as :func:`plan` says, with ``epoch`` from 0."""
    drawn = plan(measure(docs, seed), quality, weights, share, epochs).where("copies > 0 and size > 0")
    repeated = drawn.drop("epoch").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return repeated.select(*(c for c in docs.columns if c not in {"epoch", "draw", *_PLAN}), "epoch")


def oracle() -> str:
    """The plan of all documents, weighted by their labels' quality, as DuckDB SQL."""
    words = ", ".join(map(str, WEIGHTS))
    return f"""
    with rated as (select doc_id, 0.5 + 1.5 * avg(quality) as weight from labels group by doc_id),
    sized as (
        select d.doc_id, d.source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) as size,
               -ln((cast('0x' || md5(concat('{SEED} ', coalesce(cast(d.doc_id as varchar), ''), ' ', coalesce(text, '')))[1:13] as bigint) + 0.5) / {2**52}.0) / coalesce(weight, 1.0) as draw_key
        from documents d left join rated r on d.doc_id = r.doc_id),
    sources as (
        select source, sum(size) as source_size, row_number() over (order by source nulls last) - 1 as place from sized group by source),
    rates as (select *, cast([{words}][cast(place % {len(WEIGHTS)} + 1 as integer)] as double) as weight from sources),
    ratios as (select *, {EPOCHS} * source_size / weight as ratio from rates),
    sums as (
        select *, sum(source_size) over upto - source_size as size_before, sum(weight) over upto - weight as weight_before, sum(weight) over () as weights, {SHARE} * sum(source_size) over () as budget
        from ratios window upto as (order by ratio, place rows between unbounded preceding and current row)),
    filled as (select *, ratio * (weights - weight_before) <= budget - {EPOCHS} * size_before as whole from sums),
    goals as (
        select source, source_size,
               case when whole then {EPOCHS}.0 * source_size
                    else weight * ((budget - {EPOCHS} * coalesce(sum(source_size) filter (whole) over (), 0)) / (sum(weight) filter (not whole) over ())) end as target
        from filled),
    rests as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from goals),
    summed as (
        select s.doc_id, s.size, r.source_size, r.target, r.epochs, r.target - r.epochs * r.source_size as rest,
               sum(s.size) over (partition by s.source order by s.draw_key, s.size rows between unbounded preceding and current row) - s.size as before
        from sized s join rests r on s.source is not distinct from r.source)
    select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, cast(target as double) as target,
           cast((epochs + case when rest > 0 and before + size / 2.0 <= rest then 1 else 0 end) * size as bigint) as taken
    from summed"""
