"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a share of all words by weight, at most ``cap`` times its own
size; what is above the cap is shared again by weight among the others (the
limit of that resharing is found in closed form on the source table). A
document of a source is then wanted target / source size times: the whole
part is certain, the fraction is a copy probability.

Fractions are rounded in pairs. Two documents exchange probability so that the
expected words of the pair stay the same, until one of the two is certain;
which one is drawn with the odds that keep both expectations. The other goes
on to the next pair, so a group of documents ends with one undecided document
and has moved no words. Groups of about ``GROUP`` documents of a source are
rounded first, their undecided documents are grouped again, and so on: a
reduction tree with a shuffle of one row a group at each level. The last
undecided document of a source goes to the nearer side, so a source ends
within half the size of one of its documents of its target.

Draws are hashes of the document's key, so reruns agree whatever the
partitioning. A null text and a text without words have size zero and are
taken once or not at all without changing any sum; a null source is a source
of its own, ordered last. Repeated rows (equal document key, source and text)
are one unit, taken alike. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderwell.llm.common import n_words, packed, table, unpacked
from cinderwell.session import stable_checkpoint

WEIGHTS = (1.0, 2.0, 3.0)
CAP = 3.0
GROUP = 64
SEED = 20


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size), a row for each source -> adds ``target``.

    Sources by code point, null last, take the weights in turn. A source is
    capped if its cap per weight is below the common words per weight ``rate``;
    with sources in that order, the first k whose caps are below what the rest
    would then get are the capped ones.
    """
    in_turn = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    top = F.col("source_size") * cap
    s = sizes.withColumn("weight", F.get(in_turn, place % len(weights))).withColumn("top", top)
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "words": F.sum("source_size").over(everything).cast("double"), "weights": F.sum("weight").over(everything),
        "top_before": F.coalesce(F.sum("top").over(order), F.lit(0.0)),
        "weights_before": F.coalesce(F.sum("weight").over(order), F.lit(0.0))})
    rate = (F.col("words") - F.col("top_before")) / (F.col("weights") - F.col("weights_before"))
    # the first source in order that is not capped sets the rate of all after it
    s = s.withColumn("rate", F.when(rate * F.col("weight") <= F.col("top"), rate))
    s = s.withColumn("rate", F.max_by("rate", F.when(F.col("rate").isNotNull(), -F.col("weights_before"))).over(everything))
    target = F.least(F.col("top"), F.coalesce(F.col("rate") * F.col("weight"), F.col("top")))
    return s.select(*sizes.columns, target.alias("target"))


def _draw(key: Column, level: Column | int) -> Column:
    """Uniform in [0, 1), the same for the same key."""
    level = F.lit(level) if isinstance(level, int) else level
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), level, key), 11) * F.lit(2.0 ** -53)


def _pivotal(items: Column, level: int) -> Column:
    """Sequential pivotal rounding of an array of struct(key, mass, p): an
    array of the same units with final p, the undecided one last.

    ``state`` holds the undecided unit and the decided ones. mass * p summed
    over the units stays as it was.
    """
    def unit(x: Column, p: Column) -> Column:
        return F.struct(x["key"].alias("key"), x["mass"].alias("mass"), p.alias("p"))

    def step(state: Column, y: Column) -> Column:
        x, a, b = state["open"], state["open"]["mass"], y["mass"]
        ratio = a / b
        up = F.least(1 - x["p"], y["p"] / ratio)  # x may rise so far, y falling
        down = F.least(x["p"], (1 - y["p"]) / ratio)
        rises = _draw(y["key"], level) * (up + down) < down
        px = F.when(rises, x["p"] + up).otherwise(x["p"] - down)
        py = F.when(rises, y["p"] - up * ratio).otherwise(y["p"] + down * ratio)
        # the one that met its bound is exactly 0 or 1
        x_done = F.when(rises, up == 1 - x["p"]).otherwise(down == x["p"])
        px = F.when(x_done, F.when(rises, 1.0).otherwise(0.0)).otherwise(px)
        py = F.when(x_done, py).otherwise(F.when(rises, 0.0).otherwise(1.0))
        moved = F.array(F.struct(px.alias("x"), py.alias("y"), x_done.alias("done")))
        # an array of one element binds the three values once
        return F.get(F.transform(moved, lambda m: F.struct(
            F.when(m["done"], unit(y, m["y"])).otherwise(unit(x, m["x"])).alias("open"),
            F.concat(state["closed"], F.array(F.when(m["done"], unit(x, m["x"])).otherwise(unit(y, m["y"])))).alias("closed"))), F.lit(0))

    head = F.get(items, F.lit(0))
    start = F.struct(unit(head, head["p"]).alias("open"), F.slice(F.transform(items, lambda x: unit(x, x["p"])), 1, 0).alias("closed"))
    return F.aggregate(F.slice(items, 2, F.size(items)), start, step, lambda s: F.concat(s["closed"], F.array(s["open"])))


def rounded(units: DataFrame, most: int, group: int = GROUP) -> DataFrame:
    """(source, key, mass, p, n) with 0 < p < 1, mass > 0 and n units of the
    source, at most ``most`` -> (key, extra): 1 for a unit whose fraction is
    rounded up, else 0."""
    levels = max(1, math.ceil(math.log(max(most, 2), group / 2)))
    out, rest = None, units
    for level in range(levels):
        last = level == levels - 1
        parts = F.lit(1) if last else F.ceil(F.col("n") / (group / 2) ** (level + 1))
        part = F.pmod(F.xxhash64(F.lit(SEED + 1), F.lit(level), "key"), parts)
        # large documents first: they are settled while others remain to trade with
        item = F.struct((-F.col("mass")).alias("order"), F.xxhash64(F.lit(SEED + 2), F.lit(level), F.col("key")).alias("tie"), "key", "mass", "p")
        done = rest.groupBy("source", part.alias("part")).agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("n").alias("n"))
        done = done.select("source", "n", _pivotal(F.col("items"), level).alias("items"))
        done = stable_checkpoint(done.select("source", "n", F.posexplode("items").alias("i", "u"), F.size("items").alias("size"))
                                 .select("source", "n", "u.key", "u.mass", "u.p", (F.col("i") == F.col("size") - 1).alias("open")))
        p = F.col("p")
        sure = ~F.col("open") | (p <= 0) | (p >= 1)
        closed = done.where(F.lit(True) if last else sure).select("key", (p >= 0.5).cast("int").alias("extra"))
        out = closed if out is None else out.unionByName(closed)
        rest = done.where(~sure).select("source", "key", "mass", "p", "n")
    return out


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
           weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(key, n_rows, size, source_size, target, copies) for each unit: rows that
    agree in doc_id, source and text hash (``key``). One pass over the texts."""
    c = lambda name: docs[f"`{name}`"]
    key = F.struct(c(doc_id).alias("doc_id"), c(source).alias("source"), F.xxhash64(c(text)).alias("h"))
    units = docs.select(key.alias("key"), n_words(c(text)).alias("size")).groupBy("key").agg(
        F.count("*").alias("n_rows"), F.first("size").alias("size"))
    units = stable_checkpoint(units.withColumn("source", F.col("key.source")))
    totals = stable_checkpoint(units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count("*").alias("n")))
    most = totals.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    targets = source_targets(totals, weights, cap)
    on = units["source"].eqNullSafe(targets["source"])
    wanted = units.join(targets, on).drop(targets["source"])
    per_row = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(1.0))
    wanted = wanted.withColumn("whole", F.floor(per_row)).withColumn("p", per_row - F.floor(per_row))
    open_units = stable_checkpoint(wanted.where("p > 0").select(
        "source", "key", (F.col("size") * F.col("n_rows")).cast("double").alias("mass"), "p", "n"))
    up = rounded(open_units.where("mass > 0"), most)
    # without words there is nothing to exchange: a draw for each alone
    empty = open_units.where("mass = 0").select("key", (_draw(F.col("key"), -1) < F.col("p")).cast("int").alias("extra"))
    up = up.unionByName(empty).select(F.col("key").alias("k"), "extra")
    same = (wanted.key["doc_id"].eqNullSafe(up.k["doc_id"])) & (wanted.key["source"].eqNullSafe(up.k["source"])) & (wanted.key["h"] == up.k["h"])
    return wanted.join(up, same, "left").select(
        "key", "n_rows", "size", "source_size", "target", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("long").alias("copies"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """The documents as often as the mix takes them, all columns as they were;
    a document that it does not take is gone."""
    n = copies(docs, doc_id, text, source, weights, cap).where("copies > 0").select(F.col("key").alias("k"), "copies")
    rows = packed(docs, docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{source}`"].alias("source"), F.xxhash64(docs[f"`{text}`"]).alias("h"))
    on = (rows["doc_id"].eqNullSafe(n.k["doc_id"])) & (rows["source"].eqNullSafe(n.k["source"])) & (rows["h"] == n.k["h"])
    out = rows.join(n, on).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return unpacked(out, docs.columns)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # a row for each input row: repeated rows are taken alike
    out = copies(docs).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    return out.select(F.col("key.doc_id").alias("doc_id"), "size", "source_size", "target",
                      (F.col("copies") * F.col("size")).alias("taken"))
