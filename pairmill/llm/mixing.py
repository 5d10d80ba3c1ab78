"""Mixing sources to target weights by pivotal rounding (operator 9); DataFrame functions only.

Every document of a source is taken target / size of its source times: whole
copies for all, and one more for a share of the documents. That share is
rounded so that the words taken stay what they should be: two documents with
fractional probabilities trade words, up or down by chance with the odds that
keep each probability's mean, until one of them is 0 or 1; the other goes on
to the next. A group of at most a few hundred documents leaves one such
document; those meet in groups again, level by level, until one is left in
each source, which is rounded to the nearer whole; in its group the bits of
documents are turned, large to small, where that brings the words taken nearer
to the target.

The chances come from hashes of the documents' ids and texts with their source
and group, so reruns agree and no two groups share their draws. A null text has size 0
and is taken 0 words; a null source is a source of its own, last. Repeated ids
and rows are documents of their own; equal rows are numbered and dealt over all
groups. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairmill.llm import common

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Documents that one group has on average; its rounding runs in one row.
GROUP = 128
SEED = 20240
#: Sources up to which their table is sent to all tasks.
FEW_SOURCES = 50_000


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, source and number of words of each document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))


#: Equal rows that one row is opened into at once.
OPENED = 10_000


def numbered(sized: DataFrame) -> DataFrame:
    """sized with nth: 0, 1, ... within equal rows, however many; counted before they are shuffled."""
    own = sized.columns
    rows = sized.groupBy(*own).agg(F.count("*").alias("rows"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / OPENED))))
    first = F.col("part") * OPENED
    return rows.select(*own, F.explode(F.sequence(first, F.least(F.col("rows"), first + OPENED) - 1)).alias("nth"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target and n (documents with words) of each source.

    The total is dealt by weight; what a source can't take (over most times
    its size) is dealt again among the others, which comes to one level for
    all sources below their limit. A source's rank and that level need all
    sources in order: one task over a row for each source.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1).cast("double")
    by = by.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    first = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(first), F.lit(0.0))
    level = rest / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(first), F.lit(0.0)))
    by = by.withColumn("level", level)
    # the first source that the level leaves below its limit sets the level for it and all after
    below = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)
    target = F.when(below.isNull() | (F.col("cap") / F.col("weight") <= below["level"]), F.col("cap")).otherwise(below["level"] * F.col("weight"))
    return by.select("source", "source_size", "n", target.alias("target"))


def _uniform(*of: Column) -> Column:
    return (F.xxhash64(*of, F.lit(SEED)).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))


def _round(items: Column) -> Column:
    """Pivotal rounding along an array of struct(key, size, p, salt): struct(kept, done).

    kept is the element left with its probability; done the others' keys and
    bits. Two elements draw by their salts, which belong to a document.
    """
    empty = F.array().cast("array<struct<key:bigint,bit:int>>")

    def step(s, b):
        a = s["kept"]
        up = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])  # words that may move from b to a
        down = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
        rises = _uniform(a["salt"], b["salt"]) * (up + down) < down
        pa = F.when(rises, a["p"] + up / a["size"]).otherwise(a["p"] - down / a["size"])
        pb = F.when(rises, b["p"] - up / b["size"]).otherwise(b["p"] + down / b["size"])
        off = lambda p: F.least(p, 1 - p)  # noqa: E731  the nearer to a whole number is the one that is settled
        settled = off(pa) <= off(pb)
        kept = F.when(settled, F.struct(b["key"].alias("key"), b["size"].alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), pb)).alias("p"), b["salt"].alias("salt"))).otherwise(F.struct(a["key"].alias("key"), a["size"].alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), pa)).alias("p"), a["salt"].alias("salt")))
        done = F.struct(F.when(settled, a["key"]).otherwise(b["key"]).alias("key"), F.round(F.when(settled, pa).otherwise(pb)).cast("int").alias("bit"))
        return F.struct(kept.alias("kept"), F.concat(s["done"], F.array(done)).alias("done"))

    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), F.struct(F.element_at(items, 1).alias("kept"), empty.alias("done")), step)


def _repaired(bits: Column, docs: Column, over: Column) -> Column:
    """The bits of the group that holds a source's last document, some turned so that fewer words are over or missing."""
    sized = F.sort_array(F.transform(bits, lambda x: F.struct(F.element_at(docs, (x["key"] + 1).cast("int"))["size"].cast("double").alias("size"), x["key"].alias("key"), x["bit"].alias("bit"))), asc=False)
    start = F.struct(over.alias("rest"), F.array().cast("array<struct<key:bigint,bit:int,over:double>>").alias("out"))

    def step(s, x):
        turn = (x["size"] < 2 * F.abs(s["rest"])) & (x["bit"] == F.when(s["rest"] > 0, 1).otherwise(0))
        rest = F.when(turn, s["rest"] - F.signum(s["rest"]) * x["size"]).otherwise(s["rest"])
        return F.struct(rest.alias("rest"), F.concat(s["out"], F.array(F.struct(x["key"].alias("key"), F.when(turn, 1 - x["bit"]).otherwise(x["bit"]).alias("bit"), F.lit(0.0).alias("over")))).alias("out"))

    return F.aggregate(sized, start, step, lambda s: s["out"])


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, hash, source, size, source_size, target and copies of each document."""
    spark = docs.sparkSession
    sized = common.written(numbered(sizes(docs)), "mix-sizes")
    by = common.written(targets(sized, weights, share, most), "mix-targets")
    by = F.broadcast(by) if by.count() <= FEW_SOURCES else by  # its size is checked
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sized.join(by, sized["source"].eqNullSafe(by["source"])).drop(by["source"]).withColumn("whole", F.floor(rate)).withColumn("p", rate - F.floor(rate))
    moved = (F.col("size") > 0) & (F.col("p") > 0)
    keep = ("doc_id", "hash", "source", "size", "source_size", "target", "whole")
    groups = F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP))
    level = rows.where(moved).withColumn("g", F.pmod(F.pmod(F.xxhash64("doc_id", "size", F.lit(SEED)), groups) + F.col("nth"), groups))  # equal rows side by side
    top = int(by.agg(F.max("n")).first()[0] or 0)
    # the leaves: groups of documents, in order of id; equal rows stand side by side
    item = F.struct("doc_id", "hash", "size", "p", "source_size", "target", "whole")
    leaf = level.groupBy("source", "g").agg(F.sort_array(F.collect_list(item)).alias("docs"))
    keyed = F.transform("docs", lambda x, i: F.struct(i.cast("long").alias("key"), x["size"].cast("double").alias("size"), x["p"].alias("p"), F.xxhash64(x["doc_id"], x["hash"], F.col("source"), F.col("g"), i, F.lit(SEED)).alias("salt")))
    tree = [common.written(leaf.withColumn("out", _round(keyed)), "mix-0")]
    left, n = tree[0].select("source", "g", F.col("out.kept.size").alias("size"), F.col("out.kept.p").alias("p"), F.col("out.kept.salt").alias("salt")), -(-top // GROUP)
    while n > 1:
        n = -(-n // GROUP)
        ahead = left.withColumn("child", F.col("g")).withColumn("g", F.pmod(F.xxhash64("g", F.lit(SEED + n)), F.lit(n)))
        inner = ahead.groupBy("source", "g").agg(F.sort_array(F.collect_list(F.struct(F.col("child").alias("key"), "size", "p", F.xxhash64("salt", "g", F.lit(n)).alias("salt")))).alias("items"))
        tree.append(common.written(inner.select("source", "g", _round(F.col("items")).alias("out")), f"mix-{len(tree)}"))
        left = tree[-1].select("source", "g", F.col("out.kept.size").alias("size"), F.col("out.kept.p").alias("p"), F.col("out.kept.salt").alias("salt"))
    root = F.round("out.kept.p")
    bits = tree[-1].select("source", "g", root.cast("int").alias("bit"), ((root - F.col("out.kept.p")) * F.col("out.kept.size")).alias("over"))
    for inner in reversed(tree):
        both = inner.join(bits.withColumnRenamed("source", "s2").withColumnRenamed("g", "g2"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("g") == F.col("g2")))
        settled = F.transform("out.done", lambda x: F.struct(x["key"].alias("key"), x["bit"].alias("bit"), F.lit(0.0).alias("over")))
        own = F.concat(settled, F.array(F.struct(F.col("out.kept.key").alias("key"), "bit", "over")))
        if inner is not tree[0]:
            bits = both.select("source", F.explode(own).alias("x")).select("source", F.col("x.key").alias("g"), F.col("x.bit").alias("bit"), F.col("x.over").alias("over"))
    own = F.explode(F.when(F.col("over") == 0, own).otherwise(_repaired(own, F.col("docs"), F.col("over"))))
    doc = F.element_at("docs", (F.col("x.key") + 1).cast("int"))
    chosen = both.select("source", "docs", own.alias("x")).select("source", doc.alias("d"), "x.bit")
    chosen = chosen.select("d.doc_id", "d.hash", "source", "d.size", "d.source_size", "d.target", (F.col("d.whole") + F.col("bit")).cast("long").alias("copies"))
    plain = rows.where(~moved).select(*keep).withColumnRenamed("whole", "copies").withColumn("copies", F.col("copies").cast("long"))
    return chosen.unionByName(plain)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs with every row as often as the mix takes it.

    Rows of one id, text and source share their copies out: each distinct one
    with its repetitions takes its part, the first in order one more.
    """
    own = docs.columns
    key = ["doc_id", "hash", "source"]
    copies = common.written(mix(docs, **how).groupBy(*key).agg(F.sum("copies").alias("pm_copies__"), F.count("*").alias("pm_rows__")), "mix-copies")
    taken = copies.where("pm_copies__ > 0")
    rows = common.decided(docs, taken.where("pm_rows__ = 1"), "inner", ("pm_copies__",), ("source",))
    if not taken.where("pm_rows__ > 1").isEmpty():
        again = common.decided(docs, taken.where("pm_rows__ > 1"), "inner", ("pm_copies__", "pm_rows__"), ("source",))
        kinds = common.written(again.groupBy(*again.columns).agg(F.count("*").alias("pm_n__")), "mix-again")  # repeated rows are counted before they are shuffled
        before = F.sum("pm_n__").over(Window.partitionBy("doc_id", F.xxhash64("text"), "source").orderBy(*own)) - F.col("pm_n__")
        whole = F.floor(F.col("pm_copies__") / F.col("pm_rows__"))
        more = F.greatest(F.lit(0), F.least(F.col("pm_n__"), F.col("pm_copies__") - whole * F.col("pm_rows__") - F.col("pm_before__")))
        kinds = kinds.withColumn("pm_before__", before).withColumn("pm_copies__", whole * F.col("pm_n__") + more).where("pm_copies__ > 0")
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("pm_copies__") - 1) / OPENED)))
        parts = kinds.withColumn("pm_part__", part).withColumn("pm_copies__", F.least(F.lit(OPENED), F.col("pm_copies__") - F.col("pm_part__") * OPENED))
        parts = parts.repartition(common.partitions(docs.sparkSession), F.xxhash64("doc_id", "pm_part__"))  # a row that is taken very often is opened by several tasks
        rows = rows.unionByName(parts.select(*own, "pm_copies__"))
    return rows.withColumn("pm_copy__", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pm_copies__")))).select(*own)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(common.documents(spark, sf_dir))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
