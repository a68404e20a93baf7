"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share
all words by weight; none exceeds ``CAP`` times its own words, and what is cut off is
shared again by weight. The closed form sorts sources by cap / weight: the uncapped
ones share (all words - caps of the capped) at one rate.

A source's documents all want r = target / words copies: floor(r) each, and the
fraction is rounded so that the source's words stay put. Two documents meet; one
passes words of expectation to the other until one of them holds none or all of its
size and is decided. The direction is random with odds that keep every document's
expected copies. One document of each meeting stays open and meets the next. Groups
of about ``FAN`` documents fold so, side by side; their open documents meet in groups
of FAN groups, and so on up a tree, until one open document is left a source and is
decided by its own odds. So a source misses its target by less than one document.

Randomness is a hash of the two documents' identities, hence reruns agree for any
partitioning. Rows equal in all columns are counted first and then numbered, which
keeps a hot identity from gathering in a task.

Edge cases: null and wordless texts have size 0 and take nothing; a table without
words has targets of 0; a null source is a source of its own; repeated rows are
separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.llm.runtime import written

WEIGHTS = (5, 2, 1)
CAP, FAN, SEED = 3, 128, 17
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and ident, a hash of the whole row; ``again`` numbers equal rows from 1."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), F.xxhash64(*docs.columns).alias("ident"))
    counted = rows.groupBy("doc_id", "source", "size", "ident").count()
    return counted.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "count"))).drop("count")


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row a source: n, source_size, target, and rate, the copies that each document wants."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(cap))).withColumn("bend", F.col("cap") / F.col("weight"))
    upward = W.orderBy("bend", F.col("source").asc_nulls_last())
    before = upward.rowsBetween(W.unboundedPreceding, -1)
    onward = upward.rowsBetween(W.currentRow, W.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", left / F.sum("weight").over(onward))
    # the first source that isn't filled to its cap at its level sets the level of all
    s = s.withColumn("level", F.coalesce(F.min(F.when(F.col("level") <= F.col("bend"), F.struct("bend", "level"))).over(every)["level"], F.lit(0.0)))
    s = s.withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return s.select("source", "source_size", "n", "target", F.least(rate, F.lit(float(cap))).alias("rate"))


def let(value: Column, then) -> Column:
    """then(value), with value computed once a row."""
    return F.transform(F.array(value), then)[0]


def meet(acc: Column, x: Column) -> Column:
    """The open document of acc meets document x; one of them is decided."""
    a = F.least(acc.size - acc.mass, x.mass)
    b = F.least(x.size - x.mass, acc.mass)
    u = F.pmod(F.xxhash64(acc.k, x.k, F.lit(SEED)), F.lit(1 << 52)) / F.lit(float(1 << 52))

    def closed(d: Column, up: Column) -> Column:
        return F.struct(d.k.alias("k"), d.ident.alias("ident"), d.doc_id.alias("doc_id"), d.size.alias("size"), up.cast("long").alias("up"))

    def result(d: Column) -> Column:
        full = F.when(d.gain, acc.size - acc.mass <= x.mass).otherwise(x.size - x.mass > acc.mass)  # acc is the decided one
        mass = F.when(full, F.when(d.gain, x.mass - d.a).otherwise(x.mass + d.b)).otherwise(F.when(d.gain, acc.mass + d.a).otherwise(acc.mass - d.b))
        shut = F.when(full, closed(acc, d.gain)).otherwise(closed(x, ~d.gain))
        return F.struct(
            F.when(full, x.k).otherwise(acc.k).alias("k"),
            F.when(full, x.ident).otherwise(acc.ident).alias("ident"),
            F.when(full, x.doc_id).otherwise(acc.doc_id).alias("doc_id"),
            F.when(full, x.size).otherwise(acc.size).alias("size"),
            mass.alias("mass"),
            F.concat(acc.out, F.array(shut)).alias("out"),
        )

    return let(F.struct(a.alias("a"), b.alias("b"), (u * (a + b) < b).alias("gain")), result)


def fold(items: DataFrame, name: str) -> DataFrame:
    """Each group (source, gid) of open documents folds to one that stays open and the decided ones."""
    doc = F.struct("k", "ident", "doc_id", "size", "mass")
    groups = items.groupBy("source", "gid").agg(F.sort_array(F.collect_list(doc)).alias("docs"))
    none = F.expr("cast(array() as array<struct<k: bigint, ident: bigint, doc_id: bigint, size: double, up: bigint>>)")
    first = F.element_at("docs", 1)
    zero = F.struct(first.k.alias("k"), first.ident.alias("ident"), first.doc_id.alias("doc_id"), first.size.alias("size"), first.mass.alias("mass"), none.alias("out"))
    done = groups.withColumn("r", F.aggregate(F.slice("docs", F.lit(2), F.greatest(F.size("docs") - 1, F.lit(0))), zero, meet))
    return written(done.select("source", "gid", "r"), name)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, fan: int = FAN) -> DataFrame:
    """One row a document: doc_id, source, ident, size, source_size, target and copies."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = written(sized(docs), "sizes")
    targets = written(source_targets(rows, weights, cap), "targets")
    frac = F.col("rate") - F.floor("rate")
    k = F.xxhash64("doc_id", "ident", "again", F.lit(SEED))
    items = rows.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        "source", "doc_id", "ident", k.alias("k"), F.col("size").cast("double").alias("size"), (F.col("size") * frac).alias("mass"),
        F.pmod(k, F.ceil(F.col("n") / fan)).alias("gid"),
    )
    most = (targets.agg(F.max("n")).first()[0] or 0) // fan + 1
    decided = []
    while True:
        level = fold(items, "fold")
        decided.append(level.select("source", F.explode("r.out").alias("d")).select("source", "d.*"))
        if most <= 1:
            break
        items = level.select("source", "r.k", "r.ident", "r.doc_id", "r.size", "r.mass", F.floor(F.col("gid") / fan).alias("gid"))
        most = -(-most // fan)
    u = F.pmod(F.xxhash64(F.col("r.k"), F.lit(SEED + 1)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    last = level.select("source", "r.k", "r.ident", "r.doc_id", "r.size", (u * F.col("r.size") < F.col("r.mass")).cast("long").alias("up"))
    for part in decided:
        last = last.union(part.select("source", "k", "ident", "doc_id", "size", "up"))
    out = last.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    copies = F.when(F.col("size") > 0, (F.floor("rate") + F.col("up"))).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "source", "ident", F.col("size").cast("long").alias("size"), "source_size", "target", F.least(copies, F.lit(int(cap))).alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs."""
    names, least = docs.columns, F.lit(-(1 << 63))
    key = [F.xxhash64(*names).alias("_ident"), F.coalesce(F.col("doc_id").cast("long"), least).alias("_id")]
    wanted = mix(docs).groupBy(F.col("ident").alias("_ident"), F.coalesce("doc_id", least).alias("_id")).agg(F.sum("copies").alias("_copies"))
    taken = written(wanted.where("_copies > 0"), "copies")
    # equal rows share one total, so one of them stands for all
    one = docs.select("*", *key).join(taken, ["_ident", "_id"]).dropDuplicates(["_ident", "_id"])
    return one.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(*names)


def op8(docs: DataFrame) -> DataFrame:
    m = mix(docs.select("doc_id", "text", "source"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
