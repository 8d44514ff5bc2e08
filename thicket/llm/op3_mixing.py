"""Mixing sources to target weights.

Each document gets a hash-random key. Keys and sizes alone, without texts, are range-sorted by source and key; partition
sums give prefix sums of sizes, and each source is cut where its budget ends. The cut is a few keys a source, so it goes back
to the documents as a small table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import cycle

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.llm.common import WORD, spare, stored, table, without

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3.0
MOST_BROADCAST = 100_000
#: source names go to the driver, where weights are given by name; more than this are an error
MOST_SOURCES = 1_000_000
RESULTS = ("_size", "_source_size", "_target", "_taken")


def n_words(text: str) -> Column:
    """Runs of characters other than space and \\x09-\\x0D; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], budget: float, most: float = MOST_EPOCHS) -> list[float]:
    """Shares of the budget by weight; none is above `most` times its size, and what that leaves over is shared again by weight."""
    got = [0.0] * len(sizes)
    open_ = {i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0}
    left = min(float(budget), most * sum(sizes[i] for i in open_))
    while open_:
        total = sum(weights[i] for i in sorted(open_))
        full = {i for i in open_ if left * weights[i] / total >= most * sizes[i]}
        if not full:
            for i in open_:
                got[i] = left * weights[i] / total
            break
        for i in full:
            got[i] = most * sizes[i]
        left -= sum(got[i] for i in sorted(full))
        open_ -= full
    return got


def by_turns(names: Sequence[str | None], weights: Sequence[float] = WEIGHTS) -> dict[str | None, float]:
    """Weights in turn to the sources by code point, null last."""
    ordered = sorted((n for n in names if n is not None), key=lambda n: [ord(c) for c in n])
    return dict(zip([*ordered, *([None] if None in names else [])], cycle(weights), strict=False))


def advance(ranged: DataFrame, state: list[tuple], small: Callable[[DataFrame], DataFrame], sums: DataFrame | None = None) -> dict[str | None, tuple[int | None, int]]:
    """By source, (the first key that does not fit, or null where all fit; the sizes before it).

    state: (source, key after which it begins, greatest size that takes part, what is left), nulls for no limit; sources without
    such rows have no result. Partition sums tell in which partition a source's rest ends, and only its rows are summed one by one.
    """
    at = small(ranged.sparkSession.createDataFrame(state, "_cs string, _from long, _bound long, _left double"))
    rows = ranged.join(at, F.col("_s").eqNullSafe(F.col("_cs"))).where("(_from IS NULL OR _key > _from) AND (_bound IS NULL OR _size <= _bound)")
    sums = rows.groupBy("_s", "_p").agg(F.sum("_size").alias("n")) if sums is None else sums
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("_s").orderBy("_p")) - F.col("n"))
    before = stored(before.join(at.select("_cs", "_left"), F.col("_s").eqNullSafe(F.col("_cs"))).select("_cs", "_left", "_p", "before", "n"))
    out = {r["_cs"]: (None, r["n"]) for r in before.groupBy("_cs").agg(F.sum("n").alias("n")).collect()}
    ends = before.where("before <= _left AND _left < before + n").select(F.col("_cs").alias("_as"), F.col("_p").alias("_ap"), "before")
    step = rows.join(small(ends), F.col("_s").eqNullSafe(F.col("_as")) & (F.col("_p") == F.col("_ap"))).groupBy("_s", "before", "_left", "_key").agg(F.sum("_size").alias("n"))
    step = step.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("_s").orderBy("_key")))
    fits = F.col("upto") <= F.col("_left")
    for r in step.groupBy("_s", "before").agg(F.min(F.when(~fits, F.col("_key"))).alias("stop"), F.max(F.when(fits, F.col("upto"))).alias("used")).collect():
        out[r["_s"]] = (r["stop"], r["used"] if r["used"] is not None else r["before"])
    return out


def mix(docs: DataFrame, size: Column, source: str = "source", key: Sequence[str] = ("doc_id",), weights: Callable[[Sequence[str | None]], dict] = by_turns, share: float = 1.0, most: float = MOST_EPOCHS, seed: int = 17, near: float = 0.001, passes: int = 12, names: Sequence[str] = RESULTS) -> DataFrame:
    """docs with _size, _source_size, _target and _taken: the words that the mix takes from the document, a whole number of times its size.

    weights: from the sources' names, null included, to their weights. The budget is `share` of all sizes. A source with
    target T and size S is read floor(T / S) times whole, and of the next time it gives the documents of the smallest keys
    as long as they fit. Where more than `near` of the target is left, the key that does not fit is skipped, and further keys
    whose documents are no longer than what is left are taken in the same way, in at most `passes` passes; in the end one key
    more, of all that are left, fills best what still is. So a source misses its target by more than `near` only if no
    document left over would fit, or the passes did not suffice. The hash of `key` and the seed is the key, and rows that agree in `key` and size are cut
    together: `key` should name documents. Sizes of 0 take nothing. The source names go to the driver, one row each, as the weights are given there, and
    more than MOST_SOURCES of them are an error. Results are the same for every partitioning. `names` are those of the four
    results, and replace columns of those names; no rows: no rows.
    """
    spark = docs.sparkSession
    own = without(docs.columns, names)
    # the tables in between have names of their own; the documents' columns join them only at the end, under spare names
    size_, key_, source_ = spare([*docs.columns, *names, "_ps", "_source_size", "_target", "_epochs", "_rest", "_spans", "_extra"], "_size", "_key", "_s")
    whole_docs = docs.select("*", size.alias(size_), F.xxhash64(F.lit(seed), *[F.col(f"`{k}`") for k in key]).alias(key_), F.col(f"`{source}`").alias(source_))
    # written, so that the range sort's sample and the sort itself do not split the texts again
    sized = stored(whole_docs.select(F.col(source_).alias("_s"), F.col(key_).alias("_key"), F.col(size_).alias("_size")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = sized.where("_size > 0").repartitionByRange(parts, "_s", "_key")
    ranged = stored(ranged.withColumn("_p", F.spark_partition_id()))
    part_sums = stored(ranged.groupBy("_s", "_p").agg(F.sum("_size").alias("n")))

    rows = part_sums.groupBy("_s").agg(F.sum("n").alias("n")).collect()
    all_names = [r[0] for r in sized.select("_s").distinct().limit(MOST_SOURCES + 1).collect()]
    if len(all_names) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: mix groups of them")
    total = {r["_s"]: r["n"] for r in rows}
    weight = weights(all_names)
    goal = dict(zip(all_names, targets([total.get(s, 0) for s in all_names], [weight[s] for s in all_names], share * sum(total.values()), most), strict=True))
    plan = [(s, total.get(s, 0), goal[s], min(int(goal[s] // total[s]), int(most)) if total.get(s) else 0) for s in all_names]
    plan = [(*p, float(p[2] - p[3] * p[1])) for p in plan]
    plan_df = spark.createDataFrame(plan, "_s string, _source_size long, _target double, _epochs int, _rest double") if plan else spark.createDataFrame([], "_s string, _source_size long, _target double, _epochs int, _rest double")

    # these tables have a row a source: broadcast up to a number of sources that is known here, joined like any other beyond it
    small = F.broadcast if len(all_names) <= MOST_BROADCAST else lambda df: df
    taken: dict[str | None, list[tuple[int | None, int | None, int | None]]] = {}
    end: dict[str | None, tuple[float, int | None, list[int]]] = {}
    state = [(s, None, None, rest) for s, n, _, _, rest in plan if n and rest > 0]
    for turn in range(passes):
        if not state:
            break
        found = advance(ranged, state, small, part_sums if turn == 0 else None)
        after = []
        for s, low, bound, left in state:
            if s not in found:
                continue
            stop, used = found[s]
            taken.setdefault(s, []).append((low, stop, bound))
            left -= used
            end[s] = (left, stop, [*end.get(s, (0, None, []))[2], *([stop] if stop is not None else [])])
            if stop is not None and left > near * goal[s]:
                after.append((s, stop, int(left), left))
        state = after
    # and one key more of all that are not taken, whose size fills best what is left
    open_ = spark.createDataFrame([(s, *e) for s, e in end.items() if e[0] > 0], "_cs string, _left double, _last long, _skipped array<long>")
    later = ranged.join(small(open_), ranged["_s"].eqNullSafe(open_["_cs"])).where("_key >= _last OR array_contains(_skipped, _key)")
    later = later.groupBy("_s", "_left", "_key").agg(F.sum("_size").alias("n")).withColumn("miss", F.abs(F.col("n") - F.col("_left"))).where("miss < _left")
    fill = {r["_s"]: r["_extra"] for r in later.groupBy("_s").agg(F.min(F.struct("miss", "_key"))["_key"].alias("_extra")).collect()}
    cuts = spark.createDataFrame([(s, spans, fill.get(s)) for s, spans in taken.items()], "_cs string, _spans array<struct<low:long,stop:long,bound:long>>, _extra long")
    whole = plan_df.join(cuts, plan_df["_s"].eqNullSafe(cuts["_cs"]), "left").drop("_cs").withColumnRenamed("_s", "_ps")
    # in the join these names are not the documents'
    inner = spare([*docs.columns, size_, key_, source_, *names], "_ps", "_source_size", "_target", "_epochs", "_rest", "_spans", "_extra")
    whole = whole.select("_ps", "_source_size", "_target", "_epochs", "_rest", "_spans", "_extra").toDF(*inner)
    ps_, total_, target_, epochs_, _, spans_, extra_ = inner
    at, n = F.col(key_), F.col(size_)
    within = F.exists(spans_, lambda x: (x["low"].isNull() | (at > x["low"])) & (x["stop"].isNull() | (at < x["stop"])) & (x["bound"].isNull() | (n <= x["bound"])))
    more = F.coalesce(within, F.lit(False)) | F.coalesce(at == F.col(extra_), F.lit(False))
    out = whole_docs.join(small(whole), whole_docs[source_].eqNullSafe(whole[ps_]), "left")
    made = (F.col(size_), F.col(total_), F.col(target_), n * (F.col(epochs_) + more.cast("int")))
    return out.select(*[F.col(f"`{c}`") for c in own], *(c.alias(n) for c, n in zip(made, names, strict=True)))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document; see mix for odd rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mix(docs, n_words("text"))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def repeated(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """docs as the mix has them: each row as often as it is taken. Rows that agree in all columns are cut together; columns stay as they are."""
    *names, times_ = spare(docs.columns, *RESULTS, "_times")
    size, _, _, taken = names
    out = mix(docs, n_words(text), source, docs.columns, names=names)
    times = F.when(F.col(size) > 0, (F.col(taken) / F.col(size)).cast("int")).otherwise(0)
    # a document without words weighs nothing: it stays once, whatever the weights
    times = F.when(F.col(size) == 0, 1).otherwise(times)
    return out.withColumn(times_, F.explode(F.array_repeat(F.lit(1), times))).select(docs.columns)
