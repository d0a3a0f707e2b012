"""Audits of synthetic text: duplicates, near duplicates, label histograms and shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderloom.functions.scalars import audit_text, audit_tokens, hashed_shingles, lenient_double
from cinderloom.sources.staging import staged


def is_synthetic(source_split: Column, origin_cycle: Column) -> Column:
    """By the split's name; any other name is not, and without a name a cycle above 0 is."""
    name = F.lower(F.trim(F.coalesce(source_split, F.lit(""))))
    return F.when(name.isin("augmented", "synthetic", "online_augmented"), True).when(name != "", False).otherwise(F.coalesce(lenient_double(origin_cycle.cast("string")) > 0, F.lit(False)))


def exact_duplicates(rows: DataFrame, text: str, order: str) -> DataFrame:
    """rows with seen_before: whether the normalised text stands in an earlier row (empty texts never do).

    ``order`` tells rows apart. The earliest row of each text is a partial aggregate over the
    text's digest, joined back: no task gathers the copies of a common text.
    """
    marked = rows.withColumn("norm", audit_text(F.col(text))).withColumn("_d", F.sha2("norm", 256))
    first = marked.where("norm <> ''").groupBy("_d").agg(F.min(order).alias("_first"))
    return marked.join(first, "_d", "left").withColumn("seen_before", F.coalesce(F.col(order) > F.col("_first"), F.lit(False))).drop("_d", "_first")


def exact_duplicate_rate(rows: DataFrame, text: str) -> DataFrame:
    """Second and later occurrences over all rows. Sums per text combine before the shuffle."""
    per_text = rows.select(audit_text(F.col(text)).alias("norm")).groupBy("norm").agg(F.count("*").alias("n"))
    return per_text.agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("norm") != "", F.col("n") - 1)), F.lit(0)).alias("n_duplicates")).withColumn("rate", F.try_divide("n_duplicates", "n_rows"))


def seed_duplicates(synthetic: DataFrame, seeds: DataFrame, text: str) -> DataFrame:
    """Synthetic rows whose normalised text is a seed's."""
    known = seeds.select(audit_text(F.col(text)).alias("norm")).where("norm <> ''").distinct()
    return synthetic.withColumn("norm", audit_text(F.col(text))).join(known, "norm", "left_semi")


#: A shingle of more classes than this is common: it comes last in the order of shingles, and its classes meet in steps.
COMMON = 32
#: Words of 64 bits of the filter of rows whose sets travel: a fixed size.
FILTER = 1 << 17


def _prefix_length(threshold: float) -> Column:
    """Of this many first shingles in any one order, two similar sets share one."""
    return (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).cast("int")


def _sets(synthetic: DataFrame, seeds: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with their hashed shingle sets in order, in one scan of either side: rid (names the row), id, own (whether synthetic), s, n, and two hashes of the whole set."""
    hashed = lambda df, own: df.select(F.col(key).alias("id"), F.lit(own).alias("own"), hashed_shingles(audit_tokens(F.col(text))).alias("s"))
    rows = hashed(synthetic, True).unionAll(hashed(seeds, False)).withColumn("rid", F.monotonically_increasing_id())
    return staged(rows.select("rid", "id", "own", "s", F.size("s").alias("n"), F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(1), F.reverse("s")).alias("h2")))


def _classes(rows: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Classes of equal sets: cid (the rid of a row), h1, h2, n, first (earliest synthetic row), seed (whether a seed is among them), pre (the least shingles).

    The copies of a text meet as one row a task, and no set travels whole.
    """
    same = rows.where("n > 0").select("*", F.slice("s", 1, _prefix_length(threshold)).alias("pre")).groupBy("h1", "h2", "n")
    return staged(same.agg(F.min("rid").alias("cid"), F.min(F.when(F.col("own"), F.col("id"))).alias("first"), F.bool_or(~F.col("own")).alias("seed"), F.any_value("pre").alias("pre")))


def _picked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid and s of the wanted classes (cid, distinct) and of some other rows: a fixed-size bit table keeps most of those back, and lets more through if it fills."""
    bit = F.pmod(F.xxhash64("cid"), F.lit(64 * FILTER))
    table = wanted.select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    some = rows.select(F.col("rid").alias("cid"), "s").withColumn("bit", bit).withColumn("word", F.shiftright("bit", 6))
    # FILTER rows of two numbers at most.
    return some.join(F.broadcast(table), "word").where(F.getbit("mask", F.col("bit").bitwiseAND(F.lit(63))) == 1).select("cid", "s")


def _often(grams: DataFrame) -> DataFrame:
    return grams.groupBy("g").agg(F.count("*").alias("df")).where(F.col("df") > COMMON).select("g")


def _prefixes(rows: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(g, at, common) of the shingles of each class of which two similar classes share one: the first n - ceil(t n) + 1, by hash, common ones last.

    Only shingles that stand in a prefix matter, so only those are counted. A class that has a
    common one among them gets others in its place, and those may be common too: of such
    classes the whole sets are counted. Any one order of shingles serves, so this is exact.
    """
    least = classes.select("cid", F.explode("pre").alias("g"))
    common = staged(_often(least))
    slim = classes.select("cid", "n", "first", "seed", "pre")
    plain = slim.select("cid", "n", "first", "seed", F.posexplode("pre").alias("at", "g")).withColumn("common", F.lit(False))
    if common.isEmpty():
        return staged(plain)
    mixed = least.join(common, "g", "left_semi").select("cid").distinct()
    common = staged(common.unionAll(_often(_picked(rows, mixed).select(F.explode("s").alias("g")))).distinct())
    mixed = staged(least.join(common, "g", "left_semi").select("cid").distinct())
    sets = _picked(rows, mixed)
    own = sets.join(mixed, "cid", "left_semi").select("cid", F.explode("s").alias("g")).join(common, "g", "left_semi").groupBy("cid").agg(F.array_sort(F.collect_list("g")).alias("often"))
    rare = F.array_except("s", "often")
    moved = slim.drop("pre").join(sets.join(own, "cid"), "cid").select("cid", "n", "first", "seed", rare.alias("rare"), "often", _prefix_length(threshold).alias("p"))
    moved = moved.select("cid", "n", "first", "seed", F.size("rare").alias("r"), F.posexplode(F.slice(F.concat("rare", "often"), 1, F.col("p"))).alias("at", "g"))
    moved = moved.select("cid", "n", "first", "seed", "at", "g", (F.col("at") >= F.col("r")).alias("common"))
    return staged(plain.join(mixed, "cid", "left_anti").unionByName(moved))


def _similar(rows: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """x, y, shared and united (sizes of intersection and union) of the pairs of classes that are similar. Only sets of classes in pairs travel."""
    pairs = staged(pairs.select("x", "y").distinct())
    sx = _picked(rows, pairs.select(F.col("x").alias("cid")).distinct()).select(F.col("cid").alias("x"), F.col("s").alias("sx"))
    sy = _picked(rows, pairs.select(F.col("y").alias("cid")).distinct()).select(F.col("cid").alias("y"), F.col("s").alias("sy"))
    both = pairs.join(sx, "x").join(sy, "y").select("x", "y", F.size(F.array_intersect("sx", "sy")).alias("shared"), (F.size("sx") + F.size("sy")).alias("sum"))
    return both.select("x", "y", "shared", (F.col("sum") - F.col("shared")).alias("united")).where(F.col("shared") >= threshold * F.col("united") - 1e-12)


def _sides(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries as those that look for others (classes with a synthetic row) and as those that are found."""
    x = entries.where("first is not null").select(F.col("cid").alias("x"), F.col("n").alias("nx"), F.col("first").alias("fx"), F.col("seed").alias("sx"), "g", F.col("at").alias("ax"), "common")
    return x, entries.select(F.col("cid").alias("y"), F.col("n").alias("ny"), F.col("first").alias("fy"), "seed", "g", F.col("at").alias("ay"), "common")


def _close(threshold: float) -> Column:
    """Whether sizes and places of a shared shingle leave room for the threshold."""
    sizes = F.least("nx", "ny") >= threshold * F.greatest("nx", "ny") - 1e-9
    # Of the first shingle that both prefixes share: what stands behind it bounds what the sets share.
    reach = 1 + F.least(F.col("nx") - F.col("ax") - 1, F.col("ny") - F.col("ay") - 1) >= threshold / (1 + threshold) * (F.col("nx") + F.col("ny")) - 1e-9
    return sizes & reach


def _met(entries: DataFrame, earlier: Column, threshold: float) -> DataFrame:
    """Pairs x, y of classes that share a shingle which is not common, from one shuffle of entries: such groups have ``COMMON`` classes at most, or few more."""
    rare = entries.where("not common").drop("common")
    # Dealt before they are gathered: rows are narrower than lists of one.
    sizes = rare.repartition("g").groupBy("g").agg(F.collect_list(F.struct("cid", "n", "first", "seed", "at")).alias("m")).where(F.size("m") > 1)
    one = sizes.select("m", F.explode("m").alias("a")).where("a.first is not null")
    both = one.select("a", F.explode("m").alias("b"))
    names = both.select(F.col("a.cid").alias("x"), F.col("a.n").alias("nx"), F.col("a.first").alias("fx"), F.col("a.seed").alias("sx"), F.col("a.at").alias("ax"), F.col("b.cid").alias("y"), F.col("b.n").alias("ny"), F.col("b.first").alias("fy"), F.col("b.seed").alias("seed"), F.col("b.at").alias("ay"))
    return names.where(earlier & _close(threshold)).select("x", "y")


def near_duplicate_pairs(synthetic: DataFrame, seeds: DataFrame, key: str, text: str, threshold: float = 0.85) -> DataFrame:
    """Pairs (a, b) of similarity from the threshold on: a synthetic, b a seed or a synthetic row before it (by ``key``, unique).

    Classes of equal sets meet as in ``near_duplicates``, and all that are similar count. Copies
    become pairs of rows only in the result.
    """
    every = _sets(synthetic, seeds, key, text)
    classes = _classes(every, threshold)
    entries = _prefixes(every, classes, threshold)
    # Either class of two can hold the later row; a pair of classes is compared once.
    once = F.col("x") < F.col("y")
    pairs = _met(entries.withColumn("first", F.coalesce("first", F.lit(0))), once, threshold)
    often = entries.where("common")
    if not often.isEmpty():
        x, y = _sides(often.withColumn("first", F.coalesce("first", F.lit(0))))
        pairs = pairs.unionAll(x.join(y.drop("common"), "g").where(once & _close(threshold)).select("x", "y"))
    found = _similar(every, pairs, threshold).select("x", "y", (F.col("shared") / F.col("united")).alias("similarity")).where(F.col("similarity") >= threshold)
    alike = staged(found.unionAll(found.select("y", "x", "similarity")).unionAll(classes.select("cid", "cid", F.lit(1.0))))
    rows = staged(every.select("id", "own", "h1", "h2", "n").join(classes.select("cid", "h1", "h2", "n"), ["h1", "h2", "n"]).select("cid", "id", "own"))
    a, b = rows.where("own").select(F.col("cid").alias("x"), F.col("id").alias("a")), rows.select(F.col("cid").alias("y"), F.col("id").alias("b"), F.col("own").alias("late"))
    return alike.join(a, "x").join(b, "y").where(~F.col("late") | (F.col("b") < F.col("a"))).select("a", "b", "similarity")


def near_duplicates(synthetic: DataFrame, seeds: DataFrame, key: str, text: str, threshold: float = 0.85) -> DataFrame:
    """id and near of each synthetic row: whether a seed or an earlier synthetic row (by ``key``, unique) is so similar. Exact copies are; a row without words is not.

    Equal shingle sets are one class, so copies never meet as pairs: all of a class but its
    first row are settled by that one, and all of a class with a seed by the seed. Only first rows
    look for a witness, among classes that share a shingle of a short prefix, and one hit is
    enough. Prefixes hold few common shingles, as those come last; for those that do, the earliest
    class is tried before any others, and only rows still open meet the rest.
    """
    every = _sets(synthetic, seeds, key, text)
    classes = _classes(every, threshold)
    entries = _prefixes(every, classes, threshold)
    earlier = ~F.col("sx") & (F.col("x") != F.col("y")) & (F.col("seed") | (F.col("fy") < F.col("fx")))
    could = earlier & _close(threshold)
    witnessed = lambda pairs: _similar(every, pairs, threshold).select("x").distinct()
    found = staged(witnessed(_met(entries, earlier, threshold)))
    x, y = _sides(entries.where("common"))
    often, kept = x.where("not sx").drop("common"), y.drop("common")
    if not often.isEmpty():
        rank = F.struct((~F.col("seed")).alias("late"), F.coalesce("fy", F.col("y")).alias("f"), "y")
        lead = kept.groupBy("g").agg(F.min_by(F.struct("y", "ny", "fy", "seed", "ay"), rank).alias("l")).select("g", "l.*")
        open_ = often.join(found, "x", "left_anti")
        found = staged(found.unionAll(witnessed(open_.join(lead, "g").where(could))))
        found = staged(found.unionAll(witnessed(often.join(found, "x", "left_anti").join(kept, "g").where(could))))
    near = classes.join(found.withColumnRenamed("x", "cid").withColumn("hit", F.lit(True)), "cid", "left").select("h1", "h2", "n", "first", "seed", F.coalesce("hit", F.lit(False)).alias("hit"))
    rows = every.where("own").select("id", "h1", "h2", "n")
    told = rows.join(near, ["h1", "h2", "n"], "left")
    return told.select("id", F.coalesce(F.col("seed") | (F.col("id") > F.col("first")) | F.col("hit"), F.lit(False)).alias("near"))


def near_duplicate_rate(synthetic: DataFrame, seeds: DataFrame, key: str, text: str, threshold: float = 0.85) -> DataFrame:
    """Share of synthetic rows near a seed or an earlier synthetic row; exact copies count as near."""
    told = near_duplicates(synthetic, seeds, key, text, threshold)
    return told.agg(F.count_if("near").alias("n_near"), F.count("*").alias("n_rows")).withColumn("rate", F.try_divide("n_near", "n_rows"))


def label_histogram(rows: DataFrame, label: str, synthetic: str, cycle: str) -> DataFrame:
    """Counts and shares by origin (seed, synthetic, all) over all cycles, and of synthetic rows by cycle; blank labels are left out."""
    named = rows.where(F.trim(F.coalesce(F.col(label).cast("string"), F.lit(""))) != "").select(F.trim(F.col(label).cast("string")).alias("label"), F.col(synthetic).alias("s"), F.col(cycle).alias("c"))
    origins = F.array(F.struct(F.when(F.col("s"), "synthetic").otherwise("seed").alias("origin"), F.lit("all").alias("cycle")), F.struct(F.lit("all").alias("origin"), F.lit("all").alias("cycle")), F.when(F.col("s"), F.struct(F.lit("synthetic").alias("origin"), F.col("c").cast("string").alias("cycle"))))
    counts = named.groupBy("label", "s", "c").agg(F.count("*").alias("n")).select("label", "n", F.explode(F.array_compact(origins)).alias("o")).groupBy("o.origin", "o.cycle", "label").agg(F.sum("n").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("origin", "cycle")))


def distribution_shift(left: DataFrame, right: DataFrame, label: str = "label") -> DataFrame:
    """Total variation distance, greatest difference of counts, labels missing on the right and extra there. Inputs have label and n."""
    l, r = left.select(label, F.col("n").alias("nl")), right.select(F.col(label).alias("_l"), F.col("n").alias("nr"))
    # One row per label on either side.
    rows = l.join(r, F.col(label).eqNullSafe(F.col("_l")), "full").select(F.coalesce(label, "_l").alias("label"), F.coalesce("nl", F.lit(0)).alias("nl"), F.coalesce("nr", F.lit(0)).alias("nr"))
    totals = rows.agg(F.sum("nl").alias("tl"), F.sum("nr").alias("tr"))
    both = rows.crossJoin(F.broadcast(totals))
    gap = F.abs(F.coalesce(F.try_divide("nl", "tl"), F.lit(0.0)) - F.coalesce(F.try_divide("nr", "tr"), F.lit(0.0)))
    names = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("label").cast("string")))), ",")
    return both.agg((F.sum(gap) / 2).alias("tvd"), F.max(F.abs(F.col("nl") - F.col("nr"))).alias("max_count_delta"), names((F.col("nl") > 0) & (F.col("nr") == 0)).alias("missing_labels"), names((F.col("nl") == 0) & (F.col("nr") > 0)).alias("extra_labels"))
