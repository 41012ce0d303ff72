"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of their id and text and queue up; a second pass over the source queues behind the
first. A copy's virtual finish time is the source's words up to and including it, divided by the source's target, so at
any virtual time all sources have given the same share of their targets, and at time 1 all of it. Copies of all sources
are put in order of finish and taken until the budget is used up.

Nothing is sorted in one place. A source is cut into ``BUCKETS`` ranges of its shuffle hash; the ranges' sums give each
range its offset (a table of at most BUCKETS rows a source), and only a range's own documents are sorted together, so a
source with a third of all rows is spread like any other. The global cut is found from sums over ranges of finish time,
which fair queueing fills evenly, in two steps of narrowing; then each copy compares itself with the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.plans.staging import stage

WEIGHTS = (3, 1, 2)
BUCKETS, SLICES = 4_096, 4_096
WORD = r"[^\x20\x09-\x0D]+"
ORDER = ("__hash", "__size")
NEW, OWN = ("size", "source_size", "target", "first_finish", "copies"), (*ORDER, "__bucket", "__key", "__before", "__end", "__copy", "__at")


def own_name(column: str) -> bool:
    """Whether a column has a name that this module gives columns of its own."""
    name = column.lower()
    return name in (*NEW, *OWN) or name.startswith("__f") and name[3:].isdigit()


def word_count(text: str = "text") -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill_targets(sources: DataFrame, weights: tuple[int, ...], share: float, repeat: float) -> DataFrame:
    """Adds target to (source, source_size): weights in order of source, null last, repeating; ``share`` of all words in
    proportion to weight, no source above ``repeat`` times its size, the excess given to the others in proportion.

    A source is full if a level of words per unit of weight, once all sources that fill up earlier are taken out,
    reaches its own cap; in order of cap per weight that is a running sum over the sources, one row each. The level of
    the first source that stays open holds for all after it; levels worked out as if it too were full are lower.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    caps = sources.withColumn("weight", weight).withColumn("cap", F.lit(repeat) * F.col("source_size"))
    everything = Window.partitionBy(F.lit(1))
    in_order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(in_order), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(in_order), F.lit(0.0))
    )
    open_level = F.max(F.when(F.col("weight") * F.col("level") < F.col("cap"), F.col("level"))).over(everything)
    levelled = caps.withColumn("level", level).withColumn("open", open_level)
    return levelled.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("open")), F.col("cap")).alias("target"))


def queue(docs: DataFrame, size: Column, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeat: int = 2, seed: str = "mix", text: Column | None = None) -> DataFrame:
    """All columns of ``docs`` (doc_id, source, text or whatever ``size`` needs), with size, source_size, target, first_finish
    (virtual finish time of the first copy, null where the source has no words) and copies (how often the mix takes it).

    Input columns of these names, and of those in ``OWN``, are replaced. A null source is a source of its own,
    after all others; documents without words are taken with the queue around them and add nothing; in a source without
    any words the copies are 0. The shuffle hash is one of doc_id and text (``text`` is a hash of it where the text itself
    isn't a column), so rows that share an id, or have none, are spread like others; ties go by size, and identical rows
    queue up one after another. The result depends on the rows only, not on their order or partitions. An empty table
    gives no rows.
    """
    columns = [c for c in docs.columns if not own_name(c)]
    own = F.md5(F.coalesce("text", F.lit("")).cast("binary")) if text is None else text
    identity = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), own)
    hashed = (
        docs.withColumns({"__size": size, "__hash": F.md5(identity.cast("binary"))})
        .withColumns({"__bucket": F.conv(F.substring("__hash", 1, 3), 16, 10).cast("int") % BUCKETS, "__key": F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-"))})
        .select(*columns, *ORDER, "__bucket", "__key")
    )
    narrow = stage(hashed.select("__key", "__bucket", *ORDER), "queue")
    sums = narrow.groupBy("__key", "__bucket").agg(F.sum("__size").alias("__sum"))
    sizes = sums.groupBy("__key").agg(F.sum("__sum").alias("source_size"))
    targets = fill_targets(sizes.select(F.when(F.col("__key") != "-", F.expr("substring(__key, 2)")).alias("source"), "source_size"), weights, share, repeat)
    keyed = targets.select(F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-")).alias("__key"), "source_size", "target")
    earlier = Window.partitionBy("__key").orderBy("__bucket")
    offsets = stage(
        sums.withColumn("__before", F.sum("__sum").over(earlier) - F.col("__sum")).drop("__sum").join(keyed, "__key"),
        "offsets",
    )

    def finished(rows: DataFrame) -> DataFrame:
        within = Window.partitionBy("__key", "__bucket").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
        return rows.join(offsets, ["__key", "__bucket"]).withColumn("__end", F.col("__before") + F.sum("__size").over(within))

    def finish(copy: int) -> Column:
        return F.when(F.col("target") > 0, (F.lit(copy) * F.col("source_size") + F.col("__end")).cast("double") / F.col("target"))

    all_copies = F.explode(F.array(*[F.struct(F.lit(i).alias("copy"), finish(i).alias("finish")) for i in range(repeat)])).alias("c")
    line = stage(finished(narrow).select("__key", *ORDER, all_copies).select("__key", *ORDER, "c.copy", "c.finish").where("finish IS NOT NULL"), "line")
    budget = F.lit(share)
    total = sizes.agg((budget * F.coalesce(F.sum("source_size"), F.lit(0))).alias("t")).first()["t"]
    cut = find_cut(line, total)
    wide = finished(hashed).withColumns({f"__f{i}": finish(i) for i in range(repeat)})
    copies = F.lit(0)
    for i in range(repeat):
        copies = copies + F.when(before_cut(F.col(f"__f{i}"), i, cut), 1).otherwise(0)
    return wide.select(*columns, F.col("__size").alias("size"), "source_size", "target", F.col("__f0").alias("first_finish"), copies.cast("int").alias("copies"))


POSITION = ("finish", "__key", "copy", *ORDER)


def find_cut(line: DataFrame, budget: float) -> dict | None:
    """The first copy in global order (POSITION) that no longer fits the budget; None if all fit.

    Sums over slices of finish time show in which slice the budget ends, a second time within it; only what is left
    then is sorted. Copies without words never end the budget, so any number of them may finish together.
    """
    low, width, spent, rest = 0.0, 1.0 / SLICES, 0, line.where("__size > 0")
    for _ in range(2):
        at = F.floor((F.col("finish") - F.lit(low)) / F.lit(width)).cast("long")
        slices = rest.groupBy(at.alias("at")).agg(F.sum("__size").alias("words"))
        running = slices.withColumn("end", F.sum("words").over(Window.orderBy("at")) + F.lit(spent))
        found = running.where(F.col("end") > budget).orderBy("at").first()
        if found is None:
            return None
        spent = found["end"] - found["words"]
        rest = rest.where(at == found["at"])
        low, width = low + found["at"] * width, width / SLICES
    running = rest.withColumn("end", F.sum("__size").over(Window.orderBy(*POSITION).rowsBetween(Window.unboundedPreceding, 0)) + F.lit(spent))
    first = running.where(F.col("end") > budget).orderBy(*POSITION).first()
    return first.asDict() if first else None


def before_cut(finish: Column, copy: int, cut: dict | None) -> Column:
    """Whether this copy of a row comes before the cut in the order of POSITION."""
    if cut is None:
        return finish.isNotNull()
    own = {"finish": finish, "copy": F.lit(copy)}
    out = F.lit(False)
    for name in reversed(POSITION):
        value = own.get(name, F.col(name))
        out = (value < F.lit(cut[name])) | ((value == F.lit(cut[name])) & out)
    return F.coalesce(out, F.lit(False))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeat: int = 2) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each copy taken, range-sorted over the partitions by virtual finish time.

    Columns of ``docs`` that have a name of ``queue``'s own come through unchanged.
    """
    kept = {c: f"__kept_{c}" if own_name(c) else c for c in docs.columns}
    taken = queue(docs.withColumnsRenamed(kept), word_count(), weights, share, repeat).where("copies > 0")
    copy = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("__copy")
    rows = taken.select("*", copy).withColumn("__at", F.col("first_finish") + F.col("__copy") * F.col("source_size") / F.col("target"))
    ordered = rows.repartitionByRange("__at").sortWithinPartitions("__at")
    return ordered.select(*[F.col(new).alias(old) for old, new in kept.items()])


def mix_table(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted) for every document."""
    mark = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    sized = stage(docs.select("doc_id", "source", word_count().alias("words"), mark.alias("mark")), "sizes")
    rows = queue(sized, F.col("words"), text=F.col("mark"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
