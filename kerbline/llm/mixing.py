"""Mixing sources to target weights.

Each document gets an exponential key, divided by its quality weight (Efraimidis-Spirakis); within a source, documents
are taken in ascending order of their keys. A source is taken whole as often as its target allows; the rest of the
target is met by the documents whose running sum of sizes stays within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import cut, row_keys, run_starts

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = 17
#: Weight of a document by its ``quality`` label; documents without one count as NO_LABEL.
QUALITY = {1: 1.0, 0: 0.25}
NO_LABEL = 0.5


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in the text; null: 0."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) of a table (source, size).

    Sources get ``weights`` in turn, in code-point order, null last, and share ``share`` of all sizes in proportion. A target
    stops at ``max_epochs`` times its source's size and the excess is dealt again by weight until none is above.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    ranked = run_starts(by_source, [F.col("source").asc_nulls_last()], "one", "rank")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.select("source", "source_size", w.alias("weight"), (max_epochs * F.col("source_size")).alias("most")))
    total, open_weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total, level, capped = share * float(total or 0), 0.0, -1
    fixed = 0.0
    while open_weight:
        level = (total - fixed) / open_weight
        over = F.col("most") < level * F.col("weight")
        n, fixed_, open_weight = ranked.agg(
            F.count_if(over), F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if n == capped:
            break
        capped, fixed = n, float(fixed_ or 0)
    return ranked.select("source", "source_size", F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def _planned(
    docs: DataFrame,
    labels: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = 1.0,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """plan_mix with k1 and k2, two hashes of each row."""
    k1, k2 = row_keys(docs.columns)
    base = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), k1.alias("k1"), k2.alias("k2")
    )
    weight = F.lit(NO_LABEL)
    if labels is not None:
        best = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        base = base.join(best, "doc_id", "left")
        known = F.create_map(*[F.lit(x) for pair in QUALITY.items() for x in pair])
        weight = F.coalesce(known[F.col("quality")], F.lit(NO_LABEL))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + F.lit(0.5)) / F.lit(float(2**53))
    keyed = cut(base.withColumn("key", -F.log(uniform) / weight).select("doc_id", "source", "size", "key", "k1", "k2"))

    targets = cut(source_targets(keyed.select("source", "size"), weights, share, max_epochs))
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("size"), F.col("k1"), F.col("k2")]
    running = cut(run_starts(keyed, order, "size", "before_all"))
    starts = running.groupBy(F.col("source").alias("of")).agg(F.min("before_all").alias("start"))
    per_source = cut(
        targets.join(starts, F.col("source").eqNullSafe(F.col("of"))).select(
            "of",
            "source_size",
            "target",
            "start",
            F.least(F.lit(max_epochs), F.floor(F.try_divide("target", "source_size"))).alias("epochs"),
        )
    )
    joined = running.join(per_source, F.col("source").eqNullSafe(F.col("of")))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    within = F.col("before_all") - F.col("start") + F.col("size") / 2 <= rest
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("epochs") + F.when((F.col("epochs") < max_epochs) & within, 1).otherwise(0))
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), "k1", "k2"
    ).withColumn("taken", F.col("copies") * F.col("size"))


def plan_mix(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken (= copies x size).

    ``labels`` (doc_id, quality) sets quality weights; of several labels for an id the best counts. Complete epochs
    come first; of the rest of a target, documents are taken whole, in the order of their keys, while the middle of the document still lies
    within it, so a source misses its target by half a document at most. A null text has size 0 and takes nothing; a null source
    is a source of its own; null ids share one key. Ties of keys go by id, size and a hash of the row. Repeated rows count each, and an
    empty table has an empty plan. Other columns count in that hash alone.
    """
    return _planned(docs, labels, id_col, **options).drop("k1", "k2")


#: Copies of one row that a task writes at a time.
COPIES = 10_000


def mix(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", **options) -> DataFrame:
    """The mixed corpus: each row as often as the plan takes it, with all columns of the input, whatever their names.

    Rows are known by all their columns, so that rows that share an id, or have none, are taken as the plan has it for each of them. Of
    rows that are equal in all columns the plan may take some once more than others; which of them can't be told. Rows of size 0, as
    those with a null or empty text, are never taken; an empty table gives an empty one.
    """
    plan = _planned(docs, labels, id_col, **options)
    least = F.min("copies")
    chosen = cut(plan.groupBy(F.col("k1").alias("c1"), F.col("k2").alias("c2")).agg(least.alias("copies"), (F.sum("copies") - least * F.count("*")).alias("more")).where("copies + more > 0"))
    k1, k2 = row_keys(docs.columns)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), k1.alias("k1"), k2.alias("k2"))
    of = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))
    taken = rows.join(chosen.where("copies > 0"), of).select("row", F.explode(F.sequence(F.lit(1), "copies")))
    more = chosen.where("more > 0").select("c1", "c2", "more")
    if not more.isEmpty():  # equal rows at the end of a source's rest: one of them stands for all
        one = rows.join(more, of).groupBy("k1", "k2").agg(F.first("row").alias("row"), F.first("more").alias("more"))
        blocks = one.select("row", "more", F.explode(F.sequence(F.lit(0), F.expr("(more - 1) div {0}".format(COPIES)))).alias("b"))
        dealt = blocks.repartition("b")
        taken = taken.unionByName(dealt.select("row", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("more") - F.col("b") * COPIES).cast("int"))).alias("col")))
    return taken.select("row.*")
