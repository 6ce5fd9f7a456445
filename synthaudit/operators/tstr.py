"""Train on synthetic, test on real (M2, M4, G17; labels and features in ``encode``).

* stratified folds (M4): rank inside each label by seeded hash, fold =
  rank mod 5.  Ranks come from per-(label, hash bucket) counts and a
  ranking inside each bucket, so a dominant label never lands in one task;
* TSTR: a random forest (100 fully grown trees, seed 42) fitted on all
  synthetic rows, accuracy on each real fold, averaged (G17).  TRTR: the same
  forest fitted on four real folds, scored on the fifth.  gap = max(0, TRTR−TSTR).
  (Decision D2: the original tool's cross-validation refits on real, so its
  TSTR equals TRTR; here TSTR is what it is documented to be.)

The six forests are one run of ``forest_votes``: a row takes part in every
forest it belongs to.  A feature that the synthetic table lacks is zero there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from synthaudit.functions.keys import hash_rank_key
from synthaudit.operators.encode import category_levels, feature_kinds, label_classes, quoted
from synthaudit.operators.forest import forest_votes, predicted
from synthaudit.session import cut_lineage

N_FOLDS = 5
N_TREES = 100


def stratified_folds(df: DataFrame, key: str, label: str, seed: int = 42, k: int = N_FOLDS) -> DataFrame:
    """M4: ``fold = (rank of row inside its label by hash order) mod k``."""
    h = hash_rank_key(seed, quoted(key))
    d = df.withColumn("__h", h).withColumn("__bk", F.shiftright("__h", 44))
    counts = d.groupBy(label, "__bk").agg(F.count(F.lit(1)).alias("__n"))
    wo = Window.partitionBy(label).orderBy("__bk").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(label, "__bk", F.coalesce(F.sum("__n").over(wo), F.lit(0)).alias("__off"))
    wr = Window.partitionBy(label, "__bk").orderBy("__h", key)
    # offsets: one row per (label, bucket) — at most classes × 65,536 rows
    ranked = d.join(offs, [label, "__bk"])
    ranked = ranked.withColumn("fold", ((F.col("__off") + F.row_number().over(wr) - 1) % k).cast("int"))
    return ranked.drop("__h", "__bk", "__off")


def majority_fold_accuracy(folded: DataFrame, label: str, k: int = N_FOLDS) -> DataFrame:
    """G17 with the majority-class predictor: for each fold, predict the most
    frequent label of the other folds (smallest on ties) and score the fold.
    Works on the (fold, label) counts only."""
    counts = folded.groupBy("fold", label).agg(F.count(F.lit(1)).alias("n"))
    tot = counts.groupBy(label).agg(F.sum("n").alias("t"))
    # every (fold, label): labels absent from a fold still predict for it
    grid = tot.select(label, "t", F.explode(F.array(*[F.lit(i) for i in range(k)])).alias("fold"))
    rest = (grid.join(counts, ["fold", label], "left")
            .select("fold", label, (F.col("t") - F.coalesce(F.col("n"), F.lit(0))).alias("rest")))
    # (fold, label) rows are at most folds × classes: the window below is tiny
    w = Window.partitionBy("fold").orderBy(F.desc("rest"), F.asc(label))
    pred = (rest.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1)
            .select("fold", F.col(label).alias("pred")))
    size = counts.groupBy("fold").agg(F.sum("n").alias("size"))
    hit = counts.join(pred, "fold").where(F.col(label) == F.col("pred")).select("fold", F.col("n").alias("hit"))
    return (size.join(hit, "fold", "left").join(pred, "fold")
            .select("fold", "pred", (F.coalesce("hit", F.lit(0)) / F.col("size")).alias("accuracy")))


def fold_accuracy(pred: DataFrame) -> DataFrame:
    """Accuracy per fold."""
    return pred.groupBy("fold").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


def tstr_frames(real: DataFrame, syn: DataFrame, target: str, key: str, seed: int = 42, trees: int = N_TREES,
                depth: int | None = None):
    """Return (tstr per-fold accuracy, trtr per-fold accuracy) DataFrames.
    ``depth`` limits the trees; None grows them fully."""
    nums, cats = feature_kinds(real, (key, target))
    classes, levels = label_classes(real, target), category_levels(real, cats)
    absent = {c: F.lit(None).cast(real.schema[c].dataType) for c in (*nums, *cats) if c not in syn.columns}

    def rows(df: DataFrame, carry: list[str]) -> DataFrame:
        # numbered names inside: a column of the table may be called anything
        named = df.select(quoted(key).alias("id"), *[quoted(c).alias(f"f{j}") for j, c in enumerate((*nums, *cats))],
                          quoted(target).alias("target"))
        named = classes.encode(named, "target")
        if "fold" in carry:
            named = stratified_folds(named, "id", "label", seed)
        own = [f"f{j}" for j in range(len(nums) + len(cats))]
        levels_here = type(levels)(levels.table, own[len(nums):], levels.sizes)
        return levels_here.encode(named, own[:len(nums)], carry)

    r = cut_lineage(rows(real, ["id", "label", "fold"]))
    s = rows(syn.withColumns(absent) if absent else syn, ["id", "label"])
    folds = F.sequence(F.lit(0).cast("long"), F.lit(N_FOLDS - 1).cast("long"))
    columns = ["forests", "id", "numbers", "levels", "label"]
    trtr = r.withColumn("forests", F.filter(folds, lambda f: f != F.col("fold")))
    train = trtr.select(columns).unionByName(s.withColumn("forests", F.array(F.lit(N_FOLDS).cast("long"))).select(columns))
    test = r.withColumn("forests", F.array(F.col("fold").cast("long"), F.lit(N_FOLDS).cast("long")))
    votes = forest_votes(train, test, len(nums), len(cats), levels.dummies, trees, seed, depth)
    # a row without a vote (no tree saw a row) takes the first class
    asked = test.select(F.explode("forests").alias("forest"), "id", "fold", "label")
    pred = asked.join(predicted(votes), ["forest", "id"], "left")
    pred = cut_lineage(pred.withColumn("prediction", F.coalesce(F.col("prediction"), F.lit(0)).cast("double")))
    return (fold_accuracy(pred.where(F.col("forest") == N_FOLDS)), fold_accuracy(pred.where(F.col("forest") < N_FOLDS)))


@dataclass
class TstrResult:
    score: float = -1.0
    baseline: float = -1.0
    gap: float = -1.0
    reason: str = ""           # why it could not run


def tstr(real: DataFrame, syn: DataFrame, target: str, key: str, seed: int = 42, trees: int = N_TREES,
         depth: int | None = None) -> TstrResult:
    """M2: score, baseline and gap; −1 each, with the reason, on any failure."""
    try:
        a, b = tstr_frames(real, syn, target, key, seed, trees, depth)
        ta = float(a.agg(F.avg("accuracy")).first()[0])
        tb = float(b.agg(F.avg("accuracy")).first()[0])
        return TstrResult(ta, tb, max(0.0, tb - ta))
    except Exception as exc:  # noqa: BLE001 - whatever stops it, the other measurements stand
        return TstrResult(reason=f"TSTR failed: {str(exc).splitlines()[0] if str(exc) else type(exc).__name__}")
