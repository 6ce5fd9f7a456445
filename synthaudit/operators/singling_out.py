"""Univariate singling-out attack.

Predicates are learned from the synthetic table, one per (column, kind):
``col IS NULL``, ``col <= min`` and ``col >= max`` for numerics, and
``col = v`` for values seen once.  A predicate is kept if it isolates
exactly one synthetic row; it is identified by that row's key, so the
seeded order ``md5(seed|column|kind|key)`` is the same in any engine.
The first ``n_attacks`` predicates are evaluated on real (training) and
control rows; success = exactly one matching row.  Risk is the residual
risk of the real success rate over the control rate (Wilson intervals).

Plan: syn is unpivoted to ``(column_name, vnum, vstr)`` and counted per value
(partial aggregation, then one shuffle on the value).  The chosen
predicates (≤ n_attacks rows, a proven bound) are broadcast and joined to
the unpivoted real / control rows, so only matching rows are counted; the
few range and null predicates are one aggregate with ``count_if``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthaudit.functions.columns import feature_columns, is_numeric_type
from synthaudit.functions.keys import hash_text
from synthaudit.functions.risk import residual_risk
from synthaudit.operators.results import AttackResult, failed_result

PRED_SCHEMA = "column_name string, kind string, vnum double, vstr string, syn_key long"


def value_key(vnum, vstr):
    """One non-null text key per value: ``n:<double>``, ``s:<text>``, ``null:``
    (``+ 0.0`` folds −0.0 into 0.0; doubles print in round-trip form)."""
    return (F.when(vnum.isNotNull(), F.concat(F.lit("n:"), (vnum + F.lit(0.0)).cast("string")))
            .when(vstr.isNotNull(), F.concat(F.lit("s:"), vstr)).otherwise(F.lit("null:")))


def unpivot_values(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """``(key, column_name, vnum, vstr)``: numerics as double, the rest as text."""
    items = []
    for c in cols:
        num = is_numeric_type(df.schema[c].dataType)
        items.append(F.struct(
            F.lit(c).alias("column_name"),
            (F.col(c).cast("double") if num else F.lit(None).cast("double")).alias("vnum"),
            (F.lit(None).cast("string") if num else F.col(c).cast("string")).alias("vstr")))
    return df.select(F.col(key).alias("__k"), F.explode(F.array(*items)).alias("__v")).select(
        F.col("__k").alias(key), "__v.column_name", "__v.vnum", "__v.vstr")


def value_counts(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """``(column_name, vkey, vnum, vstr, n, min_key)`` per distinct value
    (NULL is a value), hash-partitioned on ``(column_name, vkey)``."""
    u = unpivot_values(df, key, cols)
    return u.groupBy("column_name", value_key(F.col("vnum"), F.col("vstr")).alias("vkey")).agg(
        F.first("vnum").alias("vnum"), F.first("vstr").alias("vstr"),
        F.count(F.lit(1)).alias("n"), F.min(key).alias("min_key"))


def predicates(syn: DataFrame, key: str, cols: list[str], counts: DataFrame | None = None) -> DataFrame:
    """All predicates isolating exactly one synthetic row."""
    if counts is None:
        counts = unpivot_values(syn, key, cols).groupBy("column_name", "vnum", "vstr").agg(
            F.count(F.lit(1)).alias("n"), F.min(key).alias("min_key"))
    nums = [c for c in cols if is_numeric_type(syn.schema[c].dataType)]
    isnull = F.col("vnum").isNull() & F.col("vstr").isNull()
    kinds = [F.when(isnull, F.lit("null")).otherwise(F.lit("eq"))]
    if nums:
        b = syn.agg(*[F.min(F.col(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(nums)],
                    *[F.max(F.col(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(nums)]).first()
        for kind, pre in (("le", "lo"), ("ge", "hi")):
            conds = [(F.col("column_name") == c) & (F.col("vnum") == F.lit(b[f"{pre}{i}"]))
                     for i, c in enumerate(nums) if b[f"{pre}{i}"] is not None]
            if conds:
                kinds.append(F.when(reduce(or_, conds), F.lit(kind)))
    # every kind from one count of the values
    return counts.where(F.col("n") == 1).select(
        "column_name", F.explode(F.array_compact(F.array(*kinds))).alias("kind"), "vnum", "vstr",
        F.col("min_key").alias("syn_key"))


def choose(preds: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """First ``n`` predicates in seeded hash order (a top-k, bounded by n)."""
    h = hash_text(seed, F.col("column_name"), F.col("kind"), F.col("syn_key"))
    return preds.withColumn("__o", h).orderBy("__o", "column_name", "kind", "syn_key").limit(n).drop("__o")


TOPK_START = 4          # first candidate pool: 4 × n_attacks equality rows
FULL_COUNT_CELLS = 20_000_000   # below this many syn cells, counting all values is cheaper
MAX_POOL = 256_000      # beyond this pool size fall back to full value counts


def special_predicates(syn: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """``null`` / ``le`` / ``ge`` predicates isolating one row (≤ 3p rows),
    from two aggregates over syn (no shuffle of rows)."""
    nums = [c for c in cols if is_numeric_type(syn.schema[c].dataType)]
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count_if(F.col(c).isNull()).alias(f"z{i}"), F.min(F.when(F.col(c).isNull(), F.col(key))).alias(f"zk{i}")]
    for i, c in enumerate(nums):
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    b = syn.agg(*aggs).first()
    rows = [(c, "null", None, None, b[f"zk{i}"]) for i, c in enumerate(cols) if b[f"z{i}"] == 1]
    if nums:
        aggs2 = []
        for i, c in enumerate(nums):
            x = F.col(c).cast("double")
            for kind, v in (("le", b[f"lo{i}"]), ("ge", b[f"hi{i}"])):
                if v is None:
                    continue
                hit = x == F.lit(v)
                aggs2 += [F.count_if(hit).alias(f"n_{kind}{i}"), F.min(F.when(hit, F.col(key))).alias(f"k_{kind}{i}")]
        if aggs2:
            r = syn.agg(*aggs2).first()
            for i, c in enumerate(nums):
                for kind, v in (("le", b[f"lo{i}"]), ("ge", b[f"hi{i}"])):
                    if v is not None and r[f"n_{kind}{i}"] == 1:
                        rows.append((c, kind, float(v), None, r[f"k_{kind}{i}"]))
    return syn.sparkSession.createDataFrame(rows, PRED_SCHEMA)


def choose_topk(syn: DataFrame, key: str, cols: list[str], n: int, seed: int = 42,
                n_rows: int | None = None) -> DataFrame:
    """Same result as ``choose(predicates(...), n)`` without counting every
    value of syn.  Equality predicates are ordered by a hash of the row key,
    known before counting: the ``m`` syn cells with the smallest hash are
    taken (a top-k), and only their values are counted, through a broadcast
    join of those ≤ m values with the unpivoted syn.  If fewer than ``n`` of
    them are unique, ``m`` grows, as long as the next pool can be expected to
    hold ``n``; where most values recur, all values are counted instead.
    Exact: any unique value outside the pool ranks after at least ``n`` unique
    values inside it."""
    uv = unpivot_values(syn, key, cols)
    isnull = F.col("vnum").isNull() & F.col("vstr").isNull()
    uvh = uv.where(~isnull).withColumn("__o", hash_text(seed, F.col("column_name"), F.lit("eq"), F.col(key)))
    uvh = uvh.withColumn("__ho", F.conv(F.substring("__o", 1, 15), 16, 10).cast("long"))
    spark = syn.sparkSession
    special = special_predicates(syn, key, cols)
    cells = (n_rows if n_rows is not None else syn.count()) * len(cols)
    m = max(TOPK_START * n, 64)
    while True:
        # the first m cells in hash order all lie below a hash prefix holding
        # ~4m cells on average: filter first, so tasks send few rows to the driver
        src = uvh
        frac = (4.0 * m + 64.0) / max(cells, 1)
        while frac < 1.0:
            pre = uvh.where(F.col("__ho") < F.lit(int(frac * (1 << 60))))
            if pre.count() >= m:
                src = pre
                break
            frac *= 4.0
        pool = src.orderBy("__o", "column_name", key).limit(m).collect()
        pdf = spark.createDataFrame([(r["column_name"], "eq", r["vnum"], r["vstr"], r[key]) for r in pool], PRED_SCHEMA)
        vals = F.broadcast(pdf.select("column_name", "vnum", "vstr").distinct())
        j = uv.join(vals, (uv.column_name == vals.column_name) & uv.vnum.eqNullSafe(vals.vnum)
                    & uv.vstr.eqNullSafe(vals.vstr))
        cnt = j.groupBy(vals.column_name, vals.vnum, vals.vstr).agg(F.count(F.lit(1)).alias("n"))
        uniq = pdf.alias("p").join(cnt.where(F.col("n") == 1).alias("c"),
                                   (F.col("p.column_name") == F.col("c.column_name"))
                                   & F.col("p.vnum").eqNullSafe(F.col("c.vnum"))
                                   & F.col("p.vstr").eqNullSafe(F.col("c.vstr")), "left_semi")
        k = uniq.count()
        if k >= n or len(pool) < m or m >= MAX_POOL or 4 * k < n:
            break
        m *= 4
    if k < n and len(pool) >= m:          # too few unique values in reach: exact fallback on full counts
        return choose(predicates(syn, key, cols), n, seed)
    return choose(uniq.unionByName(special), n, seed)


def choose_predicates(syn: DataFrame, key: str, cols: list[str], n: int, seed: int = 42,
                      n_rows: int | None = None) -> DataFrame:
    """The first ``n`` predicates; full value counts for small tables,
    the top-k pool (no shuffle of all values) for large ones."""
    n_rows = n_rows if n_rows is not None else syn.count()
    if n_rows * len(cols) <= FULL_COUNT_CELLS:
        return choose(predicates(syn, key, cols), n, seed)
    return choose_topk(syn, key, cols, n, seed, n_rows)


def success_counts(chosen_rows: list, tables: dict, key: str) -> dict:
    """Number of chosen predicates that match exactly one row, per table,
    from one tagged union of the tables (one join + one aggregate job)."""
    spark = next(iter(tables.values())).sparkSession
    tagged = None
    for tag, t in tables.items():
        cols = sorted({r["column_name"] for r in chosen_rows})
        part = t.select(key, *cols).withColumn("__t", F.lit(tag))
        tagged = part if tagged is None else tagged.unionByName(part)
    hits = {tag: 0 for tag in tables}
    eq = [r for r in chosen_rows if r["kind"] == "eq"]
    if eq:
        eq_df = F.broadcast(spark.createDataFrame(
            [(r["column_name"], r["kind"], r["vnum"], r["vstr"], r["syn_key"]) for r in eq], PRED_SCHEMA))
        cols = sorted({r["column_name"] for r in eq})
        items = []
        for c in cols:
            num = is_numeric_type(tagged.schema[c].dataType)
            items.append(F.struct(
                F.lit(c).alias("column_name"),
                (F.col(c).cast("double") if num else F.lit(None).cast("double")).alias("vnum"),
                (F.lit(None).cast("string") if num else F.col(c).cast("string")).alias("vstr")))
        tv = tagged.select("__t", F.explode(F.array(*items)).alias("__v")).select(
            "__t", "__v.column_name", "__v.vnum", "__v.vstr")
        j = tv.join(eq_df, (tv.column_name == eq_df.column_name) & tv.vnum.eqNullSafe(eq_df.vnum)
                    & tv.vstr.eqNullSafe(eq_df.vstr))
        per = j.groupBy("__t", eq_df.column_name, eq_df.syn_key).agg(F.count(F.lit(1)).alias("n"))
        for r in per.where(F.col("n") == 1).groupBy("__t").count().collect():
            hits[r["__t"]] += r["count"]
    other = [r for r in chosen_rows if r["kind"] != "eq"]
    if other:
        aggs = []
        for i, r in enumerate(other):
            c = F.col(r["column_name"])
            if r["kind"] == "null":
                cond = c.isNull()
            elif r["kind"] == "le":
                cond = c.cast("double") <= F.lit(r["vnum"])
            else:
                cond = c.cast("double") >= F.lit(r["vnum"])
            aggs.append(F.count_if(cond).alias(f"p{i}"))
        for r in tagged.groupBy("__t").agg(*aggs).collect():
            hits[r["__t"]] += sum(1 for i in range(len(other)) if r[f"p{i}"] == 1)
    return hits


def singling_out(real: DataFrame, syn: DataFrame, control: DataFrame, key: str,
                 n_attacks: int = 500, seed: int = 42) -> AttackResult:
    """Univariate singling-out risk of ``syn`` against ``real``."""
    try:
        cols = [c for c in feature_columns(real, key) if c in syn.columns]
        if not cols:
            return failed_result("SinglingOut", "no shared columns")
        chosen = choose_predicates(syn, key, cols, n_attacks, seed)
        chosen_rows = chosen.collect()
        n = len(chosen_rows)
        if n == 0:
            return failed_result("SinglingOut", "no predicate isolates a synthetic row")
        hits = success_counts(chosen_rows, {"real": real, "control": control}, key)
        s, c = hits["real"], hits["control"]
        risk, lo, hi = residual_risk(s, c, n)
        return AttackResult("SinglingOut", risk, lo, hi, n, False,
                            f"n_success={s} | n_control_success={c} | n_requested={n_attacks}", s, c)
    except Exception as exc:  # noqa: BLE001 - fail safe, whatever stops the attack
        return failed_result("SinglingOut", str(exc))


def singling_out_matches(real: DataFrame, syn: DataFrame, control: DataFrame, key: str) -> DataFrame:
    """J7 over every equality predicate: per column, how many synthetic
    values occur once (``n_predicates``) and how many of them isolate
    exactly one real / control row.  All three sides are value counts
    hash-partitioned on ``(column_name, vkey)``; the equi-joins on the same
    keys reuse that partitioning (no further exchange)."""
    cols = [c for c in feature_columns(real, key) if c in syn.columns]
    sv = (value_counts(syn, key, cols).where((F.col("n") == 1) & (F.col("vkey") != "null:"))
          .select("column_name", "vkey"))
    out = sv
    for name, t in (("train", real), ("control", control)):
        tv = value_counts(t, key, cols).where(F.col("n") == 1).select(
            "column_name", "vkey", F.lit(1).alias(f"hit_{name}"))
        out = out.join(tv, ["column_name", "vkey"], "left")
    return out.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_predicates"),
        F.count("hit_train").alias("hits_train"),
        F.count("hit_control").alias("hits_control"))
