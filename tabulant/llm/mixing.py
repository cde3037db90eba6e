"""Mixing sources to target weights by hierarchical budgeting.

A tree (say domain, language, source) has a weight at every node.  The token
budget flows down it in proportion to the weights; what a node cannot use is
redistributed among its siblings, and only what no sibling can use is left to
the level above.  Each leaf then takes whole seeded epochs of its documents
and the token-prefix of one more.  Everything is a DataFrame expression, in
exact integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage

D = "decimal(38,0)"
ABSENT = "(null)"
DIGITS, RANGES = 3, 4096   # digits of a key that one round of ranges looks at, and how many ranges they make
RANGE_ROWS = 1 << 16       # documents of a leaf that are ordered in one window, about


def count_tokens(text: Column) -> Column:
    """Words of a text, as its token count; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def epoch_key(id_col: Column, epoch: Column, seed: int) -> Column:
    """The hex key whose ascending order is the seeded permutation of one epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"),
                             F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))


def _path(depth: int) -> Column:
    return F.concat_ws("/", *[F.col(f"__mix_m{k}") for k in range(depth)])


def _share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Divide each parent's ``__mix_b`` among its children: by weight, none over its ``__mix_cap``, all of it used.

    Children in ascending order of cap / weight are full as long as their
    due share of what is left reaches their cap; the rest divide what remains.
    Cumulative floors make the integer shares add up exactly.
    """
    d = lambda c: F.col(c).cast(D)
    by = Window.partitionBy(*parent)
    tight = by.orderBy(F.col("__mix_cap") / F.col("__mix_w"), "__mix_path")
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    onward = tight.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    zero = F.lit(0).cast(D)
    nodes = (nodes.withColumn("__mix_caps", F.coalesce(F.sum(d("__mix_cap")).over(before), zero).cast(D))
             .withColumn("__mix_ws", F.sum(d("__mix_w")).over(onward).cast(D))
             .withColumn("__mix_full", d("__mix_cap") * F.col("__mix_ws") <= d("__mix_w") * (d("__mix_b") - F.col("__mix_caps"))))
    open_w = F.when(F.col("__mix_full"), zero).otherwise(d("__mix_w"))
    upto = by.orderBy("__mix_path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nodes = (nodes.withColumn("__mix_left", (d("__mix_b") - F.sum(F.when(F.col("__mix_full"), d("__mix_cap")).otherwise(zero))
                                         .over(by)).cast(D))
             .withColumn("__mix_cum", F.sum(open_w).over(upto).cast(D)).withColumn("__mix_all", F.sum(open_w).over(by).cast(D)))
    exact = lambda c: F.expr(f"cast(__mix_left * ({c}) as {D}) div __mix_all")
    got = F.when(F.col("__mix_full"), F.col("__mix_cap")).otherwise(exact("__mix_cum") - exact(f"__mix_cum - cast(__mix_w as {D})"))
    return nodes.withColumn("__mix_got", got.cast("long"))


def leaf_budgets(leaves: DataFrame, depth: int, weights: DataFrame | None, budget: int, max_epochs: int) -> DataFrame:
    """Token budget of every leaf.

    ``leaves``: ``__mix_m0 .. __mix_m<depth-1>`` and ``__mix_tokens`` of each leaf;
    ``weights``: ``path`` (labels joined by ``/``) and ``weight`` (a positive
    integer), 1 where absent, a leaf or inner node of weight 0 takes nothing.
    """
    caps = leaves.withColumn("__mix_cap", F.col("__mix_tokens") * F.lit(max_epochs))
    names = [f"__mix_m{k}" for k in range(depth)]
    levels = []
    for k in range(1, depth + 1):
        nodes = caps.groupBy(*names[:k]).agg(F.sum("__mix_cap").alias("__mix_cap")).withColumn("__mix_path", _path(k))
        if weights is not None:
            nodes = nodes.join(weights.select(F.col("path").alias("__mix_path"),
                                              F.col("weight").cast("long").alias("__mix_w")), "__mix_path", "left")
            nodes = nodes.withColumn("__mix_w", F.coalesce("__mix_w", F.lit(1)).cast("long"))
        else:
            nodes = nodes.withColumn("__mix_w", F.lit(1).cast("long"))
        levels.append(nodes)
    # What a subtree can use: nothing below a weight of 0.
    for k in range(depth - 1, -1, -1):
        usable = levels[k].withColumn("__mix_cap", F.when(F.col("__mix_w") > 0, F.col("__mix_cap")).otherwise(0))
        if k + 1 < depth:
            below = levels[k + 1].groupBy(*names[:k + 1]).agg(F.sum("__mix_cap").alias("__mix_sub"))
            usable = (usable.join(below, names[:k + 1])
                      .withColumn("__mix_cap", F.least("__mix_cap", "__mix_sub")).drop("__mix_sub"))
        levels[k] = usable.filter("__mix_cap > 0")
    top = Window.partitionBy(F.lit(1))  # over the first level's nodes
    nodes = levels[0].withColumn("__mix_b", F.least(F.lit(int(budget)), F.sum("__mix_cap").over(top)).cast("long"))
    out = _share(nodes.withColumn("__mix_top", F.lit(0)), ["__mix_top"])
    for k in range(1, depth):
        parents = out.select(*names[:k], F.col("__mix_got").alias("__mix_b"))
        out = _share(levels[k].join(parents, names[:k]), names[:k])
    return out.select(*names, F.col("__mix_got").alias("__mix_budget"))


def mix(docs: DataFrame, levels: dict[str, Column], weights: DataFrame | None = None, budget: int | None = None,
        budget_percent: int = 100, max_epochs: int = 2, seed: int = 42, id_col: str = "doc_id",
        text_col: str = "text", tokens_col: str | None = None, epoch_out: str = "epoch") -> DataFrame:
    """Select documents so that tokens follow the target weights of a tree of sources.

    ``levels``: the tree from its root down, label column by name (NULL is the
    label ``(null)``).  ``budget``: tokens in all, else ``budget_percent`` of the
    table's; at most ``max_epochs`` times a leaf's tokens are taken from it.
    A leaf with budget A and T tokens takes A div T whole epochs and, of the
    next, the longest prefix in seeded order whose tokens fit into the rest.

    Returns the columns of ``docs`` and ``epoch_out`` (from 0), one row for each
    time a document is taken.  The leaf a third of all rows belong to is not a
    hot group: its prefix is found from token sums of 4096 key ranges, the range
    that holds the cut is divided again while it may have more than
    ``RANGE_ROWS`` documents, and only those left are ordered in a window
    (documents of one id have one key and stay together).  Leaves
    without tokens yield nothing; an empty table gives an empty result; equal
    rows are taken one by one.
    """
    depth = len(levels)
    names = [f"__mix_m{k}" for k in range(depth)]
    tokens = F.col(tokens_col) if tokens_col else count_tokens(F.col(text_col))
    keyed = docs.select("*", tokens.alias("__mix_t"), *[
        F.coalesce(c.cast("string"), F.lit(ABSENT)).alias(n) for n, c in zip(names, levels.values())])
    lean = keyed.select(F.col(id_col).alias("__mix_id"), "__mix_t", *names)
    if not tokens_col:
        lean = stage(lean, "mix-tokens")
    leaves = stage(lean.groupBy(*names).agg(F.sum("__mix_t").alias("__mix_tokens"),
                                               F.count(F.lit(1)).alias("__mix_n")), "mix-leaves")
    if budget is None:
        total = leaves.agg(F.sum("__mix_tokens")).first()[0] or 0
        budget = total * budget_percent // 100
    plan = leaf_budgets(leaves, depth, weights, budget, max_epochs).join(leaves, names)
    plan = stage(plan.select(*names, "__mix_budget", F.expr("cast(__mix_budget div __mix_tokens as int)").alias("__mix_whole"),
                             F.expr("__mix_budget % __mix_tokens").alias("__mix_rest")), "mix-plan")

    # Ranges of keys, by ever more of their digits, until the range that holds a leaf's cut is short enough to be ordered.
    key = epoch_key(F.col("__mix_id"), F.col("__mix_whole"), seed)
    rounds, most = 1, leaves.agg(F.max("__mix_n")).first()[0] or 0
    while most > RANGE_ROWS * RANGES ** rounds and rounds < 10:
        rounds += 1
    plan = plan.withColumns({"__mix_cut_key": F.lit(""), "__mix_cut_at": F.lit(0).cast("long")})
    upto = Window.partitionBy(*names).orderBy("__mix_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for r in range(1, rounds + 1):
        digits = lambda n: F.substring("__mix_key", 1, DIGITS * n)
        inside = lean.join(plan, names).withColumn("__mix_key", key).filter(digits(r - 1) == F.col("__mix_cut_key"))
        cut = inside.groupBy(*names, "__mix_rest", "__mix_cut_at", digits(r).alias("__mix_k")).agg(F.sum("__mix_t").alias("__mix_s"))
        cut = (cut.withColumn("__mix_c", F.sum("__mix_s").over(upto) + F.col("__mix_cut_at")).filter("__mix_c > __mix_rest")
               .groupBy(*names).agg(F.min(F.struct("__mix_k", (F.col("__mix_c") - F.col("__mix_s")).alias("__mix_c"))).alias("__mix_cut")))
        plan = stage(plan.drop("__mix_cut_key", "__mix_cut_at").join(cut, names).select(
            *names, "__mix_whole", "__mix_rest", F.col("__mix_cut.__mix_k").alias("__mix_cut_key"),
            F.col("__mix_cut.__mix_c").cast("long").alias("__mix_cut_at")), "mix-cuts")
    bucket = F.substring("__mix_key", 1, DIGITS * rounds)

    taken = (keyed.withColumn("__mix_id", F.col(id_col)).join(plan, names).withColumn("__mix_key", key)
             .withColumn("__mix_k", bucket))
    whole = F.when(F.col("__mix_whole") > 0, F.sequence(F.lit(0), F.col("__mix_whole") - 1)).otherwise(
        F.array().cast("array<int>"))
    prefix = F.when((F.col("__mix_k") < F.col("__mix_cut_key")) & (F.col("__mix_rest") > 0), F.array(F.col("__mix_whole"))).otherwise(
        F.array().cast("array<int>"))
    cols = [F.col(c) for c in docs.columns]
    clear = taken.select(*cols, F.explode(F.concat(whole, prefix)).alias(epoch_out))
    order = Window.partitionBy(*names).orderBy("__mix_key", "__mix_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = (taken.filter((F.col("__mix_k") == F.col("__mix_cut_key")) & (F.col("__mix_rest") > 0))
            .withColumn("__mix_upto", F.sum("__mix_t").over(order) + F.col("__mix_cut_at")).filter("__mix_upto <= __mix_rest")
            .select(*cols, F.col("__mix_whole").alias(epoch_out)))
    return clear.unionByName(edge)


def mix_report(mixed: DataFrame, levels: dict[str, Column], tokens: Column) -> DataFrame:
    """Documents and tokens taken from each leaf."""
    return mixed.groupBy(*[c.alias(n) for n, c in levels.items()]).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(tokens).alias("tokens"))


def node_weights(spark, weights: dict[tuple[str, ...], int]) -> DataFrame:
    """Weights by label path as the DataFrame that ``mix`` takes."""
    rows = [F.struct(F.lit("/".join(p)).alias("path"), F.lit(int(w)).cast("long").alias("weight"))
            for p, w in weights.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))
