"""Mixing sources to target weights by hierarchical budgets.

A token budget runs down a tree domain > language > source. At each node the children get shares in
proportion to their weights; a child that cannot use its share (its tokens times ``max_epochs``) gets
what it can, and its siblings take the rest before anything goes back up: a node is never given more
than all below it can hold, so only then does the shortage reach the siblings of its parent.

Each leaf then reads its documents in seeded epochs: whole epochs as often as the budget holds all its
tokens, and of the next epoch the longest prefix, in the order of a hash of seed, epoch and document,
whose tokens fit the rest. The end of the prefix is found from token sums of 4096 parts of the leaf's
hash order and one of these parts, so a leaf with a third of all rows is not sorted.

Defined results: null domain, language or source counts as the empty name. A null or empty text has 0
tokens; it comes along when it lies before the end of a prefix. Documents equal in id and text have
the same place in the order and stand or fall together. Shares are whole tokens, rounded down. Weights
below or equal to 0 or null give nothing. Extra columns are kept by ``mix_documents`` whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from trainset.llm.common import materialize

LEVELS = ("domain", "lang", "source")
_PART_DIGITS = 3
MAX_BROADCAST_LEAVES = 20_000  # plan rows of some 200 bytes; with more leaves the join is shuffled


@dataclass(frozen=True)
class Tree:
    """How a document finds its leaf, and the weights, as expressions over domain, lang and source."""

    domain: Column
    domain_weight: Column
    lang_weight: Column
    source_weight: Column


def default_tree() -> Tree:
    """Sources are dealt to four domains by the number in their name."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("long"), F.lit(0)) % 4
    domain = F.when(number == 1, "books").when(number == 2, "forum").when(number == 3, "code").otherwise("web")
    return Tree(
        domain=domain,
        domain_weight=F.when(F.col("domain") == "web", 4.0).when(F.col("domain") == "books", 3.0).when(F.col("domain") == "code", 2.0).otherwise(1.0),
        lang_weight=F.when(F.col("lang") == "en", 4.0).when(F.col("lang").isin("fr", "de", "es"), 2.0).otherwise(1.0),
        source_weight=F.lit(1.0),
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \t\n\r]+")), F.lit(0)).cast("long")


def _named(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _order(seed: int, epoch: Column, doc_id: Column, digest: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), _named(doc_id), _named(digest)))


def water_fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children`` (parent, name, weight, cap, budget of the parent) with ``share``.

    In order of cap / weight, a child is full while its ratio is at most what remains for each unit of
    weight of it and those after it; the others get that rate.
    """
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(0.0))
    ratio = F.when(weight > 0, F.col("cap") / weight).otherwise(F.lit(float("inf")))
    group = [F.col(p) for p in parent] or [F.lit(0)]
    inside, whole = Window.partitionBy(*group).orderBy("ratio", name), Window.partitionBy(*group)
    ranked = (
        children.withColumn("weight", weight)
        .withColumn("ratio", ratio)
        .withColumn("at", F.row_number().over(inside))
        .withColumn("spent", F.sum("cap").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("left", F.sum("weight").over(inside.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("rate", F.when(F.col("left") > 0, (F.col("budget") - F.col("spent")) / F.col("left")))
        .withColumn("full", (F.col("weight") > 0) & (F.col("ratio") <= F.col("rate")))
    )
    rate = F.min(F.when(~F.col("full"), F.struct("at", "rate"))).over(whole)["rate"]
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.coalesce(F.floor(F.col("weight") * F.col("common")), F.lit(0)))
    shared = ranked.withColumn("common", rate).withColumn("share", F.least(share, F.col("cap")).cast("long"))
    return shared.select(*parent, name, "share")


def leaf_budgets(leaves: DataFrame, tree: Tree, budget_fraction: float, budget: int | None, max_epochs: int) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with the token budget of each."""
    capped = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = F.lit(budget) if budget is not None else F.floor(F.sum("tokens").over(Window.partitionBy(F.lit(0))) * F.lit(budget_fraction))
    given, parent = None, []
    for level, weight in zip(LEVELS, (tree.domain_weight, tree.lang_weight, tree.source_weight)):
        names = [*parent, level]
        nodes = capped.groupBy(*names).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", weight.cast("double"))
        nodes = nodes.withColumn("budget", total) if given is None else nodes.join(given, parent)
        filled = water_fill(nodes, parent, level)
        given, parent = filled.withColumnRenamed("share", "budget"), names
    return leaves.join(given, list(LEVELS))


def _plan(narrow: DataFrame, tree: Tree, seed: int, budget_fraction: float, budget: int | None, max_epochs: int) -> tuple[DataFrame, bool]:
    """One row per leaf: whole epochs, the rest, and up to which hash the next epoch is read."""
    leaves = materialize(narrow.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    plan = leaf_budgets(leaves, tree, budget_fraction, budget, max_epochs)
    epochs = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(max_epochs))).otherwise(0)
    plan = plan.withColumn("epochs", epochs.cast("long"))
    plan = materialize(plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")), "mix-plan")
    small = plan.count() <= MAX_BROADCAST_LEAVES
    open_leaves = plan.where("rest > 0").select(*LEVELS, "epochs", "rest")
    keyed = narrow.join(F.broadcast(open_leaves) if small else open_leaves, list(LEVELS))
    keyed = keyed.withColumn("ord", _order(seed, F.col("epochs"), F.col("doc_id"), F.col("digest")))
    keyed = keyed.withColumn("part", F.substring("ord", 1, _PART_DIGITS))
    sums = keyed.groupBy(*LEVELS, "rest", "part").agg(F.sum("n_tokens").alias("n"))
    parts = sums.withColumn("before", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("part")) - F.col("n"))
    edge = parts.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest"))).select(*LEVELS, "part", "before")
    edge = edge.withColumnRenamed("part", "edge")
    inside = keyed.join(F.broadcast(edge) if small else edge, list(LEVELS)).where("part = edge")
    running = F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("ord")) + F.col("before")
    ends = inside.withColumn("running", running).where("running <= rest").groupBy(*LEVELS).agg(F.max("ord").alias("end"))
    plan = plan.join(edge.select(*LEVELS, "edge"), list(LEVELS), "left").join(ends, list(LEVELS), "left")
    return materialize(plan.select(*LEVELS, "epochs", "budget", F.coalesce("end", "edge").alias("end")), "mix-ends"), small


def _mixed(rows: DataFrame, plan: DataFrame, small: bool, seed: int) -> DataFrame:
    """``rows`` (with leaf, doc_id and digest) once for each epoch that reads them."""
    joined = rows.join(F.broadcast(plan) if small else plan, list(LEVELS))
    partly = _order(seed, F.col("epochs"), F.col("doc_id"), F.col("digest")) <= F.col("end")
    times = F.col("epochs") + F.when(partly, 1).otherwise(0)
    return joined.withColumn("times", times).where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))



def _narrow(docs: DataFrame, tree: Tree, doc_id: str, text: str, lang: str, source: str, tokens: Column | None) -> DataFrame:
    counted = word_count(F.col(text)) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), _named(F.col(lang)).alias("lang"), _named(F.col(source)).alias("source"),
        F.md5(F.col(text).cast("binary")).alias("digest"), counted.alias("n_tokens"),
    )
    return rows.withColumn("domain", _named(tree.domain))


def mix_plan_and_rows(docs: DataFrame, **options) -> DataFrame:
    """The selected documents, narrow: doc_id, domain, lang, source, n_tokens and the epoch."""
    o = {**_DEFAULTS, **options}
    tree = o["tree"] or default_tree()
    narrow = materialize(_narrow(docs, tree, o["doc_id"], o["text"], o["lang"], o["source"], o["tokens"]), "mix-rows")
    plan, small = _plan(narrow, tree, o["seed"], o["budget_fraction"], o["budget"], o["max_epochs"])
    return _mixed(narrow, plan, small, o["seed"]).select("doc_id", *LEVELS, "n_tokens", "epoch")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The selected documents with all their columns, once for each epoch that reads them."""
    o = {**_DEFAULTS, **options}
    tree = o["tree"] or default_tree()
    narrow = materialize(_narrow(docs, tree, o["doc_id"], o["text"], o["lang"], o["source"], o["tokens"]), "mix-rows")
    plan, small = _plan(narrow, tree, o["seed"], o["budget_fraction"], o["budget"], o["max_epochs"])
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(o["doc_id"]).alias("doc_id"),
        _named(F.col(o["lang"])).alias("lang"), _named(F.col(o["source"])).alias("source"), F.md5(F.col(o["text"]).cast("binary")).alias("digest"),
    ).withColumn("domain", _named(tree.domain))
    return _mixed(rows, plan, small, o["seed"]).select("row.*")


_DEFAULTS = {
    "doc_id": "doc_id", "text": "text", "lang": "lang", "source": "source", "tokens": None, "tree": None,
    "seed": 17, "budget_fraction": 0.6, "budget": None, "max_epochs": 3,
}


def oracle(seed: int = 17, fraction: float = 0.6, max_epochs: int = 3) -> str:
    """The rows of ``mix_plan_and_rows(documents)`` in SQL."""

    def fill(nodes: str, parent: str, name: str, out: str) -> str:
        by = f"PARTITION BY {parent}" if parent else ""
        keys = f"{parent}, {name}" if parent else name
        return f"""{out}_r AS (SELECT *, CASE WHEN weight > 0 THEN cap / weight ELSE 'inf'::DOUBLE END AS ratio FROM {nodes}),
        {out}_s AS (SELECT *, row_number() OVER w AS place, CAST(sum(cap) OVER (w ROWS UNBOUNDED PRECEDING) - cap AS BIGINT) AS spent,
            sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining
            FROM {out}_r WINDOW w AS ({by} ORDER BY ratio, {name})),
        {out}_t AS (SELECT *, (budget - spent) / remaining AS rate FROM {out}_s),
        {out}_u AS (SELECT *, min(CASE WHEN NOT (ratio <= rate) THEN place END) OVER ({by}) AS first_open FROM {out}_t),
        {out}_v AS (SELECT *, max(CASE WHEN place = first_open THEN rate END) OVER ({by}) AS common FROM {out}_u),
        {out} AS (SELECT {keys}, CAST(CASE WHEN ratio <= rate THEN cap ELSE least(cap, floor(weight * common)) END AS BIGINT) AS budget FROM {out}_v)"""

    return f"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, md5(text) AS digest,
            CAST(coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0) AS BIGINT) AS n_tokens,
            CASE coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0) % 4
                WHEN 1 THEN 'books' WHEN 2 THEN 'forum' WHEN 3 THEN 'code' ELSE 'web' END AS domain FROM documents),
    leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
    n1 AS (SELECT domain, CAST(sum(tokens) * {max_epochs} AS BIGINT) AS cap,
            CASE domain WHEN 'web' THEN 4.0::DOUBLE WHEN 'books' THEN 3.0 WHEN 'code' THEN 2.0 ELSE 1.0 END AS weight,
            (SELECT floor(CAST(sum(tokens) AS DOUBLE) * {fraction}::DOUBLE) FROM leaves) AS budget FROM leaves GROUP BY domain),
    {fill('n1', '', 'domain', 'b1')},
    n2 AS (SELECT domain, lang, CAST(sum(tokens) * {max_epochs} AS BIGINT) AS cap,
            CASE WHEN lang = 'en' THEN 4.0::DOUBLE WHEN lang IN ('fr', 'de', 'es') THEN 2.0 ELSE 1.0 END AS weight, any_value(budget) AS budget
            FROM leaves JOIN b1 USING (domain) GROUP BY domain, lang),
    {fill('n2', 'domain', 'lang', 'b2')},
    n3 AS (SELECT domain, lang, source, tokens * {max_epochs} AS cap, 1.0::DOUBLE AS weight, budget FROM leaves JOIN b2 USING (domain, lang)),
    {fill('n3', 'domain, lang', 'source', 'b3')},
    plan AS (SELECT domain, lang, source, budget, CASE WHEN tokens > 0 THEN least(budget // tokens, {max_epochs}) ELSE 0 END AS epochs, tokens
            FROM leaves JOIN b3 USING (domain, lang, source)),
    o AS (SELECT d.*, epochs, budget - epochs * tokens AS rest,
            md5('{seed}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(digest, '')) AS ord
            FROM d JOIN plan USING (domain, lang, source)),
    r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY ord) AS running FROM o),
    t AS (SELECT *, CAST(epochs + CASE WHEN rest > 0 AND running <= rest THEN 1 ELSE 0 END AS BIGINT) AS times FROM r)
    SELECT doc_id, domain, lang, source, n_tokens, unnest(range(times)) AS epoch FROM t WHERE times > 0"""
