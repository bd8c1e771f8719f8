"""Mixing sources to target weights (operator 7).

Hierarchical budgeting over a tree domain -> language -> source. Each node may give at most
the tokens of its leaves times ``max_epochs``. From the root down, a node's budget is shared
among its children in proportion to their weights; a child that can't use its share is filled
up, and what it leaves goes to its siblings first. As a node never gets more than its leaves
can give, a shortage reaches an ancestor's other children only when all siblings are full.

Each leaf orders its documents by a seeded hash for every epoch; whole epochs are taken while
they fit the leaf's budget, then the longest prefix of the next epoch's order that fits.
Prefixes are found over two levels, hash buckets and then the one bucket where the budget
ends, so a leaf that holds a third of all rows is never sorted in one task.

A text is counted whole; a task needs memory in proportion to its longest text. All amounts are
whole tokens and all divisions round down, so results don't depend on the
order of summation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitree.llm.shared import materialize

#: Tokens to take, as a share of the corpus; copies of a document at most; the draw's seed.
BUDGET_SHARE = 0.5
MAX_EPOCHS = 2
SEED = 17
#: Target weights; what is not named weighs 1.
DOMAIN_WEIGHTS = {"web": 5, "books": 2, "forum": 2, "code": 1}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}
#: Domains by the source's number, where the name ends in one.
DOMAINS = ("web", "books", "forum", "code")
#: Hash buckets of a leaf.
BUCKETS = 4096

_AMOUNT = "decimal(38,0)"


def domain_of(source: Column, domains: dict[str, str] | None = None) -> Column:
    """The domain of a source as ``domains`` maps it (what it doesn't name is in the domain '').
    Without a map its number modulo four names it; sources without one are web."""
    if domains is not None:
        pairs = [F.lit(x) for pair in domains.items() for x in pair]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), source), F.lit("")) if pairs else F.lit("")
    digits = F.regexp_extract(source, r"([0-9]+)$", 1)
    picks = F.array(*(F.lit(d) for d in DOMAINS))
    return F.when(digits == "", F.lit(DOMAINS[0])).otherwise(F.get(picks, (F.substring(digits, -4, 4).cast("int") % len(DOMAINS))))


def _weight(value: Column, weights: dict[str, int]) -> Column:
    if any(int(w) != w or w < 1 for w in weights.values()):
        raise ValueError("weights are whole numbers of at least 1")
    out = F.lit(1)
    for name, weight in weights.items():
        out = F.when(value == name, weight).otherwise(out)
    return out


def share_out(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Split each parent's ``budget`` among its rows by ``weight`` up to ``capacity``.

    Children are filled in order of capacity per weight: while the next one's capacity is at
    most its share of what is left, it is filled; the others share the rest by weight."""
    key = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), child)
    before = key.rowsBetween(Window.unboundedPreceding, -1)
    onward = key.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = children.withColumn("filled", F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast(_AMOUNT)).withColumn("open", F.sum("weight").over(onward).cast(_AMOUNT))
    rows = rows.withColumn("full", F.col("capacity") * F.col("open") <= (F.col("budget") - F.col("filled")) * F.col("weight"))
    whole = Window.partitionBy(*parent)
    rows = rows.withColumn("spent", F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(whole), F.lit(0)).cast(_AMOUNT)).withColumn("sharing", F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole).cast(_AMOUNT))
    part = F.expr("((budget - spent) * weight) div sharing").cast(_AMOUNT)
    return rows.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(part).cast(_AMOUNT)).drop("filled", "open", "full", "spent", "sharing")


def leaf_budgets(leaves: DataFrame, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, domain_weights: dict[str, int] = DOMAIN_WEIGHTS, lang_weights: dict[str, int] = LANG_WEIGHTS, source_weights: dict[str, int] | None = None) -> DataFrame:
    """Budgets of (domain, lang, source, tokens) rows, one row per leaf. Weights are whole numbers
    of at least 1; what is not named weighs 1."""
    held = leaves.withColumn("capacity", (F.col("tokens") * max_epochs).cast(_AMOUNT)).where("capacity > 0")
    langs = held.groupBy("domain", "lang").agg(F.sum("capacity").cast(_AMOUNT).alias("capacity"))
    domains = langs.groupBy("domain").agg(F.sum("capacity").cast(_AMOUNT).alias("capacity"))
    root = held.agg(F.sum("tokens").alias("all_")).select(F.least(F.floor(F.col("all_") * F.lit(budget_share)), F.col("all_") * max_epochs).cast(_AMOUNT).alias("budget"))
    top = domains.crossJoin(F.broadcast(root)).withColumn("root", F.lit(0)).withColumn("weight", _weight(F.col("domain"), domain_weights).cast(_AMOUNT))
    top = share_out(top, ["root"], "domain").select("domain", "budget")
    middle = share_out(langs.join(top, "domain").withColumn("weight", _weight(F.col("lang"), lang_weights).cast(_AMOUNT)), ["domain"], "lang").select("domain", "lang", "budget")
    low = share_out(held.join(middle, ["domain", "lang"]).withColumn("weight", _weight(F.col("source"), source_weights or {}).cast(_AMOUNT)), ["domain", "lang"], "source")
    return low.select("domain", "lang", "source", "tokens", F.col("budget").cast("long").alias("budget"))


def _draw(seed: int, epoch: Column) -> Column:
    """The place of a document in an epoch's order, as hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("digest")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domains: dict[str, str] | None = None, domain_weights: dict[str, int] = DOMAIN_WEIGHTS, lang_weights: dict[str, int] = LANG_WEIGHTS, source_weights: dict[str, int] | None = None) -> DataFrame:
    """The mix: (doc_id, domain, lang, source, n_tokens, copies), documents taken at least once.

    Tokens are words. ``domains`` maps sources to domains; the weights are targets within a domain's,
    a language's and a source's parent. Null languages and sources form leaves named ''. Null and empty texts
    have no tokens and are never taken. Rows that repeat an id and a text are drawn apart as
    separate rows of the same place. Empty tables give no rows. Other columns are ignored."""
    n_tokens = F.size(F.filter(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[ \t-\r]+"), lambda w: w != "")).cast("long")
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), n_tokens.alias("n_tokens"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("digest"))
    rows = materialize(named.where("n_tokens > 0").withColumn("domain", domain_of(F.col("source"), domains)), "tokens")
    leaf = ["domain", "lang", "source"]
    budgets = materialize(leaf_budgets(rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")), budget_share, max_epochs, domain_weights, lang_weights, source_weights), "budgets")
    plan = budgets.withColumn("whole", F.expr("budget div tokens")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")).select(*leaf, "whole", "rest")
    placed = rows.join(plan, leaf).withColumn("place", _draw(seed, F.col("whole"))).withColumn("bucket", (F.conv(F.substring("place", 1, 3), 16, 10).cast("int") % BUCKETS))
    sums = placed.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("inside"))
    sums = sums.withColumn("before", F.coalesce(F.sum("inside").over(Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    seen = placed.join(sums, [*leaf, "bucket"])
    below = seen.where("before + inside <= rest").withColumn("more", F.lit(1))
    edge = seen.where("before + inside > rest and before <= rest")
    order = Window.partitionBy(*leaf, "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("total", F.col("before") + F.sum("n_tokens").over(order)).withColumn("more", F.when(F.col("total") <= F.col("rest"), 1).otherwise(0)).drop("total")
    beyond = seen.where("before > rest and whole > 0").withColumn("more", F.lit(0))
    chosen = below.unionByName(edge).unionByName(beyond).withColumn("copies", (F.col("whole") + F.col("more")).cast("long"))
    return chosen.where("copies > 0").select("doc_id", *leaf, "n_tokens", "copies")


def mix_sql(rel: str = "documents", budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    """The mix of a relation in DuckDB SQL, with the standard weights."""
    case = lambda col, weights: f"CASE {' '.join(f"WHEN {col} = '{k}' THEN {v}" for k, v in weights.items())} ELSE 1 END"

    def shared(rows: str, parent: str, child: str) -> str:
        key = f"PARTITION BY {parent} ORDER BY CAST(capacity AS DOUBLE) / weight, {child}"
        return f"""(SELECT * EXCLUDE (budget), CAST(CASE WHEN fills THEN capacity ELSE ((budget - spent) * weight) // sharing END AS HUGEINT) AS budget FROM (
            SELECT *, COALESCE(SUM(CASE WHEN fills THEN capacity END) OVER (PARTITION BY {parent}), 0) AS spent, SUM(CASE WHEN NOT fills THEN weight END) OVER (PARTITION BY {parent}) AS sharing FROM (
                SELECT *, capacity * left_open <= (budget - filled) * weight AS fills FROM (
                    SELECT *, COALESCE(SUM(capacity) OVER ({key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled, SUM(weight) OVER ({key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_open FROM ({rows})))))"""

    domains = "CASE " + " ".join(f"WHEN num % {len(DOMAINS)} = {i} THEN '{d}'" for i, d in enumerate(DOMAINS)) + f" ELSE '{DOMAINS[0]}' END"
    return f"""
    WITH raw AS (
        SELECT doc_id, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source, COALESCE(text, '') AS body,
            CAST(len(list_filter(regexp_split_to_array(COALESCE(text, ''), '[ \\t-\\r]+'), lambda w: w <> '')) AS BIGINT) AS n_tokens FROM {rel}),
    toks AS (
        SELECT doc_id, lang, source, n_tokens, md5(body) AS digest, {domains} AS domain
        FROM (SELECT *, TRY_CAST(right(regexp_extract(source, '([0-9]+)$', 1), 4) AS INTEGER) AS num FROM raw WHERE n_tokens > 0)),
    held AS (SELECT domain, lang, source, SUM(n_tokens) AS tokens, CAST(SUM(n_tokens) * {max_epochs} AS HUGEINT) AS capacity FROM toks GROUP BY ALL),
    langs AS (SELECT domain, lang, CAST(SUM(capacity) AS HUGEINT) AS capacity FROM held GROUP BY ALL),
    domains AS (SELECT domain, CAST(SUM(capacity) AS HUGEINT) AS capacity FROM langs GROUP BY ALL),
    root AS (SELECT CAST(LEAST(FLOOR(SUM(tokens) * CAST({budget_share} AS DOUBLE)), SUM(tokens) * {max_epochs}) AS HUGEINT) AS budget FROM held),
    top AS (SELECT domain, budget FROM {shared(f"SELECT domains.*, root.budget, 0 AS root, CAST({case('domain', DOMAIN_WEIGHTS)} AS HUGEINT) AS weight FROM domains, root", "root", "domain")}),
    middle AS (SELECT domain, lang, budget FROM {shared(f"SELECT langs.*, top.budget, CAST({case('lang', LANG_WEIGHTS)} AS HUGEINT) AS weight FROM langs JOIN top USING (domain)", "domain", "lang")}),
    leaves AS (SELECT domain, lang, source, tokens, budget FROM {shared("SELECT held.*, middle.budget, CAST(1 AS HUGEINT) AS weight FROM held JOIN middle USING (domain, lang)", "domain, lang", "source")}),
    plan AS (SELECT *, budget // tokens AS whole, budget % tokens AS rest FROM leaves),
    placed AS (SELECT toks.*, whole, rest, md5('{seed}:' || whole || ':' || COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || digest) AS place FROM toks JOIN plan USING (domain, lang, source)),
    summed AS (SELECT *, SUM(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM placed)
    SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN total <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
    FROM summed WHERE whole + CASE WHEN total <= rest THEN 1 ELSE 0 END > 0
    """
