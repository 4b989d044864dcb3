"""Operator 3: a token budget spread over a domain-language-source tree.

Weights and budget go down the tree level by level.  Among siblings each child
gets its share by weight, but no more than its subtree can supply; what it
cannot use goes to its siblings by their weights, and reaches other branches
only once the whole branch is used up, as the parent's own allotment was
bounded by its subtree before.  The level of such a filling has a closed form on
siblings ordered by supply per weight, so a level is one window over node
totals; all amounts are integers and add up to the parent's exactly.

A leaf of s tokens with budget b takes b div s whole epochs and of the next one
the documents that come first in the order of a hash of (seed, epoch, doc_id),
cut at the token where the budget ends.  The cut is found digit by digit on sums
of hash prefixes, so a leaf with a third of all rows is never sorted in one task.

Defined results: null domain, language or source is a value of its own, shown
as an empty string; a document without words has no tokens and is not taken;
rows with equal ids have equal hashes and are ordered by their token counts; an
empty table gives no rows; other columns are ignored.  Only DataFrame
operations are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import saved
from .common import keep_ids

LEVELS = ("domain", "language", "source")
HASH_DIGITS = 12  # hexadecimal digits of the order hash
STEP = 2  # digits decided at a time: 256 sums per leaf
WORD = r"[^\x20\x09-\x0D]+"

#: Integer weights of the production query; a value that is not named has weight 1.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANGUAGE_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}


@dataclass(frozen=True)
class Plan:
    """Budget in per mille of all tokens, greatest number of epochs, seed, and weights by level."""

    budget_permille: int = 600
    max_epochs: int = 2
    seed: int = 7
    domains: tuple[tuple[str, int], ...] = tuple(DOMAIN_WEIGHTS.items())
    languages: tuple[tuple[str, int], ...] = tuple(LANGUAGE_WEIGHTS.items())
    sources: tuple[tuple[str, int], ...] = ()


def domain_of(source: str = "source") -> Column:
    """Domain of a source: its number modulo 4, ``d0`` without a number."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9]{1,9})", 1)
    return F.concat(F.lit("d"), F.coalesce(number.try_cast("long"), F.lit(0)) % 4)


def leaf_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, domain, language, source, n_tokens``: the narrow rows that everything else works on."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(
        "doc_id",
        domain_of().alias("domain"),
        F.coalesce("lang", F.lit("")).alias("language"),
        F.coalesce("source", F.lit("")).alias("source"),
        words.alias("n_tokens"),
    )


def order_hash(seed: int, epoch: Column) -> Column:
    """Hexadecimal digits that order a leaf's documents in one epoch."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, HASH_DIGITS)


def _weight(level: str, weights: tuple[tuple[str, int], ...]) -> Column:
    found = F.lit(1)
    for name, weight in weights:
        found = F.when(F.col(level) == name, weight).otherwise(found)
    return found.cast("decimal(19,0)")


def fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``budget`` to children with ``supply``, ``weight`` and their parent's ``given``.

    Ordered by supply per weight, a child is filled up if what is left, shared
    by weight with all later ones, covers its supply.  The others share the rest
    by weight; single tokens left by rounding go to the largest remainders.
    """
    # both keys of an order of fractions: supply / weight, then the name
    ratio = (F.col("supply") / F.col("weight")).cast("double")
    ordered = Window.partitionBy(*parent).orderBy("ratio", name)
    whole = Window.partitionBy(*parent)
    before = F.sum("supply").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    later = F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    placed = nodes.withColumn("ratio", ratio).withColumn("before", F.coalesce(before, F.lit(0))).withColumn("later", later)
    left = F.col("given") - F.col("before")
    placed = placed.withColumn("full", F.col("supply") * F.col("later") <= left * F.col("weight"))
    used = F.coalesce(F.sum(F.when(F.col("full"), F.col("supply"))).over(whole), F.lit(0))
    open_weight = F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole), F.lit(0))
    placed = placed.withColumn("rest", (F.col("given") - used).cast("decimal(19,0)")).withColumn("open", open_weight.cast("decimal(19,0)"))
    product = (F.col("rest") * F.col("weight")).cast("decimal(38,0)")
    share = F.when(F.col("full"), F.col("supply").cast("decimal(38,0)")).otherwise(F.floor((product - product % F.col("open")) / F.col("open")).cast("decimal(38,0)"))
    placed = placed.withColumn("share", share.cast("long")).withColumn("remainder", F.when(F.col("full"), F.lit(None)).otherwise((product % F.col("open")).cast("long")))
    missing = F.col("given") - F.sum("share").over(whole)
    rank = F.row_number().over(Window.partitionBy(*parent).orderBy(F.desc_nulls_last("remainder"), name))
    placed = placed.withColumn("missing", missing).withColumn("rank", rank)
    extra = F.when(~F.col("full") & (F.col("rank") <= F.col("missing")), 1).otherwise(0)
    return placed.withColumn("budget", (F.col("share") + extra).cast("long"))


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """``domain, language, source, tokens, budget`` of every leaf."""
    weights = dict(zip(LEVELS, (plan.domains, plan.languages, plan.sources), strict=True))
    tokens = leaves.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    granted = F.least(F.floor(F.sum("tokens") * plan.budget_permille / 1000), F.sum("tokens") * plan.max_epochs).cast("long")
    given = F.coalesce(tokens.agg(granted).scalar(), F.lit(0).cast("long"))
    supply = tokens.withColumn("supply", F.col("tokens") * plan.max_epochs).withColumn("root", F.lit(1))
    above, parent = None, ["root"]
    for level in LEVELS:
        key = [*parent, level]
        nodes = supply.groupBy(*key).agg(F.sum("supply").alias("supply"))
        nodes = nodes.withColumn("given", given) if above is None else nodes.join(above, parent)
        filled = fill(nodes.withColumn("weight", _weight(level, weights[level])), parent, level)
        above, parent = filled.select(*key, F.col("budget").alias("given")), key
    return tokens.join(above.drop("root"), list(LEVELS)).withColumnRenamed("given", "budget")


def cuts(rows: DataFrame, goals: DataFrame, plan: Plan) -> DataFrame:
    """Per leaf with a part of an epoch to take: the hash where its prefix ends and the tokens still wanted there.

    ``goals``: leaf, ``epoch``, ``rest`` (tokens to take in that epoch).  After
    each step the leaf's prefix is known to end inside one group of hashes.
    """
    key = list(LEVELS)
    state = goals.where("rest > 0").select(*key, "epoch", "rest", F.lit("").alias("prefix"))
    hashed = rows.join(state.select(*key, "epoch"), key).select(*key, "n_tokens", order_hash(plan.seed, F.col("epoch")).alias("h"))
    hashed = saved(hashed, "mixing-order")
    for digits in range(STEP, HASH_DIGITS + 1, STEP):
        inside = hashed.join(state.select(*key, "prefix"), key).where(F.col("h").startswith(F.col("prefix")))
        sums = inside.groupBy(*key, F.substring("h", 1, digits).alias("next")).agg(F.sum("n_tokens").alias("n"))
        up_to = F.sum("n").over(Window.partitionBy(*key).orderBy("next"))
        found = sums.withColumn("up_to", up_to).join(state, key).where((F.col("up_to") >= F.col("rest")) & (F.col("up_to") - F.col("n") < F.col("rest")))
        state = saved(found.select(*key, "epoch", (F.col("rest") - F.col("up_to") + F.col("n")).alias("rest"), F.col("next").alias("prefix")), "mixing-cut")
    return state


def select_tokens(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``doc_id, domain, language, source, epoch, n_tokens, taken``: what each document gives in each epoch."""
    key = list(LEVELS)
    rows = saved(leaf_rows(docs), "mixing-rows")
    goals = saved(budgets(rows, plan).select(*key, "budget", "tokens", F.floor(F.col("budget") / F.col("tokens")).cast("long").alias("epoch"), (F.col("budget") % F.col("tokens")).alias("rest")), "mixing-goals")
    ends = cuts(rows, goals, plan).select(*key, F.col("prefix").alias("end_hash"), F.col("rest").alias("end_rest"))
    placed = rows.where("n_tokens > 0").join(goals.join(ends, key, "left"), key)
    # whole epochs, then the one that is cut
    epochs = placed.select("doc_id", *key, "n_tokens", F.col("epoch").alias("last"), "end_hash", "end_rest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epoch"))).alias("epoch"))
    h = order_hash(plan.seed, F.col("epoch"))
    part = epochs.withColumn("h", F.when(F.col("epoch") == F.col("last"), h))
    sure = part.where(F.col("h").isNull() | (F.col("h") < F.col("end_hash"))).select("doc_id", *key, "epoch", "n_tokens", F.col("n_tokens").alias("taken"))
    # only documents with the very hash of the cut are ordered among themselves
    same = part.where(F.col("h") == F.col("end_hash"))
    ahead = F.sum("n_tokens").over(Window.partitionBy(*key, "epoch").orderBy("doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1))
    ended = same.withColumn("ahead", F.coalesce(ahead, F.lit(0))).where(F.col("ahead") < F.col("end_rest"))
    ended = ended.select("doc_id", *key, "epoch", "n_tokens", F.least("n_tokens", F.col("end_rest") - F.col("ahead")).alias("taken"))
    return sure.unionByName(ended)


def keep_selected(docs: DataFrame, plan: Plan = Plan(budget_permille=900, max_epochs=1)) -> DataFrame:
    """Documents of which the plan takes any token; rows and columns stay as they are."""
    return keep_ids(docs, select_tokens(docs, plan).select("doc_id").distinct())
