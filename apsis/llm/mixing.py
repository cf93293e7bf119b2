"""Mixing sources to target weights (operator 7) by iterative proportional fitting, in DataFrame functions only.

Token totals of (source, language, topic) cells are raked in turn to the three target marginals, no cell above its own
tokens; a cell's weight over its tokens is the rate at which its documents are sampled. A value whose target is more
than all its tokens is sampled whole, and the others share what it lacks in proportion to their targets. Only the cells, never documents, pass through the
iterations. Cells are bounded: sources beyond the max_sources largest share one margin called `other`, languages and
topics likewise, so the raked table has at most (max_sources + 1) * (max_langs + 1) * (max_topics + 1) rows. Every
document keeps its own row and its own draw. Documents meet the table of rates by a join that Spark turns into a broadcast
while that table is small; beyond it, adaptive execution splits the partitions of large cells.

Cases: null source, language, topic count as the value `none`; null or empty text has no tokens, and such a
document takes the probability of its cell, 0 if no document of the cell has tokens; repeated rows draw alike, since the draw hashes the id
and the seed; an empty table gives an empty result; extra columns are ignored (clashing names too).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MARGINS = ("source", "lang", "topic")


def surface_topic(text: Column) -> Column:
    """A topic of four from the surface of a text: table, markup, shouting or prose."""
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda marks: sum((F.length(text) - F.length(F.replace(text, F.lit(m), F.lit(""))) for m in marks), F.lit(0)) / size
    return F.when(share("|") > 0.02, "table").when(share("#*$%&") > 0.02, "markup").when((F.upper(text) == text) & (F.lower(text) != text), "shouting").otherwise("prose")


def token_count(text: Column) -> Column:
    """Words as tokens: runs of characters other than blanks."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("bigint")


def tempered(shares: DataFrame, exponent: float) -> DataFrame:
    """Target shares proportional to a power of the present ones: value, tokens, target."""
    raised = shares.select("value", "tokens", F.pow(F.col("tokens"), F.lit(exponent)).alias("_p"))
    return raised.select("value", "tokens", (F.col("_p") / F.sum("_p").over(Window.partitionBy())).alias("target"))


def _margin(cells: DataFrame, name: str, given: dict[str, float] | None, exponent: float) -> DataFrame:
    present = cells.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").cast("double").alias("tokens")).where("tokens > 0")
    if given is None:
        return tempered(present, exponent)
    lookup = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])
    # A value without a target keeps its present tokens' share of what the named targets leave.
    named = present.withColumn("_t", lookup[F.col("value")])
    rest = F.greatest(F.lit(1.0) - F.sum(F.coalesce("_t", F.lit(0.0))).over(Window.partitionBy()), F.lit(0.0))
    loose = F.when(F.col("_t").isNull(), F.col("tokens")).otherwise(0.0)
    share = F.coalesce("_t", rest * loose / F.nullif(F.sum(loose).over(Window.partitionBy()), F.lit(0.0)))
    unscaled = named.select("value", "tokens", share.alias("_s"))
    return unscaled.select("value", "tokens", (F.col("_s") / F.sum("_s").over(Window.partitionBy())).alias("target"))


def _scaled(rows: DataFrame, mass: str, cap: str, total: Column, *keys: str) -> DataFrame:
    """mass times, in each group of keys, the factor with which sum(least(cap, mass)) is total; where the caps hold less
    than that, one with which every cap is reached. With the first i rows at their caps the factor is
    (total - their caps) / (mass of the others), and the largest of these is the one that fits."""
    order = Window.partitionBy(*keys).orderBy((F.col(cap) / F.nullif(F.col(mass), F.lit(0.0))).asc_nulls_last())
    full = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum(mass).over(order.rowsBetween(0, Window.unboundedFollowing))
    tried = rows.withColumn("_factor", (total - full) / F.nullif(free, F.lit(0.0)))
    factor = F.greatest(F.coalesce(F.max("_factor").over(Window.partitionBy(*keys)), F.lit(0.0)), F.lit(0.0))
    return tried.withColumn("_factor", factor).withColumn(mass, F.col(mass) * F.col("_factor")).drop("_factor")


def within_reach(margin: DataFrame, total: Column) -> DataFrame:
    """margin: value, target, tokens. Adds goal: tokens to sample, together total, in proportion to the targets but never
    more than the value has; what a value lacks goes to the others."""
    capped = _scaled(margin.withColumn("goal", F.col("target")), "goal", "tokens", total)
    return capped.withColumn("goal", F.least("goal", "tokens"))


def rake(cells: DataFrame, goals: dict[str, DataFrame], iterations: int, tolerance: float = 1e-9, per_table: int = 4) -> DataFrame:
    """cells: source, lang, topic, tokens. Adds weight: tokens to sample, at most those of the cell, that meet the goals
    of the margins in turn. A cell at its bound keeps its factors, so that it can leave the bound again. Ends when every margin
    is within `tolerance` of its goal, when rounds no longer bring it nearer (then the cells' bounds do not allow the goals), or
    after `iterations` rounds. The cells are few by their bound: they stay in one partition, and the plan is cut by a written
    table every per_table rounds."""
    fitted = cells.withColumn("_cap", F.col("tokens").cast("double")).withColumn("weight", F.col("_cap"))
    for name in MARGINS:
        fitted = fitted.join(F.broadcast(goals[name].select(F.col("value").alias(name), F.col("goal").alias(f"_to_{name}"))), name, "left")
    done, before = 0, float("inf")
    while done < iterations:
        fitted = fitted.coalesce(1)
        for _ in range(min(per_table, iterations - done)):
            for name in MARGINS:
                fitted = _scaled(fitted, "weight", "_cap", F.coalesce(F.col(f"_to_{name}"), F.lit(0.0)), name)
        done += per_table
        fitted = materialize(fitted, "raked")
        now = residual(fitted)
        if now <= tolerance or now > 0.99 * before:
            break
        before = now
    return fitted.select(*MARGINS, "tokens", F.least("weight", "_cap").alias("weight"))


def residual(fitted: DataFrame) -> float:
    """The largest relative distance of a margin's weight from its goal, over the margins that have one."""
    off = None
    for name in MARGINS:
        held = fitted.groupBy(name).agg(F.sum(F.least("weight", "_cap")).alias("w"), F.max(f"_to_{name}").alias("g")).where("g > 0").select((F.abs(F.col("w") - F.col("g")) / F.col("g")).alias("off"))
        off = held if off is None else off.unionByName(held)
    return off.agg(F.max("off")).first()[0] or 0.0


@dataclass
class Mixer:
    """How documents are described and sampled. targets maps a margin to {value: share}; a margin without targets gets
    shares proportional to its present tokens to the power `exponent`. The sampled documents hold about keep * all
    tokens, or all that values with a target have; a probability is at most 1."""

    id_col: str = "doc_id"
    text_col: str = "text"
    source_col: str = "source"
    lang_col: str = "lang"
    topic: Column | None = None
    targets: dict[str, dict[str, float]] | None = None
    keep: float = 0.5
    exponent: float = 0.5
    iterations: int = 40  # at most; see rake
    seed: int = 7
    most: tuple[int, int, int] = (64, 16, 16)  # values with a margin of their own, by margin

    def described(self, docs: DataFrame, *kept: Column) -> DataFrame:
        text = F.coalesce(F.col(self.text_col), F.lit(""))
        topic = self.topic if self.topic is not None else surface_topic(text)
        value = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
        return docs.select(*kept, F.col(self.id_col).alias("_id"), value(F.col(self.source_col)).alias("source"), value(F.col(self.lang_col)).alias("lang"), value(topic).alias("topic"), token_count(text).alias("n_tokens"))

    def rates(self, rows: DataFrame) -> DataFrame:
        """Per (source, lang, topic) of described rows: probability."""
        totals = materialize(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "mixing-cells")
        pooled = totals
        for name, most in zip(MARGINS, self.most, strict=True):
            # The largest values of the margin; a value with a target always has a margin of its own.
            known = totals.groupBy(name).agg(F.sum("tokens").alias("_n")).orderBy(F.desc("_n"), name).limit(most).select(name, F.lit(True).alias("_known"))
            pooled = pooled.join(F.broadcast(known), name, "left")
            named = (self.targets or {}).get(name)
            own = F.col("_known") if named is None else F.coalesce("_known", F.lit(False)) | F.col(name).isin(list(named))
            pooled = pooled.withColumn(f"_{name}", F.when(F.coalesce(own, F.lit(False)), F.col(name)).otherwise("other")).drop("_known")
        cells = materialize(pooled.groupBy(*[F.col(f"_{m}").alias(m) for m in MARGINS]).agg(F.sum("tokens").alias("tokens")), "mixing-pooled")
        margins = {m: materialize(_margin(cells, m, (self.targets or {}).get(m), self.exponent), f"margin-{m}") for m in MARGINS}
        # The budget, or less if the values that have a target hold less.
        held = [margins[m].where("target > 0").agg(F.sum("tokens").alias("n")) for m in MARGINS]
        most = held[0].unionByName(held[1]).unionByName(held[2]).agg(F.min("n").alias("_most"))
        sums = cells.agg((F.sum("tokens") * F.lit(self.keep)).alias("_budget")).crossJoin(F.broadcast(most)).select(F.least("_budget", "_most").alias("_total"))
        goals = {m: materialize(within_reach(margins[m].crossJoin(F.broadcast(sums)), F.col("_total")), f"goals-{m}") for m in MARGINS}
        fitted = rake(cells, goals, self.iterations)
        raked = fitted.select(*[F.col(m).alias(f"_{m}") for m in MARGINS], F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") / F.col("tokens"))).otherwise(0.0).alias("probability"))
        by_cell = pooled.select(*MARGINS, *[f"_{m}" for m in MARGINS]).join(F.broadcast(raked), [f"_{m}" for m in MARGINS])
        return materialize(by_cell.select(*MARGINS, F.round("probability", 12).alias("probability")), "mixing-rates")

    def drawn(self) -> Column:
        return F.pmod(F.xxhash64("_id", F.lit(self.seed)), F.lit(1 << 40)) / float(1 << 40) < F.col("probability")


def mix(docs: DataFrame, mixer: Mixer | None = None) -> DataFrame:
    """Per document: id, source, lang, topic, n_tokens, probability and sampled."""
    mixer = mixer or Mixer()
    rows = materialize(mixer.described(docs), "mixing-rows")
    return rows.join(mixer.rates(rows), list(MARGINS)).select(F.col("_id").alias(mixer.id_col), *MARGINS, "n_tokens", "probability", mixer.drawn().alias("sampled"))


def sample(docs: DataFrame, mixer: Mixer | None = None) -> DataFrame:
    """The sampled rows of docs, with all their columns."""
    mixer = mixer or Mixer()
    rates = mixer.rates(materialize(mixer.described(docs), "mixing-rows"))
    rows = mixer.described(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return rows.join(rates, list(MARGINS)).where(mixer.drawn()).select("_row.*")


def achieved(mixed: DataFrame, mixer: Mixer | None = None) -> DataFrame:
    """What a mixture gives against what was asked: margin, value, target (share of tokens), expected (share of the sampled tokens by
    the documents' probabilities) and sampled (by the draws). mixed: the rows of mix. A value that has fewer tokens than
    its target asks for falls short of it. For margins whose values all have one of their own (none in `other`)."""
    mixer = mixer or Mixer()
    rows = mixed.select(*MARGINS, "n_tokens", (F.col("n_tokens") * F.col("probability")).alias("_e"), F.when(F.col("sampled"), F.col("n_tokens")).otherwise(0).alias("_s"))
    cells = materialize(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"), F.sum("_e").alias("_e"), F.sum("_s").alias("_s")), "mixing-achieved")
    out = None
    for name in MARGINS:
        asked = _margin(cells, name, (mixer.targets or {}).get(name), mixer.exponent).select("value", "target")
        ranked = cells.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").alias("tokens"), F.sum("_e").alias("_e"), F.sum("_s").alias("_s"))
        share = lambda c: (F.col(c) / F.nullif(F.sum(c).over(Window.partitionBy()), F.lit(0))).alias({"_e": "expected", "_s": "sampled"}[c])
        part = ranked.join(asked, "value", "left").select(F.lit(name).alias("margin"), "value", "target", share("_e"), share("_s"))
        out = part if out is None else out.unionByName(part)
    return out
