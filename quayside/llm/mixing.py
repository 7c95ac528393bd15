"""Mixing the sources of a corpus to target weights, by soft membership of documents in domains.

The domains are the sources that a mix names; all other sources are one class. A classifier (multinomial naive Bayes
over the words of all labelled documents but a held-out tenth) gives posteriors, whose sharpness is calibrated on the held-out
tenth. The membership of a document is its posterior; where its source is stated, that is certain and the posterior is 1.
Projected-gradient least squares then fits a rate between 0 and max_repeats for every document, for all mixes at once,
so that the expected token totals by domain match the targets: each step is one distributed sum, and only the totals,
one number for each mix and domain, reach the driver. Documents with equal membership and rate are fitted as one row.

Rates become whole repeats: documents without a source by a threshold on a hash, after which the rates of the others are
fitted again to what is left; these take the whole part of their rate, and its fraction goes to the documents of smallest
hash until their tokens are used, found from a histogram, so that no group passes through one task.

Only documents with a non-empty text take part. The report gives for each mix and source the tokens reached and the residual
of the fit; a source is ``met`` within one percent of its target, ``short`` if its documents at max_repeats are too few,
``absent`` without any, else ``missed``. Null sources are unlabelled; such a document repeats at most as often as the strictest
of the domains allows to which it belongs with a probability of LIKELY or more. An empty corpus gives no rows and a report of
absent sources. Weights need not sum to 1: they are relative within a mix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quayside.llm.tokenizer import count_column, share_vocabulary
from quayside.operators.units import join_counted
from quayside.session import cut_lineage

#: Buckets of the histogram of document hashes.
HASH_BUCKETS = 4096
#: The class of labelled documents whose source no mix names.
OTHER = "\u0001other"
#: Relative error of a domain's tokens at which the fit ends; most steps, after which the residual is reported; steps between checkpoints.
CLOSE, MOST_STEPS, STEPS_WRITTEN = 1e-4, 200, 5
#: Share of labelled documents held out for calibration, as one in so many, and the temperatures that are tried.
HELD_OUT, TEMPERATURES = 10, (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 1e6)
#: Least probability of a domain whose cap an unlabelled document keeps.
LIKELY = 0.05
#: Passes that fill what long documents left open, and the share of the target that may stay open.
PASSES, OPEN = 4, 0.002


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def sized_documents(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens of the documents with a non-empty text, counted once and written down."""
    shared = share_vocabulary(documents.sparkSession, tokenizer, folder)
    some = documents.where("length(text) > 0")
    return cut_lineage(some.select("doc_id", "source", count_column(shared, F.col("text")).cast("long").alias("n_tokens")))


def domain_posteriors(documents: DataFrame, classes: list[str]) -> DataFrame:
    """(doc_id, posterior) of the unlabelled documents with text: calibrated probabilities in the order of ``classes``.

    ``documents`` has doc_id, text and source, which is one of ``classes`` or null.
    """
    k = len(classes)
    some = documents.where("length(text) > 0")
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(HELD_OUT)) == 0
    parts = some.select("doc_id", "source", (F.col("source").isNull() | held).alias("scored"), _words(F.col("text")).alias("words"))
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("source")).cast("int") - 1
    counts = parts.where("NOT scored").select(index.alias("class"), F.explode("words").alias("word")).groupBy("word").agg(*[F.count(F.when(F.col("class") == c, 1)).alias(f"n{c}") for c in range(k)])
    counts = cut_lineage(counts)
    totals = counts.agg(F.count("*").alias("words"), *[F.sum(f"n{c}").alias(f"t{c}") for c in range(k)]).first()
    docs = {r["class"]: r["count"] for r in parts.where("source IS NOT NULL").groupBy(index.alias("class")).count().collect()}
    unseen = [1.0 / ((totals[f"t{c}"] or 0) + totals["words"] + 1) for c in range(k)]
    gains = counts.select("word", *[F.log(F.col(f"n{c}") + 1.0).alias(f"g{c}") for c in range(k)])
    each = parts.where("scored").select("doc_id", F.explode("words").alias("word"))
    sums = join_counted(each, "word", gains, "doc_id").groupBy("doc_id").agg(F.count("*").alias("length"), *[F.sum(F.coalesce(f"g{c}", F.lit(0.0))).alias(f"g{c}") for c in range(k)])
    prior = [float(np.log((docs.get(c, 0) + 1) / (sum(docs.values()) + k))) for c in range(k)]
    evidence = F.array(*[F.coalesce(F.col(f"g{c}"), F.lit(0.0)) + F.coalesce("length", F.lit(0)) * float(np.log(unseen[c])) for c in range(k)])
    # few bytes but much work: a stated number of partitions is not coalesced
    scored = cut_lineage(parts.where("scored").select("doc_id", index.alias("class")).join(sums, "doc_id", "left").select("doc_id", "class", evidence.alias("evidence")).repartition(documents.sparkSession.sparkContext.defaultParallelism))

    def posterior(temperature: float) -> Column:
        score = F.zip_with("evidence", F.array(*[F.lit(p) for p in prior]), lambda e, p: e / temperature + p)
        top = F.transform(score, lambda x: F.exp(x - F.array_max(score)))
        return F.transform(top, lambda x: x / F.aggregate(top, F.lit(0.0), lambda a, y: a + y))

    # the temperature under which the held-out documents are likeliest
    likely = lambda t: F.avg(F.log(F.greatest(F.get(posterior(t), F.col("class")), F.lit(1e-300))))
    fits = scored.where("class IS NOT NULL").agg(*[likely(t).alias(f"t{j}") for j, t in enumerate(TEMPERATURES)]).first()
    best = max(range(len(TEMPERATURES)), key=lambda j: fits[j] if fits[j] is not None else -j)
    return scored.where("class IS NULL").select("doc_id", posterior(TEMPERATURES[best]).alias("posterior"))


class Mix:
    """One mix: goals in tokens, caps and shares in the order of the corpus' domains; a goal of nothing elsewhere."""

    def __init__(self, name: str, rows: list, domains: list[str], corpus: int) -> None:
        weight = sum(max(r["target_share"] or 0.0, 0.0) for r in rows) or 1.0
        self.name, self.size = name, (rows[0]["size_ratio"] or 0.0) * corpus
        self.named = [r["source"] for r in rows]
        self.shares = {r["source"]: max(r["target_share"] or 0.0, 0.0) / weight for r in rows}
        self.caps = {r["source"]: max(r["max_repeats"] or 0, 0) for r in rows}
        self.target = np.array([self.size * self.shares.get(d, 0.0) for d in domains])
        self.goal = self.target

    def bound(self, most: np.ndarray) -> None:
        """Goals no higher than ``most``: documents of uncertain source would else be repeated in vain for a short one."""
        self.goal = np.minimum(self.target, most)


def _moved(rate: Column, errors: list[dict[str, np.ndarray]]) -> Column:
    """The rate after steps against the errors of its mix and domains, each projected between nothing and the cap."""
    for step in errors:
        table = F.create_map(*[x for name, e in step.items() for x in (F.lit(name), F.array(*[F.lit(float(v)) for v in e]))])
        against = F.aggregate(F.zip_with("member", F.element_at(table, F.col("mix_name")), lambda m, e: m * e), F.lit(0.0), lambda a, x: a + x)
        rate = F.least(F.greatest(rate - against, F.lit(0.0)), F.col("cap"))
    return rate


def fit_rates(members: DataFrame, mixes: list[Mix], fixed: dict[str, np.ndarray] | None = None) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """(``members`` with their rate, tokens reached by mix and domain) by projected-gradient least squares.

    ``members`` holds mix_name, n_tokens, member (by domain) and cap. A step moves each rate against the errors of the
    document's domains, relative to all tokens of the domain, so that memberships of 1 converge at once. ``fixed`` are
    tokens that are in the mix anyhow. The fit ends when every domain is close to its goal or its documents are used up.
    """
    k = len(mixes[0].goal)
    sums = lambda df, w: {
        r["mix_name"]: np.array([r[f"d{d}"] or 0.0 for d in range(k)])
        for r in df.groupBy("mix_name").agg(*[F.sum(F.col("n_tokens") * F.col("member")[d] * w).alias(f"d{d}") for d in range(k)]).collect()
    }
    none = np.zeros(k)
    capacity, most = sums(members, F.lit(1.0)), sums(members, F.col("cap"))
    rates, errors, reached = members.withColumn("rate", F.lit(0.0)), [], {m.name: (fixed or {}).get(m.name, none) for m in mixes}
    for step in range(MOST_STEPS):
        gaps = {m.name: reached[m.name] - m.goal for m in mixes}
        full = {m.name: reached[m.name] - (fixed or {}).get(m.name, none) >= most.get(m.name, none) * (1 - CLOSE) for m in mixes}
        open_ = [(abs(gaps[m.name]) > CLOSE * m.goal) & (m.goal > 0) & ~((gaps[m.name] < 0) & full[m.name]) for m in mixes]
        if not any(o.any() for o in open_):
            break
        held = {m.name: capacity.get(m.name, none) for m in mixes}
        errors.append({name: np.divide(gap, held[name], out=np.zeros(k), where=held[name] > 0) for name, gap in gaps.items()})
        if len(errors) == STEPS_WRITTEN:
            rates, errors = cut_lineage(rates.withColumn("rate", _moved(F.col("rate"), errors))), []
        before = reached
        now = sums(rates, _moved(F.col("rate"), errors))
        reached = {m.name: now.get(m.name, none) + (fixed or {}).get(m.name, none) for m in mixes}
        if step and all(np.allclose(reached[m.name], before[m.name], rtol=1e-9, atol=1e-9) for m in mixes):
            break
    return cut_lineage(rates.withColumn("rate", _moved(F.col("rate"), errors))), reached


def _unit_hash(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40))


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents of each mix with their repeats, report of the shares reached).

    The mix has mix_name, doc_id, source, n_tokens, repeats (over 0); the report one row for each mix and source. The fit
    aims at no more of a domain than its stated documents can give.
    ``targets`` is a configuration table of a few rows for each mix and is read on the driver.
    """
    spark = documents.sparkSession
    wanted: dict[str, list] = {}
    for r in targets.dropna(subset=["mix_name", "source"]).orderBy("mix_name", "source").collect():
        wanted.setdefault(r["mix_name"], []).append(r)
    domains = sorted({r["source"] for rows in wanted.values() for r in rows})
    sized = sized_documents(documents, tokenizer, folder)
    report_schema = "mix_name string, source string, target_tokens double, target_share double, documents int, available_tokens long, max_repeats int, unlabelled_tokens double, residual double"
    if not wanted:
        nothing = sized.selectExpr("CAST(NULL AS STRING) AS mix_name", "doc_id", "source", "n_tokens", "0 AS repeats").where("false")
        return nothing, _report(spark.createDataFrame([], report_schema), nothing)
    # sources that no mix names are one class together
    classes = F.when(F.col("source").isin(domains), F.col("source")).when(F.col("source").isNotNull(), OTHER)
    posteriors = domain_posteriors(documents.select("doc_id", "text", classes.alias("source")), [*domains, OTHER])
    totals = {r["source"]: r for r in sized.groupBy(classes.alias("source")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    corpus = sum(int(r["tokens"]) for r in totals.values())
    mixes = [Mix(name, rows, domains, corpus) for name, rows in wanted.items()]
    for m in mixes:
        m.bound(np.array([float(totals[d]["tokens"]) * m.caps.get(d, 0) if d in totals else 0.0 for d in domains]))

    # one row for each mix and stated source, and one for each mix and unlabelled document
    one_hot = [(m.name, d, float(totals[d]["tokens"]), [1.0 if d == e else 0.0 for e in domains], float(m.caps[d])) for m in mixes for d in m.named if d in totals]
    stated = spark.createDataFrame(one_hot, "mix_name string, source string, n_tokens double, member array<double>, cap double")
    soft = sized.where("source IS NULL").select("doc_id", F.col("n_tokens").cast("double").alias("n_tokens")).join(posteriors, "doc_id")
    per_mix = []
    for m in mixes:
        inside = F.array(*[F.get("posterior", F.lit(k)) if d in m.caps else F.lit(0.0) for k, d in enumerate(domains)])
        cap = F.least(*[F.when(F.get("posterior", F.lit(k)) >= LIKELY, float(m.caps[d])) for k, d in enumerate(domains) if d in m.caps], F.lit(float(max(m.caps.values()))))
        per_mix.append(F.struct(F.lit(m.name).alias("mix_name"), inside.alias("member"), cap.alias("cap")))
    soft = soft.select("doc_id", "n_tokens", F.inline(F.array(*per_mix)))
    rated, _ = fit_rates(cut_lineage(stated.unionByName(soft, allowMissingColumns=True)), mixes)

    # unlabelled documents become whole repeats; the others are fitted again to what these leave
    chance = _unit_hash(F.col("mix_name"), F.col("doc_id")) < (F.col("rate") - F.floor("rate")) * (1 << 40)
    drawn = rated.where("doc_id IS NOT NULL").withColumn("repeats", (F.floor("rate") + chance.cast("int")).cast("int"))
    sums = drawn.groupBy("mix_name").agg(*[F.sum(F.col("n_tokens") * F.col("repeats") * F.col("member")[k]).alias(f"d{k}") for k in range(len(domains))]).collect()
    expected = {r["mix_name"]: np.array([r[f"d{k}"] or 0.0 for k in range(len(domains))]) for r in sums}
    refitted, reached = fit_rates(stated, mixes, expected)
    rates = {(r["mix_name"], r["source"]): r["rate"] for r in refitted.collect()}

    plans, reports = [], []
    for m in mixes:
        for k, d in enumerate(domains):
            if d not in m.caps:
                continue
            tokens, docs = (int(totals[d]["tokens"]), int(totals[d]["docs"])) if d in totals else (0, 0)
            rate = min(rates.get((m.name, d), 0.0), float(m.caps[d]))
            base = int(rate + 1e-9)
            plans.append((m.name, d, base, max(rate - base, 0.0) * tokens, float(m.goal[k])))
            reports.append((m.name, d, float(m.target[k]), m.shares[d], docs, tokens, m.caps[d], float(expected.get(m.name, np.zeros(len(domains)))[k]), float(reached[m.name][k] - m.target[k])))
    plan = spark.createDataFrame(plans, "mix_name string, source string, base int, remainder double, goal double")
    chosen = _draw(sized, plan)
    unlabelled = drawn.where("repeats > 0").select("mix_name", "doc_id", F.lit(None).cast("string").alias("source"), F.col("n_tokens").cast("long").alias("n_tokens"), "repeats")
    return chosen.unionByName(unlabelled), _report(spark.createDataFrame(reports, report_schema), chosen)


def _draw(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Every labelled document base times, and some once more until the remainder of their source and mix is used.

    Later passes fill what a long document left open with documents that are short against the gap, as long as more of
    a target is open than OPEN.
    """
    hashed = sized.where("source IS NOT NULL").join(F.broadcast(plan.drop("goal")), "source").withColumn("more", F.lit(0))
    gaps = plan.select("mix_name", "source", F.col("remainder").alias("gap"), F.lit(None).cast("double").alias("longest"))
    for k in range(PASSES):
        hashed = cut_lineage(_fill(hashed, gaps, k))
        used = hashed.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("more")).alias("used"), F.min(F.when(F.col("more") == 0, F.col("n_tokens"))).alias("least"))
        left = cut_lineage(plan.join(used, ["mix_name", "source"]).withColumn("gap", F.col("remainder") - F.col("used")))  # one row for each mix and source
        gaps = left.where((F.col("gap") > F.col("goal") * OPEN) & (F.col("least") <= F.col("gap"))).select("mix_name", "source", "gap", F.greatest(F.col("gap") / 4, F.col("least").cast("double")).alias("longest"))
        if gaps.isEmpty():
            break
    repeats = (F.col("base") + F.col("more")).cast("int").alias("repeats")
    return hashed.select("mix_name", "doc_id", "source", "n_tokens", repeats).where("repeats > 0")


def _fill(hashed: DataFrame, gaps: DataFrame, k: int) -> DataFrame:
    """Mark documents by rising hash, as long as their tokens stay within the gap.

    The threshold lies in the bucket of the hash histogram where the gap is passed; only the documents of that one
    bucket are ordered.
    """
    columns = hashed.columns
    free = hashed.join(F.broadcast(gaps), ["mix_name", "source"], "left")
    free = free.withColumn("u", F.when((F.col("more") == 0) & (F.col("gap") > 0) & (F.col("longest").isNull() | (F.col("n_tokens") <= F.col("longest"))), _unit_hash(F.col("mix_name"), F.col("doc_id"), F.lit(k))))
    free = free.withColumn("bucket", (F.col("u") / F.lit((1 << 40) // HASH_BUCKETS)).cast("int"))
    histogram = free.where("bucket IS NOT NULL").groupBy("mix_name", "source", "gap", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    running = F.sum("tokens").over(W.partitionBy("mix_name", "source").orderBy("bucket"))
    edges = (
        histogram.withColumn("upto", running).withColumn("before", F.col("upto") - F.col("tokens")).where("before <= gap AND upto > gap")
        .select("mix_name", "source", F.col("bucket").alias("edge"), "before")
    )
    placed = free.join(F.broadcast(edges), ["mix_name", "source"], "left")
    upto = F.col("before") + F.sum("n_tokens").over(W.partitionBy("mix_name", "source").orderBy("u", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    inside = placed.where("bucket = edge").withColumn("more", (upto <= F.col("gap")).cast("int"))
    below = F.col("bucket").isNotNull() & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge")))
    outside = placed.where("bucket IS NULL OR edge IS NULL OR bucket <> edge").withColumn("more", F.when(below, 1).otherwise(F.col("more")))
    return inside.select(columns).unionByName(outside.select(columns))


def _report(plan: DataFrame, chosen: DataFrame) -> DataFrame:
    sums = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    full = plan.join(sums, ["mix_name", "source"], "left").fillna(0, ["tokens", "most_repeats"])
    whole = F.sum(F.col("tokens")).over(W.partitionBy("mix_name"))
    soft = F.sum(F.col("tokens") + F.col("unlabelled_tokens")).over(W.partitionBy("mix_name"))
    reached = F.col("tokens") + F.col("unlabelled_tokens")
    status = (
        F.when(F.col("available_tokens") == 0, "absent")
        .when(F.abs(reached - F.col("target_tokens")) <= F.col("target_tokens") * 0.01, "met")
        .when(F.col("available_tokens") * F.col("max_repeats") + F.col("unlabelled_tokens") < F.col("target_tokens"), "short")
        .otherwise("missed")
    )
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return full.select(
        "mix_name", "source", F.round("target_share", 6).alias("target_share"), share(F.col("tokens"), whole).alias("actual_share"), share(reached, soft).alias("expected_share"),
        share(F.col("tokens") * F.col("target_share"), F.col("target_tokens")).alias("share_of_size"), F.round("target_tokens", 0).cast("long").alias("target_tokens"), "tokens",
        "documents", "available_tokens", "most_repeats", "max_repeats", F.round("residual", 1).alias("residual"), status.alias("status"),
    )
