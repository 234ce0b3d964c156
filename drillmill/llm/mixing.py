"""Mixing sources to target weights (problem 8): entropy balancing.

Each document gets a rate: the expected number of its uses. Rates stay as close to one as the constraints allow (smallest
relative entropy), so a rate is exp(lambda_source * tokens), clipped at the source's most repeats, and lambda solves the
convex dual: the rates' tokens must be the source's target. Newton steps run over all sources at once; each step is one
aggregation of the documents into a row per source, the only thing that reaches the driver. Rates become whole copies by a
threshold on a hash of the document; the threshold of each source is found by two histograms of tokens, so that the tokens
used miss the target by about one document.

The size of the mix is a parameter; by default it is the largest at which every source that has tokens meets its share, so
the scarcest source sets it. With `everything` it is that of all texts of the named sources, each taken once.
A source whose target can't be met is used as often as allowed, and the report says so.

Scale: tokens are counted once and kept in the shared checkpoint folder with id and source only; steps read that, and
shuffle a few partial sums. mix_targets is a fixed small table, checked before it is broadcast.

Defined results: texts that are NULL or have no tokens, and sources that no target names (NULL too), are not used; equal texts
are one text, under the smallest doc_id; no targets or no documents give an empty mix; weights are normalised if they don't sum to 1.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drillmill.llm.tokenizer import VOCABULARY, count_column
from drillmill.session import cut

MAX_TARGETS = 10_000
STEPS, TOLERANCE = 60, 1e-9
BINS = 1024
#: Exponents beyond it are 0 or above every cap.
LIMIT = 60.0


def read_targets(targets: DataFrame) -> list[dict]:
    rows = [r.asDict() for r in targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).limit(MAX_TARGETS + 1).collect()]
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets: they don't fit a broadcast")
    if len({r["source"] for r in rows}) < len(rows):
        raise ValueError("a source has two targets")
    total = sum(r["target_share"] for r in rows)
    return [{"source": r["source"], "share": r["target_share"] / total, "cap": max(0, int(r["max_repeats"] or 0))} for r in rows]


def token_table(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens of every text, written once.

    Texts that are the same word for word are one text, as it must not be used more often than allowed under several ids:
    the smallest doc_id stands for it. Tokens are counted before the texts are compared, so texts aren't shuffled.
    """
    # only the empty text has no tokens; a condition on the count would have it computed twice
    counted = documents.where(F.col("doc_id").isNotNull() & (F.col("text") != "")).select("doc_id", "source", F.xxhash64("text").alias("k1"), F.md5("text").alias("k2"), count_column(documents.sparkSession, "text", path).cast("long").alias("n_tokens"))
    return cut(counted.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("x")).select("x.*"))


def _with(df: DataFrame, settings: dict[str, dict]) -> DataFrame:
    """Adds each source's settings, by a broadcast of the (bounded) targets."""
    rows = [(s, *(float(v) for v in x.values())) for s, x in settings.items()]
    names = ["source", *next(iter(settings.values()))]
    table = df.sparkSession.createDataFrame(rows, ", ".join(f"{n} {'string' if n == 'source' else 'double'}" for n in names))
    return df.join(F.broadcast(table), "source")


def _rate():
    return F.least(F.col("cap"), F.exp(F.least(F.lit(LIMIT), F.greatest(F.lit(-LIMIT), F.col("tilt") * F.col("n_tokens") / F.col("scale")))))


def solve_rates(tokens: DataFrame, plan: dict[str, dict]) -> dict[str, float]:
    """source -> lambda (per mean document length), by safeguarded Newton steps on the dual, all sources at once."""
    lo = {s: -LIMIT * 4 for s in plan}
    hi = {s: LIMIT * 4 for s in plan}
    tilt = dict.fromkeys(plan, 0.0)
    left = set()
    for s, p in plan.items():
        if p["target"] >= p["cap"] * p["have"] * (1 - TOLERANCE):
            tilt[s] = LIMIT * 1e6  # every text as often as allowed
        elif p["target"] <= 0:
            tilt[s] = -LIMIT * 1e6
        else:
            left.add(s)
    for _ in range(STEPS):
        if not left:
            break
        now = _with(tokens, {s: {"tilt": tilt[s], "cap": plan[s]["cap"], "scale": plan[s]["scale"]} for s in left}).withColumn("w", _rate())
        slope = F.when(F.col("w") < F.col("cap"), F.col("w") * F.col("n_tokens") * F.col("n_tokens") / F.col("scale")).otherwise(0.0)
        for r in now.groupBy("source").agg(F.sum(F.col("w") * F.col("n_tokens")).alias("got"), F.sum(slope).alias("slope")).collect():
            s = r["source"]
            gap = r["got"] - plan[s]["target"]
            if abs(gap) <= max(0.5, TOLERANCE * plan[s]["target"]):
                left.discard(s)
                continue
            if gap > 0:
                hi[s] = tilt[s]
            else:
                lo[s] = tilt[s]
            step = tilt[s] - gap / r["slope"] if r["slope"] > 0 else math.inf
            tilt[s] = step if lo[s] < step < hi[s] else (lo[s] + hi[s]) / 2
            if hi[s] - lo[s] < 1e-12:
                left.discard(s)
    return tilt


def _thresholds(rated: DataFrame, plan: dict[str, dict]) -> dict[str, float]:
    """source -> t: a document gets one copy more than floor(rate) if u - fraction < t; found by two histograms of tokens."""
    low = dict.fromkeys(plan, -1.0)
    width = dict.fromkeys(plan, 2.0)
    base = {r["source"]: r["n"] for r in rated.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("whole")).alias("n")).collect()}
    for _ in range(3):
        binned = _with(rated, {s: {"low": low[s], "width": width[s]} for s in plan}).withColumn("bin", F.floor((F.col("key") - F.col("low")) / F.col("width") * BINS))
        sums: dict[str, dict[int, float]] = {s: {} for s in plan}
        # at most BINS rows a source: keys outside the stretch fall into two bins
        clipped = F.least(F.greatest(F.col("bin"), F.lit(-1)), F.lit(BINS))
        for r in binned.where("more").groupBy("source", clipped.alias("bin")).agg(F.sum("n_tokens").alias("n")).collect():
            sums[r["source"]][r["bin"]] = r["n"]
        for s, bins in sums.items():
            need, at = plan[s]["target"] - base.get(s, 0) - bins.get(-1, 0), 0
            while at < BINS and need >= bins.get(at, 0):
                need -= bins.get(at, 0)
                at += 1
            low[s] += width[s] / BINS * min(at, BINS)
            width[s] /= BINS
            if at >= BINS:
                width[s] = 1e-15
    return {s: low[s] for s in plan}


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, path: str = VOCABULARY, everything: bool = False) -> tuple[DataFrame, DataFrame]:
    """(copies: doc_id, source, n_tokens, copies of every used text; shares: the report by source)."""
    spark = documents.sparkSession
    wanted = read_targets(targets)
    named = F.broadcast(spark.createDataFrame([(w["source"],) for w in wanted], "source string"))
    tokens = token_table(documents.select("doc_id", "source", "text").join(named, "source", "left_semi"), path)
    have = {r["source"]: (r["n"], r["docs"]) for r in tokens.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect()}
    plan = {w["source"]: {"share": w["share"], "cap": w["cap"], "have": have.get(w["source"], (0, 0))[0], "docs": have.get(w["source"], (0, 0))[1]} for w in wanted}
    usable = {s: p for s, p in plan.items() if p["have"] * p["cap"] > 0}
    if everything:
        total_tokens = sum(p["have"] for p in plan.values())
    elif total_tokens is None:
        total_tokens = int(min((p["have"] * p["cap"] / p["share"] for p in usable.values()), default=0))
    for p in plan.values():
        p["target"] = min(p["share"] * total_tokens, p["have"] * p["cap"])
        p["scale"] = p["have"] / p["docs"] if p["docs"] else 1.0
    schema = "doc_id long, source string, n_tokens long, copies int"
    if usable:
        tilt = solve_rates(tokens, usable)
        rated = _with(tokens, {s: {"tilt": tilt[s], "cap": p["cap"], "scale": p["scale"]} for s, p in usable.items()}).withColumn("w", _rate())
        u = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 40)) / float(1 << 40)
        rated = rated.withColumn("whole", F.floor("w")).withColumn("key", u - (F.col("w") - F.col("whole"))).withColumn("more", F.col("whole") < F.col("cap"))
        limit = _thresholds(rated, usable)
        extra = F.when(F.col("more") & (F.col("key") < F.col("t")), 1).otherwise(0)
        copies = _with(rated, {s: {"t": limit[s]} for s in usable}).select("doc_id", "source", "n_tokens", (F.col("whole") + extra).cast("int").alias("copies")).where("copies > 0")
    else:
        copies = spark.createDataFrame([], schema)
    plans = spark.createDataFrame([(s, float(p["share"]), int(p["cap"]), int(p["have"]), float(p["target"])) for s, p in plan.items()], "source string, target_share double, max_repeats int, available_tokens long, target_tokens double")
    used = copies.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("texts"), F.max("copies").alias("most_copies"))
    joined = F.broadcast(plans).join(used, "source", "left").na.fill(0, ["tokens", "texts", "most_copies"])
    reached = F.round(F.coalesce(F.try_divide("tokens", F.sum("tokens").over(_all())), F.lit(0.0)), 6)
    shares = joined.withColumn("reached_share", reached).withColumn("met", F.abs(F.col("reached_share") - F.col("target_share")) <= 0.005)
    return copies, shares.select("source", "target_share", "reached_share", "met", "max_repeats", "most_copies", "texts", "tokens", "available_tokens")


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # over the report's rows, one per target


def mixed_rows(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens, copy_no: one row for each use of a text."""
    copies, _ = mix(documents, targets, total_tokens, path)
    return copies.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
