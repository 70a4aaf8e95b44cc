"""Second-stage filters over vectors, and the figures they report."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import VECTOR_MODEL
from ..functions.vectors import dot, l2_normalize
from .ordering import running_total
from .vectors import centroid, seed_vectors, vector_or_null, vectors_for

DEFAULT_TAU = 0.38
MISSING = "missing-embedding"


def _decide(scored: DataFrame, score: Column, tau: float, reason: str) -> DataFrame:
    """Write score, keep flag and reason. Without a vector an older score stays as it is."""
    has = F.col("vector").isNotNull()
    old = F.col("ai_sem_sim") if "ai_sem_sim" in scored.columns else F.lit(None)
    return scored.withColumn("_score", score).withColumns(
        {
            "ai_sem_sim": F.when(has, F.col("_score")).otherwise(old.cast("double")),
            "ai_stage2_keep": F.when(has, (F.col("_score") >= tau).cast("int")),
            "ai_stage2_reason": F.when(has, reason).otherwise(MISSING),
        }
    ).drop("_score", "vector")


def centroid_filter(
    papers: DataFrame,
    emb: DataFrame,
    seeds: DataFrame,
    tau: float = DEFAULT_TAU,
    model: str | None = VECTOR_MODEL,
) -> DataFrame:
    """Keep papers whose vector is within ``tau`` of the seeds' centroid (inclusive).

    The centroid is one row and enters as a scalar subquery: the large side is read once, joined
    on its key, and scored in place.
    """
    center = centroid(seed_vectors(seeds, emb, model)).select("centroid").scalar()
    scored = vector_or_null(papers, emb, model).withColumn("_center", center)
    sim = dot(l2_normalize(F.col("vector")), F.col("_center"))
    return _decide(scored, sim, tau, f"centroid tau={tau}").drop("_center")


def classifier_filter(
    papers: DataFrame,
    emb: DataFrame,
    labels: DataFrame,
    tau: float = DEFAULT_TAU,
    model: str | None = VECTOR_MODEL,
    max_iter: int = 100,
    reg: float = 1.0,
) -> DataFrame:
    """Keep papers whose probability under a logistic regression on vectors reaches ``tau``.

    ``reg`` is the strength of the L2 penalty as a weight on the summed loss.
    """
    train = (
        vectors_for(labels, emb, model)
        .join(labels.select(F.col("id").alias("paper_id"), "label"), "paper_id")
        .select(array_to_vector("vector").alias("features"), F.col("label").cast("double"))
    )
    n = train.count()
    if n == 0:
        raise ValueError("no labelled paper has a vector")
    fitted = LogisticRegression(
        maxIter=max_iter, regParam=reg / n, elasticNetParam=0.0, standardization=False
    ).fit(train)
    probability = _probability(fitted, l2_normalize(F.col("vector")))
    return _decide(vector_or_null(papers, emb, model), probability, tau, f"logreg tau={tau}")


def _probability(fitted: LogisticRegressionModel, vector: Column) -> Column:
    """Probability of label 1 from the coefficients alone.

    The model's own transform would put the model, and with it the summary and the rows of its
    training, into every task, which need not be serialisable.
    """
    rows = fitted.coefficientMatrix.toArray().tolist()
    shift = fitted.interceptVector.toArray().tolist()
    margins = [dot(vector, F.lit(w)) + F.lit(b) for w, b in zip(rows, shift, strict=True)]
    if len(margins) == 1:
        return 1.0 / (1.0 + F.exp(-margins[0]))
    others = [F.exp(m - margins[1]) for i, m in enumerate(margins) if i != 1]
    return 1.0 / (1.0 + sum(others))


def similarity_stats(scored: DataFrame, score: str = "ai_sem_sim", exact: bool = True) -> DataFrame:
    """min, p10, median, p90, max with linear interpolation.

    The exact form counts equal values, sorts them over all tasks and reads six positions; the
    built-in exact percentile would hold every distinct value in one task.
    """
    sims = scored.where(F.col(score).isNotNull()).select(F.col(score).alias("s"))
    if not exact:
        q = F.percentile_approx("s", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), 10000)
        return sims.agg(
            F.min("s").alias("min"), q[0].alias("p10"), q[1].alias("median"), q[2].alias("p90"),
            F.max("s").alias("max"),
        )
    values = sims.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    placed = running_total(values, [F.col("s")], "n")
    last = placed.agg(F.max("upto") - 1).scalar()
    spots = {"p10": 0.1, "median": 0.5, "p90": 0.9}

    def at(p: float, side) -> Column:
        spot = side(F.lit(p) * F.col("_last"))
        holds = (spot < F.col("upto")) & (spot >= F.col("upto") - F.col("n"))
        return F.max(F.when(holds, F.col("s")))

    measures = [F.min("s").alias("min"), F.max("s").alias("max"), F.max("_last").alias("_last")]
    for name, p in spots.items():
        measures += [at(p, F.floor).alias(f"{name}_lo"), at(p, F.ceil).alias(f"{name}_hi")]
    row = placed.withColumn("_last", last).agg(*measures)

    def between(name: str, p: float) -> Column:
        pos = F.lit(p) * F.col("_last")
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return (lo + (hi - lo) * (pos - F.floor(pos))).alias(name)

    return row.select("min", *[between(n, p) for n, p in spots.items()], "max")


def stage_counts(papers: DataFrame) -> DataFrame:
    """Rows scanned, kept, rejected and undecided (a NULL flag counts as neither)."""
    flag = F.col("ai_stage2_keep")
    return papers.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(flag == 1).alias("kept"),
        F.count_if(flag == 0).alias("rejected"),
        F.count_if(flag.isNull()).alias("undecided"),
    )
