"""Least-squares polynomials as one-pass, map-side combinable aggregates."""

from pyspark.sql import functions as F

SCALE = 1000.0


def fit_polynomial(points, keys, x, y, origin=0.0, scale=SCALE, max_degree=2):
    """Fit ``y`` over ``x`` per group: a line below three points, else a parabola.

    Covariances of ``u = (x - origin) / scale`` and ``u * u`` are merged pairwise
    by Spark's own aggregates, so a hot group is combined map-side and never
    gathered, and no uncentred power sums lose digits. A single point or
    coinciding points have no fit: NULL coefficients.

    Returns ``keys, n, degree, c0, c1, c2`` with ``y = c0 + c1 u + c2 u^2``.
    """
    u = (F.col(x) - F.lit(float(origin))) / F.lit(float(scale))
    kept = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = (
        kept.select(*keys, u.alias("u"), F.col(y).cast("double").alias("v"))
        .withColumn("q", F.col("u") * F.col("u"))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.avg("u").alias("mu"), F.avg("q").alias("mq"), F.avg("v").alias("mv"),
            F.var_pop("u").alias("suu"), F.var_pop("q").alias("sqq"),
            F.covar_pop("u", "q").alias("suq"),
            F.covar_pop("u", "v").alias("suv"), F.covar_pop("q", "v").alias("sqv"),
        )
    )
    det = F.col("suu") * F.col("sqq") - F.col("suq") * F.col("suq")
    solvable = det > F.lit(1e-12) * F.col("suu") * F.col("sqq")
    degree = F.when(F.col("n") < 3, 1).otherwise(max_degree) if max_degree > 1 else F.lit(1)
    is_line = F.col("degree") == 1
    c1 = F.when(is_line, F.when(F.col("suu") > 0, F.col("suv") / F.col("suu"))).when(
        solvable, (F.col("suv") * F.col("sqq") - F.col("sqv") * F.col("suq")) / det)
    c2 = F.when(is_line, F.when(F.col("suu") > 0, F.lit(0.0))).when(
        solvable, (F.col("sqv") * F.col("suu") - F.col("suv") * F.col("suq")) / det)
    return (
        sums.withColumn("degree", degree).withColumn("c1", c1).withColumn("c2", c2)
        .select(*keys, "n", "degree",
                (F.col("mv") - F.col("c1") * F.col("mu") - F.col("c2") * F.col("mq")).alias("c0"),
                "c1", "c2")
    )


def evaluate(x, origin=0.0, scale=SCALE):
    """Value of the fitted polynomial at ``x``, from columns ``c0, c1, c2``."""
    u = (x - F.lit(float(origin))) / F.lit(float(scale))
    return F.col("c0") + u * (F.col("c1") + u * F.col("c2"))


def gram_basis(t, m, degree=4):
    """Discrete orthogonal polynomials on ``m`` equally spaced points centred at 0."""
    basis = [F.lit(1.0), t]
    for k in range(1, degree):
        beta = F.lit(float(k * k)) * (m * m - F.lit(float(k * k))) / F.lit(4.0 * (4 * k * k - 1))
        basis.append(t * basis[k] - beta * basis[k - 1])
    return basis
