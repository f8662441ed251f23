"""Scalers, caps and the quantile transform. All fitted numbers are exact."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions.numeric import clip_upper
from tabforge.operators.quantiles import fitted_quantiles
from tabforge.plans.base import Configured, setting

# Ends of the probability range before the normal inverse.
PROBABILITY_END = 1e-7

# Wichura's algorithm AS 241 for the inverse normal distribution.
AS241_CENTRE = (
    [3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3,
     1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
     3.3430575583588128105e4, 2.5090809287301226727e3],
    [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
     5.2264952788528545610e3],
)
AS241_MIDDLE = (
    [1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550,
     3.64784832476320460504, 1.27045825245236838258, 2.41780725177450611770e-1,
     2.27238449892691845833e-2, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
     1.05075007164441684324e-9],
)
AS241_TAIL = (
    [6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580,
     2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
     2.71155556874348757815e-5, 2.01033439929228813265e-7],
    [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
     2.04426310338993978564e-15],
)


def _ratio(pair, x: Column) -> Column:
    above, below = (
        reduce(lambda total, c: total * x + c, reversed(coefficients[:-1]), F.lit(coefficients[-1]))
        for coefficients in pair
    )
    return above / below


def probit_tail(p: Column) -> Column:
    return F.sqrt(-F.ln(F.least(p, 1 - p)))


def probit(p: Column, tail: Column | None = None) -> Column:
    """Inverse of the standard normal distribution function, good to 16 digits.

    ``tail`` may name a column that already holds ``probit_tail(p)``, which keeps
    the expression short.
    """
    tail = probit_tail(p) if tail is None else tail
    centred = p - 0.5
    outer = F.when(tail <= 5, _ratio(AS241_MIDDLE, tail - 1.6)).otherwise(
        _ratio(AS241_TAIL, tail - 5)
    )
    return F.when(
        F.abs(centred) <= 0.425,
        centred * _ratio(AS241_CENTRE, F.lit(0.180625) - centred * centred),
    ).otherwise(F.signum(centred) * outer)


class StdScaler(Configured, Estimator):
    """Centre on the mean, divide by the population standard deviation."""

    cols = setting("cols", "columns to scale")

    def _fit(self, df: DataFrame) -> "AffineModel":
        cols = self.get("cols")
        row = df.agg(
            *[F.avg(c).alias(f"mean_{c}") for c in cols],
            *[F.stddev_pop(c).alias(f"std_{c}") for c in cols],
        ).first()
        return AffineModel(
            centres={c: row[f"mean_{c}"] or 0.0 for c in cols},
            scales={c: row[f"std_{c}"] or 1.0 for c in cols},
        )


class IqrScaler(Configured, Estimator):
    """Centre on the median, divide by the interquartile range (by 1 if that is 0)."""

    cols = setting("cols", "columns to scale")

    def _fit(self, df: DataFrame) -> "AffineModel":
        found = fitted_quantiles(df, self.get("cols"), [0.25, 0.5, 0.75])
        known = {c: q or [0.0, 0.0, 0.0] for c, q in found.items()}
        return AffineModel(
            centres={c: q[1] for c, q in known.items()},
            scales={c: (q[2] - q[0]) or 1.0 for c, q in known.items()},
        )


class AffineModel(Configured, Model):
    centres = setting("centres", "number subtracted, per column")
    scales = setting("scales", "number divided by, per column")

    def _transform(self, df: DataFrame) -> DataFrame:
        scales = self.get("scales")
        return df.withColumns(
            {c: (F.col(c) - centre) / scales[c] for c, centre in self.get("centres").items()}
        )


class Winsorizer(Configured, Estimator):
    """Learn an upper quantile per column and clip to it. NULL stays NULL."""

    cols = setting("cols", "columns to clip")
    q = setting("q", "quantile that becomes the cap")
    defaults = {"q": 0.99}

    def _fit(self, df: DataFrame) -> "CapModel":
        found = fitted_quantiles(df, self.get("cols"), [self.get("q")])
        return CapModel(caps={c: q[0] for c, q in found.items() if q})


def percentile_caps(df: DataFrame, cols: list[str], q: float = 0.99) -> dict[str, float]:
    return Winsorizer(cols=cols, q=q).fit(df).get("caps")


class CapModel(Configured, Model):
    caps = setting("caps", "upper cap per column")

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: clip_upper(F.col(c), cap) for c, cap in self.get("caps").items()})


class QuantileNormal(Configured, Estimator):
    """Map values to their rank share, then to the normal distribution."""

    cols = setting("cols", "columns to map")
    n_quantiles = setting("n_quantiles", "reference quantiles, ends included")
    defaults = {"n_quantiles": 1000}

    def _fit(self, df: DataFrame) -> "QuantileNormalModel":
        cols = self.get("cols")
        most = df.agg(F.greatest(F.lit(2), *[F.count(c) for c in cols])).first()[0]
        n = min(self.get("n_quantiles"), most)
        shares = [i / (n - 1) for i in range(n)]
        return QuantileNormalModel(references=fitted_quantiles(df, cols, shares))


class QuantileNormalModel(Configured, Model):
    references = setting("references", "sorted reference quantiles per column")

    def _share(self, c: str) -> Column:
        """Rank share of a value, between 0 and 1, from its position ``_at_<column>``.

        A value equal to several references takes the middle of their ranks;
        between two references it is interpolated.
        """
        points = self.get("references")[c]
        distinct = sorted(set(points))
        first = {p: i for i, p in reversed(list(enumerate(points)))}
        last = {p: i for i, p in enumerate(points)}
        top = len(points) - 1

        def at(values: list[float], shift: int = 0) -> Column:
            literal = F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})")
            return F.get(literal, F.col(f"_at_{c}").cast("int") - 1 + shift)

        x, low, high = F.col(f"_x_{c}"), at(distinct), at(distinct, 1)
        from_rank, to_rank = at([last[p] for p in distinct]), at([first[p] for p in distinct], 1)
        middle = at([(first[p] + last[p]) / 2 for p in distinct])
        between = from_rank + (to_rank - from_rank) * (x - low) / (high - low)
        return (
            F.when(x <= distinct[0], 0.0)
            .when(x >= distinct[-1], 1.0)
            .when(x == low, middle / top)
            .when(x.isNotNull(), between / top)
        )

    def _transform(self, df: DataFrame) -> DataFrame:
        """All columns go through each step together, so that the plan stays short.

        The reference below a value is found by the Bucketizer's binary search.
        """
        references = self.get("references")
        cols = [c for c, points in references.items() if points]
        if not cols:
            return df
        low, high = F.lit(PROBABILITY_END), F.lit(1 - PROBABILITY_END)
        inf = float("inf")
        placed = Bucketizer(
            splitsArray=[[-inf, *sorted(set(references[c])), inf] for c in cols],
            inputCols=[f"_x_{c}" for c in cols], outputCols=[f"_at_{c}" for c in cols],
            handleInvalid="keep",
        ).transform(df.withColumns({f"_x_{c}": F.col(c).cast("double") for c in cols}))
        shares = placed.withColumns({f"_at_{c}": self._share(c) for c in cols})
        inside = shares.withColumns(
            {
                f"_at_{c}": F.when(
                    F.col(f"_at_{c}").isNotNull(),
                    F.greatest(low, F.least(high, F.col(f"_at_{c}"))),
                )
                for c in cols
            }
        )
        tails = inside.withColumns({f"_x_{c}": probit_tail(F.col(f"_at_{c}")) for c in cols})
        return tails.withColumns(
            {c: probit(F.col(f"_at_{c}"), F.col(f"_x_{c}")) for c in cols}
        ).drop(*[f"_at_{c}" for c in cols], *[f"_x_{c}" for c in cols])
