"""The result of an estimator."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import distributions as D
from .design import Design, Term

COEF = "name string, b double, se double, stat double, p double, low double, high double"


@dataclass
class Fit:
    kind: str
    y: str
    terms: list[Term]
    b: np.ndarray
    v: np.ndarray
    n: int
    df: float | None = None  # None: normal inference
    stats: dict[str, float] = field(default_factory=dict)
    design: Design | None = None
    gamma: np.ndarray | None = None

    @property
    def names(self) -> list[str]:
        return [t.name for t in self.terms]

    def __getitem__(self, name: str) -> float:
        return float(self.b[self.names.index(name)])

    def se(self, name: str) -> float:
        k = self.names.index(name)
        return float(np.sqrt(self.v[k, k]))

    def _row(self, name: str, b: float, var: float, level: float) -> tuple:
        se = float(np.sqrt(max(var, 0)))
        if se == 0:
            return (name, float(b), se, None, None, None, None)
        stat = b / se
        if self.df is None:
            p, q = D.normal_two_sided(stat), D.NORMAL.inv_cdf(0.5 + level / 200)
        else:
            p, q = D.t_two_sided(stat, self.df), D.t_quantile(0.5 + level / 200, self.df)
        return (name, float(b), se, float(stat), float(p), float(b - q * se), float(b + q * se))

    def coefficients(self, spark: SparkSession, level: float = 95, contrasts: dict[str, dict[str, float]] | None = None, exponentiate: bool = False) -> DataFrame:
        """One row a coefficient, then one a contrast c'b."""
        rows = [self._row(n, self.b[k], self.v[k, k], level) for k, n in enumerate(self.names)]
        for name, parts in (contrasts or {}).items():
            c = np.array([parts.get(n, 0.0) for n in self.names])
            rows.append(self._row(name, c @ self.b, c @ self.v @ c, level))
        if exponentiate:
            e = lambda x: None if x is None else float(np.exp(x))
            rows = [(n, e(b), se * e(b), s, p, e(lo), e(hi)) for n, b, se, s, p, lo, hi in rows]
        return spark.createDataFrame(rows, COEF)

    def summary(self, spark: SparkSession) -> DataFrame:
        rows = [("n", float(self.n)), *((k, float(v)) for k, v in self.stats.items())]
        return spark.createDataFrame(rows, "stat string, value double")

    def wald(self, *names: str, value: float = 0.0) -> dict[str, float]:
        """Joint test that the named coefficients are ``value``."""
        at = [self.names.index(n) for n in names]
        d = self.b[at] - value
        chi2 = float(d @ np.linalg.solve(self.v[np.ix_(at, at)], d))
        q = len(at)
        if self.df is None:
            return {"chi2": chi2, "df": q, "p": D.chi2_upper(chi2, q)}
        return {"f": chi2 / q, "df": q, "df_resid": self.df, "p": D.f_upper(chi2 / q, q, self.df)}

    def xb(self) -> Column:
        out = F.lit(0.0)
        for t, b in zip(self.terms, self.b, strict=False):
            out = out + t.value() * float(b)
        return out


def predict(df: DataFrame, fit: Fit, new: str, kind: str = "xb") -> DataFrame:
    """Fitted values or residuals, null where a term is."""
    return df.withColumn(new, fit.xb() if kind == "xb" else F.col(fit.y) - fit.xb())
