"""The four tools of the analysis service, over one table registered as a view."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessella.operators import profile
from tessella.plans.runner import CHART_TIMEOUT, TIMEOUT, Result, run, run_sql


class Tools:
    """``dataset_info``, ``statistics``, ``query`` and ``chart_data`` of ``df``; texts begin with "ERROR: " on failure."""

    def __init__(self, df: DataFrame, name: str = "df", order: str | None = None):
        self.df, self.spark, self.order = df, df.sparkSession, order or df.columns[0]
        df.createOrReplaceTempView(name)

    @staticmethod
    def _text(r: Result) -> str:
        return f"ERROR: {r.error}" if r.error else r.text

    def dataset_info(self) -> str:
        return profile.schema_card(self.df, self.order)

    def statistics(self) -> str:
        return self._text(run(lambda: profile.describe(self.df), self.spark, timeout=60))

    def query(self, sql: str) -> str:
        return self._text(run_sql(self.spark, sql, TIMEOUT, columns=set(self.df.columns)))

    def chart_data(self, sql: str) -> Result:
        """The rows a chart would be drawn from."""
        return run_sql(self.spark, sql, CHART_TIMEOUT, columns=set(self.df.columns))
