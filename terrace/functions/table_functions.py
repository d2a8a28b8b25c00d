"""Table functions for SQL whose output follows from their arguments."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import LongType, StringType, StructType


class Runs:
    """``runs(TABLE(t) PARTITION BY k ORDER BY (o), 'column', 'label', ...)``: stretches of rows with one value of ``column``.

    Gives run (from 1 in each partition), value, rows, and for each further column named
    its first value in the run, in its own type. A column that the table lacks is an error
    before anything runs. Null values are values. One run is held at a time.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument, *labels: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("runs: the first argument is a TABLE")
        fields = {f.name: f.dataType for f in table.dataType.fields}
        names = [x.value for x in (column, *labels)]
        for name in names:
            if name not in fields:
                raise ValueError(f"runs: the table has no column {name}")
        schema = StructType().add("run", LongType()).add("value", StringType()).add("rows", LongType())
        for name in names[1:]:
            schema = schema.add(f"first_{name}", fields[name])
        return AnalyzeResult(schema)

    def __init__(self):
        self.n, self.value, self.rows, self.first = 0, None, 0, ()

    def eval(self, row, column: str, *labels: str):
        value = None if row[column] is None else str(row[column])
        if self.rows and value == self.value:
            self.rows += 1
            return
        if self.rows:
            yield (self.n, self.value, self.rows, *self.first)
        self.n, self.value, self.rows, self.first = self.n + 1, value, 1, tuple(row[x] for x in labels)

    def terminate(self):
        if self.rows:
            yield (self.n, self.value, self.rows, *self.first)


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL of this session."""
    spark.udtf.register("runs", udtf(Runs))
