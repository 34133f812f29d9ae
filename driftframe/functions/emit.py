"""A table function for SQL: lists of labels as rows, whatever else their table holds.

    SELECT * FROM emit_labels(TABLE(SELECT core, t, labels FROM steps) PARTITION BY core ORDER BY t)

The lists are the table's last column. A row is given for each label of a list: the other columns as they are, the label's
``position``, the ``label`` and whether it is the ``first`` time that the partition has it. The schema of the result follows
from that of the argument.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf


@udtf
class EmitLabels:
    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or not table.dataType.fields or not isinstance(table.dataType.fields[-1].dataType, T.ArrayType):
            raise ValueError("the argument is a table whose last column is a list")
        *kept, lists = table.dataType.fields
        taken = {"position", "label", "first"} & {f.name.lower() for f in kept}
        if taken:
            raise ValueError(f"columns {sorted(taken)} are given by the function")
        more = [T.StructField("position", T.IntegerType()), T.StructField("label", lists.dataType.elementType), T.StructField("first", T.BooleanType())]
        return AnalyzeResult(T.StructType([*kept, *more]))

    def __init__(self) -> None:
        self.seen: set = set()  # of one partition

    def eval(self, row: T.Row) -> Iterator[tuple]:
        *kept, labels = row
        for i, label in enumerate(labels or []):
            first = label not in self.seen
            self.seen.add(label)
            yield *kept, i, label, first


def register(spark: SparkSession) -> None:
    spark.udtf.register("emit_labels", EmitLabels)
