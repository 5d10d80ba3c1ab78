"""Records of broken dumps put together by a polymorphic table function.

``SELECT * FROM assemble_records(TABLE(lines), starts, sep, fields)``: lines
has file, line and text. The function asks Spark for partitions by file in
order of line; how many columns it gives depends on its arguments. A line that
begins with one of starts begins a record, others go on; line breaks are
written as \\n in fields; records with another number of fields, and lines
before the first record, are dropped. Files are worked on side by side and
only a record is in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


@udtf
class AssembleRecords:
    def __init__(self):
        self.file, self.lines, self.record = None, [], 0
        self.sep, self.fields = "", 0

    @staticmethod
    def analyze(lines: AnalyzeArgument, starts: AnalyzeArgument, sep: AnalyzeArgument, fields: AnalyzeArgument) -> AnalyzeResult:
        if not lines.isTable:
            raise ValueError("the lines have to be a table")
        if not (starts.isConstantExpression and sep.isConstantExpression and fields.isConstantExpression):
            raise ValueError("starts, sep and fields have to be constants")
        schema = StructType().add("file", StringType()).add("record", IntegerType())
        for k in range(int(fields.value)):
            schema = schema.add(f"field{k + 1}", StringType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("file")], orderBy=[OrderingColumn("line")])

    def _closed(self):
        if self.lines:
            parts = "\n".join(self.lines).split(self.sep, self.fields - 1)
            if len(parts) == self.fields and self.sep not in parts[-1]:
                self.record += 1
                yield (self.file, self.record, *[p.replace("\n", "\\n") for p in parts])
        self.lines = []

    def eval(self, row, starts, sep, fields):
        self.file, self.sep, self.fields = row["file"], sep, fields
        text = row["text"] or ""
        if text.startswith(tuple(starts)):
            yield from self._closed()
            self.lines = [text]
        elif self.lines:
            self.lines.append(text)

    def terminate(self):
        yield from self._closed()


def assembled(spark: SparkSession, lines: DataFrame, starts: list[str], sep: str, fields: int) -> DataFrame:
    """file, record, field1, field2, ... of the records in lines (file, line, text)."""
    spark.udtf.register("assemble_records", AssembleRecords)
    listed = "array(" + ", ".join("'" + s.replace("'", "\\'") + "'" for s in starts) + ")"
    return spark.sql(f"SELECT * FROM assemble_records(TABLE({{lines}}), {listed}, :sep, {int(fields)})", args={"sep": sep}, lines=lines)
