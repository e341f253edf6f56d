"""Table functions for SQL: extraction as a LATERAL join.

    register(spark)
    spark.sql("select d.doc_id, p.* from documents d, lateral extract_people(d.text) p")
    spark.sql("select * from quotes(table(said) partition by doc_id order by (at), 'content', 'needle')")
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SkipRestOfInputTableException

from .text import EMAIL, MENTION


@udtf(returnType="name string, entity_type string, confidence double, value string")
class ExtractPeople:
    """functions.text.people for one text, a row for each person."""

    def __init__(self):
        self.mail, self.mention = re.compile(EMAIL), re.compile(MENTION)

    def eval(self, text: str) -> Iterator[tuple]:
        said = text or ""
        for found, sure in ((self.mail.findall(said), 0.7), (self.mention.findall(said), 0.6)):
            seen = set()
            for value in found:
                if value.lower() not in seen:
                    seen.add(value.lower())
                    yield (re.sub("[._-]", " ", value.split("@")[0]) if sure == 0.7 else value), "person", sure, value


@udtf
class Quotes:
    """For each partition of a table the first row in its order whose text holds its needle (any case): the partition's columns'
    values aren't repeated; number is the row's place, quote the text from the needle on."""

    def __init__(self):
        self.number = 0

    @staticmethod
    def analyze(table: AnalyzeArgument, text: AnalyzeArgument, needle: AnalyzeArgument) -> AnalyzeResult:
        columns = {f.name: f.dataType for f in table.dataType.fields}
        for name in (text.value, needle.value):
            if not isinstance(columns.get(name), T.StringType):
                raise ValueError(f"the table has no text column {name!r}")
        kept = [f for f in table.dataType.fields if f.name not in (text.value, needle.value)]
        out = T.StructType([*kept, T.StructField("number", T.LongType()), T.StructField("quote", T.StringType())])
        return AnalyzeResult(schema=out)

    def eval(self, row, text: str, needle: str, width: int = 160) -> Iterator[tuple]:
        self.number += 1
        said, wanted = row[text] or "", row[needle] or ""
        at = said.lower().find(wanted.lower()) if wanted else -1
        if at >= 0:
            own = [row[name] for name in row.__fields__ if name not in (text, needle)]
            yield (*own, self.number, said[at : at + max(len(wanted), width)])
            raise SkipRestOfInputTableException("found")


def register(spark: SparkSession) -> None:
    spark.udtf.register("extract_people", ExtractPeople)
    spark.udtf.register("quotes", Quotes)
