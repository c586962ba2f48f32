"""C entities as a table function for SQL: SELECT e.* FROM files, LATERAL c_entities(file, content) e."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

SCHEMA = "kind string, seq long, name string, scope string, role string, start_line int, end_line int"


@udtf(returnType=SCHEMA)
class CEntities:
    """What facts() says of one file, entities only."""

    def eval(self, file: str, content: bytes):
        from quarrygraph.functions.cfacts import facts

        for row in facts(file or "", bytes(content or b"")):
            if row[10] is None:
                yield row[1:8]


def register(spark: SparkSession, name: str = "c_entities") -> None:
    from ..sources.shipping import ship

    ship(spark)
    spark.udtf.register(name, CEntities)
