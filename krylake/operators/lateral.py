"""Table functions over partitions of a table in their order."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def simplified(rows: DataFrame, key: str, order: str, value: str, least: float) -> DataFrame:
    """The rows of each key, in their order, that differ by `least` or more from the last one kept; the first is kept. Null values are passed over.

    Which row is kept depends on which was before: no window says that. The function sees a key's rows one after another and remembers one
    number, so a key of any size takes no memory; it is called through a table argument with PARTITION BY and ORDER BY.
    """
    types = dict(rows.dtypes)

    class Simplify:
        def __init__(self):
            self.last = None

        def eval(self, row):
            v = row[value]
            if v is not None and (self.last is None or abs(v - self.last) >= least):
                self.last = v
                yield row[key], row[order], v

    simplify = F.udtf(Simplify, returnType=f"`{key}` {types[key]}, `{order}` {types[order]}, `{value}` {types[value]}")
    return simplify(rows.select(key, order, value).asTable().partitionBy(key).orderBy(order))
