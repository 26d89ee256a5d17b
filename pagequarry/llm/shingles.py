"""Word shingles as column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 5
#: Rows of a side that is sent to every executor; beyond it the join shuffles. For rows of a few numbers each.
SENT_ROWS = 500_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; null texts have none."""
    found = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(found, lambda w: w != "")


def none() -> Column:
    return F.expr("cast(array() as array<bigint>)")


def shingles(name: str, size: int = WORDS) -> Column:
    """Hashes of each `size` words in a row of the array column `name`; fewer words make none.

    It takes a name so that the words are worked out before, once for a row, and not once for each place.
    """
    found = F.col(name)
    many = F.transform(F.sequence(F.lit(0), F.size(found) - size), lambda i: F.xxhash64(*(F.get(found, i + k) for k in range(size))))
    return F.when(F.size(found) >= size, many).otherwise(none())


def own_shingles(name: str, size: int = WORDS) -> Column:
    """Like shingles(), but fewer words make one shingle of all of them."""
    out = F.when(F.size(name) >= size, shingles(name, size))
    for k in range(size - 1, 0, -1):
        out = out.when(F.size(name) == k, shingles(name, k))
    return out.otherwise(none())


def sent_if_small(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """df marked for a broadcast join if it has at most `rows` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
