"""Mock predictor: labels with seeded errors, the same for a cell wherever it is computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALAR_ERROR, LIST_ERROR = 0.12, 0.18
_LETTERS = "aeiotrs0"


def _unit(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1_000_003)) / 1_000_003.0


def perturb(cells: DataFrame, key: str = "source_file", seed: int = 0, scalar_error: float = SCALAR_ERROR, list_error: float = LIST_ERROR) -> DataFrame:
    """Scalars: NA, or one letter replaced; lists: an item dropped, a spurious one added; empty lists are [NA]."""
    s = F.lit(seed)
    r = _unit(s, F.col(key), F.col("field"), F.lit("r"))
    n = F.length("scalar")
    at = (F.pmod(F.xxhash64(s, F.col(key), F.col("field"), F.lit("at")), F.greatest(n, F.lit(1))) + 1).cast("int")
    letter = F.substr(F.lit(_LETTERS), (F.pmod(F.xxhash64(s, F.col(key), F.col("field"), F.lit("c")), F.lit(len(_LETTERS))) + 1).cast("int"), F.lit(1))
    slip = F.concat(F.substr("scalar", F.lit(1), at - 1), letter, F.substr("scalar", at + 1))
    scalar = F.when(r < 0.4 * scalar_error, "NA").when((r < scalar_error) & (n > 3), slip).otherwise(F.col("scalar"))
    drop = _unit(s, F.col(key), F.col("field"), F.lit("d")) < list_error
    which = F.pmod(F.xxhash64(s, F.col(key), F.col("field"), F.lit("w")), F.greatest(F.size("items"), F.lit(1)))
    fewer = F.when(drop & (F.size("items") > 1), F.filter("items", lambda x, i: i != which)).otherwise(F.col("items"))
    more = F.when(_unit(s, F.col(key), F.col("field"), F.lit("m")) < list_error / 2, F.concat(fewer, F.array(F.lit("spurious")))).otherwise(fewer)
    items = F.when(F.coalesce(F.size("items"), F.lit(0)) <= 0, F.array(F.lit("NA"))).otherwise(more)
    return cells.select(key, "field", "is_list", F.when(~F.col("is_list"), scalar).alias("scalar"), F.when(F.col("is_list"), items).alias("items"))


class MockPredictor:
    def __init__(self, seed: int = 0, scalar_error: float = SCALAR_ERROR, list_error: float = LIST_ERROR):
        self.settings = {"seed": seed, "scalar_error": scalar_error, "list_error": list_error}

    def predict(self, label_cells: DataFrame) -> DataFrame:
        return perturb(label_cells, **self.settings)
