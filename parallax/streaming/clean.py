"""The stateless text chain on a streaming DataFrame.

The reference has no streams; what carries over is that the row-local operators
(P4-P10, P15-P20) hold no global state, so the same expressions clean text arriving as
files in a folder.  Positions are not assigned here: a stream has no global order, so the
key must come with the data (e.g. a line id column).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def clean_columns(df: DataFrame, cols: list[str], lang: str = "en") -> DataFrame:
    """strip non-printing -> normalise punctuation -> tokenize, column by column."""
    return df.withColumns({c: X.tokenize(X.normalize_punctuation(X.strip_nonprinting(c), lang)) for c in cols})


def clean_stream(spark: SparkSession, folder: str, schema: str, cols: list[str], lang: str = "en",
                 max_files: int | None = None) -> DataFrame:
    """A streaming frame over parquet files arriving in `folder`, cleaned and with `n_tokens_<col>`."""
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    out = clean_columns(reader.load(folder), cols, lang)
    return out.withColumns({f"n_tokens_{c}": X.n_tokens(F.col(c)) for c in cols})
