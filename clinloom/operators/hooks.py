"""plug an external tokenizer/encoder into a DataFrame.

The function is applied with ``mapInPandas`` (Arrow batches); the object it needs
(a tokenizer, a model) is built once per Python worker by ``factory`` and kept under a key
of its own for each call.
Use it only for per-row library code that has no Spark expression equivalent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from clinloom.operators.worker import fresh_key, resident


# Characters of text whose tokens are held as Python objects at a time.
PIECE_CHARS = 1 << 20


def text_pieces(pdf: pd.DataFrame, text: str, limit: int = PIECE_CHARS) -> Iterator[pd.DataFrame]:
    """The rows of ``pdf`` in order, in runs of about ``limit`` characters of ``text`` (one row at least)."""
    ends = np.cumsum([1 + len(t) if hasattr(t, "__len__") else 1 for t in pdf[text]])
    at = 0
    while at < len(pdf):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield pdf.iloc[at:end]
        at = end


def apply_tokenizer(df: DataFrame, text: str, factory: Callable[[], Callable[[str], list]],
                    out_col: str = "tokens", element_type: T.DataType = T.StringType()) -> DataFrame:
    """Add ``out_col`` = tokenizer(text) for every row, a bounded run of text at a time."""
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(element_type), True)])
    key = fresh_key()

    def run(batches):
        fn = resident(key, factory)
        for pdf in batches:
            for part in text_pieces(pdf, text):
                tokens = [None if t is None else list(fn(t)) for t in part[text]]
                yield part.assign(**{out_col: pd.Series(tokens, index=part.index, dtype=object)})

    return df.mapInPandas(run, schema)


def whitespace_tokenizer() -> Callable[[str], list]:
    """A trivial factory (``str.split``) used by tests and as an example."""
    return str.split


def apply_batches(df: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
                  schema: T.StructType | str) -> DataFrame:
    """a batched map -- ``fn(batch) -> batch`` on Arrow batches (``dataset.map(fn, batched=True)``).

    ``factory`` builds ``fn`` once per Python worker (load a model or tokenizer there).
    """
    key = fresh_key()

    def run(batches):
        fn = resident(key, factory)
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)


def char_count_batch() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Example batched function: characters per text, vectorised over the batch."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": pdf["doc_id"], "n_chars": pdf["text"].str.len().astype("int64")})
    return fn
