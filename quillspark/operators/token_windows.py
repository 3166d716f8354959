"""Windows of a tokenizer's tokens over texts."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

_WINDOW = StructType().add("start", IntegerType()).add("tokens", IntegerType()).add("text", StringType())


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer  # an optional dependency

    return Tokenizer.from_file(path)


def token_windows(text: Column, tokenizer: str, size: int = 384, overlap: int = 64, most: int = 64) -> Column:
    """array of struct<start, tokens, text>: runs of ``size`` tokens of a text, each sharing ``overlap`` with the next.

    The last ends with the text.  ``most`` windows a text are the feature: a page's later
    windows are left out; pass None for all.  ``tokenizer`` is the path of its file.
    """
    step = size - overlap

    @F.pandas_udf(ArrayType(_WINDOW))
    def windows(texts: pd.Series) -> pd.Series:
        def cut(value: str | None) -> list[dict]:
            spans = _tokenizer(tokenizer).encode(value or "", add_special_tokens=False).offsets
            starts = range(0, max(1, len(spans) - overlap), step) if spans else ()
            out = [(s, spans[s : s + size]) for s in list(starts)[:most]]
            return [{"start": s, "tokens": len(w), "text": value[w[0][0] : w[-1][1]]} for s, w in out]

        return texts.map(cut)

    return windows(text)
