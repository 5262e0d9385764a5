"""Lengths of texts in tokens of a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: A byte-level BPE vocabulary as ranks, and the pattern that cuts a text into pieces before merging.
TOKENIZER = os.environ.get("LISTENLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the published pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space that the pattern's look-ahead can't take; cut out where it would cut them.
_LONG_SPACE = re.compile(r"[^\S\x1c-\x1f]{4000,}")


@lru_cache(maxsize=4)
def encoder(path: str = TOKENIZER):
    """The tokenizer of the file; loaded once per process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of ``text``; 0 for null and empty. Strings of special tokens are ordinary text."""
    if not isinstance(text, str) or not text:
        return 0
    enc, total, at = encoder(path), 0, 0
    for run in _LONG_SPACE.finditer(text) if len(text) > 4000 else ():
        stop = run.end() - 1 if run.end() < len(text) else run.end()  # the last one may belong to what follows
        total += len(enc.encode_ordinary(text[at : run.start()]))
        total += len(enc._core_bpe.encode_single_piece(text[run.start() : stop].encode()))
        at = stop
    return total + len(enc.encode_ordinary(text[at:]))


def with_token_counts(documents: DataFrame, text: str = "text", name: str = "n_tokens", path: str = TOKENIZER) -> DataFrame:
    """``documents`` without ``text`` and with ``name``, its length in tokens; whole texts count.

    Null and empty texts have 0 tokens. An existing column ``name`` is replaced.
    """
    rest = documents.drop(name).drop(text)
    schema = StructType([*rest.schema.fields, StructField(name, LongType())])
    taken = documents.select(*[F.col(f"`{c}`") for c in rest.columns], F.col(f"`{text}`").alias("__text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            counts = [token_count(t, path) for t in pdf["__text"]]
            yield pdf.drop(columns="__text").assign(**{name: pd.Series(counts, index=pdf.index, dtype="int64")})

    return taken.mapInPandas(run, schema)
