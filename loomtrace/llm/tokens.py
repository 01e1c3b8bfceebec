"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the tokenizer files; a parameter, since they are not part of this package.
TOKENIZERS = os.environ.get("LOOMTRACE_TOKENIZERS", "/opt/tokenizers")
#: A byte-level BPE vocabulary of 50,256 ranks in ``tiktoken`` form.
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that splits text for this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, name: str = "n_tokens", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the number of tokens (BIGINT) of the whole of ``text`` in its place.

    A null or empty text has 0. A column that was called ``name`` is replaced.
    """
    keep = [c for c in df.columns if c not in (text, name)]
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, vocabulary)
        for b in batches:
            sizes = [len(e.encode_ordinary(t)) if t else 0 for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(sizes, pa.int64())], names=[*keep, name])

    return df.select(*keep, text).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{name}` bigint"]))
