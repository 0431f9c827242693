"""Token counts with a public tokenizer read from a parameter path, and the sources of documents."""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
RANK_FILE = "byte_bpe_multi_50k.tiktoken"

#: An unbroken run of letters this long is encoded in slices: merging is quadratic in a run's length.
LONGEST_RUN = 5_000
_RUN = re.compile(r"[^\W\d_]{%d,}" % LONGEST_RUN)

OTHER = "other"


class TokenCounter:
    """Counts tokens of one text; loaded once per Python worker."""

    def __init__(self, directory: str = TOKENIZER_DIR, file: str = RANK_FILE):
        import tiktoken

        spec = importlib.util.spec_from_file_location("tokenizer_files", os.path.join(directory, "__init__.py"))
        files = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(files)
        with open(os.path.join(directory, file), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> int:
        if len(text) >= LONGEST_RUN and _RUN.search(text):
            return sum(len(self._encoding.encode_ordinary(p)) for p in _slices(text))
        return len(self._encoding.encode_ordinary(text))


def _slices(text: str) -> Iterator[str]:
    at = 0
    for m in _RUN.finditer(text):
        yield text[at : m.start()]
        for i in range(m.start(), m.end(), LONGEST_RUN):
            yield text[i : min(i + LONGEST_RUN, m.end())]
        at = m.end()
    yield text[at:]


def source_name(column: Column | str) -> Column:
    """One spelling per source: lower case, blanks at the ends removed, inner blanks and hyphens as ``_``."""
    column = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(column, r"\s+", " "))), "[ -]+", "_")


def count_tokens(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", directory: str = TOKENIZER_DIR, file: str = RANK_FILE
) -> DataFrame:
    """(id, queue, n_tokens); ``queue`` is the normalised source.  Null texts are no items and left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TokenCounter(directory, file)
        for batch in batches:
            sizes = [count(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["id", "queue", "n_tokens"]
            )

    narrow = documents.select(
        F.col(id_col).alias("id"), source_name("source").alias("queue"), F.col(text_col).alias("text")
    ).where("text is not null")
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, queue string, n_tokens bigint")
