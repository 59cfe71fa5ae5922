"""Sizes of texts in tokens of a public byte-level BPE vocabulary.

The vocabulary file (a parameter; nothing is copied into the package) is read on
the driver and travels to the executors with the function, under 1 MB.  A text is
cut into chunks of whitespace and the word behind it; no token of this vocabulary
spans two chunks, so a chunk's size is looked up once per worker and reused, and
only chunks not seen before are encoded.  Counts are exact over whole texts.
"""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the vocabulary's own rule for cutting text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Chunks a worker remembers.
MEMORY = 400_000
#: Control characters Python's ``\s`` takes for whitespace and the vocabulary's rule doesn't.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_CHUNKS = re.compile(r"\s*\S+|\s+\Z")


def default_vocabulary() -> str:
    return os.environ.get("PAPERLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _counter(vocabulary: bytes):
    """The counting function of this worker process, made once and kept while the worker lives."""
    import base64
    import sys

    kept = sys.__dict__.setdefault("_paperloom_counters", {})
    key = hash(vocabulary)
    if key not in kept:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        encode = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        memory: dict[str, int] = {}

        def count(text: str) -> int:
            if _ODD_SPACE.search(text):
                return len(encode(text))
            chunks = _CHUNKS.findall(text)
            try:
                return sum(map(memory.__getitem__, chunks))
            except KeyError:
                pass
            total = 0
            for chunk in chunks:
                n = memory.get(chunk)
                if n is None:
                    n = len(encode(chunk))
                    if len(chunk) < 64 and len(memory) < MEMORY:
                        memory[chunk] = n
                total += n
            return total

        kept[key] = count
    return kept[key]


def token_count(text: Column, vocabulary: str | None = None) -> Column:
    """Tokens of ``text`` as BIGINT; a null text has none, like an empty one."""
    with open(vocabulary or default_vocabulary(), "rb") as file:
        ranks = file.read()

    @F.pandas_udf("bigint")
    def sizes(texts: pd.Series) -> pd.Series:
        count = _counter(ranks)
        return texts.map(lambda t: count(t) if t else 0).astype("int64")

    return sizes(text)
