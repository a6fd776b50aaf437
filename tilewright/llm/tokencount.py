"""Token counts of a document's parts (fields or sections) by offset mapping.

The parts are joined and encoded once as a whole, as a tokenizer would see the document; each token's character span is
then joined to the parts' intervals. A token that crosses a boundary is allocated by rule:

    most   to the part that has most of its bytes, the earlier one of equals (the default)
    first  to the part that has its first byte
    share  to all its parts, in proportion to its bytes in each

so a document's counts always add up to the count of the whole. Vocabularies are read from a path given by the caller
(byte-level BPE ranks, one base64 token and its rank to a line) and sent to the workers; nothing is trained.

Defined cases: a null document has no parts and no tokens; null and empty parts have none; special tokens' strings are
ordinary text; texts of any length are encoded whole, runs of white space of any length included; repeated rows count each; an
empty table gives an empty result. Only the column given is read, so others cannot clash.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import text_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the word pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that the pattern would take as one piece and whose matcher overflows on runs of a million; such pieces are encoded without it.
LONG_BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{100000,}")
RESULT = "struct<n_tokens:bigint,crossing:bigint,counts:array<double>>"
_LOADED: dict[int, tuple] = {}


def tokenizer(vocabulary: bytes) -> tuple:
    """The encoding, and each token's length in bytes; kept by the worker."""
    import tiktoken

    if (key := hash(vocabulary)) not in _LOADED:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            lengths[k] = len(token)
        _LOADED[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _LOADED[key]


def token_ends(text: str, vocabulary: bytes) -> np.ndarray:
    """Byte offsets behind each token of the whole text; tokens tile it."""
    encoding, lengths = tokenizer(vocabulary)
    ids, at = [], 0
    for run in LONG_BLANKS.finditer(text):
        stop = run.end() - (run.end() < len(text))  # the last one belongs to the piece that follows
        ids += encoding.encode_ordinary(text[at : run.start()]) + encoding._encode_single_piece(text[run.start() : stop].encode())
        at = stop
    ids += encoding.encode_ordinary(text[at:])
    return np.cumsum(lengths[np.array(ids, np.int64)])


def allocate(token_ends: np.ndarray, part_ends: np.ndarray, rule: str = "most") -> tuple[np.ndarray, int]:
    """Counts for each part, and how many tokens cross a boundary. Both offsets in bytes."""
    counts = np.zeros(len(part_ends))
    if not len(token_ends):
        return counts, 0
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(part_ends, starts, "right")
    last = np.searchsorted(part_ends, token_ends - 1, "right")
    inside = first == last
    counts += np.bincount(first[inside], minlength=len(counts))
    for a, b, i, j in zip(starts[~inside].tolist(), token_ends[~inside].tolist(), first[~inside].tolist(), last[~inside].tolist(), strict=True):
        if rule == "first":
            counts[i] += 1
            continue
        edges = np.clip(part_ends[i : j + 1], a, b)
        bytes_in = np.diff(np.concatenate([[a], edges]))
        if rule == "most":
            counts[i + int(bytes_in.argmax())] += 1
        elif rule == "share":
            counts[i : j + 1] += bytes_in / (b - a)
        else:
            raise ValueError(f"no rule {rule!r}: most, first or share")
    return counts, int((~inside).sum())


def lines_of(text: Column) -> Column:
    """A text's sections: its lines, each with the line breaks that follow it."""
    return F.split(text, r"(?<=\n)(?=[^\n])")


def counter(spark: SparkSession, vocabulary: str = VOCABULARY, rule: str = "most"):
    """A column function array<string> parts -> RESULT. The vocabulary file (a bounded table) is read by the driver."""
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    kind = pa.struct([("n_tokens", pa.int64()), ("crossing", pa.int64()), ("counts", pa.list_(pa.float64()))])
    text_batches(spark)

    @F.arrow_udf(RESULT)
    def counted(parts: pa.Array) -> pa.Array:
        rows = []
        for row in parts.to_pylist():
            texts = [x or "" for x in row or ()]
            ends = token_ends("".join(texts), shared.value)
            counts, crossing = allocate(ends, np.cumsum([len(x.encode()) for x in texts]), rule)
            rows.append({"n_tokens": len(ends), "crossing": crossing, "counts": counts})
        return pa.array(rows, kind)

    return counted
