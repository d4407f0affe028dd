"""Token counts by section, from offsets.

A document is encoded once, whole. The tokens' byte spans are then joined with the spans of the sections (lines of
fields), so that each token counts for exactly one section, also where it reaches over a boundary.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that parts a text before merging; a fixed value that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: How a token that reaches over a boundary is allotted: to the section of its first byte, or to that with most of its bytes (the earlier of equals).
RULES = ("first", "most")


def ranks(vocabulary: bytes) -> dict[bytes, int]:
    """The vocabulary's byte strings and their numbers."""
    return {base64.b64decode(token): int(number) for token, number in (line.split() for line in vocabulary.splitlines() if line)}


class Encoder:
    """Token spans of texts; built in each task from the vocabulary file's bytes."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        known = ranks(vocabulary)
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        self.sizes = np.zeros(max(known.values(), default=-1) + 1, np.int64)
        for token, number in known.items():
            self.sizes[number] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """Where each token of a whole text ends, in UTF-8 bytes."""
        return np.cumsum(self.sizes[self.encoding.encode_to_numpy(text, disallowed_special=())])


def allotted(ends: np.ndarray, starts: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section. ``starts``: where the sections begin, ascending from 0; empty sections share a start and get nothing."""
    begins = np.concatenate((np.zeros(1, np.int64), ends[:-1])) if len(ends) else ends
    # The last section that starts at or before a byte holds it.
    first, last = np.searchsorted(starts, begins, "right") - 1, np.searchsorted(starts, ends - 1, "right") - 1
    owner, across = first.copy(), np.flatnonzero(first != last)
    if rule == "most":
        for i in across:
            cuts = np.concatenate(([begins[i]], starts[first[i] + 1 : last[i] + 1], [ends[i]]))
            owner[i] = first[i] + int(np.diff(cuts).argmax())
    return np.bincount(owner, minlength=len(starts)), np.bincount(owner[across], minlength=len(starts))


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The starts of a text's lines in UTF-8 bytes and in code points; a line break belongs to the line that it ends. No text has one empty line."""
    lines = text.split("\n")
    chars = np.array([len(x) + 1 for x in lines])
    size = np.array([len(x.encode("utf-8", "surrogatepass")) + 1 for x in lines]) if not text.isascii() else chars
    start = lambda n: np.concatenate(([0], np.cumsum(n)[:-1]))
    return start(size), start(chars)


def _contents(spark: SparkSession, path: str) -> bytes:
    """A file's bytes: of the driver's own disk, or by Spark if the path names a file system."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as file:
        return file.read()


def section_tokens(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", fields: Sequence[str] = ("text",), vocabulary: str = VOCABULARY, pattern: str = PATTERN, rule: str = "first") -> DataFrame:
    """(id_col, field, section, start, end, n_tokens, n_crossing), one row for each line of each field.

    Fields are joined by a line break in the order given and encoded together; the break belongs to the field before it. start and end are code
    points in the joined text, end exclusive and with the line's break. A null field is an empty one and has one empty line. Every token
    counts once: the sum of n_tokens is the document's. Repeated rows and null ids stay as they are. The vocabulary goes
    to the tasks as a broadcast of the file's size, under a few MB.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    sent = spark.sparkContext.broadcast(_contents(spark, vocabulary))
    rows = docs.select(F.col(id_col).alias("id"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)])
    names = list(fields)
    longs = ("section", "start", "end", "n_tokens", "n_crossing")
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("field", T.StringType()), *[T.StructField(c, T.LongType()) for c in longs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value, pattern)
        for batch in batches:
            took, field, numbers = [], [], []
            for i, parts in enumerate(zip(*batch.columns[1:], strict=True)):
                texts = [p.as_py() for p in parts]
                whole = "\n".join(texts)
                bytes_at, chars_at = line_sections(whole)
                tokens, crossing = allotted(encoder.ends(whole), bytes_at, rule)
                per_field = [t.count("\n") + 1 for t in texts]
                took.append(np.full(len(bytes_at), i))
                field.append(np.repeat(np.arange(len(texts)), per_field))
                numbers.append(np.stack([np.concatenate([np.arange(n) for n in per_field]), chars_at, np.append(chars_at[1:], len(whole)), tokens, crossing]))
            if took:
                table = np.concatenate(numbers, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(took))), pa.array(names).take(pa.array(np.concatenate(field))), *[pa.array(table[k]) for k in range(len(longs))]], names=schema.names)

    return rows.mapInArrow(run, schema)
