"""Token counts of sections: whole documents are encoded once and tokens attributed by their spans.

Sections are spans of characters of a text; tokens get spans from their lengths in bytes (a byte-level vocabulary loses
nothing), and a sorted interval join gives each token to sections. Rule for a token that crosses a boundary: it counts for
the section that holds its first byte, and as ``crossing`` for it too; a token that begins outside every section counts for
none (``outside`` on no row; the document's total shows the difference).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import MODEL, encoder

FIELDS = "section long, start long, end long, tokens long, crossing long, doc_tokens long"


def lines_of(text: str) -> list[tuple[int, int]]:
    """The lines of a text as spans of characters, each with its line end; an empty text has none."""
    spans, at = [], 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end + 1
        spans.append((at, end))
        at = end
    return spans


def attribute(ids: np.ndarray, n_bytes: np.ndarray, text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each span; spans are in order and don't overlap."""
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum(n_bytes[ids])
    starts = ends - n_bytes[ids]
    if len(raw) == len(text):
        edge = np.array(spans, np.int64)
    else:
        of_char = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        edge = of_char[np.array(spans, np.int64)]
    first = np.searchsorted(starts, edge)  # tokens that begin before an edge
    over = np.searchsorted(ends, edge[:, 1], side="right")  # tokens that end up to the section's end
    return first[:, 1] - first[:, 0], first[:, 1] - np.maximum(np.minimum(over, first[:, 1]), first[:, 0])


def section_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", sections=lines_of, model: str = MODEL) -> DataFrame:  # noqa: ANN001
    """One row for each section of each row's text: ``key, section`` (from 0)``, start, end`` (characters)``, tokens,
    crossing, doc_tokens``.

    sections: a function from a text to ordered, disjoint spans of characters. A text without sections (null or empty)
    gives no row. Repeated rows and null keys are counted like others. Memory: one batch of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            keys, columns = [], [[] for _ in range(6)]
            for k, value in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True):
                spans = sections(value) if value else []
                if not spans:
                    continue
                ids = np.frombuffer(enc.ids(value), "<u4")
                tokens, crossing = attribute(ids, enc.n_bytes(), value, spans)
                both = np.array(spans, np.int64)
                keys += [k] * len(spans)
                for c, x in zip(columns, (np.arange(len(spans)), both[:, 0], both[:, 1], tokens, crossing, np.full(len(spans), len(ids))), strict=True):
                    c.append(x)
            arrays = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(key).type), *arrays], [key, "section", "start", "end", "tokens", "crossing", "doc_tokens"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"`{key}` {kind}, {FIELDS}")
