"""Statistics of whole texts, a block at a time: what the quality classifier and the quality rules look at."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, LOWER, NON_ALNUM, SAME, U64, Words, blocks, is_in, mix, window_hashes, within

#: Very common words of four languages.
COMMON_WORDS = "the of and to in is that for it was with as on be at by this are from or an which not have you de la el los las que y en un una se por con para no le les des et est dans du pour ce qui pas sur au der die das und den von zu mit sich ist im dem nicht ein eine auf als auch".split()
#: The marks that count as symbols.
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_digits", "n_marks", "n_bars", "n_cries", "n_wide", "n_common", "word_bytes")


def _among(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_LEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])
_TABLES = {
    "word_chars": ~BLANK & _LEAD,
    "n_symbols": _among(SYMBOLS),
    "n_chars": _LEAD,
    "n_upper": _among(bytes(range(65, 91))),
    "n_digits": _among(b"0123456789"),
    "n_marks": NON_ALNUM & ~BLANK,
    "n_bars": _among(b"|"),
    "n_cries": _among(b"!"),
    "n_wide": ~_LEAD,
    "word_bytes": ~BLANK,
}
_common: np.ndarray | None = None


def common_hashes() -> np.ndarray:
    global _common
    if _common is None:
        _common = np.sort(Words(pa.array([" ".join(COMMON_WORDS)]), NON_ALNUM, LOWER).hash)
    return _common


def repeated_words(words: Words, width: int = 8) -> np.ndarray:
    """Per row: words covered by windows of `width` words that occur twice or more in the row."""
    hashes = window_hashes(words.hash, width)
    starts = np.flatnonzero(within(words, width))
    key = mix(hashes[starts] + mix(words.row[starts].astype(U64) + U64(1)))
    order = np.argsort(key)
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    at = starts[order[same[1:] | same[:-1]]]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
    return np.diff(covered[words.first])


def count_block(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of every text."""
    words = Words(texts, BLANK, SAME)
    out = {"n_words": np.diff(words.first), "n_repeat_words": repeated_words(words)}
    for name, table in _TABLES.items():
        out[name] = np.diff(np.concatenate(([0], np.cumsum(table[words.data])))[words.offsets])
    plain = Words(texts, NON_ALNUM, LOWER)
    hit = np.concatenate(([0], np.cumsum(is_in(plain.hash, common_hashes()))))
    out["n_common"] = np.diff(hit[plain.first])
    data, lines, again = words.data.tobytes(), [], []
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        own = [x for x in data[a:b].split(b"\n") if x.strip()]
        lines.append(len(own))
        again.append(len(own) - len(set(own)))
    out["n_lines"], out["n_dup_lines"] = np.array(lines, np.int64), np.array(again, np.int64)
    return out


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """COUNTS per row of docs, beside its id (as `_id`); null text counts as empty. One pass over the texts, no shuffle."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "_text"):
                counts = count_block(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)], names=["_id", *COUNTS])

    return rows.mapInArrow(run, ", ".join([f"_id {dict(rows.dtypes)['_id']}", *(f"{c} bigint" for c in COUNTS)]))


FEATURES = ("size", "word_length", "symbols", "upper", "digits", "marks", "bars", "cries", "wide", "common", "dup_lines", "repeats", "line_words")


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """The FEATURES matrix: ratios that do not grow with a text, and its log size. Finite for empty texts."""
    c = {k: np.asarray(v, np.float64) for k, v in counts.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1), np.maximum(c["n_lines"], 1)
    root = lambda x: np.sqrt(np.clip(x, 0, None))
    return np.column_stack(
        [
            np.log1p(c["n_words"]), np.minimum(c["word_chars"] / words, 40), root(c["n_symbols"] / words), root(c["n_upper"] / chars), root(c["n_digits"] / chars),
            root(c["n_marks"] / chars), root(c["n_bars"] / words), root(c["n_cries"] / words), root(c["n_wide"] / chars), c["n_common"] / words,
            c["n_dup_lines"] / lines, c["n_repeat_words"] / words, np.log1p(c["n_words"] / lines),
        ]
    )
