"""Operator 12: fill-in-middle texts, cut at token boundaries that a Roaring-style set selects."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from featurelens.llm.text import pack

MARKS = ("<P>", "<S>", "<M>")
SEED = 42
CUT_SHARE, SPM_SHARE = 50, 80      # percent of the documents that are cut; of those, percent with the suffix first
UNITS = ("tokens", "characters")
SPAN = 1 << 16                     # offsets that share a container
WORDS = SPAN // 64
BLOCK = 1 << 20


class BoundarySet:
    """Ascending offsets in containers of ``SPAN``: sorted array, bitmap or runs, whichever is smallest.

    ``select`` finds the container of a rank by its cumulative cardinality and the offset inside by its kind.
    """

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.containers: list[tuple[str, tuple[np.ndarray, ...]]] = []
        self.totals: list[int] = []
        self._open: tuple[int, list[np.ndarray]] | None = None

    def add(self, offsets: np.ndarray) -> None:
        """Append ascending offsets, all above those added before."""
        high = offsets >> 16
        starts = np.flatnonzero(np.diff(high, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(offsets)]):
            key, low = int(high[a]), (offsets[a:b] & (SPAN - 1)).astype(np.uint16)
            if self._open and self._open[0] == key:
                self._open[1].append(low)
            else:
                self.close()
                self._open = (key, [low])

    def close(self) -> None:
        """Finish the last container."""
        if not self._open:
            return
        key, parts = self._open
        low = np.concatenate(parts)
        breaks = np.flatnonzero(np.diff(low.astype(np.int32)) != 1)
        bytes_of = {"array": 2 * len(low), "bitmap": SPAN // 8, "runs": 4 * (len(breaks) + 1)}
        kind = min(bytes_of, key=bytes_of.get)
        if kind == "array":
            held = (low,)
        elif kind == "bitmap":
            bits = np.zeros(SPAN, bool)
            bits[low] = True
            words = np.packbits(bits, bitorder="little").view("<u8")
            held = (words, np.cumsum(np.bitwise_count(words), dtype=np.int64))
        else:
            first = low[np.concatenate(([0], breaks + 1))]
            lengths = np.diff(np.concatenate(([-1], breaks, [len(low) - 1])))
            held = (first, np.cumsum(lengths))
        self.keys.append(key)
        self.containers.append((kind, held))
        self.totals.append((self.totals[-1] if self.totals else 0) + len(low))
        self._open = None

    def __len__(self) -> int:
        return self.totals[-1] if self.totals else 0

    def select(self, rank: int) -> int:
        """The offset with ``rank`` smaller ones."""
        at = int(np.searchsorted(self.totals, rank, "right"))
        rank -= self.totals[at - 1] if at else 0
        kind, held = self.containers[at]
        if kind == "array":
            low = int(held[0][rank])
        elif kind == "bitmap":
            words, seen = held
            word = int(np.searchsorted(seen, rank, "right"))
            rank -= int(seen[word - 1]) if word else 0
            low = 64 * word + int(np.flatnonzero(np.unpackbits(words[word:word + 1].view(np.uint8), bitorder="little"))[rank])
        else:
            first, seen = held
            run = int(np.searchsorted(seen, rank, "right"))
            low = int(first[run]) + rank - (int(seen[run - 1]) if run else 0)
        return (self.keys[at] << 16) + low


def boundaries(text: bytes, unit: str = "tokens") -> BoundarySet:
    """Ends of all units of a UTF-8 text, in code points, found block by block.

    A token is a run of other characters with the white space before it; white space at the end is a token of its own.
    """
    found, before = BoundarySet(), 0
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, len(raw), BLOCK):
        block = raw[at:at + BLOCK + 1]
        space = (block == 32) | ((block >= 9) & (block <= 13))
        ahead = space[1:] if len(block) > BLOCK else np.append(space[1:], True)
        block, space = block[:BLOCK], space[:BLOCK]
        points = before + np.cumsum((block & 0xC0) != 0x80)
        if unit == "characters":
            found.add(np.arange(before + 1, int(points[-1]) + 1))
        else:
            found.add(points[~space & ahead])
            if at + BLOCK >= len(raw) and space[-1]:
                found.add(points[-1:])
        before = int(points[-1])
    found.close()
    return found


def draws(doc_id: Column, seed: int = SEED) -> Column:
    """Four unsigned 32-bit numbers from the SHA-256 of seed and id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)])


def _transform(unit: str, cut_share: int, spm_share: int, marks: Sequence[str]):
    p, s, m = marks

    @arrow_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def of(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        rows = []
        for raw, drawn in zip(texts, numbers):
            raw = raw.as_py() or b""
            h1, h2, h3, h4 = drawn.as_py()
            ends = boundaries(raw, unit)
            n, text = len(ends), raw.decode("utf-8", "replace")
            if not text or h3 % 100 >= cut_share or any(mark in text for mark in marks):
                rows.append((n, "plain", None, None, text))
                continue
            units = sorted((h1 % (n + 1), h2 % (n + 1)))
            a, b = (ends.select(u - 1) if u else 0 for u in units)
            prefix, middle, suffix = text[:a], text[a:b], text[b:]
            if h4 % 100 < spm_share:
                rows.append((n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"))
            else:
                rows.append((n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = list(zip(*rows)) or [()] * 5
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["n", "form", "prefix_chars", "middle_chars", "output"])
    return of


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "tokens", seed: int = SEED,
                   cut_share: int = CUT_SHARE, spm_share: int = SPM_SHARE, marks: Sequence[str] = MARKS) -> DataFrame:
    """Every row of ``docs`` as ``_row`` with ``n, form, prefix_chars, middle_chars, output``.

    A text of n units is cut after two drawn numbers of units into prefix, middle and suffix, written with a mark before each:
    suffix, prefix, middle (``spm``) or prefix, suffix, middle (``psm``). The draws depend on seed and id alone. A text that is empty,
    holds a mark or is not drawn stays as it is (``plain``, lengths null). Lengths are code points.

    The unit ends of a text form a ``BoundarySet``, in which both cuts are selected: memory is the text, its output and about
    two bytes for each unit. A null text is an empty one, a null id an empty id; rows that repeat an id share its draws, equal rows
    their result. An empty table gives no rows. Other columns are carried along whatever their names. No row leaves its task.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    rows = pack(docs)
    made = _transform(unit, cut_share, spm_share, tuple(marks))(F.col(f"_row.{text_col}").cast("binary"), draws(F.col(f"_row.{id_col}"), seed))
    return rows.withColumn("_made", made).select("_row", "_made.*")


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that an output was made from. No part holds a mark, so the first place of each mark is the one written."""
    p, s, m = marks

    def parts(text: Column, *at: str) -> list[Column]:
        out = []
        for mark in at:
            head = F.substring_index(text, mark, 1)
            out.append(head)
            text = F.substr(text, F.length(head) + F.lit(len(mark) + 1))
        return [*out, text]

    prefix, suffix, middle = parts(F.substr(output, F.lit(len(p) + 1)), s, m)
    last, first, inner = parts(F.substr(output, F.lit(len(s) + 1)), p, m)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(first, inner, last)).otherwise(output)
