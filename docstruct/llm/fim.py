"""Fill-in-the-middle transformation, cut by an indexable skip list.

A text is a sequence of units: code points, or what a pattern matches (words, lines). Two ranks,
drawn from a digest of the document's key, cut it into prefix, middle and suffix. Where a rank lies in
the text is read from a skip list over the units: its lanes are linked lists of ever fewer nodes,
and every link carries how many units and how many code points it skips. A descent from the highest
lane goes on while the units skipped do not pass the rank, and drops a lane when they would; it ends
at the rank exactly, and the code points it skipped are the place of the cut.

The parts are put together as ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle)
behind sentinels, or the text stays ``plain``. ``restored`` gives the text back from output and form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import without

# Sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

SEED = 1
#: Of 100 documents with units and without sentinels: how many are transformed, and how many of
#: those with the suffix first.
FIM_PERCENT = 90
SPM_PERCENT = 20
#: One node in so many is linked in the next lane as well.
FAN = 16
_CUTS = "units long, first long, second long"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def unit_lengths(text: str, unit: re.Pattern[str] | None) -> np.ndarray:
    """Code points of each unit. What a pattern leaves between two matches belongs to the one before,
    what precedes the first one to the first; a text without a match is one unit."""
    if unit is None:
        return np.ones(len(text), np.int64)
    starts = [m.start() for m in unit.finditer(text) if m.end() > m.start()]
    if not text:
        return np.empty(0, np.int64)
    return np.diff([0, *starts[1:], len(text)])


class SkipList:
    """Lanes over units; ``lanes[0]`` links every unit to the next one.

    Lane l holds the nodes of height l and more. Heights come from a digest of the node's number, so
    they are the same in every run. ``units[l][i]`` and ``points[l][i]`` are the widths of the i-th link of
    lane l, ``down[l][i]`` is the place of its start in the lane below.
    """

    def __init__(self, lengths: np.ndarray, fan: int = FAN):
        nodes = np.arange(len(lengths), dtype=np.uint64)
        height = (nodes + np.uint64(1)) * _MIX
        height ^= height >> np.uint64(29)
        self.units = [np.ones(len(lengths), np.int64)]
        self.points = [np.asarray(lengths, np.int64)]
        self.down: list[np.ndarray] = [nodes]
        step = 1
        while len(self.units[-1]) > 2 * fan:
            step *= fan
            # Nodes of the lane below, by number, that are high enough; the head always is.
            kept = np.flatnonzero(height % np.uint64(step) == 0)
            if not len(kept) or kept[0] != 0:
                kept = np.concatenate([[0], kept])
            if len(kept) == len(height):
                break
            self.units.append(np.add.reduceat(self.units[-1], kept))
            self.points.append(np.add.reduceat(self.points[-1], kept))
            self.down.append(kept)
            height = height[kept]

    def point(self, rank: int) -> int:
        """Code points before the unit of this rank; all of them at the number of units."""
        place, units, points = 0, 0, 0
        for lane in range(len(self.units) - 1, -1, -1):
            widths, far = self.units[lane], self.points[lane]
            while place < len(widths) and units + widths[place] <= rank:
                units += int(widths[place])
                points += int(far[place])
                place += 1
            if units == rank:
                break
            place = int(self.down[lane][place]) if lane else place
        return points


def cut_points(text: str | None, first: int, second: int, unit: re.Pattern[str] | None) -> tuple[int, int, int]:
    """Units of a text, and the code points before the two cuts that these digests choose."""
    lengths = unit_lengths(text or "", unit)
    n = len(lengths)
    low, high = sorted((first % (n + 1), second % (n + 1)))
    lanes = SkipList(lengths)
    return n, lanes.point(low), lanes.point(high)


def _draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a key; a null key counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9, 17, 25)]


def transform(
    docs: DataFrame,
    key: str = "doc_id",
    text_col: str = "text",
    unit: str | None = None,
    seed: int = SEED,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """Add ``n, form, prefix_chars, middle_chars, output`` to every row, replacing such columns.

    ``unit`` is a regular expression, see ``unit_lengths``; without it code points are units. A null
    text counts as empty. Empty texts and those that hold a sentinel are ``plain``: the output is the text and
    the two numbers are null. Rows are independent, so repeated rows get the same result and texts of
    any length are cut whole. An empty table gives an empty result.
    """
    pattern = re.compile(unit) if unit is not None else None

    @F.arrow_udf(_CUTS)
    def cuts(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, first, second in columns:
            found = [
                cut_points(t.as_py(), a, b, pattern)
                for t, a, b in zip(texts, first.to_pylist(), second.to_pylist())
            ]
            fields = list(zip(*found)) if found else [(), (), ()]
            yield pa.StructArray.from_arrays(
                [pa.array(f, pa.int64()) for f in fields], names=["units", "first", "second"]
            )

    kept = without(docs, "n", "form", "prefix_chars", "middle_chars", "output")
    named = kept.select(F.struct("*").alias("row"), docs[key].alias("key"), docs[text_col].alias("text"))
    h1, h2, h3, h4 = _draws(F.col("key"), seed)
    cut = named.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("cut", cuts("text", h1, h2))
    text, at = F.col("text"), F.col("cut")
    special = [F.contains(text, F.lit(s)) for s in (PREFIX, SUFFIX, MIDDLE)]
    plain = (text == "") | special[0] | special[1] | special[2] | (h3 % 100 >= fim_percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    start, size = at["first"], at["second"] - at["first"]
    prefix = F.substring(text, F.lit(1), start.cast("int"))
    middle = F.substring(text, (start + 1).cast("int"), size.cast("int"))
    suffix = F.substring(text, (at["second"] + 1).cast("int"), F.length(text))
    output = (
        F.when(F.col("form") == "plain", text)
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    out = cut.withColumn("form", form).withColumn("output", output)
    whole = F.col("form") == "plain"
    return out.select(
        "row.*",
        at["units"].alias("n"),
        "form",
        F.when(~whole, start).alias("prefix_chars"),
        F.when(~whole, size).alias("middle_chars"),
        "output",
    )


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of. No sentinel is in a transformed text, so the first ones count."""
    ends = F.instr(output, MIDDLE)
    middle = F.substring(output, ends + len(MIDDLE), F.length(output))

    def parts(one: str, two: str) -> tuple[Column, Column]:
        at = F.instr(output, two)
        return (
            F.substring(output, F.lit(len(one) + 1), at - len(one) - 1),
            F.substring(output, at + len(two), ends - at - len(two)),
        )

    prefix, suffix = parts(PREFIX, SUFFIX)
    suffix_first, prefix_second = parts(SUFFIX, PREFIX)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(prefix_second, middle, suffix_first))
        .otherwise(output)
    )
