"""Fill-in-the-middle: a text is cut twice between units, and its middle moves to the end.

Where the cuts lie is asked of a wavelet matrix over the classes of the texts' characters. A class is three bits:
whether the character ends a word, is white space, is a line end. The matrix keeps one bit vector per level, each
ordered by the bits above it, and counts of ones up to each place. A rank query walks the levels and tells how many
characters of a class stand before a place. The ranks of all classes that end a unit add up to the number of units
that end before a place, and bisection on this sum finds the place of any cut.

One matrix holds the texts of a whole block of rows; both cuts of all its rows are bisected at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, text_of

# The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
LEVELS = 3
ENDS, BLANK, LINE = 4, 2, 1            # bits of a class, the highest first
# Classes whose characters end a unit.
UNITS = {
    "word": tuple(c for c in range(8) if c & ENDS),
    "line": tuple(c for c in range(8) if c & LINE),
}


def classes(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class of every character of texts that stand one after the other; ``ends`` is where each text ends.

    A word ends with its last character. White space behind the last word, or a text of white space, ends a unit too.
    """
    blank = np.isin(points, WHITE)
    last = np.zeros(len(points), dtype=bool)
    last[ends[ends > np.concatenate([[0], ends[:-1]])] - 1] = True
    before_blank = np.append(blank[1:], True)
    out = np.where(last | (~blank & before_blank), ENDS, 0) + np.where(blank, BLANK, 0) + np.where(points == 0x0A, LINE, 0)
    return out.astype(np.uint8)


class WaveletMatrix:
    """Ranks of symbols of ``LEVELS`` bits."""

    def __init__(self, symbols: np.ndarray):
        self.size, self.ones, self.zeros = len(symbols), [], []
        for level in range(LEVELS - 1, -1, -1):
            bits = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bits, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(self.size - self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])  # order within a bit stays

    def rank(self, symbol: int, place: np.ndarray) -> np.ndarray:
        """How many characters before each ``place`` have the class ``symbol``."""
        start, stop = np.zeros_like(place), place
        for i, level in enumerate(range(LEVELS - 1, -1, -1)):
            ones = self.ones[i]
            if symbol >> level & 1:
                start, stop = self.zeros[i] + ones[start], self.zeros[i] + ones[stop]
            else:
                start, stop = start - ones[start], stop - ones[stop]
        return stop - start

    def units(self, unit: str, place: np.ndarray) -> np.ndarray:
        """How many units end before each ``place``."""
        return sum(self.rank(symbol, place) for symbol in UNITS[unit])


def cut_places(texts: list[str], draws: np.ndarray, unit: str = "word") -> tuple[np.ndarray, np.ndarray]:
    """Units of each text, and the characters before each cut.

    ``draws`` has a row of numbers per text; each gives the cut after (number modulo units + 1) units. Cuts come in order.
    """
    joined = "".join(texts)
    ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
    begin = ends - np.array([len(x) for x in texts], dtype=np.int64)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    matrix = WaveletMatrix(classes(points, ends))
    before = matrix.units(unit, begin)
    n = matrix.units(unit, ends) - before
    wanted = np.sort(draws % (n + 1)[:, None], axis=1)
    low = np.repeat(begin[:, None], draws.shape[1], axis=1)      # the least place with that many units before it
    high = np.repeat(ends[:, None], draws.shape[1], axis=1)
    goal = wanted + before[:, None]
    while (low < high).any():
        middle = (low + high) // 2
        enough = matrix.units(unit, middle) >= goal
        high = np.where(enough, middle, high)
        low = np.where(enough, low, np.minimum(middle + 1, high))
    return n, low - begin[:, None]


def _cutter(unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                draws = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2")], axis=1)
                n, cuts = cut_places(part.column("text").to_pylist(), draws, unit)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("text"), part.column("form"), pa.array(n, pa.int64()),
                     pa.array(cuts[:, 0], pa.int32()), pa.array(cuts[:, 1], pa.int32())],
                    ["row", "text", "form", "n", "first", "second"])

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
                   seed: int = 42, percent: int = 50, spm_percent: int = 80, unit: str = "word") -> DataFrame:
    """``row`` (a struct of the columns ``keep``), ``n`` units, ``form``, ``prefix``, ``middle``, ``suffix`` and ``output``.

    A unit is a word with the white space before it, or the white space at the end (``word``); or a line with its line
    end (``line``; what stands behind the last one belongs to the last piece). Four numbers of 32 bits from the SHA-256 of
    ``seed:id`` decide: the first two the cuts, the third whether a text is cut at all (in ``percent`` of 100), the
    fourth the form: suffix first (``spm``) in ``spm_percent`` of 100, else prefix first (``psm``). A text that is empty or
    has one of the marks stays as it is (``plain``, with null parts).

    A null text counts as empty, a null id as an empty one. Equal ids are cut by equal numbers. Rows are worked on one by
    one, so ties, repeated rows and further columns make no difference; an empty table gives an empty result. Time and
    memory follow the length of a text, whatever it is.
    """
    text = text_of(F.col(f"`{text_col}`"))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text.alias("text"), F.sha2(key, 256).alias("hash"))
    number = [F.conv(F.substring("hash", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    whole = (F.col("text") == "") | F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = (F.when(whole | (number[2] % 100 >= percent), "plain").when(number[3] % 100 < spm_percent, "spm").otherwise("psm"))
    rows = rows.select("row", "text", form.alias("form"), number[0].alias("h1"), number[1].alias("h2"))
    kept = rows.schema["row"].dataType.simpleString()
    rows = rows.mapInArrow(_cutter(unit), f"row {kept}, text string, form string, n long, first int, second int")
    cut = F.col("form") != "plain"
    part = lambda a, b: F.when(cut, F.substr(F.col("text"), a + 1, b - a))
    rows = rows.withColumns({
        "prefix": part(F.lit(0), F.col("first")), "middle": part(F.col("first"), F.col("second")),
        "suffix": part(F.col("second"), F.length("text"))})
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select("row", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. No mark can arise where a part meets one, so the first of each is the right one."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", 4)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
