"""String literals over the lines of a file, without the file as one string.

Where a line begins (outside, or inside a literal with one of three quotes) decides where it ends, so a line is a map of
four states. Maps compose, and the map of all lines before a line is found over blocks of lines, blocks of blocks and the
rest, so no window holds more than a block's maps or one map for each of a file's largest blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUOTES = ("'", '"', "`")
#: Lines of a block, blocks of a large block; a map holds two bits for each state, the identity is 3 2 1 0.
BLOCK, SAME = 64, 0b11100100
_BODY = {q: f"[^{q}\\\\]*+(?:\\\\.[^{q}\\\\]*+)*+" for q in QUOTES}
_WHOLE = "|".join(f"{q}{_BODY[q]}{q}" for q in QUOTES)
_TOUCHED = "['\"`]"


def _open(text: Column) -> Column:
    """The state at the end of a text that begins outside: 0, or 1 to 3 for the quote of a literal that does not end."""
    mark = F.regexp_extract(text, f"(?s)^(?:[^'\"`]++|{_WHOLE})*+(['\"`])", 1)
    return F.when(mark == "", 0).otherwise(F.instr(F.lit("".join(QUOTES)), mark))


def _after(text: Column, quote: str) -> Column:
    """What follows the literal that a text begins inside of; null if it does not end there."""
    end = f"(?s)^{_BODY[quote]}{quote}"
    return F.when(text.rlike(end), F.regexp_replace(text, end, ""))


def quoteless(text: Column) -> Column:
    """Whether a text has no literals."""
    return ~(F.contains(text, F.lit("'")) | F.contains(text, F.lit('"')) | F.contains(text, F.lit("`")))


def line_map(text: Column) -> Column:
    """Where a line ends for each state that it can begin in, two bits each."""
    out = _open(text)
    for k, q in enumerate(QUOTES, 1):
        rest = _after(text, q)
        out = out + F.shiftleft(F.when(rest.isNull(), F.lit(k)).otherwise(_open(rest)), 2 * k)
    return F.when(text.rlike(_TOUCHED), out).otherwise(F.lit(SAME)).cast("int")


def composed(f: Column, g: Column) -> Column:
    """The map of f, then g."""
    out = F.lit(0)
    for s in range(4):
        middle = F.shiftright(f, 2 * s).bitwiseAND(3)
        out = out + F.call_function("shiftleft", F.call_function("shiftright", g, 2 * middle).bitwiseAND(3), F.lit(2 * s))
    return out.cast("int")


def line_states(lines: DataFrame) -> DataFrame:
    """lines (path, line from 1, text) with `quoted`: the state that the line begins in."""
    place = F.col("line") - 1
    rows = lines.withColumns({"_f": line_map(F.col("text")), "_b1": F.floor(place / BLOCK), "_b2": F.floor(place / BLOCK**2)})
    all_of = lambda maps: F.aggregate(maps, F.lit(SAME), composed)
    before = lambda *keys: Window.partitionBy("path", *keys).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_p1", all_of(F.collect_list("_f").over(before("_b1"))))
    rows = rows.withColumn("_t1", F.when(F.col("line") % BLOCK == 0, composed(F.col("_p1"), F.col("_f"))))
    rows = rows.withColumn("_p2", all_of(F.collect_list("_t1").over(before("_b2"))))
    rows = rows.withColumn("_t2", F.when(F.col("line") % BLOCK**2 == 0, composed(F.col("_p2"), F.col("_t1"))))
    rows = rows.withColumn("_p3", all_of(F.collect_list("_t2").over(before())))
    state = composed(composed(F.col("_p3"), F.col("_p2")), F.col("_p1")).bitwiseAND(3)
    return rows.select(*lines.columns, state.alias("quoted"))


def without_literals(lines: DataFrame) -> DataFrame:
    """lines with `code`: the text with a space for each literal that begins in it, and without what a literal from before covers."""
    known = line_states(lines)
    rest = F.when(F.col("quoted") == 0, F.col("text"))
    for k, q in enumerate(QUOTES, 1):
        rest = rest.when(F.col("quoted") == k, F.coalesce(_after(F.col("text"), q), F.lit("")))
    ends = "(?s)" + "|".join(f"{q}{_BODY[q]}(?:{q}|\\\\?\\z)" for q in QUOTES)
    return known.withColumn("code", F.regexp_replace(rest, ends, " ")).drop("quoted")
