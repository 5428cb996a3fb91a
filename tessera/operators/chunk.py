"""Cut files into line-range chunks at top-level declarations, as windows over per-line facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import ChunkConfig
from tessera.functions.text import begins_with, line_begins_with, normalize_newlines, snippet, split_lines, trim_space

# Beginnings of top-level declarations (of lower-cased, trimmed lines).
BOUNDARIES = (
    "import ",
    "export default ",
    "export function ",
    "function ",
    "export class ",
    "class ",
    "export interface ",
    "interface ",
    "export type ",
    "type ",
    "export enum ",
    "enum ",
    "export const ",
    "const ",
    "let ",
)
CONST_LET = ("export const ", "const ", "let ")
_LONGEST = max(map(len, BOUNDARIES))

_COMPLETE = "(?s)\"[^\"]*(?:\"|\\z)|'[^']*(?:'|\\z)|`[^`]*(?:`|\\z)|//.*|/\\*.*?\\*/"
_OPEN = "(?s)/\\*.*\\z"


def _starts(line: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out |= F.startswith(line, F.lit(p))
    return out


def line_kind(line: Column) -> Column:
    """'import', 'constlet' or 'other' for a boundary line, null for any other line."""
    low = F.lower(F.substring(trim_space(line), 1, _LONGEST))
    kind = F.when(F.startswith(low, F.lit("import ")), "import").when(_starts(low, CONST_LET), "constlet").when(_starts(low, BOUNDARIES), "other")
    return F.when(begins_with(line, BOUNDARIES), kind)


def lines_of(files: DataFrame, content: str = "content") -> DataFrame:
    """path, line (from 1), text."""
    return files.select("path", F.posexplode(split_lines(normalize_newlines(F.col(content)))).alias("_p", "text")).select("path", (F.col("_p") + 1).alias("line"), "text")


def _balance(code: Column, up: str, down: str) -> tuple[Column, Column]:
    """(net change, least running value) of a bracket pair along a line."""
    some = F.contains(code, F.lit(up)) | F.contains(code, F.lit(down))
    only = F.when(some, F.regexp_replace(code, f"[^\\{up}\\{down}]", "")).otherwise("")
    net = (F.length(only) - 2 * F.length(F.replace(only, F.lit(up), F.lit("")))).cast("int")
    zero = F.struct(F.lit(0).alias("s"), F.lit(0).alias("m"))

    def step(a: Column, c: Column) -> Column:
        s = a["s"] + F.when(c == up, 1).when(c == down, -1).otherwise(0)
        return F.struct(s.alias("s"), F.least(a["m"], s).alias("m"))

    low = F.when(F.contains(only, F.lit(down)), F.aggregate(F.split(only, ""), zero, step, lambda a: a["m"])).otherwise(0)
    return net, low


def line_state(lines: DataFrame) -> DataFrame:
    """lines with brace and paren depth and whether a block comment is open, before each line.

    Each line maps the comment flag to a new one; constant and swapping maps compose as a last value and a parity.
    Depth that never falls below zero is the running sum less its least value so far.
    """
    marks = F.contains("text", F.lit('"')) | F.contains("text", F.lit("'")) | F.contains("text", F.lit("`")) | F.contains("text", F.lit("/"))
    closed = F.when(marks, F.regexp_replace("text", _COMPLETE, " ")).otherwise(F.col("text"))
    inside = F.instr("text", "*/")
    rest = F.regexp_replace(F.expr("substring(text, instr(text, '*/') + 2)"), _COMPLETE, " ")
    out0 = F.contains(closed, F.lit("/*"))
    out1 = F.when(inside == 0, F.lit(True)).otherwise(F.contains(rest, F.lit("/*")))
    facts = lines.withColumns({"_c0": F.when(out0, F.regexp_replace(closed, _OPEN, "")).otherwise(closed), "_c1": F.when(inside == 0, "").otherwise(F.regexp_replace(rest, _OPEN, "")), "_o0": out0, "_o1": out1})
    order = Window.partitionBy("path").orderBy("line")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    constant = F.when(F.col("_o0") == F.col("_o1"), F.col("_o0"))
    swap = F.when(F.col("_o0") & ~F.col("_o1"), 1).otherwise(0)
    facts = facts.withColumns({"_k": constant, "_x": F.sum(swap).over(upto)})
    base_value = F.coalesce(F.last("_k", ignorenulls=True).over(upto), F.lit(False))
    base_swaps = F.coalesce(F.last(F.when(F.col("_k").isNotNull(), F.col("_x")), ignorenulls=True).over(upto), F.lit(0))
    after = base_value != ((F.col("_x") - base_swaps) % 2 == 1)
    facts = facts.withColumn("_after", after).withColumn("in_comment", F.coalesce(F.lag("_after").over(order), F.lit(False)))
    code = F.when(F.col("in_comment"), F.col("_c1")).otherwise(F.col("_c0"))
    facts = facts.withColumn("_code", code)
    depths = {}
    for name, up, down in (("brace", "{", "}"), ("paren", "(", ")")):
        net, low = _balance(F.col("_code"), up, down)
        facts = facts.withColumns({f"_n_{name}": net, f"_l_{name}": low})
        facts = facts.withColumn(f"_s_{name}", F.coalesce(F.sum(f"_n_{name}").over(before), F.lit(0)))
        least = F.least(F.lit(0), F.coalesce(F.min(F.col(f"_s_{name}") + F.col(f"_l_{name}")).over(before), F.lit(0)))
        depths[f"{name}_depth"] = (F.col(f"_s_{name}") - least).cast("int")
    return facts.withColumns(depths).select(*lines.columns, "brace_depth", "paren_depth", "in_comment")


def declared(lines: DataFrame) -> DataFrame:
    """lines with begins: whether a declaration block of its file begins there; a file without any is one block."""
    state = line_state(lines)
    top = (F.col("brace_depth") == 0) & (F.col("paren_depth") == 0) & ~F.col("in_comment")
    brace = begins_with(F.col("text"), ("export {",)) & F.startswith(trim_space(F.col("text")), F.lit("export {"))
    facts = state.select(*lines.columns, F.when(top & brace, "export").when(top, line_kind(F.col("text"))).alias("_kind"))
    whole = Window.partitionBy("path")
    before = whole.orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    facts = facts.withColumn("_first", F.min(F.when(F.col("_kind").isNotNull(), F.col("line"))).over(whole))
    # "export {" begins a block only as the first event of a file
    event = F.when(F.col("_kind") == "export", F.when(F.col("line") == F.col("_first"), "other")).otherwise(F.col("_kind"))
    facts = facts.withColumn("_event", event).withColumn("_previous", F.last("_event", ignorenulls=True).over(before))
    begins = F.when(F.col("_first").isNull(), F.col("line") == 1).otherwise(F.col("_event").isNotNull() & ((F.col("_event") == "other") | ~F.col("_previous").eqNullSafe(F.col("_event"))))
    return facts.select(*lines.columns, begins.alias("begins"))


def blocks(lines: DataFrame) -> DataFrame:
    """path, start, end of the declaration blocks of each file."""
    order = Window.partitionBy("path").orderBy("line")
    found = declared(lines).withColumn("_n", F.max("line").over(Window.partitionBy("path"))).filter("begins")
    return found.select("path", F.col("line").alias("start"), F.coalesce(F.lead("line").over(order) - 1, "_n").alias("end"))


def chunked_lines(lines: DataFrame, config: ChunkConfig, *first: str, each: tuple[str, ...] = ()) -> DataFrame:
    """path, lines (array), chunks (array of (start, end)) of each file, made from its lines in one shuffle.

    first: columns that the first line of each file carries and that the file gets; each: columns of lines that the file gets as arrays.
    """
    per = declared(lines).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "text", "begins", *each))).alias("_l"), *[F.max(c).alias(c) for c in first])  # a file's own lines
    starts = F.transform(F.filter("_l", lambda x: x["begins"]), lambda x: x["line"])
    first = (*first, *each)
    per = per.withColumns({c: F.transform("_l", lambda x: x[c]) for c in each})  # noqa: B023
    per = per.select("path", *first, F.transform("_l", lambda x: x["text"]).alias("lines"), starts.alias("_s"))
    end = lambda i: F.coalesce(F.get(F.col("_s"), i + 1) - 1, F.size("lines"))
    found = F.transform("_s", lambda s, i: F.struct(s.alias("start"), end(i).alias("end")))
    per = per.withColumn("_b", merge_short(found, config.min_lines))
    return per.select("path", *first, "lines", F.flatten(F.transform("_b", lambda b: windows(b["start"], b["end"], config))).alias("chunks"))


def undeclared(content: Column) -> Column:
    """Whether no line of a text can begin a declaration, so that the file is one block."""
    return ~line_begins_with(content, (*BOUNDARIES, "export {"))


def whole_lines(files: DataFrame, config: ChunkConfig, *first: str, content: str = "content") -> DataFrame:
    """What `chunked_lines` gives for files of one block (rows with distinct paths), each made from its own row."""
    rows = files.select("path", *first, split_lines(normalize_newlines(F.col(content))).alias("lines"))
    return rows.withColumn("chunks", windows(F.lit(1), F.size("lines"), config))


def merge_short(found: Column, min_lines: int) -> Column:
    """Fold an ordered array of (start, end): a block absorbs the following ones until it has min_lines."""
    empty = F.slice(found, 1, 0)

    def step(done: Column, b: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), b["end"].alias("end"))))
        return F.when((F.size(done) > 0) & (last["end"] - last["start"] + 1 < min_lines), grown).otherwise(F.concat(done, F.array(b)))

    return F.aggregate(found, empty, step)


def windows(start: Column, end: Column, config: ChunkConfig) -> Column:
    """The overlapping (start, end) windows of a block, in closed form."""
    m = config.max_lines
    if m <= 0:
        return F.array(F.struct(start.alias("start"), end.alias("end")))
    stride = m - config.overlap_lines if 0 < m - config.overlap_lines else m
    count = F.greatest(F.lit(0), F.ceil((end - start + 1 - m) / F.lit(stride)).cast("int"))
    return F.transform(F.sequence(F.lit(0), count), lambda k: F.struct((start + k * stride).alias("start"), F.least(end, start + k * stride + (m - 1)).alias("end")))


def chunk_ranges(files: DataFrame, config: ChunkConfig, content: str = "content") -> DataFrame:
    """path, chunks: array of (start, end) per file."""
    return chunked_lines(lines_of(files, content), config).select("path", "chunks")


def chunk_files(files: DataFrame, config: ChunkConfig, max_snippet_bytes: int = 800, content: str = "content") -> DataFrame:
    """path, ordinal (from 0), start_line, end_line, snippet, lines of every chunk."""
    rows = chunked_lines(lines_of(files, content), config).select("path", "lines", F.posexplode("chunks").alias("ordinal", "_c"))
    return rows.select("path", "ordinal", F.col("_c.start").alias("start_line"), F.col("_c.end").alias("end_line"), snippet(F.col("lines"), F.col("_c.start"), F.col("_c.end"), max_snippet_bytes).alias("snippet"), F.slice("lines", F.col("_c.start"), F.col("_c.end") - F.col("_c.start") + 1).alias("lines"))
