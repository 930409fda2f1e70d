"""Tables as text.

Each format is built per row (distributed), then assembled from an ordered
``collect_list`` per part.  Tables of every size have one shape: ordered parts
of ``PART_ROWS`` rows, so no group grows without bound and no row is dropped.
A consumer that needs one text per table takes ``joined``, which puts the parts of
tables of every size together; ``whole`` picks the texts that are one part.

Missing cells print as the usual writers print them: empty (text) and ``nan``
(INT) in markdown, ``None`` and ``nan`` in constructor text, ``null`` in JSON,
``None`` in the matrix, ``None`` and ``NaN`` in HTML and tab text, empty in CSV and in
the flattened forms.  A missing value leaves the other integers of its column
as integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabqa.functions.tokens import count_tokens


def lower_cell(c: Column) -> Column:
    """Cell as the flatten/tapex formats print it: lowercased text, '' for NULL."""
    return F.coalesce(F.lower(c), F.lit(""))


# ---------------------------------------------------------------- flatten (M9)


def flatten_header(header: Column) -> Column:
    return F.concat(
        F.lit("The table have "), F.size(header).cast("string"), F.lit(" columns: "),
        F.array_join(header, " | "), F.lit("\n"),
    )


def flatten_line(header: Column, cells: Column, row_idx: Column) -> Column:
    pairs = F.transform(
        F.arrays_zip(header.alias("h"), cells.alias("c")),
        lambda p: F.concat(p["h"], F.lit(" is "), lower_cell(p["c"]), F.lit(". ")),
    )
    return F.concat(F.lit("row "), (row_idx + 1).cast("string"), F.lit(" : "), F.array_join(pairs, ""), F.lit("\n"))


def table_tokens(rows: DataFrame, tables: DataFrame, counter=count_tokens) -> DataFrame:
    """Token length of each table in flatten form (B13), as a sum over lines.

    Rows that carry their table's ``header`` meet no tables: a table's first row counts for its head.
    """
    if "header" in rows.columns:
        line = counter(flatten_line(F.col("header"), F.col("cells"), F.col("row_idx")))
        head = F.when(F.col("row_idx") == 0, counter(flatten_header(F.col("header")))).otherwise(F.lit(0))
        return rows.groupBy("table_id").agg(F.sum(line + head).cast("bigint").alias("n_tokens"))
    lines = with_meta(rows, tables, cols=("header",)).select(
        "table_id", counter(flatten_line(F.col("header"), F.col("cells"), F.col("row_idx"))).alias("t")
    )
    body = lines.groupBy("table_id").agg(F.sum("t").cast("bigint").alias("body"))
    head = tables.select("table_id", counter(flatten_header(F.col("header"))).cast("bigint").alias("head"))
    return head.join(body, "table_id", "left").select(
        "table_id", (F.col("head") + F.coalesce("body", F.lit(0))).cast("bigint").alias("n_tokens")
    )


def with_meta(rows: DataFrame, tables: DataFrame, cols=("header", "types", "n_rows", "n_cols"), key=("table_id",)) -> DataFrame:
    """Attach per-table metadata to rows; the planner broadcasts it if its bytes allow, else AQE splits a hot table."""
    return rows.join(tables.select(*key, *cols), list(key))


# ---------------------------------------------------------------- all formats

FORMATS = [
    "markdown", "markdown_index", "dfloader", "json", "matrix", "html", "csv", "tab",
    "flatten", "tapex", "flatten_norow", "col_row_line", "noenter", "markdown_one_line",
]
PART_ROWS = 10_000  # rows of a part
NONE_TABLE = "None Table"
# What a missing cell prints, by format: (text, INT); JSON handles it itself.
MISSING = {
    "markdown": ("", "nan"), "markdown_index": ("", "nan"), "markdown_one_line": ("", "nan"), "dfloader": ("None", "nan"),
    "matrix": ("None", "None"), "html": ("None", "NaN"), "tab": ("None", "NaN"), "csv": ("", ""),
}


def _is_int(types: Column, j: Column) -> Column:
    return F.try_element_at(types, j + 1).isin("INT", "REAL")


def _filled(cells: Column, types: Column, fmt: str) -> Column:
    """Cells with missing ones replaced by what the format prints."""
    if fmt not in MISSING:
        return cells
    text, number = MISSING[fmt]
    return F.transform(cells, lambda v, j: F.coalesce(v, F.when(_is_int(types, j), number).otherwise(text)))


def _escaped(v: Column, odd: str, one) -> Column:
    """``v`` with ``one`` applied to each character, if it has any of the class ``odd``."""
    chars = F.filter(F.split(v, ""), lambda c: c != "")
    return F.when(v.rlike(odd), F.array_join(F.transform(chars, one), "")).otherwise(v)


def _hex(n: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(n)), width, "0")


def _py_repr(v: Column, is_int: Column) -> Column:
    """Python repr of a cell: ints bare, text quoted and escaped; a missing cell is ``None``."""
    single, double = v.contains("'"), v.contains('"')
    one = lambda c: (
        F.when(c == "\\", "\\\\").when(c == "\n", "\\n").when(c == "\r", "\\r").when(c == "\t", "\\t")
        .when((c == "'") & single & double, "\\'")
        .when((F.ascii(c) < 32) | F.ascii(c).between(127, 160) | (F.ascii(c) == 173), F.concat(F.lit("\\x"), _hex(F.ascii(c), 2)))
        .otherwise(c)
    )
    q = F.when(single & ~double, '"').otherwise("'")
    text = F.concat(q, _escaped(v, "[\\x00-\\x1f'\\\\\\x7f-\\xa0\\xad]", one), q)
    return F.coalesce(F.when(is_int, v).otherwise(text), F.lit("None"))


def _json_str(v: Column) -> Column:
    """A JSON string in ASCII, with ``/`` escaped."""
    code = F.ascii
    pair = lambda c: F.concat(
        F.lit("\\u"), _hex(F.floor((code(c) - 65536) / 1024) + 55296, 4), F.lit("\\u"), _hex(F.pmod(code(c) - 65536, F.lit(1024)) + 56320, 4)
    )
    one = lambda c: (
        F.when(c.isin('"', "\\", "/"), F.concat(F.lit("\\"), c))
        .when(c == "\n", "\\n").when(c == "\r", "\\r").when(c == "\t", "\\t").when(c == "\b", "\\b").when(c == "\f", "\\f")
        .when(code(c) > 65535, pair(c))
        .when((code(c) < 32) | (code(c) > 126), F.concat(F.lit("\\u"), _hex(code(c), 4)))
        .otherwise(c)
    )
    return F.concat(F.lit('"'), _escaped(v, '[^\\x20-\\x7e]|["\\\\/]', one), F.lit('"'))


def _csv_field(v: Column) -> Column:
    needs = v.rlike('[,"\\n\\r]')
    return F.when(needs, F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def _html_esc(v: Column) -> Column:
    return F.replace(F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _widths(rows: DataFrame, key: list[str]) -> DataFrame:
    """Longest cell per (table, column), and whether one is missing, as an array per table (one partial aggregation)."""
    per = rows.select(*key, F.posexplode("cells").alias("j", "v")).groupBy(*key, "j").agg(
        F.coalesce(F.max(F.length("v")), F.lit(0)).alias("w"), F.bool_or(F.col("v").isNull()).alias("missing")
    )
    return per.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("j", "w", "missing"))).alias("cw"))


def _pad(v: Column, w: Column, right: Column) -> Column:
    return F.when(right, F.lpad(v, w, " ")).otherwise(F.rpad(v, w, " "))


def _md_cells(vals: Column, widths: Column, right: Column) -> Column:
    """'| a | b |' from parallel arrays of values, widths and right-alignment flags."""
    z = F.arrays_zip(vals.alias("v"), widths.alias("w"), right.alias("r"))
    return F.concat(F.lit("| "), F.array_join(F.transform(z, lambda s: _pad(s["v"], s["w"], s["r"])), " | "), F.lit(" |"))


def _md_sep(widths: Column, right: Column) -> Column:
    z = F.arrays_zip(widths.alias("w"), right.alias("r"))
    cell = lambda s: F.when(s["r"], F.concat(F.repeat(F.lit("-"), s["w"] + 1), F.lit(":"))).otherwise(
        F.concat(F.lit(":"), F.repeat(F.lit("-"), s["w"] + 1))
    )
    return F.concat(F.lit("|"), F.array_join(F.transform(z, cell), "|"), F.lit("|"))


def _line_and_frame(fmt: str):
    """(row line, table head, table tail, separator) column builders for a format.

    Row lines see: header, types, cells, row_idx, n_rows, n_cols, and the
    width arrays ``mw`` (markdown) / ``tw`` (tab) where needed.
    """
    h, t, i = F.col("header"), F.col("types"), F.col("row_idx")
    c = _filled(F.col("cells"), t, fmt)
    idx = F.sequence(F.lit(0), F.col("n_cols") - 1)
    right = F.transform(idx, lambda j: _is_int(t, j))
    low = F.transform(c, lower_cell)
    istr = i.cast("string")
    nl = F.lit("\n")
    if fmt in ("markdown", "markdown_index", "markdown_one_line"):
        mw = F.col("mw")
        if fmt == "markdown":
            line = _md_cells(c, mw, right)
            head = F.concat(_md_cells(h, mw, right), nl, _md_sep(mw, right))
        else:
            iw = F.greatest(F.lit(2), F.length((F.col("n_rows") - 1).cast("string")))
            allw = F.concat(F.array(iw), mw)
            allr = F.concat(F.array(F.lit(True)), right)
            line = _md_cells(F.concat(F.array(istr), c), allw, allr)
            brk = F.lit(" ") if fmt == "markdown_one_line" else nl
            head = F.concat(_md_cells(F.concat(F.array(F.lit("")), h), allw, allr), brk, _md_sep(allw, allr))
        sep = " " if fmt == "markdown_one_line" else "\n"
        joiner = F.lit(sep)
        return line, F.concat(head, joiner), F.lit(""), sep
    if fmt == "json":
        pairs = F.transform(
            idx, lambda j: F.concat(
                _json_str(F.element_at(h, j + 1)), F.lit(":"),
                F.coalesce(F.when(_is_int(t, j), F.try_element_at(c, j + 1)).otherwise(_json_str(F.try_element_at(c, j + 1))), F.lit("null")),
            ),
        )
        line = F.concat(F.lit('"'), istr, F.lit('":{'), F.array_join(pairs, ","), F.lit("}"))
        return line, F.lit("{"), F.lit("}"), ","
    if fmt == "matrix":
        vals = F.transform(F.col("cells"), lambda v, j: _py_repr(v, _is_int(t, j)))
        line = F.concat(F.lit("  ["), istr, F.lit(", "), F.array_join(vals, ", "), F.lit("]\n"))
        hd = F.concat(F.lit("[\n  ['', "), F.array_join(F.transform(h, lambda x: _py_repr(x, F.lit(False))), ", "), F.lit("]\n"))
        return line, hd, F.lit("]"), ""
    if fmt == "html":
        tds = F.array_join(F.transform(c, lambda v: F.concat(F.lit("      <td>"), _html_esc(v), F.lit("</td>\n"))), "")
        line = F.concat(F.lit("    <tr>\n      <th>"), istr, F.lit("</th>\n"), tds, F.lit("    </tr>\n"))
        ths = F.array_join(F.transform(h, lambda v: F.concat(F.lit("      <th>"), _html_esc(v), F.lit("</th>\n"))), "")
        hd = F.concat(
            F.lit('<table border="1" class="dataframe">\n  <thead>\n    <tr style="text-align: right;">\n      <th></th>\n'),
            ths, F.lit("    </tr>\n  </thead>\n  <tbody>\n"),
        )
        return line, hd, F.lit("  </tbody>\n</table>"), ""
    if fmt == "csv":
        line = F.concat(istr, F.lit(","), F.array_join(F.transform(c, _csv_field), ","), nl)
        return line, F.concat(F.lit(","), F.array_join(F.transform(h, _csv_field), ","), nl), F.lit(""), ""
    if fmt == "tab":
        tw = F.col("tw")
        iw = F.length((F.col("n_rows") - 1).cast("string"))
        z = lambda vals: F.arrays_zip(vals.alias("v"), tw.alias("w"))
        # pandas: each value gets a leading space, columns joined by one space
        cells = F.array_join(F.transform(z(c), lambda s: F.concat(F.lit(" "), F.lpad(s["v"], s["w"], " "))), "")
        line = F.concat(F.rpad(istr, iw, " "), cells)
        hd = F.concat(F.repeat(F.lit(" "), iw), F.array_join(F.transform(z(h), lambda s: F.concat(F.lit(" "), F.lpad(s["v"], s["w"], " "))), ""))
        return line, F.concat(hd, nl), F.lit(""), "\n"
    if fmt == "flatten":
        return flatten_line(h, c, i), flatten_header(h), F.lit(""), ""
    if fmt == "tapex":
        line = F.concat(F.lit("row "), (i + 1).cast("string"), F.lit(" : "), F.array_join(low, " | "), nl)
        return line, F.concat(F.lit("header: "), F.array_join(h, " | "), nl), F.lit(""), ""
    if fmt == "flatten_norow":
        pairs = F.transform(F.arrays_zip(h.alias("h"), low.alias("v")), lambda p: F.concat(p["h"], F.lit(" is "), p["v"], F.lit(". ")))
        return F.concat(F.array_join(pairs, ""), nl), flatten_header(h), F.lit(""), ""
    if fmt == "col_row_line":
        line = F.concat(F.lit("row "), (i + 1).cast("string"), F.lit(" : "), F.array_join(low, " | "), F.lit(" "))
        return line, F.concat(F.lit("col : "), F.array_join(h, " | "), F.lit(" ")), F.lit(""), ""
    if fmt == "noenter":
        pairs = F.transform(
            F.arrays_zip(h.alias("h"), low.alias("v")),
            lambda p: F.concat(p["h"], F.lit(" is "), p["v"], F.lit(".  "), p["v"], F.lit(" | ")),
        )
        line = F.concat(F.lit("row "), (i + 1).cast("string"), F.lit(" : "), F.array_join(pairs, ""), F.lit(" "))
        hd = F.concat(F.lit("The table have "), F.size(h).cast("string"), F.lit(" columns: "), F.array_join(h, " | "), F.lit(" "))
        return line, hd, F.lit(""), ""
    raise ValueError(f"unknown format {fmt!r}")


def render(rows: DataFrame, tables: DataFrame, fmt: str, part_rows: int = PART_ROWS, key=("table_id",)) -> DataFrame:
    """Tables as text in ordered parts (M1-M15): ``(key..., chunk, n_chunks, text)``.

    Lines are built per row in parallel; part ``k`` holds the rows from ``k * part_rows``
    on (part 0 carries the head, the last one the tail; joined by the format's
    separator they are the whole text).  Empty tables render as 'None Table'.
    """
    key = list(key)
    meta = tables.select(*key, "header", "types", "n_rows", "n_cols")
    chunk = F.floor(F.col("row_idx") / part_rows).cast("int").alias("chunk")
    last = F.floor((F.greatest(F.col("n_rows"), F.lit(1)) - 1) / part_rows).cast("int")
    if fmt == "dfloader":
        body = _dfloader_parts(rows, meta, key, chunk)
        return meta.select(*key, (last + 1).alias("n_chunks")).join(body, key, "left").select(
            *key, F.coalesce("chunk", F.lit(0)).alias("chunk"), "n_chunks", F.coalesce("text", F.lit(NONE_TABLE)).alias("text")
        )
    if fmt in ("markdown", "markdown_index", "markdown_one_line", "tab"):
        cw = _widths(rows, key)
        text, number = MISSING[fmt]
        hw = F.transform(F.col("header"), lambda x, j: F.struct(F.length(x).alias("a"), F.get(F.col("cw"), j).alias("c"), F.when(_is_int(F.col("types"), j), len(number)).otherwise(len(text)).alias("m")))
        width = lambda x: F.greatest(F.coalesce(x["c"]["w"], F.lit(0)), F.when(x["c"]["missing"], x["m"]).otherwise(0))
        meta = meta.join(cw, key, "left").select(
            "*",
            F.transform(hw, lambda x: F.greatest(x["a"] + 2, width(x))).alias("mw"),
            F.transform(hw, lambda x: F.greatest(x["a"], width(x) + 1)).alias("tw"),
        ).drop("cw")
    line, head, tail, sep = _line_and_frame(fmt)
    lines = rows.join(meta, key).select(*key, chunk, "row_idx", line.alias("line"))
    body = lines.groupBy(*key, "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "line"))), lambda s: s["line"]), sep).alias("body")
    )
    frame = meta.select(*key, head.alias("head"), tail.alias("tail"), last.alias("last"))
    j = frame.join(body, key, "left")
    text = F.concat(
        F.when(F.coalesce(F.col("chunk"), F.lit(0)) == 0, F.col("head")).otherwise(F.lit("")),
        F.coalesce(F.col("body"), F.lit("")),
        F.when(F.coalesce(F.col("chunk"), F.lit(0)) == F.col("last"), F.col("tail")).otherwise(F.lit("")),
    )
    return j.select(
        *key,
        F.coalesce(F.col("chunk"), F.lit(0)).alias("chunk"),
        (F.col("last") + 1).alias("n_chunks"),
        F.when(F.col("body").isNull(), F.lit(NONE_TABLE)).otherwise(text).alias("text"),
    )


def in_place(tables: DataFrame, rows: str = "rows") -> DataFrame:
    """``text``, the markdown of tables that have their rows (``row_idx, cells``, in order) beside ``header`` and ``types``; the same as of ``render``."""
    header, types = F.col("header"), F.col("types")
    # A projection each for what the next one reads several times, so that it is worked out once.
    t = tables.select("*", F.transform(rows, lambda r: _filled(r["cells"], types, "markdown")).alias("__cells"), F.transform(header, lambda h, j: _is_int(types, j)).alias("__right"))
    widest = lambda j: F.coalesce(F.array_max(F.transform("__cells", lambda c: F.length(F.get(c, j)))), F.lit(0))
    t = t.select("*", F.transform(header, lambda h, j: F.greatest(F.length(h) + 2, widest(j))).alias("__w"))
    w, right = F.col("__w"), F.col("__right")
    lines = F.transform("__cells", lambda c: _md_cells(c, w, right))
    text = F.array_join(F.concat(F.array(_md_cells(header, w, right), _md_sep(w, right)), lines), "\n")
    return t.withColumn("text", F.when(F.size("__cells") == 0, F.lit(NONE_TABLE)).otherwise(text)).drop("__cells", "__right", "__w")


def whole(parts: DataFrame) -> DataFrame:
    """The texts of the tables that are one part."""
    return parts.where(F.col("n_chunks") == 1).drop("chunk", "n_chunks")


def joined(parts: DataFrame, fmt: str, key=("table_id",)) -> DataFrame:
    """``(key..., text)``: one text for every table, its parts joined in order; a text is one value, whatever its size."""
    if fmt == "dfloader":
        raise ValueError("parts of constructor text are constructors of their own")
    sep = _line_and_frame(fmt)[3]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda s: s["text"]), sep)
    return whole(parts).unionByName(parts.where(F.col("n_chunks") > 1).groupBy(*key).agg(text.alias("text")))


def _dfloader_parts(rows: DataFrame, meta: DataFrame, key: list[str], chunk: Column) -> DataFrame:
    """M3: DataFrame-constructor text of each range of rows, built column by column, with the range's index."""
    cells = rows.select(*key, chunk, "row_idx", F.posexplode("cells").alias("j", "v"))
    cols = cells.groupBy(*key, "chunk", "j").agg(F.array_sort(F.collect_list(F.struct("row_idx", "v"))).alias("vals"))
    is_int = _is_int(F.col("types"), F.col("j"))
    missing = lambda v: F.coalesce(v, F.when(is_int, "nan"))
    cols = cols.join(meta.select(*key, "header", "types"), key).select(
        *key, "chunk", "j",
        F.concat(
            F.lit("    "), _py_repr(F.element_at("header", F.col("j") + 1), F.lit(False)), F.lit(": ["),
            F.array_join(F.transform("vals", lambda s: _py_repr(missing(s["v"]), is_int)), ", "),
            F.lit("],\n"),
        ).alias("line"),
        F.when(F.col("j") == 0, F.array_join(F.transform("vals", lambda s: s["row_idx"].cast("string")), ", ")).alias("index"),
    )
    body = cols.groupBy(*key, "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "line"))), lambda s: s["line"]), "").alias("body"),
        F.max("index").alias("index"),
    )
    return body.select(*key, "chunk", F.concat(F.lit("pd.DataFrame({\n"), F.col("body"), F.lit("},\nindex=["), F.col("index"), F.lit("])")).alias("text"))
