"""Text to records: headings and links of pages, and declarations of source text.

Declarations are found by a scanner that knows comments, strings, templates and the code in them, patterns and braces, not
by a compiler: what rests on them is labelled ``syntax`` and is never authoritative.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

HEADING, LINK = r"<h([1-6])[^>]*>([^<]*)</h[1-6]>", r'<a href="([^"]*)"'


def headings(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Rows (key, level, title) in document order."""
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(HEADING), F.lit(1)).alias("level"), F.regexp_extract_all(html, F.lit(HEADING), F.lit(2)).alias("title"))
    return pages.select(key, F.explode(both).alias("h")).select(key, F.col("h.level").cast("int").alias("level"), F.col("h.title").alias("title"))


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    return pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(LINK), F.lit(1))).alias("href"))


#: What has text of its own, and what opens and closes code: comments, quoted strings, templates, braces, and a slash that
#: may begin a pattern.
_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[`{}/]", re.S)
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(`|\$\{|\\?\Z)", re.S)
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: What a pattern, and no division, stands behind.
_BEFORE_PATTERN = re.compile(r"(?:^|[(,=:\[!&|?{};+*%~^<>-]|\b(?:return|typeof|case|in|of|void|delete|do|else))\s*$")
_TOP = re.compile(r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(class|interface|enum|namespace|module|function\*?|type|const|let|var)\s+([\w$]+)")
_MEMBER = re.compile(r"(?:(?:public|private|protected|static|readonly|async|get|set|abstract|override)\s+)*(#?[\w$]+)\s*[?!]?\s*(\(|:|=|<|;)")
KINDS = {"class": "ClassDeclaration", "interface": "InterfaceDeclaration", "enum": "EnumDeclaration", "namespace": "ModuleDeclaration", "module": "ModuleDeclaration", "function": "FunctionDeclaration", "type": "TypeAliasDeclaration", "const": "VariableDeclaration", "let": "VariableDeclaration", "var": "VariableDeclaration"}


def code_of(source: str) -> str:
    """``source`` with blanks for what stands in comments, strings, templates and patterns; code inside a template stays, as
    do lines and places. One pass from the left."""
    out, at, skip = [], 0, 0
    open_braces: list[bool] = []  # whether a brace leads back into a template

    def blank(begin: int, end: int) -> None:
        nonlocal at
        out.append(source[at:begin] + re.sub(r"[^\n]", " ", source[begin:end]))
        at = end

    while m := _TOKEN.search(source, skip):
        skip, text = m.end(), m[0]
        if text == "{":
            open_braces.append(False)
        elif text == "/":
            if _BEFORE_PATTERN.search(source[max(0, m.start() - 40) : m.start()]) and (p := _PATTERN.match(source, m.start())):
                blank(m.start(), p.end())
                skip = p.end()
        elif text == "`" or text == "}" and open_braces and open_braces.pop():
            inside = _TEMPLATE.match(source, m.end())
            blank(m.start(), inside.end())
            skip = inside.end()
            if inside[1] == "${":
                open_braces.append(True)
        elif text != "}":
            blank(m.start(), m.end())
    return "".join(out) + source[at:]


_NEXT = re.compile(r"\s*,\s*([\w$]+)\s*(?=[=:;,!]|$)")


def declarations(text: str | None) -> Iterator[tuple[str, str, str, str, int, int]]:
    """(name, path, kind, signature, first line, last line) in document order; what has no name is passed over."""
    source = text or ""
    # what stands in comments and strings holds no declaration; positions stay
    clean = code_of(source)
    close: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(r"[{}]", clean):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            close[stack.pop()] = m.start()
    ends = [m.start() for m in re.finditer("\n", source)]
    line = lambda at: bisect_left(ends, at) + 1

    def bounds(at: int, end: int) -> tuple[int, int | None, int]:
        """Where what is declared before ``at`` has its head's end, its opening brace if it has one, and its last place."""
        stop = re.compile(r"[{;]|\n(?=\s*\n)").search(clean, at, end)
        head = stop.start() if stop else end
        opened = head if stop and stop[0] == "{" and head in close else None
        return head, opened, close[opened] if opened is not None else min(head, end - 1)

    def commas(begin: int, end: int) -> list[re.Match]:
        """Further variables of a list in clean[begin:end], outside of brackets."""
        depth, out = 0, []
        for m in re.finditer(r"[()\[\]<>]|=>|,", clean[begin:end]):
            if m[0] == "," and depth == 0 and (found := _NEXT.match(clean, begin + m.start(), end)):
                out.append(found)
            elif m[0] in "([<":
                depth += 1
            elif m[0] in ")]>":
                depth = max(0, depth - 1)
        return out

    def walk(begin: int, end: int, prefix: str, members: bool) -> Iterator[tuple[str, str, str, str, int, int]]:
        at = begin
        while at < end:
            m = (_MEMBER if members else _TOP).match(clean, at, end)
            if m and (at == 0 or not re.match(r"[\w$.#]", clean[at - 1])):
                word, name = ("member", m[1]) if members else (m[1].rstrip("*"), m[2])
                head, opened, last = bounds(m.end(1 if members else 2), end)
                path = f"{prefix}.{name}" if prefix else name
                kind = KINDS.get(word) or ("Constructor" if name == "constructor" else "MethodDeclaration" if m[2] in "(<" else "PropertyDeclaration")
                listed = [] if members or word not in ("const", "let", "var") else commas(m.end(2), head)
                tails = [x.start() for x in listed] + [head]
                yield name, path, kind, " ".join(source[at : tails[0]].split()), line(at), line(last if not listed else tails[0])
                for x, tail in zip(listed, tails[1:], strict=True):
                    yield x[1], f"{prefix}.{x[1]}" if prefix else x[1], kind, f"{word} " + " ".join(source[x.start(1) : tail].split()), line(x.start(1)), line(last if tail == head else tail)
                # a list goes on behind what braces hold
                while kind == "VariableDeclaration" and opened is not None and (x := _NEXT.match(clean, last + 1, end)):
                    head, opened, last = bounds(x.end(1), end)
                    yield x[1], f"{prefix}.{x[1]}" if prefix else x[1], kind, f"{word} " + " ".join(source[x.start(1) : head].split()), line(x.start(1)), line(last)
                if opened is not None and kind in ("ClassDeclaration", "InterfaceDeclaration", "ModuleDeclaration"):
                    yield from walk(opened + 1, last, path, kind != "ModuleDeclaration")
                at = last + 1
            elif clean[at] in "{(" and at in close:
                at = close[at] + 1
            else:
                at += 1

    yield from walk(0, len(clean), "", False)


FIELDS = "name string, symbol_path string, kind string, signature string, line int, end_line int, symbol_position int"


def symbols(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """The declarations of each file, with selectors; texts are read in Arrow batches, each once."""
    own = to_arrow_schema(StructType([StructField("key", files.schema[path].dataType), *StructType.fromDDL(FIELDS)]))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, source in zip(batch.column(0), batch.column(1), strict=True):
                if rows := [(*row, i) for i, row in enumerate(declarations(source.as_py()))]:
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(rows), own[0].type), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(own)[1:], strict=True))], schema=own)

    found = files.select(path, text).mapInArrow(extracted, StructType([StructField("key", files.schema[path].dataType), *StructType.fromDDL(FIELDS)]))
    return found.withColumnRenamed("key", path).withColumn("selector", F.concat("symbol_path", F.lit("@"), F.col("line").cast("string")))


def entries(files: DataFrame, config_digest: str, indexed_at: str, path: str = "path", text: str = "text") -> DataFrame:
    """One index entry for each file, as the stores hold them; a file without declarations has an empty list."""
    own = symbols(files, path, text).select(path, F.struct("symbol_position", F.struct("name", "symbol_path", "selector", "kind", "signature", "line", "end_line").alias("s")).alias("x"))
    lists = own.groupBy(path).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]).alias("symbols"))
    known = files.select(path, F.sha2(F.col(text).cast("binary"), 256).alias("content_hash"))
    empty = F.array().cast("array<struct<name:string,symbol_path:string,selector:string,kind:string,signature:string,line:int,end_line:int>>")
    return known.join(lists, path, "left").select(F.col(path).alias("file_path"), "content_hash", F.lit(config_digest).alias("config_digest"), F.coalesce("symbols", empty).alias("symbols"), F.lit(indexed_at).alias("last_indexed_at"))


IMPORT = r"(?:import|export)\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?\{([^}]*)\}\s*from\s*['\"](\.{1,2}/[^'\"]+)['\"]"
ENDING = r"(?:/index)?\.[cm]?[jt]sx?$"


def imports(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Rows (file, name, target): what files import by name from others that are there; of renamed ones, the name outside."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(IMPORT), F.lit(1)).alias("names"), F.regexp_extract_all(text, F.lit(IMPORT), F.lit(2)).alias("at"))
    rows = files.select(F.col(path).alias("file"), F.explode(both).alias("i"))
    at = F.concat(F.regexp_replace("file", "[^/]*$", ""), F.col("i.at"))
    # one segment after another; a step up drops the one before, however many there are
    up = lambda a, x: F.when((x == "..") & (F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, 1, F.size(a) - 1)).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    at = F.array_join(F.aggregate(F.split(at, "/"), F.array().cast("array<string>"), up), "/")
    rows = rows.select("file", F.regexp_replace(at, ENDING, "").alias("stem"), F.explode(F.split("i.names", ",")).alias("part"))
    rows = rows.select("file", "stem", F.trim(F.regexp_replace(F.regexp_replace("part", r"^\s*type\s+", ""), r"\s+as\s+.*$", "")).alias("name")).where("name <> ''")
    targets = files.select(F.col(path).alias("target"), F.regexp_replace(path, ENDING, "").alias("stem"))
    return rows.join(targets, "stem").select("file", "name", "target").distinct()


def outline(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """For each file, its declarations' signatures as one text without bodies."""
    depth = F.size(F.split("symbol_path", r"\.")) - 1
    shown = F.concat(F.repeat(F.lit("  "), depth), "signature")
    rows = symbols(files, path, text).select(path, F.struct("symbol_position", shown.alias("s")).alias("x"))
    return rows.groupBy(path).agg(F.count("*").alias("n_symbols"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "\n").alias("outline"))


def source_of(files: DataFrame, spans: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """The text of lines ``line`` to ``end_line`` of each span's file; no text where the file has none.

    A file is cut into lines once, and each line meets the spans that hold it: what is moved grows with the files and with
    what is returned, however many spans a file has, and a file's lines are many keys.
    """
    from ..operators.files import line_counts, lines

    cut = lines(files.where(F.col(text).isNotNull()), path, text)
    known = line_counts(files, path, text)
    # spans alike share their lines; a span that holds no line of its file is empty
    span = spans.select(path, "line", "end_line").distinct().join(known, path).withColumn("_to", F.least("end_line", "n_lines")).where("_to >= line")
    each = span.select(path, F.struct("line", "end_line").alias("_span"), F.explode(F.sequence("line", "_to")).alias("line"))
    found = each.join(cut, [path, "line"]).groupBy(path, "_span").agg(F.array_sort(F.collect_list(F.struct("line", "line_text"))).alias("_l"))
    found = found.select(path, "_span.*", F.array_join(F.transform("_l", lambda x: x["line_text"]), "\n").alias("_source"))
    out = spans.join(known, path).join(found, [path, "line", "end_line"], "left")
    there = (F.col("n_lines") >= 0) & F.col("line").isNotNull() & F.col("end_line").isNotNull()
    return out.withColumn("source", F.when(there, F.coalesce("_source", F.lit("")))).drop("_source", "n_lines")
