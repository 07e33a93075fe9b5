"""One query for each operator over the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import redaction as hiding
from .functions.scalar import array_items, at_pointer, canonical_instant, identifier, in_project, json_bytes, matches_glob, saturated, selector_line, selector_path, sha256, strict_base64, utf8_text
from .operators import delta, diagnostics, evidence, files, graph, resolution, search
from .sources import extract

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c: str) -> Column:
    return F.col(c).cast("long").alias(c)


# --- search -----------------------------------------------------------------

NAMES = search.Names(name="p_name", path="symbol_path", line="p_partkey", file="p_brand", kind="p_type", position="p_partkey")
#: the search term of the queries, which occurs in p_name
TERM = "widget"
PARTS = "(SELECT *, p_brand || '.' || p_name AS symbol_path, p_brand || '.' || p_name || '@' || p_partkey AS selector FROM part)"
RANK = """CASE WHEN lower(selector) = '{q}' THEN 0 WHEN lower(symbol_path) = '{q}' THEN 1 WHEN lower(p_name) = '{q}' THEN 2
 WHEN starts_with(lower(symbol_path), '{q}') OR starts_with(lower(p_name), '{q}') THEN 3 ELSE 4 END"""
FOUND = f"(SELECT *, {RANK} AS rank FROM {PARTS} WHERE contains(lower(p_name), '{{q}}') OR contains(lower(symbol_path), '{{q}}') OR contains(lower(selector), '{{q}}'))"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.withColumn("symbol_path", F.concat_ws(".", "p_brand", "p_name")).withColumn("selector", F.concat(F.concat_ws(".", "p_brand", "p_name"), F.lit("@"), F.col("p_partkey").cast("string")))


def _page_sql(q: str, offset: int, limit: int, columns: str, where: str = "TRUE") -> str:
    found = FOUND.format(q=q)
    return f"""WITH f AS (SELECT * FROM {found} WHERE {where}), t AS (SELECT count(*) AS total FROM f)
 SELECT {columns}, total, total > {offset + limit} AS has_more, CASE WHEN total > {offset + limit} THEN CAST({offset + limit} AS BIGINT) END AS next_offset
 FROM (SELECT * FROM f ORDER BY rank, p_brand, p_partkey LIMIT {limit} OFFSET {offset}), t"""


PAGE_COLUMNS = ("rank", "p_brand", "selector", "p_partkey", "total", "has_more", "next_offset")


@query(_page_sql(TERM, 0, 50, "CAST(rank AS INT) AS rank, p_brand, selector, p_partkey"))
def ranked_search(spark, sf_dir):
    return search.ranked_page(parts(spark, sf_dir), TERM, NAMES, limit=50).select(*PAGE_COLUMNS)


@query(_page_sql("brand", 40, 20, "CAST(rank AS INT) AS rank, p_brand, selector, p_partkey"))
def ranked_page_2(spark, sf_dir):
    return search.ranked_page(parts(spark, sf_dir), "brand", NAMES, offset=40, limit=20).select(*PAGE_COLUMNS)


@query(f"SELECT CAST(rank AS INT) AS rank, count(*) AS n FROM {FOUND.format(q=TERM)} GROUP BY 1")
def rank_histogram(spark, sf_dir):
    return search.histogram(search.candidates(parts(spark, sf_dir), TERM, NAMES)).select("rank", "n")


#: a term for each rank: a selector, a path, a name, the start of one, and a part of one
RANKED = ("Brand#2.small ring@0", "brand#2.small RING", "hot gear", "brand#1", "izm")


@query(" UNION ALL ".join(f"SELECT '{q}' AS term, CAST(rank AS INT) AS rank, count(*) AS n FROM {FOUND.format(q=q.lower())} GROUP BY 2" for q in RANKED))
def match_rank(spark, sf_dir):
    out = [search.histogram(search.candidates(parts(spark, sf_dir), q, NAMES)).select(F.lit(q).alias("term"), "rank", "n") for q in RANKED]
    for other in out[1:]:
        out[0] = out[0].unionByName(other)
    return out[0]


def _detail(level: str):
    def run(spark, sf_dir):
        p = parts(spark, sf_dir).withColumns({"file_path": F.col("p_brand"), "name": F.col("p_name"), "kind": F.col("p_type"), "line": F.col("p_partkey"), "signature": F.concat_ws(" ", "p_type", "p_name")})
        return search.detail(search.candidates(p, TERM, NAMES), level)

    return run


_DETAIL_SQL = {"file_path": "p_brand AS file_path", "selector": "selector", "rank": "CAST(rank AS INT) AS rank", "symbol_path": "symbol_path", "kind": "p_type AS kind", "line": "p_partkey AS line", "name": "p_name AS name", "signature": "p_type || ' ' || p_name AS signature"}
for _level, _columns in search.DETAIL.items():
    QUERIES[f"detail_{_level}"] = _detail(_level)
    SQL[f"detail_{_level}"] = f"SELECT {', '.join(_DETAIL_SQL[c] for c in _columns)} FROM {FOUND.format(q=TERM)}"


@query(f"SELECT p_partkey, p_type, p_brand FROM {FOUND.format(q='a')} WHERE p_type IN (SELECT min(p_type) FROM part UNION SELECT max(p_type) FROM part) AND contains(lower(p_brand), '1')")
def kind_file_filter(spark, sf_dir):
    p = parts(spark, sf_dir)
    ends = p.agg(F.min("p_type"), F.max("p_type")).first()
    return search.candidates(p, "a", NAMES, kinds=list(ends), file_filter="1").select("p_partkey", "p_type", "p_brand")


@query("""SELECT c_custkey, c_name, total, total > 150 AS has_more, CASE WHEN total > 150 THEN CAST(150 AS BIGINT) END AS next_offset
 FROM (SELECT * FROM customer ORDER BY c_name, c_custkey LIMIT 50 OFFSET 100), (SELECT count(*) AS total FROM customer)""")
def paginate(spark, sf_dir):
    return search.page(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), [F.col("c_name"), F.col("c_custkey")], 100, 50)


@query("""WITH f AS (SELECT page_id, url FROM pages WHERE contains(lower(url), 'a')), t AS (SELECT count(*) AS total FROM f)
 SELECT page_id, url, total, total > 100 AS has_more, CASE WHEN total > 100 THEN CAST(100 AS BIGINT) END AS next_offset FROM (SELECT * FROM f ORDER BY url, page_id LIMIT 100), t""")
def list_files(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    return files.list_files(p, "A", 0, 100, path="url", language_order=False)


@query("""WITH b AS (SELECT p_partkey, p_name FROM part), i AS (SELECT p_partkey, CASE WHEN p_size = 7 THEN p_name || '?' ELSE p_name END AS p_name FROM part WHERE p_size <> 9)
 SELECT (SELECT count(*) FROM b) AS n_base, (SELECT count(*) FROM i) AS n_index, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM i)) AS n_missing,
 (SELECT count(*) FROM (SELECT * FROM i EXCEPT ALL SELECT * FROM b)) AS n_extra, (SELECT count(*) FROM part WHERE p_size IN (7, 9)) = 0 AS equal""")
def parity_check(spark, sf_dir):
    from .sources.store import MemoryStore

    p = read(spark, sf_dir, "part")
    store = MemoryStore(spark)
    store.put("parts", p.where("p_size <> 9").select("p_partkey", F.when(F.col("p_size") == 7, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name")).alias("p_name")))
    return search.parity(p.select("p_partkey", "p_name"), store.get("parts"))


# --- declarations -----------------------------------------------------------

SOURCE_SQL = "(SELECT p_brand, 'C' || substr(p_brand, 7) AS c, 'm' || p_partkey AS m, p_size, 1 + row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS line, count(*) OVER (PARTITION BY p_brand) AS n FROM part)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of source text for each brand: one class, with a method for each part."""
    p = read(spark, sf_dir, "part").select("p_brand", F.struct("p_partkey", F.concat(F.lit("  m"), F.col("p_partkey").cast("string"), F.lit("(): number { return "), F.col("p_size").cast("string"), F.lit("; }")).alias("line")).alias("m"))
    lines = F.transform(F.array_sort(F.collect_list("m")), lambda m: m["line"])
    text = F.concat(F.lit("export class C"), F.expr("substring(p_brand, 7)"), F.lit(" {\n"), F.array_join("lines", "\n"), F.lit("\n}\n"))
    return p.groupBy("p_brand").agg(lines.alias("lines")).select(F.col("p_brand").alias("path"), text.alias("text"))


@query(f"""SELECT p_brand AS path, c AS symbol_path, 'ClassDeclaration' AS kind, 1 AS line, CAST(max(n) + 2 AS INT) AS end_line, 0 AS symbol_position FROM {SOURCE_SQL} GROUP BY p_brand, c
 UNION ALL SELECT p_brand, c || '.' || m, 'MethodDeclaration', CAST(line AS INT), CAST(line AS INT), CAST(line - 1 AS INT) FROM {SOURCE_SQL}""")
def symbol_enumeration(spark, sf_dir):
    return extract.symbols(sources(spark, sf_dir)).select("path", "symbol_path", "kind", "line", "end_line", "symbol_position")


@query(f"""SELECT p_brand AS path, count(*) + 1 AS n_symbols, 'export class ' || c || chr(10) || string_agg('  ' || m || '(): number', chr(10) ORDER BY line) AS outline FROM {SOURCE_SQL} GROUP BY p_brand, c""")
def outline(spark, sf_dir):
    return extract.outline(sources(spark, sf_dir))


@query(f"SELECT p_brand AS path, c || '.' || m || '@' || line AS selector, '  ' || m || '(): number {{ return ' || p_size || '; }}' AS source FROM {SOURCE_SQL}")
def symbol_source(spark, sf_dir):
    text = sources(spark, sf_dir)
    own = extract.symbols(text).where("kind = 'MethodDeclaration'").select("path", "selector", "line", "end_line")
    return extract.source_of(text, own).select("path", "selector", "source")


@query(f"SELECT p_brand AS path, c || '.' || m AS symbol_path FROM {SOURCE_SQL}")
def executable_bodies(spark, sf_dir):
    return extract.symbols(sources(spark, sf_dir)).where(resolution.executable()).select("path", "symbol_path")


@query(f"SELECT p_brand AS file_path, c || '.' || m AS symbol_path, CAST(line AS INT) AS line FROM {SOURCE_SQL} WHERE contains(m, 'm1') AND contains(lower(p_brand), '#2')")
def stored_symbols(spark, sf_dir):
    import uuid

    from .plans.checkpoints import folder
    from .sources.store import ParquetStore

    entries = extract.entries(sources(spark, sf_dir), "c1", "2026-08-06T00:00:00.000Z")
    store = ParquetStore(spark, f"{folder(spark)}/index-{uuid.uuid4().hex}")
    store.upsert("parts", entries)
    return store.symbols("parts", "M1", ["MethodDeclaration"], "#2").select("file_path", "symbol_path", "line")


#: what the segment store holds after its second change: sizes of 7 renamed, sizes of 9 gone
CHANGED = """(SELECT p_brand || '/' || p_type AS file_path, p_partkey, CASE WHEN p_size = 7 THEN 'renamed ' || p_name ELSE p_name END AS name FROM part WHERE p_size <> 9)"""


def _segments(spark: SparkSession, sf_dir: str):
    """A segment store of parts as symbols of files, after one change of all and one of some files."""
    import uuid

    from .plans.checkpoints import folder
    from .sources.segments import SegmentStore

    p = read(spark, sf_dir, "part").withColumn("file_path", F.concat_ws("/", "p_brand", "p_type"))
    none = F.lit(None).cast("string")
    symbol = lambda name: F.struct(name.alias("name"), F.concat_ws(".", "p_brand", name).alias("symbol_path"), F.concat_ws("@", "p_brand", F.col("p_partkey").cast("string")).alias("selector"), F.lit("part").alias("kind"), none.alias("signature"), F.col("p_partkey").cast("int").alias("line"), F.col("p_partkey").cast("int").alias("end_line"))

    def entries(rows: DataFrame, name: Column) -> DataFrame:
        own = rows.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("p_partkey", symbol(name).alias("s")))).alias("x"))
        own = own.select("file_path", F.transform("x", lambda x: x["s"]).alias("symbols"))
        return own.select("file_path", sha256(F.to_json("symbols")).alias("content_hash"), F.lit("c1").alias("config_digest"), "symbols", F.lit("2026-08-06T00:00:00.000Z").alias("last_indexed_at"))

    store = SegmentStore(spark, f"{folder(spark)}/segments-{uuid.uuid4().hex}", buckets=8)
    old = entries(p, F.col("p_name"))
    store.upsert("parts", old)
    new = entries(p.where("p_size <> 9"), F.when(F.col("p_size") == 7, F.concat(F.lit("renamed "), F.col("p_name"))).otherwise(F.col("p_name")))
    changed = new.join(old.select("file_path", "content_hash"), ["file_path", "content_hash"], "left_anti")
    gone = old.join(new.select("file_path"), "file_path", "left_anti")
    plan = changed.select("file_path", F.lit("rebuild").alias("action")).unionByName(gone.select("file_path", F.lit("remove").alias("action")))
    store.refresh("parts", plan, changed)
    return store


@query(f"SELECT file_path, count(*) AS n_symbols, string_agg(name, chr(10) ORDER BY p_partkey) AS names FROM {CHANGED} GROUP BY 1")
def segment_refresh(spark, sf_dir):
    found = _segments(spark, sf_dir).load("parts")
    return found.select("file_path", F.size("symbols").cast("long").alias("n_symbols"), F.array_join(F.transform("symbols", lambda s: s["name"]), "\n").alias("names"))


@query(f"""SELECT t.term, file_path, name, p_partkey AS line FROM {CHANGED}, (SELECT unnest(['{TERM}', 'ED ', 'b', 'brand#11.renamed', 'wi']) AS term) t
 WHERE contains(lower(name), lower(term)) OR contains(lower(split_part(file_path, '/', 1) || '.' || name), lower(term)) OR contains(lower(split_part(file_path, '/', 1) || '@' || p_partkey), lower(term))""")
def indexed_search(spark, sf_dir):
    """Terms of one character and more, by postings over two segments."""
    store = _segments(spark, sf_dir)
    out = None
    for term in (TERM, "ED ", "b", "brand#11.renamed", "wi"):
        found = store.symbols("parts", term).select(F.lit(term).alias("term"), "file_path", "name", F.col("line").cast("long"))
        out = found if out is None else out.unionByName(found)
    return out


@query("""SELECT c_custkey, coalesce(signature, c_name) AS signature FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS signature FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey""")
def record_projection(spark, sf_dir):
    symbols = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    lines = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("signature"))
    return resolution.records(symbols, lines, ["c_custkey"], text="c_name").select("c_custkey", "signature")


NAMED = "(SELECT p_brand AS file_path, p_brand || '.' || p_name AS symbol_path, p_brand || '.' || p_name || '@' || p_partkey AS selector, p_size > 25 AS has_body FROM part)"


@query(f"""WITH w AS (SELECT DISTINCT file_path, symbol_path AS symbol FROM {NAMED} UNION SELECT file_path, selector FROM {NAMED} UNION SELECT DISTINCT file_path, 'nothing' FROM {NAMED})
 SELECT w.file_path, w.symbol, count(s.selector) AS n_found, CASE WHEN bool_or(s.selector = w.symbol) THEN w.symbol WHEN count(s.selector) = 1 THEN min(s.selector) WHEN count_if(s.has_body) = 1 THEN min(CASE WHEN s.has_body THEN s.selector END) END AS resolved
 FROM w LEFT JOIN {NAMED} s ON s.file_path = w.file_path AND (s.symbol_path = w.symbol OR s.selector = w.symbol) GROUP BY 1, 2""")
def declaration_lookup(spark, sf_dir):
    s = parts(spark, sf_dir).select(F.col("p_brand").alias("file_path"), "symbol_path", "selector", (F.col("p_size") > 25).alias("has_body"))
    wanted = s.select("file_path", F.explode(F.array("symbol_path", "selector", F.lit("nothing"))).alias("symbol")).distinct()
    return resolution.lookup(s, wanted)


@query("""WITH d AS (SELECT 'n' || c_nationkey AS file, 'c' || (c_custkey % 200) AS name, c_custkey AS id FROM customer),
 own AS (SELECT file, name, min(id) AS id, count(DISTINCT id) AS n FROM d GROUP BY 1, 2),
 brought AS (SELECT 'n' || s_nationkey AS file, 'c' || (s_suppkey % 200) AS name, min(d.id) AS id, count(DISTINCT d.id) AS n FROM supplier JOIN d ON d.file = 'n' || ((s_nationkey + 1) % 25) AND d.name = 'c' || (s_suppkey % 200) GROUP BY 1, 2),
 scope AS (SELECT * FROM own UNION ALL SELECT b.* FROM brought b ANTI JOIN own o ON o.file = b.file AND o.name = b.name)
 SELECT o_orderkey, coalesce(s.id, -1) AS symbol_id FROM orders LEFT JOIN (SELECT * FROM scope WHERE n = 1) s ON s.file = 'n' || (o_orderkey % 25) AND s.name = 'c' || (o_custkey % 200)""")
def references_by_declaration(spark, sf_dir):
    """Equal names of other files do not count: a name means one declaration of its file, or one that is imported."""
    name = lambda p, c, n: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    declared = read(spark, sf_dir, "customer").select(name("n", "c_nationkey", 25).alias("file"), name("c", "c_custkey", 200).alias("name"), F.col("c_custkey").alias("symbol_id"))
    imports = read(spark, sf_dir, "supplier").select(name("n", "s_nationkey", 25).alias("file"), name("c", "s_suppkey", 200).alias("name"), F.concat(F.lit("n"), ((F.col("s_nationkey") + 1) % 25).cast("string")).alias("target"))
    uses = read(spark, sf_dir, "orders").select("o_orderkey", name("n", "o_orderkey", 25).alias("file"), name("c", "o_custkey", 200).alias("name"))
    return resolution.resolved(uses, declared, imports).select("o_orderkey", F.coalesce("symbol_id", F.lit(-1)).alias("symbol_id"))


@query("""SELECT p.p_partkey, p.p_brand, coalesce(e.n, 0) AS n FROM part p LEFT JOIN (SELECT p_brand, p_name, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND p_size < 25 GROUP BY 1, 2) e ON e.p_brand = p.p_brand AND e.p_name = p.p_name""")
def evidence_attach(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("file"), F.col("p_name").alias("selector"), "p_size")
    lines = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    found = p.where("p_size < 25").join(lines, "p_partkey").groupBy("file", "selector").agg(F.count("*").alias("n"))
    return resolution.attached(p.drop("p_size"), found).select("p_partkey", F.col("file").alias("p_brand"), F.coalesce("n", F.lit(0)).alias("n"))


# --- files ------------------------------------------------------------------

TAILS = "(SELECT DISTINCT regexp_replace(url, '^.*/', '') AS suffix FROM pages)"


@query(f"""SELECT suffix, count(DISTINCT url) AS n_files, CASE WHEN count(DISTINCT url) = 1 THEN min(url) END AS resolved
 FROM {TAILS} t LEFT JOIN pages p ON p.url = t.suffix OR ends_with(p.url, '/' || t.suffix) GROUP BY suffix""")
def path_resolve(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return files.suffix_matches(p.select("url"), p.select(F.regexp_replace("url", "^.*/", "").alias("suffix")).distinct(), "url", "suffix")


LINES = "CASE WHEN s[-1] = '' THEN s[:-2] ELSE s END"
LINE_SQL = f"(SELECT doc_id, {LINES} AS l FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\n|\\r') AS s FROM documents))"


@query(f"""SELECT doc_id, CAST(i AS INT) AS line, l[i] AS line_text, CAST(len(l) AS BIGINT) AS total_lines FROM {LINE_SQL}, unnest(range(2, 5)) AS r(i) WHERE i <= len(l)""")
def file_line_slice(spark, sf_dir):
    return files.line_slice(read(spark, sf_dir, "documents"), "doc_id", 1, 3)


@query(f"SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines FROM {LINE_SQL}")
def line_counts(spark, sf_dir):
    return files.line_counts(read(spark, sf_dir, "documents"), "doc_id")


@query("SELECT page_id, CAST(level AS INT) AS level, title FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h[1-6][^>]*>', 0)) AS tag, unnest(regexp_extract_all(html, '<h([1-6])[^>]*>', 1)) AS level, unnest(regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1)) AS title FROM pages)")
def html_outline(spark, sf_dir):
    return extract.headings(read(spark, sf_dir, "pages"), "page_id", "html")


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages""")
def html_links(spark, sf_dir):
    return extract.links(read(spark, sf_dir, "pages"), "page_id", "html")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://[^/]*/(?:.*/)?[^/]*1[^/]$')")
def glob_filter(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    return p.where(matches_glob(F.col("url"), "https://*/**/*1?") | matches_glob(F.col("url"), "http://*/**/*1?"))


OLD, NEW = "(SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0)", "(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 11 <> 0)"


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = read(spark, sf_dir, "documents")
    old = d.where("doc_id % 7 <> 0").select("doc_id", sha256(F.col("text")).alias("content_hash"))
    new = d.where("doc_id % 11 <> 0").select("doc_id", sha256(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))
    return old, new


@query(f"""SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.h <> n.h THEN 'changed' ELSE 'unchanged' END AS change
 FROM {OLD} o FULL JOIN {NEW} n ON o.doc_id = n.doc_id""")
def snapshot_diff(spark, sf_dir):
    return files.snapshot_diff(*_versions(spark, sf_dir), path="doc_id")


@query(f"""SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'remove' WHEN o.doc_id IS NULL OR o.h <> n.h THEN 'rebuild' ELSE 'reuse' END AS action
 FROM {OLD} o FULL JOIN {NEW} n ON o.doc_id = n.doc_id""")
def refresh_plan(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return files.refresh_plan(new, old.withColumn("config_digest", F.lit("c1")), "c1", path="doc_id")


@query(f"SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'remove' ELSE 'rebuild' END AS action FROM {OLD} o FULL JOIN {NEW} n ON o.doc_id = n.doc_id")
def refresh_plan_config(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return files.refresh_plan(new, old.withColumn("config_digest", F.lit("c1")), "c2", path="doc_id")


@query(f"""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0)
 SELECT n.doc_id, sha256(n.text) AS content_hash, CAST(strlen(n.text) AS BIGINT) AS size_bytes, coalesce(o.h = sha256(n.text), FALSE) AS reused FROM n LEFT JOIN {OLD} o ON o.doc_id = n.doc_id""")
def incremental_rescan(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    now = d.where("doc_id % 11 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    extract_ = lambda f: f.select("doc_id", "content_hash", F.octet_length("text").cast("long").alias("size_bytes"))
    before = extract_(d.where("doc_id % 7 <> 0").withColumn("content_hash", sha256(F.col("text"))))
    return files.rescan(before, now, extract_, path="doc_id")


URL_PATH = "regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[?#].*$', '')"


@query(f"""WITH p AS (SELECT string_split(CASE WHEN page_id % 3 = 0 THEN 'src/dist/' ELSE 'src/' END || {URL_PATH}, '/') AS l FROM pages)
 SELECT DISTINCT array_to_string(l[1:i], '/') AS directory FROM p, unnest(range(0, 10)) AS r(i) WHERE i < len(l) AND NOT list_contains(l[1:i], 'dist')""")
def watch_directories(spark, sf_dir):
    from .streaming.feed import watched

    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*/", ""), "[?#].*$", "")
    p = read(spark, sf_dir, "pages").select(F.concat(F.when(F.col("page_id") % 3 == 0, "src/dist/").otherwise("src/"), path).alias("path"))
    return watched(p)


@query(f"""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/' WHEN 1 THEN 'node_modules/' WHEN 2 THEN '../' ELSE '' END || {URL_PATH} AS path FROM pages)
 SELECT page_id, page_id % 4 = 3 AS inside, split_part(path, '/', -1) AS base FROM p""")
def project_scope(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*/", ""), "[?#].*$", "")
    head = F.element_at(F.array(F.lit("/"), F.lit("node_modules/"), F.lit("../"), F.lit("")), (F.col("page_id") % 4 + 1).cast("int"))
    p = read(spark, sf_dir, "pages").select("page_id", F.concat(head, path).alias("path"))
    return p.select("page_id", in_project(F.col("path")).alias("inside"), F.element_at(F.split("path", "/"), -1).alias("base"))


@query("""SELECT source, count(*) AS n_files, sha256(string_agg(p || chr(0) || sha256(text) || chr(0), '' ORDER BY p, sha256(text))) AS digest
 FROM (SELECT source, CAST(doc_id AS VARCHAR) AS p, text FROM documents) GROUP BY source""")
def workspace_digest(spark, sf_dir):
    return files.digest(read(spark, sf_dir, "documents"), F.col("doc_id").cast("string"), sha256(F.col("text")), ["source"])


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS content_hash FROM documents")
def fingerprints(spark, sf_dir):
    return files.fingerprints(read(spark, sf_dir, "documents"), "doc_id", "text")


@query("""SELECT count(*) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(max(strlen(text)) AS BIGINT) AS largest, CAST(sum(n_chars) AS BIGINT) AS n_symbols,
 count(*) <= 10000 AND sum(strlen(text)) <= 67108864 AND max(strlen(text)) <= 4194304 AND sum(n_chars) <= 50000 AS fits FROM documents""")
def payload_budget(spark, sf_dir):
    return files.within_budget(read(spark, sf_dir, "documents"), F.octet_length("text"), F.col("n_chars"))


@query("SELECT s AS selector, regexp_replace(s, '@[0-9]+$', '') AS path, CAST(regexp_extract(s, '@([0-9]+)$', 1) AS INT) AS line FROM (SELECT p_brand || '.' || p_name || '@' || p_partkey AS s FROM part)")
def selector_parse(spark, sf_dir):
    return parts(spark, sf_dir).select("selector", selector_path(F.col("selector")).alias("path"), selector_line(F.col("selector")).alias("line"))


# --- joins and aggregates ---------------------------------------------------

SPANS = "(SELECT user_id, event_type, epoch_us(min(ts)) AS s, epoch_us(max(ts)) AS e FROM events GROUP BY 1, 2)"


@query(f"""SELECT event_id, user_id, best.size AS size, best.event_type AS event_type FROM (
 SELECT p.event_id, p.user_id, min({{'size': s.e - s.s, 'event_type': s.event_type}}) AS best FROM events p JOIN {SPANS} s ON p.user_id = s.user_id AND s.s <= epoch_us(p.ts) AND s.e >= epoch_us(p.ts) GROUP BY 1, 2)""")
def containing_span(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    spans = e.groupBy("user_id", "event_type").agg(F.min("at").alias("s"), F.max("at").alias("e"))
    out = evidence.containing(e.select("event_id", "user_id", "at"), spans, ["user_id"], ["event_id"], "s", "e", "at", ["event_type"])
    return out.select("event_id", "user_id", F.col("span.size").alias("size"), F.col("span.event_type").alias("event_type"))


HALVES = "(SELECT *, event_id % 2 AS half FROM events)"


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY half, user_id, event_type ORDER BY event_id) AS rn FROM {HALVES}),
 c AS (SELECT half, user_id, event_type, count(*) AS n FROM {HALVES} GROUP BY 1, 2, 3)
 SELECT r.event_id, r.user_id, r.event_type, CASE WHEN r.half = 1 THEN 'added' ELSE 'removed' END AS change FROM r LEFT JOIN c ON c.half <> r.half AND c.user_id = r.user_id AND c.event_type = r.event_type
 WHERE r.rn > coalesce(c.n, 0)""")
def diagnostic_delta(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return delta.delta(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], ["event_id"])


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY half, user_id, event_type ORDER BY event_id) AS rn FROM {HALVES}),
 c AS (SELECT half, user_id, event_type, count(*) AS n FROM {HALVES} GROUP BY 1, 2, 3)
 SELECT r.event_id, r.user_id, r.event_type FROM r LEFT JOIN c ON c.half = 0 AND c.user_id = r.user_id AND c.event_type = r.event_type WHERE r.half = 1 AND r.rn > coalesce(c.n, 0) AND r.event_type = 'error'""")
def added_errors(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return delta.added_errors(delta.delta(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], ["event_id"]), "event_type", ["error"]).drop("change")


@query("""SELECT l_orderkey, l_linenumber, 1001 AS code, 'Error' AS category, 'discount ' || l_linestatus AS message FROM lineitem WHERE l_discount > 0.08 UNION ALL
 SELECT l_orderkey, l_linenumber, 1002, 'Warning', 'quantity ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) FROM lineitem WHERE l_quantity > 45""")
def diagnostics_scan(spark, sf_dir):
    rules = [
        diagnostics.Rule(1001, "Error", F.col("l_discount") > 0.08, F.concat(F.lit("discount "), F.col("l_linestatus"))),
        diagnostics.Rule(1002, "Warning", F.col("l_quantity") > 45, F.concat(F.lit("quantity "), F.col("l_quantity").cast("int").cast("string"))),
    ]
    return diagnostics.scan(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], rules)


@query("""SELECT o_orderpriority, o_orderkey, CAST(place AS INT) AS place, n, total, n > 3 AS has_more FROM (
 SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS place, count(*) OVER (PARTITION BY o_orderpriority) AS n, count(*) OVER () AS total FROM orders) WHERE place <= 3""")
def omission_details(spark, sf_dir):
    return evidence.omissions(read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], ["o_orderkey"], 3)


@query("SELECT count_if(event_type = 'error') AS n_error, count_if(event_type = 'view') AS n_view FROM events")
def category_counts(spark, sf_dir):
    return delta.category_counts(read(spark, sf_dir, "events"), "event_type", ["error", "view"])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, (SELECT count(*) FROM lineitem) AS total FROM lineitem GROUP BY 1, 2")
def omission_counts(spark, sf_dir):
    return evidence.omission_counts(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("""SELECT l_partkey, count(*) AS n_files, string_agg(s, ',' ORDER BY s) AS files FROM (SELECT DISTINCT l_partkey, CAST(l_suppkey AS VARCHAR) AS s FROM lineitem) GROUP BY 1""")
def affected_files(spark, sf_dir):
    return evidence.affected(read(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").cast("string").alias("s")), "l_partkey", "s")


@query("SELECT l_orderkey, min(l_suppkey) AS target FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def unique_target(spark, sf_dir):
    return graph.unique_targets(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_suppkey")


TOPK_ORDER = ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_shipdate")


@query("SELECT l_partkey, CAST(rn AS INT) AS rn, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, " + ", ".join(TOPK_ORDER) + ") AS rn FROM lineitem) WHERE rn <= 3")
def topk_neighbors(spark, sf_dir):
    return graph.topk_neighbours(read(spark, sf_dir, "lineitem"), 3, [F.desc("l_extendedprice"), *map(F.col, TOPK_ORDER)], key="l_partkey").select("l_partkey", "rn", "l_extendedprice")


@query("SELECT doc_id, running FROM (SELECT doc_id, CAST(sum(strlen(text)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM documents) WHERE running <= 500000")
def byte_budget_prefix(spark, sf_dir):
    return evidence.byte_prefix(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], F.octet_length("text"), 500_000).select("doc_id", "running")


@query("""SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def reference_scan(spark, sf_dir):
    from .operators.occurrences import contained

    return contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "item_id").select("item_id", "doc_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_pointer(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", at_pointer(F.col("props"), "/k", "bigint").alias("k"))


@query("SELECT p_partkey, CAST(i - 1 AS INT) AS pos, w[i] AS item FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), unnest(range(1, 20)) AS r(i) WHERE i <= len(w)")
def foreach_expand(spark, sf_dir):
    from .plans.batch import foreach

    return foreach(read(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("items")), "items", most=None).select("p_partkey", "pos", "item")


@query(f"""WITH hits AS (SELECT p_partkey FROM (SELECT * FROM {FOUND.format(q=TERM)} ORDER BY rank, p_brand, p_partkey LIMIT 10))
 SELECT l_partkey AS p_partkey, count(*) AS n_lines, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM hits) GROUP BY 1""")
def batch_pipeline(spark, sf_dir):
    """A document of two steps, the second one for each row of the first, as one plan."""
    from .plans.compiled import Tool, compiled, rows_of

    def found(calls: DataFrame) -> DataFrame:
        return search.pages(parts(spark, sf_dir), F.broadcast(calls), NAMES).select("pos", "place", "p_partkey")  # at most as many calls as items

    def usage(calls: DataFrame) -> DataFrame:
        lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey")
        return lines.join(F.broadcast(calls), "p_partkey").groupBy("pos", "p_partkey").agg(F.count("*").alias("n_lines"), F.countDistinct("l_suppkey").alias("n_suppliers"))

    tools = {"search": Tool({"query": "string", "limit": "int"}, found, ("place",)), "usage": Tool({"p_partkey": "bigint"}, usage)}
    document = {"version": 1, "steps": [{"id": "s", "tool": "search", "input": {"query": TERM, "limit": 10}}, {"id": "u", "tool": "usage", "foreach": {"$ref": "/s"}, "input": {"p_partkey": {"$item": "/p_partkey"}}}]}
    return rows_of(compiled(spark, document, tools), "p_partkey bigint, n_lines bigint, n_suppliers bigint", nested=True)


#: each nation's customers with a number of their own, a page of three for each, and the orders of those
FANNED = """(SELECT n_nationkey, c_custkey FROM nation, LATERAL (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 3))"""


@query(f"""WITH f AS {FANNED} SELECT list_position((SELECT list(DISTINCT n_nationkey ORDER BY n_nationkey) FROM nation), n_nationkey)::INT - 1 AS pos, c_custkey, count(o_orderkey) AS n_orders,
 (SELECT count(*) FROM nation) AS n_nations FROM f LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey, c_custkey""")
def batch_fan_out(spark, sf_dir):
    """Three steps: nations, a page of customers for each, and an emitted object that refers to both; then orders joined."""
    from .plans.compiled import Tool, compiled

    def nations(calls: DataFrame) -> DataFrame:
        return read(spark, sf_dir, "nation").join(F.broadcast(calls), F.lit(True)).select("pos", F.col("n_nationkey").alias("id"))

    def customers(calls: DataFrame) -> DataFrame:
        met = read(spark, sf_dir, "customer").join(F.broadcast(calls), F.col("c_nationkey") == F.col("nation"))
        place = F.row_number().over(W.partitionBy("pos").orderBy(F.desc("c_acctbal"), "c_custkey"))
        return met.withColumn("place", place).where("place <= few").select("pos", "place", F.col("c_custkey").alias("id"))

    tools = {"nations": Tool({}, nations, ("id",)), "customers": Tool({"nation": "bigint", "few": "int"}, customers, ("place",))}
    steps = [{"id": "n", "tool": "nations"}, {"id": "c", "tool": "customers", "foreach": {"$ref": "/n"}, "input": {"nation": {"$item": "/id"}, "few": 3}}]
    output = compiled(spark, {"version": 1, "steps": steps, "emit": {"all": {"$ref": "/c"}, "nations": {"$ref": "/n"}}}, tools)
    groups = output.select(F.size(F.variant_get("output", "$.nations", "array<variant>")).cast("long").alias("n_nations"), F.posexplode(F.variant_get("output", "$.all", "array<array<struct<id:bigint>>>")).alias("pos", "own"))
    each = groups.select("n_nations", "pos", F.explode("own").alias("x")).select("n_nations", "pos", F.col("x.id").alias("c_custkey"))
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return each.join(orders, "c_custkey", "left").select("pos", "c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "n_nations")


@query("SELECT event_id, CAST(least(value_sum, 1000) AS BIGINT) AS n FROM (SELECT user_id AS event_id, count(*) * 100 AS value_sum FROM events GROUP BY 1)")
def counters(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("event_id")).agg(saturated(F.count("*") * 100, 1000).alias("n"))


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1")
def percentiles(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.95).alias("p95"))


#: the secrets' rules as SQL, over one line after another of what the rule before has left
HIDE = f"""WITH a AS (SELECT doc_id, regexp_replace(text, '(?i)\\b(authorization)([ \\t]*[:=][ \\t]*)([^\\r\\n;]+)', '\\1\\2{hiding.HIDDEN}', 'g') AS text FROM documents),
 b AS (SELECT doc_id, regexp_replace(text, '(?i)\\bbearer([ \\t]+)([^\\r\\n;]+)', 'Bearer {hiding.HIDDEN}', 'g') AS text FROM a),
 c AS (SELECT doc_id, regexp_replace(text, '(?i)\\b({hiding.one_of(hiding.NAMED)})\\b\\s*[:=]\\s*("[^"]*"|''[^'']*''|[^\\s,;}}\\]]+)', '\\1={hiding.HIDDEN}', 'g') AS text FROM b),
 d AS (SELECT doc_id, regexp_replace(text, '(\\w://)[^\\s"''`]+@', '\\1{hiding.HIDDEN}@', 'g') AS text FROM c)
 SELECT doc_id, regexp_replace(text, '\\b{hiding.one_of(hiding.KEYS)}[0-9A-Za-z_-]{{8,}}\\b', '{hiding.HIDDEN}', 'g') AS text FROM d"""


@query(HIDE)
def redaction(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", hiding.without_secrets(F.col("text")).alias("text"))


LANES = ", ".join(f"sum(('0x' || substr(own, {8 * i + 1}, 8))::BIGINT) % 4294967296" for i in range(8))
CHILDREN = " || ".join(f"coalesce(max(CASE WHEN right(prefix, 1) = '{d}' THEN digest END), '-')" for d in "0123456789abcdef")
TREE = f"""WITH f AS (SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN doc_id % 50 = 7 THEN 'new ' ELSE '' END || coalesce(text, '')) AS h FROM documents WHERE doc_id % 50 <> 9),
 o AS (SELECT substr(sha256(path), 1, 2) AS prefix, sha256(path || chr(0) || h) AS own FROM f),
 a AS (SELECT prefix, count(*) AS n, sha256(concat_ws('|', 'v1', count(*), {LANES})) AS digest FROM o GROUP BY 1),
 b AS (SELECT left(prefix, 1) AS prefix, sum(n)::BIGINT AS n, sha256({CHILDREN}) AS digest FROM a GROUP BY 1),
 c AS (SELECT '' AS prefix, sum(n)::BIGINT AS n, sha256({CHILDREN}) AS digest FROM b)
 SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c"""


@query(TREE)
def tree_digest(spark, sf_dir):
    """The tree over all documents, brought up to date with those that change and go."""
    from .operators import tree_digest as tree

    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = docs.select("path", sha256(F.col("text")).alias("content_hash"))
    changed = docs.where("path % 50 = 7").select("path", sha256(F.concat(F.lit("new "), F.col("text"))).alias("content_hash"))
    old = tree.tree(hashed, F.col("path"), F.col("content_hash"), 2)
    fresh = tree.updated(old, hashed.where("path % 50 in (7, 9)"), changed, levels=2)
    return tree.replaced(old, fresh).select("prefix", "n", "digest")


@query("""SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN doc_id % 50 = 7 THEN 'new ' ELSE '' END || text) AS content_hash, 'op' AS last_kind, 2 AS n_receipts FROM documents WHERE doc_id % 50 <> 9 AND text IS NOT NULL""")
def reviewed_write(spark, sf_dir):
    """All documents as files, then one reviewed change of some; a change made on the older table is refused."""
    import uuid

    from .contracts import QueryError
    from .plans.checkpoints import folder
    from .plans.reviewed import ReviewedTable

    docs = read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), "text", "doc_id")
    table = ReviewedTable(spark, f"{folder(spark)}/reviewed-{uuid.uuid4().hex}")
    first = table.prepare(docs.select("path", "text"))
    late = table.prepare(docs.select("path", F.lit("late").alias("text")).limit(3))
    table.apply(first.operation_id, first.plan_hash)
    change = docs.where("doc_id % 50 in (7, 9)").select("path", F.when(F.col("doc_id") % 50 == 7, F.concat(F.lit("new "), F.col("text"))).alias("text"))
    second = table.prepare(change)
    table.apply(second.operation_id, second.plan_hash)
    try:
        table.apply(late.operation_id, late.plan_hash)
    except QueryError as e:
        if e.code != "STALE_WORKSPACE":
            raise
    last = table.receipts().agg(F.max_by(F.substring("operation_id", 1, 2), "place").alias("last_kind"), F.count("*").cast("int").alias("n_receipts"))
    return table.load().select("path", "content_hash").join(F.broadcast(last))  # one row


#: the newer version of documents: some lose or gain a line in the middle or at the end, some go, some come
NEWER = """(SELECT doc_id, text FROM documents WHERE doc_id % 10 > 4 UNION ALL SELECT doc_id, replace(text, chr(10), chr(10) || 'line ' || doc_id || chr(10)) FROM documents WHERE doc_id % 10 = 1
 UNION ALL SELECT doc_id, text || chr(10) || 'end' FROM documents WHERE doc_id % 10 = 2 UNION ALL SELECT doc_id, replace(text, 'e' || chr(10), chr(10)) FROM documents WHERE doc_id % 10 = 3 UNION ALL SELECT -1 - doc_id, text FROM documents WHERE doc_id % 10 = 4)"""


@query(f"SELECT doc_id, sha256(text) AS content_hash FROM {NEWER} WHERE text IS NOT NULL")
def line_diff_apply(spark, sf_dir):
    """Whole documents brought to their newer version by the hunks of their differences alone."""
    from .operators import line_diff

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    d, t, some = F.col("doc_id"), F.col("text"), lambda n: docs.where(F.col("doc_id") % 10 == n)
    newline = F.lit("\n")
    newer = docs.where("doc_id % 10 > 4").unionByName(some(1).select("doc_id", F.replace(t, newline, F.concat(F.lit("\nline "), d.cast("string"), newline)).alias("text")))
    newer = newer.unionByName(some(2).select("doc_id", F.concat(t, F.lit("\nend")).alias("text"))).unionByName(some(3).select("doc_id", F.replace(t, F.lit("e\n"), newline).alias("text")))
    newer = newer.unionByName(some(4).select((-1 - d).alias("doc_id"), "text"))
    found = line_diff.line_diff(docs, newer, "doc_id")
    return line_diff.applied(docs, found, "doc_id").where("text is not null").select("doc_id", sha256(t).alias("content_hash"))


@query("""WITH d AS (SELECT doc_id, text FROM documents), n AS (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN 'new ' || text ELSE text END AS text FROM documents WHERE doc_id % 50 <> 9 UNION ALL SELECT -1 - doc_id, text FROM documents WHERE doc_id % 50 = 3),
 p AS (SELECT CASE WHEN n.doc_id IS NULL THEN 'removed' WHEN d.doc_id IS NULL OR d.text <> n.text THEN 'rebuilt' ELSE 'reused' END AS name FROM d FULL JOIN n ON d.doc_id = n.doc_id)
 SELECT 'refresh' AS scope, name, least(count(*), 1000000) AS n FROM p GROUP BY 2""")
def observed_counters(spark, sf_dir):
    """What a refresh of all documents does, counted while its plan is written."""
    import uuid

    from .plans.checkpoints import folder
    from .plans.counters import Counters

    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_path"), "text")
    newer = docs.where("file_path % 50 <> 9").withColumn("text", F.when(F.col("file_path") % 50 == 7, F.concat(F.lit("new "), F.col("text"))).otherwise(F.col("text")))
    newer = newer.unionByName(docs.where("file_path % 50 = 3").withColumn("file_path", -1 - F.col("file_path")))
    hashed = lambda df: df.select("file_path", sha256(F.col("text")).alias("content_hash"))
    plan = files.refresh_plan(hashed(newer), hashed(docs).withColumn("config_digest", F.lit("c")))
    counters = Counters(spark, f"{folder(spark)}/counters-{uuid.uuid4().hex}")
    names = {"rebuilt": "rebuild", "reused": "reuse", "removed": "remove"}
    seen = counters.observed(plan, "refresh", **{name: F.count_if(F.col("action") == action) for name, action in names.items()})
    seen.write.format("noop").mode("overwrite").save()
    counters.flush()
    return counters.table()


@query()
def redaction_whole(spark, sf_dir):
    """Paths and secrets; the paths' rules look around, which the SQL cannot."""
    return read(spark, sf_dir, "documents").select("doc_id", hiding.redacted(F.col("text")).alias("text"))


@query(r"""SELECT p_partkey, CAST(strlen('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_size":' || p_size || '}') AS INT) AS json_bytes, CAST(len(string_split(p_name, ' ')) AS INT) AS n_items,
 to_base64(encode(p_name)) AS code, p_name AS decoded, regexp_matches(p_brand, '^[\p{L}_$][\p{L}\p{N}_$]*$') AS brand_is_name, regexp_matches(string_split(p_name, ' ')[1], '^[\p{L}_$][\p{L}\p{N}_$]*$') AS word_is_name FROM part""")
def text_functions(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    code = F.base64(F.col("p_name").cast("binary"))
    return p.select("p_partkey", json_bytes(F.struct("p_partkey", "p_name", "p_size")).alias("json_bytes"), array_items(F.to_json(F.split("p_name", " "))).alias("n_items"), code.alias("code"), utf8_text(strict_base64(code)).alias("decoded"), identifier(F.col("p_brand")).alias("brand_is_name"), identifier(F.element_at(F.split("p_name", " "), 1)).alias("word_is_name"))


@query("""SELECT p_partkey, '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_brand":"' || p_brand || '","p_size":' || p_size || '}' AS json FROM part""")
def json_sink(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct("p_partkey", "p_name", "p_brand", "p_size")).alias("json"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def canonical_time(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("iso", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return e.select("event_id", F.unix_millis(canonical_instant(F.col("iso"))).alias("ms"))


# --- graph ------------------------------------------------------------------

EDGES = """(SELECT kind || ':' || src || '->' || dst AS relationship_id, * FROM (
 SELECT 'reference' AS kind, 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst FROM customer UNION ALL
 SELECT 'import', 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL
 SELECT 'extends', 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation UNION ALL
 SELECT 'call', 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders UNION ALL
 SELECT DISTINCT 'implements', 'part:' || l_partkey, 'supplier:' || l_suppkey FROM lineitem))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def family(table: str | DataFrame, kind: str, src: str, a: str, dst: str, b: str) -> DataFrame:
        node = lambda p, c: F.concat(F.lit(f"{p}:"), F.col(c).cast("string"))
        rows = read(spark, sf_dir, table) if isinstance(table, str) else table
        return rows.select(F.lit(kind).alias("kind"), node(src, a).alias("src"), node(dst, b).alias("dst"))

    out = family("customer", "reference", "customer", "c_custkey", "nation", "c_nationkey")
    for f in (("supplier", "import", "supplier", "s_suppkey", "nation", "s_nationkey"), ("nation", "extends", "nation", "n_nationkey", "region", "n_regionkey"), ("orders", "call", "order", "o_orderkey", "customer", "o_custkey")):
        out = out.unionByName(family(*f))
    # made different as numbers, before names are made of them, in as many tasks as the rows ask for
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    lines = lines.repartition(graph.tasks(spark, lines.count()), "l_partkey", "l_suppkey").distinct()
    out = out.unionByName(family(lines, "implements", "part", "l_partkey", "supplier", "l_suppkey"))
    return out.withColumn("relationship_id", graph.relationship_id(F.col("kind"), F.col("src"), F.col("dst")))


@query("SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'implements' AS kind, l_partkey, l_suppkey FROM lineitem) GROUP BY 1")
def edge_dedup(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").select(F.lit("implements").alias("kind"), F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("relationship_id"))
    return graph.dedup(e).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT kind, count(DISTINCT relationship_id) AS n FROM {EDGES} WHERE kind IN ('call', 'implements') GROUP BY 1")
def edge_collect(spark, sf_dir):
    e = edges(spark, sf_dir)
    one, other = e.where("kind = 'call'"), e.where("kind = 'implements' or kind = 'call'")
    rows = read(spark, sf_dir, "lineitem").count() + 2 * read(spark, sf_dir, "orders").count()
    return graph.collect(one, other, rows=rows).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT node FROM (SELECT src AS node FROM {EDGES} UNION ALL SELECT dst FROM {EDGES}) WHERE NOT starts_with(node, 'nation:') AND NOT starts_with(node, 'region:')")
def edge_integrity(spark, sf_dir):
    known = read(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("node")).unionByName(read(spark, sf_dir, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("node")))
    return graph.dangling(edges(spark, sf_dir), known)


TRUSTED = "CASE l_returnflag WHEN 'R' THEN 'syntax' ELSE 'compiler' END AS provenance, CASE l_linestatus WHEN 'F' THEN 'exact' ELSE 'high' END AS confidence, CASE WHEN l_linenumber % 5 = 0 THEN 'unresolved' ELSE 'resolved' END AS resolution, CASE WHEN l_linenumber % 3 = 0 THEN 'stale' ELSE 'fresh' END AS state"


@query(f"""WITH e AS (SELECT l_linenumber % 2 = 0 AS call, {TRUSTED} FROM lineitem), a AS (SELECT *, provenance = 'compiler' AND confidence = 'exact' AND resolution = 'resolved' AND state = 'fresh' AS ok FROM e)
 SELECT provenance, confidence, resolution, state, ok AS compiler_authoritative, ok AND call AS exact_call, count(*) AS n FROM a GROUP BY ALL""")
def edge_authority(spark, sf_dir):
    kind = F.when(F.col("l_linenumber") % 2 == 0, "call").otherwise("reference")
    state = F.when(F.col("l_linenumber") % 3 == 0, "stale").otherwise("fresh")
    rows = read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("dst"), kind.alias("kind"),
        F.when(F.col("l_returnflag") == "R", "syntax").otherwise("compiler").alias("provenance"), F.when(F.col("l_linestatus") == "F", "exact").otherwise("high").alias("confidence"),
        F.when(F.col("l_linenumber") % 5 == 0, "unresolved").otherwise("resolved").alias("resolution"), state.alias("state"),
        F.when(state == "stale", F.array(F.lit("source_change"))).otherwise(F.array().cast("array<string>")).alias("causes"),
    )
    built = graph.build(rows).withColumn("exact_call", graph.exact(calls=True))
    return built.groupBy("provenance", "confidence", "resolution", "state", "compiler_authoritative", "exact_call").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT 'reference:order:' || o_orderkey || '->customer:' || c_custkey AS relationship_id FROM orders JOIN customer ON c_custkey = o_custkey")
def reference_edges(spark, sf_dir):
    node = lambda p, c: F.concat(F.lit(f"{p}:"), F.col(c).cast("string"))
    uses = read(spark, sf_dir, "orders").select(node("order", "o_orderkey").alias("src"), F.col("o_custkey").alias("symbol_id"))
    declared = read(spark, sf_dir, "customer").select(node("customer", "c_custkey").alias("dst"), F.col("c_custkey").alias("symbol_id"))
    return graph.reference_edges(uses, declared).select("relationship_id")


@query("SELECT DISTINCT CASE WHEN n_regionkey < 3 THEN 'extends' ELSE 'implements' END AS kind, 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation")
def heritage_edges(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    clauses = n.select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("src"), F.col("n_regionkey").alias("symbol_id"), F.when(F.col("n_regionkey") < 3, "extends").otherwise("implements").alias("clause"))
    declared = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("symbol_id"), F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("dst"))
    return graph.heritage_edges(clauses, declared).select("kind", "src", "dst")


@query("""SELECT DISTINCT kind, src_file, CASE WHEN name IS NULL THEN dst_file || '|<module>@1' ELSE dst END AS dst FROM (
 SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'import' ELSE 'export' END AS kind, 's' || s_suppkey AS src_file, 'n' || s_nationkey AS dst_file, CASE WHEN s_suppkey % 3 > 0 THEN 'c' || (s_suppkey % 50) END AS name FROM supplier)
 LEFT JOIN (SELECT 'n' || c_nationkey AS file, 'c' || c_custkey AS symbol, 'n' || c_nationkey || '|c' || c_custkey AS dst FROM customer) ON file = dst_file AND symbol = name WHERE name IS NULL OR dst IS NOT NULL""")
def module_edges(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    n = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    used = s.select(F.when(F.col("s_suppkey") % 2 == 0, "import").otherwise("export").alias("kind"), n("s", "s_suppkey").alias("src_file"), n("n", "s_nationkey").alias("dst_file"), F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("c"), (F.col("s_suppkey") % 50).cast("string"))).alias("name"))
    declared = read(spark, sf_dir, "customer").select(n("n", "c_nationkey").alias("file"), n("c", "c_custkey").alias("name"), F.concat(n("n", "c_nationkey"), F.lit("\0"), n("c", "c_custkey")).alias("dst"))
    out = graph.module_edges(used, declared)
    return out.select("kind", F.element_at(F.split("src", "\0"), 1).alias("src_file"), F.translate("dst", "\0", "|").alias("dst"))


@query(f"""WITH e AS MATERIALIZED {EDGES}, n AS (SELECT src AS node, dst AS other, relationship_id FROM e UNION ALL SELECT dst, src, relationship_id FROM e)
 SELECT node, CAST(rn AS INT) AS rn, other, relationship_id FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY other, relationship_id) AS rn FROM n) WHERE rn <= 2""")
def neighbor_order(spark, sf_dir):
    near = graph.neighbours(edges(spark, sf_dir), "both")
    return graph.topk_neighbours(near, 2, [F.col("other"), F.col("relationship_id")]).select("node", "rn", "other", "relationship_id")


@query(f"""WITH n AS (SELECT relationship_id, kind, src AS other, row_number() OVER (ORDER BY src, relationship_id) AS rn FROM {EDGES} WHERE dst = 'nation:3' AND kind IN ('reference', 'import')),
 c AS (SELECT * FROM n WHERE rn <= 40), f AS (SELECT * FROM c WHERE other <> (SELECT min(other) FROM c))
 SELECT relationship_id, kind, other, (SELECT count(*) FROM c) AS work_items, (SELECT count(*) FROM n) > 40 AS work_limit_reached, CAST(1 AS BIGINT) AS excluded, (SELECT count(*) FROM n) > 40 OR (SELECT count(*) FROM f) > 10 AS incomplete
 FROM f ORDER BY rn LIMIT 10""")
def incident_edges(spark, sf_dir):
    e = edges(spark, sf_dir)
    first = graph.neighbours(e.where(F.col("kind").isin("reference", "import")), "incoming").where("node = 'nation:3'").agg(F.min("other")).first()[0]
    return graph.incident(e, "nation:3", "incoming", ["reference", "import"], max_edges=10, work=40, exclude=[first])


@query("""WITH t AS (SELECT l_orderkey, min(l_suppkey) AS target FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem ORDER BY 1, 2 LIMIT 3000) GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1)
 SELECT l_orderkey, target, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)) > 3000 OR (SELECT count(*) FROM t) > 100 AS incomplete FROM t ORDER BY 1 LIMIT 100""")
def call_edges(spark, sf_dir):
    return graph.call_edges(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_suppkey", most=100, work=3000)


def _bfs(start: str, step: str, depth: int) -> str:
    return f"""WITH RECURSIVE e AS MATERIALIZED {EDGES}, r(node, depth) AS (SELECT '{start}', 0 UNION SELECT {step}), b AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1)
 SELECT node, CAST(depth AS INT) AS depth, depth = 1 AS direct FROM b""".replace("{depth}", str(depth))


@query(_bfs("region:1", "e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < {depth}", 4))
def impact_incoming(spark, sf_dir):
    return graph.impact(edges(spark, sf_dir), "region:1", "incoming", 4)


@query(_bfs("order:1", "e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < {depth}", 4))
def impact_outgoing(spark, sf_dir):
    return graph.impact(edges(spark, sf_dir), "order:1", "outgoing", 4)


@query(_bfs("nation:3", "CASE WHEN e.src = r.node THEN e.dst ELSE e.src END, r.depth + 1 FROM r JOIN e ON e.src = r.node OR e.dst = r.node WHERE r.depth < {depth}", 2))
def impact_both(spark, sf_dir):
    return graph.impact(edges(spark, sf_dir), "nation:3", "both", 2)


@query(f"""WITH e AS MATERIALIZED {EDGES}, n AS (SELECT src AS node FROM e WHERE dst = 'region:1'), c AS (SELECT e.src AS node, row_number() OVER (ORDER BY n.node, e.src, e.relationship_id) AS rn FROM n JOIN e ON e.dst = n.node),
 r AS (SELECT 'region:1' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM n UNION ALL SELECT node, 2 FROM c WHERE rn <= 99 - (SELECT count(*) FROM n)),
 why AS (SELECT (SELECT count(*) FROM e JOIN r ON e.dst = r.node AND r.depth = 2) > 0 AS deep, (SELECT count(*) FROM c) > 99 - (SELECT count(*) FROM n) AS wide)
 SELECT node, depth, depth = 1 AS direct, deep OR wide AS incomplete, concat_ws(',', CASE WHEN deep THEN 'depth_limit' END, CASE WHEN wide THEN 'record_limit' END) AS reasons FROM r, why""")
def impact_budgeted(spark, sf_dir):
    found = graph.bounded_impact(edges(spark, sf_dir), "region:1", "incoming", 2, 100, 200)
    return spark.createDataFrame([(n, d, x, found.incomplete, ",".join(found.reasons)) for n, d, x in found.ordered_nodes()], "node string, depth int, direct boolean, incomplete boolean, reasons string")


@query("""WITH c AS (SELECT 'customer:' || c_custkey AS node, 'nation:' || c_nationkey AS nation, 'region:' || n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey), o AS (SELECT 'order:' || o_orderkey AS node, 'customer:' || o_custkey AS customer FROM orders)
 SELECT DISTINCT node, ancestor FROM (SELECT node, nation AS ancestor FROM c UNION ALL SELECT node, region FROM c UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation
 UNION ALL SELECT node, customer FROM o UNION ALL SELECT o.node, c.nation FROM o JOIN c ON c.node = o.customer UNION ALL SELECT o.node, c.region FROM o JOIN c ON c.node = o.customer)""")
def inheritance_closure(spark, sf_dir):
    e = edges(spark, sf_dir).where(F.col("kind").isin("reference", "extends", "call"))
    return graph.ancestors(e)


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst FROM customer WHERE c_custkey % 7 <> 0 UNION
 SELECT 'customer:' || c_custkey, 'customer:' || (c_custkey + 1) FROM customer WHERE c_custkey % 7 = 0 UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation WHERE n_nationkey % 5 <> 2 UNION
 SELECT 'region:' || r_regionkey, 'nation:' || (r_regionkey * 5) FROM region UNION SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders WHERE o_orderstatus <> 'P'),
 p(node, ancestor) AS (SELECT src, dst FROM e UNION SELECT p.node, e.dst FROM p JOIN e ON e.src = p.ancestor) SELECT node, ancestor FROM p WHERE node <> ancestor""")
def maintained_closure(spark, sf_dir):
    """A stored closure after two updates: edges that go, edges that come (new ones in a row, and in a circle)."""
    import uuid

    from .operators.closure import StoredClosure
    from .plans.checkpoints import folder

    e = edges(spark, sf_dir).where(F.col("kind").isin("reference", "extends", "call")).select("src", "dst")
    number = F.regexp_extract("src", "[0-9]+", 0).cast("long")
    node = lambda p, c: F.concat(F.lit(f"{p}:"), c.cast("string"))
    state = read(spark, sf_dir, "orders").select(node("order", F.col("o_orderkey")).alias("src"), node("customer", F.col("o_custkey")).alias("dst"), "o_orderstatus")
    stored = StoredClosure(spark, f"{folder(spark)}/closure-{uuid.uuid4().hex}")
    stored.update(e.where(~F.col("src").startswith("order:")).unionByName(state.where("o_orderstatus <> 'F'").drop("o_orderstatus")), e.limit(0))
    seventh = read(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(node("customer", F.col("c_custkey")).alias("src"), node("customer", F.col("c_custkey") + 1).alias("dst"))
    back = read(spark, sf_dir, "region").select(node("region", F.col("r_regionkey")).alias("src"), node("nation", F.col("r_regionkey") * 5).alias("dst"))
    stored.update(seventh.unionByName(back), e.where(F.col("src").startswith("customer:") & (number % 7 == 0)))
    stored.update(state.where("o_orderstatus = 'F'").drop("o_orderstatus"), e.where(F.col("src").startswith("nation:") & (number % 5 == 2)).unionByName(state.where("o_orderstatus = 'P'").drop("o_orderstatus")))
    return stored.pairs()


#: layer by layer, of each layer the first path as JSON; a node of an earlier layer is not entered again
PATHS = f"""WITH RECURSIVE e AS MATERIALIZED {EDGES}, n AS MATERIALIZED (SELECT src AS node, dst AS other, relationship_id AS id FROM e {{both}}),
 p(node, depth, path) USING KEY (node) AS (SELECT '{{root}}', 0, '' UNION
 SELECT n.other, p.depth + 1, min(CASE WHEN p.depth = 0 THEN '' ELSE p.path || '","' END || n.id) FROM p JOIN n ON n.node = p.node
 WHERE NOT EXISTS (SELECT 1 FROM recurring.p r WHERE r.node = n.other) GROUP BY 1, 2)
 SELECT node, depth::INTEGER AS depth, {{path}} AS path FROM p WHERE depth > 0"""


@query(PATHS.format(root="part:0", both="", path="replace(path, '\",\"', '|')"))
def canonical_paths(spark, sf_dir):
    """Over all edges, to any depth."""
    out = graph.canonical_paths(edges(spark, sf_dir), "part:0")
    return out.select("node", "depth", F.array_join("path", "|").alias("path"))


@query("""WITH e AS (SELECT DISTINCT 'call:order:' || l_orderkey || '->part:' || l_partkey AS id, 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst FROM lineitem UNION ALL SELECT DISTINCT 'call:part:' || l_partkey || '->supplier:' || l_suppkey, 'part:' || l_partkey, 'supplier:' || l_suppkey FROM lineitem),
 a AS (SELECT dst AS node, id FROM e WHERE src = 'order:7')
 SELECT node AS endpoint, id AS path FROM a UNION ALL SELECT e.dst, min(a.id || '|' || e.id) FROM a JOIN e ON e.src = a.node GROUP BY 1""")
def call_spines(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    node = lambda p, c: F.concat(F.lit(f"{p}:"), F.col(c).cast("string"))
    calls = lines.select(node("order", "l_orderkey").alias("src"), node("part", "l_partkey").alias("dst")).unionByName(lines.select(node("part", "l_partkey").alias("src"), node("supplier", "l_suppkey").alias("dst"))).distinct().withColumn("kind", F.lit("call"))
    calls = calls.withColumn("relationship_id", graph.relationship_id(F.col("kind"), F.col("src"), F.col("dst")))
    found = graph.call_spines(calls, "order:7", "outgoing", 2, 1000, 5000)
    return spark.createDataFrame([(p["endpoint"], "|".join(p["relationship_ids"])) for p in found.paths], "endpoint string, path string")


@query(PATHS.format(root="region:2", both="UNION ALL SELECT dst, src, relationship_id FROM e", path="array_to_string(list_reverse(string_split(path, '\",\"')), '|')"))
def shortest_path(spark, sf_dir):
    """From every node to one, over all edges either way, to any depth."""
    out = graph.shortest_paths(edges(spark, sf_dir), "region:2")
    return out.select("node", "depth", F.array_join("path", "|").alias("path"))


@query("""WITH n AS (SELECT 'customer:' || c_custkey AS node, c_mktsegment || '/test/' || (c_custkey % 7) AS file FROM customer WHERE c_nationkey = 3)
 SELECT file, 'direct_compiler_reference' AS reason, 'exact' AS confidence, 1 AS depth, 'reference:' || min(node) || '->nation:3' AS path FROM n GROUP BY 1""")
def test_candidates(spark, sf_dir):
    e = edges(spark, sf_dir).where(F.col("kind").isin("reference", "import"))
    place = F.concat(F.col("c_mktsegment"), F.lit("/test/"), (F.col("c_custkey") % 7).cast("string"))
    files = read(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("node"), place.alias("file"))
    found = evidence.proven_candidates(e, "nation:3", files)
    return found.select("file", "reason", "confidence", "depth", F.array_join("relationship_ids", "|").alias("path"))


@query("""WITH b AS (SELECT DISTINCT p_brand, 'Brand#' || (CAST(substr(p_brand, 7, 1) AS INT)) AS base FROM part),
 m AS (SELECT DISTINCT p_brand, split_part(p_name, ' ', 1) AS name FROM part), k AS (SELECT DISTINCT base AS p_brand, name FROM m JOIN b USING (p_brand)),
 o AS (SELECT m.p_brand || '.' || m.name AS src, k.p_brand || '.' || k.name AS dst FROM m JOIN b ON b.p_brand = m.p_brand JOIN k ON k.p_brand = b.base AND k.name = m.name WHERE b.base <> m.p_brand)
 SELECT src, dst FROM o UNION SELECT dst, src FROM o""")
def member_override(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    bases = p.select(F.col("p_brand").alias("src"), F.concat(F.lit("Brand#"), F.substring("p_brand", 7, 1)).alias("dst")).distinct()
    own = p.select(F.col("p_brand").alias("container"), F.element_at(F.split("p_name", " "), 1).alias("name")).distinct()
    up = own.join(bases, own.container == bases.src).select(F.col("dst").alias("container"), "name").distinct()
    members = own.unionByName(up).distinct().withColumn("symbol", F.concat_ws(".", "container", "name"))
    return graph.override_edges(members, bases)


# --- streams and stores -----------------------------------------------------


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM events),
 s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
 SELECT user_id, count(*) AS n_events, count(DISTINCT event_type) AS n_paths, count(DISTINCT event_type) > 3 AS overflow FROM s GROUP BY user_id, sid""")
def debounce_sessions(spark, sf_dir):
    from .streaming.feed import debounced

    e = read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("path"))
    return debounced(e, "user_id", "30 minutes", most=3).select("user_id", "n_events", "n_paths", "overflow")


@query("""WITH e AS (SELECT user_id, event_id AS seq, event_id % 2 = 0 AS evidence, CASE event_type WHEN 'purchase' THEN 'sync_succeeded' WHEN 'error' THEN 'index_failed' WHEN 'signup' THEN 'index_recovered' WHEN 'view' THEN 'source_changed'
 ELSE CASE event_id % 4 WHEN 0 THEN 'config_changed' WHEN 1 THEN 'compiler_rebuild_started' WHEN 2 THEN 'sync_failed' ELSE 'stale_detected' END END AS event FROM events),
 l AS (SELECT user_id, max(seq) FILTER (WHERE event = 'index_failed') AS failed, max(seq) FILTER (WHERE event = 'index_recovered') AS recovered, arg_max(event, seq) FILTER (WHERE event <> 'index_failed') AS last, arg_max(evidence, seq) FILTER (WHERE event <> 'index_failed') AS proof FROM e GROUP BY 1)
 SELECT user_id, CASE WHEN coalesce(failed, -1) > coalesce(recovered, -1) THEN 'degraded' WHEN last IN ('sync_failed', 'stale_detected') THEN 'stale' WHEN last = 'compiler_rebuild_started' THEN 'rebuilding' WHEN last = 'sync_succeeded' AND proof THEN 'fresh' ELSE 'pending' END AS state FROM l""")
def freshness_fold(spark, sf_dir):
    from .streaming.freshness import fold

    e = read(spark, sf_dir, "events")
    click = F.element_at(F.array(*map(F.lit, ("config_changed", "compiler_rebuild_started", "sync_failed", "stale_detected"))), (F.col("event_id") % 4 + 1).cast("int"))
    kind = F.when(F.col("event_type") == "purchase", "sync_succeeded").when(F.col("event_type") == "error", "index_failed").when(F.col("event_type") == "signup", "index_recovered").when(F.col("event_type") == "view", "source_changed").otherwise(click)
    status = e.select("user_id", F.col("event_id").alias("seq"), kind.alias("event"), (F.col("event_id") % 2 == 0).alias("evidence"), F.lit(None).cast("string").alias("detail"))
    return fold(status, "user_id").select("user_id", "state")


LAST = "(SELECT user_id, max(event_id) AS last FROM events GROUP BY 1)"


@query(f"SELECT user_id, CAST(row_number() OVER (ORDER BY last DESC, user_id) AS INT) AS place, row_number() OVER (ORDER BY last DESC, user_id) <= 8 AS kept FROM {LAST}")
def lru_eviction(spark, sf_dir):
    last = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("last"))
    return delta.evicted(last, 8, F.col("last"), F.col("user_id")).select("user_id", "place", "kept")


@query("SELECT event_id FROM events, (SELECT max(ts) AS now FROM events) WHERE ts + INTERVAL 15 MINUTE > now")
def ttl_prune(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    return delta.live(e.join(F.broadcast(now)), F.col("ts") + F.expr("INTERVAL 15 MINUTES"), F.col("now")).select("event_id")


@query("SELECT user_id, min(event_id) AS first_event, count(*) - 1 AS replays FROM events GROUP BY 1")
def receipts(spark, sf_dir):
    return delta.receipts(read(spark, sf_dir, "events"), "user_id", [F.col("event_id")]).select("user_id", F.col("first.event_id").alias("first_event"), "replays")


@query("""SELECT source, count(*) AS n_changes, sha256(string_agg(k || '|' || sha256(text) || '|' || sha256(text || '!') || chr(10), '' ORDER BY k, sha256(text))) AS plan_hash
 FROM (SELECT source, CAST(doc_id AS VARCHAR) AS k, text FROM documents) GROUP BY 1""")
def plan_hash(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return delta.plan_hash(d, F.col("doc_id"), sha256(F.col("text")), sha256(F.concat("text", F.lit("!"))), ["source"])


@query(_page_sql(TERM, 0, 100, "CAST(rank AS INT) AS rank, p_brand, selector, p_partkey"))
def toon_roundtrip(spark, sf_dir):
    """A page written as compact text and read back."""
    from .functions.toon import decode, encode_checked

    rows = [r.asDict() for r in search.ranked_page(parts(spark, sf_dir), TERM, NAMES, limit=100).select(*PAGE_COLUMNS).orderBy("rank", "p_brand", "p_partkey").collect()]
    back = decode(encode_checked(rows))
    return spark.createDataFrame([tuple(r[c] for c in PAGE_COLUMNS) for r in back], "rank int, p_brand string, selector string, p_partkey bigint, total bigint, has_more boolean, next_offset bigint")


@query(f"""WITH f AS (SELECT *, row_number() OVER (ORDER BY rank, p_brand, p_partkey) AS rn FROM {FOUND.format(q=TERM)})
 SELECT CAST(rn AS INT) AS place, p_brand AS file, selector, p_type || ' ' || p_name AS signature, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 20 AS has_more FROM f WHERE rn <= 20""")
def explore(spark, sf_dir):
    hits = search.ranked_page(parts(spark, sf_dir), TERM, NAMES, limit=20).orderBy("rank", "p_brand", "p_partkey").collect()
    clusters = [{"symbol": {"file": r.p_brand, "selector": r.selector, "kind": r.p_type, "signature": f"{r.p_type} {r.p_name}"}} for r in hits]
    shown = evidence.present(clusters, hits[0].total if hits else 0, 64 << 10)
    rows = [(i, x["file"], x["selector"], x["signature"], shown["page"]["total"], shown["page"]["has_more"]) for i, x in enumerate(shown["symbols"], 1)]
    return spark.createDataFrame(rows, "place int, file string, selector string, signature string, total bigint, has_more boolean")
