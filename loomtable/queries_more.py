"""Further queries: files and their round trips, whole steps of ``TableSet``, linking, and operators that the first module has none for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtable.functions import text as T
from loomtable.operators import cells as C
from loomtable.operators import clean, evaluate, link, profile, similarity, stitching, unpivot
from loomtable.operators.scratch import scratch
from loomtable.plans.tableset import TableSet
from loomtable.queries import _query, _t
from loomtable.sources import files, gold, kb


def _nation_tables(spark, sf) -> DataFrame:
    """A table per region: a header that is repeated as the first body row, an empty row and an empty column, then the nations."""
    n = _t(spark, sf, "nation").join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_name"], F.lit(""), x["n_nationkey"].cast("string")))
    head = F.array(F.array(F.lit("Name"), F.lit(""), F.lit("Key")))
    rows = n.groupBy(F.col("r_name").alias("table_id")).agg(row.alias("rows"))
    body = F.concat(head, F.array(F.array(F.lit(""), F.lit(" "), F.lit(""))), F.col("rows"))
    return rows.select("table_id", F.col("table_id").alias("pg_title"), head.alias("head"), body.alias("body"), F.lit(3).alias("num_cols"), F.size(body).alias("num_rows"))


_NATION = "(SELECT r_name AS table_id, n_name, n_nationkey, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS INTEGER) AS ri FROM nation JOIN region ON n_regionkey = r_regionkey)"
_CLEAN = f"SELECT table_id, 'body' AS section, ri, 0 AS ci, n_name AS text FROM {_NATION} UNION ALL SELECT table_id, 'body', ri, 1, n_nationkey::VARCHAR FROM {_NATION} UNION ALL SELECT r_name, 'head', 0, 0, 'Name' FROM region UNION ALL SELECT r_name, 'head', 0, 1, 'Key' FROM region"


@_query(_CLEAN)
def restructured_tables(spark, sf):
    return C.to_cells(TableSet(_nation_tables(spark, sf)).reshape().tables)


@_query(_CLEAN.replace("'body' AS section, ri", "'body' AS section, ri + 2 AS ri").replace("'body', ri, 1", "'body', ri + 2, 2").replace("'head', 0, 1, 'Key'", "'head', 0, 2, 'Key'")
        + " UNION ALL SELECT r_name, 'head', 0, 1, '' FROM region UNION ALL SELECT table_id, 'body', ri + 2, 1, '' FROM " + _NATION + " UNION ALL SELECT r_name, 'body', ri, ci, text FROM region, (VALUES (0,0,'Name'),(0,1,''),(0,2,'Key'),(1,0,''),(1,1,' '),(1,2,'')) v(ri, ci, text)")
def jsonl_round_trip(spark, sf):
    """Tables dumped as JSON lines, broken lines put beside them, and all loaded again."""
    path = scratch(spark, "jsonl")
    TableSet(_nation_tables(spark, sf)).dump(path)
    bad = spark.createDataFrame([("{broken",), ('{"_id": "no data"}',), ("",)], "value string")
    bad.coalesce(1).write.mode("append").text(path)
    return C.to_cells(TableSet.load(spark, path).tables)


@_query("SELECT table_id FROM (SELECT DISTINCT r_name AS table_id FROM region) WHERE table_id LIKE 'A%'")
def headerless_and_wide_dropped(spark, sf):
    t = _nation_tables(spark, sf).withColumn("head", F.when(F.col("table_id").startswith("A"), F.col("head")).otherwise(F.array(F.array(F.lit(" "), F.lit("")))))
    wide = t.withColumn("table_id", F.concat(F.lit("wide"), "table_id")).withColumn("num_cols", F.lit(100))
    return clean.drop_wide(TableSet(t.unionByName(wide)).discard_headerless().tables).select("table_id")


def _csv(spark: SparkSession, df: DataFrame, folder: str, name: str, header: bool = False) -> str:
    """``df`` as one CSV file of a given name."""
    part = f"{folder}/parts-{name}"
    df.coalesce(1).write.option("escape", '"').option("header", header).csv(part)
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(part).getFileSystem(spark._jsc.hadoopConfiguration())
    (found,) = [s.getPath() for s in system.globStatus(path(f"{part}/part-*.csv"))]
    system.rename(found, path(f"{folder}/{name}"))
    system.delete(path(part), True)
    return f"{folder}/{name}"


@_query("SELECT 'suppliers' AS table_id, CAST(dense_rank() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS ri, CAST(ci AS INTEGER) AS ci, CASE ci WHEN 0 THEN s_suppkey::VARCHAR ELSE s_name || ', \"' || chr(10) || '\"' END AS text FROM supplier, range(2) c(ci)")
def csv_tables(spark, sf):
    """A file with quotes, commas and line breaks in fields as one table."""
    df = _t(spark, sf, "supplier").orderBy("s_suppkey").select("s_suppkey", F.concat("s_name", F.lit(', "\n"')).alias("name"))
    path = _csv(spark, df, scratch(spark, "csv"), "suppliers.csv")
    return C.to_cells(TableSet.load(spark, path).tables).filter("section = 'body'").drop("section")


@_query(f"SELECT '#0' AS id, text, CAST(count(*) AS BIGINT) AS n FROM ({_CLEAN}) GROUP BY ALL")
def wdc_round_trip(spark, sf):
    path = scratch(spark, "wdc")
    clean_ = TableSet(_nation_tables(spark, sf)).reshape().tables
    files.to_wdc(clean_).select("json").write.text(path)
    back = C.to_cells(files.read_wdc(spark, path))
    return back.groupBy(F.lit("#0").alias("id"), "text").agg(F.count("*").alias("n"))


@_query("SELECT url, nullif(regexp_extract(url, '/([^/?#]+)$', 1), '') AS about, md5(html) AS page FROM pages WHERE html IS NOT NULL AND regexp_matches(url, '^\\S+$')")
def line_pages(spark, sf):
    p = _t(spark, sf, "pages").filter(F.col("html").isNotNull() & F.col("url").rlike(r"^\S+$"))
    path = scratch(spark, "lines")
    p.select(F.concat("url", F.lit(" "), F.expr("regexp_replace(substring(to_json(named_struct('h', html)), 6), '}$', '')")).alias("value")).write.text(path)
    return files.line_pages(spark, path, title="/([^/?#]+)$").select("url", "about", F.md5("html").alias("page"))


@_query("SELECT url, 'p' || page_id AS about, md5(html) AS page FROM pages WHERE html IS NOT NULL AND regexp_matches(url, '^[^\\s?]+$')")
def warc_pages(spark, sf):
    p = _t(spark, sf, "pages").filter(F.col("html").isNotNull() & F.col("url").rlike(r"^[^\s?]+$"))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\n\r\n"), F.col("html"))
    record = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), "url", F.lit("?about=p"), F.col("page_id").cast("string"), F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)
    path = scratch(spark, "warcs")
    p.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)
    return files.warc_pages(spark, path).select("url", "about", F.md5("html").alias("page"))


@_query("SELECT 'n' || n_nationkey AS s, 'http://www.w3.org/2000/01/rdf-schema#label' AS p, n_name || ' \"x\"' AS o, 'literal' AS o_kind, 'en' AS o_lang FROM nation UNION ALL SELECT 'n' || n_nationkey, 'in', 'r' || n_regionkey, 'uri', NULL FROM nation UNION ALL SELECT 'n' || n_nationkey, 'key', n_nationkey::VARCHAR, 'literal', NULL FROM nation")
def ntriples_scan(spark, sf):
    n = _t(spark, sf, "nation")
    s = F.concat(F.lit("<n"), "n_nationkey", F.lit("> "))
    lines = [
        F.concat(s, F.lit('<http://www.w3.org/2000/01/rdf-schema#label> "'), "n_name", F.lit(' \\"x\\""@en .')), F.concat(s, F.lit('<http://www.w3.org/2000/01/rdf-schema#label> "'), "n_name", F.lit('"@de .')),
        F.concat(s, F.lit("<in> <r"), "n_regionkey", F.lit("> .")), F.concat(s, F.lit('<key> "'), "n_nationkey", F.lit('"^^<int> .')), F.lit("# no triple"),
    ]
    path = scratch(spark, "nt")
    n.select(F.explode(F.array(*lines)).alias("value")).write.text(path)
    return kb.ntriples(spark, path, languages=["en"]).select("s", "p", F.replace("o", F.lit('\\"'), F.lit('"')).alias("o"), "o_kind", "o_lang")


@_query("SELECT 'Q' || p_partkey AS uri, lower(p_name) AS txt, 1.0::DOUBLE AS score, 'statement' AS kind, 'Q' || p_size AS value FROM part UNION ALL SELECT 's' || p_partkey, 'year', NULL, 'qualifier', '+' || (1990 + p_size) FROM part")
def wikidata_flatten(spark, sf):
    """Labels with their statements' values, and qualifiers, from a dump's JSON lines."""
    snak = lambda prop, value: F.struct(F.lit(prop).alias("property"), value.alias("datavalue"))
    item = F.struct(F.lit("wikibase-entityid").alias("type"), F.struct(F.concat(F.lit("Q"), "p_size").alias("id")).alias("value"))
    year = F.struct(F.lit("time").alias("type"), F.struct(F.concat(F.lit("+"), (F.col("p_size") + 1990).cast("string")).alias("time")).alias("value"))
    claim = F.struct(F.concat(F.lit("s"), "p_partkey").alias("id"), snak("size", item).alias("mainsnak"), F.create_map(F.lit("year"), F.array(snak("year", year))).alias("qualifiers"))
    doc = F.struct(F.concat(F.lit("Q"), "p_partkey").alias("id"), F.create_map(F.lit("en"), F.struct(F.col("p_name").alias("value"))).alias("labels"), F.create_map(F.lit("size"), F.array(claim)).alias("claims"))
    path = scratch(spark, "wikidata")
    _t(spark, sf, "part").select(F.concat(F.to_json(doc), F.lit(",")).alias("value")).write.text(path)
    w = kb.wikidata(spark, path)
    st = w["labels"].join(w["statements"].select(F.col("s").alias("uri"), "o"), "uri").select("uri", "txt", "score", F.lit("statement").alias("kind"), F.col("o").alias("value"))
    return st.unionByName(w["qualifiers"].select(F.col("stmt_id").alias("uri"), F.col("qp").alias("txt"), F.lit(None).cast("double").alias("score"), F.lit("qualifier").alias("kind"), F.col("qo").alias("value")))


@_query("SELECT p_brand AS surfaceform, p_type AS uri, CAST(n AS BIGINT) AS pairs, round(n / sum(n) OVER (PARTITION BY p_brand), 6) AS share FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)")
def spotlight_3way_join(spark, sf):
    folder = scratch(spark, "spotlight")
    p = _t(spark, sf, "part")
    quoted = F.replace("p_type", F.lit(" "), F.lit("%20"))
    for name, df in (("u", p.groupBy(quoted.alias("uri")).count()), ("p", p.groupBy("p_brand", quoted.alias("uri")).count()), ("t", p.groupBy("p_brand").agg(F.count("*").alias("n"), F.lit(9).alias("m")))):
        df.write.option("sep", "\t").csv(f"{folder}/{name}")
    return kb.spotlight(spark, f"{folder}/u", f"{folder}/p", f"{folder}/t").select("surfaceform", "uri", "pairs", F.round("share", 6).alias("share"))


@_query("""WITH w AS (SELECT p_brand AS id, unnest(string_split(lower(p_type), ' ')) AS word, p_type FROM (SELECT DISTINCT p_brand, p_type FROM part)), v AS (SELECT id, sum(length(word)) AS a, sum(ascii(word) % 7 + 1) AS b FROM w GROUP BY id)
    SELECT id, round(a / sqrt(a * a + b * b), 6) AS x, round(b / sqrt(a * a + b * b), 6) AS y FROM v""")  # fmt: skip
def word_vectors_pooled(spark, sf):
    p = _t(spark, sf, "part")
    path = scratch(spark, "words")
    words = p.select(F.explode(F.split(F.lower("p_type"), " ")).alias("w")).distinct()
    words.select(F.concat_ws(" ", "w", F.length("w").cast("string"), (F.ascii("w") % 7 + 1).cast("string")).alias("value")).write.text(path)
    v = kb.pooled(p.select(F.col("p_brand").alias("id"), F.col("p_type").alias("text")), kb.word_vectors(spark, path))
    return v.select("id", F.round(F.col("v")[0], 6).alias("x"), F.round(F.col("v")[1], 6).alias("y"))


@_query("SELECT p_brand AS uri, p_type AS surface, round(m / max(m) OVER (PARTITION BY p_brand), 6) AS score FROM (SELECT p_brand, p_type, max(p_size) AS m FROM part GROUP BY ALL)")
def surface_scores(spark, sf):
    return kb.surface_scores(_t(spark, sf, "part").select(F.col("p_brand").alias("uri"), F.col("p_type").alias("surface"), F.col("p_size").alias("score"))).select("uri", "surface", F.round("score", 6).alias("score"))


@_query("SELECT 'entity' AS kind, 'nations' AS table_id, CAST(n_nationkey AS INTEGER) AS ri, 0 AS ci, 'http://x/' || n_name AS uri FROM nation UNION ALL SELECT 'class', 'nations', NULL, 0, 'http://c' UNION ALL SELECT 'column', 'nations', NULL, 0, NULL UNION ALL SELECT 'column', 'nations', NULL, 2, NULL")
def semtab_gold(spark, sf):
    """Tables with a header row, gold cells counted from it, and the columns that may hold entities; what is submitted is read as gold again."""
    folder = scratch(spark, "semtab")
    n = _t(spark, sf, "nation").orderBy("n_nationkey").coalesce(1)
    table = _csv(spark, n.select(F.col("n_name").alias("Name"), F.col("n_nationkey").alias("Key"), F.concat(F.lit("region "), "n_regionkey").alias("Region")), folder, "nations.csv", header=True)
    best = n.select(F.lit("nations").alias("table_id"), (F.col("n_nationkey") + 1).alias("ri"), F.lit(0).alias("ci"), F.concat(F.lit("http://x/"), "n_name").alias("uri"))
    files.write_submission(best, f"{folder}/cea")
    files.write_submission(spark.createDataFrame([("nations", 0, "http://c"), ("nations", 1, None)], "table_id string, ci int, uri string"), f"{folder}/cta")
    g = gold.semtab(spark, table, cea=f"{folder}/cea", cta=f"{folder}/cta")
    e = g["cell_entities"].select(F.lit("entity").alias("kind"), "table_id", "ri", "ci", "uri")
    c = g["col_classes"].select(F.lit("class").alias("kind"), "table_id", F.lit(None).cast("int").alias("ri"), "ci", "uri")
    return e.unionByName(c).unionByName(g["entity_columns"].select(F.lit("column").alias("kind"), "table_id", F.lit(None).cast("int").alias("ri"), "ci", F.lit(None).cast("string").alias("uri")))


@_query("SELECT 'entity' AS kind, 't2d' AS table_id, 1 AS ci, CAST(n_nationkey AS INTEGER) AS at, 'http://dbpedia.org/resource/' || n_name AS uri FROM nation UNION ALL SELECT 'class', 't2d', 1, NULL, 'http://c/Nation' UNION ALL SELECT 'property', 't2d', 1, 0, 'http://dbpedia.org/p'")
def t2d_gold(spark, sf):
    folder = scratch(spark, "t2d")
    n = _t(spark, sf, "nation").orderBy("n_nationkey")
    table = _csv(spark, n.select("n_nationkey", "n_name"), f"{folder}/tables", "t2d.csv")
    ent = _csv(spark, n.select(F.concat(F.lit("http://dbpedia_org/page/"), F.regexp_replace("n_name", "A", "%2541")), F.lower("n_name"), "n_nationkey"), f"{folder}/ent", "t2d.csv")
    cls = _csv(spark, spark.createDataFrame([("t2d.tar.gz", "Nation", "http://c/Nation")], "a string, b string, c string"), folder, "classes.csv")
    prop = _csv(spark, spark.createDataFrame([("http://label", "Name", "True", 1), ("http://dbpedia_org/p", "Key", "False", 0)], "a string, b string, c string, d int"), f"{folder}/prop", "t2d.csv")
    g = gold.t2d(spark, table, ent, cls, prop, twice=True)
    out = g["cell_entities"].select(F.lit("entity").alias("kind"), "table_id", "ci", F.col("ri").alias("at"), "uri")
    out = out.unionByName(g["col_classes"].select(F.lit("class").alias("kind"), "table_id", "ci", F.lit(None).cast("int").alias("at"), "uri"))
    return out.unionByName(g["col_properties"].select(F.lit("property").alias("kind"), "table_id", F.col("from_ci").alias("ci"), F.col("to_ci").alias("at"), "uri"))


@_query("SELECT 'CTRL_A_1' AS table_id, 'CTRL_A' AS category, 0 AS ci, CAST(n_nationkey AS INTEGER) AS ri, uri FROM nation, (VALUES ('u'), ('v')) t(k), LATERAL (SELECT k || n_nationkey AS uri)")
def tough_tables_gold(spark, sf):
    folder = scratch(spark, "tough")
    n = _t(spark, sf, "nation").orderBy("n_nationkey")
    table = _csv(spark, n.select("n_name"), f"{folder}/tables", "CTRL_A_1.csv")
    cea = _csv(spark, n.select(F.lit("CTRL_A_1"), F.lit(0), (F.col("n_nationkey") + 1), F.concat(F.lit("u"), "n_nationkey", F.lit(" v"), "n_nationkey")), folder, "cea.csv")
    cta = _csv(spark, spark.createDataFrame([("CTRL_A_1", 0, "c")], "a string, b int, c string"), folder, "cta.csv")
    g = gold.tough_tables(spark, cea, cta, table)
    return g["cell_entities"].join(g["tables"].select("table_id", "category"), "table_id").select("table_id", "category", "ci", "ri", "uri")


@_query("SELECT 'lim' AS table_id, 1 AS ci, CAST(n_nationkey AS INTEGER) AS ri, 'http://dbpedia.org/resource/' || n_name AS uri FROM nation")
def limaye_gold(spark, sf):
    folder = scratch(spark, "limaye")
    n = _t(spark, sf, "nation").orderBy("n_nationkey")
    table = _csv(spark, n.select("n_nationkey", F.concat("n_name", F.lit("é")), F.concat("n_name", F.lit("é")).alias("again")), f"{folder}/tables", "lim.csv")
    ent = _csv(spark, n.select(F.concat(F.lit("http://dbpedia_org/page/"), "n_name"), F.concat("n_name", F.lit("Ã©")), "n_nationkey"), f"{folder}/ent", "lim.csv")
    return gold.limaye(spark, table, ent)["cell_entities"]


# --- functions ----------------------------------------------------------------


_PLAIN = "replace(n_name, '_', ' ')"


@_query(f"SELECT n_nationkey, lower({_PLAIN}) || ' (x y)' AS title, n_name || ' a b ' AS surface, {_PLAIN} || ', X (y)|' || {_PLAIN} || ', X|' || {_PLAIN} AS surfaces FROM nation")
def titles_and_surfaces(spark, sf):
    n = _t(spark, sf, "nation")
    return n.select("n_nationkey", T.title_key(F.concat("n_name", F.lit("_%28x_y%29"))).alias("title"), T.surface_key(F.concat("n_name", F.lit("-a.b!"))).alias("surface"), F.array_join(T.surfaces_of_uri(F.concat(F.lit("http://x/"), "n_name", F.lit(",_X_(y)"))), "|").alias("surfaces"))


@_query("SELECT p_brand, CAST('0x' || substr(md5(p_brand || chr(31) || p_type || chr(31) || ''), 1, 15) AS BIGINT) AS header_id, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_brand, p_type")
def header_ids(spark, sf):
    p = _t(spark, sf, "part").withColumn("header_id", T.header_id(F.array("p_brand", "p_type", F.lit(None).cast("string"))))
    return p.groupBy("p_brand", "header_id").agg(F.count("*").alias("n"))


@_query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain, string_split(url, '/')[-1] AS last FROM pages WHERE url IS NOT NULL")
def url_parts(spark, sf):
    return _t(spark, sf, "pages").filter("url IS NOT NULL").select("page_id", T.domain(F.col("url")).alias("domain"), T.last_segment(F.col("url")).alias("last"))


@_query("""SELECT o_orderkey, CASE WHEN d > 0 THEN round(d, 6) END AS date_score, CASE WHEN x > 0.95 THEN round(x, 6) END AS number_score, CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 END::DOUBLE AS text_score FROM
    (SELECT *, greatest(0, 1 - abs(date_diff('day', DATE '1995-06-01', o_orderdate::DATE)) / 365.0) AS d, greatest(0, 1 - abs(floor(o_totalprice) - 150000) / greatest(floor(o_totalprice), 150000)) AS x FROM orders)""")  # fmt: skip
def literal_match_typed(spark, sf):
    o = _t(spark, sf, "orders")
    date = T.literal_match(F.date_format("o_orderdate", "d MMMM yyyy"), F.lit("1995-06-01"), F.lit("dateTime"))
    number = T.literal_match(F.format_number(F.floor("o_totalprice"), 0), F.lit("150000"), F.lit("decimal"))
    return o.select("o_orderkey", F.round(date, 6).alias("date_score"), F.round(number, 6).alias("number_score"), T.literal_match(F.lower("o_orderpriority"), F.lit("1-Urgent"), F.lit("xsd:string")).alias("text_score"))


@_query("SELECT n_nationkey, '\"' || n_name || chr(92) || '\"' || '\"@en' AS literal, '<http://r/' || n_regionkey || '>' AS uri, 'http://en.wikipedia.org/wiki/' || n_name || '_x?curid=' || n_nationkey AS url, n_name || chr(92) || 'u00E9' AS escaped FROM nation")
def rdf_nodes(spark, sf):
    n, no = _t(spark, sf, "nation"), F.lit(None).cast("string")
    return n.select("n_nationkey", T.rdf_node(F.concat("n_name", F.lit('"')), F.lit("literal"), no, F.lit("en")).alias("literal"), T.rdf_node(F.concat(F.lit("http://r/"), "n_regionkey"), F.lit("uri"), no, no).alias("uri"), T.wiki_url(F.concat("n_name", F.lit(" x")), "en", F.col("n_nationkey")).alias("url"), T.unicode_escaped(F.concat("n_name", F.lit("é"))).alias("escaped"))


@_query("SELECT n_nationkey, '<a href=\"/r\">' || n_name || '</a> in <a href=\"/r\">' || n_name || '</a>' AS html, CAST(length(n_name) + 4 AS INTEGER) AS moved, CAST(length(n_name) - 1 AS INTEGER) AS cut FROM nation")
def link_offsets(spark, sf):
    n = _t(spark, sf, "nation")
    one = F.array(F.struct(F.lit(0).alias("start"), F.length("n_name").alias("end"), F.lit("/r").alias("href")))
    text = F.concat("n_name", F.lit(" in "), "n_name")
    both = T.links_joined(one, F.length("n_name") + 4, one)
    inner = T.links_within(both, F.length("n_name") + 5 - 1, F.length(text))
    return n.select("n_nationkey", T.with_anchors(text, both).alias("html"), both[1]["start"].alias("moved"), (inner[0]["end"] - 1).alias("cut"))


# --- similarity, ranks, profiles ----------------------------------------------


@_query("WITH c AS (SELECT DISTINCT p_partkey % 40 AS ti, lower(p_type) AS k FROM part), b AS (SELECT DISTINCT a.ti AS x, b.ti AS y FROM c a JOIN c b ON a.k = b.k AND a.ti < b.ti), n AS (SELECT ti, count(*) AS n FROM (SELECT x AS ti FROM b UNION ALL SELECT y FROM b) GROUP BY 1) SELECT CAST((SELECT count(*) FROM b) AS BIGINT) AS pairs, CAST(count(*) AS BIGINT) AS tables, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS deviation FROM n")
def block_statistics(spark, sf):
    cells = _t(spark, sf, "part").select((F.col("p_partkey") % 40).alias("ti"), F.lit(0).alias("ci"), F.col("p_type").alias("text"))
    return similarity.block_statistics(similarity.cell_block(cells)).select("pairs", "tables", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


_SIZES = "SELECT a.p_partkey AS ti1, b.p_partkey AS ti2, 0 AS ci1, 0 AS ci2, round(1 - abs(a.p_size - b.p_size) / 50.0, 6) AS score FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey"


@_query(f"SELECT ti1, ti2, score FROM ({_SIZES}) WHERE (ti1 + ti2) % 3 > 0 UNION ALL SELECT p_partkey, p_partkey, 1.0 FROM part")
def second_matcher_and_identity(spark, sf):
    p = _t(spark, sf, "part")
    a, b = p.alias("a"), p.alias("b")
    pairs = a.join(b, (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.p_type") == F.col("b.p_type")) & (F.col("a.p_partkey") < F.col("b.p_partkey")))
    s = pairs.select(F.col("a.p_partkey").alias("ti1"), F.col("b.p_partkey").alias("ti2"), F.lit(0).alias("ci1"), F.lit(0).alias("ci2"), F.round(1 - F.abs(F.col("a.p_size") - F.col("b.p_size")) / 50, 6).alias("score"))
    kept = similarity.kept_by(s, s.withColumn("score", ((F.col("ti1") + F.col("ti2")) % 3).cast("double")))
    return similarity.with_identity(kept.withColumnRenamed("score", "sim"), p.select(F.col("p_partkey").alias("ti"))).withColumnRenamed("sim", "score")


@_query("SELECT l_partkey, CAST(count(*) AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, l_partkey) AS BIGINT) AS rank FROM lineitem GROUP BY 1")
def value_ranks(spark, sf):
    return profile.ranked(_t(spark, sf, "lineitem"), "l_partkey")


@_query("SELECT p_brand AS text, 'p' || p_partkey AS uri, CAST(coalesce(n, 0) AS BIGINT) AS facts, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(n, 0) DESC, 'p' || p_partkey) AS INTEGER) AS place FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey")
def candidates_by_facts(spark, sf):
    c = _t(spark, sf, "part").select(F.col("p_brand").alias("text"), F.concat(F.lit("p"), "p_partkey").alias("uri"))
    triples = _t(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("p"), "l_partkey").alias("s"), F.lit("sold").alias("p"), F.col("l_orderkey").alias("o"))
    return link.by_fact_count(c, triples).select("text", "uri", "facts", "place")


@_query("SELECT table_id, ci, CAST(filled AS BIGINT) AS filled, CAST(row_number() OVER (PARTITION BY table_id ORDER BY filled DESC, ci) AS INTEGER) AS place FROM (SELECT lang AS table_id, ci, count(*) FILTER (CASE ci WHEN 0 THEN length(text) > 2000 WHEN 1 THEN true ELSE source LIKE '%a%' END) AS filled FROM documents, (VALUES (0), (1), (2)) c(ci) GROUP BY ALL)")
def columns_by_fill(spark, sf):
    d = _t(spark, sf, "documents")
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("ci"), F.when(c, "x").otherwise(" ").alias("text")) for i, c in enumerate((F.length("text") > 2000, F.lit(True), F.col("source").contains("a")))]))
    return profile.by_fill(d.select(F.col("lang").alias("table_id"), cells.alias("c")).select("table_id", "c.ci", "c.text"))


@_query("SELECT p_brand AS table_id, round(avg(CASE WHEN lower(p_type) IN (SELECT lower(p_type) FROM part WHERE p_size > 49) THEN 1 ELSE 0 END), 6) AS share FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY 1 HAVING share > 0.75")
def known_members(spark, sf):
    p = _t(spark, sf, "part")
    return profile.known_share(p.select(F.col("p_brand").alias("table_id"), F.lit(0).alias("ci"), F.col("p_type").alias("text")), p.filter("p_size > 49").select(F.upper("p_type").alias("text")), 0.75).select("table_id", F.round("share", 6).alias("share"))


@_query("SELECT p_partkey AS uri, substr(p_name, 3) AS text, round(max(greatest(0, (least(length(p_name) - 2, length(txt)) - levenshtein(lower(substr(p_name, 3)), lower(txt))) / least(length(p_name) - 2, length(txt)))), 6) AS score FROM part, LATERAL (SELECT unnest([p_name, p_type, reverse(p_name)]) AS txt) GROUP BY ALL HAVING score > 0.2")
def label_match(spark, sf):
    p = _t(spark, sf, "part")
    labels = p.select(F.col("p_partkey").alias("uri"), F.explode(F.array("p_name", "p_type", F.reverse("p_name"))).alias("txt"))
    return link.label_match(p.select(F.col("p_partkey").alias("uri"), F.expr("substring(p_name, 3)").alias("text")), labels, 0.2).select("text", "uri", F.round("score", 6).alias("score"))


@_query("SELECT l_returnflag AS p, l_suppkey AS o, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL")
def triple_pattern_counts(spark, sf):
    li = _t(spark, sf, "lineitem").select(F.col("l_linestatus").alias("s"), F.col("l_returnflag").alias("p"), F.col("l_suppkey").alias("o"))
    return link.pattern_counts(link.pattern(li, s="O"), ["p", "o"])


@_query("""WITH lab AS (SELECT DISTINCT 'p' || p_partkey AS uri, p_name AS txt FROM part), lw AS (SELECT DISTINCT uri, txt, unnest(string_split(lower(txt), ' ')) AS word FROM lab), n AS (SELECT count(*) AS n FROM lab),
    w AS (SELECT word, ln(1 + (SELECT n FROM n) / count(*)) AS w FROM lw GROUP BY 1), q AS (SELECT DISTINCT n_name || ' ' || p_name AS text FROM (SELECT n_name, n_nationkey FROM nation) JOIN (SELECT p_partkey, p_name FROM part) ON p_partkey = n_nationkey + 1),
    qw AS (SELECT DISTINCT text, word, w FROM (SELECT text, unnest(string_split(lower(text), ' ')) AS word FROM q) JOIN w USING (word)), c AS (SELECT text, uri, txt, sum(w) AS common FROM qw JOIN lw USING (word) GROUP BY ALL),
    s AS (SELECT text, uri, max(common / (qt + lt - common) * CASE WHEN lower(text) = lower(txt) THEN 2 ELSE 1 END) AS base FROM c JOIN (SELECT text, sum(w) AS qt FROM qw GROUP BY 1) USING (text) JOIN (SELECT uri, sum(w) AS lt FROM lw JOIN w USING (word) GROUP BY 1) USING (uri) GROUP BY ALL),
    r AS (SELECT 'p' || l_partkey AS uri, count(*) AS refs FROM lineitem GROUP BY 1), f AS (SELECT text, uri, base + 0.1 * ln(1 + coalesce(refs, 0)) + CASE WHEN p_brand = 'Brand#11' THEN 0.2 ELSE 0 END AS score FROM s LEFT JOIN r USING (uri) JOIN part ON uri = 'p' || p_partkey)
    SELECT text, uri, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY text ORDER BY round(score, 9) DESC, uri) AS INTEGER) AS rank FROM f QUALIFY rank <= 3""")  # fmt: skip
def word_search(spark, sf):
    p = _t(spark, sf, "part")
    labels = p.select(F.concat(F.lit("p"), "p_partkey").alias("uri"), F.col("p_name").alias("txt"), F.lit(1.0).alias("score"))
    q = _t(spark, sf, "nation").join(p, F.col("p_partkey") == F.col("n_nationkey") + 1).select(F.concat_ws(" ", "n_name", "p_name").alias("text"), F.lit("_brand").alias("context"))
    refs = _t(spark, sf, "lineitem").groupBy(F.concat(F.lit("p"), "l_partkey").alias("uri")).agg(F.count("*").alias("refs"))
    context = p.filter("p_brand = 'Brand#11'").select(F.concat(F.lit("p"), "p_partkey").alias("uri"), F.lit("_brand").alias("value"))
    return link.search_words(q, labels, refs, context, 3).select("text", "uri", F.round("score", 6).alias("score"), "rank")


@_query("SELECT p_brand AS id, p_type AS key, CAST(count(*) AS DOUBLE) AS w FROM part WHERE p_type <> (SELECT min(p_type) FROM part) GROUP BY ALL")
def type_vectors_excluded(spark, sf):
    p = _t(spark, sf, "part")
    dull = p.agg(F.min("p_type")).first()[0]
    return similarity.type_vectors(p.select(F.col("p_brand").alias("id"), F.col("p_type").alias("type")), (dull,))


@_query("SELECT r_name AS table_id, 1 AS heads, CAST(count(*) + 1 AS INTEGER) AS rows, 'x' AS first FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def plain_heads_demoted(spark, sf):
    n = _t(spark, sf, "nation").join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    t = n.groupBy(F.col("r_name").alias("table_id")).agg(F.collect_list(F.array("n_name")).alias("body")).withColumn("head", F.array(F.array(F.lit("Name")), F.array(F.lit("x")))).withColumn("head_tags", F.array(F.array(F.lit("th")), F.array(F.lit("td"))))
    return clean.demote_plain_heads(t).select("table_id", F.size("head").alias("heads"), F.col("num_rows").alias("rows"), F.col("body")[0][0].alias("first"))


@_query("SELECT n_nationkey AS header_id, 'number_last' AS finder, 0 AS level, 1 AS colfrom, 3 AS colto FROM nation WHERE n_nationkey % 3 <> 0")
def standard_finders(spark, sf):
    """Nations as header rows: a name, then three numbered columns (equal ones for every third nation, whose pivot has no meaning)."""
    same = F.col("n_nationkey") % 3 == 0
    cells = F.array(F.lit("name"), *[F.concat(F.lit("col "), F.when(same, 1).otherwise(i).cast("string")) for i in (1, 2, 3)])
    h = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("header_id"), F.lit(0).alias("level"), F.posexplode(cells).alias("ci", "text"))
    return unpivot.valid_pivots(unpivot.best_pivot(unpivot.found_by_standard(h)), h)


@_query("SELECT doc_id::VARCHAR AS table_id, 'entity' AS kind, 0 AS a, CAST(doc_id % 7 AS INTEGER) AS b, lang AS uri, 0.5::DOUBLE AS score FROM documents UNION ALL SELECT doc_id::VARCHAR, 'class', 1, NULL, source, 1.0 FROM documents UNION ALL SELECT doc_id::VARCHAR, 'property', 0, 1, lang || source, 0.25 FROM documents")
def flat_annotations(spark, sf):
    m = F.create_map
    of = lambda uri, score: m(uri, F.lit(score))
    d = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("table_id"), m(F.lit("0"), m((F.col("doc_id") % 7).cast("string"), of(F.col("lang"), 0.5))).alias("entities"), m(F.lit("1"), of(F.col("source"), 1.0)).alias("classes"), m(F.lit("0"), m(F.lit("1"), of(F.concat("lang", "source"), 0.25))).alias("properties"))
    row = lambda df, kind, a, b: df.select("table_id", F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), "uri", "score")
    return row(evaluate.flat_entities(d), "entity", F.col("ci"), F.col("ri")).unionByName(row(evaluate.flat_classes(d), "class", F.col("ci"), F.lit(None).cast("int"))).unionByName(row(evaluate.flat_properties(d), "property", F.col("from_ci"), F.col("to_ci")))


@_query("SELECT CAST(count(*) AS BIGINT) AS tables, round(avg(n), 6) AS rows, 3.0::DOUBLE AS columns, CAST((SELECT count(*) FROM documents) AS BIGINT) AS entities, CAST((SELECT count(*) FROM labels) AS BIGINT) AS classes, CAST((SELECT count(*) FROM nation) AS BIGINT) AS properties FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)")
def dataset_overview(spark, sf):
    t = _t(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("num_rows")).withColumn("num_cols", F.lit(3))
    return evaluate.overview(t, _t(spark, sf, "documents"), _t(spark, sf, "labels"), _t(spark, sf, "nation")).select("tables", F.round("rows", 6).alias("rows"), "columns", "entities", "classes", "properties")


@_query("WITH s AS (SELECT s_suppkey AS ti, s_nationkey AS class FROM supplier), m AS (SELECT a.ti AS t1, b.ti AS t2, least(a.ti % 5, b.ti % 5) / 5.0 AS score FROM s a JOIN s b ON a.class = b.class AND a.ti < b.ti), c AS (SELECT ti, row_number() OVER (ORDER BY ti) - 1 AS code FROM (SELECT t1 AS ti FROM m UNION SELECT t2 FROM m)) SELECT CAST(a.code AS BIGINT) AS code1, CAST(b.code AS BIGINT) AS code2, round(score, 6) AS score FROM m JOIN c a ON t1 = a.ti JOIN c b ON t2 = b.ti")
def class_matches_and_codes(spark, sf):
    c = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("ti"), F.lit(0).alias("ci"), F.col("s_nationkey").alias("class"), ((F.col("s_suppkey") % 5) / 5).alias("score"))
    pairs, _ = stitching.column_codes(stitching.class_matches(c))
    return pairs.select(F.col("code1").cast("bigint"), F.col("code2").cast("bigint"), F.round("score", 6).alias("score"))


# --- linking, integration, stitching ------------------------------------------


def _places(spark, sf):
    """Nations and their regions as a table to link, with a knowledge base: every name is also a ship's, which no column prefers."""
    n = _t(spark, sf, "nation").join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cell = F.explode(F.array(F.struct(F.lit(0).alias("ci"), F.col("n_name").alias("text")), F.struct(F.lit(1).alias("ci"), F.col("r_name").alias("text")), F.struct(F.lit(2).alias("ci"), F.col("n_nationkey").cast("string").alias("text"))))
    cells = n.select(F.lit("t").alias("table_id"), F.col("n_nationkey").alias("ri"), cell.alias("c")).select("table_id", "ri", "c.ci", "c.text")
    names = n.select(F.col("n_name").alias("name"), F.lit("Nation").alias("type")).union(n.select("r_name", F.lit("Region"))).distinct()
    uri = F.concat(F.lit("u:"), F.col("type"), F.lit(":"), F.col("name")).alias("uri")
    ships = names.select("name", F.lit("Zhip").alias("type"))
    labels = names.unionByName(ships).select(uri, F.lower("name").alias("txt"), F.lit(1.0).alias("score"))
    types = names.unionByName(ships).select(uri, "type")
    triples = n.select(F.concat(F.lit("u:Nation:"), "n_name").alias("s"), F.lit("in").alias("p"), F.concat(F.lit("u:Region:"), "r_name").alias("o"))
    return cells, labels, types, triples


_LINKED = "SELECT 't' AS table_id, CAST(ri AS INTEGER) AS ri, ci, uri FROM (SELECT n_nationkey AS ri, 0 AS ci, 'u:Nation:' || n_name AS uri FROM nation UNION ALL SELECT n_nationkey, 1, 'u:Region:' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"


@_query(_LINKED)
def link_by_majority_class(spark, sf):
    cells, labels, types, triples = _places(spark, sf)
    return link.link_first(cells, labels, types, triples, class_cover=0.5).select("table_id", F.col("ri").cast("int"), "ci", "uri")


@_query(_LINKED)
def link_by_salience(spark, sf):
    cells, labels, _, triples = _places(spark, sf)
    found = cells.join(link.search(cells, labels), "text").select("table_id", "ri", "ci", "uri", "score")
    return link.link_salient(found, triples, 0.5).select("table_id", F.col("ri").cast("int"), "ci", "uri")


@_query("SELECT 'u:Nation:' || n_name AS s, 'in' AS p, 'u:Region:' || r_name AS o, 'uri' AS kind, 'existing' AS novelty FROM nation JOIN region ON n_regionkey = r_regionkey")
def tableset_link_integrate(spark, sf):
    """The fluent steps: link, integrate, triples and their novelty."""
    cells, labels, types, triples = _places(spark, sf)
    t = C.to_tables(cells.withColumn("section", F.lit("body")).withColumn("ri", F.col("ri").cast("int")))
    return TableSet(t).link(labels, types, triples).integrate(triples).novelty(triples)


@_query("SELECT 'u:Nation:' || n_name AS s, 'in' AS p, 'u:Region:' || r_name AS o, CAST(1 AS BIGINT) AS facts, CAST(0 AS BIGINT) AS refs FROM nation JOIN region ON n_regionkey = r_regionkey")
def entity_facts(spark, sf):
    _, _, types, triples = _places(spark, sf)
    asked = types.filter("type = 'Nation'").select("uri")
    info = link.kb_info(asked, triples).select(F.col("uri").alias("s"), "facts", "refs")
    return link.about(asked, triples).join(info, "s").select("s", "p", "o", "facts", "refs")


@_query("SELECT c_mktsegment AS table_id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM (SELECT c_mktsegment, count(*) FILTER (c_nationkey % 2 = 0 AND c_custkey % 3 > 0) AS tp, count(*) FILTER (c_nationkey % 2 > 0 AND c_custkey % 3 > 0) AS fp, count(*) FILTER ((c_nationkey % 2 = 0 AND c_custkey % 3 = 0) OR (c_nationkey % 2 > 0)) AS fn FROM customer GROUP BY 1)")
def tableset_score(spark, sf):
    """Cell entities scored where gold is known: right where the nation is even, missing where the key divides by three."""
    c = _t(spark, sf, "customer")
    key = [F.col("c_mktsegment").alias("table_id"), F.lit(0).alias("ci"), F.col("c_custkey").alias("ri")]
    right = F.concat(F.lit("e"), "c_custkey")
    pred = c.filter("c_custkey % 3 > 0").select(*key, F.when(F.col("c_nationkey") % 2 == 0, right).otherwise("wrong").alias("uri"), F.lit(1.0).alias("score"))
    gold_ = c.select(*key, right.alias("uri"))
    flags = evaluate.annotated_only(evaluate.flagged(gold_, pred, ["table_id", "ci", "ri", "uri"]), ["table_id", "ci", "ri"])
    return evaluate.scores(flags, ["table_id"]).select("table_id", "tp", "fp", "fn")


@_query("SELECT text, CAST(count(*) AS BIGINT) AS n FROM (SELECT n_name AS text FROM nation UNION ALL SELECT n_name FROM nation UNION ALL SELECT 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || n_regionkey FROM nation) GROUP BY 1")
def tableset_cluster(spark, sf):
    """Two tables with the same columns in another order become one partition; its stitched rows hold every cell, and each column one kind of text."""
    n = _t(spark, sf, "nation").orderBy("n_nationkey")
    rows = lambda *cols: F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", *cols))), lambda x: F.array(*[x[c] for c in ("a", "b")]))
    one = n.agg(rows(F.col("n_name").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b")).alias("body")).withColumn("table_id", F.lit("x"))
    two = n.agg(rows(F.concat(F.lit("r"), "n_regionkey").alias("a"), F.col("n_name").alias("b")).alias("body")).withColumn("table_id", F.lit("y"))
    t = one.unionByName(two).select("table_id", F.array(F.array(F.lit("A"), F.lit("B"))).alias("head"), "body", F.lit(2).alias("num_cols"), F.size("body").alias("num_rows"))
    out = TableSet(t).cluster(matchers={"cell": similarity.Matcher(similarity.cell_jaccard)}, agg_threshold_col=0.5).extra["stitched"]
    pure = out.groupBy("pci").agg((F.max(F.col("text").startswith("r").cast("int")) == F.min(F.col("text").startswith("r").cast("int"))).alias("pure")).filter("pure")
    return out.join(pure, "pci", "left_semi").groupBy("text").agg(F.count("*").alias("n"))


@_query("SELECT 's' || a.n_nationkey AS ti1, 's' || b.n_nationkey AS ti2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND 's' || a.n_nationkey < 's' || b.n_nationkey")
def exact_headers(spark, sf):
    h = _t(spark, sf, "nation").select(F.concat(F.lit("s"), "n_nationkey").alias("ti"), F.lit(0).alias("ci"), F.concat(F.lit(" Region "), "n_regionkey").alias("text"))
    return stitching.exact_header_matches(h).select("ti1", "ti2")


@_query("""WITH m AS (SELECT p_brand AS class, unnest(string_split(lower(p_type), ' ')) AS key FROM part), tf AS (SELECT class, key, count(*) AS tf FROM m GROUP BY ALL), df AS (SELECT key, count(*) AS df FROM tf GROUP BY 1),
    w AS (SELECT class, key, tf * ln(((SELECT count(DISTINCT class) FROM m) + 1) / df) AS w FROM tf JOIN df USING (key)), c AS (SELECT p_size AS id, key, count(*) AS c FROM (SELECT p_size, unnest(string_split(lower(p_type), ' ')) AS key FROM part) GROUP BY ALL),
    s AS (SELECT id, class, sum(c * w) / any_value(nc) / any_value(np) AS score FROM c JOIN w USING (key) JOIN (SELECT id, sqrt(sum(c * c)) AS nc FROM c GROUP BY 1) USING (id) JOIN (SELECT class, sqrt(sum(w * w)) AS np FROM w GROUP BY 1) USING (class) GROUP BY ALL)
    SELECT id, round(max(score), 6) AS score FROM s WHERE score > 0 GROUP BY id""")  # fmt: skip
def predicted_classes(spark, sf):
    p = _t(spark, sf, "part")
    profiles = stitching.class_profile(p.select(F.col("p_brand").alias("class"), F.col("p_type").alias("text")))
    return stitching.predicted_classes(p.select(F.col("p_size").alias("id"), F.col("p_type").alias("text")), profiles).select("id", F.round("score", 6).alias("score"))


@_query("SELECT CAST(o_orderkey AS BIGINT) AS ri, ci, CASE ci WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN (o_custkey * 1000)::DOUBLE::VARCHAR ELSE lower(o_orderpriority) END AS text FROM orders, (VALUES (0), (1), (2)) c(ci)")
def normalised_values(spark, sf):
    o = _t(spark, sf, "orders")
    texts = (F.date_format("o_orderdate", "dd/MM/yyyy"), F.concat("o_custkey", F.lit(",000")), F.concat(F.lit("7. "), "o_orderpriority", F.lit(" (x)")))
    cells = o.select(F.lit("t").alias("table_id"), F.col("o_orderkey").alias("ri"), F.posexplode(F.array(*texts)).alias("ci", "text"))
    out = stitching.cleaned_values(cells, profile.shapes(cells)).select("ri", "ci", "text")
    return out.withColumn("text", F.when(F.col("ci") == 1, F.regexp_replace(F.col("text").cast("double").cast("decimal(20,1)").cast("string"), "$", "")).otherwise(F.regexp_replace("text", r"^7\. ", "")))


@_query("SELECT 'p_partkey' AS det, dep, 1.0::DOUBLE AS score FROM (VALUES ('p_brand'), ('p_type')) t(dep)")
def key_candidates(spark, sf):
    return stitching.key_candidates(_t(spark, sf, "part"), ["p_partkey", "p_brand", "p_type"], 2, 1.0).select("det", "dep", F.round("score", 6).alias("score"))


@_query("SELECT event_id, user_id FROM events ORDER BY user_id DESC, event_id LIMIT 50")
def largest_first(spark, sf):
    """The largest by a global sort, from a relation saved and loaded again."""
    saved = files.save(_t(spark, sf, "events").select("event_id", "user_id"), scratch(spark, "saved"))
    return C.largest_first(saved, "user_id", "event_id").limit(50)
