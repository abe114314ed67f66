"""Operators on small golden inputs, and queries against DuckDB."""

import glob
import json
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtable import queries as Q
from loomtable.functions import text as T
from loomtable.operators import cells as C
from loomtable.operators import clean, cluster, compound, evaluate, link, linkage, profile, similarity, stitching, unpivot
from loomtable.plans import config, tableset
from loomtable.sources import files, gold, kb
from loomtable.sources import html as H

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def body(spark, *tables):
    return spark.createDataFrame([(t, r, c, x) for t, rs in tables for r, cs in enumerate(rs) for c, x in enumerate(cs)], "table_id string, ri int, ci int, text string")


# --- queries -----------------------------------------------------------------


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {f.rsplit('/', 1)[-1][:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    sql = Q.oracle_sql().get(name)
    if sql:
        cur = duck.execute(sql)
        names = [d[0] for d in cur.description]
        tidy = lambda r: tuple(round(float(v), 6) if not isinstance(v, str | bool | int | type(None)) else v for _, v in sorted(r.items()))
        assert sorted(map(tidy, got), key=repr) == sorted((tidy(dict(zip(names, r, strict=True))) for r in cur.fetchall()), key=repr)


# --- HTML ----------------------------------------------------------------------


def test_spans_ragged_rows_and_bad_numbers():
    _, (t,) = H.page_tables('<html><h1>T</h1><table><tr><th>A<th colspan=2>B</tr><tr><td rowspan=2>1<td>2<td rowspan="x">3</tr><tr><td>4</tr></table>')
    assert t["head"] == [["A", "B", "B"]] and t["body"] == [["1", "2", "3"], ["1", "4", ""]]


def test_subtables_captions_and_links():
    page = """<html><body><h1>Page</h1><h2>Sec</h2><table class="wikitable" summary="s"><tr><th>A</th><th>B</th></tr><tr><td><a href="/wiki/X">X y</a><sup class="reference">[1]</sup></td><td>b <i>c</i></td></tr>
    <tr><th colspan="2">Mid</th></tr><tr><td>1</td><td>2</td></tr><tr><th>C</th><th>D</th></tr><tr><td>3</td><td>4</td></tr></table><table><tr><td> </td></tr></table></body></html>"""
    title, found = H.page_tables(page, ["wikitable"])
    assert title == "Page" and [t["head"] for t in found] == [[["A", "B"]], [["C", "D"]]]
    assert found[0]["body"] == [["X y", "b c"], ["Mid", "Mid"], ["1", "2"]] and found[0]["links"] == [(0, 0, 0, 3, "/wiki/X")] and found[0]["caption"] == "s" and found[0]["section"] == "Sec"
    assert H.page_tables("<p>no root</p>") == ("", [])


def test_nested_tables_keep_their_rows():
    _, found = H.page_tables("<html><table><tr><td>a<table><tr><td>x</td></tr></table></td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table></html>")
    assert [t["body"] for t in found] == [[["a x", "b"], ["c", "d"]], [["x"]]]


# --- cells and cleaning --------------------------------------------------------------


def test_tables_and_cells_round_trip(spark):
    t = spark.createDataFrame([("a", [["h1", "h2"]], [["1", "2"], ["3"]]), ("b", [], [["x"]])], "table_id string, head array<array<string>>, body array<array<string>>")
    got = {r.table_id: r for r in C.to_tables(C.to_cells(t)).collect()}
    assert got["a"].body == [["1", "2"], ["3", ""]] and got["b"].head == [] and got["a"].num_rows == 2


def test_cleaning_of_rows(spark):
    t = spark.createDataFrame([("a", [["Cap", "Cap"], ["A", "B"], ["", " "]], [["A", "B"], ["", ""], ["1", "2"]]), ("gone", [["A", "B"]], [["", ""]])], "table_id string, head array<array<string>>, body array<array<string>>").withColumn("num_cols", F.lit(2))
    (r,) = clean.drop_repeated_header(clean.spanning_header_rows(clean.drop_empty_rows(t))).collect()
    assert (r.head, r.body, r.captions, r.num_rows) == ([["A", "B"]], [["1", "2"]], ["Cap"], 1)


@pytest.mark.parametrize(
    ("lines", "want"),
    [("nRnR", "NRNR"), ("RnRn", "LNLN"), ("RnnRnn", "HNNHNN"), ("nnnRR", "NNNFF"), ("RRnn", "XHNN"), ("nnn", "NNN"), ("RRR", "NNN"), ("nRRn", "NXHN")],
)
def test_row_classes(spark, lines, want):
    df = spark.createDataFrame([("t", i, ["s", "S"] if c == "R" else ["a", "b"]) for i, c in enumerate(lines)], "table_id string, ri int, texts array<string>")
    assert "".join(r["class"] for r in clean.row_classes(df).orderBy("ri").collect()) == want


def test_section_headers_are_carried(spark):
    df = spark.createDataFrame([("t", i, [x, y]) for i, (x, y) in enumerate([("a", "b"), ("S", "S"), ("c", "d"), ("e", "f")])], "table_id string, ri int, texts array<string>")
    assert [(r.texts, r.subheader) for r in clean.spread_classes(clean.row_classes(df)).orderBy("ri").collect()] == [(["a", "b"], ""), (["c", "d"], "S"), (["e", "f"], "S")]


def test_prefix_rules_and_context(spark):
    cells = body(spark, ("t", [["Preceded by X", "y"]])).withColumn("section", F.lit("body"))
    rules = spark.createDataFrame([("Preceded by ", "Preceded by"), ("Pre", "no")], "find string, header string")
    assert [(r.text, r.header) for r in clean.prefix_rules(cells, rules).orderBy("ci").collect()] == [("X", "Preceded by"), ("y", None)]
    out = clean.context_columns(cells.select("table_id", "section", "ri", "ci", "text"), spark.createDataFrame([("t", "Page")], "table_id string, pgTitle string"), ["pgTitle"])
    assert rows(out.select("section", "ci", "text")) == [("body", 0, "Page"), ("body", 1, "Preceded by X"), ("body", 2, "y"), ("head", 0, "_pgTitle")]


# --- unpivot and compound -----------------------------------------------------------------


def heads(spark, *rows_):
    return spark.createDataFrame([(h, level, ci, t) for h, level, r in rows_ for ci, t in enumerate(r)], "header_id int, level int, ci int, text string")


def test_pivot_prefers_the_longest_run(spark):
    h = heads(spark, (1, 0, ["A", "2001", "x", "2002", "2003"]), (2, 0, ["n", "m"]), (3, 0, ["1", "2", "a", "3", "4"]))
    found = unpivot.found_by_pattern(h, "num", "^[0-9]+$")
    assert rows(unpivot.best_pivot(found)) == [(1, "num", 0, 3, 4), (3, "num", 0, 0, 1)]
    assert rows(unpivot.best_pivot(found, gap=1)) == [(1, "num", 0, 1, 4), (3, "num", 0, 0, 4)]


def test_other_finders(spark):
    h = heads(spark, (1, 0, ["Team", "Wins", "Wins", "Wins"]), (1, 1, ["Team", "Home", "Away", "Home"]), (2, 0, ["Game 1", "Game 2", "Player"]))
    assert rows(unpivot.found_by_prefix(h.filter("header_id = 2")).select("ci")) == [(0,), (1,)]
    assert rows(unpivot.spanned_repeats(h).select("level", "ci")) == [(0, 1), (0, 3)]
    assert rows(unpivot.found_by_rule(h, ["Team"], ["Home", "Away"]).select("level", "ci")) == [(1, 1), (1, 2), (1, 3)]
    assert rows(unpivot.found_by_attribute(h, spark.createDataFrame([("PLAYER",)], "value string")).select("header_id", "ci")) == [(2, 2)]
    linked = spark.createDataFrame([(1, 0, 0, "E1"), (1, 0, 1, "E2"), (1, 0, 2, "E3")], "header_id int, level int, ci int, title string")
    titles = spark.createDataFrame([("E1", "u1"), ("E2", "u2"), ("E3", "u3")], "title string, uri string")
    triples = spark.createDataFrame([("x", "type", "u1"), ("u2", "type", "Attribute"), ("u3", "type", "Person")], "s string, p string, o string")
    assert rows(unpivot.found_by_agent_link(linked, titles, triples, ["type"], ["Attribute"]).select("ci")) == [(2,)]


def test_unpivot_keeps_every_value(spark):
    t = spark.createDataFrame([("t", [["Team", "2001", "2002"]], [["a", "1", "2"], ["b", "3", ""]]), ("all", [["2001", "2002"]], [["5", "6"]])], "table_id string, head array<array<string>>, body array<array<string>>").withColumn("num_cols", F.lit(3)).withColumn("num_rows", F.size("body"))
    got = {r.table_id: r for r in tableset.TableSet(t).unpivot([{"pattern": "^[0-9]{4}$"}]).tables.collect()}
    assert got["t"].head == [["Team", "_Variable", "_Value"]] and got["t"].body == [["a", "2001", "1"], ["a", "2002", "2"], ["b", "2001", "3"], ["b", "2002", ""]]
    assert got["all"].body == [["5", "6"]]


def test_affixes_and_parts(spark):
    cells = body(spark, ("t", [["Rank 1 km", "Bob 12"], ["Rank 22 km", "Al 7"], ["Rank 3 km", "Cy 9"]]))
    got = {(r.ci, r.ri): r.rest for r in compound.strip_affixes(cells, ["table_id", "ci"]).collect()}
    assert [got[0, i] for i in range(3)] == ["1", "22", "3"]
    assert rows(compound.split_parts(cells.filter("ci = 1"), ["table_id", "ci"]).select("ri", "kind", "piece")) == [(0, "N", "12"), (0, "W", "Bob"), (1, "N", "7"), (1, "W", "Al"), (2, "N", "9"), (2, "W", "Cy")]


def test_template_parts(spark):
    cells = body(spark, ("t", [["Rank: 1 (of 9)", "x"], ["Rank: 22 (of 31)", "y"]]))
    got = compound.template_parts(cells, ["table_id", "ci"])
    assert rows(got.select("ri", "part", "piece")) == [(0, 0, "1"), (0, 1, "9"), (1, 0, "22"), (1, 1, "31")]


def test_career_tables():
    page = "<html><table><tr><th>A</th><th>B</th><th>C</th><th>D</th></tr><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr><tr><td colspan=3>Club</td><td>x</td></tr><tr><td>5</td><td>6</td><td>7</td><td>8</td></tr></table></html>"
    assert [t["body"] for t in H.page_tables(page, careers=True)[1]] == [[["1", "2", "3", "4"]], [["5", "6", "7", "8"]]]


# --- similarity, clustering ---------------------------------------------------------------


def test_score_expressions(spark):
    df = spark.createDataFrame([(0.9, None), (0.2, 0.4)], "a double, b double")
    f = lambda e: [r[0] if r[0] is None else round(r[0], 6) for r in df.select(similarity.score_expression(e, ["a", "b"])).collect()]
    assert f("mean") == [0.9, 0.3] and f("@mean(@max(a,@pow(b,4)),b)") == [0.9, 0.3] and f("a*2-0.1") == [1.7, 0.3] and f("min") == [0.9, 0.2]
    for bad in ("__import__('os')", "c + 1", "a if b else a"):
        with pytest.raises(ValueError):
            similarity.score_expression(bad, ["a", "b"])


def test_communities_of_two_planted_groups(spark):
    edges = [(a, b, 1.0) for g in (range(6), range(10, 16)) for a in g for b in g if a < b] + [(0, 10, 0.1), (50, 50, 1.0)]
    e = spark.createDataFrame(edges, "src bigint, dst bigint, weight double")
    parts = cluster.louvain(e)
    assert {r.node: r.part for r in parts.collect()} == {**dict.fromkeys(range(6), 0), **dict.fromkeys(range(10, 16), 10), 50: 50}
    assert cluster.modularity(e, parts).first()[0] > 0.45


def test_complete_linkage_needs_every_pair():
    assert cluster.complete_linkage(3, [(0, 1, 0.9), (1, 2, 0.8)]) == [0, 0, 2]
    assert cluster.complete_linkage(3, [(0, 1, 0.9), (1, 2, 0.8), (0, 2, 0.1)]) == [0, 0, 0]
    assert cluster.complete_linkage(0, []) == []


def _plain_linkage(score):
    """Complete linkage by looking at the whole matrix for every merge."""
    score = np.where(score > 0, score, 0)
    np.fill_diagonal(score, 0)
    label = np.arange(len(score))
    while len(score) and score.max() > 0:
        a, b = divmod(int(score.argmax()), len(score))
        score[a] = score[:, a] = np.minimum(score[a], score[b])
        score[b] = score[:, b] = 0
        label[label == b] = a
    return label.tolist()


def test_complete_linkage_by_parts_is_the_plain_one(monkeypatch):
    draw = np.random.default_rng(7)
    for most, cells, pairs in ((1000, 300_000, 100_000), (3, 7, 5), (2, 50, 3), (5, 20, 10)):
        for name, value in (("MATRIX", most), ("CELLS", cells), ("PAIRS", pairs)):
            monkeypatch.setattr(linkage, name, value)
        for _ in range(100):
            n = int(draw.integers(1, 24))
            score = draw.integers(-1, int(draw.integers(2, 40)), (n, n)) / 10  # many ties
            score[draw.random((n, n)) > draw.random()] = 0
            score = np.maximum(score, score.T)
            plain = _plain_linkage(score.copy())
            a, b = np.triu_indices(n, 1)
            some = score[a, b] > 0
            assert cluster.complete_linkage(n, [(x, y, score[x, y]) for x in range(n) for y in range(n)]) == plain
            assert linkage.heap_labels(n, a[some], b[some], score[a, b][some]).tolist() == plain
            of = lambda x, y: score[np.ix_(x, y)]  # noqa: B023, E731
            assert linkage.block_labels(n, of).tolist() == plain
            assert linkage.block_labels(n, of, 0.0, linkage.block_labels(n, of, 1.0)).tolist() == plain


def test_linkage_of_a_large_partition_takes_little_memory():
    """9,000 columns in a chain of 25 blocks, of which a matrix would be 648 MB."""
    n, of = 9_000, 40
    i = np.arange(n)
    a = np.repeat(i, of)
    b = a + np.tile(np.arange(1, of + 1), n)
    same = (b < n) & (a // 360 == np.minimum(b, n - 1) // 360)
    tracemalloc.start()
    label = linkage.scored_labels(n, np.r_[a[same], i[360::360] - 1], np.r_[b[same], i[360::360]], np.r_[0.5 + 0.5 / (1 + b[same] - a[same]), np.full(24, 0.3)])
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()
    assert (label // 360 == i // 360).all() and np.bincount(label).max() <= of + 1
    tracemalloc.start()
    assert not linkage.block_labels(4000, lambda x, y: 0.5 + 0.5 / (1 + abs(y[None] * 7919 % 10007 - x[:, None] * 7919 % 10007))).any()
    assert tracemalloc.get_traced_memory()[1] < 40e6  # half a matrix would be 64 MB
    tracemalloc.stop()


def test_block_clusters_are_those_of_all_pairs(spark):
    draw = np.random.default_rng(3)
    columns, links, pairs, expected = [], [], [], {}
    for part in (1, 2, 3, None):
        n = 26
        ids = draw.permutation(100)[:n] + 1000 * (part or 9)
        ids.sort()
        block = draw.integers(0, 6, n) if part != 3 else np.arange(n) // 2
        at = draw.integers(0, 9, n) / 4.0
        score = np.where(block[:, None] == block[None], 1 / (1 + abs(at[:, None] - at[None])) - 0.4, 0)
        for x in range(n):
            columns.append((part, None if block[x] == 5 else int(block[x]), int(ids[x]), float(at[x])))
            for y in range(x):
                if block[x] != block[y] and draw.random() < (0.8 if part == 3 else 0.5):
                    score[x, y] = score[y, x] = s = float(draw.integers(-1, 9 if part == 1 else 4)) / 10
                    links.append((part, int(ids[x]), int(ids[y]), s))
        label = np.array(_plain_linkage(score))
        roots = sorted(set(label.tolist()), key=lambda r: (-(label == r).sum(), r))
        expected |= {(part, int(ids[x])): roots.index(label[x]) for x in range(n)}
        assert len(roots) < n and any(len(set(block[label == r])) > 1 for r in roots)
    c = spark.createDataFrame(columns, "part bigint, block int, gci bigint, at double")
    e = spark.createDataFrame([*links, (1, columns[0][2], columns[0][2], 5.0)], "part bigint, c1 bigint, c2 bigint, score double")
    score = lambda x, y: 1 / (1 + abs(x["at"] - y["at"])) - 0.4
    assert {(r.part, r.gci): r.cluster for r in cluster.block_clusters(c, score, e).collect()} == expected
    assert cluster.block_clusters(c.filter("part = 1"), score).select("cluster").distinct().count() >= 6


def test_cluster_and_stitch(spark):
    t = spark.createDataFrame([("a", [["Name", "Age"]], [["ann lee", "1"], ["bob ray", "2"]]), ("b", [["Age", "Name"]], [["1", "ann lee"], ["9", "bob ray"]]), ("c", [["z"]], [["other"]])], "table_id string, head array<array<string>>, body array<array<string>>").withColumn("num_cols", F.array_max(F.transform("body", F.size))).withColumn("num_rows", F.size("body"))
    ts = tableset.TableSet(t).cluster()
    parts = {r.table_id: r.part for r in ts.extra["partitions"].collect()}
    assert parts["a"] == parts["b"] and "c" not in parts
    wide = {}
    for r in ts.extra["stitched"].collect():
        wide.setdefault((r.table_id, r.ri), {})[r.pci] = r.text
    names = {k for row in wide.values() for k, v in row.items() if " " in v}
    assert len(wide) == 4 and len(names) == 1


def test_cluster_keeps_columns_without_partner(spark):
    tables = [("a", [["Name", "Note"]], [["ann lee", "only here"], ["bob ray", "nor there"]]), ("b", [["Name"]], [["ann lee"], ["bob ray"]])]
    t = spark.createDataFrame(tables, "table_id string, head array<array<string>>, body array<array<string>>").withColumn("num_cols", F.array_max(F.transform("body", F.size))).withColumn("num_rows", F.size("body"))
    out = tableset.TableSet(t).cluster().extra
    assert {r.text for r in out["stitched"].collect()} == {"ann lee", "bob ray", "only here", "nor there", ""}
    assert {r.gci: r.cluster for r in out["col_clusters"].collect()} == {0: 0, 2: 0, 1: 1}
    alone = tableset.TableSet(t).cluster(max_cluster_size=1).extra["stitched"].collect()
    assert {(r.table_id, r.ri) for r in alone} == {("a", 0), ("a", 1), ("b", 0), ("b", 1)}
    other = spark.createDataFrame([(0, 1, 1, 0, 0.8)], "ti1 long, ti2 long, ci1 int, ci2 int, score double")
    both = tableset.TableSet(t).cluster(matchers={"cell": similarity.cell_jaccard, "other": other}, agg_func="max").extra["col_clusters"].collect()
    assert {r.gci for r in both} == {0, 1, 2}
    by_other = {r.gci: r.cluster for r in tableset.TableSet(t).cluster(matchers={"other": other}).extra["col_clusters"].collect()}
    assert by_other[1] == by_other[2] != by_other[0]


def test_header_union_keeps_all_rows(spark):
    df = spark.createDataFrame([("h", "b", 0), ("h", "a", 0), ("h", "a", 1), ("g", "c", 0)], "header string, table_id string, ri int")
    n = df.groupBy("header", "table_id").agg(F.count("*").alias("n"))
    assert rows(cluster.header_union(df, "header", "table_id", n).select("header", "table_id", "ri", "union_ri")) == [("g", "c", 0, 0), ("h", "a", 0, 0), ("h", "a", 1, 1), ("h", "b", 0, 2)]


# --- linking -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def mini(spark):
    labels = spark.createDataFrame([("u:ams", "amsterdam", 1.0), ("u:ams2", "amsterdam", 1.0), ("u:par", "paris", 1.0), ("u:nl", "netherlands", 1.0), ("u:fr", "france", 1.0)], "uri string, txt string, score double")
    triples = spark.createDataFrame([("u:ams", "in", "u:nl"), ("u:par", "in", "u:fr"), ("u:x", "likes", "u:ams2"), ("u:y", "likes", "u:ams2")], "s string, p string, o string")
    types = spark.createDataFrame([("u:ams", "City"), ("u:par", "City"), ("u:ams2", "Ship"), ("u:nl", "Country"), ("u:fr", "Country")], "uri string, type string")
    cells = body(spark, ("t", [["Amsterdam", "Netherlands", "1"], ["Paris", "France", "2"], ["Paris (City)", "x", "3"]]))
    return labels, triples, types, cells


def test_link_and_integrate(spark, mini):
    labels, triples, types, cells = mini
    e = link.link_first(cells, labels, types, triples)
    got = {(r.ci, r.ri): r.uri for r in e.collect()}
    assert got[0, 1] == "u:par" and got[1, 0] == "u:nl" and (2, 0) not in got
    cand = cells.join(link.search(cells, labels), "text").select("table_id", "ri", "ci", "uri", "score")
    assert {r.uri for r in link.link_salient(cand, triples).collect()} == {"u:ams", "u:nl", "u:par", "u:fr"}
    facts = link.row_facts(cand, triples)
    n = spark.createDataFrame([("t", 3)], "table_id string, n int")
    assert rows(link.column_properties(facts, n)) == [("t", 0, 1, "in", 2 / 3)]
    assert "u:par" in {r.uri for r in link.search(cells, labels, parts=True).filter("text = 'Paris (City)'").collect()}


def test_nary(spark):
    e = spark.createDataFrame([("t", 0, 0, "a"), ("t", 0, 1, "b"), ("t", 0, 2, "q")], "table_id string, ri int, ci int, uri string")
    lit = spark.createDataFrame([("t", 0, 3, "1,999")], "table_id string, ri int, ci int, text string")
    st = spark.createDataFrame([("a", "s1", "p", "b")], "s string, stmt_id string, p string, o string")
    qu = spark.createDataFrame([("s1", "role", "q", False), ("s1", "year", "1999", True)], "stmt_id string, qp string, qo string, literal boolean")
    out = link.nary_facts(e, lit, st, qu)
    assert rows(out) == [("t", 0, 0, 1, "p", 2, "role"), ("t", 0, 0, 1, "p", 3, "year")]
    assert rows(link.integrate_nary(out, spark.createDataFrame([("t", 1)], "table_id string, n int"))) == [("t", 0, 1, "p", 1.0), ("t", 0, 2, "role", 1.0), ("t", 0, 3, "year", 1.0)]


# --- profiles and evaluation -----------------------------------------------------------------


def test_dependencies_are_minimal(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "y"), (4, "b", "y")], "k int, g string, h string")
    got = {(r.det, r.dep) for r in profile.dependencies(df, ["k", "g", "h"], 2, 0.0).collect()}
    assert got == {("k", "g"), ("k", "h"), ("g", "h"), ("h", "g")}
    fact, rest = profile.decompose(df, ["g"], ["h"])
    assert rows(fact) == [("a", "x"), ("b", "y")] and rest.columns == ["k", "g"]
    assert {(r.det, r.dep) for r in stitching.key_candidates(df, ["k", "g", "h"]).collect()} == got


def test_types(spark):
    cells = body(spark, ("t", [["1999", "1,5", "Bob", "2001-01-02"], ["2000", "2", "Al", "3 May 2002"], ["2001", "x", "Cy", "q"]]))
    assert {(r.ci, r.type) for r in profile.types_of_columns(cells).collect()} == {(0, "dateTime"), (1, "decimal"), (2, "string"), (3, "dateTime")}


def test_scores_and_curve(spark):
    key = "t string, uri string"
    g = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], key)
    p = spark.createDataFrame([("1", "a", 0.9), ("2", "x", 0.8), ("2", "b", 0.5), ("9", "z", 0.7)], key + ", score double")
    f = evaluate.annotated_only(evaluate.flagged(g, p, ["t", "uri"]), ["t"])
    s = evaluate.scores(f).first()
    assert (s.tp, s.fp, s.fn, s.support) == (2, 1, 1, 3)
    a = evaluate.scores(evaluate.any_annotated(f, ["t"])).first()
    assert (a.tp, a.fp, a.fn) == (2, 0, 1)
    assert rows(evaluate.pr_curve(f)) == [(0.5, 2 / 3, 2 / 3), (0.8, 0.5, 1 / 3), (0.9, 1.0, 1 / 3), (None, 1.0, 0.0)]


def test_triples(spark):
    e = spark.createDataFrame([("t", 0, 0, "a", True, True, 1.0), ("t", 1, 0, "b", False, True, 0.5)], "table_id string, ri int, ci int, uri string, gold boolean, pred boolean, score double")
    cells = body(spark, ("t", [["A", "5"], ["B", ""]]))
    props = spark.createDataFrame([("t", 0, 1, "age")], "table_id string, from_ci int, to_ci int, uri string")
    assert rows(evaluate.property_triples(e, cells, props)) == [("a", "age", "5", "literal")]
    assert rows(evaluate.label_triples(cells, e).select("s", "o")) == [("a", "A"), ("b", "B")]
    classes = spark.createDataFrame([("t", 0, "C", True, False)], "table_id string, ci int, uri string, gold boolean, pred boolean")
    assert rows(evaluate.class_triples(e, classes)) == [("a", "rdf:type", "C", True, False)]


def test_functions(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    assert one(T.repaired(F.lit("CafÃ©"))) == "Café" and one(T.repaired(F.lit("Café"))) == "Café"
    assert one(T.title_key(F.lit("New_York%20City"))) == "new york city"
    assert one(T.surfaces_of_uri(F.lit("http://x/Paris,_Texas_(city)"))) == ["Paris, Texas (city)", "Paris, Texas", "Paris"]
    assert one(T.literal_match(F.lit("1,000"), F.lit("990"), F.lit("decimal"))) == pytest.approx(0.99)
    assert one(T.literal_match(F.lit("2000"), F.lit("2000-01-11"), F.lit("dateTime"))) == pytest.approx(1 - 10 / 365)
    assert one(T.literal_match(F.lit("a b"), F.lit("B c"), F.lit(None).cast("string"))) == pytest.approx(1 / 3)
    assert one(T.tokens(F.lit("_Été"))) == ["_Été"] and one(T.tokens(F.lit("Été-là Été"))) == ["été", "là"]


# --- sources and plans ---------------------------------------------------------------------------


def test_jsonl_and_csv(spark, tmp_path):
    doc = {"_id": "p#1", "pgTitle": "P", "tableHeaders": [[{"text": "A"}]], "tableData": [[{"text": "x", "surfaceLinks": [{"offset": 0, "endOffset": 1, "target": {"href": "/X"}}]}]]}
    (tmp_path / "t.jsonl").write_text(json.dumps(doc) + "\n{broken\n" + json.dumps({"_id": "none"}) + "\n")
    (r,) = files.load(spark, str(tmp_path / "t.jsonl")).collect()
    assert (r.table_id, r.head, r.body, r.links[0].href) == ("p#1", [["A"]], [["x"]], "/X")
    (tmp_path / "c.csv").write_text('a,"b\nc",d\n1\n')
    (r,) = files.load(spark, str(tmp_path / "c.csv")).collect()
    assert (r.table_id, r.body, r.num_cols) == ("c", [["a", "b\nc", "d"], ["1"]], 3)
    again = files.write_jsonl(files.load(spark, str(tmp_path / "t.jsonl")), str(tmp_path / "out"))
    assert again.first().body == [["x"]]
    assert "<th>A</th>" in files.preview(again)


def test_pages(spark, tmp_path):
    import gzip

    record = b"HTTP/1.1 200 OK\r\n\r\n<html>\xc3\xa9</html>"
    warc = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a?about=E\r\nContent-Length: %d\r\n\r\n%s\r\n\r\nWARC/1.0\r\nWARC-Type: request\r\nContent-Length: 0\r\n\r\n\r\n\r\n" % (len(record), record)
    (tmp_path / "w.warc.gz").write_bytes(gzip.compress(warc))
    assert rows(files.warc_pages(spark, str(tmp_path / "w.warc.gz"))) == [("http://a", "<html>é</html>", "E")]
    (tmp_path / "l.txt").write_text('http://x/Foo "<html>\\u00e9</html>"\nbad\n')
    assert rows(files.line_pages(spark, str(tmp_path / "l.txt"), title="/([A-Za-z]+)$")) == [("http://x/Foo", "<html>é</html>", "Foo")]


def test_wdc(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"relation": [["A", "1", "2"], ["B", "x"]], "headerPosition": "FIRST_ROW", "url": "http://h.org/p", "tableNum": 3}) + "\n" + json.dumps({"relation": [["A"]], "headerPosition": "NONE"}))
    df = files.read_wdc(spark, str(tmp_path / "w.json"))
    (r,) = df.collect()
    assert (r.table_id, r.head, r.body, r.domain) == ("http://h.org/p#3", [["A", "B"]], [["1", "x"], ["2", ""]], "h.org")
    assert json.loads(files.to_wdc(df).first().json)["relation"] == [["A", "1", "2"], ["B", "x", ""]]


def test_gold(spark, tmp_path):
    for d in ("tables", "ent", "prop"):
        (tmp_path / d).mkdir()
    (tmp_path / "tables/x.csv").write_text("Name,Country\nParis,France\n")
    (tmp_path / "ent/x.csv").write_text('"http://dbpedia_org/page/Paris","paris","1"\n')
    (tmp_path / "classes.csv").write_text('"x.tar.gz","City","http://c"\n')
    (tmp_path / "prop/x.csv").write_text('"label","Name","True","0"\n"http://p","Country","False","1"\n')
    g = gold.t2d(spark, str(tmp_path / "tables/*.csv"), str(tmp_path / "ent"), str(tmp_path / "classes.csv"), str(tmp_path / "prop"))
    assert rows(g["cell_entities"]) == [("x", 0, 1, "http://dbpedia.org/resource/Paris")] and rows(g["col_classes"]) == [("x", 0, "http://c")] and rows(g["col_properties"]) == [("x", 0, 1, "http://p")]
    (tmp_path / "cea.csv").write_text('"x","1","0","http://e"\n')
    s = gold.semtab(spark, str(tmp_path / "tables/*.csv"), cea=str(tmp_path / "cea.csv"))
    assert s["tables"].first().head == [["Name", "Country"]] and rows(s["cell_entities"]) == [("x", 0, 0, "http://e")] and s["entity_columns"].count() == 2


def test_kb(spark, tmp_path):
    (tmp_path / "k.nt").write_text('<a> <http://www.w3.org/2000/01/rdf-schema#label> "A x"@en .\n<a> <http://www.w3.org/2000/01/rdf-schema#label> "B"@de .\n<a> <p> <b> .\n<a> <n> "5"^^<int> .\n# no\n')
    t = kb.ntriples(spark, str(tmp_path / "k.nt"), languages=["en"])
    assert {(r.p, r.o, r.o_kind) for r in t.collect()} == {("http://www.w3.org/2000/01/rdf-schema#label", "A x", "literal"), ("p", "b", "uri"), ("n", "5", "literal")}
    assert rows(kb.labels(t)) == [("a", "a x", 1.0)]
    doc = {"id": "Q1", "labels": {"en": {"value": "One"}}, "aliases": {}, "claims": {"P1": [{"id": "s1", "mainsnak": {"datavalue": {"type": "wikibase-entityid", "value": {"id": "Q2"}}}, "qualifiers": {"P2": [{"datavalue": {"type": "time", "value": {"time": "+2000"}}}]}}]}}
    (tmp_path / "w.json").write_text("[\n" + json.dumps(doc) + ",\n]\n")
    w = kb.wikidata(spark, str(tmp_path / "w.json"))
    assert rows(w["labels"]) == [("Q1", "one", 1.0)] and rows(w["statements"]) == [("Q1", "s1", "P1", "Q2")] and rows(w["qualifiers"]) == [("s1", "P2", "+2000", True)]
    (tmp_path / "v.txt").write_text("ann 1 0\nlee 0 1\n")
    v = kb.pooled(spark.createDataFrame([("c", "Ann Lee"), ("c", "zz")], "id string, text string"), kb.word_vectors(spark, str(tmp_path / "v.txt")))
    assert v.first().v == pytest.approx([0.5**0.5] * 2)


def test_config():
    c = {"assets": [{"name": "kb", "a": 1, "b": {"c": 2}}], "step": [{"step": "take", "n": {"resolve": "kb", "b": {"d": 3}}}]}
    assert config.steps_of(c) == [{"step": "take", "n": {"a": 1, "b": {"c": 2, "d": 3}}}]
    assert config.load('[[step]]\nstep = "take"\nn = 1') == {"step": [{"step": "take", "n": 1}]}
    with pytest.raises(ValueError):
        config.resolved({"resolve": "x"}, {"x": {"resolve": "x"}})
    with pytest.raises(ValueError):
        config.resolved({"resolve": "y"}, {})


def test_pipeline_with_split_and_cache(spark, tmp_path):
    t = spark.createDataFrame([("a", [["A", "B"]], [["1", "x"], ["", ""]]), ("b", [["A"]], [["2"]])], "table_id string, head array<array<string>>, body array<array<string>>").withColumn("num_cols", F.size(F.col("body")[0])).withColumn("num_rows", F.size("body"))
    steps = {"step": [{"step": "reshape"}, {"split": [[{"step": "filter", "filters": ["num_cols > 1"]}], [{"step": "take", "n": 2}]]}, {"step": "coltypes"}]}
    for _ in range(2):
        out = tableset.run(tableset.TableSet(t), steps, str(tmp_path / "work"))
        assert {k: sorted(r.table_id for r in v.tables.collect()) for k, v in out.items()} == {"r0": ["a"], "r1": ["a", "b"]}
    with pytest.raises(ValueError):
        tableset.run(tableset.TableSet(t), {"step": [{"step": "nothing"}]})


def test_stream_of_pages(spark, tmp_path):
    from loomtable.streaming import pages as S

    (tmp_path / "in").mkdir()
    page = "<html><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table></html>"
    (tmp_path / "in/1.json").write_text("".join(json.dumps({"url": u, "html": page, "ts": "2024-01-01T00:10:00Z"}) + "\n" for u in "ab"))
    for name, df in (("tables", S.tables(S.pages(spark, str(tmp_path / "in")))), ("heads", S.header_counts(S.pages(spark, str(tmp_path / "in"))))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "tables" else "update").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert rows(spark.sql("SELECT table_id, num_rows FROM tables")) == [("a#0", 1), ("b#0", 1)]
    assert rows(spark.sql("SELECT header, n FROM heads")) == [("A|B", 2)]


# --- scale ------------------------------------------------------------------------------------


def test_running_sums_are_exact_over_many_ranges(spark):
    """Wide rows and many partitions: ranges that were dealt twice would differ."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        n = 1_500_000
        df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.lit("x"), 100).alias("wide"), (F.col("id") % 5).alias("n"))
        assert tuple(C.offsets(df, F.lit(1), ["k"], "o").agg(F.count("*"), F.sum((F.col("o") != F.col("k")).cast("int"))).first()) == (n, 0)
        t = C.number_columns(df.select(F.format_string("%07d", "k").alias("table_id"), F.col("n").alias("num_cols"))).agg(F.count_distinct("table_index"), F.max("table_index"), F.max(F.col("col_offset") + F.col("num_cols"))).first()
        assert tuple(t) == (n, n - 1, 2 * n)
        curve = spark.range(200_000).select(F.col("id").cast("double").alias("score"), F.lit(True).alias("gold"), F.lit(True).alias("pred"))
        assert tuple(evaluate.pr_curve(curve).agg(F.max("recall"), F.min("precision")).first()) == (1.0, 1.0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_components_of_a_long_chain_and_a_large_star(spark):
    chain = spark.range(5000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    star = spark.range(20_000).select(F.lit(10_000).cast("bigint").alias("src"), (F.col("id") + 10_001).alias("dst"))
    assert rows(cluster.components(chain.union(star)).groupBy("component").count()) == [(0, 5001), (10_000, 20_001)]


def test_intermediate_tables_can_be_deleted(spark):
    from loomtable.operators import scratch

    at = scratch.mark()
    a, b = scratch.written(spark.range(3), "a"), scratch.written(spark.range(4), "b")
    scratch.dropped_since(spark, at, b)
    assert b.count() == 4 and scratch.mark() == at + 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FAILED_READ"):
        spark.read.parquet(a._loomtable_path).count()


def test_pairs_by_prefixes_lose_nothing(spark):
    import random

    r = random.Random(3)
    texts = [(i, " ".join(["the", *(r.choice("abcdefghij") for _ in range(r.randint(0, 6)))])) for i in range(120)] + [(500, ""), (501, None)]
    df = spark.createDataFrame(texts, "id bigint, text string")
    sets = {i: set((t or "").split()) for i, t in texts}
    for least in (0.1, 0.5, 0.75):
        want = sorted((a, b) for a in sets for b in sets if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least)
        assert sorted((x.a, x.b) for x in similarity.shared_token_pairs(df, df, least).collect()) == want
    weights = [(i, w, r.random()) for i, s in sets.items() for w in s]
    vec = {i: {w: v for j, w, v in weights if j == i} for i in sets}
    norm = lambda v: sum(x * x for x in v.values()) ** 0.5
    for least in (0.3, 0.8):
        want = sorted((a, b) for a in vec for b in vec if a < b and vec[a] and vec[b] and sum(x * vec[b].get(w, 0) for w, x in vec[a].items()) / norm(vec[a]) / norm(vec[b]) > least)
        assert sorted((x.a, x.b) for x in similarity.sparse_cosine(spark.createDataFrame(weights, "id bigint, key string, w double"), least).collect()) == want


def test_top_cosine_in_blocks(spark):
    import numpy as np

    r = np.random.default_rng(4)
    v = r.normal(size=(300, 5))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id bigint, v array<double>").repartition(3)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    want = {(i, int(j), k) for i in range(300) for k, j in enumerate(np.lexsort((np.arange(300), -s[i]))[:4], 1)}
    for block in (16_384, 100):
        assert {(x.query, x.id, x["rank"]) for x in similarity.top_cosine(df, df, 4, block=block).collect()} == want
