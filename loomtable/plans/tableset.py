"""A fluent interface: each method returns a new set of tables, nothing runs until rows are asked for."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtable.operators import cells as C
from loomtable.operators import clean, cluster, evaluate, link, profile, similarity, unpivot
from loomtable.operators.scratch import written
from loomtable.plans import config
from loomtable.sources import files
from loomtable.sources import html as H


class TableSet:
    """Tables (``tables``) with annotations and results of steps as further relations (``extra``)."""

    def __init__(self, tables: DataFrame, **extra: DataFrame):
        self.tables, self.extra = tables, extra

    # --- input and output
    @classmethod
    def load(cls, spark: SparkSession, *paths: str) -> TableSet:
        return cls(files.load(spark, *paths))

    @classmethod
    def extract(cls, pages: DataFrame, class_restrict: list[str] | None = None) -> TableSet:
        return cls(H.tables(pages, class_restrict))

    @classmethod
    def dataset(cls, relations: dict[str, DataFrame], take: int | None = None) -> TableSet:
        t = relations["tables"] if take is None else C.take(relations["tables"], take, "table_id")
        return cls(t, **{f"gold_{k}": v for k, v in relations.items() if k != "tables"})

    def dump(self, path: str) -> TableSet:
        return TableSet(files.write_jsonl(self.tables, path), **self.extra)

    def with_(self, tables: DataFrame | None = None, **extra: DataFrame) -> TableSet:
        return TableSet(self.tables if tables is None else tables, **self.extra | extra)

    def cells(self) -> DataFrame:
        return C.to_cells(self.tables)

    def _body(self) -> DataFrame:
        return self.cells().filter("section = 'body'").select("table_id", "ri", "ci", "text")

    # --- steps
    def filter(self, filters: list[str]) -> TableSet:
        return self.with_(C.where_all(self.tables, *filters))

    def discard_headerless(self) -> TableSet:
        return self.with_(C.with_header(self.tables))

    def reshape(self, max_columns: int = clean.MAX_COLUMNS, prefix_rules: DataFrame | None = None, pivots: list[dict] | None = None) -> TableSet:
        """Structural cleaning, then unpivoting of headers that the given patterns find: [{name, pattern}]."""
        t = clean.drop_wide(self.tables, max_columns)
        for step in (clean.drop_empty_rows, clean.spanning_header_rows, clean.drop_repeated_header, clean.drop_empty_rows):
            t = step(t)
        cells = clean.restack(clean.empty_columns(C.to_cells(t)))
        if prefix_rules is not None:
            cells = clean.prefix_rules(cells, prefix_rules).drop("header")
        attributes = t.select("table_id", *[c for c in t.columns if c not in ("table_id", "head", "body", "num_cols", "num_rows")])
        out = C.to_tables(cells).join(attributes, "table_id", "left")
        return self.with_(out).unpivot(pivots) if pivots else self.with_(out)

    def unpivot(self, pivots: list[dict], least: int = 2) -> TableSet:
        """Tables with a pivot become long: id columns, ``_Variable``, ``_Value``; others, and those whose pivot is the whole header, stay as they are."""
        cells = self.cells()
        head = cells.filter("section = 'head'")
        # Detection runs once per distinct header, not once per table.
        ids = head.groupBy("table_id").agg(T_header().alias("header_id"))
        one = ids.groupBy("header_id").agg(F.min("table_id").alias("table_id"))
        headers = head.join(one, "table_id").select("header_id", F.col("ri").alias("level"), "ci", "text")
        found = [unpivot.found_by_pattern(headers, p.get("name", f"pattern{i}"), p["pattern"], i) for i, p in enumerate(pivots)]
        best = unpivot.best_pivot(C.concat(*found), least)
        long = unpivot.unpivot_cells(cells.join(ids, "table_id"), best)
        rows = long.select("table_id", F.concat("ids", F.array("variable", "value")).alias("row"), "ri", "ci")
        body = rows.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ri", "ci", "row"))), lambda x: x["row"]).alias("long_body"))
        pivot_of = ids.join(best, "header_id").select("table_id", "level", "colfrom", "colto")
        df = self.tables.join(body, "table_id", "left").join(pivot_of, "table_id", "left")
        kept = F.expr("filter(element_at(head, level + 1), (c, i) -> i < colfrom OR i > colto)")
        done = F.col("long_body").isNotNull()
        df = df.withColumn("head", F.when(done, F.array(F.concat(kept, F.array(F.lit("_Variable"), F.lit("_Value"))))).otherwise(F.col("head"))).withColumn("body", F.coalesce("long_body", "body"))
        df = df.withColumn("num_cols", F.coalesce(F.array_max(F.transform("body", lambda r: F.size(r))), F.lit(0))).withColumn("num_rows", F.size("body"))
        return self.with_(df.drop("long_body", "level", "colfrom", "colto"))

    def cluster(self, agg_threshold: float = 0.0, agg_threshold_col: float = 0.0, edge_exp: float = 1.0, max_cluster_size: int = 250, how: str = "jacc", matchers: dict | None = None, agg_func: str = "mean", filters: tuple[str, ...] = ()) -> TableSet:
        """Tables that share a schema: similar columns, greedy alignment, communities, column clusters; adds ``partitions``, ``col_clusters`` and ``stitched``.

        ``matchers`` are column scores by name: ``similarity.Matcher``s, DataFrames (ti1, ti2, ci1, ci2, score), or functions that make one from
        cells (ti, ci, text) and blocks of tables; by default ``cell`` alone, the best Jaccard of two cells.  ``agg_func`` is an expression over
        their names; pairs must have a score over 0 by each matcher named in ``filters``.  Columns without a partner in their partition are
        clusters of their own.
        """
        t = written(C.number_columns(self.tables), "numbered")  # read several times below
        every = C.to_cells(t).join(t.select("table_id", F.col("table_index").alias("ti"), "col_offset"), "table_id")
        body = every.filter("section = 'body'")
        flat = body.select("ti", "ci", "text").distinct()
        block = similarity.cell_block(flat)
        matchers = matchers or {"cell": similarity.cell_jaccard}
        pairs = C.concat(*[(m.matches(every) if isinstance(m, similarity.Matcher) else m(flat, block) if callable(m) else m).select(*similarity.PAIR, "score", F.lit(name).alias("matcher")) for name, m in matchers.items()])
        pairs = pairs.select("ti1", "ti2", "ci1", "ci2", F.col("score").cast("double").alias("score"), "matcher").filter("ti1 < ti2")
        for name in filters:
            pairs = similarity.kept_by(pairs, pairs.filter(F.col("matcher") == name))
        scores = similarity.wide_scores(pairs, list(matchers)).select(*similarity.PAIR, similarity.score_expression(agg_func, list(matchers)).alias("score")).filter("score IS NOT NULL")
        scores = written(scores, "scores")  # read more than once below
        sims = similarity.normalised(similarity.greedy_alignment(scores), t.select(F.col("table_index").alias("ti"), F.col("num_cols").alias("n")), how).filter(F.col("sim") > agg_threshold)
        edges = sims.select(F.col("ti1").alias("src"), F.col("ti2").alias("dst"), F.col("sim").alias("weight"))
        parts = cluster.sliced(cluster.louvain(edges, edge_exp), max_cluster_size).select(F.col("node").alias("ti"), (F.col("part") * 100_000 + F.col("slice")).cast("bigint").alias("part"))
        parts = written(parts, "parts")
        off = t.select(F.col("table_index").alias("ti"), "col_offset")
        inside = scores.join(parts.withColumnsRenamed({"ti": "ti1", "part": "part"}), "ti1").join(parts.withColumnsRenamed({"ti": "ti2", "part": "part2"}), "ti2").filter((F.col("part") == F.col("part2")) & (F.col("score") > agg_threshold_col))
        gci = inside.join(off.withColumnsRenamed({"ti": "ti1", "col_offset": "o1"}), "ti1").join(off.withColumnsRenamed({"ti": "ti2", "col_offset": "o2"}), "ti2")
        found = gci.select("part", (F.col("o1") + F.col("ci1")).cast("bigint").alias("c1"), (F.col("o2") + F.col("ci2")).cast("bigint").alias("c2"), "score")
        width = t.select(F.col("table_index").alias("ti"), "col_offset", "num_cols").filter("num_cols > 0")
        own = parts.join(width, "ti").select("part", F.explode(F.expr("sequence(0, CAST(num_cols AS INT) - 1)")).alias("ci"), "col_offset").select("part", (F.col("col_offset") + F.col("ci")).cast("bigint").alias("c"))
        clusters = cluster.column_clusters(found.unionByName(own.select("part", F.col("c").alias("c1"), F.col("c").alias("c2"), F.lit(1.0).alias("score"))))
        clusters = written(clusters, "clusters")
        stitched = cluster.stitch(body.withColumn("gci", (F.col("col_offset") + F.col("ci")).cast("bigint")).select("table_id", "ri", "gci", "text"), clusters)
        return self.with_(partitions=parts.join(t.select("table_id", F.col("table_index").alias("ti")), "ti").select("table_id", "part"), col_clusters=clusters, stitched=stitched)

    def coltypes(self) -> TableSet:
        return self.with_(col_types=profile.types_of_columns(self._body()))

    def link(self, labels: DataFrame, types: DataFrame, triples: DataFrame, **how) -> TableSet:
        return self.with_(cell_entities=link.link_first(self._body(), labels, types, triples, self.extra.get("cell_entities"), **how))

    def integrate(self, triples: DataFrame) -> TableSet:
        e = self.extra["cell_entities"]
        rows = self.tables.select("table_id", F.col("num_rows").alias("n"))
        return self.with_(col_properties=link.column_properties(link.row_facts(e, triples), rows))

    def triples(self) -> DataFrame:
        return evaluate.property_triples(self.extra["cell_entities"], self._body(), self.extra["col_properties"])

    def novelty(self, kb: DataFrame) -> DataFrame:
        return evaluate.novelty(self.triples(), kb)

    def score(self, kind: str = "cell_entities") -> DataFrame:
        key = {"cell_entities": ["table_id", "ci", "ri", "uri"], "col_classes": ["table_id", "ci", "uri"], "col_properties": ["table_id", "from_ci", "to_ci", "uri"]}[kind]
        flags = evaluate.annotated_only(evaluate.flagged(self.extra[f"gold_{kind}"], self.extra[kind], key), key[:-1])
        return evaluate.scores(flags)

    def take(self, n: int) -> TableSet:
        return self.with_(C.take(self.tables, n, "table_id"))


def T_header():
    """Id of a table's header from its cells: all rows, in order."""
    from loomtable.functions import text as T

    return T.header_id(F.transform(F.array_sort(F.collect_list(F.struct("ri", "ci", "text"))), lambda x: F.concat_ws("\u001e", x["ri"].cast("string"), x["text"])))


#: Steps a pipeline may name.
STEPS = {"filter", "discard_headerless", "reshape", "unpivot", "cluster", "coltypes", "link", "integrate", "take", "dump"}


def run(start: TableSet, pipeline: str | dict, workdir: str | None = None, force: set[int] = frozenset(), assets: dict | None = None, named: dict[str, DataFrame] | None = None) -> dict[str, TableSet]:
    """Runs a pipeline of steps over a set of tables; returns the end of each branch by its path.

    A step ``{split = [[steps], [steps]]}`` forks: what came before is persisted
    and each branch goes its own way.  With ``workdir`` the tables after each
    step are written and a later run reads them instead, as long as the step
    and all before it are the same and not in ``force``.  Arguments that are
    ``{frame = "name"}`` are taken from ``named``.
    """
    frames = named or {}
    argument = lambda v: frames[v["frame"]] if isinstance(v, dict) and set(v) == {"frame"} else v

    def go(ts: TableSet, steps: list[dict], path: str, history: str) -> dict[str, TableSet]:
        for i, step in enumerate(steps):
            if "split" in step:
                ts.tables.persist()
                out: dict[str, TableSet] = {}
                for k, branch in enumerate(step["split"]):
                    out |= go(ts, list(branch) + steps[i + 1 :], f"{path}{k}", history + f"/{k}")
                return out
            name = step["step"]
            if name not in STEPS:
                raise ValueError(f"no step {name!r}; there are {sorted(STEPS)}")
            history += json.dumps(step, sort_keys=True)
            place = f"{workdir}/{path}-{i}-{name}-{hashlib.sha256(history.encode()).hexdigest()[:12]}" if workdir else None
            spark = ts.tables.sparkSession
            if place and i not in force:
                try:
                    ts = ts.with_(spark.read.parquet(place))
                    continue
                except Exception as e:  # noqa: BLE001 - only a missing result is expected here
                    if "PATH_NOT_FOUND" not in str(e):
                        raise
            ts = getattr(ts, name)(**{k: argument(v) for k, v in step.items() if k != "step"})
            if place:
                ts.tables.write.mode("overwrite").parquet(place)
                ts = ts.with_(spark.read.parquet(place))
        return {path: ts}

    return go(start, config.steps_of(config.load(pipeline), assets), "r", "")
