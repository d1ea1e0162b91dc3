"""A Merkle manifest of a dataset: leaves are rows, each source has a tree of 16-ary runs, and the sources' roots have one.

Executors run ordered string_agg and sha256 level queries of DuckDB on Arrow blocks of whole buckets, a bucket being 4096
leaves of a source that start at a multiple of 4096; Spark makes the levels above from the buckets' roots, a grouping by
run each, and joins each bucket's outer proof back to its block. No source, level or tree is ever in one task.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnframe.llm.common import materialize

FAN = 16
#: Levels that a bucket makes on its own.
INNER = 3
#: Buckets that one DuckDB query takes together, about.
BLOCK = 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_OUTER = "array<struct<before:string,after:string>>"
_PROVED_SQL = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, source string"


def _field(c: F.Column) -> F.Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, changed): each row's hash, and that of the tampered row where it is one of those that are tampered with."""
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    digest = lambda text: F.sha2(F.concat(*(_field(F.col(c)) for c in FIELDS[:-1]), _field(text)), 256)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return row.select("source", "doc_id", digest(F.col("text")).alias("leaf"), F.when(tampered, digest(F.translate("text", UPPER, LOWER))).alias("changed"))


def ranked(spark: SparkSession, df: DataFrame, group: str, order: list[str], tag: str) -> tuple[DataFrame, DataFrame]:
    """df with idx, a row's place among the rows of its group by order (nulls first), and size, the group's rows; and (group, size).

    Rows are sorted in ranges and numbered there; a range adds what the ranges before it hold of the group. So a group of
    any size is spread over many tasks.
    """
    ranges = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    place = F.monotonically_increasing_id()
    rows = materialize(spark, ranges.select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("at")), tag)
    held = rows.groupBy("part", group).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy(group).orderBy("part")
    starts = held.select("part", F.col(group).alias("of"), "first", (F.sum("n").over(before) - F.col("n")).alias("skip"), F.sum("n").over(Window.partitionBy(group)).alias("size"))
    numbered = rows.alias("r").join(starts, (rows["part"] == starts["part"]) & rows[group].eqNullSafe(F.col("of"))).select("r.*", (F.col("skip") + F.col("at") - F.col("first")).alias("idx"), "size").drop("part", "at")
    return numbered, starts.select(F.col("of").alias(group), "size").distinct()


def _levels(most: int) -> int:
    """Levels of a tree of so many leaves."""
    n = 0
    while most > 1:
        most, n = -(-most // FAN), n + 1
    return n


def tree(spark: SparkSession, nodes: DataFrame, most: int, tag: str) -> DataFrame:
    """(grp, idx, h, size) -> (grp, idx, top, path): of each node the root of its group and the siblings before and after it, level by level.

    A run of 16 nodes is one row of a grouping. size is the number of nodes of the group, most the greatest of these.
    """
    runs, now = [], nodes.select("grp", "idx", "h", "size")
    for level in range(_levels(most)):
        members = F.array_sort(F.collect_list(F.struct("idx", "h")))
        grouped = now.where("size > 1").groupBy("grp", F.expr(f"idx div {FAN}").alias("up"), "size").agg(members.alias("run"))
        runs.append(materialize(spark, grouped, f"{tag}-runs"))
        up = runs[-1].select("grp", F.col("up").alias("idx"), F.sha2(F.concat_ws("", "run.h"), 256).alias("h"), F.expr(f"(size + {FAN - 1}) div {FAN}").alias("size"))
        now = up.union(now.where("size = 1").select("grp", "idx", "h", "size"))
    found = now.select("grp", "idx", F.col("h").alias("top"), F.array().cast(_OUTER).alias("path"), F.col("size").alias("level_size"))
    for run in reversed(runs):
        up = found.withColumnRenamed("idx", "up").drop("level_size")
        side = lambda lo, n: F.concat_ws("", F.slice("run.h", lo, n))
        down = run.join(up, ["grp", "up"]).select("grp", "top", "path", "run", "size", F.posexplode("run").alias("k", "node"))
        step = F.struct(side(F.lit(1), F.col("k")).alias("before"), side(F.col("k") + 2, F.lit(FAN)).alias("after"))
        below = down.select("grp", F.col("node.idx").alias("idx"), "top", F.concat(F.array(step), F.col("path")).cast(_OUTER).alias("path"), F.col("size").alias("level_size"))
        # groups that this level's runs don't hold were single nodes already
        kept = found.join(run.select("grp").distinct(), "grp", "left_anti")
        found = materialize(spark, below.unionByName(kept), f"{tag}-paths")
    return found.select("grp", "idx", "top", "path")


def _level_query(below: str) -> str:
    return f"SELECT grp, bucket, levels, node // {FAN} AS node, sha256(string_agg(h, '' ORDER BY node)) AS h FROM {below} GROUP BY ALL"


def _block(con: duckdb.DuckDBPyConnection, inner: int) -> None:
    """Tables level0, level1 and on of the block's buckets, from its leaves. A bucket stops where its tree does."""
    con.execute(f"CREATE TEMP TABLE level0 AS SELECT grp, idx // {FAN**inner} AS bucket, idx % {FAN**inner} AS node, least({inner}, levels) AS levels, leaf AS h FROM leaf")
    for n in range(inner):
        con.execute(f"CREATE TEMP TABLE level{n + 1} AS {_level_query(f'(FROM level{n} WHERE levels > {n})')}")


def _connect(**tables: pa.Table) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
    for name, t in tables.items():
        con.register(name, t)
    return con


def _arrow(con: duckdb.DuckDBPyConnection, sql: str, schema: pa.Schema) -> pa.Table:
    return con.sql(sql).to_arrow_table().cast(schema)


def _roots(table: pa.Table, inner: int) -> pa.Table:
    """The root of each bucket of a block."""
    with _connect(leaf=table) as con:
        _block(con, inner)
        tops = " UNION ALL ".join(f"SELECT grp, bucket, h FROM level{n} WHERE levels = {n}" for n in range(inner + 1))
        return _arrow(con, tops, pa.schema([("grp", pa.int64()), ("bucket", pa.int64()), ("h", pa.string())]))


_PROVED = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()), ("source", pa.string())])


def _prove(table: pa.Table, outer: pa.Table, inner: int) -> pa.Table:
    """Proofs of a block's leaves, and the root folded from each leaf or its tampered form."""
    with _connect(leaf=table, outside=outer) as con:
        _block(con, inner)
        con.execute(f"CREATE TEMP TABLE fold0 AS SELECT grp, idx // {FAN**inner} AS bucket, idx, idx % {FAN**inner} AS node, least({inner}, levels) AS levels, coalesce(changed, leaf) AS h, '' AS proof FROM leaf")
        for n in range(inner):
            # siblings of each node: those of its run, without it
            con.execute(f"""CREATE TEMP TABLE beside{n} AS SELECT grp, bucket, node, coalesce(string_agg(h, '' ORDER BY node) OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                coalesce(string_agg(h, '' ORDER BY node) OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
                FROM level{n} WHERE levels > {n} WINDOW run AS (PARTITION BY grp, bucket, node // {FAN} ORDER BY node)""")
            con.execute(f"""CREATE TEMP TABLE fold{n + 1} AS SELECT f.grp, f.bucket, f.idx, f.node // {FAN} AS node, f.levels,
                CASE WHEN f.levels > {n} THEN sha256(b.before || f.h || b.after) ELSE f.h END AS h, f.proof || coalesce(b.before || b.after, '') AS proof
                FROM fold{n} f LEFT JOIN beside{n} b USING (grp, bucket, node)""")
        depth = con.execute("SELECT coalesce(max(len(path)), 0) FROM outside").fetchone()[0]
        con.execute(f"CREATE TEMP TABLE out0 AS SELECT f.grp, f.idx, f.h, f.proof, o.path, o.subroot, o.root FROM fold{inner} f JOIN outside o USING (grp, bucket)")
        for k in range(1, depth + 1):
            h = f"CASE WHEN len(path) >= {k} THEN sha256(path[{k}].before || h || path[{k}].after) ELSE h END"
            proof = f"CASE WHEN len(path) >= {k} THEN proof || path[{k}].before || path[{k}].after ELSE proof END"
            con.execute(f"CREATE TEMP TABLE out{k} AS SELECT grp, idx, {h} AS h, {proof} AS proof, path, subroot, root FROM out{k - 1}")
        return _arrow(con, f"SELECT l.doc_id, l.leaf, o.subroot, o.root, sha256(o.proof) AS proof_sha256, o.h AS folded_root, o.h = o.root AS verified, l.source FROM out{depth} o JOIN leaf l USING (grp, idx)", _PROVED)


def manifest(spark: SparkSession, docs: DataFrame, inner: int = INNER) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, source) of each row of docs.

    A null in any column is hashed as `-`; an empty text as its length and nothing. Rows that repeat a doc_id within a
    source come in order of their leaves, a null doc_id before all others (it is never tampered with); equal rows are
    leaves each and interchangeable. A null source is a source of its own, before all others. Texts are hashed whole, by
    Spark, whatever their length. Other columns are ignored. No rows give no rows.
    """
    placed, sizes = ranked(spark, leaves(docs), "source", ["doc_id", "leaf"], "merkle")
    # sources are numbered in order, by ranges as well
    of_source, _ = ranked(spark, sizes.select(F.lit(0).alias("all"), F.col("source").alias("name"), F.col("size").alias("rows")), "all", ["name"], "merkle-sources")
    of_source = materialize(spark, of_source.select("name", "rows", F.col("idx").alias("grp"), F.col("size").alias("sources")), "merkle-groups")
    most_rows, sources, total = of_source.agg(F.coalesce(F.max("rows"), F.lit(0)), F.coalesce(F.max("sources"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    level_of = F.lit(0)
    for n in range(_levels(most_rows)):
        level_of = level_of + F.when(F.col("rows") > FAN**n, 1).otherwise(0)
    size = FAN**inner
    bucket = F.expr(f"idx div {size}")
    block = F.pmod(F.xxhash64("grp", "bucket"), F.lit(max(1, -(-total // (BLOCK * size)))))
    numbered = placed.join(of_source, placed["source"].eqNullSafe(of_source["name"])).select("doc_id", "source", "leaf", "changed", "idx", "grp", level_of.alias("levels"), bucket.alias("bucket")).withColumn("block", block)
    numbered = materialize(spark, numbered, "merkle-leaves")
    tops = materialize(spark, numbered.select("block", "grp", "idx", "levels", "leaf").groupBy("block").applyInArrow(lambda t: _roots(t, inner), "grp long, bucket long, h string"), "merkle-buckets")
    groups = of_source.select("grp", F.expr(f"(rows + {size - 1}) div {size}").alias("size"))
    within = tree(spark, tops.withColumnRenamed("bucket", "idx").join(groups, "grp"), -(-most_rows // size), "merkle-inner")
    within = materialize(spark, within, "merkle-within")
    subroots = within.where("idx = 0").select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("idx"), F.col("top").alias("h"), F.lit(sources).cast("long").alias("size"))
    across = tree(spark, subroots, sources, "merkle-outer").select(F.col("idx").alias("grp"), F.col("top").alias("root"), F.col("path").alias("rest"))
    outer = within.join(across, "grp").select("grp", F.col("idx").alias("bucket"), F.col("top").alias("subroot"), "root", F.concat("path", "rest").alias("path")).withColumn("block", block)
    return numbered.drop("bucket").groupBy("block").cogroup(outer.groupBy("block")).applyInArrow(lambda t, o: _prove(t, o, inner), _PROVED_SQL)
