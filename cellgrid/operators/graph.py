"""Dependency graphs: closures, cones, certificates and small pipelines of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes reachable from `seeds` (node) along `edges` (src, dst), the seeds among them.

    Each round joins only the frontier; the frontier is checkpointed to the shared folder, so plans stay short.
    """
    spark = edges.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        import tempfile

        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cellgrid-"))  # unset: tests on one machine
    seen = seeds.select("node").distinct().checkpoint()
    frontier = seen
    while True:  # every round adds nodes, so it ends
        frontier = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier).checkpoint()
    return seen


def range_contains(areas: DataFrame, cells: DataFrame, band: int = 256) -> DataFrame:
    """Areas (id, r1, c1, r2, c2) that contain a cell (row, col): an equi-join on bands of rows, then the exact test.

    An area meets a cell once, in the cell's band; areas are spread over the bands that they cover.
    """
    spread = areas.withColumn("band", F.explode(F.sequence(F.floor(F.col("r1") / band), F.floor(F.col("r2") / band))))
    inside = (F.col("row") >= F.col("r1")) & (F.col("row") <= F.col("r2")) & (F.col("col") >= F.col("c1")) & (F.col("col") <= F.col("c2"))
    return spread.join(cells.withColumn("band", F.floor(F.col("row") / band)), "band").filter(inside).drop("band")


def certify(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, names: DataFrame) -> DataFrame:
    """Differences between an artifact and its edited form under the renaming `names` (node, new): node, problem.

    nodes: node, op; edges: node, pos, dep. No rows: the edited one is the same graph.
    """
    shared = names.groupBy("new").agg(F.count("*").alias("n")).filter("n > 1").join(names, "new").select("node", F.lit("not_injective").alias("problem"))
    made = new_nodes.select(F.col("node").alias("new"))
    extra = made.join(names.select("new"), "new", "left_anti").select(F.col("new").alias("node"), F.lit("undeclared").alias("problem"))
    renamed = nodes.join(names, "node", "left")
    lost = renamed.join(new_nodes.select(F.col("node").alias("new")), "new", "left_anti").select("node", F.lit("missing").alias("problem"))
    other = renamed.join(new_nodes.select(F.col("node").alias("new"), F.col("op").alias("new_op")), "new").filter("not (op <=> new_op)").select("node", F.lit("op").alias("problem"))
    want = edges.join(names, "node").select("node", "new", "pos", "dep").join(names.select(F.col("node").alias("dep"), F.col("new").alias("new_dep")), "dep")
    got = new_edges.select(F.col("node").alias("new"), "pos", F.col("dep").alias("got_dep"))
    deps = want.join(got, ["new", "pos"], "full").filter("not (new_dep <=> got_dep)").select(F.coalesce("node", "new").alias("node"), F.lit("dependency").alias("problem")).distinct()
    return shared.unionByName(extra).unionByName(lost).unionByName(other).unionByName(deps)


def in_order(dependencies: dict[str, set[str]]) -> list[str]:
    """Names after all that they depend on, alphabetically where free; a cycle is an error."""
    left = {k: set(v) & dependencies.keys() for k, v in dependencies.items()}
    out: list[str] = []
    while left:
        ready = sorted(k for k, v in left.items() if not v)
        if not ready:
            raise ValueError(f"cycle among {sorted(left)}")
        out.append(ready[0])
        del left[ready[0]]
        for v in left.values():
            v.discard(ready[0])
    return out


def run_models(spark: SparkSession, models: dict[str, str], wanted: str) -> DataFrame:
    """A project of SQL models that name each other as {{ ref('x') }}: views in dependency order; returns `wanted`."""
    import re

    ref = re.compile(r"\{\{\s*ref\('(\w+)'\)\s*\}\}")
    for name in in_order({k: set(ref.findall(sql)) for k, sql in models.items()}):
        sql = ref.sub(r"\1", models[name])
        if "{{" in sql or "{%" in sql:
            raise ValueError(f"model {name} holds a template that is not a reference")
        spark.sql(sql).createOrReplaceTempView(name)
    return spark.table(wanted)


def frozen(frame: DataFrame) -> DataFrame:
    """(rows, digest): the same for the same rows in any order; the digest sums 48 bits of each row's MD5, as any engine can."""
    text = F.concat_ws("|", *(frame[f"`{c}`"].cast("string") for c in frame.columns))
    bits = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")
    return frame.agg(F.count("*").alias("rows"), F.sum(bits).alias("digest"))
