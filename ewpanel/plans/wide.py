"""The wide candidate table: all feature families of a cell and issue date."""

from __future__ import annotations

from pyspark.sql import functions as F

from ewpanel.functions.staging import shared_folder
from ewpanel.plans import candidates
from ewpanel.plans.registry import SQL, query
from ewpanel.sources.families import FamilyStore, replace_partitions

KEYS = ["priogrid_gid", "issue_date"]
BASE = "candidate_age_windows"
FAMILIES = ["candidate_forward_labels", "candidate_actor_diversity", "candidate_rings", "hawkes_intensity", "hawkes_ring1", "cusum", "grid_diffusion"]
_RING1 = {f"hawkes_{k}": f"hawkes_ring1_{k}" for k in (3, 14, 30)}


def _family_sql(name):
    if name == "grid_diffusion":
        return f"(SELECT * RENAME (issue AS issue_date) FROM ({SQL[name]}))"
    if name == "hawkes_ring1":
        return f"(SELECT * RENAME ({', '.join(f'{a} AS {b}' for a, b in _RING1.items())}) FROM ({SQL[name]}))"
    return f"({SQL[name]})"


def _family(spark, d, name):
    df = getattr(candidates, name)(spark, d)
    if name == "grid_diffusion":
        df = df.withColumnRenamed("issue", "issue_date")
    return df.withColumnsRenamed(_RING1) if name == "hawkes_ring1" else df


WIDE_SQL = f"(SELECT *, CAST(year(issue_date) AS bigint) issue_year FROM {_family_sql(BASE)}" + "".join(f" LEFT JOIN {_family_sql(f)} USING (priogrid_gid, issue_date)" for f in FAMILIES) + ")"


def wide_table(spark, d):
    """Write the wide table, a folder for each year of issue; its path and schema. The families' own tables go."""
    path = shared_folder(spark, "wide")
    with FamilyStore(spark, KEYS, "issue_year") as store:
        for name in [BASE, *FAMILIES]:
            store.put(name, _family(spark, d, name).withColumn("issue_year", F.year("issue_date").cast("long")))
        merged = store.merged(BASE)
        replace_partitions(merged, path, ["issue_year"])
        return path, merged.schema


@query("wide_candidates", f"SELECT * FROM {WIDE_SQL}")
def wide_candidates(spark, d):
    """Every candidate with the features of all eight families, written by year and read back."""
    path, schema = wide_table(spark, d)
    return spark.read.schema(schema).parquet(path)  # a table without rows has no files to take a schema from


_BLOCKS = {"labels": "label_10", "actors": "actor_diversity", "rings": "ring1_30d", "hawkes": "hawkes_14", "hawkes_ring1": "hawkes_ring1_14", "cusum": "cusum_up", "diffusion": "hop_1"}


@query("wide_coverage", f"""SELECT issue_year, count(*) n_rows, count(DISTINCT priogrid_gid) n_cells, {", ".join(f"count({c}) n_{n}" for n, c in _BLOCKS.items())},
 CAST(sum(label_10) AS bigint) n_pos, CAST(sum(label_10) FILTER (hop_1 IS NULL) AS bigint) n_pos_without_diffusion FROM {WIDE_SQL} GROUP BY 1""")
def wide_coverage(spark, d):
    """Rows of each year that a family covers, and the positives among all and among those that diffusion doesn't reach."""
    w = wide_candidates(spark, d)
    return w.groupBy("issue_year").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("priogrid_gid").alias("n_cells"), *[F.count(c).alias(f"n_{n}") for n, c in _BLOCKS.items()],
        F.sum("label_10").cast("long").alias("n_pos"), F.sum(F.when(F.col("hop_1").isNull(), F.col("label_10"))).cast("long").alias("n_pos_without_diffusion"))
