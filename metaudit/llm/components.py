"""Connected components of a table of links, as Spark jobs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaudit.llm.shared import saved


def components(links: DataFrame) -> DataFrame:
    """Per node of ``links`` (a, b): node and component, the smallest node it is linked with.

    Each round hooks every node to its smallest neighbour, follows the hooks one step, and
    contracts the links; the tables of a round are written to the shared folder, so lineage
    stays short. Rounds are about the logarithm of the longest chain.
    """
    edges = saved(links.select("a", "b").where("a <> b").distinct())
    members = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("of"), F.least("a", "low").alias("to"))
        hooks = saved(hooks)
        second = hooks.select(F.col("of").alias("to"), F.col("to").alias("next"))
        hooks = saved(hooks.join(second, "to").select("of", F.col("next").alias("to")))

        def moved(df, column):
            return (df.join(hooks.withColumnRenamed("of", column), column, "left")
                    .withColumn(column, F.coalesce("to", column)).drop("to"))

        members = saved(moved(members, "component"))
        edges = saved(moved(moved(edges, "a"), "b").where("a <> b")
                      .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return members
