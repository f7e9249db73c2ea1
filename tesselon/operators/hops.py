"""Multi-hop retrieval: what the hits of one hop have in common with other documents is what the next hop asks for.

All queries move together, a hop a few joins.  Hop 1 is the best of a search.  For each document of the frontier the
rarest of its terms that another document holds too and that the query hasn't asked for in any hop are its bridges; a search for them
gives the documents of the next hop.  A path's score is that of the document it comes from plus the new score, halved once
more each hop; a document is reached by its best path only, and never again once a query has visited it.  Each hop is
written before the next begins, so a lost executor costs one hop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import shared_folder
from . import index
from .retrieval import top_k


def _held(df: DataFrame, name: str) -> DataFrame:
    df.write.parquet(name)
    return df.sparkSession.read.schema(df.schema).parquet(name)


def bridges(frontier: DataFrame, docs: DataFrame, used: DataFrame, path: str, n: int) -> DataFrame:
    """query_id, doc_id, term: the n rarest shared terms of each document of the frontier, without those used (query_id, term)."""
    few = frontier.select("doc_id").distinct()
    few = F.broadcast(few) if frontier.count() <= index.ASKED else few
    texts = docs.select("doc_id", "text").join(few, "doc_id")
    terms = texts.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    shared = index.statistics(docs.sparkSession, path, terms.select("term").distinct()).where("df >= 2").select("term", "df")
    mine = frontier.select("query_id", "doc_id").join(terms.join(shared, "term"), "doc_id")
    mine = mine.join(used, ["query_id", "term"], "left_anti")
    ranked = top_k(mine.withColumn("from", F.struct("query_id", "doc_id")), "from", n, F.col("df"), F.col("term"))
    return ranked.select("query_id", "doc_id", "term")


def multi_hop(docs: DataFrame, path: str, asked: DataFrame, hops: int = 3, width: int = 3, bridging: int = 2) -> DataFrame:
    """query_id, hop, doc_id, via, path, score for asked(query_id, term); via is the document a hit was reached from."""
    spark, folder = docs.sparkSession, f"{shared_folder(docs.sparkSession)}-hops"
    first = index.search(spark, path, asked).where("score > 0").select("query_id", "doc_id", "score")
    first = top_k(first, "query_id", width, F.desc("score"), F.col("doc_id")).select("query_id", F.lit(1).alias("hop"), "doc_id", F.lit(None).cast("long").alias("via"), F.col("doc_id").cast("string").alias("path"), "score")
    frontier = visited = _held(first, f"{folder}/hop=1")
    used = asked.select("query_id", "term").distinct()
    for hop in range(2, hops + 1):
        known = _held(bridges(frontier, docs, used, path, bridging).select(F.struct("query_id", "doc_id").alias("query_id"), "term"), f"{folder}/terms={hop}")
        used = used.union(known.select("query_id.query_id", "term"))
        found = index.search(spark, path, known).where("score > 0")
        found = found.select("query_id.query_id", F.col("query_id.doc_id").alias("via"), "doc_id", F.col("score").alias("gain"))
        found = found.join(visited.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        since = frontier.select("query_id", F.col("doc_id").alias("via"), "path", F.col("score").alias("before"))
        scored = found.join(since, ["query_id", "via"]).withColumn("score", F.round(F.col("before") + F.lit(0.5 ** (hop - 1)) * F.col("gain"), 6))
        one = scored.groupBy("query_id", "doc_id").agg(F.max_by(F.struct("score", "via", "path"), F.struct("score", -F.col("via"))).alias("best")).select("query_id", "doc_id", "best.*")
        reached = top_k(one, "query_id", width, F.desc("score"), F.col("doc_id"))
        reached = reached.select("query_id", F.lit(hop).alias("hop"), "doc_id", "via", F.concat_ws(">", "path", F.col("doc_id").cast("string")).alias("path"), "score")
        frontier = _held(reached, f"{folder}/hop={hop}")
        visited = visited.unionByName(frontier)
    return visited
