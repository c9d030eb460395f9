"""Engagement graph: vertices, typed edges, degrees and their summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens import schema as S
from feedlens.operators import projections as P
from feedlens.operators.filters import positives
from feedlens.operators.running import older_events
from feedlens.operators.skew import salted_lookup
from feedlens.sources.durable import durable


@dataclass(frozen=True)
class Graph:
    """Directed multigraph: ``vertices(id, …)`` and ``edges(src, dst, …)``."""

    vertices: DataFrame
    edges: DataFrame

    def persist(self) -> "Graph":
        return Graph(self.vertices.persist(), self.edges.persist())

    def unpersist(self) -> None:
        self.vertices.unpersist()
        self.edges.unpersist()


def vertices(df: DataFrame) -> DataFrame:
    """Distinct users of the positive samples.

    Distinct over all attributes: a user seen with two follower counts is two
    rows; see :func:`latest_vertices` for one row per user.
    """
    return P.both_users(positives(df)).distinct()


def latest_vertices(df: DataFrame) -> DataFrame:
    """One row per user: the attributes at the user's newest tweet."""
    attributes = [c for c in P.VERTEX_ATTRIBUTES if c != "id"]
    seen = positives(df).select(
        "tweet_timestamp",
        F.inline(F.array(F.struct(*P._user("engaged_with")), F.struct(*P._user("engaging")))),
    )
    # The attributes themselves break ties between equal timestamps.
    newest = F.max(F.struct("tweet_timestamp", *attributes)).alias("_v")
    return seen.groupBy("id").agg(newest).select("id", *[F.col(f"_v.{c}").alias(c) for c in attributes])


def edges(df: DataFrame) -> DataFrame:
    """One edge per engagement, viewer to author, typed 1 to 4; one scan."""
    names = {label: str(number) for label, number in S.EDGE_TYPES.items()}
    ids = ["src", "dst", "dst_follows_src", *[c for c in P.EDGE_TWEET_COLUMNS if c in df.columns]]
    rows = P.labels_to_rows(
        P.edge_projection(positives(df)), ids, names, "interaction_type", "interaction_timestamp"
    )
    return rows.select(*ids, "interaction_timestamp", F.col("interaction_type").cast("int").alias("interaction_type"))


def build_graph(df: DataFrame) -> Graph:
    return Graph(vertices(df), edges(df))


def sizes(graph: Graph) -> DataFrame:
    """Number of vertices and of edges."""
    n = F.count(F.lit(1))
    return graph.vertices.agg(n.alias("n_vertices")).select(
        "n_vertices", graph.edges.agg(n.alias("n_edges")).scalar().alias("n_edges")
    )


def in_degrees(edges: DataFrame) -> DataFrame:
    """Edges per target vertex, parallel edges counted."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))


def out_degrees(edges: DataFrame) -> DataFrame:
    """Edges per source vertex, parallel edges counted."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))


def degrees(edges: DataFrame) -> DataFrame:
    """Both degrees of every endpoint, from one scan and one shuffle."""
    end = F.inline(
        F.array(
            F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
            F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
        )
    )
    return edges.select(end).groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def degree_summary(edges: DataFrame) -> DataFrame:
    """Maximum, minimum, mean and sample deviation per direction.

    Only vertices with at least one edge of the direction count, so the minimum
    is never 0.
    """
    long = degrees(edges).unpivot(["id"], ["in_degree", "out_degree"], "direction", "degree").where("degree > 0")
    return long.groupBy("direction").agg(
        F.max("degree").alias("max"),
        F.min("degree").alias("min"),
        F.avg("degree").alias("avg"),
        F.stddev_samp("degree").alias("stddev"),
    )


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct ids that occur in an edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def drop_isolated(graph: Graph) -> Graph:
    """Keep the vertices that are an endpoint of some edge."""
    return Graph(graph.vertices.join(endpoints(graph.edges), "id", "left_semi"), graph.edges)


def own_edges(df: DataFrame) -> Column:
    """Edges that a row itself stands for; none without label columns."""
    return sum((F.col(c).isNotNull().cast("long") for c in S.LABELS if c in df.columns), F.lit(0).cast("long"))


def degree_features(
    df: DataFrame,
    degree_table: DataFrame,
    rows: int | None = None,
    keep: list[str] = S.KEYS,
    own: Column | None = None,
    **skew,
) -> DataFrame:
    """``keep`` columns plus in-degree of the author and out-degree of the viewer.

    Users without an edge get 0. Where ``own`` is given, that many edges of the
    row itself are left out of both. Celebrities make both lookups skewed, so
    hot users are split over several tasks.
    """
    if rows is None:
        rows = df.count()
    authors = degree_table.select(F.col("id").alias("engaged_with_user_id"), F.col("in_degree").alias("_in"))
    viewers = degree_table.select(F.col("id").alias("engaging_user_id"), F.col("out_degree").alias("_out"))
    own = F.lit(0).cast("long") if own is None else own
    joined = df.select(*dict.fromkeys([*keep, *S.KEYS, "engaged_with_user_id"]), own.alias("_own"))
    joined = salted_lookup(joined, authors, "engaged_with_user_id", S.KEYS, "left", rows, **skew)
    joined = salted_lookup(joined, viewers, "engaging_user_id", ["tweet_id"], "left", rows, **skew)
    return joined.select(
        *keep,
        (F.coalesce("_in", F.lit(0)) - F.col("_own")).alias("engaged_with_user_in_degree"),
        (F.coalesce("_out", F.lit(0)) - F.col("_own")).alias("engaging_user_out_degree"),
    )


def degrees_as_of(df: DataFrame, edges: DataFrame, rows: int | None = None, keep: list[str] = S.KEYS, **skew) -> DataFrame:
    """``keep`` columns plus in-degree of the author and out-degree of the viewer
    from the edges that are strictly older than the row's tweet.

    An edge is as old as its engagement, or as its tweet where the engagement is
    dated before it; so no row sees its own edges, nor later ones. Users without
    an older edge, and rows without a user or a time, get 0.
    """
    if rows is None:
        rows = df.count()
    at = F.greatest("interaction_timestamp", "tweet_timestamp").alias("at")
    events = [F.struct(F.lit(role).alias("role"), F.col(end).alias("id"), at) for role, end in enumerate(("dst", "src"))]
    users = ["engaged_with_user_id", "engaging_user_id"]
    asked = [F.struct(F.lit(role).alias("role"), F.col(user).alias("id"), F.col("tweet_timestamp").alias("at")) for role, user in enumerate(users)]
    older = older_events(edges.select(F.inline(F.array(*events))), df.select(F.inline(F.array(*asked))), ["role", "id"], "at")
    older = durable(older, "older")
    joined = df.select(*dict.fromkeys([*keep, *S.KEYS, *users, "tweet_timestamp"]))
    for role, user in enumerate(users):
        known = older.where(F.col("role") == role).select(F.col("id").alias(user), F.col("at").alias("tweet_timestamp"), F.col("older").alias(f"_{role}"))
        joined = salted_lookup(joined, known, [user, "tweet_timestamp"], S.KEYS, "left", rows, **skew)
    names = ["engaged_with_user_in_degree", "engaging_user_out_degree"]
    return joined.select(*keep, *[F.coalesce(f"_{role}", F.lit(0).cast("long")).alias(name) for role, name in enumerate(names)])


def add_degrees(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sum of two degree tables, for edges that arrive in several batches."""
    both = left.unionByName(right).groupBy("id")
    return both.agg(F.sum("in_degree").alias("in_degree"), F.sum("out_degree").alias("out_degree"))
