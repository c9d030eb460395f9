"""Extractors every store knows by default."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens import schema as S
from feedlens.operators import graph
from feedlens.operators.projections import target_columns
from feedlens.plans.registry import Registry

DEFAULT = Registry()


@DEFAULT.feature()
def binarize_timestamps(raw_data, features, auxiliaries):
    """The four engagement targets."""
    return target_columns()


@DEFAULT.feature()
def binarize_flags(raw_data, features, auxiliaries):
    """The four targets of a sample whose labels are 0/1 already."""
    return target_columns(binarised=True)


@DEFAULT.auxiliary()
def engagement_graph(raw_data: DataFrame, auxiliary_train: dict[str, DataFrame] | None = None):
    """Vertices, edges and degrees; at inference merged with those of training.

    Degrees are sums over edges, so the stored ones are added to those of the
    new data and the training edges are not aggregated again. The degrees of
    training alone stay at hand as ``known_degrees``. Data without labels has no
    edges.
    """
    unknown = [c for c in S.LABELS if c not in raw_data.columns]
    built = graph.build_graph(raw_data.withColumns({c: F.lit(None).cast("long") for c in unknown}))
    degrees = graph.degrees(built.edges)
    if auxiliary_train is None:
        return {"vertices": built.vertices, "edges": built.edges, "degrees": degrees}
    return {
        "vertices": auxiliary_train["vertices"].unionByName(built.vertices).distinct(),
        "edges": auxiliary_train["edges"].unionByName(built.edges),
        "degrees": graph.add_degrees(auxiliary_train["degrees"], degrees),
        "known_degrees": auxiliary_train["degrees"],
        "known_edges": auxiliary_train["edges"],
    }


@DEFAULT.feature(version="2")
def engagement_degrees(raw_data, features, auxiliaries):
    """In-degree of the author and out-degree of the viewer, as two more columns.

    No row sees its own labels: new rows get the degrees of training, rows whose
    edges are in the graph get the degrees without those edges. Compared with each
    other such degrees still tell a label: among the rows of a user the engaged
    ones have the smaller degree. Models learn from ``engagement_degrees_as_of``.
    """
    if "known_degrees" in auxiliaries:
        return graph.degree_features(raw_data, auxiliaries["known_degrees"], keep=raw_data.columns)
    return graph.degree_features(raw_data, auxiliaries["degrees"], keep=raw_data.columns, own=graph.own_edges(raw_data))


@DEFAULT.feature()
def engagement_degrees_as_of(raw_data, features, auxiliaries):
    """In-degree of the author and out-degree of the viewer as of the tweet's
    time, as two more columns: engagements of training that are strictly older."""
    edges = auxiliaries.get("known_edges", auxiliaries["edges"])
    return graph.degrees_as_of(raw_data, edges, keep=raw_data.columns)
