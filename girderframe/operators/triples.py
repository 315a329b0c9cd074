"""RDF triples of boxes, adjacency and groups as (subject, predicate, object) frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girderframe.functions import rdf
from girderframe.functions.boxes import Box
from girderframe.functions.formats import group_code
from girderframe.functions.text import is_empty
from girderframe.schema import EMPTY_GUID

TRIPLE = "struct<s:string,p:string,o:string>"


def _triples(df: DataFrame, entries: list[tuple[Column, str, Column, Column | None]]) -> DataFrame:
    """Explode (subject, predicate, object, condition) entries of each row."""
    made = [
        F.when(
            F.lit(True) if condition is None else F.coalesce(condition, F.lit(False)),
            F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o")),
        )
        for s, p, o, condition in entries
    ]
    kept = F.filter(F.array(*made), lambda t: t.isNotNull())
    return df.select(F.explode(kept).alias("t")).select("t.s", "t.p", "t.o")


def geometry_triples(geometry: DataFrame) -> DataFrame:
    """Box, centroid, volume, mesh, label and category triples of each object."""
    box = Box.of()
    rows = geometry.filter(~F.col("object_id").isin("", EMPTY_GUID))
    subject = F.concat(F.lit("bso:Object_"), rdf.bare_id(F.col("object_id")))
    shape = F.concat(F.lit("bso:BBox_"), rdf.bare_id(F.col("object_id")))
    centre, present = box.centroid(), box.present()
    wkt = "^^geo:wktLiteral"

    def wkt_literal(c: Column) -> Column:
        return F.concat(F.lit('"'), c, F.lit(f'"{wkt}'))

    def text(name: str) -> Column:
        return F.col(name) if name in geometry.columns else F.lit(None).cast("string")

    mesh = F.coalesce("has_mesh", F.lit(False)) if "has_mesh" in geometry.columns else F.lit(False)
    entries = [
        (subject, "bso:hasBoundingBox", shape, present),
        (shape, "a", F.lit("bso:BoundingBox"), present),
        *[
            (shape, f"bso:{end}{axis.upper()}", rdf.double_literal(F.col(f"{end}_{axis}")), present)
            for end in ("min", "max")
            for axis in "xyz"
        ],
        (shape, "geo:asWKT", wkt_literal(rdf.wkt_footprint(box)), present),
        *[(subject, f"bso:centroid{x.upper()}", rdf.double_literal(F.coalesce(c, F.lit(0.0))), None) for x, c in zip("xyz", centre.axes())],
        (subject, "bso:centroidWKT", wkt_literal(rdf.wkt_point(centre)), present),
        (subject, "bso:volume", rdf.double_literal(box.volume()), box.volume() > 0),
        (subject, "bso:hasMesh", rdf.typed(mesh.cast("string"), "boolean"), None),
        (subject, "bso:meshUri", rdf.quoted(text("mesh_uri")), ~is_empty(text("mesh_uri"))),
        (subject, "rdfs:label", rdf.quoted(text("display_name")), ~is_empty(text("display_name"))),
        (subject, "bso:category", rdf.quoted(text("category")), ~is_empty(text("category"))),
    ]
    return _triples(rows, entries)


def object_uri(object_id: Column, prefix: str = "inst:obj_") -> Column:
    """The name of an object in spatial triples."""
    return F.concat(F.lit(prefix), rdf.safe_id(object_id))


def edge_triples(edges: DataFrame, prefix: str = "inst:obj_") -> DataFrame:
    """Adjacency, distance and overlap triples of each edge.

    Edges that bring ``source_uri`` and ``target_uri`` along keep these names, so they are made once for each box.
    """
    if "source_uri" in edges.columns:
        source, target = F.col("source_uri"), F.col("target_uri")
    else:
        source, target = object_uri(F.col("source_id"), prefix), object_uri(F.col("target_id"), prefix)

    def nested(name: str, c: Column) -> Column:
        return F.concat(F.lit("[ spatial:target "), target, F.lit(f" ; spatial:{name} "), rdf.fixed_literal(c, 6), F.lit(" ]"))

    # The texts are made after the kinds are dealt out, each only for the kind that needs it.
    kinds = edges.withColumn("_kind", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).filter((F.col("_kind") < 2) | (F.col("overlap_volume") > 0))
    kind = F.col("_kind")
    objects = [target, nested("distance", F.col("distance")), nested("overlapVolume", F.col("overlap_volume"))]
    predicates = [F.lit(f"spatial:{p}") for p in ("adjacentTo", "distanceTo", "overlapsWith")]

    def of_kind(values: list[Column]) -> Column:
        return F.when(kind == 0, values[0]).when(kind == 1, values[1]).otherwise(values[2])

    return kinds.select(source.alias("s"), of_kind(predicates).alias("p"), of_kind(objects).alias("o"))


def _group_uri() -> Column:
    return F.concat(F.lit("spatial:Group_"), F.substring(group_code(F.col("group_id")), 2, 20))


def group_triples(stats: DataFrame, groups: DataFrame, prefix: str = "inst:obj_") -> DataFrame:
    """Size and volume triples of each group and one membership triple per member."""
    uri = _group_uri()
    own = _triples(
        stats,
        [
            (uri, "a", F.lit("spatial:ConnectedGroup"), None),
            (uri, "spatial:groupSize", F.col("element_count").cast("string"), None),
            (uri, "spatial:groupVolume", rdf.fixed_literal(F.col("total_volume"), 4), None),
        ],
    )
    members = groups.select(
        object_uri(F.col("object_id"), prefix).alias("s"), F.lit("spatial:inGroup").alias("p"), uri.alias("o")
    )
    return own.unionByName(members)


def sparql_insert(geometry: DataFrame) -> DataFrame:
    """``INSERT DATA`` text per object."""
    box = Box.of()
    base = rdf.GEOMETRY_PREFIXES["bso"]
    bare = rdf.bare_id(F.col("object_id"))
    subject = F.concat(F.lit(f"<{base}Object_"), bare, F.lit(">"))
    shape = F.concat(F.lit(f"<{base}BBox_"), bare, F.lit(">"))

    def statement(s: Column, predicate: str, value: Column) -> Column:
        return F.concat(F.lit("  "), s, F.lit(f" {predicate} "), value, F.lit(" ."))

    has_mesh = F.coalesce("has_mesh", F.lit(False)) if "has_mesh" in geometry.columns else F.lit(False)
    uri = F.col("mesh_uri") if "mesh_uri" in geometry.columns else F.lit(None).cast("string")
    bounds = [
        F.when(box.present(), statement(shape, f"bso:{end}{axis.upper()}", rdf.double_literal(F.col(f"{end}_{axis}"))))
        for end in ("min", "max")
        for axis in "xyz"
    ]
    centre = [
        statement(subject, f"bso:centroid{x.upper()}", rdf.double_literal(F.coalesce(c, F.lit(0.0))))
        for x, c in zip("xyz", box.centroid().axes())
    ]
    lines = [
        F.lit("INSERT DATA {"),
        F.when(box.present(), statement(subject, "bso:hasBoundingBox", shape)),
        F.when(box.present(), statement(shape, "a", F.lit("bso:BoundingBox"))),
        *bounds,
        *centre,
        statement(subject, "bso:hasMesh", rdf.typed(has_mesh.cast("string"), "boolean")),
        F.when(~is_empty(uri), statement(subject, "bso:meshUri", rdf.quoted(uri))),
        F.lit("}"),
    ]
    usable = geometry.filter(~F.col("object_id").isin("", EMPTY_GUID))
    return usable.select("object_id", F.concat_ws("\n", *lines).alias("sparql"))
