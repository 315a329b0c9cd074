"""RDF ids, escapes, literals and WKT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from girderframe.functions.boxes import Box, Point

# Namespaces of the emitted triples.
GEOMETRY_PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "bso": "http://example.org/bso#",
    "geo": "http://www.opengis.net/ont/geosparql#",
}
SPATIAL_PREFIXES = {
    "spatial": "http://example.org/bim-ontology/spatial#",
    "inst": "http://example.org/bim-ontology/instance#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
}


def safe_id(object_id: Column) -> Column:
    # Most ids hold no hyphen, and looking for one is much cheaper than translating.
    return F.when(F.contains(object_id, F.lit("-")), F.translate(object_id, "-", "_")).otherwise(object_id)


def bare_id(object_id: Column) -> Column:
    """Id without hyphens, as used in object and box URIs."""
    return F.translate(object_id, "-", "")


def escape_literal(text: Column) -> Column:
    out = text
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


escape_json = escape_literal


def number_text(c: Column) -> Column:
    """Shortest text of a double; whole numbers carry no decimals."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def typed(c: Column, kind: str) -> Column:
    return F.concat(F.lit('"'), c, F.lit(f'"^^xsd:{kind}'))


def double_literal(c: Column) -> Column:
    return typed(number_text(c), "double")


def fixed_literal(c: Column, digits: int) -> Column:
    return typed(fixed_text(c, digits), "double")


def fixed_text(c: Column, digits: int) -> Column:
    """``%.nf`` of a double; values from 0 to a million that are no near tie are put together from whole numbers."""
    unit = 10**digits
    scaled = c * float(unit)
    nearest = F.floor(scaled + 0.5)
    # The product is off by far less than a thousandth, so other values round to the same side.
    plain = (c >= 0) & (c < 1e6) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    cents = F.lpad((nearest % unit).cast("string"), digits, "0")
    text = F.concat(F.floor(nearest / float(unit)).cast("string"), F.lit("."), cents)
    return F.when(plain, text).otherwise(F.format_string(f"%.{digits}f", c))


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), escape_literal(text), F.lit('"'))


def wkt_footprint(box: Box) -> Column:
    """Rectangle of the box in the XY plane."""
    x0, y0 = number_text(box.lo.x), number_text(box.lo.y)
    x1, y1 = number_text(box.hi.x), number_text(box.hi.y)
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    ring = F.concat_ws(", ", *[F.concat_ws(" ", x, y) for x, y in corners])
    return F.concat(F.lit("POLYGON(("), ring, F.lit("))"))


def wkt_point(p: Point) -> Column:
    return F.concat(F.lit("POINT("), F.concat_ws(" ", *[number_text(a) for a in p.axes()]), F.lit(")"))
