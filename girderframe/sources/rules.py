"""Rule tables: keyword classes, extraction patterns, precedence, levels and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values: (class, keywords), in rule order; a keyword matches as a substring, without case.
CLASSIFICATION_RULES = [
    ("Column", ["Column", "기둥", "COL", "柱", "Columns", "Structural Column"]),
    ("Beam", ["Beam", "보", "BM", "梁", "Beams", "Structural Framing", "Girder", "큰보", "작은보"]),
    ("Slab", ["Slab", "슬래브", "슬라브", "Floor", "SL", "Floors", "바닥", "Deck"]),
    ("Wall", ["Wall", "벽", "벽체", "WL", "Walls", "내벽", "외벽", "Curtain Wall", "커튼월"]),
    ("Foundation", ["Foundation", "기초", "Footing", "FD", "Foundations", "Mat Foundation", "매트기초", "Pile", "말뚝"]),
    ("Stair", ["Stair", "계단", "Stairs", "ST"]),
    ("Door", ["Door", "문", "Doors", "DR"]),
    ("Window", ["Window", "창", "창문", "Windows", "WN"]),
    ("Duct", ["Duct", "덕트", "Ducts", "Air Duct", "공조덕트"]),
    ("Pipe", ["Pipe", "배관", "Pipes", "Piping", "급수관", "배수관"]),
    ("Equipment", ["Equipment", "장비", "Mechanical Equipment", "기계장비", "AHU", "공조기"]),
]

# Fixed values: (class, priority, keywords) for system paths; the highest priority wins.
PATH_RULES = [
    ("StructuralElement", 1, ["Structural", "Structure", "Civil_Structure"]),
    ("Column", 10, ["Column", "Columns", "Vertical Member"]),
    ("Beam", 10, ["Beam", "Beams", "Girder", "Horizontal Braces", "Stringers"]),
    ("Brace", 10, ["Vertical Braces", "Braces", "Brace", "Bracing"]),
    ("Foundation", 10, ["Foundation", "Footing", "Pile", "Mat", "Drainage Ditches"]),
    ("Slab", 10, ["Slab", "Floor", "Deck"]),
    ("Wall", 10, ["Wall", "Walls", "RightWall", "LeftWall"]),
    ("Pipe", 10, ["Piping", "Pipe", "PipeSys", "Pipeline"]),
    ("Duct", 10, ["Duct", "HVAC", "Air", "Ventilation"]),
    ("Equipment", 10, ["Equipment", "Pump", "Tank", "Vessel", "Exchanger", "Compressor", "Kettle", "Recovery"]),
    ("ElectricalElement", 10, ["Electrical", "Cable", "Tray", "Conduit"]),
    ("Pipe", 5, ["Water", "-W-", "-W>"]),
]

# Patterns of area, unit, zone and level names.
AREA_PATTERNS = {
    "area_name": r"\b(A[0-9]+)\b",
    "unit_name": r"\b(U[0-9]+)\b",
    "zone_name": r"(Zone-[A-Za-z0-9]+)",
    "level_name": r"\b(Level\s*[0-9]+|L[0-9]+|[0-9]+F|B[0-9]+)\b",
}

# Fixed values: (predecessor, successor, condition, priority).
PRECEDENCE_RULES = [
    ("Foundation", "Column", "same_level", 1),
    ("Column", "Beam", "same_level", 2),
    ("Beam", "Slab", "same_level", 3),
    ("StructuralElement", "Wall", "same_level", 4),
    ("Wall", "Door", "same_level", 5),
    ("Wall", "Window", "same_level", 5),
    ("*", "*", "lower_level_first", 0),
    ("StructuralElement", "MEPElement", "same_level", 10),
    ("StructuralElement", "MEPElement", "same_area", 10),
    ("Foundation", "Column", "same_unit", 1),
    ("Column", "Beam", "same_unit", 2),
    ("Foundation", "Brace", "same_unit", 1),
    ("Brace", "Beam", "same_unit", 2),
    ("StructuralElement", "Pipe", "same_unit", 10),
    ("StructuralElement", "Equipment", "same_unit", 10),
]

# Fixed values: (class, superclass).
CLASS_TREE = [
    ("StructuralElement", "ModelObject"),
    ("Foundation", "StructuralElement"),
    ("Column", "StructuralElement"),
    ("Beam", "StructuralElement"),
    ("Slab", "StructuralElement"),
    ("Wall", "StructuralElement"),
    ("Stair", "StructuralElement"),
    ("ArchitecturalElement", "ModelObject"),
    ("Door", "ArchitecturalElement"),
    ("Window", "ArchitecturalElement"),
    ("Curtainwall", "ArchitecturalElement"),
    ("MEPElement", "ModelObject"),
    ("Duct", "MEPElement"),
    ("Pipe", "MEPElement"),
    ("Equipment", "MEPElement"),
    ("Level", "SpatialZone"),
    ("Area", "SpatialZone"),
]

# Named levels; numbered ones follow the rules in level_orders().
_NAMED_LEVELS = {
    "GL": 0, "Ground": 0, "지상": 0,
    "RF": 100, "Roof": 100, "옥상": 100, "옥상층": 100,
    "PH": 101, "Penthouse": 101, "펜트하우스": 101,
}

# Weights of the scored schedule match and its acceptance limit.
MATCH_WEIGHTS = {"level": 0.30, "category": 0.25, "name": 0.25, "path": 0.20}
MIN_MATCH_SCORE = 0.7
MAX_INFERENCE_DEPTH = 5


def level_orders() -> dict[str, int]:
    """Order of level names: basements B1-B5, floors 1F-20F and their Korean forms."""
    basements = {name: -n for n in range(1, 6) for name in (f"B{n}", f"지하{n}층")}
    floors = {f"{n}F": n for n in range(1, 21)}
    korean = {f"{n}층": n for n in range(1, 11)}
    return {**basements, **floors, **korean, **_NAMED_LEVELS}


def superclasses() -> dict[str, list[str]]:
    """Every class with itself and all its superclasses."""
    parent = dict(CLASS_TREE)
    names = set(parent) | set(parent.values()) | {c for c, *_ in PATH_RULES} | {c for c, _ in CLASSIFICATION_RULES}
    closed = {}
    for name in sorted(names):
        chain = [name]
        while chain[-1] in parent:
            chain.append(parent[chain[-1]])
        closed[name] = chain
    return closed


def expanded_precedence(rules=None) -> list[tuple[str, str, str, int]]:
    """Rules between concrete classes: superclasses replaced by their members.

    Wildcard rules stay as they are. Pairs of one class with itself are dropped; the
    strongest (lowest) priority of a repeated pair is kept.
    """
    members: dict[str, list[str]] = {}
    for name, chain in superclasses().items():
        for above in chain:
            members.setdefault(above, []).append(name)
    best: dict[tuple[str, str, str], int] = {}
    for before, after, condition, priority in PRECEDENCE_RULES if rules is None else rules:
        pairs = [("*", "*")] if before == "*" else [
            (a, b) for a in members.get(before, [before]) for b in members.get(after, [after]) if a != b
        ]
        for a, b in pairs:
            key = (a, b, condition)
            best[key] = min(priority, best.get(key, priority))
    return [(a, b, c, p) for (a, b, c), p in sorted(best.items())]


def precedence_table(spark: SparkSession, rules=None) -> DataFrame:
    return spark.createDataFrame(
        expanded_precedence(rules), "pred_class string, succ_class string, condition string, priority int"
    )


def class_table(spark: SparkSession) -> DataFrame:
    rows = [(name, above) for name, chain in superclasses().items() for above in chain]
    return spark.createDataFrame(rows, "class string, superclass string")


# Names in rule documents and here.
WEIGHT_NAMES = {"level_match": "level", "category_match": "category", "name_similarity": "name", "sys_path_match": "path"}
PATTERN_NAMES = {"areaName": "area_name", "unitName": "unit_name", "zoneName": "zone_name", "levelName": "level_name"}


def load_rules(document: dict) -> dict:
    """Rule tables from a parsed rule document, in the form that their consumers take.

    Disabled rules are dropped. Weights, score limit and depth that the document leaves out keep
    their built-in values.
    """
    settings = document.get("advanced_settings", {})
    weights = {WEIGHT_NAMES.get(k, k): float(v) for k, v in document.get("matching_weights", {}).items()}

    def enabled(section: str) -> list[dict]:
        return [r for r in document.get(section, []) if r.get("enabled", True)]

    def bare(name: str) -> str:
        return name.split(":")[-1]

    return {
        "classification": [(bare(r["target_class"]), list(r["keywords"])) for r in enabled("classification_rules")],
        "path": [
            (bare(r["target_class"]), int(r.get("priority", 0)), list(r["keywords"]))
            for r in enabled("systempath_classification")
        ],
        "area": {PATTERN_NAMES.get(bare(r["property"]), bare(r["property"])): r["pattern"] for r in enabled("area_extraction_patterns")},
        "precedence": [
            (bare(r["predecessor_class"]), bare(r["successor_class"]), r["condition"], int(r.get("priority", 0)))
            for r in enabled("precedence_rules")
        ],
        "level_order": dict(document.get("level_order", {})),
        "weights": {**MATCH_WEIGHTS, **weights},
        "min_score": float(settings.get("min_match_score", MIN_MATCH_SCORE)),
        "max_depth": int(settings.get("max_inference_depth", MAX_INFERENCE_DEPTH)),
    }
