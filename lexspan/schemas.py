"""Table schemas of a corpus. Dates are DateType; row order is an explicit `pos`."""

from pyspark.sql import types as T

_s, _i, _d, _b = T.StringType(), T.IntegerType(), T.DateType(), T.BooleanType()


def _table(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in fields])


STANDARD = _table(
    ("id", _s, False), ("kind", _s, False), ("number", _s, False), ("year", _i, False),
    ("title", _s, False), ("order_date", _d, False), ("order_no", _s, False),
    ("effective_from", _d, False), ("effective_to", _d, True), ("superseded_by", _s, True),
    ("source_url", _s, False),
)
EDITION = _table(
    ("id", _s, False), ("standard_id", _s, False), ("edition_no", _i, False),
    ("amending_order", _s, True), ("effective_from", _d, False),
)
CLAUSE = _table(
    ("id", _s, False), ("standard_id", _s, False), ("edition_id", _s, False), ("pos", _i, False),
    ("path", _s, False), ("parent_path", _s, True), ("heading", _s, True), ("text", _s, False),
)
MAPPING = _table(
    ("standard_id", _s, False), ("clause_path", _s, False), ("edition_from", _i, True),
    ("config", _s, False), ("version_from", _s, True), ("kind", _s, False),
    ("object_ref", _s, False), ("note", _s, True), ("confidence", _i, False),
    ("verified", _b, False),
)
CONFIG_OBJECT = _table(
    ("config", _s, False), ("ref", _s, False), ("kind", _s, False), ("presentation", _s, False),
)
LINK = _table(
    ("standard_id", _s, False), ("clause_path", _s, False), ("edition_from", _i, True),
    ("its_id", _s, False), ("title", _s, False), ("summary", _s, False), ("verified", _b, False),
)
STANDARD_RELATION = _table(
    ("from_standard", _s, False), ("to_standard", _s, False), ("kind", _s, False),
)
CLAUSE_RELATION = _table(
    ("from_standard", _s, False), ("from_clause_path", _s, False), ("from_edition_from", _i, True),
    ("to_standard", _s, False), ("to_clause_path", _s, False), ("to_edition_from", _i, True),
    ("kind", _s, False),
)
CORPUS_META = _table(
    ("built_at", _d, False), ("registry_hash", _s, False), ("source_snapshot_date", _d, False),
)

NESTED_CLAUSE = _table(
    ("pos", _i, True), ("path", _s, True), ("parent_path", _s, True), ("heading", _s, True), ("text", _s, True),
)
NESTED_EDITION = _table(
    ("edition_no", _i, True), ("amending_order", _s, True), ("effective_from", _d, True),
    ("part", _i, True), ("clauses", T.ArrayType(NESTED_CLAUSE), True),
)
# One source document, or a part of one (see sources.documents.nest_documents): `continues` marks the parts
# whose standard another part describes, `part` those whose edition does; a clause may state its position.
DOCUMENT = T.StructType(
    [T.StructField(f.name, f.dataType, True) for f in STANDARD.fields]
    + [T.StructField("editions", T.ArrayType(NESTED_EDITION), True), T.StructField("continues", T.BooleanType(), True)]
)
