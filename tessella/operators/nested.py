"""Flat tables from deeply nested JSON records (problem 2).

What stands around each record's JSON object is taken off, JSON strings of JSON are opened and keys become snake_case.
The merged schema is inferred from all records by one aggregation of the places and kinds of their values: a place that
holds objects in a list in some record is an array of records in all, a lone object there is an array of one. Elements
that are not objects become null, so that the others keep their position; what stood there, and any other value where
other records have an object, is kept as JSON text in a field beside it (``<name>_value``). The records are then typed
and every array level is exploded into a child table from the level above, which is stored once: level n + 1 reads only
what level n still holds. A child carries its own key, its parent's key and its 0-based ordinal. Keys are digests of the
record and the full place, plain objects included; the short path, which leaves them out, is a label.

Defined results: a null, cut off or unreadable record (also one nested deeper than the interpreter can follow) has no
rows; what lies deeper than LEVELS stays JSON text; of several records of one id the latest counts (ties: the greatest text); an empty table gives no rows; keys that
clash after renaming keep the first value that is not null; fields that clash with the key columns get the prefix ``f_``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Staging, ship, staged

#: Array fields of the extraction payload; they are arrays of records even where no record shows it.
ARRAY_FIELDS = (
    "parties", "rights_grants", "subjects", "definitions", "scope_modifiers", "exceptions", "windows", "payments",
    "installments", "evidence", "targets", "chunks", "issues", "refs",
)
#: Levels of objects that become fields; what lies deeper stays JSON text.
LEVELS = 50
KEYS = ("record_id", "row_key", "parent_key", "parent_path", "ordinal", "child_path")

_DECODER = json.JSONDecoder()
_BREAKS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_ODD = re.compile(r"[\W_]+")


def snake(key: str) -> str:
    return _ODD.sub("_", _BREAKS.sub("_", key).lower()).strip("_") or "_"


def outer_object(text: str | None) -> dict | None:
    """The JSON object in a text, whatever stands around it; None if there is none or it is cut off."""
    if text is None:
        return None
    text = text.strip().lstrip("\ufeff")
    while text.startswith('"'):  # a record that was written as a JSON string, however often
        try:
            inner = json.loads(text)
        except ValueError:
            return None
        text = inner.strip().lstrip("\ufeff")
    at = text.find("{")
    while at >= 0:
        try:
            value, _ = _DECODER.raw_decode(text, at)
            return value
        except json.JSONDecodeError as e:
            if e.pos >= len(text.rstrip()) - 1 or "Unterminated" in e.msg:
                return None  # cut off: what is inside is not a whole record
            if at == 0 or text[at - 1 : at + 2].strip("{ \n\"'") == "" and '"' in text[at : at + 3]:
                return None
        except RecursionError:
            return None
        at = text.find("{", at + 1)
    return None


# --- the merged schema ------------------------------------------------------------------------------------------------


@dataclass
class Node:
    """A place of the merged schema. other: the field beside it that keeps values of another kind; raw: the keys below
    as they are written, with their name and node."""

    kinds: set[str] = field(default_factory=set)
    below: dict[str, Node] = field(default_factory=dict)
    raw: dict[str, tuple[str, Node]] = field(default_factory=dict)
    kind: str = "object"
    other: str = ""


def observed(value: dict, node: Node, depth: int = 1) -> dict:
    """The record with snake_case keys; what its places hold (records in a list, object, list, scalar) is noted at the node."""
    out: dict = {}
    for k, v in value.items():
        if depth >= LEVELS and isinstance(v, dict | list):
            v = json.dumps(v, ensure_ascii=False)
        known = node.raw.get(k)
        if known is None:
            name = snake(k)
            known = node.raw[k] = name, node.below.setdefault(name, Node())
        name, n = known
        if isinstance(v, dict):
            n.kinds.add("object")
            v = observed(v, n, depth + 1)
        elif isinstance(v, list):
            v, inner = _listed(v, n, depth + 1)
            n.kinds.add("records" if inner else "list")
        else:
            n.kinds.add("null" if v is None else "scalar")
        if out.get(name) is None:
            out[name] = v
    return out


def _listed(items: list, node: Node, depth: int) -> tuple[list, bool]:
    new, inner = [], False
    for x in items:
        if isinstance(x, dict):
            inner = True
            x = observed(x, node, depth)
        new.append(x)
    return new, inner


def shapes(node: Node, at: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str]]:
    """The places below a node and what they hold."""
    for name, n in node.below.items():
        for kind in sorted(n.kinds):
            yield (*at, name), kind
        yield from shapes(n, (*at, name))


def merged(found: set[tuple[tuple[str, ...], str]], known: tuple[str, ...] = ()) -> Node:
    """The schema that holds every record; `known` names are arrays of records wherever they hold an object or a list."""
    root = Node()
    for place, kind in sorted(found):
        node = root
        for name in place:
            node = node.below.setdefault(name, Node())
        node.kinds.add(kind)

    def settle(node: Node) -> None:
        for name, n in node.below.items():
            if "records" in n.kinds or name in known and n.kinds & {"object", "list"}:
                n.kind = "records"
            else:
                n.kind = "object" if "object" in n.kinds else "list" if "list" in n.kinds else "scalar"
            if n.kind in ("records", "object"):
                n.other = f"{name}_value"
                while n.other in node.below:
                    n.other += "_"
            settle(n)

    settle(root)
    return root


def schema_of(node: Node) -> T.StructType:
    fields = []
    for name, n in node.below.items():
        inner = schema_of(n) if n.kind in ("records", "object") else T.StringType()
        fields.append(T.StructField(name, T.ArrayType(inner) if n.kind in ("records", "list") else inner))
        if n.other:
            fields.append(T.StructField(n.other, T.StringType()))
    return T.StructType(fields or [T.StructField("_", T.StringType())])  # files cannot hold a struct without fields


def _text(v) -> str | None:
    return v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False)


def laid_out(value: dict, node: Node) -> dict:
    """A renamed record in the layout of the merged schema."""
    out: dict = {}
    for k, v in value.items():
        n = node.below[k]
        if v is None:
            continue
        if n.kind == "records":
            items = v if isinstance(v, list) else [v]
            out[k] = [laid_out(x, n) if isinstance(x, dict) else None for x in items]
            odd = {str(i): x for i, x in enumerate(items) if not isinstance(x, dict) and x is not None}
            if odd:
                out[n.other] = _text(odd)
        elif n.kind == "object":
            if isinstance(v, dict):
                out[k] = laid_out(v, n)
            else:
                out[n.other] = _text(v)
        elif n.kind == "list":
            out[k] = [_text(x) for x in v] if isinstance(v, list) else [_text(v)]
        else:
            out[k] = _text(v)
    return out


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """record_id and renamed record; at a task's end, in a row without id, the shapes it has seen."""
    root = Node()
    for b in batches:
        ids, docs = [], []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            value = outer_object(text)
            if value is None:
                continue
            try:
                docs.append(json.dumps(observed(value, root), ensure_ascii=False).encode("utf-8", "replace").decode())
                ids.append(i)
            except RecursionError:
                continue
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(docs, pa.string())], names=["record_id", "doc"])
    seen = json.dumps([[list(p), k] for p, k in shapes(root)])
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([seen], pa.string())], names=["record_id", "doc"])


def latest(df: DataFrame, key: str, text: str, when: str) -> DataFrame:
    """record_id and payload of each key's latest record. Aggregated before the shuffle, so a key may have any number of records."""
    pick = F.max(F.struct(F.col(when).alias("w"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(text).alias("p")))
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("record_id")).agg(pick.alias("m")).select("record_id", F.col("m.p").alias("payload"))


def _typed(node: Node, schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = [laid_out(json.loads(x), node) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(docs, arrow)], names=["record_id", "rec"])

    return run


# --- the tables -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Place:
    """An array of records: the fields that lead to it from its parent's element, the place of the parent (None: the
    record itself), the struct of its elements, and the names of the arrays from the outside in."""

    no: int
    steps: tuple[str, ...]
    parent: int | None
    schema: T.StructType
    label: tuple[str, ...]


def places_of(schema: T.StructType) -> list[list[Place]]:
    """The arrays of each level."""
    count = 0

    def arrays(t: T.StructType, steps: tuple[str, ...]) -> Iterator[tuple[tuple[str, ...], T.StructType]]:
        for f in t.fields:
            if isinstance(f.dataType, T.StructType):
                yield from arrays(f.dataType, (*steps, f.name))
            elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                yield (*steps, f.name), f.dataType.elementType

    levels: list[list[Place]] = []
    above: list[tuple[int | None, T.StructType, tuple[str, ...]]] = [(None, schema, ())]
    while above:
        level = []
        for parent, t, label in above:
            for steps, inner in arrays(t, ()):
                level.append(Place(count, steps, parent, inner, (*label, steps[-1])))
                count += 1
        if level:
            levels.append(level)
        above = [(p.no, p.schema, p.label) for p in level]
    return levels


def _key(full: Column) -> Column:
    return F.md5(F.concat_ws("\u0001", F.col("record_id"), full))


class Flattened(Staging):
    """The typed records and the tables of their arrays."""

    def __init__(self, typed: DataFrame, schema: T.StructType) -> None:
        super().__init__(typed.sparkSession)
        self.typed, self.schema = typed, schema
        self.places = places_of(schema)
        self._levels: list[DataFrame] | None = None

    @property
    def levels(self) -> list[DataFrame]:
        """The child tables by level: record_id, place, row_key, parent_key, ordinal, child_path, parent_path and, of its
        place only, the object."""
        if self._levels is None:
            self._levels = []
            root = F.lit("$")
            above = self.typed.select("record_id", F.lit(-1).alias("place"), _key(root).alias("row_key"), root.alias("full"), root.alias("child_path"), F.col("rec").alias("r_root"))
            for level in self.places:
                above = self.stage(self._explode(above, level), "level")
                self._levels.append(above)
        return self._levels

    @staticmethod
    def _explode(above: DataFrame, level: list[Place]) -> DataFrame:
        """The level below: one generator over the elements of all its arrays."""

        def elements(p: Place) -> Column:
            holder = F.col("r_root" if p.parent is None else f"r{p.parent}")
            array = reduce(lambda c, f: c.getField(f), p.steps, holder)
            each = F.transform(
                array,
                lambda x, i: F.struct(
                    F.lit(p.no).alias("place"), i.alias("ordinal"), x.isNotNull().alias("is"), F.lit(".".join(p.steps)).alias("steps"), F.lit(p.steps[-1]).alias("name"),
                    *[(x if q is p else F.lit(None).cast(q.schema)).alias(f"r{q.no}") for q in level],
                ),
            )
            return F.coalesce(F.filter(each, lambda s: s["is"]), F.array().cast(T.ArrayType(_element(level))))

        rows = above.select("record_id", F.col("row_key").alias("parent_key"), F.col("full").alias("up"), F.col("child_path").alias("parent_path"), F.explode(F.concat(*[elements(p) for p in level])).alias("e"))
        at = lambda c: F.concat(c, F.lit("["), F.col("e.ordinal").cast("string"), F.lit("]"))
        rows = rows.withColumn("full", F.concat(F.col("up"), F.lit("."), at(F.col("e.steps"))))
        short = F.when(F.col("parent_path") == "$", at(F.col("e.name"))).otherwise(F.concat(F.col("parent_path"), F.lit("/"), at(F.col("e.name"))))
        return rows.select(
            "record_id", F.col("e.place").alias("place"), _key(F.col("full")).alias("row_key"), "parent_key", "full", short.alias("child_path"), "parent_path",
            F.col("e.ordinal").alias("ordinal"), *[F.col(f"e.r{p.no}").alias(f"r{p.no}") for p in level],
        )

    def rows(self, place: Place) -> DataFrame:
        """The objects at one place: the keys and rec."""
        at = next(i for i, level in enumerate(self.places) if place in level)
        return self.levels[at].filter(F.col("place") == place.no).select("record_id", "row_key", "parent_key", "child_path", "parent_path", "ordinal", F.col(f"r{place.no}").alias("rec"))

    def table(self, name: str) -> DataFrame:
        """The flat table of all arrays of this name: keys and the scalar fields of its objects; plain objects in them are
        spread, their names joined by '_'. A name no record has gives no rows."""
        parts = [p for level in self.places for p in level if p.label[-1] == name]
        if not parts:
            return self.typed.sparkSession.createDataFrame([], "record_id string, row_key string, parent_key string, child_path string, parent_path string, ordinal int")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self._flat(p) for p in parts])

    def _flat(self, place: Place) -> DataFrame:
        df = self.rows(place)
        return df.select("record_id", "row_key", "parent_key", "child_path", "parent_path", "ordinal", *[c.alias(n) for n, c in _scalars(place.schema, F.col("rec")).items()])

    def tables(self) -> DataFrame:
        """Every object of every array: table_name, record_id, row_key, parent_key, child_path, ordinal, fields (its scalar fields as JSON)."""
        parts = []
        for level, places in zip(self.levels, self.places, strict=True):
            fields = reduce(lambda other, p: F.when(F.col("place") == p.no, F.to_json(F.struct(*[c.alias(n) for n, c in _scalars(p.schema, F.col(f"r{p.no}")).items()]))).otherwise(other), places, F.lit("{}"))
            names = reduce(lambda other, p: F.when(F.col("place") == p.no, F.lit(p.label[-1])).otherwise(other), places, F.lit(""))
            parts.append(level.select(names.alias("table_name"), "record_id", "row_key", "parent_key", "child_path", "ordinal", fields.alias("fields")))
        none = "table_name string, record_id string, row_key string, parent_key string, child_path string, ordinal int, fields string"
        return reduce(DataFrame.unionAll, parts) if parts else self.typed.sparkSession.createDataFrame([], none)

    def links(self, names: tuple[str, ...] | None = ARRAY_FIELDS) -> DataFrame:
        """Parent and child path of every object in an array of one of the names. Paths leave out plain objects, so only
        where two places of the schema read alike can rows repeat."""
        parts, alike = [], False
        for level, places in zip(self.levels if self.places else [], self.places, strict=True):
            wanted = [p for p in places if names is None or p.label[-1] in names]
            alike = alike or len({p.label for p in wanted}) < len(wanted)
            if wanted:
                parts.append(level.filter(F.col("place").isin([p.no for p in wanted])).select("record_id", "parent_path", "child_path"))
        if not parts:
            return self.typed.sparkSession.createDataFrame([], "record_id string, parent_path string, child_path string")
        found = reduce(DataFrame.unionAll, parts)
        return found.distinct() if alike else found


def _element(level: list[Place]) -> T.StructType:
    head = [("place", T.IntegerType()), ("ordinal", T.IntegerType()), ("is", T.BooleanType()), ("steps", T.StringType()), ("name", T.StringType())]
    return T.StructType([T.StructField(n, t) for n, t in head] + [T.StructField(f"r{p.no}", p.schema) for p in level])


def _scalars(schema: T.StructType, rec: Column) -> dict[str, Column]:
    """The fields of an object that are no arrays of records, by flat name."""
    columns: dict[str, Column] = {}

    def spread(c: Column, t: T.StructType, prefix: str) -> None:
        for f in t.fields:
            n = f"{prefix}{f.name}"
            if isinstance(f.dataType, T.StructType):
                spread(c.getField(f.name), f.dataType, n + "_")
            elif not (isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)):
                n = f"f_{n}" if n in KEYS else n
                columns[n] = F.coalesce(columns[n].cast("string"), c.getField(f.name).cast("string")) if n in columns else c.getField(f.name)

    spread(rec, schema, "")
    return columns


def flatten(records: DataFrame, key: str, text: str, when: str, known: tuple[str, ...] = ARRAY_FIELDS) -> Flattened:
    """Infer the merged schema of the latest record of each key and make its arrays available as tables."""
    ship(records.sparkSession)
    kept: list[str] = []
    docs = staged(latest(records, key, text, when).mapInArrow(_clean, "record_id string, doc string"), "records", kept)
    # As many rows as tasks, each with the shapes of the schema; merged by one aggregation.
    found = docs.filter("record_id IS NULL").select(F.explode(F.from_json("doc", "array<string>")).alias("s")).distinct().collect()
    node = merged({(tuple(p), k) for p, k in (json.loads(r.s) for r in found)}, known)
    schema = schema_of(node)
    typed = docs.filter("record_id IS NOT NULL").mapInArrow(_typed(node, schema), T.StructType([T.StructField("record_id", T.StringType()), T.StructField("rec", schema)]))
    flat = Flattened(typed, schema)
    flat._kept += kept
    return flat
