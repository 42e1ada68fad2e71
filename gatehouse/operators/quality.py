"""Field rules, unit heuristics and cross-field rules over a column of JSON objects.

A specification is a plain dict; it is compiled once into one array expression per row, so a table is
checked in a single narrow pass whatever the number of rules.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from typing import Any, NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.functions.bind import explode_rows, let
from gatehouse.functions.variants import at, doc, facts, field, items, keys, text

_V = "struct<path:string,rule:string,severity:string>"


def _hit(when: Column, path: str | Column, rule: str, severity: str) -> Column:
    path = F.lit(path) if isinstance(path, str) else path
    return F.when(when, F.struct(path.alias("path"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))).cast(_V)


def columns_as_json(df: DataFrame, columns: list[str], out: str = "args") -> DataFrame:
    """Typed columns as a JSON object; NULL columns are absent fields."""
    return df.withColumn(out, F.to_json(F.struct(*columns)))


def _type_ok(x: Column, kind_: str) -> Column:
    """``x`` is a :func:`facts` struct."""
    if kind_ == "integer":
        return F.coalesce(x["num"] == F.floor(x["num"]), F.lit(False))
    return F.coalesce(x["kind"] == kind_, F.lit(False))


def _unit_hits(path: str, n: Column, unit: str) -> list[Column]:
    whole = n == F.floor(n)
    if unit == "cents":
        return [_hit(~whole, path, "unit-coercion", "medium"), _hit((n > 0) & (n < 1), path, "unit-coercion", "medium")]
    limit = {"usd": whole & (n >= 10000), "bps": n > 10000, "percent": n > 100}[unit]
    return [_hit(limit, path, "unit-coercion", "medium")]


def _field_hits(x: Column, name: str, spec: dict, units_only: bool = False) -> list[Column]:
    present = x["v"].isNotNull()
    null = F.coalesce(x["kind"] == "null", F.lit(False))
    typed = present & ~null & _type_ok(x, spec["type"])
    out: list[Column] = []
    n, s = x["num"], x["str"]
    if not units_only:
        if spec.get("required"):
            out.append(_hit(~present, name, "required", "critical"))
        if not spec.get("nullable"):
            out.append(_hit(null, name, "null", "high"))
        out.append(_hit(present & ~null & ~typed, name, "type", "high"))
        if spec.get("enum"):
            words = [x for x in spec["enum"] if isinstance(x, str)]
            values = [float(x) for x in spec["enum"] if isinstance(x, (int, float)) and not isinstance(x, bool)]
            listed = F.coalesce(s.isin(words), F.lit(False)) | F.coalesce(n.isin(values), F.lit(False))
            out.append(_hit(typed & ~listed, name, "enum", "high"))
    if spec["type"] in ("number", "integer"):
        if not units_only:
            if "min" in spec:
                out.append(_hit(typed & (n < spec["min"]), name, "min", "medium"))
            if "max" in spec:
                out.append(_hit(typed & (n > spec["max"]), name, "max", "medium"))
        if spec.get("unit"):
            out += [F.when(typed, h) for h in _unit_hits(name, n, spec["unit"])]
    if spec["type"] == "string" and not units_only:
        if "minLength" in spec:
            out.append(_hit(typed & (F.length(s) < spec["minLength"]), name, "minLength", "medium"))
        if "maxLength" in spec:
            out.append(_hit(typed & (F.length(s) > spec["maxLength"]), name, "maxLength", "medium"))
        if "pattern" in spec:
            out.append(_hit(typed & ~s.rlike(spec["pattern"]), name, "pattern", "medium"))
    return out


def _explode_hits(df: DataFrame, hits: Column) -> DataFrame:
    return explode_rows(df, ["subject_id"], F.filter(hits, lambda h: h.isNotNull()), "h").select("subject_id", "h.*")


def _with_fields(df: DataFrame, id_col: str, args_col: str, names: list[str]) -> DataFrame:
    """``subject_id, a`` and one facts column per field: every value is read from the document once."""
    base = df.select(F.col(id_col).alias("subject_id"), doc(F.col(args_col)).alias("a"))
    return base.select("*", *[facts(field(F.col("a"), n)).alias(f"f{i}") for i, n in enumerate(names)])


def check_fields(df: DataFrame, id_col: str, args_col: str, spec: dict) -> DataFrame:
    """``spec``: ``{"fields": {name: {type, required, nullable, enum, min, max, minLength, maxLength, pattern,
    unit}}, "allowUnknown": bool}``.  After a null or type violation a field has no further ones."""
    names = list(spec["fields"])
    base = _with_fields(df, id_col, args_col, names)
    hits = F.array(*[h for i, n in enumerate(names) for h in _field_hits(F.col(f"f{i}"), n, spec["fields"][n])])
    if not spec.get("allowUnknown"):
        declared = F.array(*[F.lit(n) for n in names])
        hits = F.concat(hits, F.transform(F.array_except(keys(F.col("a")), declared), lambda k: _hit(F.lit(True), k, "unknown", "low")))
    return _explode_hits(base, hits)


def unit_heuristics(df: DataFrame, id_col: str, args_col: str, spec: dict) -> DataFrame:
    names = [n for n, f in spec["fields"].items() if f.get("unit")]
    base = _with_fields(df, id_col, args_col, names)
    return _explode_hits(base, F.array(*[h for i, n in enumerate(names) for h in _field_hits(F.col(f"f{i}"), n, spec["fields"][n], units_only=True)]))


_OPS = {"lte": "__le__", "gte": "__ge__", "lt": "__lt__", "gt": "__gt__", "eq": "__eq__", "neq": "__ne__"}


def cross_field_rules(df: DataFrame, id_col: str, args_col: str, rules: list[dict]) -> DataFrame:
    """``rules``: ``{"left": path, "op": lte|gte|lt|gt|eq|neq, "right": path or {"const": value}}``.
    A missing side or two different types skip the rule."""
    paths = list(dict.fromkeys(x for r in rules for x in (r["left"], r["right"]) if isinstance(x, str)))
    base = df.select(F.col(id_col).alias("subject_id"), doc(F.col(args_col)).alias("a")).select(
        "subject_id", *[facts(at(F.col("a"), "$" + "".join(f"['{p}']" for p in x.split(".")))).alias(f"f{i}") for i, x in enumerate(paths)])

    def side(x) -> tuple[Column, Column]:
        if isinstance(x, dict):
            c = x["const"]
            is_num = isinstance(c, (int, float)) and not isinstance(c, bool)
            return (F.lit(float(c)) if is_num else F.lit(None).cast("double")), (F.lit(c) if isinstance(c, str) else F.lit(None).cast("string"))
        return F.col(f"f{paths.index(x)}.num"), F.col(f"f{paths.index(x)}.str")

    hits = []
    for r in rules:
        (ln, ls), (rn, rs) = side(r["left"]), side(r["right"])
        # A comparison with NULL is NULL: missing values and mixed types skip by themselves.
        broken = F.coalesce(~getattr(ln, _OPS[r["op"]])(rn), ~getattr(ls, _OPS[r["op"]])(rs), F.lit(False))
        hits.append(_hit(broken, f"__cross__.{r['left']}", f"cross-field.{r['op']}", "high"))
    return _explode_hits(base, F.array(*hits))


def tool_argument_findings(df: DataFrame, id_col: str, args_col: str, spec: dict) -> DataFrame:
    """All three groups as findings for the verdict kernel."""
    from gatehouse.operators.findings import as_findings

    all_ = check_fields(df, id_col, args_col, spec)
    if spec.get("rules"):
        all_ = all_.unionByName(cross_field_rules(df, id_col, args_col, spec["rules"]))
    return as_findings(all_.select("subject_id", F.col("rule").alias("rule_id"), "severity", F.col("path").alias("matched")), "tool-args")


# String formats.
FORMATS = {
    "date": r"\A[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])\z",
    "date-time": r"(?i)\A[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])\z",
    "email": r"\A[^\s@]+@[^\s@]+\.[^\s@]+\z",
    "uuid": r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z",
    "uri": r"\A[a-zA-Z][a-zA-Z0-9+\-.]*:[^\s]+\z",
    "ipv4": r"\A((25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\z",
}
_E = "struct<path:string,keyword:string>"


def _err(when: Column, path: Column, keyword: str) -> Column:
    return F.when(when, F.struct(path.alias("path"), F.lit(keyword).alias("keyword"))).cast(_E)


def _pointer(name: str) -> str:
    return "/" + name.replace("~", "~0").replace("/", "~1")


def _same(x: Column | _Value, value) -> Column:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.coalesce(x["num"] == float(value), F.lit(False))
    if isinstance(value, str):
        return F.coalesce(x["str"] == value, F.lit(False))
    return F.coalesce(text(x["v"]) == text(F.parse_json(F.lit(json.dumps(value)))), F.lit(False))


class _Root(NamedTuple):
    """The whole schema, and the references that are open on the way to a part of it."""

    schema: Any
    open: tuple[str, ...] = ()

    def enter(self, ref: str) -> "_Root":
        if ref in self.open:
            raise ValueError(f"{ref} leads back to itself: a schema without a fixed depth is no column expression")
        return _Root(self.schema, (*self.open, ref))

    def target(self, ref: str) -> Any:
        """What a local JSON pointer (``#/...``) leads to, or None."""
        part = self.schema
        for token in unquote(ref[2:]).split("/") if ref.startswith("#/") else [None]:
            if not isinstance(part, dict) or token is None:
                return None
            part = part.get(token.replace("~1", "/").replace("~0", "~"))
        return part


class _Value:
    """The facts of a value, and those of the members that the schemas judging it ask for, each read once."""

    def __init__(self, facts: Column, members: dict[str, Column]):
        self.facts, self.members = facts, members

    def __getitem__(self, part: str) -> Column:
        return self.facts[part]


def _in_place(schema: Any, root: _Root) -> Iterator[dict]:
    """The schemas that judge the same value."""
    if not isinstance(schema, dict):
        return
    ref = schema.get("$ref")
    if isinstance(ref, str):
        yield from _in_place(root.target(ref), root.enter(ref))
        return
    yield schema
    for word in ("allOf", "anyOf", "oneOf"):
        for sub in schema[word] if isinstance(schema.get(word), list) else []:
            yield from _in_place(sub, root)
    yield from _in_place(schema.get("not"), root)


def _members(schema: Any, root: _Root) -> list[str]:
    return list(dict.fromkeys(name for part in _in_place(schema, root) for name in [*part.get("properties", {}), *filter(_plain, part.get("required", []))]))


def _plain(name: str) -> bool:
    """Names that a path holds as they are."""
    return re.fullmatch("[A-Za-z0-9_-]+", name) is not None


def _schema_errors(v: Column, schema, path: Column, root: _Root) -> Column:
    """Array of errors of one value; built recursively over the schema, evaluated once per row."""
    names = _members(schema, root)
    if not names:
        return let(facts(v), lambda x: _node_errors(_Value(x, {}), schema, path, root))
    read = lambda x: F.struct(x.alias("x"), *[facts(field(x["v"], name)).alias(f"m{i}") for i, name in enumerate(names)])
    value = lambda b: _Value(b["x"], {name: b[f"m{i}"] for i, name in enumerate(names)})
    return let(let(facts(v), read), lambda b: _node_errors(value(b), schema, path, root))


def _member_errors(member: Column, schema, path: Column, root: _Root) -> Column:
    """Errors of a member whose facts are at hand."""
    return _schema_errors(member["v"], schema, path, root) if _members(schema, root) else _node_errors(_Value(member, {}), schema, path, root)


def _composed(x: _Value, schema: dict, path: Column, root: _Root) -> list[Column]:
    """Errors of ``allOf``, ``anyOf``, ``oneOf`` and ``not``; the schemas in them judge the same value."""
    parts = lambda word: schema[word] if isinstance(schema.get(word), list) else None
    fits = lambda sub: F.size(_node_errors(x, sub, path, root)) == 0
    out = [_node_errors(x, sub, path, root) for sub in parts("allOf") or []]
    if parts("anyOf") is not None:
        out.append(_errors_if(~functools.reduce(lambda a, b: a | b, map(fits, parts("anyOf")), F.lit(False)), path, "anyOf"))
    if parts("oneOf") is not None:
        out.append(_errors_if(sum((fits(sub).cast("int") for sub in parts("oneOf")), F.lit(0)) != 1, path, "oneOf"))
    if "not" in schema:
        out.append(_errors_if(fits(schema["not"]), path, "not"))
    return out


def _errors_if(when: Column, path: Column, keyword: str) -> Column:
    return F.when(when, F.array(_err(F.lit(True), path, keyword)))


def _node_errors(x: _Value, schema, path: Column, root: _Root) -> Column:
    none = F.array().cast(f"array<{_E}>")
    if schema is True or not isinstance(schema, (bool, dict)):
        return none
    if schema is False:
        return F.array(_err(F.lit(True), path, "false schema"))
    ref = schema.get("$ref")
    if isinstance(ref, str):  # stands for the whole schema: what is beside it does not count
        found = root.target(ref)
        return F.array(_err(F.lit(True), path, "$ref")) if found is None else _node_errors(x, found, path, root.enter(ref))
    v, k = x["v"], x["kind"]
    flat: list[Column] = []
    nested: list[Column] = []
    nullable = schema.get("nullable") is True
    if "type" in schema:
        types = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        ok = F.lit(False)
        for t in types:
            ok = ok | _type_ok(x, t)
        flat.append(_err(~ok, path, "type"))
    if "enum" in schema:
        ok = F.lit(False)
        for value in schema["enum"]:
            ok = ok | _same(x, value)
        flat.append(_err(~ok, path, "enum"))
    if "const" in schema:
        flat.append(_err(~_same(x, schema["const"]), path, "const"))
    s, n = x["str"], x["num"]
    tests = {
        "minLength": lambda x: F.length(s) < x, "maxLength": lambda x: F.length(s) > x, "pattern": lambda x: ~s.rlike(x),
        "format": lambda x: ~s.rlike(FORMATS[x]) if x in FORMATS else F.lit(False),
        "minimum": lambda x: n < x, "maximum": lambda x: n > x, "exclusiveMinimum": lambda x: n <= x, "exclusiveMaximum": lambda x: n >= x,
        "multipleOf": lambda x: (F.abs(n % x) > 1e-10 * x) & (F.abs(n % x - x) > 1e-10 * x) if x > 0 else F.lit(False),
    }
    for word, test in tests.items():
        if word in schema:
            flat.append(_err(test(schema[word]), path, word))
    if any(w in schema for w in ("minItems", "maxItems", "uniqueItems", "items")):
        arr = items(v)
        is_arr = k == "array"
        if "minItems" in schema:
            flat.append(_err(is_arr & (F.size(arr) < schema["minItems"]), path, "minItems"))
        if "maxItems" in schema:
            flat.append(_err(is_arr & (F.size(arr) > schema["maxItems"]), path, "maxItems"))
        if schema.get("uniqueItems") is True:
            distinct = F.size(F.array_distinct(F.transform(arr, text)))
            flat.append(_err(is_arr & (distinct < F.size(arr)), path, "uniqueItems"))
        part = schema.get("items")
        if isinstance(part, list):
            for i, sub in enumerate(part):
                nested.append(F.when(is_arr & (F.size(arr) > i), _schema_errors(F.get(arr, i), sub, F.concat(path, F.lit(f"/{i}")), root)))
        elif part is not None:
            nested.append(F.flatten(F.transform(arr, lambda e, i: _schema_errors(e, part, F.concat(path, F.lit("/"), i.cast("string")), root))))
    if any(w in schema for w in ("minProperties", "maxProperties", "required", "properties", "additionalProperties")):
        is_obj = F.coalesce(k == "object", F.lit(False))
        names = keys(v)
        if "minProperties" in schema:
            flat.append(_err(is_obj & (F.size(names) < schema["minProperties"]), path, "minProperties"))
        if "maxProperties" in schema:
            flat.append(_err(is_obj & (F.size(names) > schema["maxProperties"]), path, "maxProperties"))
        for r in schema.get("required", []):
            missing = x.members[r]["v"].isNull() if r in x.members and _plain(r) else ~F.array_contains(names, r)
            flat.append(_err(is_obj & missing, path, "required"))
        props = schema.get("properties", {})
        for name, sub in props.items():
            child = x.members[name]
            nested.append(F.when(is_obj & child["v"].isNotNull(), _member_errors(child, sub, F.concat(path, F.lit(_pointer(name))), root)))
        extra = schema.get("additionalProperties")
        if extra is not None and extra is not True:
            others = F.array_except(names, F.array(*[F.lit(p) for p in props]).cast("array<string>"))
            tail = lambda q: F.concat(path, F.lit("/"), F.replace(F.replace(q, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
            if extra is False:
                nested.append(F.when(is_obj, F.transform(others, lambda q: _err(F.lit(True), tail(q), "additionalProperties"))))
            else:
                values = F.try_variant_get(v, "$", "map<string,variant>")
                nested.append(F.when(is_obj, F.flatten(F.transform(others, lambda q: _schema_errors(F.element_at(values, q), extra, tail(q), root)))))
    nested += _composed(x, schema, path, root)
    own = F.filter(F.array(*flat), lambda e: e.isNotNull()) if flat else none
    out = F.concat(own, *[F.coalesce(x, none) for x in nested]) if nested else own
    return F.when(F.coalesce(k == "null", F.lit(False)), none).otherwise(out) if nullable else out


def schema_conformance(df: DataFrame, id_col: str, json_col: str, schema: dict) -> DataFrame:
    """One row per violation with its JSON pointer.  Text that is not JSON fails with keyword ``json``.

    ``$ref`` is resolved inside the schema; one that leads back to itself is an error of the call.
    """
    base = df.select(F.col(id_col).alias("subject_id"), doc(F.col(json_col)).alias("d"))
    errors = F.when(F.col("d").isNull(), F.array(_err(F.lit(True), F.lit(""), "json"))).otherwise(_schema_errors(F.col("d"), schema, F.lit(""), _Root(schema)))
    return explode_rows(base, ["subject_id"], errors, "e").select("subject_id", "e.*")


def schema_verdicts(df: DataFrame, id_col: str, json_col: str, schema: dict, mode: str = "block") -> DataFrame:
    base = df.select(F.col(id_col).alias("subject_id"), doc(F.col(json_col)).alias("d"))
    errors = F.when(F.col("d").isNull(), F.array(_err(F.lit(True), F.lit(""), "json"))).otherwise(_schema_errors(F.col("d"), schema, F.lit(""), _Root(schema)))
    bad = {"block": "BLOCK", "flag": "FLAG", "audit": "PASS"}[mode]
    return base.select("subject_id", F.size(errors).alias("errors")).select(
        "subject_id", "errors", F.when(F.col("errors") == 0, "PASS").otherwise(bad).alias("verdict"))
