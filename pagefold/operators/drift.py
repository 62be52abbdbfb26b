"""Schemas that drift between files: per-file schemas, their promotion, one table, and a log of departures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.functions.values import computed, let

#: Declared fields that one call takes; they are a fixed table and become part of the expressions.
MAX_DECLARED = 1_000

# The kind of value that each declared type names.
KINDS = {
    "integer": "integer",
    "number": "number",
    "string": "string",
    "boolean": "boolean",
    "array of 4 numbers": "box",
    "array of arrays of 4 numbers": "boxes",
    "array of figure": "objects",
    "object": "object",
    "array": "array",
}
#: Kinds that stand in for a missing field of a declared kind.
STANDS_IN = {"array of 4 numbers": ("box",), "array of arrays of 4 numbers": ("boxes",)}
#: What a page id looks like: letters, an underscore, digits.
PAGE_ID = r"^[A-Za-z]+_[0-9]+$"
#: The lattice: kinds join to the least kind above both; ``null`` is below all, ``empty`` below the lists of any length, ``any`` on top.
ABOVE = {"integer": "number", "number": "any", "page id": "string", "string": "any", "box": "array", "boxes": "array", "objects": "array", "array": "any", "object": "any", "boolean": "any"}
#: Kinds of lists that may have no element.
MAY_BE_EMPTY = ("boxes", "objects", "array")


def chain(kind: str) -> list[str]:
    """A kind and all above it."""
    out = [kind]
    while out[-1] in ABOVE:
        out.append(ABOVE[out[-1]])
    return out


def within(kind: str) -> list[str]:
    """Kinds whose join with ``kind`` is ``kind``: a value of theirs needs no promotion there."""
    return ["null", *[k for k in (*ABOVE, "any") if kind in chain(k)], *(["empty"] if kind in (*MAY_BE_EMPTY, "any") else [])]


def readable(body: Column) -> Column:
    """The body as a variant if it is exactly one JSON object, else null (empty, cut off, followed by more, a repeated key)."""
    whole = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    only = let(F.try_variant_get(whole, "$", "array<variant>"), lambda one: F.when(F.size(one) == 1, F.get(one, F.lit(0))))
    return F.when(F.btrim(body, F.lit(" \t\r\n")).startswith("{"), only)


def kind(v: Column) -> Column:
    """The kind of a JSON value. Numbers count by value: 2, 2.0 and 2e0 are integers."""
    numeric = lambda x: F.schema_of_variant(x).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    four = lambda a: (F.size(a) == 4) & F.forall(a, numeric)
    number = let(F.try_variant_get(v, "$", "double"), lambda n: F.when(n == F.floor(n), "integer").otherwise("number"))
    text = F.when(F.try_variant_get(v, "$", "string").rlike(PAGE_ID), "page id").otherwise("string")
    boxes = lambda items: F.forall(items, lambda x: let(F.try_variant_get(x, "$", "array<variant>"), lambda a: F.coalesce(four(a), F.lit(False))))

    def listed(t: Column) -> Column:
        return let(
            F.try_variant_get(v, "$", "array<variant>"),
            lambda items: F.when(F.size(items) == 0, "empty")
            .when(t.startswith("ARRAY<ARRAY<"), F.when(boxes(items), "boxes").otherwise("array"))
            .when(t.startswith("ARRAY<OBJECT<"), "objects")
            .when(four(items), "box")
            .when((t == "ARRAY<VARIANT>") & boxes(items), "boxes")
            .otherwise("array"),
        )

    return let(
        F.schema_of_variant(v),
        lambda t: F.when(t == "STRING", text)
        .when(t == "BIGINT", "integer")
        .when(t.startswith("ARRAY<"), listed(t))
        .when(t == "VOID", "null")
        .when(t.startswith("OBJECT<"), "object")
        .when(t == "BOOLEAN", "boolean")
        .when(t.rlike("^(DECIMAL|DOUBLE|FLOAT)"), number)
        .otherwise("any"),
    )


def header(obj: Column) -> Column:
    """The schema of one JSON object: an array of (name, kind) in order of name."""
    fields = F.map_entries(F.try_variant_get(obj, "$", "map<string,variant>"))
    return F.sort_array(F.transform(fields, lambda e: F.struct(e["key"].alias("name"), kind(e["value"]).alias("kind"))))


def file_headers(files: DataFrame, key: str, body: str, inner: str | None = None) -> DataFrame:
    """``key, holder, at, header`` for each object of each readable body: the body (``page``, 0) and the elements of ``inner`` (``figure``, 1, 2, ...).

    Parsed once per file in the executors by built-in functions; nothing is shuffled. Elements that aren't objects give no row.
    """
    read = computed(files.select(key, F.col(body).alias("_b")), _v=readable(F.col("_b"))).where("_v IS NOT NULL")
    page = F.struct(F.lit("page").alias("holder"), F.lit(0).alias("at"), header(F.col("_v")).alias("header"))
    if inner is None:
        return read.select(key, page.alias("o")).select(key, "o.*")
    parts = F.coalesce(F.try_variant_get("_v", f"$.{inner}", "array<variant>"), F.array().cast("array<variant>"))
    figures = F.transform(F.filter(parts, lambda x: F.schema_of_variant(x).startswith("OBJECT<")), lambda x, i: F.struct(F.lit("figure").alias("holder"), (i + 1).alias("at"), header(x).alias("header")))
    return read.select(key, F.explode(F.concat(F.array(page), figures)).alias("o")).select(key, "o.*")


def declared_of(declared: DataFrame, file_kind: str) -> dict[str, list[tuple[str, str]]]:
    """Declared (name, kind) by holder; rows with a null name or kind, or a kind unknown here, are refused."""
    rows = declared.where(F.col("file_kind") == file_kind).select("holder", "field_name", "json_type").limit(MAX_DECLARED + 1).collect()
    if len(rows) > MAX_DECLARED or any(r["json_type"] not in KINDS or r["field_name"] is None for r in rows):
        raise ValueError("declared fields: too many, or of an unknown kind")
    out: dict[str, list[tuple[str, str]]] = {}
    for r in sorted(rows):
        out.setdefault(r["holder"], []).append((r["field_name"], r["json_type"]))
    return out


def _stand_in(name: str, json_type: str) -> list[str]:
    """Kinds that may hold the value of a missing field; page ids only that of a field declared as one."""
    return ["page id"] if json_type == "string" and name.endswith("page_id") else list(STANDS_IN.get(json_type, ()))


def _departures(header: Column, declared: list[tuple[str, str]]) -> Column:
    """Departures of one object: (field_name, change_type, found) in order of name.

    Missing fields claim their stand-ins one by one in order of name: among the undeclared fields of the right kind
    that no earlier field claimed, the one whose name is nearest.
    """
    names = F.array(*[F.lit(n) for n, _ in declared])
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*[F.lit(k) for k in within(KINDS[t])]).alias("good"), F.array(*[F.lit(k) for k in _stand_in(n, t)]).cast("array<string>").alias("stand_in")) for n, t in declared])
    none = F.lit(None).cast("string")
    row = lambda name, change, found: F.struct(name.alias("field_name"), F.lit(change).alias("change_type"), found.alias("found"))
    held = F.transform(header, lambda e: e["name"])
    strange = F.filter(header, lambda e: ~F.array_contains(names, e["name"]))

    def claim(claims: Column, m: Column) -> Column:
        taken = F.transform(claims, lambda c: c["found"])
        able = F.filter(strange, lambda e: F.array_contains(m["stand_in"], e["kind"]) & ~F.coalesce(F.array_contains(taken, e["name"]), F.lit(False)))
        near = F.array_min(F.transform(able, lambda e: F.struct(F.levenshtein(F.lower(e["name"]), m["name"]).alias("d"), e["name"].alias("n"))))["n"]
        return F.concat(claims, F.array(F.struct(m["name"].alias("name"), near.alias("found"))))

    missing = F.filter(table, lambda m: ~F.array_contains(held, m["name"]))
    claims = F.aggregate(missing, F.array().cast("array<struct<name:string,found:string>>"), claim)
    gone = F.transform(claims, lambda c: F.struct(c["name"].alias("field_name"), F.when(c["found"].isNull(), "removed").otherwise("renamed").alias("change_type"), c["found"].alias("found")))
    used = F.transform(gone, lambda c: c["found"])
    added = F.transform(F.filter(strange, lambda e: ~F.coalesce(F.array_contains(used, e["name"]), F.lit(False))), lambda e: row(e["name"], "added", e["kind"]))
    good = F.map_from_entries(F.transform(table, lambda m: F.struct(m["name"], m["good"])))
    retyped = F.transform(F.filter(header, lambda e: F.array_contains(names, e["name"]) & ~F.array_contains(good[e["name"]], e["kind"])), lambda e: row(e["name"], "retyped", e["kind"]))
    return F.when(F.size(header) >= 0, F.concat(gone, added, retyped))


def departures(headers: DataFrame, declared: dict[str, list[tuple[str, str]]], key: str) -> DataFrame:
    """``key, holder, at, field_name, change_type, found``: ordered differences of each object from the declared fields.

    ``renamed`` names the declared field and in ``found`` the field that holds its value; ``removed`` has none;
    ``retyped`` has the kind found; ``added`` the undeclared name and its kind. Kept per object: make keys distinct
    where copies or several objects of a file show the same.
    """
    changes = F.lit(None).cast("array<struct<field_name:string,change_type:string,found:string>>")
    for holder, fields in declared.items():
        changes = F.when(F.col("holder") == holder, _departures(F.col("header"), fields)).otherwise(changes)
    return headers.select(key, "holder", "at", F.explode(changes).alias("c")).select(key, "holder", "at", "c.*")


def promoted(headers: DataFrame) -> DataFrame:
    """``holder, field_name, kinds, kind, objects``: the union schema, each field's kinds folded through the lattice.

    The fold is a set union that is combined before the shuffle; a field has a dozen kinds at most.
    """
    seen = headers.select("holder", F.explode("header").alias("f")).groupBy("holder", F.col("f.name").alias("field_name")).agg(F.sort_array(F.collect_set("f.kind")).alias("kinds"), F.count(F.lit(1)).alias("objects"))
    chains = F.create_map(*[x for k in (*ABOVE, "any") for x in (F.lit(k), F.array(*[F.lit(c) for c in chain(k)]))])
    real = F.filter("kinds", lambda k: ~k.isin("null", "empty"))
    join = F.aggregate(real, F.lit(None).cast("string"), lambda a, k: F.when(a.isNull() | (a == k), k).otherwise(F.get(F.array_intersect(chains[a], chains[k]), F.lit(0))))
    fallback = F.when(F.array_contains("kinds", "empty"), "array").otherwise("null")
    join = F.when(F.array_contains("kinds", "empty") & ~join.isin(*MAY_BE_EMPTY, "any"), F.when(join == "box", "array").otherwise("any")).otherwise(join)
    return seen.withColumn("kind", F.coalesce(join, fallback))


# The Spark type of each promoted kind; what no single type holds is JSON text.
UNION_TYPES = {"integer": "bigint", "number": "double", "string": "string", "page id": "string", "boolean": "boolean", "box": "array<double>", "boxes": "array<array<double>>", "objects": "array<string>", "array": "array<string>", "object": "map<string,string>", "null": "string", "any": "string"}
#: Fields that the union schema may have: they become columns.
MAX_FIELDS = 5_000


def union_fields(schema: DataFrame, holder: str) -> dict[str, str]:
    """The union schema of a holder as field and kind, from ``promoted``; more than MAX_FIELDS are refused."""
    rows = schema.where(F.col("holder") == holder).select("field_name", "kind").limit(MAX_FIELDS + 1).collect()
    if len(rows) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} fields")
    return dict(sorted((r["field_name"], r["kind"]) for r in rows))


def _union_cast(v: Column, kind: str) -> Column:
    """A value cast to the type of a kind at or above its own, which holds it whole; null stays null."""
    value = F.when(~F.is_variant_null(v), v)
    if kind in ("objects", "array"):
        return F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.to_json(x))
    if kind == "any":
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))
    if kind == "object":
        return F.transform_values(F.try_variant_get(value, "$", "map<string,variant>"), lambda _, x: F.to_json(x))
    return F.try_variant_get(value, "$", UNION_TYPES[kind])


def unified(files: DataFrame, key: str, body: str, fields: dict[str, str], holder: str, inner: str | None = None) -> DataFrame:
    """All readable bodies cast to the union schema: ``key, at`` and a column per field of ``fields`` (``union_fields``), undeclared ones too.

    The lattice makes each field's type hold every value of it, so none is lost: kinds without a common type are JSON
    text. Columns carry the names as found; two that differ in letter case only get the suffix ``__2`` and so on. An
    absent field is null, as is a null. Unreadable bodies give no row.
    """
    objects = _objects(files, key, body, holder, inner)
    objects = computed(objects, _m=F.try_variant_get("_o", "$", "map<string,variant>"))
    taken: dict[str, int] = {key.lower(): 1, "at": 1}
    columns = []
    for name, kind in fields.items():
        taken[name.lower()] = n = taken.get(name.lower(), 0) + 1
        columns.append(_union_cast(F.try_element_at("_m", F.lit(name)), kind).alias(name if n == 1 else f"{name}__{n}"))
    return objects.select(key, "at", *columns)


def unreadable(files: DataFrame, key: str, body: str) -> DataFrame:
    """``key, reason`` of bodies that aren't one JSON object: ``null``, ``blank`` or ``not one JSON object``."""
    blank = F.btrim(body, F.lit(" \t\r\n")) == ""
    reason = F.when(F.col(body).isNull(), "null").when(blank, "blank").when(readable(F.col(body)).isNull(), "not one JSON object")
    return files.select(key, reason.alias("reason")).where("reason IS NOT NULL")


def _objects(files: DataFrame, key: str, body: str, holder: str, inner: str | None) -> DataFrame:
    """``key, at, _o``: the objects of a holder in readable bodies."""
    read = computed(files.select(key, F.col(body).alias("_b")), _v=readable(F.col("_b"))).where("_v IS NOT NULL")
    if holder == "page":
        return read.select(key, F.lit(0).alias("at"), F.col("_v").alias("_o"))
    parts = F.coalesce(F.try_variant_get("_v", f"$.{inner}", "array<variant>"), F.array().cast("array<variant>"))
    return read.select(key, F.posexplode(parts).alias("at", "_o")).where(F.schema_of_variant("_o").startswith("OBJECT<")).withColumn("at", F.col("at") + 1)


# The Spark type of each declared kind.
SPARK_TYPES = {"integer": "bigint", "number": "double", "string": "string", "boolean": "boolean", "array of 4 numbers": "array<double>", "array of arrays of 4 numbers": "array<array<double>>", "array of figure": "array<variant>", "object": "map<string,string>", "array": "array<string>"}


#: A number, and four of them as text: separated by commas or blanks, in brackets or not.
NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
FOUR = rf"^\s*[\[(]?\s*{NUMBER}(?:(?:\s*[,;]\s*|\s+){NUMBER}){{3}}\s*[\])]?\s*$"


def _whole(a: Column) -> Column:
    return F.when((F.size(a) == 4) & F.forall(a, lambda x: x.isNotNull()), a)


def _box(v: Column) -> Column:
    """A box however it is written: four numbers (or texts of such), nested once more, an object of its sides, text; else null."""
    items = F.try_variant_get(v, "$", "array<variant>")
    sides = F.array(*[F.try_variant_get(v, f"$.{k}", "double") for k in ("x0", "y0", "x1", "y1")])
    text = let(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), lambda x: F.when(x.rlike(FOUR), F.regexp_extract_all(x, F.lit(NUMBER), F.lit(0)).cast("array<double>")))
    return F.coalesce(_whole(F.try_variant_get(v, "$", "array<double>")), F.when(F.size(items) == 1, _whole(F.try_variant_get(v, "$[0]", "array<double>"))), _whole(sides), text)


def _boxes(v: Column) -> Column:
    """Boxes however they are written: a list of what ``_box`` reads, flat numbers, one box, an object of boxes (in order of the number in their names), JSON text of these; else null."""
    whole = lambda b: F.when((F.size(b) > 0) & F.forall(b, lambda x: x.isNotNull()), b)
    every = lambda items: let(F.transform(items, _box), whole)
    number = lambda k: F.coalesce(F.regexp_extract(k, "([0-9]{1,9})[^0-9]*$", 1).try_cast("int"), F.lit(0))

    def read(v: Column) -> Column:
        numbers = let(F.try_variant_get(v, "$", "array<double>"), whole)
        flat = let(numbers, lambda a: F.when(F.size(a) % 4 == 0, F.transform(F.sequence(F.lit(1), F.size(a), F.lit(4)), lambda i: F.slice(a, i, F.lit(4)))))
        one = let(_box(v), lambda b: F.when(b.isNotNull(), F.array(b)))
        named = let(F.try_variant_get(v, "$", "map<string,variant>"), lambda m: F.transform(F.array_sort(F.transform(F.map_keys(m), lambda k: F.struct(number(k).alias("n"), k.alias("k")))), lambda o: F.try_element_at(m, o["k"])))
        return F.coalesce(every(F.try_variant_get(v, "$", "array<variant>")), flat, one, every(named))

    text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.coalesce(read(v), let(F.try_parse_json(text), read))


#: How a value of another shape than declared is read all the same, and what an element of its plain cast must be to say something.
RECOVERED = {"array of 4 numbers": (_box, lambda x: x.isNotNull()), "array of arrays of 4 numbers": (_boxes, lambda x: F.exists(x, lambda y: y.isNotNull()))}


def conformed(files: DataFrame, key: str, body: str, declared: dict[str, list[tuple[str, str]]], holder: str, inner: str | None = None) -> DataFrame:
    """One table of the declared columns of ``holder`` over all readable bodies: ``key, at`` and a column per field.

    Each value is cast to the declared type, from its stand-in where the field was renamed; boxes are also read from
    text, objects, flat and nested lists. What can't be cast is null. ``retyped`` has, by declared name, the JSON of
    every value that is of another kind than declared or that the cast can't hold, recovered or not, so that none is
    lost; null if there is none. Undeclared fields stay as JSON text in ``rest``; ``unified`` has them in columns of
    their own. Unreadable bodies give no row.
    """
    objects = _objects(files, key, body, holder, inner)
    fields = declared.get(holder, [])
    objects = computed(objects.select(key, "at", "_o"), _h=header(F.col("_o")))
    split = lambda d: F.struct(F.map_from_entries(F.transform(F.filter(d, lambda c: c["change_type"] == "renamed"), lambda c: F.struct(c["field_name"], c["found"]))).alias("c"), F.transform(F.filter(d, lambda c: c["change_type"] == "retyped"), lambda c: c["field_name"]).alias("t"))
    objects = computed(objects, _d=let(_departures(F.col("_h"), fields), split), _m=F.try_variant_get("_o", "$", "map<string,variant>"))
    values, found = F.col("_m"), F.col("_d")["c"]
    objects = computed(objects, _held=F.transform(F.array(*[F.coalesce(found[name], F.lit(name)) for name, _ in fields]).cast("array<string>"), lambda k: F.try_element_at(values, k)))
    columns, raw = {}, []
    for i, (name, json_type) in enumerate(fields):
        held, other = F.get("_held", F.lit(i)), F.array_contains(F.col("_d")["t"], name)
        cast = F.try_variant_get(held, "$", SPARK_TYPES[json_type])
        if json_type in RECOVERED:
            again, says = RECOVERED[json_type]
            some = let(cast, lambda a: F.when(F.exists(a, says), a))  # noqa: B023
            cast = F.when(other, F.coalesce(let(held, again), some)).otherwise(cast)
        out = f"n_{name}" if json_type == "array of figure" else name
        columns[out] = F.size(cast) if json_type == "array of figure" else cast
        raw.append(F.when(held.isNotNull() & ~F.is_variant_null(held) & (other | F.col(f"`{out}`").isNull()), F.struct(F.lit(name).alias("k"), held.alias("v"))))
    if columns:
        objects = computed(objects, **columns)
    kept = F.array_compact(F.array(*raw).cast("array<struct<k:string,v:variant>>"))
    retyped = let(kept, lambda a: F.when(F.size(a) > 0, F.to_json(F.map_from_entries(a))))
    rest = F.filter(F.map_entries(values), lambda e: ~e["key"].isin([n for n, _ in fields]) & ~F.coalesce(F.array_contains(F.map_values(found), e["key"]), F.lit(False)))
    return objects.select(key, "at", *[F.col(f"`{c}`") for c in columns], retyped.alias("retyped"), F.to_json(F.map_from_entries(F.transform(rest, lambda e: F.struct(e["key"], e["value"].cast("string"))))).alias("rest"))
