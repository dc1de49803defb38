"""Arrays and JSON as column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

CALL = "struct<name:string,arguments:struct<bbox_2d:array<array<double>>>>"


def padded(c: Column, n: int, value: Column, left: bool = False) -> Column:
    """c filled up with value to n members; longer ones stay."""
    more = F.array_repeat(value, F.greatest(F.lit(n) - F.size(c), F.lit(0)))
    return F.concat(more, c) if left else F.concat(c, more)


def fitted(c: Column, n: int, value: Column, left: bool = True, truncation: str = "error") -> Column:
    """c padded to n members, or cut: 'left' keeps the end, 'right' the start, 'error' fails."""
    cut = {"left": F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), n), "right": F.slice(c, 1, n), "error": F.when(F.size(c) > n, F.raise_error(F.lit(f"over {n} members")).cast("array<long>")).otherwise(c)}
    return padded(cut[truncation], n, value, left)


def unpadded(c: Column, mask: Column) -> Column:
    """The last members of c, as many as the mask has ones."""
    n = F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int"))
    return F.when(n == 0, F.slice(c, 1, 0)).otherwise(F.slice(c, F.size(c) - n + 1, n))


def nested_sum(c: Column) -> Column:
    return F.aggregate(F.flatten(c), F.lit(0).cast("long"), lambda a, x: a + x)


def tool_call(c: Column) -> Column:
    """A call written as JSON, or with single quotes; null if it is neither."""
    one = lambda x: F.from_json(x, CALL)
    return F.coalesce(F.when(one(c)["name"].isNotNull(), one(c)), F.when(one(F.translate(c, "'", '"'))["name"].isNotNull(), one(F.translate(c, "'", '"'))))


def call_status(c: Column, name: str = "focus") -> Column:
    """ok, or the first thing that is wrong with a call."""
    call = tool_call(c)
    boxes = call["arguments"]["bbox_2d"]
    return F.when(call.isNull(), "not a call").when(call["name"] != name, "unknown tool").when(boxes.isNull(), "no boxes").when(~F.size(boxes).between(1, 3), "1 to 3 boxes").when(F.exists(boxes, lambda b: F.size(b) != 4), "4 coordinates").otherwise("ok")


def as_list(c: Column) -> Column:
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c))


#: What the check of arguments says.
NOT_AN_OBJECT, MISSING, WRONG_TYPE, NOT_LISTED, FINE = "Arguments must be a dictionary", "Missing required parameter: {}", "Parameter {} has incorrect type, should be {}", "Parameter {} has invalid value, should be one of: {}", "Parameters valid"
#: What schema_of_variant says of values of a JSON schema's type; truth values are numbers too.
TYPES = {"string": "STRING", "number": r"BIGINT|DOUBLE|FLOAT|DECIMAL\(.*|BOOLEAN", "integer": r"BIGINT|DECIMAL\(\d+,0\)|BOOLEAN", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "(OBJECT|STRUCT).*"}


def argument_fault(c: Column, schema: dict) -> Column:
    """What is wrong with arguments written as JSON, by a schema with required names, types and listed values: required names first, then the arguments in the order in which they stand."""
    value = F.try_parse_json(c)
    at = lambda name: F.try_variant_get(value, f'$["{name}"]', "variant")
    keys = F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    missing = [F.when(~F.array_contains(keys, name), MISSING.format(name)) for name in schema.get("required", [])]

    def check(name: str, rule: dict) -> Column:
        tests = []
        if kind := TYPES.get(rule.get("type")):
            tests.append(F.when(~F.schema_of_variant(at(name)).rlike(f"^({kind})$"), WRONG_TYPE.format(name, rule["type"])))
        if "enum" in rule:
            tests.append(F.when(~F.to_json(at(name)).isin([json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in rule["enum"]]), NOT_LISTED.format(name, ", ".join(map(str, rule["enum"])))))
        return F.coalesce(*tests, F.lit(None).cast("string"))

    found = [F.when(F.array_contains(keys, name), F.struct(F.array_position(keys, name).alias("at"), check(name, rule).alias("fault"))) for name, rule in schema.get("properties", {}).items()]
    wrong = F.array_min(F.filter(F.array(*found), lambda x: x["fault"].isNotNull()))["fault"] if found else F.lit(None).cast("string")
    return F.when(~F.coalesce(F.schema_of_variant(value).rlike("^(OBJECT|STRUCT)"), F.lit(False)), NOT_AN_OBJECT).otherwise(F.coalesce(*missing, wrong, F.lit(FINE)))


def bound(value: Column, body) -> Column:
    """body(value), where value is worked out once however often body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def _powers(logits: Column, body) -> Column:
    """body(powers of logits over the largest, that largest one), each worked out once."""
    return bound(F.array_max(logits), lambda top: bound(F.transform(logits, lambda x: F.exp(x - top)), lambda powers: body(powers, top)))


def entropy(logits: Column) -> Column:
    """Of the distribution that logits (doubles) give: log of the sum of powers less the mean logit; null without any."""
    weighted = lambda powers: _total(F.zip_with(powers, logits, lambda p, x: p * x))
    return F.when(F.size(logits) > 0, _powers(logits, lambda powers, top: bound(_total(powers), lambda z: top + F.log(z) - weighted(powers) / z)))


def top_k(logits: Column, k: int) -> Column:
    """logits below the k-th largest are minus infinity; ties with it stay."""
    least = F.get(F.sort_array(logits, asc=False), F.least(F.lit(k), F.size(logits)) - 1)
    return bound(least, lambda m: F.transform(logits, lambda x: F.when(x < m, F.lit(float("-inf"))).otherwise(x)))


def top_p(logits: Column, p: float) -> Column:
    """logits are minus infinity but for the largest ones that reach a share of p between them; ties with the smallest of them stay, and at least one does."""
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(None).cast("double").alias("least"))
    add = lambda s, v, z: F.when(s["mass"] < p, F.struct((s["mass"] + v["power"] / z).alias("mass"), v["x"].alias("least"))).otherwise(s)
    least = lambda order: _powers(order, lambda powers, _: bound(_total(powers), lambda z: F.aggregate(F.arrays_zip(order.alias("x"), powers.alias("power")), start, lambda s, v: add(s, v, z))["least"]))
    return bound(bound(F.sort_array(logits, asc=False), least), lambda m: F.transform(logits, lambda x: F.when(x < m, F.lit(float("-inf"))).otherwise(x)))


def reachable(board: Column, size: int) -> Column:
    """Whether a step-by-step way leads from S to G on a board, an array of size strings of S, G, F and H, past the H."""
    cells = F.split(F.array_join(board, ""), "", size * size)
    n = size * size

    def step(reach: Column, _: Column) -> Column:
        # a zero for every neighbour beyond the board
        near = lambda i: F.get(reach, i) | ((i % size > 0) & F.coalesce(F.get(reach, i - 1), F.lit(False))) | ((i % size < size - 1) & F.coalesce(F.get(reach, i + 1), F.lit(False))) | F.coalesce(F.get(reach, i - size), F.lit(False)) | F.coalesce(F.get(reach, i + size), F.lit(False))
        return F.transform(cells, lambda c, i: (c != "H") & near(i))

    reach = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.transform(cells, lambda c: c == "S"), step)
    return F.exists(F.arrays_zip(cells.alias("cell"), reach.alias("near")), lambda x: (x["cell"] == "G") & x["near"])


def union_maps(a: Column, b: Column) -> Column:
    """Both maps' entries; a key with different values fails."""
    differ = F.exists(F.map_keys(a), lambda k: F.map_contains_key(b, k) & ~F.element_at(a, k).eqNullSafe(F.element_at(b, k)))
    return F.when(differ, F.raise_error(F.lit("a key has two values")).cast("map<string,bigint>")).otherwise(F.map_concat(a, F.map_filter(b, lambda k, _: ~F.map_contains_key(a, k))))


def merged_inputs(a: Column, b: Column) -> Column:
    """Maps of arrays key by key, a's members before b's."""
    return F.map_zip_with(a, b, lambda _, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.concat(x, y)))
