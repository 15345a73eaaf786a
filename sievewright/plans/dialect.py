"""The few spellings in which Spark SQL and DuckDB differ; plans are written once over them."""

from __future__ import annotations


class SparkSql:
    name = "spark"
    size = staticmethod(lambda x: f"size({x})")
    each = staticmethod(lambda x: f"explode({x})")
    like = staticmethod(lambda x, p: f"regexp_like({x}, r'{p}')")
    find = staticmethod(lambda x, p: f"regexp_extract_all({x}, r'{p}', 0)")
    sub = staticmethod(lambda x, p, r: f"regexp_replace({x}, r'{p}', '{r}')")
    pct = staticmethod(lambda x, p: f"percentile({x}, {p})")
    join = staticmethod(lambda x, s: f"array_join({x}, '{s}')")
    gather = staticmethod(lambda x, by: f"transform(sort_array(collect_list(struct({by} AS k, {x} AS v))), z -> z.v)")
    at = staticmethod(lambda x, i: f"try_element_at({x}, CAST({i} AS INT))")
    seq = staticmethod(lambda a, b: f"sequence({a}, {b})")
    split = staticmethod(lambda x, s: f"split({x}, '{s}')")
    half_even = staticmethod(lambda x: f"bround({x})")
    has = staticmethod(lambda x, v: f"array_contains({x}, {v})")
    both = staticmethod(lambda a, b: f"size(array_intersect({a}, {b}))")
    distinct = staticmethod(lambda x: f"array_distinct({x})")
    in_order = distinct
    keep = staticmethod(lambda x, v, p: f"filter({x}, {v} -> {p})")
    tiled = staticmethod(lambda x, n: f"slice(flatten(array_repeat({x}, {n})), 1, greatest(1, {n}))")
    map = staticmethod(lambda x, v, e: f"transform({x}, {v} -> {e})")
    slice = staticmethod(lambda x, a, n: f"slice({x}, {a}, {n})")
    sha = staticmethod(lambda x: f"sha2({x}, 256)")
    json = staticmethod(lambda x, k: f"get_json_object({x}, '$.{k}')")
    count_of = staticmethod(lambda x, p: f"regexp_count({x}, r'{p}')")
    edit = staticmethod(lambda a, b: f"levenshtein({a}, {b})")
    dot = staticmethod(lambda a, b: f"aggregate(zip_with({a}, {b}, (p, q) -> CAST(p AS DOUBLE) * CAST(q AS DOUBLE)), CAST(0 AS DOUBLE), (s, p) -> s + p)")
    array = staticmethod(lambda *x: f"array({', '.join(x)})")
    strings = staticmethod(lambda: "CAST(array() AS ARRAY<STRING>)")
    arg_max = staticmethod(lambda v, by: f"max_by({v}, {by})")
    arg_min = staticmethod(lambda v, by: f"min_by({v}, {by})")
    hour = staticmethod(lambda ts: f"date_trunc('hour', {ts})")
    epoch = staticmethod(lambda ts: f"unix_micros(CAST({ts} AS TIMESTAMP))")
    values = staticmethod(lambda x: f"collect_list({x})")
    chars = staticmethod(lambda x: f"length({x})")
    pair = staticmethod(lambda a, b: f"struct({a} AS a, {b} AS b)")


class DuckSql:
    name = "duckdb"
    size = staticmethod(lambda x: f"CAST(len({x}) AS INT)")
    each = staticmethod(lambda x: f"unnest({x})")
    like = staticmethod(lambda x, p: f"regexp_matches({x}, '{p}')")
    find = staticmethod(lambda x, p: f"regexp_extract_all({x}, '{p}')")
    sub = staticmethod(lambda x, p, r: f"regexp_replace({x}, '{p}', '{r}', 'g')")
    pct = staticmethod(lambda x, p: f"quantile_cont({x}, {p})")
    join = staticmethod(lambda x, s: f"array_to_string({x}, '{s}')")
    gather = staticmethod(lambda x, by: f"list({x} ORDER BY {by})")
    at = staticmethod(lambda x, i: f"({x})[CAST({i} AS INT)]")
    seq = staticmethod(lambda a, b: f"range({a}, {b} + 1)")
    split = staticmethod(lambda x, s: f"string_split({x}, '{s}')")
    half_even = staticmethod(lambda x: f"round_even({x}, 0)")
    has = staticmethod(lambda x, v: f"list_contains({x}, {v})")
    both = staticmethod(lambda a, b: f"CAST(len(list_intersect({a}, {b})) AS INT)")
    distinct = staticmethod(lambda x: f"list_distinct({x})")  # in no order
    in_order = staticmethod(lambda x: f"list_filter({x}, lambda v, i: list_position({x}, v) = i)")  # distinct entries of a short list as they first appear
    keep = staticmethod(lambda x, v, p: f"list_filter({x}, lambda {v}: {p})")
    tiled = staticmethod(lambda x, n: f"(flatten([{x} FOR _i IN range({n})]))[1:greatest(1, {n})]")
    map = staticmethod(lambda x, v, e: f"list_transform({x}, lambda {v}: {e})")
    slice = staticmethod(lambda x, a, n: f"({x})[{a}:{a} + {n} - 1]")
    sha = staticmethod(lambda x: f"sha256({x})")
    json = staticmethod(lambda x, k: f"json_extract_string({x}, '$.{k}')")
    count_of = staticmethod(lambda x, p: f"CAST(len(regexp_extract_all({x}, '{p}')) AS INT)")
    edit = staticmethod(lambda a, b: f"CAST(levenshtein({a}, {b}) AS INT)")
    dot = staticmethod(lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))")
    array = staticmethod(lambda *x: f"[{', '.join(x)}]")
    strings = staticmethod(lambda: "CAST([] AS VARCHAR[])")
    arg_max = staticmethod(lambda v, by: f"max_by({v}, {by})")
    arg_min = staticmethod(lambda v, by: f"min_by({v}, {by})")
    hour = staticmethod(lambda ts: f"date_trunc('hour', {ts})")
    epoch = staticmethod(lambda ts: f"epoch_us({ts})")
    values = staticmethod(lambda x: f"list({x})")
    chars = staticmethod(lambda x: f"length({x})")
    pair = staticmethod(lambda a, b: f"struct_pack(a := {a}, b := {b})")
