"""JSON functions, over the events' properties and literal documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import json as J
from larkspur.plans import plan
from larkspur.sources.tables import Tables


@plan("""select event_id, json_extract_string(props, '$.k') as v, (props->'$.k')::varchar as e, null::varchar as q, json_exists(props, '$.k')::bigint as x, json_exists(props, '$.z')::bigint as nx, '["k"]' as ks, 1::bigint as len, 2::bigint as depth, 'OBJECT' as ty, 1::bigint as ok from events""")
def json_read(t: Tables) -> DataFrame:
    p = "props"
    return t.events.select(
        "event_id", J.json_value(p, "$.k").alias("v"), J.json_extract(p, "$.k").alias("e"), J.json_query(p, "$.k").alias("q"), J.json_exists(p, "$.k").alias("x"), J.json_exists(p, "$.z").alias("nx"), J.json_keys(p).alias("ks"), J.json_length(p).alias("len"), J.json_depth(p).alias("depth"),
        J.json_type(p).alias("ty"), J.json_valid(p).alias("ok"),
    )


_DOCS = [(1, '{"a": [1, 2, {"b": "x"}], "c": true}'), (2, "[10, 20, 30]"), (3, "not json"), (4, None), (5, '"text"')]


def _docs(t: Tables) -> DataFrame:
    return t.rows(_DOCS, "id int, j string")


@plan("""select * from (values (1, '[1, 2, {"b": "x"}]', '["x"]', '1', 1::bigint, 'OBJECT'), (2, null, null, null, 1, 'ARRAY'), (3, null, null, null, 0, null), (4, null, null, null, null, null), (5, null, null, null, 1, 'STRING')) v(id, a, deep, c, ok, ty)""")
def json_paths(t: Tables) -> DataFrame:
    return _docs(t).select("id", J.json_query("j", "$.a").alias("a"), J.json_extract("j", "$**.b").alias("deep"), J.json_value("j", "$.c").alias("c"), J.json_valid("j").alias("ok"), J.json_type("j").alias("ty"))


@plan("""select * from (values (1, '[2, {"b": "x"}]', '{"b": "x"}', '[1, 2]'), (2, null, null, null), (3, null, null, null), (4, null, null, null), (5, null, null, null)) v(id, r, l, two)""")
def json_array_paths(t: Tables) -> DataFrame:
    return _docs(t).select("id", J.json_extract("j", "$.a[1 to 2]").alias("r"), J.json_extract("j", "$.a[last]").alias("l"), J.json_extract("j", "$.a[0]", "$.a[-2]").alias("two"))


@plan("""select event_id, '{"k": ' || (props->>'$.k') || ', "n": 1}' as i, '{"k": 0}' as r, '{"k": 0, "n": "x"}' as s, '{}' as d, '{"k": ' || (props->>'$.k') || '}' as same from events""")
def json_edit(t: Tables) -> DataFrame:
    p = "props"
    return t.events.select("event_id", J.json_insert(p, ("$.k", 0), ("$.n", 1)).alias("i"), J.json_replace(p, ("$.k", 0), ("$.n", 1)).alias("r"), J.json_set(p, ("$.k", 0), ("$.n", "x")).alias("s"), J.json_remove(p, "$.k").alias("d"), J.json_remove(p, "$.zz").alias("same"))


@plan("""select * from (values (1, '{"a": [1, 2, {"b": "x"}, 9], "c": true}', '{"a": [1, 2, {"b": "x"}], "c": [true, 9]}', '{"a": [0, 1, 2, {"b": "x"}], "c": true}')) v(id, ap, sc, ins)""")
def json_array_edit(t: Tables) -> DataFrame:
    return _docs(t).where("id = 1").select("id", J.json_array_append("j", ("$.a", 9)).alias("ap"), J.json_array_append("j", ("$.c", 9)).alias("sc"), J.json_array_insert("j", ("$.a[0]", 0)).alias("ins"))


@plan("""select event_id, '{"k": [' || (props->>'$.k') || ', 5], "m": 1}' as m, '{"m": 1}' as p from events""")
def json_merge(t: Tables) -> DataFrame:
    return t.events.select("event_id", J.json_merge_preserve("props", F.lit('{"k": 5, "m": 1}')).alias("m"), J.json_merge_patch("props", F.lit('{"k": null, "m": 1}')).alias("p"))


@plan("""select event_id, case when props->>'$.k' = '7' then 1 else 0 end::bigint as c, case when props->>'$.k' = '7' then 1 else 0 end::bigint as o, case when props->>'$.k' = '7' then 1 else 0 end::bigint as e, 1::bigint as any_path, 0::bigint as all_paths from events""")
def json_compare(t: Tables) -> DataFrame:
    p = "props"
    return t.events.select("event_id", J.json_contains(p, "7", "$.k").alias("c"), J.json_overlaps(p, '{"k": 7, "z": 1}').alias("o"), J.json_equals(p, F.lit('{ "k":7 }')).alias("e"), J.json_contains_path(p, "one", "$.k", "$.z").alias("any_path"), J.json_contains_path(p, "all", "$.k", "$.z").alias("all_paths"))


@plan("""select '{"b":1,"a":[1,2]}' as c, '{"b": 1, "a": [1, 2]}' as l, '{"a":[1.0E0,2.0E0],"b":1.0E0}' as n, '{' || chr(10) || '  "b": 1' || chr(10) || '}' as d, '"$.b"' as s, '["$.a[0]", "$.b"]' as sa""")
def json_format_search(t: Tables) -> DataFrame:
    doc, texts = F.lit('{"b": 1, "a": [1,2]}'), F.lit('{"a": ["xy"], "b": "xz", "c": 5}')
    return t.constant(c=J.json_compact(doc), l=J.json_loose(doc), n=J.json_normalize(doc), d=J.json_detailed(F.lit('{"b":1}'), 2), s=J.json_search(texts, "one", "xz"), sa=J.json_search(texts, "all", "x%"))


@plan("""select s_suppkey, '[' || s_suppkey || ', "' || s_name || '", null]' as a, '{"id": ' || s_suppkey || ', "name": "' || s_name || '"}' as o, '"' || s_name || '"' as q, s_name as u from supplier""")
def json_build(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", J.json_array("s_suppkey", "s_name", F.lit(None).cast("string")).alias("a"), J.json_object(("id", "s_suppkey"), ("name", "s_name")).alias("o"), J.json_quote("s_name").alias("q"), J.json_unquote(J.json_quote("s_name")).alias("u"))
