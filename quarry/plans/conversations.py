"""Queries over conversations and the calls in them: checks with the first rule broken, arguments against a schema."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import arrays, text
from quarry.operators import conversations
from quarry.plans.catalog import query
from quarry.tables import table

#: Expressions that both engines read alike: conversations with calls, and what breaks each rule.
KIND = "((conv_id * 5 + turn) % 19)"
CALLS = "(turn = 0 or turn = 2 and conv_id % 3 = 0)"
ONE = "'[' || turn || ', 1, 2, ' || conv_id || ']'"
BOXES = f"case {KIND} when 0 then '' when 1 then {ONE} || ', ' || {ONE} || ', ' || {ONE} || ', ' || {ONE} when 2 then {ONE} || ', [9, 9, 9.5, 9]' else {ONE} end"
CALL = f"case {KIND} when 4 then '{{\"name\": \"focus\"}}' when 5 then 'no json' when 3 then '{{''name'': ''focus'', ''arguments'': {{''bboxes'': [' || {BOXES} || ']}}}}' else '{{\"name\": \"focus\", \"arguments\": {{\"bboxes\": [' || {BOXES} || ']}}}}' end"
ROLE = "case when conv_id % 11 = 3 and turn = 0 then role when conv_id % 11 = 5 and turn = 2 then 'judge' when conv_id % 11 = 6 and turn = 3 then 'gpt' when turn % 2 = 0 then 'gpt' else 'human' end"
TEXT = f"""case when turn % 2 = 0 then case when {KIND} = 6 then text else '<think>' || text || '</think>' end || case when {CALLS} then '<tool_call>' || {CALL} || case when {KIND} = 7 then '' else '</tool_call>' end else '<answer>' || role || case when {KIND} = 8 then '' else '</answer>' end end
 else case {KIND} when 9 then text when 10 then '<tool_response>' || text || '</tool_response>' when 11 then '<tool_response><image><image></tool_response>' when 3 then '<tool_response><image>' || text || '<image></tool_response>' else '<tool_response><image>' || text || '</tool_response>' end end"""
WANTED = f"{CALLS} and conv_id % 7 <> 3"
FAULTS_SQL = f"""with t as (select conv_id, turn, {ROLE} as role, {TEXT} as text from conversations),
 s as (select *, lead(role) over w as nr, lead(text) over w as nt, regexp_extract(text, '(?s)<tool_call>(.*?)</tool_call>', 1) as call, regexp_matches(text, '(?s)<tool_call>.*?</tool_call>') as calls from t window w as (partition by conv_id order by turn)),
 p as (select *, case when json_valid(call) then call when json_valid(replace(call, '''', '"')) then replace(call, '''', '"') end as j, regexp_extract(nt, '(?s)<tool_response>(.*?)</tool_response>', 1) as inner_, regexp_matches(nt, '(?s)<tool_response>.*?</tool_response>') as answered from s),
 b as (select *, try_cast(json_extract(j, '$.arguments.bboxes') as double[][]) as boxes, role = 'gpt' and contains(text, '<tool_call>') and contains(text, '</tool_call>') and calls as c from p),
 r as (select *, case when role = 'gpt' and not (contains(text, '<think>') and contains(text, '</think>')) then 'no thought' when role = 'gpt' and contains(text, '<tool_call>') and not contains(text, '</tool_call>') then 'open call' when c and boxes is null then 'call without boxes' when c and len(boxes) not between 1 and 3 then 'not 1 to 3 boxes'
  when c and (nr is null or nr <> 'human') then 'call without a response' when c and not answered then 'response without tags' when c and (length(inner_) - length(replace(inner_, '<image>', ''))) // 7 <> len(boxes) then 'not as many images as boxes' when role = 'gpt' and nr is null and not contains(text, '</answer>') then 'answer not closed'
  when role = 'human' and not (contains(text, '<tool_response>') and contains(text, '</tool_response>')) then 'response without tags' when role = 'human' and not contains(text, '<image>') then 'response without an image' when role not in ('gpt', 'human') then 'unknown role' end as r4 from b),
 g as (select conv_id, count(*) as n_turns, min(turn) filter (where turn = 0 and role <> 'gpt') as a1, min(turn) filter (where nr is null and role <> 'gpt') as a2, min(turn) filter (where nr is null and not contains(text, '<answer>')) as a3, min(turn) filter (where r4 is not null) as a4, arg_min(r4, turn) filter (where r4 is not null) as r4, min(turn) filter (where role = nr) as a5 from r group by 1),
 d as (select conv_id, box, sum(n) as n from (select conv_id, unnest(boxes) as box, -1 as n from r where role = 'gpt' and contains(text, '<tool_call>') union all select conv_id, [turn, 1, 2, conv_id + case when conv_id % 7 = 4 then 1 else 0 end]::double[], 1 from conversations where {WANTED} union all select conv_id, [9, 9, 9.5, 9]::double[], 1 from conversations where {WANTED} and {KIND} = 2) group by all having sum(n) <> 0),
 e as (select conv_id, sum(n) as more from d group by 1)
 select conv_id, n_turns, case when n_turns < 3 then null else coalesce(a1, a2, a3, a4, a5) end as at, case when n_turns < 3 then 'fewer than 3 turns' when a1 is not null then 'starts with another role' when a2 is not null then 'ends with another role' when a3 is not null then 'ends without an answer' when a4 is not null then r4 when a5 is not null then 'roles don''t take turns' when more <> 0 then 'another number of boxes' when more = 0 then 'other boxes' end as reason from g left join e using (conv_id)"""


@query(FAULTS_SQL)
def n4_conversation_faults(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    turns = c.selectExpr("conv_id", "turn", f"{ROLE} as role", f"{TEXT} as text")
    boxes = c.where(WANTED).selectExpr("conv_id", "array(turn, 1D, 2D, conv_id + case when conv_id % 7 = 4 then 1 else 0 end) as box").unionByName(c.where(f"{WANTED} and {KIND} = 2").selectExpr("conv_id", "array(9D, 9D, 9.5D, 9D) as box"))
    return conversations.conversation_faults(turns, boxes)


ARGUMENTS = """case event_id % 9 when 0 then '{"name": "' || event_type || '", "k": ' || user_id || '}' when 1 then props when 2 then '{"k": "' || event_type || '", "name": 5}' when 3 then '{"name": 5, "k": 1.5}' when 4 then '{"k": 1, "unit": "' || case when user_id % 2 = 0 then 'px' else event_type end || '", "name": "n"}'
 when 5 then '[' || props || ']' when 6 then 'x' || event_type when 7 then '{"name": "' || event_type || '", "k": true, "x": ' || value || ', "list": [1], "more": ' || props || ', "flag": ' || case when user_id % 3 = 0 then '0' else 'false' end || '}' else '{"list": ' || case when user_id % 2 = 0 then props else '[]' end || ', "k": 1e3, "name": null}' end"""
SCHEMA = {"required": ["name", "k"], "properties": {"name": {"type": "string"}, "k": {"type": "integer"}, "unit": {"type": "string", "enum": ["px", "pct"]}, "x": {"type": "number"}, "flag": {"type": "boolean"}, "list": {"type": "array"}, "more": {"type": "object"}}}
JSON_TYPES = {"string": "'VARCHAR'", "number": "'UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN'", "integer": "'UBIGINT', 'BIGINT', 'BOOLEAN'", "boolean": "'BOOLEAN'", "array": "'ARRAY'", "object": "'OBJECT'"}


def fault_sql(schema: dict) -> str:
    """SQL that walks the arguments in their order."""
    tests = []
    for name, rule in schema["properties"].items():
        tests.append(f"when k = '{name}' and json_type(j, '$.{name}') not in ({JSON_TYPES[rule['type']]}) then 'Parameter {name} has incorrect type, should be {rule['type']}'")
        if "enum" in rule:
            tests.append(f"when k = '{name}' and json_extract(j, '$.{name}')::varchar not in ({', '.join(chr(39) + json.dumps(x) + chr(39) for x in rule['enum'])}) then 'Parameter {name} has invalid value, should be one of: {', '.join(rule['enum'])}'")
    missing = " ".join(f"when not list_contains(json_keys(j), '{name}') then 'Missing required parameter: {name}'" for name in schema["required"])
    walked = f"list_filter(list_transform(json_keys(j), lambda k: case {' '.join(tests)} end), lambda x: x is not null)[1]"
    return f"case when not json_valid(j) or json_type(case when json_valid(j) then j end) <> 'OBJECT' then 'Arguments must be a dictionary' {missing} else coalesce({walked}, 'Parameters valid') end"


@query(f"with a as (select event_id, {ARGUMENTS} as j from events) select event_id, {fault_sql(SCHEMA)} as fault from a")
def n8_argument_faults(spark, d) -> DataFrame:
    return table(spark, d, "events").selectExpr("event_id", f"{ARGUMENTS} as j").select("event_id", arrays.argument_fault(F.col("j"), SCHEMA).alias("fault"))


TURN_TEXT = """case (conv_id * 3 + turn) % 7 when 0 then '<think>' || text || '</think><answer>' || role || '</answer>' when 1 then ' <think>' || role || '</think> <tool_call>' || text || '</tool_call> ' when 2 then text when 3 then '<think>' || text || '</think>' when 4 then '<think>a</think> b</think><answer>c</answer>' when 5 then '<think><think>' || text || '</think><answer>' || role || '</answer>' else '<think>x</think><answer></answer>' end"""


@query(f"""with t as (select conv_id // 3 as sample, conv_id % 3 as attempt, role, trim({TURN_TEXT}, ' ' || chr(9) || chr(10) || chr(13)) as m from conversations),
 p as (select *, string_split(m, '<think>')[-1] as r from t), q as (select *, trim(string_split(r, '</think>')[-1], ' ' || chr(9) || chr(10) || chr(13)) as a, len(string_split(r, '</think>')) as parts from p),
 s as (select sample, attempt, bool_and(starts_with(m, '<think>') and not ends_with(m, '</think>') and parts = 2 and (starts_with(a, '<answer>') and ends_with(a, '</answer>') or starts_with(a, '<tool_call>') and ends_with(a, '</tool_call>'))) filter (where role = 'assistant') as formed, coalesce(bool_or(starts_with(a, '<tool_call>') and ends_with(a, '</tool_call>')) filter (where role = 'assistant'), false) as called, count(*) filter (where role = 'assistant') as n from q group by 1, 2),
 g as (select *, (sample + attempt) % 4 > 0 as correct, sample % 9 = 5 as bad from s), w as (select *, count(*) filter (where correct) over (partition by sample) as n_right, count(*) filter (where correct and n < 2) over (partition by sample) - case when correct and n < 2 then 1 else 0 end as others from g)
 select sample, attempt, case when not correct or not coalesce(formed, true) or bad then false when n_right = 1 then true when others > 0 then not called else true end as good,
 case when not correct then 'non_correct_sample' when not coalesce(formed, true) then 'wrong_format' when bad then 'bad_bboxes' when n_right = 1 then 'only_correct_trajectory' when others > 0 then 'other correct trajectory no focus' else 'good_trajectory' end as reason from w""")
def m19_trajectory_verdicts(spark, d) -> DataFrame:
    """Three conversations are the attempts at a sample."""
    turns = table(spark, d, "conversations").selectExpr("conv_id div 3 as sample", "conv_id % 3 as attempt", f"struct(turn, role, {TURN_TEXT} as content) as t")
    attempts = turns.groupBy("sample", "attempt").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return conversations.trajectory_verdicts(attempts.withColumn("correct", F.when((F.col("sample") + F.col("attempt")) % 4 > 0, 1).otherwise(0)).withColumn("bad", F.col("sample") % 9 == 5))


COLD = """case when turn % 2 = 0 then text when (conv_id + turn) % 9 = 0 then '<think>' || text || '</think>' when (conv_id + turn) % 5 = 0 then '<think>t</think><answer>' || text || '</answer>' when (conv_id * 7 + turn) % 11 = 0 then '<think>' || text || '</think><grounding>' || role || '</grounding>'
 else '<think>' || text || '</think> <grounding>{"bbox_2d": [0.' || conv_id || ', 0.25, 0.75, 0.5], "source": "' || case when conv_id % 6 = 0 then 'observation_1' else 'original_image' end || '"}</grounding>' end"""
COLD_SQL = f"""with t as (select conv_id, turn, case when turn % 2 = 1 then 'gpt' else 'human' end as role, {COLD} as text from conversations), g as (select *, contains(text, '<grounding>') and contains(text, '</grounding>') as has, regexp_extract(text, '(?s)<grounding>(.*?)</grounding>', 1) as j from t),
 p as (select *, case when has and json_valid(j) then j end as js from g), f as (select conv_id, case when count(*) <= 3 then 'length' when bool_or(role = 'gpt' and not has and not (contains(text, '<answer>') and contains(text, '</answer>'))) then 'format' when bool_or(role = 'gpt' and has and json_extract_string(js, '$.source') is null) then 'grounding' when bool_or(role = 'gpt' and has and contains(json_extract_string(js, '$.source'), 'observation_')) then 'second-order grounding' end as reason from p group by 1)"""


@query(f"{COLD_SQL} select conv_id, reason from f")
def c13_cold_start_faults(spark, d) -> DataFrame:
    return cold(spark, d)[0]


@query(f"""{COLD_SQL}, b as (select p.*, json_extract(js, '$.bbox_2d')::double[] as b, 100 + conv_id % 1000 as w, 200 + conv_id % 77 as h from p join f using (conv_id) where reason is null) select conv_id, turn, role,
 md5(case when role = 'gpt' and has then '<think>' || regexp_extract(text, '(?s)<think>(.*?)</think>', 1) || '</think>' || chr(10) || '<tool_call>' || chr(10) || '{{"name": "focus", "arguments": {{"bboxes": [[' || trunc(b[1] * w)::bigint || ', ' || trunc(b[2] * h)::bigint || ', ' || trunc(b[3] * w)::bigint || ', ' || trunc(b[4] * h)::bigint || ']]}}}}' || chr(10) || '</tool_call>' else text end) as said from b""")
def c13_cold_start_turns(spark, d) -> DataFrame:
    return cold(spark, d)[1].select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("said"))


def cold(spark, d) -> tuple[DataFrame, DataFrame]:
    turns = table(spark, d, "conversations").selectExpr("conv_id", "turn", "case when turn % 2 = 1 then 'gpt' else 'human' end as role", f"{COLD} as text")
    sizes = table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", (100 + F.col("conv_id") % 1000).alias("width"), (200 + F.col("conv_id") % 77).alias("height"))
    return conversations.cold_start(turns, sizes)


THOUGHTS = "'[' || turn || ', 3, ' || conv_id || ', 40] <think>' || text || ' [ ' || turn || ' ,3,  ' || conv_id || ',40 ] and ' || turn || ', 9,' || conv_id || ' , 40 or (' || turn || ',3,' || conv_id || ',40)</think>' || text || '<think>' || turn || ',9,' || conv_id || ',40 [' || turn || ',9,' || conv_id || ',40]</think><tool_call>[[' || turn || ', 3, ' || conv_id || ', 40]]</tool_call><think>' || text"


def _rewritten(x: str, pairs) -> str:
    for old, new in pairs:
        p = " || '\\s*,\\s*' || ".join(old)
        t = " || ', ' || ".join(new)
        x = f"regexp_replace(regexp_replace({x}, '\\[\\s*' || {p} || '\\s*\\]', '[' || {t} || ']', 'g'), {p}, {t}, 'g')"
    return x


BOX_PAIRS = [(("turn", "'3'", "conv_id", "'40'"), ("turn * 2", "'7'", "(conv_id + 5)", "'44'")), (("turn", "'9'", "conv_id", "'40'"), ("'1'", "'2'", "'3'", "conv_id"))]


@query(f"with t as (select conv_id, turn, {THOUGHTS} as c from conversations), p as (select *, regexp_extract_all(c, '(?s)<think>(.*?)</think>', 1) as inner_, string_split_regex(c, '(?s)<think>.*?</think>') as outer_ from t) select conv_id, turn, md5(array_to_string(list_transform(outer_, lambda x, i: x || case when i <= len(inner_) then '<think>' || {_rewritten('inner_[i]', BOX_PAIRS)} || '</think>' else '' end), '')) as said from p")
def t55_coordinates_in_thoughts(spark, d) -> DataFrame:
    t, c = F.col("turn"), F.col("conv_id")
    box = lambda *v: F.array(*(F.lit(x).cast("long") if isinstance(x, int) else x for x in v))
    old, new = F.array(box(t, 3, c, 40), box(t, 9, c, 40)), F.array(box(t * 2, 7, c + 5, 44), box(1, 2, 3, c))
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{THOUGHTS} as c")
    return rows.select("conv_id", "turn", F.md5(text.rewritten_in_thoughts(F.col("c"), old, new).cast("binary")).alias("said"))


BOARD = "left(md5(o_orderkey || ''), 16)"


@query(f"""with recursive b as (select o_orderkey, list_transform(range(16), lambda i: case when i = 0 then 'S' when i = 15 then 'G' when substr({BOARD}, i::int + 1, 1) < '6' then 'H' else 'F' end) as cells from orders),
 r as (select o_orderkey, cells, 0 as place from b union select o_orderkey, cells, n from (select o_orderkey, cells, unnest([case when place % 4 > 0 then place - 1 end, case when place % 4 < 3 then place + 1 end, place - 4, place + 4]) as n from r) where n between 0 and 15 and cells[n + 1] <> 'H')
 select o_orderkey, bool_or(place = 15) as way from r group by 1""")
def m23_grid_validity(spark, d) -> DataFrame:
    """Boards of four by four, from the digits of a hash."""
    cell = lambda i: "S" if i == 0 else "G" if i == 15 else None
    cells = [F.lit(cell(i)) if cell(i) else F.when(F.substring("h", i + 1, 1) < "6", "H").otherwise("F") for i in range(16)]
    rows = table(spark, d, "orders").select("o_orderkey", F.left(F.md5(F.col("o_orderkey").cast("string").cast("binary")), F.lit(16)).alias("h"))
    return rows.select("o_orderkey", arrays.reachable(F.array(*(F.concat(*cells[i : i + 4]) for i in range(0, 16, 4))), 4).alias("way"))


LOGITS = "list_transform(embedding, lambda x: x::double * 8)"
MASS = "list_transform(o, lambda x: exp(x - o[1]))"


@query(f"""with e as (select vec_id, {LOGITS} as l from embeddings), s as (select *, list_reverse_sort(l) as o from e), m as (select *, {MASS} as w, list_sum({MASS}) as z from s),
 c as (select *, list_transform(range(1, len(o) + 1), lambda i: coalesce(list_sum(w[1:i - 1]), 0) / z < 0.7) as inside from m)
 select vec_id, round(o[1] + ln(z) - list_sum(list_transform(o, lambda x: exp(x - o[1]) * x)) / z, 6) as entropy, len(list_filter(l, lambda x: x >= o[5])) as in_top_k, len(list_filter(l, lambda x: x >= o[len(list_filter(inside, lambda b: b))])) as in_top_p from c""")
def g24_o11_entropy_and_filters(spark, d) -> DataFrame:
    """Embeddings as logits: entropy, and how many stay with the five largest and with a share of 0.7."""
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 8).alias("l"))
    left = lambda x: F.size(F.filter(x, lambda v: v > float("-inf"))).cast("long")
    return rows.select("vec_id", F.round(arrays.entropy(F.col("l")), 6).alias("entropy"), left(arrays.top_k(F.col("l"), 5)).alias("in_top_k"), left(arrays.top_p(F.col("l"), 0.7)).alias("in_top_p"))
