"""Queries over replies and questions: choices, formats, scores. The texts are whole turns and documents, wrapped in the tags that replies have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import arrays, text
from quarry.plans.catalog import query
from quarry.tables import table

NL, WS = "chr(10)", "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
START, END = text.REGION, "<|vision_end|>"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def many(x: str, mark: str) -> str:
    return f"((length({x}) - length(replace({x}, '{mark}', ''))) // {len(mark)})"


def banned(x: str) -> str:
    return "(" + " or ".join(f"contains({x}, '{m}')" for m in text.BANNED) + ")"


def valid(x: str) -> str:
    """SQL of a message's validity, as the rules are stated."""
    s = strip(x)
    plain = f"replace({s}, '<think>', '')"
    thought, rest = f"string_split({plain}, '</think>')[1]", f"string_split({plain}, '</think>')[2]"
    block = lambda t: f"({many(rest, f'<{t}>')} = 1 and {many(rest, f'</{t}>')} = 1 and {strip(f'string_split(replace({rest}, {chr(39)}<{t}>{chr(39)}, {chr(39)*2}), {chr(39)}</{t}>{chr(39)})[2]')} = '' and not {banned(f'string_split(replace({rest}, {chr(39)}<{t}>{chr(39)}, {chr(39)*2}), {chr(39)}</{t}>{chr(39)})[1]')})"
    return f"coalesce(starts_with({s}, '<think>') and {many(s, '</think>')} = 1 and not {banned(thought)} and (case when starts_with({strip(rest)}, '<answer>') then {block('answer')} when starts_with({strip(rest)}, '<tool_call>') then {block('tool_call')} else false end), false)"


MESSAGES = f"""m as (select conv_id, turn, text, case conv_id % 9 when 0 then '<think>' || {NL} || role || {NL} || '</think>' || {NL} || '<answer>' || {NL} || text || {NL} || '</answer>' || {NL}
 when 1 then '<think>' || role || '</think><tool_call>' || text || '</tool_call>' when 2 then '<think>' || text || '<answer>x</answer>' when 3 then '<think>a <box>[1,2,3,4]</box></think><answer>x</answer>'
 when 4 then '<think>t</think><answer>' || text || '</answer> more' when 5 then '<think>t</think><answer>a</answer><answer> ' || text || ' </answer>' when 6 then ' <think>t</think> ' || text when 7 then '<think>t</think><answer>a <thought</answer>'
 else '<think>t</think><answer>' || role || '</answer>' end as c from conversations)"""


def messages(spark, d) -> DataFrame:
    k, t, r = F.col("conv_id") % 9, F.col("text"), F.col("role")
    forms = (("<think>\n", r, "\n</think>\n<answer>\n", t, "\n</answer>\n"), ("<think>", r, "</think><tool_call>", t, "</tool_call>"), ("<think>", t, "<answer>x</answer>"), ("<think>a <box>[1,2,3,4]</box></think><answer>x</answer>",), ("<think>t</think><answer>", t, "</answer> more"), ("<think>t</think><answer>a</answer><answer> ", t, " </answer>"), (" <think>t</think> ", t), ("<think>t</think><answer>a <thought</answer>",))
    join = lambda parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    c = join(("<think>t</think><answer>", r, "</answer>"))
    for i, parts in reversed(list(enumerate(forms))):
        c = F.when(k == i, join(parts)).otherwise(c)
    return table(spark, d, "conversations").select("conv_id", "turn", "text", c.alias("c"))


@query(f"with {MESSAGES} select conv_id, turn, {strip('regexp_extract_all(c, ' + chr(39) + '(?s)<answer>(.*?)</answer>' + chr(39) + ', 1)[-1]')} as answer, {strip('regexp_extract_all(c, ' + chr(39) + '(?s)<answer>(.*?)</answer>' + chr(39) + ', 1)[1]')} as first_answer from m")
def t1_t2_extract_answers(spark, d) -> DataFrame:
    return messages(spark, d).select("conv_id", "turn", text.last_answer(F.col("c")).alias("answer"), text.first_answer(F.col("c")).alias("first_answer"))


@query(f"with {MESSAGES} select conv_id, turn, {valid('c')} as valid from m")
def t7_message_valid(spark, d) -> DataFrame:
    return messages(spark, d).select("conv_id", "turn", text.valid_message(F.col("c")).alias("valid"))


REPLY = f"""{MESSAGES}, p as (select a.conv_id, a.turn, a.text, a.c || '<|im_end|>' || {NL} || '<|im_start|>user' || {NL} || '<tool_response>' || repeat('{START}{END}', (a.turn % 18)::int) || '<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL} || '<think>u</think><answer>' || a.text || '</answer>' || case when a.turn % 5 = 4 then '' else '<|im_end|>' end as c, a.c as m1 from m a)"""


def replies(spark, d) -> DataFrame:
    c = F.concat("c", F.lit("<|im_end|>\n<|im_start|>user\n<tool_response>"), F.expr(f"repeat('{START}{END}', cast(turn % 18 as int))"), F.lit("<|im_end|>\n<|im_start|>assistant\n<think>u</think><answer>"), "text", F.lit("</answer>"), F.when(F.col("turn") % 5 == 4, "").otherwise("<|im_end|>"))
    return messages(spark, d).select("conv_id", "turn", "text", F.col("c").alias("m1"), c.alias("c"))


@query(f"with {REPLY} select conv_id, turn, {many('c', START)} as n_start, case when {many('c', START)} = {many('c', text.REGION_END)} then {many('c', START)} else 0 end as regions, case when turn % 18 > 0 then 1 else 0 end::bigint as responses, len(string_split(c, '<|im_end|>'))::bigint as messages, (len(string_split(c, '<|im_end|>')) - 1) / 2.0 as turns from p")
def t9_t10_t11_counts(spark, d) -> DataFrame:
    m = F.split("c", r"<\|im_end\|>", -1)
    return replies(spark, d).select("conv_id", "turn", text.occurrences(F.col("c"), START).alias("n_start"), text.focused_regions(F.col("c")).alias("regions"), text.tool_responses(F.col("c")).alias("responses"), F.size(m).cast("long").alias("messages"), text.turns_of(m).alias("turns"))


@query(f"with {REPLY} select conv_id, turn, case when turn % 5 = 4 then not {valid('m1')} else not {valid('m1')} or not {valid(chr(39) + '<think>u</think><answer>' + chr(39) + ' || text || ' + chr(39) + '</answer>' + chr(39))} end as fails from p")
def t8_history_fails(spark, d) -> DataFrame:
    return replies(spark, d).select("conv_id", "turn", text.history_fails(F.split("c", r"<\|im_end\|>", -1)).alias("fails"))


@query(f"with {REPLY}, a as (select *, {strip('text')} as answer, turn % 5 <> 4 as paired, {many('c', START)} as s, {many('c', text.REGION_END)} as e from p), b as (select *, case when s = e then s else 0 end as regions, lower(answer) = lower({strip('case when conv_id % 3 = 0 then text else ' + chr(39) + 'other' + chr(39) + ' end')}) as same, not {valid('m1')} or not {valid(chr(39) + '<think>u</think><answer>' + chr(39) + ' || text || ' + chr(39) + '</answer>' + chr(39))} as bad from a) select conv_id, turn, case when paired and length(answer) between 1 and 200 and regions <= 15 and same then 1.0 else 0.0 end as score, case when paired and not bad and length(answer) between 1 and 200 then 1.0 else 0.0 end as format_reward, case when paired then regions else 0 end as num_focused_regions from b")
def t12_main_score(spark, d) -> DataFrame:
    truth = F.array(F.when(F.col("conv_id") % 3 == 0, F.col("text")).otherwise("other"))
    return replies(spark, d).select("conv_id", "turn", text.main_score(F.col("c"), truth).alias("s")).select("conv_id", "turn", "s.score", "s.format_reward", "s.num_focused_regions")


PICKS = ("b", "The answer is: (C)", "answer is A, no: answer is (D)", "Choice is B", "so option is c", "B. foo", "(C) bar", "D) x", '"A": y', "foo (B).", "opt2", "nothing of that kind", "")
PICKED = "p as (select p_partkey, ([" + ", ".join("'" + x.replace("'", "''") + "'" for x in PICKS) + "])[p_partkey % 13 + 1] as c, ['opt1', 'opt2', 'opt3', 'opt4'] as options from part)"


def letter(starts) -> str:
    pattern = lambda x: x.replace("'", "''")
    tries = [f"regexp_extract_all(c, '{pattern(x)}', 1)[-1]" for x in text.NAMED] + [f"nullif(regexp_extract(c, '{pattern(x)}', 1), '')" for x in (*starts, r"\(([A-Z])\)\.?\s*$")]
    return f"case when c = '' then '' when length(c) = 1 then upper(c) else coalesce(upper(coalesce({', '.join(tries)})), case when list_position(options, c) > 0 then chr((64 + list_position(options, c))::int) end"


@query(f"with {PICKED} select p_partkey, {letter(text.STARTS)}) end as letter, {letter(text.STARTS_OF_JUDGE)}, c) end as judged, len(options) > 0 as is_choice from p")
def t3_t4_t5_choice(spark, d) -> DataFrame:
    c = F.element_at(F.array(*map(F.lit, PICKS)), (F.col("p_partkey") % 13 + 1).cast("int"))
    options = F.array(*(F.lit(f"opt{i}") for i in range(1, 5)))
    p = table(spark, d, "part").select("p_partkey", c.alias("c"), options.alias("o"))
    return p.select("p_partkey", text.choice(F.col("c"), F.col("o")).alias("letter"), text.choice(F.col("c"), F.col("o"), judge=True).alias("judged"), text.is_choice(F.lit("q"), F.col("o")).alias("is_choice"))


@query(f"select conv_id, turn, lower({strip('text')}) in (lower({strip('role')}), lower({strip('case when turn % 2 = 0 then ' + chr(39) + '  ' + chr(39) + ' || text else role end')})) as same from conversations")
def t6_exact_match(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", text.exact_match(F.col("text"), F.array("role", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("  "), "text")).otherwise(F.col("role")))).alias("same"))


@query("select o_orderkey, o_custkey::varchar as strict, (o_custkey + 7)::varchar as flexible, case when o_orderkey % 3 = 0 then 1.0 else 0.1 end as score from orders")
def t20_t21_gsm8k_two_marks(spark, d) -> DataFrame:
    """Two #### in a text: strict takes the first number, flexible the last."""
    c = F.concat(F.lit("so #### "), F.col("o_custkey").cast("string"), F.lit(", no: #### "), (F.col("o_custkey") + 7).cast("string"), F.lit(" . done."))
    got = F.regexp_replace(text.gsm8k_strict(c), r"\.$", "")
    truth = (F.col("o_custkey") + F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(1)).cast("string")
    return table(spark, d, "orders").select("o_orderkey", got.alias("strict"), text.gsm8k_flexible(c).alias("flexible"), text.gsm8k_score(got, truth, 0.1).alias("score"))


BOXES = r"b as (select o_orderkey, o_custkey, 'first \boxed{0} then \boxed{' || case o_orderkey % 4 when 0 then '\frac{' || o_custkey || '}{2}' when 1 then o_custkey || '/2' when 2 then '\frac' || (o_custkey % 10) || '2' else o_custkey || '\%' end || '} end' as c, case o_orderkey % 4 when 0 then '\frac{' || o_custkey || '}{2}' when 1 then o_custkey || '/2' when 2 then '\frac' || (o_custkey % 10) || '2' else o_custkey || '\%' end as inner_ from orders)"


@query(f"with {BOXES} select o_orderkey, inner_ as boxed, case o_orderkey % 4 when 0 then inner_ when 1 then '\\frac{{' || o_custkey || '}}{{2}}' when 2 then '\\frac{{' || (o_custkey % 10) || '}}{{2}}' else o_custkey::varchar end as plain, case when o_orderkey % 4 = 2 and o_custkey > 9 then 0.0 when o_orderkey % 4 = 3 then 0.0 else 1.0 end as score, 1 as strict from b")
def t22_t25_boxed_answers(spark, d) -> DataFrame:
    k, n = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    own = F.when(k == 0, F.concat(F.lit("\\frac{"), n, F.lit("}{2}"))).when(k == 1, F.concat(n, F.lit("/2"))).when(k == 2, F.concat(F.lit("\\frac"), (F.col("o_custkey") % 10).cast("string"), F.lit("2"))).otherwise(F.concat(n, F.lit("\\%")))
    b = table(spark, d, "orders").select("o_orderkey", "o_custkey", own.alias("own")).withColumn("c", F.concat(F.lit("first \\boxed{0} then \\boxed{"), "own", F.lit("} end")))
    got = text.unboxed(text.last_boxed(F.col("c")))
    truth = F.concat(F.lit("\\frac{"), F.col("o_custkey").cast("string"), F.lit("}{2}"))
    return b.select("o_orderkey", got.alias("boxed"), text.math_plain(got).alias("plain"), text.math_score(F.col("c"), truth).alias("score"), text.strict_box(F.col("c"), F.col("own")).alias("strict"))


@query("select doc_id, coalesce(regexp_extract_all(right(text || case when doc_id % 3 = 0 then '' else chr(10) || 'Answer: ' || doc_id || chr(10) || 'ANSWER :  x' || doc_id end, 300), '(?i)Answer\\s*:\\s*([^\\n]+)', 1)[-1], '[INVALID]') as pred from documents where text is not null")
def t27_named_answer(spark, d) -> DataFrame:
    k = F.col("doc_id")
    c = F.concat("text", F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("\nAnswer: "), k.cast("string"), F.lit("\nANSWER :  x"), k.cast("string"))))
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.named_answer(c).alias("pred"))


@query("select o_orderkey, case when o_orderkey % 3 = 2 then false else true end as same, case when o_orderkey % 2 = 0 then 1.0 else 0.0 end as format from orders")
def t32_t33_numbers_and_format(spark, d) -> DataFrame:
    n, k = F.col("o_custkey"), F.col("o_orderkey")
    b = F.when(k % 3 == 0, F.concat(n.cast("string"), F.lit("%"))).when(k % 3 == 1, (n / 100.0).cast("decimal(18,4)").cast("string")).otherwise((7 * n + 3).cast("string"))  # never n, a hundredth or a hundredfold of it
    c = F.when(k % 2 == 0, F.concat(F.lit("<think>a\nb</think> so \\boxed{"), n.cast("string"), F.lit("} \n"))).otherwise(F.lit("<think>a</think> \\boxed 3"))
    return table(spark, d, "orders").select("o_orderkey", text.same_number(n.cast("string"), b).alias("same"), text.geometry_format(c).alias("format"))


@query("select doc_id, case when doc_id % 4 = 3 then -1.0 else 0.0 end + case when doc_id % 2 = 0 then 1.0 else -1.0 end as score from documents")
def t17_t19_retrieval_score(spark, d) -> DataFrame:
    k = F.col("doc_id")
    docs = F.when(k % 2 == 0, "<|begin_of_query|>q<|end_of_query|><|begin_of_documents|>\n(1) x<|end_of_documents|>\n").otherwise("")
    c = F.concat(F.lit("t</think>"), docs, F.lit("<answer>"), F.when(k % 4 == 3, "True one two three four five six seven eight nine ten").otherwise("True"), F.lit("</answer>"))
    f1 = F.when(text.yes_no(text.retrieval_answer(c)) == text.yes_no(F.lit("False")), 1.0).otherwise(0.0)
    return table(spark, d, "documents").select("doc_id", (F.when(text.retrieval_fails(c), -1.0).otherwise(0.0) + F.when(F.contains(c, F.lit("<|begin_of_documents|>\n(1)")), 1.0).otherwise(-1.0) + 2.0 * f1).alias("score"))


ASKED = f"q as (select p_partkey, case p_partkey % 4 when 0 then 'What is ' || p_name || '? Options:' || {NL} || '(A) ' || p_brand || {NL} || '(B) ' || p_type when 1 then 'Name ' || p_name || ' choices: A: ' || p_brand || ', B: ' || p_type when 2 then p_name || {NL} || 'OPTIONS:' || {NL} || p_brand || {NL} || p_type else p_name end as c, case when p_partkey % 4 = 3 then [] else [p_brand, p_type] end as o, case p_partkey % 4 when 0 then 'What is ' || p_name || '?' when 1 then 'Name ' || p_name || '?' else p_name || '?' end as q from part)"


@query(f"with {ASKED} select p_partkey, q as question, array_to_string(o, '|') as options, case when len(o) > 0 then q || ' choices: A: ' || o[1] || ', B: ' || o[2] else q end as prompt, 'Question: ' || q || {NL} || 'Options: ' || {NL} || case when len(o) > 0 then 'A. ' || o[1] || {NL} || 'B. ' || o[2] else '' end as lines from q")
def t42_t48_t49_question_and_options(spark, d) -> DataFrame:
    k, n, b, t = F.col("p_partkey") % 4, F.col("p_name"), F.col("p_brand"), F.col("p_type")
    c = F.when(k == 0, F.concat(F.lit("What is "), n, F.lit("? Options:\n(A) "), b, F.lit("\n(B) "), t)).when(k == 1, F.concat(F.lit("Name "), n, F.lit(" choices: A: "), b, F.lit(", B: "), t)).when(k == 2, F.concat(n, F.lit("\nOPTIONS:\n"), b, F.lit("\n"), t)).otherwise(n)
    q = table(spark, d, "part").select("p_partkey", text.question_part(c).alias("question"), text.option_parts(c).alias("o"))
    return q.select("p_partkey", "question", F.array_join("o", "|").alias("options"), text.with_choices(F.col("question"), F.col("o")).alias("prompt"), text.question_and_options(F.col("question"), F.col("o")).alias("lines"))


@query("select conv_id, turn, 5::bigint as n, 'text,image,text,video,text' as kinds, text as first_text from conversations where text <> ''")
def t50_segments(spark, d) -> DataFrame:
    s = text.segments(F.concat("text", F.lit("<image> mid <video>end")))
    return table(spark, d, "conversations").where("text <> ''").select("conv_id", "turn", F.size(s).cast("long").alias("n"), F.array_join(F.transform(s, lambda x: x["type"]), ",").alias("kinds"), F.get(s, F.lit(0))["text"].alias("first_text"))


@query("select p_partkey, trim(p_name) || '. ' || p_brand || ' x' as clean from part")
def t51_clean_up(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.hellaswag(F.concat(F.trim("p_name"), F.lit(" [title]"), "p_brand", F.lit(" [x y] x "))).alias("clean"))


@query("select o_orderkey, array_to_string([o_custkey % 50, 0, o_custkey % 50 + 1 + o_orderkey % 7, 5], ',') as box from orders")
def t53_boxes_in_text(spark, d) -> DataFrame:
    x = (F.col("o_custkey") % 50).cast("string")
    c = F.concat(F.lit("see <box>["), x, F.lit(",0,"), (F.col("o_custkey") % 50 + 1 + F.col("o_orderkey") % 7).cast("string"), F.lit(",5]</box> not <box>[9,9,1,1]</box> nor <box>[1,2]</box>"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.get(text.boxes(c), F.lit(0)).cast("array<long>").cast("array<string>"), ",").alias("box"))


@query("select o_orderkey, array_to_string(list_transform(range(1, 1 + o_orderkey % 5), lambda i: o_custkey + i * 3), ',') as truth, case when o_orderkey % 5 = 0 then 1.0 else 0.5 end > 0.4 as some from orders")
def t56_sequence_truth(spark, d) -> DataFrame:
    truth = text.sequence_truth(F.col("o_custkey"), F.lit(3), F.col("o_orderkey") % 5)
    return table(spark, d, "orders").select("o_orderkey", truth.alias("truth"), (text.prefix_reward(truth, truth) > 0.4).alias("some"))


@query("select doc_id, case when doc_id % 3 = 0 then 1 else 0 end as verdict, quality::varchar as letter from labels")
def t46_t58_verdicts(spark, d) -> DataFrame:
    k = F.col("doc_id")
    c = F.when(k % 3 == 0, "1 and 2. Judgement: 1").when(k % 3 == 1, "1. Judgement: 0").otherwise("1, no verdict")
    return table(spark, d, "labels").select("doc_id", text.verdict(c).alias("verdict"), F.regexp_extract(F.concat(F.lit("it is "), F.col("quality").cast("string"), F.lit(" or A")), r"\b([01])\b", 1).alias("letter"))


CALLS = """c as (select event_id, case event_id % 6 when 0 then '{"name": "focus", "arguments": {"bbox_2d": [[1, 2, 3, ' || event_id || ']]}}' when 1 then '{''name'': ''focus'', ''arguments'': {''bbox_2d'': [[1, 2, 3, 4], [5, 6, 7, ' || event_id || ']]}}' when 2 then '{"name": "zoom"}' when 3 then 'no json' when 4 then '{"name": "focus", "arguments": {"bbox_2d": [[1, 2]]}}' else '{"name": "focus", "arguments": {}}' end as c from events)"""


@query(f"with {CALLS} select event_id, (['ok', 'ok', 'unknown tool', 'not a call', '4 coordinates', 'no boxes'])[event_id % 6 + 1] as status, case event_id % 6 when 0 then event_id * 1.0 when 1 then event_id * 1.0 end as last, case event_id % 6 when 0 then 1 when 1 then 2 when 4 then 1 end as boxes from c")
def n1_n5_tool_calls(spark, d) -> DataFrame:
    k, e = F.col("event_id") % 6, F.col("event_id").cast("string")
    c = F.when(k == 0, F.concat(F.lit('{"name": "focus", "arguments": {"bbox_2d": [[1, 2, 3, '), e, F.lit("]]}}"))).when(k == 1, F.concat(F.lit("{'name': 'focus', 'arguments': {'bbox_2d': [[1, 2, 3, 4], [5, 6, 7, "), e, F.lit("]]}}"))).when(k == 2, '{"name": "zoom"}').when(k == 3, "no json").when(k == 4, '{"name": "focus", "arguments": {"bbox_2d": [[1, 2]]}}').otherwise('{"name": "focus", "arguments": {}}')
    rows = table(spark, d, "events").select("event_id", c.alias("c"))
    boxes = arrays.tool_call(F.col("c"))["arguments"]["bbox_2d"]
    return rows.select("event_id", arrays.call_status(F.col("c")).alias("status"), F.get(F.try_element_at(boxes, F.lit(-1)), F.lit(3)).alias("last"), F.when(boxes.isNotNull(), F.size(boxes)).alias("boxes"))


@query("select event_id, '{\"name\":\"focus\",\"arguments\":{\"k\":' || event_id || '}}' as call from events")
def n3_serialised_call(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(F.lit("focus").alias("name"), F.struct(F.col("event_id").alias("k")).alias("arguments"))).alias("call"))


@query("select o_orderkey, '1,' || o_custkey || ',0,0' as right_pad, '0,0,1,' || o_custkey as left_pad, o_custkey::varchar as stripped, '1' as cut, o_custkey + 3 as total, o_orderstatus as listed from orders")
def n6_n9_n12_n15_arrays(spark, d) -> DataFrame:
    a, z = F.array(F.lit(1).cast("long"), "o_custkey"), F.lit(0).cast("long")
    mask = F.array(F.lit(0), F.lit(0), F.lit(0), F.lit(1))
    told = lambda c, name: F.array_join(c.cast("array<string>"), ",").alias(name)
    return table(spark, d, "orders").select("o_orderkey", told(arrays.padded(a, 4, z), "right_pad"), told(arrays.padded(a, 4, z, left=True), "left_pad"), told(arrays.unpadded(arrays.padded(a, 4, z, left=True), mask), "stripped"), told(arrays.fitted(a, 1, z, truncation="right"), "cut"), arrays.nested_sum(F.array(a, F.array(F.lit(2).cast("long")))).alias("total"), told(arrays.as_list(F.col("o_orderstatus")), "listed"))


@query(f"with {PICKED}, q as (select *, p_partkey // 13 % 5 as k from p), t as (select *, case when k < 4 then (['B', 'C', 'opt4', 'D'])[k + 1] else p_partkey % 13 || '' end as truth, case when k < 4 then {letter(text.STARTS)}) end end as picked from q) select p_partkey, case when length(c) > 0 and k < 4 then coalesce(picked = case truth when 'opt4' then 'D' else truth end, false)::int::double else (length(c) > 0 and lower(c) = lower(truth))::int::double end as acc_reward, case when length(c) > 0 then 1.0 else 0.0 end as format_reward from t")
def t12_score_with_options(spark, d) -> DataFrame:
    """Replies with a letter for an answer, to questions with options and a fifth without."""
    k, r = F.floor(F.col("p_partkey") / 13) % 5, (F.col("p_partkey") % 13).cast("int")
    c = F.element_at(F.array(*map(F.lit, PICKS)), r + 1)
    truth = F.when(k < 4, F.get(F.array(*map(F.lit, ("B", "C", "opt4", "D"))), k.cast("int"))).otherwise(r.cast("string"))
    options = F.when(k < 4, F.array(*(F.lit(f"opt{i}") for i in range(1, 5)))).otherwise(F.array().cast("array<string>"))
    reply = F.concat(F.lit("<think>t</think><answer>"), c, F.lit("</answer><|im_end|>"))
    rows = table(spark, d, "part").select("p_partkey", text.main_score(reply, F.array(truth), options).alias("s"))
    return rows.select("p_partkey", "s.acc_reward", "s.format_reward")


TOLD = "case p_partkey % 7 when 0 then 'True' when 1 then 'no' when 2 then 'No, wait' when 3 then p_name when 4 then 'The ' || p_name || '! ' || p_name when 5 then 'noanswer' else p_type || ' an ' || p_brand end"
TRUE = "case p_partkey % 5 when 0 then 'yes' when 1 then 'No.' when 2 then p_name || ' a_' || p_brand when 3 then 'False' else p_type end"


def f1_sql(p: str, t: str) -> str:
    """SQL of the F1 of two texts, as tables w (normalised) and f1 over a table with both."""
    mapped = lambda c: f"case {c} when 'True' then 'yes' when 'False' then 'no' else {c} end"
    clean = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(lower(replace({mapped(c)}, '_', ' ')), '[!-/:-@\\[-`{{-~]', ' ', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"""w as (select *, {clean(p)} as pn, {clean(t)} as tn from src), l as (select *, list_filter(string_split(pn, ' '), lambda x: x <> '') as pl, list_filter(string_split(tn, ' '), lambda x: x <> '') as tl from w),
 m as (select *, coalesce(list_sum(list_transform(list_distinct(pl), lambda x: least(len(list_filter(pl, lambda y: y = x)), len(list_filter(tl, lambda y: y = x))))), 0) as n from l),
 f1 as (select *, case when (pn in ('yes', 'no', 'noanswer') or tn in ('yes', 'no', 'noanswer')) and pn <> tn then 0.0 when n = 0 then 0.0 else 2.0 * n / (len(pl) + len(tl)) end as f from m)"""


@query(f"with src as (select p_partkey, {TOLD} as told, {TRUE} as truth from part), {f1_sql('told', 'truth')} select p_partkey, round(f, 6) as f1 from f1")
def t18_f1_of_answers(spark, d) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{TOLD} as told", f"{TRUE} as truth")
    return rows.select("p_partkey", F.round(text.token_f1(F.col("told"), F.col("truth")), 6).alias("f1"))


@query(f"with src as (select p_partkey, {TOLD} as told, {TRUE} as truth from part), {f1_sql('told', 'truth')} select p_partkey, round(2 * f + case when p_partkey % 3 = 0 then 1 else -1 end + case when p_partkey % 4 = 1 or len(list_filter(string_split_regex(trim(told), '\\s+'), lambda x: x <> '')) > 10 then -1 else 0 end, 6) as score from f1")
def t19_retrieval_scores(spark, d) -> DataFrame:
    """Twice the F1, one more with documents and one less without, one less for a format error (here a second answer)."""
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{TOLD} as told", f"{TRUE} as truth")
    docs = F.when(F.col("p_partkey") % 3 == 0, "<|begin_of_query|>q<|end_of_query|><|begin_of_documents|>\n(1) x<|end_of_documents|>\n").otherwise("")
    c = F.concat(F.lit("t</think>"), docs, F.when(F.col("p_partkey") % 4 == 1, "<answer>no</answer>").otherwise(""), F.lit("<answer> "), "told", F.lit(" </answer>"))
    return rows.select("p_partkey", F.round(text.retrieval_score(c, F.col("truth")), 6).alias("score"))


PAIRS = """case o_orderkey % 14 when 0 then o_custkey || 'e3' when 1 then o_custkey || ',000' when 2 then '$' || o_custkey when 3 then '[' || o_custkey || ', 2.0]' when 4 then '(' || o_custkey || ',2)' when 5 then 'Interval.open(1, ' || o_custkey || ')' when 6 then o_custkey || '_2' when 7 then 'x+' || o_custkey when 8 then '1234567' || o_custkey || '1' when 9 then '0' when 10 then o_custkey || '%' when 11 then o_orderstatus || ', ' || o_custkey when 12 then '' else '{' || o_custkey || '}' end"""
TRUTHS = """case o_orderkey % 14 when 0 then o_custkey || '000' when 1 then (o_custkey * 1000 + o_orderkey % 2) || '.0' when 2 then (o_custkey + o_orderkey % 3) || '' when 3 then '[' || o_custkey || '.0,' || (1 + o_orderkey % 4) || ']' when 4 then '[' || o_custkey || ',2]' when 5 then '(1,' || o_custkey || '.00)' when 6 then o_custkey || '' when 7 then 'x + ' || o_custkey when 8 then '1234567' || o_custkey || (1 + o_orderkey % 5) || '.0' when 9 then '0.00005' when 10 then (o_custkey + o_orderkey % 2) / 100 || '' when 11 then lower(o_orderstatus) || ',' || o_custkey || '.0' when 12 then '0' else o_custkey || '' end"""


@query(f"""with s as (select o_orderkey, o_orderkey % 14 as k, o_custkey as n, {TRUTHS} as truth from orders) select o_orderkey, case k when 0 then true when 1 then abs(n * 1000 - truth::double) <= 1e-4 * truth::double or false when 2 then n = truth::bigint or abs(n - truth::double) <= 1e-4 * truth::double or abs(n - truth::double * 100) <= 1e-4 * greatest(n, truth::double * 100) or abs(n - truth::double / 100) <= 1e-4 * n when 3 then o_orderkey % 4 = 1 when 4 then false
 when 5 then true when 6 then true when 7 then true when 8 then abs(('1234567' || n || '1')::double - truth::double) <= 1e-4 * truth::double when 9 then false when 10 then abs(n - truth::double) <= 1e-4 * n or abs(n - truth::double * 100) <= 1e-4 * greatest(n, truth::double * 100) or abs(n - truth::double / 100) <= 1e-4 * n when 11 then true when 12 then false else true end as same from s""")
def t32_math_equal(spark, d) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("o_orderkey", f"{PAIRS} as told", f"{TRUTHS} as truth")
    return rows.select("o_orderkey", text.math_equal(F.col("told"), F.col("truth")).alias("same"))


FINAL = r"""case o_orderkey % 9 when 0 then 'x = ' || o_custkey || ',000 dollars' when 1 then '$\frac' || (o_custkey % 10) || '2$ and more' when 2 then '\boxed{\text{' || o_orderstatus || '}} degrees' when 3 then 'an ' || o_custkey || '\sqrt3' when 4 then '\textbf{' || o_orderpriority || '} km' when 5 then 'a ' || o_custkey || ' .$' when 6 then '1{,}' || o_custkey || '^\circ' when 7 then ',' || o_custkey || ',' else o_orderpriority end"""
MEANT = r"""case o_orderkey % 9 when 0 then o_custkey || '000' when 1 then '\frac{' || (o_custkey % 10) || '}{' || (1 + o_orderkey % 2) || '}' when 2 then o_orderstatus when 3 then o_custkey || '\sqrt{3}' when 4 then o_orderpriority || '  ' when 5 then (o_custkey + o_orderkey % 2) || '' when 6 then '1' || o_custkey when 7 then o_custkey || ' meters' else lower(o_orderpriority) end"""
REPLIED = f"o_orderpriority || {NL} || 'Answer: no' || {NL} || case when o_orderkey % 11 = 0 then 'none' else 'ANSWER :' || {FINAL} end"


def final_sql(c: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''").replace("\n", f"' || {NL} || '") + "'"
    x = f"string_split({c}, '=')[-1]"
    for old, new in (*text.FINAL_CUTS, *((x, "") for x in text.FINAL_REMOVED)):
        x = f"replace({x}, {quoted(old)}, {quoted(new)})"
    for pattern, left, group, right in text.FINAL_FORMS:
        x = f"regexp_replace({x}, {quoted(pattern)}, '{left.replace(chr(92), '')}\\{group}{right.replace(chr(92), '')}', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '(frac)([^{{])(.)', 'frac{{\\2}}{{\\3}}', 'g'), '(sqrt)([^{{])', 'sqrt{{\\2}}', 'g')"
    x = f"replace({x}, '$', '')"
    return f"(list_transform([{x}], lambda v: trim(case when regexp_matches(v, '^[0-9,]*[0-9][0-9,]*$') then replace(v, ',', '') else v end)))[1]"


@query(f"with r as (select o_orderkey, right({REPLIED}, 300) as c, {MEANT} as truth from orders), p as (select *, coalesce(regexp_extract_all(c, '(?i)Answer\\s*:\\s*([^\\n]+)', 1)[-1], '[INVALID]') as a from r), n as (select o_orderkey, {final_sql('a')} as pred, {final_sql('truth')} as want from p) select o_orderkey, case when pred = want then 1.0 else -1.0 end as score, pred = want as acc, pred from n")
def t26_t29_final_answers(spark, d) -> DataFrame:
    twice = lambda e: e.replace("\\", "\\\\")
    rows = table(spark, d, "orders").selectExpr("o_orderkey", f"{twice(REPLIED)} as c", f"{twice(MEANT)} as truth")
    return rows.select("o_orderkey", text.final_score(F.col("c"), F.col("truth")).alias("s")).select("o_orderkey", "s.score", "s.acc", "s.pred")


@query("select o_orderkey, round(case when o_orderkey % 5 in (0, 1) or o_orderkey % 5 = 2 and o_custkey % 2 = 0 then 0.9 else 0.0 end + case when o_orderkey % 5 in (0, 2, 3) then 0.1 else 0.0 end, 6) as score from orders")
def t33_geometry_score(spark, d) -> DataFrame:
    k, n = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    box = lambda x: F.concat(F.lit("\\boxed{"), x, F.lit("}"))
    thought = F.lit("<think>a\nb</think> so ")
    c = F.when(k == 0, F.concat(thought, box(F.concat(n, F.lit(".0"))))).when(k == 1, F.concat(F.lit("so "), box(F.concat(n, F.lit("0e-1"))))).when(k == 2, F.concat(thought, box(F.concat(F.lit("1000"), (F.col("o_custkey") - F.col("o_custkey") % 2).cast("string"))))).when(k == 3, F.concat(thought, box(F.lit("none")))).otherwise(F.concat(F.lit("no box "), n))
    truth = F.when(k == 2, F.concat(F.lit("1000"), F.when(F.col("o_custkey") % 2 == 0, n).otherwise("x"))).otherwise(n)
    return table(spark, d, "orders").select("o_orderkey", F.round(text.geometry_score(c, truth), 6).alias("score"))
