"""Answer extraction and scoring of texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.arrays import bound

#: White space that is cut off at the ends of texts.
WHITE = " \t\n\r\x0b\x0c"
#: What a thought, an answer or a call must not hold.
BANNED = ("<tool_call>", "</tool_call>", "<box>", "</box>", "<th", "</th", "<|im_start|>")
#: Ways to name a choice within a reply (the last place counts), and at its start.
NAMED = (r"(?i)answer\s*is\s*:?\s*\(?([A-Z])\)?", r"(?i)the\s*answer\s*is\s*\(?([A-Z])\)?", r"(?i)answer\s*:\s*\(?([A-Z])\)?", r"(?i)choice\s*is\s*\(?([A-Z])\)?", r"(?i)option\s*is\s*\(?([A-Z])\)?", r"(?i)correct\s*option\s*is\s*\(?([A-Z])\)?")
STARTS = (r"""^['"]?([A-Z])['"]?\.""", r"""^['"]?\(([A-Z])\)""", r"""^['"]?([A-Z])\)""", r"""^['"]?([A-Z])['"]?:""")
STARTS_OF_JUDGE = (r"^([A-Z])\.", r"^\(([A-Z])\)", r"^([A-Z])\)")
REGION, REGION_END = "<|vision_start|><|image_pad|>", "<|image_pad|><|vision_end|>"


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def last_answer(c: Column) -> Column:
    """What the last <answer> block holds, without white space at its ends; null without one."""
    return stripped(F.try_element_at(F.regexp_extract_all(c, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1)), F.lit(-1)))


def first_answer(c: Column) -> Column:
    """What the first <answer> block holds; null without one."""
    return stripped(F.get(F.regexp_extract_all(c, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1)), F.lit(0)))


def occurrences(c: Column, mark: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))) / len(mark)).cast("long")


def after_thought(c: Column) -> Column:
    return stripped(F.element_at(F.split(c, "</think>", -1), -1))


def holds_banned(c: Column) -> Column:
    out = F.lit(False)
    for mark in BANNED:
        out = out | F.contains(c, F.lit(mark))
    return out


def valid_message(c: Column) -> Column:
    """A thought, then one answer or one tool call with nothing after it, and no banned tag inside either."""
    s = stripped(c)
    plain = F.replace(s, F.lit("<think>"), F.lit(""))
    thought, rest = F.get(F.split(plain, "</think>", -1), F.lit(0)), F.get(F.split(plain, "</think>", -1), F.lit(1))

    def block(tag: str) -> Column:
        parts = F.split(F.replace(rest, F.lit(f"<{tag}>"), F.lit("")), f"</{tag}>", -1)
        once = (occurrences(rest, f"<{tag}>") == 1) & (occurrences(rest, f"</{tag}>") == 1)
        return once & (stripped(F.get(parts, F.lit(1))) == "") & ~holds_banned(F.get(parts, F.lit(0)))

    kind = F.when(stripped(rest).startswith("<answer>"), block("answer")).when(stripped(rest).startswith("<tool_call>"), block("tool_call")).otherwise(F.lit(False))
    return F.coalesce(s.startswith("<think>") & (occurrences(s, "</think>") == 1) & ~holds_banned(thought) & kind, F.lit(False))


def history_fails(messages: Column) -> Column:
    """Whether one of the assistant's messages, every other one of an array but the last of all, isn't valid."""
    own = F.transform(messages, lambda m, i: F.when((i % 2 == 0) & (i < F.size(messages) - 1), ~valid_message(F.when(i == 0, m).otherwise(F.regexp_replace(m, r"^\n<\|im_start\|>assistant\n", "")))).otherwise(F.lit(False)))
    return F.exists(own, lambda x: x)


def focused_regions(c: Column) -> Column:
    """Regions looked at; 0 if their starts and ends aren't as many."""
    n = occurrences(c, REGION)
    return F.when(n == occurrences(c, REGION_END), n).otherwise(F.lit(0).cast("long"))


def tool_responses(c: Column) -> Column:
    return occurrences(c, "<|im_start|>user\n<tool_response><|vision_start|><|image_pad|>")


def turns_of(messages: Column) -> Column:
    """Tries that a history shows: 0 if it is empty or of over ten messages, 5 at ten."""
    n = F.size(messages)
    return F.when((n > 10) | (n < 1), 0.0).when(n == 10, 5.0).otherwise((n - 1) / 2.0)


def choice(pred: Column, options: Column, judge: bool = False) -> Column:
    """The letter that a reply chooses: '' if it is empty; null if there is none, the judge then takes the reply itself."""
    p = stripped(pred)
    last = lambda pattern: F.try_element_at(F.regexp_extract_all(p, F.lit(pattern), F.lit(1)), F.lit(-1))
    one = lambda pattern: F.nullif(F.regexp_extract(p, pattern, 1), F.lit(""))
    at = F.array_position(options, p)
    named = F.upper(F.coalesce(*(last(x) for x in NAMED), *(one(x) for x in (STARTS_OF_JUDGE if judge else STARTS)), one(r"\(([A-Z])\)\.?\s*$")))
    own = F.when(at > 0, F.chr(at + 64))
    return F.when(F.coalesce(pred, F.lit("")) == "", F.lit("")).when(p.rlike(r"^\p{L}$"), F.upper(p)).otherwise(F.coalesce(named, own, *([p] if judge else [])))


def is_choice(question: Column, options: Column) -> Column:
    return (question == "Recognize the question and options in the image and answer it.") | (F.coalesce(F.size(options), F.lit(0)) > 0)


def exact_match(pred: Column, answers: Column) -> Column:
    return F.array_contains(F.transform(answers, lambda a: F.lower(stripped(a))), F.lower(stripped(pred)))


def main_score(pred: Column, answers: Column, options: Column | None = None) -> Column:
    """score, acc_reward, format_reward and num_focused_regions of a recorded reply; zeros if its messages don't come in pairs.

    A question with options is right if the letters of the answer and of the first of
    answers agree, any other by exact match.
    """
    messages = F.split(pred, r"<\|im_end\|>", -1)
    paired = (F.size(messages) % 2 == 0) & (F.element_at(messages, -1) == "")
    answer, regions = F.coalesce(last_answer(after_thought(pred)), F.lit("")), focused_regions(pred)
    same = exact_match(answer, answers)
    if options is not None:
        letters = F.coalesce(choice(answer, options) == choice(F.get(answers, F.lit(0)), options), F.lit(False))
        same = F.when(F.size(options) > 0, letters).otherwise(same)
    right = (F.length(answer) > 0) & (F.length(answer) <= 200) & (regions <= 15) & same
    fails = history_fails(messages) | (F.length(answer) == 0) | (F.length(answer) > 200)
    one = lambda c: F.when(paired & c, 1.0).otherwise(0.0)
    return F.struct(one(right).alias("score"), one(right).alias("acc_reward"), one(~fails).alias("format_reward"), F.when(paired, regions).otherwise(F.lit(0).cast("long")).alias("num_focused_regions"))


def normalised(c: Column) -> Column:
    """_ to space, lower case, punctuation to space, no articles, single spaces."""
    x = F.regexp_replace(F.lower(F.replace(c, F.lit("_"), F.lit(" "))), r"[!-/:-@\[-`{-~]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?U)\b(a|an|the)\b", " "), r"\s+", " "))


def token_f1(pred: Column, truth: Column) -> Column:
    """Harmonic mean of precision and recall of normalised words, repeats counted; 0 when none is shared. True and False are yes and no, and a yes, no or noanswer is right as a whole or not at all."""

    def score(x: Column) -> Column:
        p, t = (F.filter(F.split(x[c], " "), lambda w: w != "") for c in ("p", "t"))
        many = lambda a, w: F.size(F.filter(a, lambda v: v == w))
        same = F.aggregate(F.array_distinct(p), F.lit(0), lambda n, w: n + F.least(many(p, w), many(t, w)))
        whole = (x["p"].isin("yes", "no", "noanswer") | x["t"].isin("yes", "no", "noanswer")) & (x["p"] != x["t"])
        return F.when(whole, 0.0).otherwise(bound(same, lambda n: F.when(n == 0, 0.0).otherwise(2.0 * n / (F.size(p) + F.size(t)))))

    return bound(F.struct(normalised(yes_no(pred)).alias("p"), normalised(yes_no(truth)).alias("t")), score)


def gsm8k_strict(c: Column) -> Column:
    """The number after the first ####, without commas and $; null without one."""
    return F.translate(F.get(F.regexp_extract_all(c, F.lit(r"#### (\-?[0-9\.\,]+)"), F.lit(1)), F.lit(0)), ",$", "")


def gsm8k_flexible(c: Column) -> Column:
    """The last number of a text that isn't a lone point, else its first; null without one."""
    found = F.regexp_extract_all(c, F.lit(r"(\-?[0-9\.\,]+)"), F.lit(1))
    return F.coalesce(F.try_element_at(F.filter(found, lambda x: ~x.isin("", ".")), F.lit(-1)), F.get(found, F.lit(0)))


def gsm8k_score(got: Column, truth: Column, format_score: float = 0.0, score: float = 1.0) -> Column:
    return F.when(got.isNull(), 0.0).when(got == truth, score).otherwise(format_score)


def yes_no(c: Column) -> Column:
    return F.when(c == "True", "yes").when(c == "False", "no").otherwise(c)


def last_boxed(c: Column) -> Column:
    r"""The last \boxed or, without one, \fbox with its balanced braces; null if they don't close. '\boxed ' goes on to the next $."""
    from_last = lambda mark: F.when(F.contains(c, F.lit(mark)), F.concat(F.lit(mark), F.element_at(F.split(c, "\\Q" + mark + "\\E", -1), -1)))
    first = F.struct(F.lit(0).alias("open"), F.lit(0).alias("i"), F.lit(0).alias("end"))

    def step(a: Column, x: Column) -> Column:
        now = a["open"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)
        return F.struct(now.alias("open"), (a["i"] + 1).alias("i"), F.when((a["end"] == 0) & (x == "}") & (now == 0), a["i"] + 1).otherwise(a["end"]).alias("end"))

    spaced = F.concat(F.lit("\\boxed "), F.get(F.split(F.element_at(F.split(c, r"\\boxed ", -1), -1), r"\$", -1), F.lit(0)))
    closed = bound(F.coalesce(from_last("\\boxed"), from_last("\\fbox")), lambda tail: bound(F.aggregate(F.split(tail, ""), first, step)["end"], lambda end: F.when(end > 0, F.substring(tail, F.lit(1), end))))
    return F.when(F.contains(c, F.lit("\\boxed ")), spaced).otherwise(closed)


def unboxed(c: Column) -> Column:
    """What a box of last_boxed holds."""
    return bound(c, lambda b: F.when(b.startswith("\\boxed "), F.substr(b, F.lit(8))).when(b.startswith("\\boxed{") & b.endswith("}"), F.substring(b, F.lit(8), F.length(b) - 8)))


#: Replaced in this order.
MATH_CUTS = (("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""))


def math_plain(c: Column) -> Column:
    """An answer in one form: fractions and roots with braces, no units, percent signs, degrees and spaces."""
    for old, new in MATH_CUTS:
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.get(F.split(c, r"\\text\{ ", -1), F.lit(0))
    for old, new in (("\\%", ""), (" .", " 0."), ("{.", "{0.")):
        c = F.replace(c, F.lit(old), F.lit(new))
    c = bound(c, lambda x: F.when(x.startswith("."), F.concat(F.lit("0"), x)).otherwise(x))
    side = lambda v: F.when((F.size(v["s"]) == 2) & (F.length(F.get(v["s"], F.lit(0))) <= 2), F.get(v["s"], F.lit(1))).otherwise(v["x"])
    c = bound(c, lambda x: bound(F.struct(x.alias("x"), F.split(x, "=", -1).alias("s")), side))
    c = F.replace(F.regexp_replace(c, r"\\sqrt([^{])", r"\\sqrt{$1}"), F.lit(" "), F.lit(""))
    c = F.regexp_replace(F.regexp_replace(c, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}"), r"\\frac([^{])\{", r"\\frac{$1}{")
    c = bound(c, lambda x: F.when(x == "0.5", F.lit("\\frac{1}{2}")).otherwise(x))
    return F.regexp_replace(c, r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$", r"\\frac{$1}{$2}")


#: What a final answer loses, in this order: replacements, then removals.
FINAL_CUTS = (("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"))
FINAL_REMOVED = ("square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots")
#: Patterns and what takes their place, in this order.
FINAL_FORMS = ((r"(.*?)(\$)(.*?)(\$)(.*)", "\\$", 3, "\\$"), (r"(\\text\{)(.*?)(\})", "", 2, ""), (r"(\\textbf\{)(.*?)(\})", "", 2, ""), (r"(\\overline\{)(.*?)(\})", "", 2, ""), (r"(\\boxed\{)(.*)(\})", "", 2, ""))


def final_answer(c: Column) -> Column:
    """A quantitative answer in one form: what follows the last =, without units and spaces, fractions and roots with braces, whole numbers without commas."""
    c = F.element_at(F.split(c, "=", -1), -1)
    for old, new in (*FINAL_CUTS, *((x, "") for x in FINAL_REMOVED)):
        c = F.replace(c, F.lit(old), F.lit(new))
    for pattern, left, group, right in FINAL_FORMS:
        c = F.regexp_replace(c, "(?d)" + pattern, f"{left}${group}{right}")
    c = F.regexp_replace(F.regexp_replace(c, r"(?d)(frac)([^{])(.)", r"frac{$2}{$3}"), r"(sqrt)([^{])", r"sqrt{$2}")
    c = F.replace(c, F.lit("$"), F.lit(""))
    return stripped(bound(c, lambda x: F.when(x.rlike(r"^[\p{Nd},]*\p{Nd}[\p{Nd},]*$"), F.replace(x, F.lit(","), F.lit(""))).otherwise(x)))


def final_score(reply: Column, truth: Column) -> Column:
    """score (1 or -1), acc and pred: the last 'Answer: ...' line of the reply's last 300 characters, in one form, against the truth in the same form."""
    return bound(final_answer(named_answer(reply)), lambda pred: bound(pred == final_answer(truth), lambda ok: F.struct(F.when(ok, 1.0).otherwise(-1.0).alias("score"), ok.alias("acc"), pred.alias("pred"))))


def math_score(reply: Column, truth: Column) -> Column:
    return F.when(math_plain(unboxed(last_boxed(reply))) == math_plain(truth), 1.0).otherwise(0.0)


def strict_box(reply: Column, truth: Column) -> Column:
    """1 if the box in the last 100 characters holds the truth, else -1."""
    return F.when(unboxed(last_boxed(F.right(reply, F.lit(100)))) == truth, 1).otherwise(-1)


def named_answer(reply: Column) -> Column:
    """The last 'Answer: ...' line of the last 300 characters, else [INVALID]."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(F.right(reply, F.lit(300)), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1)), F.lit(-1)), F.lit("[INVALID]"))


def plain_number(c: Column) -> Column:
    """A number written with commas or not, as a double; null for anything else."""
    t = stripped(F.when(F.contains(c, F.lit("{,}")), F.replace(c, F.lit("{,}"), F.lit(""))).otherwise(F.replace(c, F.lit(","), F.lit(""))))
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.cast("double"))


def _without_unit(c: Column) -> Column:
    """c without a leading $ or a closing percent sign, a number of another base without its base."""
    number = F.try_element_at(F.split(c, "_", -1), F.lit(1))
    return F.when(c.rlike(r"^\$[0-9]+(\.[0-9]+)?"), F.substr(c, F.lit(2))).when(c.rlike(r"^[0-9]+(\.[0-9]+)?\\?%$"), F.translate(c, "\\%", "")).when(F.contains(c, F.lit("_")) & plain_number(number).isNotNull(), plain_number(number).cast("long").cast("string")).otherwise(c)


def same_number(a: Column, b: Column, tolerance: float = 1e-4, percentage: bool = True) -> Column:
    """Equal as texts, or as numbers within a share of the larger; b may also be given in hundredths or hundredfold."""

    def same(v: Column) -> Column:
        p, q = plain_number(v["x"]), plain_number(v["y"])
        near = lambda q: F.abs(p - q) <= tolerance * F.greatest(F.abs(p), F.abs(q))
        close = near(q) | near(q / 100) | near(q * 100) if percentage else near(q)
        spaceless = lambda c: F.replace(c, F.lit(" "), F.lit(""))
        return (F.lower(stripped(v["x"])) == F.lower(stripped(v["y"]))) | (spaceless(v["x"]) == spaceless(v["y"])) | F.coalesce(close, F.lit(False))

    return F.coalesce(bound(F.struct(_without_unit(a).alias("x"), _without_unit(b).alias("y")), same), F.lit(False))


#: Names of intervals with their brackets.
INTERVALS = {r"^Interval\((.*)\)$": "[$1]", r"^Interval\.Ropen\((.*)\)$": "[$1)", r"^Interval\.Lopen\((.*)\)$": "($1]", r"^Interval\.open\((.*)\)$": "($1)"}


def math_equal(a: Column, b: Column, tolerance: float = 1e-4, percentage: bool = True) -> Column:
    """Whether an answer is a truth: as a text or number (same_number), without brackets, or part by part of an interval, tuple or list. Expressions aren't worked out."""
    one = lambda x, y: same_number(x, y, tolerance, percentage)
    r = stripped(_without_unit(a))
    for pattern, form in INTERVALS.items():
        r = F.regexp_replace(r, pattern, form)

    def judged(v: Column) -> Column:
        r, s = v["r"], v["s"]
        opens = lambda c: F.left(c, F.lit(1))
        closes = lambda c: F.right(c, F.lit(1))
        both = ((opens(r) == "[") & (closes(r) == "]") & (opens(s) != "(")) | ((opens(r) == "(") & (closes(r) == ")") & (opens(s) != "["))
        bare = lambda c: F.translate(F.when(both, F.btrim(c, F.lit("[]()"))).otherwise(c), "{}()", "")
        parts = lambda c: F.split(c, ",", -1)
        inner = lambda c: F.substr(c, F.lit(2), F.length(c) - 2)
        every = lambda x, y: (F.size(x) == F.size(y)) & F.forall(F.zip_with(x, y, lambda p, q: F.coalesce(one(p, q), F.lit(False))), lambda ok: ok)
        framed = opens(r).isin("(", "[") & closes(r).isin(")", "]") & (opens(r) == opens(s)) & (closes(r) == closes(s)) & (F.length(r) > 1) & (F.length(s) > 1)
        listed = F.contains(r, F.lit(",")) & F.contains(s, F.lit(","))
        return (bare(r) == bare(s)) | (framed & every(parts(inner(r)), parts(inner(s)))) | (listed & every(F.transform(parts(r), stripped), F.transform(parts(s), stripped)))

    numbers = plain_number(_without_unit(a)).isNotNull() & plain_number(_without_unit(b)).isNotNull()
    return F.coalesce(F.when(one(a, b), F.lit(True)).when(numbers | (_without_unit(a) == ""), F.lit(False)).otherwise(bound(F.struct(r.alias("r"), stripped(_without_unit(b)).alias("s")), judged)), F.lit(False))


def geometry_format(c: Column) -> Column:
    return F.when(c.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$"), 1.0).otherwise(0.0)


def retrieval_fails(c: Column) -> Column:
    """Format errors of a retrieval reply: tags not paired, a speaker's name, not one answer, or one that is long or holds tags."""
    p = F.concat(F.lit("<think>"), c)
    marks = ("<|begin_of_documents|>\n", "<|end_of_documents|>\n", "<|begin_of_query|>", "<|end_of_query|>", "<|begin_of_documents|>", "<|end_of_documents|>", "<|begin_of_documents|>\n(1)")
    counts = [occurrences(p, m) for m in marks]
    answer = retrieval_answer(p)
    fails = (F.greatest(*counts) != F.least(*counts)) | F.contains(p, F.lit("Assistant:")) | F.contains(p, F.lit("assistant:")) | (occurrences(p, "<think>") != occurrences(p, "</think>"))
    fails = fails | (occurrences(p, "<answer>") != 1) | (occurrences(p, "</answer>") != 1) | F.contains(answer, F.lit("begin_of_query")) | F.contains(answer, F.lit("begin_of_documents"))
    return fails | (F.size(F.filter(F.split(answer, r"\s+"), lambda w: w != "")) > 10)


def retrieval_answer(p: Column) -> Column:
    return stripped(F.get(F.split(F.element_at(F.split(p, "<answer>", -1), -1), "</answer>", -1), F.lit(0)))


def retrieval_score(c: Column, truth: Column) -> Column:
    """Twice the answer's F1, one more with documents in the reply and one less without, one less for a format error."""
    return F.when(retrieval_fails(c), -1.0).otherwise(0.0) + F.when(F.contains(c, F.lit("<|begin_of_documents|>\n(1)")), 1.0).otherwise(-1.0) + 2.0 * token_f1(retrieval_answer(c), truth)


def verdict(c: Column) -> Column:
    """1 if a judge's text after 'Judgement:' has a 1, else 0."""
    return F.when(F.contains(F.substring_index(c, "Judgement:", -1), F.lit("1")) & F.contains(c, F.lit("Judgement:")), 1).otherwise(0)


def question_part(c: Column) -> Column:
    """The question before its options, which 'Options:' or 'choices:' names, with a question mark if it ends without one or a full stop."""
    q = stripped(F.get(F.split(c, r"(?i)(?:options|choices):", 2), F.lit(0)))
    return F.when((q == "") | q.rlike(r"[?.]$"), q).otherwise(F.concat(q, F.lit("?")))


def option_parts(c: Column) -> Column:
    """The options of a question: (A) lines, else A: parts, else lines; empty without a mark."""
    rest = F.get(F.split(c, r"(?i)(?:options|choices):", 2), F.lit(1))
    lettered = F.regexp_extract_all(rest, F.lit(r"\([A-Z]\)\s*([^\n]+)"), F.lit(1))
    listed = F.regexp_extract_all(rest, F.lit(r"[A-Z]:\s*([^,\n]+)"), F.lit(1))
    plain = F.filter(F.transform(F.split(stripped(rest), "\n", -1), stripped), lambda x: x != "")
    some = F.when(F.size(lettered) > 0, F.transform(lettered, stripped)).when(F.size(listed) > 0, F.transform(listed, stripped)).otherwise(plain)
    return F.when(rest.isNull(), F.array().cast("array<string>")).otherwise(some)


def with_choices(question: Column, options: Column) -> Column:
    """question and ' choices: A: x, B: y'."""
    listed = F.array_join(F.transform(options, lambda x, i: F.concat(F.chr(i.cast("long") + 65), F.lit(": "), x)), ", ")
    return F.when(F.size(options) > 0, F.concat(question, F.lit(" choices: "), listed)).otherwise(question)


def question_and_options(question: Column, options: Column) -> Column:
    lines = F.array_join(F.transform(options, lambda x, i: F.concat(F.chr(i.cast("long") + 65), F.lit(". "), x)), "\n")
    return F.concat(F.lit("Question: "), question, F.lit("\nOptions: \n"), lines)


def segments(c: Column) -> Column:
    """A prompt cut at <image> and <video>, as structs of type and text; empty texts are left out."""
    parts = F.filter(F.split(c, r"(?=<image>)|(?<=<image>)|(?=<video>)|(?<=<video>)"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.when(x == "<image>", "image").when(x == "<video>", "video").otherwise("text").alias("type"), F.when(~x.isin("<image>", "<video>"), x).alias("text")))


def hellaswag(c: Column) -> Column:
    return F.replace(F.regexp_replace(F.replace(stripped(c), F.lit(" [title]"), F.lit(". ")), r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def sequence_truth(first: Column, step: Column, count: Column) -> Column:
    """The next `count` members of an arithmetic sequence, as text."""
    return F.when(count < 1, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: (first + i * step).cast("string")), ","))


def prefix_reward(reply: Column, truth: Column) -> Column:
    """Share of the truth's characters, and one for the end, that the reply has right from the start on."""
    same = F.transform(F.sequence(F.lit(1), F.greatest(F.length(truth), F.lit(1))), lambda i: F.left(reply, i) == F.left(truth, i))
    n = F.when(F.length(truth) == 0, 0).otherwise(F.size(F.filter(same, lambda x: x)))
    return (n + F.when(reply == truth, 1).otherwise(0)) / (F.length(truth) + 1)


def overlong_penalty(length: Column, most: int, buffer: int, factor: float) -> Column:
    return F.least(-(length - (most - buffer)) / F.lit(float(buffer)) * factor, F.lit(0.0))


def boxes(c: Column) -> Column:
    """Boxes [x1,y1,x2,y2] within <box> tags, those with x1 < x2 and y1 < y2."""
    n = r"\s*(-?[0-9]+(?:\.[0-9]+)?)\s*"
    raw = F.regexp_extract_all(c, F.lit(rf"<box>\[{n},{n},{n},{n}\]</box>"), F.lit(0))
    four = F.transform(raw, lambda b: F.transform(F.split(F.regexp_replace(b, r"</?box>|[\[\]\s]", ""), ","), lambda v: v.cast("double")))
    return F.filter(four, lambda b: (F.get(b, F.lit(0)) < F.get(b, F.lit(2))) & (F.get(b, F.lit(1)) < F.get(b, F.lit(3))))


def by_label(labels: Column, texts: Column) -> Column:
    """Texts in the order of their labels; of a label's texts the last."""
    both = F.arrays_zip(labels.alias("label"), texts.alias("text"))
    return F.transform(F.array_sort(F.array_distinct(labels)), lambda k: F.element_at(F.filter(both, lambda x: x["label"] == k), -1)["text"])


def labelled_options(c: Column) -> Column:
    """(question, options) of a question with its options: after 'Options:' or 'choices:' as (A) lines, A: parts or lines, else inline as A. B); options are null if there are none, and in the order of their letters."""
    s = stripped(F.replace(F.coalesce(c, F.lit("")), F.lit("<image>"), F.lit("")))
    cut = F.split(s, r"(?i)(?:options:|choices:)", 2)
    rest = stripped(F.get(cut, F.lit(1)))
    all_ = lambda pattern, group: F.regexp_extract_all(rest, F.lit(pattern), F.lit(group))
    lettered, listed = r"\(([A-Z])\)\s*([^\n]+)", r"([A-Z])\s*:\s*([^\n,]+(?:\n|,|$))"
    lines = F.filter(F.transform(F.split(rest, "\n", -1), stripped), lambda x: x != "")
    trimmed = F.transform(all_(listed, 2), lambda x: stripped(F.rtrim(x, F.lit(",\n "))))
    after = F.when(F.size(all_(lettered, 1)) > 0, by_label(all_(lettered, 1), F.transform(all_(lettered, 2), stripped))).when(F.size(all_(listed, 1)) > 0, by_label(all_(listed, 1), trimmed)).when(F.size(lines) > 0, lines)
    # a private character before and after each inline label
    parts = F.split(F.regexp_replace(s, r"(?<![A-Z0-9])([A-E])\s*[.):]\s*", "\ue000$1\ue001"), "\ue000", -1)
    inner = F.slice(parts, 2, F.size(parts))
    inline = by_label(F.transform(inner, lambda x: F.left(x, F.lit(1))), F.transform(inner, lambda x: stripped(F.substr(x, F.lit(3)))))
    marked, many = F.size(cut) > 1, F.size(parts) > 2
    question = F.when(marked, stripped(F.get(cut, F.lit(0)))).when(many, stripped(F.get(parts, F.lit(0)))).otherwise(s)
    return F.struct(question.alias("question"), F.when(marked, after).when(many, inline).alias("options"))


def choice_letter(c: Column) -> Column:
    """The first letter from A to E that stands alone; null without one."""
    return F.nullif(F.regexp_extract(c, r"(?<![\p{L}\p{N}_])([A-E])(?![\p{L}\p{N}_])", 1), F.lit(""))


def boxed_part(c: Column) -> Column:
    """What stands between the first 'oxed{' and the brace after it; null without one."""
    return F.get(F.split(F.get(F.split(c, r"oxed\{", -1), F.lit(1)), r"\}", -1), F.lit(0))


def chosen_from(c: Column) -> Column:
    """(question, options) of a question that must name its options after 'choices:', as A: parts; null if it doesn't, or has no question."""
    cut = F.split(c, r"(?i)choices:", 2)
    question = F.btrim(F.get(cut, F.lit(0)), F.lit(" ?\n"))
    options = F.transform(F.regexp_extract_all(stripped(F.get(cut, F.lit(1))), F.lit(r"[A-Z]:\s*([^\n,]+(?:\n|,|$))"), F.lit(1)), lambda x: stripped(F.rtrim(x, F.lit(",\n "))))
    return F.when((F.size(cut) > 1) & (question != ""), F.struct(F.concat(question, F.lit("?")).alias("question"), F.when(F.size(options) > 0, options).alias("options")))


def rewritten_in_thoughts(c: Column, old: Column, new: Column) -> Column:
    """c with each box of old (an array of arrays of whole numbers) written as the one at its place in new, in <think> blocks only, with brackets or without."""
    spaced = lambda b, sep: F.array_join(b.cast("array<string>"), sep)
    pairs = F.arrays_zip(old.alias("old"), new.alias("new"))

    def one(t: Column, p: Column) -> Column:
        pattern, text = spaced(p["old"], r"(?U)\s*,\s*"), spaced(p["new"], ", ")
        bare = F.regexp_replace(F.regexp_replace(t, F.concat(F.lit(r"(?U)\[\s*"), pattern, F.lit(r"\s*\]")), F.concat(F.lit("["), text, F.lit("]"))), pattern, text)
        return F.when(F.size(p["old"]) > 0, bare).otherwise(t)

    inner = F.regexp_extract_all(c, F.lit(r"(?s)<think>(.*?)</think>"), F.lit(1))
    outer = F.split(c, r"(?s)<think>.*?</think>", -1)
    done = F.transform(inner, lambda x: F.concat(F.lit("<think>"), F.aggregate(pairs, x, one), F.lit("</think>")))
    return F.array_join(F.flatten(F.transform(outer, lambda x, i: F.when(i < F.size(inner), F.array(x, F.get(done, i))).otherwise(F.array(x)))), "")


def between_marks(c: Column, start: str, end: str) -> Column:
    """All that stands between the marks, which are taken literally."""
    return F.regexp_extract_all(c, F.lit(f"(?s)\\Q{start}\\E(.*?)\\Q{end}\\E"), F.lit(1))


def passages(contents: Column) -> Column:
    """Passages, a title and a text under it each, as one numbered reference."""
    title = lambda x: F.substring_index(x, "\n", 1)
    one = lambda x, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit("(Title: "), title(x), F.lit(") "), F.substr(x, F.length(title(x)) + 2), F.lit("\n"))
    return F.array_join(F.transform(contents, one), "")


def matches_exactly(reply: Column, truth: Column) -> Column:
    """1 if the answer after the last thought is the truth, whatever its case and ASCII punctuation."""
    plain = lambda x: F.regexp_replace(F.lower(x), r"[!-/:-@\[-`{-~]", "")
    return F.when(plain(retrieval_answer(after_thought(reply))) == plain(truth), 1.0).otherwise(0.0)


def first_score(pred: Column, answers: Column, fails: Column) -> Column:
    """The earlier score: accuracy and format, and one more for a right reply with a tool call that didn't fail. A short reply without answer tags is its own answer; one of 200 characters or more is neither right nor well formed."""
    found = last_answer(pred)
    answer = F.coalesce(found, pred)
    short = F.length(answer) < 200
    right = found.isNotNull() & short & exact_match(answer, answers)
    tool = F.contains(pred, F.lit("<tool_call>")) & F.contains(pred, F.lit("</tool_call>")) & ~F.contains(pred, F.lit("\n<|im_start|>user\nError: "))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    parts = F.struct(one(tool).alias("tool_reward"), one(right).alias("acc_reward"), one(~fails & short).alias("format_reward"))
    return bound(parts, lambda p: F.struct((p["acc_reward"] + p["format_reward"] + p["acc_reward"] * p["tool_reward"]).alias("score"), p["tool_reward"], p["acc_reward"], p["format_reward"]))


#: Words after which, before which, and again after which an answer stands.
ANSWER_AFTER = ("answer:", "answer is", "answers are")
ANSWER_BEFORE = ("is answer", "is the answer", "are answers", "are the answers")
VALUE_AFTER = ("be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n")


def box_content(c: Column) -> Column:
    r"""What the last \boxed or, without one, \fbox holds between its first brace and the one that closes it; null if none does."""
    first = F.struct(F.lit(0).alias("open"), F.lit(0).alias("i"), F.lit(0).alias("left"), F.lit(0).alias("right"))

    def step(a: Column, x: Column) -> Column:
        now = a["open"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)
        left = F.when((a["left"] == 0) & (x == "{"), a["i"] + 1).otherwise(a["left"])
        return F.struct(now.alias("open"), (a["i"] + 1).alias("i"), left.alias("left"), F.when((a["right"] == 0) & (x == "}") & (now == 0), a["i"] + 1).otherwise(a["right"]).alias("right"))

    found = F.coalesce(*(F.when(F.contains(c, F.lit(f"\\{mark}")), F.regexp_extract(c, rf"(?s)^.*\\{mark}(.*)\z", 1)) for mark in ("boxed", "fbox")))
    return bound(found, lambda t: bound(F.aggregate(F.split(t, ""), first, step), lambda a: F.when((a["left"] > 0) & (a["right"] > 0), stripped(F.substring(t, a["left"] + 1, a["right"] - a["left"] - 1)))))


def located_answer(c: Column) -> Column:
    """(matched, answer): what words like 'answer is' and 'is the answer', a box, a full stop and words like 'is' or '=' leave of a reply; matched only with a digit in it."""
    after = lambda x, mark: F.regexp_extract(x, rf"(?is)^.*\Q{mark}\E(.*)\z", 1)
    before = lambda x, mark: F.regexp_extract(x, rf"(?is)^(.*)\Q{mark}\E", 1)
    state = F.struct(F.lit(False).alias("m"), c.alias("c"))

    def cut(mark: str, part):
        there = lambda s: F.contains(F.lower(s["c"]), F.lit(mark))
        return lambda s: F.struct((s["m"] | there(s)).alias("m"), F.when(there(s), stripped(part(s["c"], mark))).otherwise(s["c"]).alias("c"))

    for marks, part in ((ANSWER_AFTER, after), (ANSWER_BEFORE, before)):
        for mark in marks:
            state = bound(state, cut(mark, part))
    state = bound(state, lambda s: bound(box_content(s["c"]), lambda b: F.struct((s["m"] | (F.length(b) > 0) & b.isNotNull()).alias("m"), F.when(F.length(b) > 0, b).otherwise(s["c"]).alias("c"))))
    state = bound(state, lambda s: F.struct(s["m"].alias("m"), F.when(F.contains(s["c"], F.lit(". ")), stripped(before(s["c"], ". "))).otherwise(s["c"]).alias("c")))
    for mark in VALUE_AFTER:
        state = bound(state, cut(mark, after))
    return bound(state, lambda s: F.struct((s["m"] & s["c"].rlike(r"\p{Nd}")).alias("matched"), s["c"].alias("answer")))


def geometry_score(reply: Column, truth: Column) -> Column:
    """Nine tenths for the last box if it is the truth (math_equal), one tenth for the format."""
    held = bound(last_boxed(reply), unboxed)
    return 0.9 * F.when(bound(held, lambda h: F.coalesce(math_equal(h, truth), F.lit(False))), 1.0).otherwise(0.0) + 0.1 * geometry_format(reply)
