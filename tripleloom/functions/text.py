"""Text functions: normalisation, markers, selections, replies in JSON, prompts, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.binding import let

#: The ASCII punctuation, the articles, the markers of an answer text.
PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
ARTICLES = r"\b(a|an|the)\b"
ANSWER_MARK, REASONING_MARKS, SENTENCE_MARK = "# Answer:\n", ("# Reasoning Path:\n", "Reasoning path:\n"), "the answer is: "
MEDIATOR = r"m\.[0-9a-z_]+"
SELECTION = r"\[REL(\d+)\]"
FENCE = "```"


def normalize(text: Column) -> Column:
    """Lower case, without punctuation and articles, white space collapsed."""
    c = F.regexp_replace(F.lower(text), PUNCTUATION, "")
    c = F.regexp_replace(c, "(?U)" + ARTICLES, " ")
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def holds(text: Column, part: Column) -> Column:
    """Whether ``part`` stands in ``text`` after normalisation; an empty part stands everywhere."""
    return F.instr(normalize(text), normalize(part)) > 0


def lines_after(text: Column, mark: str = ANSWER_MARK) -> Column:
    """The stripped, non-blank lines after the first ``mark``; of the whole text if it is absent."""
    return F.filter(F.transform(F.split(F.element_at(F.split(text, mark, 2), -1), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def after_last(text: Column, mark: str) -> Column:
    return F.element_at(F.split(text, mark), -1)


def selected(text: Column, candidates: Column) -> Column:
    """The candidates named by ``[RELi]`` (from 1), in the candidates' order, each once; others are ignored."""
    found = F.transform(F.regexp_extract_all(text, F.lit(SELECTION), F.lit(1)), lambda x: x.cast("int"))
    return let(found, lambda f: F.filter(F.transform(candidates, lambda c, i: F.when(F.array_contains(f, i + 1), c)), lambda c: c.isNotNull()))


def _first_object(text: Column) -> Column:
    """From the first opening brace to the closing one that makes both as many; null if none does."""
    pieces = F.split(F.substr(text, F.nullif(F.instr(text, "{"), F.lit(0))), r"\}")
    opened = lambda piece: F.length(piece) - F.length(F.replace(piece, F.lit("{"), F.lit("")))
    walked = lambda ps: F.aggregate(
        F.slice(ps, F.lit(1), F.greatest(F.size(ps) - 1, F.lit(0))),  # each of them ends with a closing brace
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("closed")),
        lambda acc, piece: F.when(acc["closed"], acc).otherwise(
            F.struct((acc["depth"] + opened(piece) - 1).alias("depth"), (acc["n"] + 1).alias("n"), (acc["depth"] + opened(piece) == 1).alias("closed"))
        ),
    )
    taken = lambda ps: let(walked(ps), lambda w: F.when(w["closed"], F.concat(F.array_join(F.slice(ps, F.lit(1), F.greatest(w["n"], F.lit(1))), "}"), F.lit("}"))))
    return let(pieces, taken)


def reply_object(text: Column) -> Column:
    """The JSON object or array in a model's reply, as text: the first fenced block that is an object, else
    the first that is an array, else the first balanced object anywhere."""
    blocks = F.filter(F.split(text, FENCE), lambda _, i: i % 2 == 1)
    bare = F.transform(blocks, lambda x: F.btrim(F.when(F.lower(x).startswith("json"), F.substr(x, F.lit(5))).otherwise(x), F.lit(" \t\r\n")))
    within = lambda first, last: F.get(F.filter(bare, lambda x: x.startswith(first) & x.endswith(last)), F.lit(0))
    return F.coalesce(within("{", "}"), within("[", "]"), _first_object(text))


#: What a fallback answer says where the reply gives nothing.
NO_PATH, NO_ANSWER, NO_OBJECT = "[Parsing Failed: No path extracted]", "Failed to parse a valid response from the language model.", "Output format error: Expected a JSON object."


def fallback_answer(text: Column) -> Column:
    """``(can_answer, reasoning_path, answer_entities, reasoning_summary)`` of a last reply: the fenced object, or
    the whole text if it is one; an answer is always taken as given, what is missing or blank has a default."""
    blocks = F.filter(F.split(text, FENCE), lambda _, i: i % 2 == 1)
    bare = F.transform(blocks, lambda x: F.btrim(F.when(F.lower(x).startswith("json"), F.substr(x, F.lit(5))).otherwise(x), F.lit(" \t\r\n")))
    whole = F.btrim(text, F.lit(" \t\r\n"))
    is_object = lambda x: x.startswith("{") & x.endswith("}")
    found = F.coalesce(F.get(F.filter(bare, is_object), F.lit(0)), F.when(is_object(whole), whole))
    read = F.from_json(found, "reasoning_path string, answer_entities array<string>, reasoning_summary string")
    filled = lambda x, default: F.when(F.btrim(x) != "", x).otherwise(default)
    return F.struct(
        F.lit(True).alias("can_answer"),
        filled(read["reasoning_path"], F.lit(NO_PATH)).alias("reasoning_path"),
        F.coalesce(read["answer_entities"], F.array().cast("array<string>")).alias("answer_entities"),
        filled(read["reasoning_summary"], F.when(found.isNull() & (F.coalesce(text, F.lit("")) != ""), NO_OBJECT).otherwise(NO_ANSWER)).alias("reasoning_summary"),
    )


REPLY = "answer_found boolean, answer_entities array<string>, reasoning_summary string, reasoning_path string, next_exploration_step struct<question:string,entity:string>"


def read_reply(text: Column, can_answer: bool = False) -> Column:
    """The reply's decision with defaults for what it doesn't give: nothing found, no entities.

    ``can_answer``: the fallback's reading, in which an answer is taken as found."""
    read = F.from_json(reply_object(text), REPLY)
    return F.struct(
        (F.lit(True) if can_answer else F.coalesce(read["answer_found"], F.lit(False))).alias("answer_found"),
        F.coalesce(read["answer_entities"], F.array().cast("array<string>")).alias("answer_entities"),
        F.coalesce(read["reasoning_summary"], F.lit("")).alias("reasoning_summary"),
        F.coalesce(read["reasoning_path"], F.lit("")).alias("reasoning_path"),
        read["next_exploration_step"]["entity"].alias("next_entity"),
    )


def quoted_list(items: Column) -> Column:
    """``"a", "b"``."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")


def with_question_mark(text: Column) -> Column:
    return F.when(text.endswith("?"), text).otherwise(F.concat(text, F.lit("?")))


def relation_words(relation: Column) -> Column:
    return F.lower(F.replace(relation, F.lit("_"), F.lit(" ")))


def fill_template(template: str, **values: Column) -> Column:
    """``{name}`` replaced by the columns; a name without a column is an error on the driver."""
    import string

    parts: list[Column] = []
    for text, name, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(text))
        if name is not None:
            if name not in values:
                raise ValueError(f"the template needs {name}")
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def history_lines(path: Column) -> Column:
    """``Step i: From 's' explored relation 'r', leading to 't'.`` for each step."""
    return F.array_join(
        F.transform(path, lambda s, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": From '"), s["h"], F.lit("' explored relation '"), s["r"], F.lit("', leading to '"), s["t"], F.lit("'."))),
        "\n",
    )


def short_name(text: Column, most: int = 64) -> Column:
    """The first ``most`` signs and an md5 of the whole where it is longer."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("_"), F.md5(text))).otherwise(text)


def safe_file_name(text: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(text, r"[/\\]", "_"), r"[^\w\s_.-]", "")
    return F.btrim(F.regexp_replace(c, r"\s+", "_"), F.lit("_"))


def rendered_options(relations: Column, style: str) -> Column:
    """Sorted distinct relations, one a line: ``one`` [REL1] r, ``zero`` [REL_0] r, ``bare`` r."""
    tags = {"one": lambda x, i: F.concat(F.lit("[REL"), (i + 1).cast("string"), F.lit("] "), x), "zero": lambda x, i: F.concat(F.lit("[REL_"), i.cast("string"), F.lit("] "), x), "bare": lambda x, i: x}
    return F.array_join(F.transform(F.sort_array(F.array_distinct(relations)), tags[style]), "\n")


def approximate_tokens(text: Column, measure: str = "words") -> Column:
    """``words``, ``words15`` (one and a half a word, rounded down) or ``chars``."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    return {"words": words, "words15": F.floor(words * 1.5).cast("int"), "chars": F.length(text)}[measure]


def packed_to_budget(df: DataFrame, group: list[str], text: str, order: Column, budget: int) -> DataFrame:
    """The rows of each group that fit: all if their lengths sum to less than ``budget``, else the
    rows in ``order`` up to the last whose running sum is not above it."""
    whole = Window.partitionBy(*group)
    running = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    length = F.length(text)
    return (
        df.withColumn("__all", F.sum(length).over(whole))
        .withColumn("__run", F.sum(length).over(running))
        .where((F.col("__all") < budget) | (F.col("__run") <= budget))
        .drop("__all", "__run")
    )


def head_lines(text: Column, budget: int, measure: str = "words") -> Column:
    """A text without the last lines that make it longer than ``budget``; the first line always stays."""
    kept = lambda lines: F.aggregate(
        lines,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.lit(False).alias("full")),
        lambda acc, x: F.when(acc["full"] | ((acc["n"] > 0) & (acc["used"] + _line_size(x, measure) > budget)), F.struct(acc["n"].alias("n"), acc["used"].alias("used"), F.lit(True).alias("full"))).otherwise(
            F.struct((acc["n"] + 1).alias("n"), (acc["used"] + _line_size(x, measure)).alias("used"), F.lit(False).alias("full"))
        ),
    )
    return let(F.split(text, "\n"), lambda lines: F.array_join(F.slice(lines, F.lit(1), kept(lines)["n"]), "\n"))


def _line_size(line: Column, measure: str) -> Column:
    return approximate_tokens(line, measure) + (1 if measure == "chars" else 0)


def tail_lines(text: Column, budget: int) -> Column:
    """The last lines of a text whose words together don't exceed ``budget``."""
    lines = F.reverse(F.split(text, "\n"))
    kept = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("out")),
        lambda acc, x: F.when(acc["full"] | (acc["n"] + approximate_tokens(x) > budget), F.struct(acc["n"].alias("n"), F.lit(True).alias("full"), acc["out"].alias("out"))).otherwise(
            F.struct((acc["n"] + approximate_tokens(x)).alias("n"), F.lit(False).alias("full"), F.concat(F.array(x), acc["out"]).alias("out"))
        ),
    )
    return F.array_join(kept["out"], "\n")


#: How the chat styles mark turns: before a turn by role, after it.
CHAT_STYLES = {
    "chatml": ({"system": "<|im_start|>system\n", "user": "<|im_start|>user\n", "assistant": "<|im_start|>assistant\n"}, "<|im_end|>\n"),
    "llama2": ({"system": "[INST] <<SYS>>\n", "user": "[INST] ", "assistant": " "}, " "),
    "add_colon_single": ({"system": "", "user": "USER: ", "assistant": "ASSISTANT: "}, "\n"),
    "add_colon_space_single": ({"system": "", "user": "USER: ", "assistant": "ASSISTANT: "}, " "),
}


def chat_text(messages: Column, style: str) -> Column:
    """A list of ``(role, content)`` as one prompt text."""
    marks, end = CHAT_STYLES[style]
    before = lambda m: F.coalesce(*(F.when(m["role"] == role, F.lit(mark)) for role, mark in marks.items()), F.concat(m["role"], F.lit(": ")))
    return F.array_join(F.transform(messages, lambda m: F.concat(before(m), m["content"], F.lit(end))), "")


#: The separator styles of chat prompts: what opens the prompt (``system`` and ``sep``; a mark after
#: ``?`` only with a system text), what stands between role and message, what ends a turn (``alt``: sep and sep2
#: in turn), what follows the role of a turn that is still open, what comes before every even and after every odd turn.
SEPARATOR_STYLES = {
    "add_colon_single": ("system sep", ": ", "sep", ":", "", ""),
    "add_colon_two": ("system sep", ": ", "alt", ":", "", ""),
    "add_colon_space_single": ("system sep", ": ", "sep", ": ", "", ""),
    "no_colon_single": ("system", "", "sep", "", "", ""),
    "no_colon_two": ("system", "", "alt", "", "", ""),
    "add_new_line_single": ("system ?sep", "\n", "sep", "\n", "", ""),
    "llama2": ("system", " ", "alt", "", "", ""),
    "chatglm": ("system ?sep", "：", "sep", "：", "round", ""),
    "chatml": ("system ?sep ?line", "\n", "sep line", "\n", "", ""),
    "chatintern": ("system", ":", "alt line", ":", "<s>", ""),
    "dolly": ("system", ":\n", "alt", ":\n", "", "\n\n"),
    "rwkv": ("system", ": ", "line line", ":", "", ""),
    "phoenix": ("system", ": <s>", "</s>", ": <s>", "", ""),
    "robin": ("system sep", ":\n", "sep", ":\n", "", ""),
    "falcon_chat": ("system ?sep", ": ", "sep", ":", "", ""),
    "chatglm3": ("system", "\n ", "", "", "", ""),
}


def chat_prompt(system: Column, messages: Column, style: str, sep: str, sep2: str = "", first_round: int = 0) -> Column:
    """A system text and a list of ``(role, content)`` in one of the separator styles; a turn without
    content is one that the model is to fill."""
    head, middle, end, left_open, before_even, after_odd = SEPARATOR_STYLES[style]
    known = F.coalesce(system, F.lit(""))
    filled = lambda m: F.coalesce(m["content"], F.lit("")) != ""

    def mark(name: str, i: Column | None = None) -> Column:
        if name.startswith("?"):
            return F.when(known != "", mark(name[1:])).otherwise("")
        if name == "alt":
            return F.when(i % 2 == 0, sep).otherwise(sep2)
        return {"system": known, "sep": F.lit(sep), "line": F.lit("\n")}.get(name, F.lit(name))

    def said(m: Column, i: Column) -> Column:
        content = m["content"]
        if style == "rwkv":
            content = F.replace(F.replace(content, F.lit("\r\n"), F.lit("\n")), F.lit("\n\n"), F.lit("\n"))
        full = F.concat(m["role"], F.lit(middle), content, *(mark(name, i) for name in end.split()), F.when(i % 2 == 1, after_odd).otherwise(""))
        return F.when(i == 0, F.concat(content, F.lit(" "))).otherwise(full) if style == "llama2" else full

    def turn(m: Column, i: Column) -> Column:
        before = F.concat(F.lit("[Round "), (F.floor(i / 2) + first_round).cast("string"), F.lit("]"), F.lit(sep)) if before_even == "round" else F.lit(before_even)
        return F.concat(F.when(i % 2 == 0, before).otherwise(""), F.when(filled(m), said(m, i)).otherwise(F.concat(m["role"], F.lit(left_open))))

    opening = [mark(name) for name in head.split()]
    if style == "llama2":
        opening = [F.when(known != "", known).otherwise("[INST] ")]
    return F.concat(*opening, F.array_join(F.transform(messages, turn), ""))
