import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripleloom.functions import paths as P
from tripleloom.functions import text as T
from tripleloom.functions import vectors as V


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def normal(s):
    """Token by token: signs out, articles out."""
    tokens = s.lower().translate({ord(c): None for c in string.punctuation}).split()
    return " ".join(t for t in tokens if t not in {"a", "an", "the"})


@given(st.lists(st.text(alphabet="aAnthe .,'é  -x\n", max_size=20), min_size=1, max_size=40))
@settings(max_examples=10, deadline=None)
def test_normalize_equals_plain_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", T.normalize(F.col("t")).alias("n")).collect()}
    assert got == {i: normal(t) for i, t in enumerate(texts)}


def test_markers_and_selections(spark):
    reply = "# Reasoning Path:\nx\n# Answer:\n a \n\nb\n# Answer:\nc"
    assert one(spark, T.lines_after(F.col("t")), t=reply) == ["a", "b", "# Answer:", "c"]
    assert one(spark, T.after_last(F.col("t"), T.SENTENCE_MARK), t="so the answer is: x. the answer is: y") == "y"
    assert one(spark, T.selected(F.col("t"), F.col("c")), t="[REL3] x [REL1] [REL1] [REL9]", c=["a", "b", "c"]) == ["a", "c"]


def test_replies(spark):
    read = lambda text, **k: one(spark, T.read_reply(F.col("t"), **k), t=text).asDict(recursive=True)
    assert read('Well.\n```json\n{"answer_found": true, "answer_entities": ["A"]}\n```')["answer_entities"] == ["A"]
    assert read('say {"answer_found": true, "next_exploration_step": {"entity": "B"}} end')["next_entity"] == "B"
    assert read("nothing here") == {"answer_found": False, "answer_entities": [], "reasoning_summary": "", "reasoning_path": "", "next_entity": None}
    assert read("nothing here", can_answer=True)["answer_found"] is True


def test_reply_objects(spark):
    read = lambda text: one(spark, T.reply_object(F.col("t")), t=text)
    assert read('x ```json\n{"a": {"b": {"c": 1}}}\n``` y {"d": 1}') == '{"a": {"b": {"c": 1}}}'
    assert read('x ```\n[1, 2]\n``` y ```JSON {"d": 1}```') == '{"d": 1}'
    assert read("x ```[1]``` {") == "[1]"
    assert read('deep {"a": {"b": {"c": {}}}} and {"d": 1}') == '{"a": {"b": {"c": {}}}}'
    assert read("never {closed {at} all") is None and read("none } here") is None and read("") is None and read(None) is None
    assert read("``` open fence {1}") == "{1}"


def test_fallback_answers(spark):
    read = lambda text: tuple(one(spark, T.fallback_answer(F.col("t")), t=text))
    assert read('```json\n{"answer_entities": ["A", 3], "reasoning_path": " ", "can_answer": false}\n```') == (True, T.NO_PATH, ["A", "3"], T.NO_ANSWER)
    assert read(' {"reasoning_path": "p", "reasoning_summary": "s"} ') == (True, "p", [], "s")
    assert read("no object") == (True, T.NO_PATH, [], T.NO_OBJECT)
    assert read("{broken}") == (True, T.NO_PATH, [], T.NO_ANSWER) and read("") == read(None) == (True, T.NO_PATH, [], T.NO_ANSWER)


def test_chat_styles(spark):
    def prompt(style, system="S", roles=("U", "B"), **seps):
        turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.lit(c).cast("string").alias("content"))
        m = F.array(turn(roles[0], "hi"), turn(roles[1], "yo"), turn(roles[0], "a\r\n\r\nb"), turn(roles[1], None))
        return spark.range(1).select(T.chat_prompt(F.lit(system), m, style, **seps)).first()[0]

    assert prompt("add_colon_two", sep=" ", sep2="</s>") == "S U: hi B: yo</s>U: a\r\n\r\nb B:"
    assert prompt("llama2", sep=" ", sep2=" </s>", roles=("[INST]", "[/INST]")) == "Shi [/INST] yo </s>[INST] a\r\n\r\nb [/INST]"
    assert prompt("llama2", system="", sep=" ", sep2=" </s>", roles=("[INST]", "[/INST]")).startswith("[INST] hi [/INST]")
    assert prompt("chatglm", sep="\n", first_round=1) == "S\n[Round 1]\nU：hi\nB：yo\n[Round 2]\nU：a\r\n\r\nb\nB："
    assert prompt("chatml", system="", sep="<|e|>") == "U\nhi<|e|>\nB\nyo<|e|>\nU\na\r\n\r\nb<|e|>\nB\n"
    assert prompt("rwkv", sep="") == "SU: hi\n\nB: yo\n\nU: a\nb\n\nB:"
    assert prompt("dolly", sep="#", sep2="$") == "SU:\nhi#B:\nyo$\n\nU:\na\r\n\r\nb#B:\n"
    assert prompt("chatintern", sep="<u>", sep2="<b>") == "S<s>U:hi<u>\nB:yo<b>\n<s>U:a\r\n\r\nb<u>\nB:"
    # two styles differ only where there is no system text
    assert len({(prompt(style, sep="#", sep2="$"), prompt(style, system="", sep="#", sep2="$")) for style in T.SEPARATOR_STYLES}) == 16


def test_path_texts_and_back(spark):
    text = "A b.c-[r1]->B - x ; bad ; B - x-[r2]->C"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(P.parse_steps(F.col("t")).alias("p"))
    got = [[tuple(s) for s in r["p"]] for r in df.collect()]
    assert got == [[("A b.c", "r1", "B - x"), ("B - x", "r2", "C")], [], []]
    again = df.select(P.steps_text(F.col("p")).alias("s"), P.arrow_text(F.col("p")).alias("a"), P.dashed_text(F.col("p")).alias("d"), P.history_key(F.col("p"), F.lit(1)).alias("k")).first()
    assert tuple(again) == ("A b.c-[r1]->B - x ; B - x-[r2]->C", "A b.c -> r1 -> B - x -> r2 -> C", "A b.c --[r1]--> B - x --[r2]--> C", "A b.c-[r1]->B - x")
    assert [r[0] for r in spark.createDataFrame([("",), ("a ; b",)], "t string").select(P.path_length(F.col("t"))).collect()] == [0, 2]


def test_templates_names_and_budgets(spark):
    import pytest

    assert one(spark, T.fill_template("{q}? {x}!", q=F.col("q"), x=F.lit(1)), q="why") == "why? 1!"
    with pytest.raises(ValueError):
        T.fill_template("{q}{missing}", q=F.lit(1))
    assert one(spark, T.safe_file_name(F.col("t")), t="_a/b c?\\d_") == "a_b_c_d"
    assert one(spark, T.short_name(F.col("t")), t="x" * 65).startswith("x" * 64 + "_")
    assert one(spark, T.tail_lines(F.col("t"), 3), t="a b\nc d\ne") == "c d\ne"
    head = lambda n, text, m="words": one(spark, T.head_lines(F.col("t"), n, m), t=text)
    assert [head(n, "a b\nc d\ne") for n in (0, 2, 3, 4, 5)] == ["a b", "a b", "a b", "a b\nc d", "a b\nc d\ne"]
    assert head(1, "") == "" and head(1, None) is None and head(8, "abc\ndef\ng", "chars") == "abc\ndef"
    assert one(spark, T.quoted_list(F.col("c")), c=["a", "b"]) == '"a", "b"'
    assert one(spark, T.rendered_options(F.col("c"), "zero"), c=["s", "r", "s"]) == "[REL_0] r\n[REL_1] s"
    rows = spark.createDataFrame([(1, "aaaa", 1), (1, "bb", 2), (1, "c", 3), (2, "d", 1)], "g int, t string, o int")
    assert sorted(r["t"] for r in T.packed_to_budget(rows, ["g"], "t", F.col("o"), 6).collect()) == ["aaaa", "bb", "d"]


def test_chat(spark):
    m = F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content")), F.struct(F.lit("tool").alias("role"), F.lit("x").alias("content")))
    assert spark.range(1).select(T.chat_text(m, "add_colon_space_single")).first()[0] == "USER: hi tool: x "


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(V.dot(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("b")), V.norm(F.col("a")), V.unit(F.col("a"))).collect()
    assert tuple(got[0]) == (3.0, 0.6, 5.0, [0.6, 0.8]) and got[1][1] is None and got[1][3] == [0.0, 0.0]
