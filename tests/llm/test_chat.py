import pytest

from tessella.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, messages string"


def go(template, **env):
    return chat.compile_template(template)(env)[0]


@pytest.mark.parametrize(
    "template,env,want",
    [
        ("a{{ x }}b", {"x": 3}, "a3b"),
        ("{{ 1 + 2 * 3 }}{{ -2 + 5 }}{{ 7 // 2 }}{{ 'a' ~ 1 }}", {}, "733a1"),
        ("{% for i in xs %}{{ i }}{% if not loop.last %},{% endif %}{% endfor %}", {"xs": [1, 2, 3]}, "1,2,3"),
        ("{% if a == 1 %}one{% elif a == 2 %}two{% else %}many{% endif %}", {"a": 2}, "two"),
        ("{{ 'yes' if a and not b else 'no' }}", {"a": 1, "b": 0}, "yes"),
        ("x  {%- if true -%}  y  {%- endif %} z", {}, "xy z"),
        ("{# remark #}{% set n = 4 %}{{ n * 2 }}", {}, "8"),
        ("{{ m['k'] }}{{ m.k }}{{ m.none }}{{ l[0] }}{{ l[9] }}", {"m": {"k": "v"}, "l": [5]}, "vv5"),
        ("{{ ' A ' | trim | lower }}{{ xs | length }}{{ q | default('d') }}", {"xs": [1, 2]}, "a2d"),
        ("{{ 'b' in ['a', 'b'] }}{{ 'c' not in 'abc' }}{{ q is defined }}{{ q is none }}", {}, "TrueFalseFalseTrue"),
    ],
)
def test_templates(template, env, want):
    assert go(template, **env) == want


@pytest.mark.parametrize("bad", ["{% if a %}", "{{ a | nothing }}", "{{ 1 + }}", "{% endfor %}", "{{ a.b( }}", "{% what %}"])
def test_bad_templates(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


def test_sandbox():
    assert go("{{ x.__class__ }}{{ x['__class__'] }}{{ ''.__class__.__mro__ }}", x="s") == ""


def test_only_numbers_are_multiplied():
    assert go("{{ n * 3 }}", n=2) == "6"
    for a in ("a", [1]):
        with pytest.raises(chat.TemplateError):
            go("{{ x * 1000000 }}", x=a)


def test_folding():
    tree = chat.fold_body(chat.parse("a{{ 'b' ~ 1 + 1 }}{% if false %}x{% else %}c{% endif %}{{ m }}"))
    assert tree[-1] == ("out", ("name", "m")) and len(tree) == 2 and tree[0][0] == "text"


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows if r[0] is not None}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: [(x is not None, x) for x in r[1:4]])
        text, spans = "", []
        for _, _, role, said in turns:
            text += f"<|im_start|>{role or ''}\n"
            start = len(text)
            text += f"{said or ''}<|im_end|>"
            if role == "assistant":
                spans.append(f"{start}:{len(text)}")
            text += "\n"
        out[conv] = (len(turns), text, ",".join(spans))
    return out


def test_conversations_match_plain_python(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in chat.render(spark.read.parquet(f"{sf}/conversations.parquet")).collect()}
    assert got == plain(rows)


def test_edge_cases(spark):
    rows = [(1, 1, "assistant", "{{ x }}"), (1, 0, "user", None), (1, None, None, ""), (None, 0, "user", "lost"), (2, 0, "assistant", "y" * 200_000), (2, 0, "assistant", "y" * 200_000), (3, 0, "user", "é"), (3, 1, "assistant", "ü")]
    df = spark.createDataFrame([(*r, "m") for r in rows], SCHEMA)
    assert {r.conv_id: tuple(r)[1:] for r in chat.render(df).collect()} == plain(rows)
    assert chat.render(df.where("false")).count() == 0


def test_loops_of_any_length_are_rendered():
    many = 1_200_000
    text, _ = chat.compile_template("{% for m in messages %}{{ m }}{% endfor %}{% for x in other %}{{ x }}{% endfor %}")({"messages": ["a"] * many, "other": "b" * many})
    assert text == "a" * many + "b" * many


def test_one_conversation_of_many_turns(spark):
    from pyspark.sql import functions as F

    df = spark.range(1_100_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    r = chat.render(df).select("conv_id", "n_turns", F.length("rendered").alias("n")).collect()
    assert [tuple(x) for x in r] == [(1, 1_100_000, 1_100_000 * len("<|im_start|>user\nx<|im_end|>\n"))]
