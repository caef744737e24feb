"""Compiled templates against the text that each says, row by row."""

import json

import pytest
from pyspark.sql import functions as F

from chatloom.operators import training
from chatloom.operators.templates import MODELS, TemplateError, compiled, from_config, model_text

ROWS = [
    (1, [("user", " hi "), ("assistant", "yo\n"), ("user", "bye")]),
    (2, [("system", " be kind "), ("user", "a"), ("assistant", "b")]),
    (3, [("assistant", "x")]),
    (4, []),
    (5, None),
    (6, [("user", None)]),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "k int, turns array<struct<role:string,text:string>>")


def _texts(rows, template, **names):
    return {r.k: r.x for r in rows.select("k", compiled(template, F.col("turns"), **names).alias("x")).collect()}


def test_models_say_what_their_families_say(rows):
    plain = rows.where("k in (1, 3, 6)")
    for model, family in MODELS.items():
        got = {r.k: (r.a, r.b) for r in plain.select("k", model_text(model, F.col("turns"), True).alias("a"), training.chat_text(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))), family, ask=True).alias("b")).collect()}
        assert all(a == b for a, b in got.values()) and (got[3][0] is None) == (family == "turn")
    assert len(MODELS) == 13 and set(MODELS.values()) == set(training.FAMILIES)
    with pytest.raises(TemplateError):
        model_text("other", F.col("turns"))


def test_conditions_sets_and_slices(rows):
    template = """
{%- if tools %}{{ tools | tojson }}{% macro x() %}{% endif %}
"""
    with pytest.raises(TemplateError):
        compiled(template, F.col("turns"))  # a block that is not known can't be skipped
    template = """{#- a note -#}
{%- if tools is defined and tools %}
    {{- tools | tojson(indent=4) }}
{%- elif messages[0]['role'] == 'system' or not messages %}
    {%- set head = 'S:' + messages[0]['content'] | trim %}
    {%- set rest = messages[1:] %}
{%- else %}
    {%- set head = 'no system' %}
    {%- set rest = messages %}
{%- endif %}
{{- head ~ '|' ~ rest | length }}
    {% for message in rest %}
        {%- if not (message.role == 'tool' or 'tool_calls' in message) %}
            {{- '\\n' + loop.index ~ '/' ~ loop.length + message['role'] + ("=" if_none) }}
        {%- endif %}
    {% endfor %}"""
    with pytest.raises(TemplateError):
        compiled(template, F.col("turns"))
    template = template.replace("""'\\n' + loop.index ~ '/' ~ loop.length + message['role'] + ("=" if_none)""", """'\\n' ~ loop.index ~ '/' ~ loop.length ~ message['role'] ~ '=' ~ message.content""")
    got = _texts(rows, template)
    assert got[1] == "no system|3\n\n1/3user= hi \n2/3assistant=yo\n\n3/3user=bye"
    assert got[2] == "S:be kind|2\n\n1/2user=a\n2/2assistant=b"
    assert got[4] == "S:|0\n" and got[5] is None and got[6] == "no system|1\n\n1/1user="


def test_loops_first_last_and_exceptions(rows):
    template = "{% for m in messages %}{% if loop.first %}<{% endif %}{% if m.content is string and m.content is not mapping %}{{ m.role }}{% endif %}{% if m.role == 'system' %}{{ raise_exception('no') }}{% endif %}{% if not loop.last %},{% else %}>{% endif %}{% endfor %}"
    assert _texts(rows, template) == {1: "<user,assistant,user>", 2: None, 3: "<assistant>", 4: "", 5: None, 6: "<user>"}
    assert _texts(rows, "{{ bos_token }}{{ missing }}{% if add_generation_prompt %}!{% endif %}{{ 7 % 4 ~ none }}", ask=True, bos_token="<s>")[1] == "<s>!3None"
    assert _texts(rows, "{% if messages %}yes{% else %}no{% endif %}")[4] == "no"


@pytest.mark.parametrize("bad", ["{% block x %}{% endblock %}", "{% if a %}", "{{ a | upper }}", "{% for x in names %}{% endfor %}", "{{ namespace(a=1) }}", "{% set ns.x = 1 %}", "{{ 1 + }}", "{{ messages }}", "{% set a, b = 1 %}", "{{ messages[:2] }}", "{{ f'x' }}", "{{ a ? b }}", "{% endif %}", "{{ 'a' is odd }}"])
def test_unknown_syntax_is_an_error(spark, bad):
    with pytest.raises(TemplateError):
        compiled(bad, F.col("turns"))


def test_a_tokenizers_configuration(spark, rows, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"chat_template": "{{ bos_token }}{% for m in messages %}{{ m.content }}{{ eos_token }}{% endfor %}", "bos_token": {"content": "<s>"}, "eos_token": "</s>", "pad_token": None}))
    template, tokens = from_config(spark, str(tmp_path / "c.json"))
    assert tokens == {"bos_token": "<s>", "eos_token": "</s>"} and _texts(rows, template, **tokens)[3] == "<s>x</s>"
    (tmp_path / "d.json").write_text("{}")
    with pytest.raises(TemplateError):
        from_config(spark, str(tmp_path / "d.json"))
