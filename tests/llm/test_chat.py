import pytest
from compare import assert_same

from gridstat.llm import chat


def test_query_agrees_with_sql(spark, data, duck):
    assert_same(chat.op8_chat(spark, data).toPandas(), duck.execute(chat.OP8_SQL).df())


@pytest.mark.parametrize("text", ["", "\\", "<|end|>\n", "<\\|end|>", "</s>[INST] ok [/INST]", "\\<|turn|>\\\\", "<|<|end|>end|>", "a\x00n\\\x00n", "<s", "中\n🙂"])
def test_escapes_are_reversible(text):
    for f in (chat.escape, chat.escape_line):
        out = f(text)
        assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)
    assert "\n" not in chat.escape_line(text)


def render(template, messages):
    return list(chat.compile_template(template)(messages))


def text(template, messages=()):
    return "".join(t for t, _ in render(template, messages))


def test_language():
    m = [{"role": "user", "text": " Hi "}, {"role": "assistant", "text": "yo"}]
    assert text("{% for m in messages %}{{ loop.index }}{% if loop.last %}!{% elif m.role == 'user' and not loop.last %}?{% else %}-{% endif %}{{ m['text'] | trim | upper }}{% endfor %}", m) == "1?HI2!YO"
    assert text("{% set x = 'a' + \"b\" %}{{ x + '\\n' }}{{ 1 }}") == "ab\n1"
    pieces = render("{% for m in messages %}{% generation %}{{ m.text }}{% endgeneration %};{% endfor %}", m)
    assert [t for t, g in pieces if g] == [" Hi ", "yo"]


#: Public templates' idioms: marks around turns, a system message first, a prompt for generation.
MARKED = (
    "{# turns in marks #}{% for message in messages %}{{'<|im_start|>' + message['role'] + '\\n' + message['content'] + '<|im_end|>' + '\\n'}}{% endfor %}"
    "{% if add_generation_prompt is defined and add_generation_prompt %}{{ '<|im_start|>assistant\\n' }}{% endif %}"
)
BRACKETED = """
{%- if messages[0]['role'] == 'system' -%}
  {%- set system = messages[0]['content'] -%}
  {%- set rest = messages[1:] -%}
{%- else -%}
  {%- set rest = messages -%}
{%- endif -%}
{%- for message in rest -%}
  {%- if (message['role'] == 'user') != (loop.index0 % 2 == 0) -%}
    {{- raise_exception('roles must alternate') -}}
  {%- endif -%}
  {%- if message['role'] == 'user' -%}
    {{- bos_token + '[INST] ' + ('<<SYS>>' + system + '<</SYS>>' if loop.first and system is defined else '') + message['content'].strip() + ' [/INST]' -}}
  {%- elif message['role'] not in 'user system' -%}
    {%- generation -%}{{ ' ' + message.content | trim + ' ' + eos_token }}{%- endgeneration -%}
  {%- endif -%}
{%- endfor -%}
"""


def test_public_idioms():
    said = lambda *rows: [{"role": r, "text": t, "content": t} for r, t in rows]
    go = lambda template, messages, **names: "".join(t for t, _ in chat.compile_template(template, names)(messages))
    m = said(("user", " Hi "), ("assistant", "yo"))
    assert go(MARKED, m) == "<|im_start|>user\n Hi <|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert go(MARKED, m, add_generation_prompt=True).endswith("<|im_start|>assistant\n")
    marks = {"bos_token": "<s>", "eos_token": "</s>"}
    assert go(BRACKETED, m, **marks) == "<s>[INST] Hi [/INST] yo </s>"
    assert go(BRACKETED, iter(said(("system", "be kind"), *(("user", "a"), ("assistant", "b")))), **marks) == "<s>[INST] <<SYS>>be kind<</SYS>>a [/INST] b </s>"
    assert [t for t, g in chat.compile_template(BRACKETED, marks)(m) if g] == [" yo </s>"]
    for bad in (said(("assistant", "b")),):
        with pytest.raises(chat.TemplateError):
            go(BRACKETED, bad, **marks)
    with pytest.raises(chat.TemplateError):
        go("{% for m in messages %}{% endfor %}{% for m in messages %}x{% endfor %}", m)
    with pytest.raises(chat.TemplateError):
        go("{{ 'a%s' % 'b' }}", m)
    assert go("{{ 'abc'[1] }}{{ 'abc'[1:] }}{{ 1 - 3 }}{{ nothing is not defined }}{{ none is none }} {# c #} {{- 'x' }}", m) == "bbc-2TrueTrue x"


def test_constants_are_folded():
    tree = chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if 1 == 1 %}d{% else %}e{% endif %}{% if 'x' == 'y' %}f{% endif %}{{ 'g' | upper }}"))
    assert [s.value.value for s in tree] == ["abc", "d", "G"] or "".join(s.value.value for s in tree) == "abcdG"


@pytest.mark.parametrize(
    "template",
    ["{{ x.__class__ }}", "{{ _x }}", "{{ f(1) }}", "{{ x | nope }}", "{% for m in messages %}", "{% endif %}", "{% import os %}", "{{ 'a }}", "{{ a b }}", "{% for 1 in x %}{% endfor %}", "{% set _y = 1 %}"],
)
def test_sandbox_and_syntax_errors(template):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(template)


def test_no_fields_of_plain_values():
    with pytest.raises(chat.TemplateError):
        text("{% set x = 'a' %}{{ x.upper }}")
    with pytest.raises(chat.TemplateError):
        text("{{ nothing }}")


def test_nulls_ties_and_long_conversations(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", ""), (2, None, "user", "a"), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"), (None, 0, "a\nb", "c")]
    rows += [(3, t, ("user", "assistant")[t % 2], f"text {t}") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS pieces")
    out = {r["conv_id"]: r for r in chat.format_digests(df).collect()}
    assert out[1]["n_turns"] == 2 and out[1]["loss_chars"] == 0
    assert out[2]["n_turns"] == 3 and out[2]["loss_chars"] == 2
    assert out[3]["n_turns"] == 3000 and out[None]["n_turns"] == 1
    assert chat.format_digests(df.limit(0)).count() == 0
    parts = chat.formatted(df.where("conv_id = 2")).orderBy("part").collect()
    assert "".join(p["text"] for p in parts if p["generated"]) == "bb"
