"""Templates as Columns: fields, filters, conditions, loops, helpers, precedence, errors."""

import pytest

from cinderloom.functions import templates

SCHEMA = "id int, text string, label string, score double, tags array<string>, samples array<struct<text:string,label:int>>, choices struct<label:array<string>,text:array<string>>, person struct<name:string,age:int>, extra map<string,string>"
ROWS = [
    (1, "hello", "pos", 0.5, ["a", "b"], [("x", 1), ("y", None)], (["A", "B", "C"], ["evaporation", "condensation", "sublimation"]), ("Kim", 30), {"k": "v"}),
    (2, None, "", 0.0, [], None, None, None, None),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


CASES = {
    "plain": ("plain", "plain"),
    "{{ text }} / {{label}}": ("hello / pos", " / "),
    "{{ text | upper }}{{ text | default('none') }}": ("HELLOhello", "none"),
    "{{ tags | join(', ') }} {{ tags | length }}": ("a, b 2", " 0"),
    "{{ person.name }} {{ person.age }}{{ extra.k }}": ("Kim 30v", " "),
    "{% if text %}T{% else %}F{% endif %}{% if not tags %}!{% endif %}{% if score %}s{% endif %}": ("Ts", "F!"),
    "{% if label == 'pos' %}+{% else %}-{% endif %}{% if label != \"pos\" %}x{% endif %}": ("+", "-x"),
    "{% for s in samples %}{{ loop.index }}={{ s.text }}:{{ s.label | default('?') }};{% endfor %}": ("1=x:1;2=y:?;", ""),
    "{% for t in tags %}{% if t == 'a' %}[{{ t }}]{% else %}{{ t | upper }}{{ text }}{% endif %}{% endfor %}": ("[a]Bhello", ""),
    "{% for s in samples %}{% for t in tags %}{{ s.text }}{{ t }} {% endfor %}{% endfor %}": ("xa xb ya yb ", ""),
    "{{ format_choices(choices) }}": ("A. evaporation\nB. condensation\nC. sublimation", ""),
    "{{ format_samples(samples) }}": ("1. x\n   label: 1\n2. y\n   label: ", ""),
    "{{ class_taxonomy(tags) }}{# a note #}": ("0: a\n1: b", ""),
    "{{ 'a|b' }} 100% {x} }}": ("a|b 100% {x} }}", "a|b 100% {x} }}"),
}


def test_cases_are_one_column_each(rows):
    columns = [templates.rendered(rows, t).alias(f"c{i}") for i, t in enumerate(CASES)]
    df = rows.select("id", *columns)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        for i, wanted in enumerate(CASES.values()):
            assert r[f"c{i}"] == wanted[r["id"] - 1]


def test_rows_over_variables_over_configuration(rows):
    said = templates.rendered(rows, "{{ text }}|{{ operator }}|{{ cycles }}|{% for n in names %}{{ n }},{% endfor %}|{{ format_samples(shots) }}", {"text": "no", "operator": "repair", "names": ["u", "v"], "shots": [{"text": "q", "label": 2}]}, {"operator": "no", "cycles": 3})
    assert [r[0] for r in rows.orderBy("id").select(said).collect()] == ["hello|repair|3|u,v,|1. q\n   label: 2", "|repair|3|u,v,|1. q\n   label: 2"]


def test_unknown_names(rows):
    with pytest.raises(templates.TemplateError, match="missing is not known; there are: .*text"):
        templates.rendered(rows, "{{ missing }}")
    with pytest.raises(templates.TemplateError):
        templates.rendered(rows, "{% for s in samples %}{{ s.nothing }}{% endfor %}")
    lenient = templates.rendered(rows, "<{{ missing }}{% if missing %}x{% endif %}{% for m in missing %}y{% endfor %}{{ person.none }}>", strict=False)
    assert {r[0] for r in rows.select(lenient).collect()} == {"<>"}
    assert {r[0] for r in rows.select(templates.rendered(rows, "{{ missing | default('d') }}")).collect()} == {"d"}


@pytest.mark.parametrize("bad", ["{% if text %}", "{% endfor %}", "{% for x of tags %}{% endfor %}", "{{ text + 1 }}", "{{ text | shout }}", "{{ nothing(text) }}", "{% for x in text %}{% endfor %}", "{% if a b %}{% endif %}", "{% else %}"])
def test_templates_that_can_not_be_read(rows, bad):
    with pytest.raises(templates.TemplateError):
        templates.rendered(rows, bad)
