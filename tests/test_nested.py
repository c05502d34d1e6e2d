import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from biblioforge.operators import nested as N

DOC = {"message": {"DOI": "10.1/a", "title": ["T \\ \" {x}"], "reference": [{"author": "A, B"}, None, {"author": [{"family": "C"}, {"name": "D"}]}, {"author": " "}, {"key": "k", "unstructured": "a\nb"}]}}
LINKS = [(1, 1), (3, 1), (3, 2), (4, 0), (5, 0)]


def links(text: str) -> list[tuple[int, int]]:
    out = []
    for ix, num, obj in N.documents_of([text.encode()]):
        _, r, a = N._rows(ix, obj, "ids", np.array([7])[num])
        out += list(zip(r.tolist(), a.tolist()))
    return sorted(out)


@pytest.mark.parametrize("wrap", [json.dumps, lambda d: json.dumps(d, indent=1), lambda d: json.dumps(json.dumps(d)), lambda d: json.dumps([d]), lambda d: json.dumps(d, ensure_ascii=False)])
def test_links(wrap):
    assert links(wrap(DOC)) == LINKS


def test_any_number_of_wraps_comes_off():
    text = json.dumps(DOC)
    for i in range(7):
        text = json.dumps(text) if i % 2 else f"[{text}]"
    assert links(text) == LINKS


def test_long_blanks_and_odd_scalars():
    doc = {"message": {"reference": [{"author": " " * 500}, {"author": "\u3000\t"}, {"author": -1.5e3, "year": 2001, "volume": None, "key": "a\\b\"c", "DOI": True}]}}
    assert links(json.dumps(doc)) == [(1, 0), (2, 0), (3, 1)]
    for ix, num, obj in N.documents_of([json.dumps(doc).encode()]):
        rows = [c.to_pylist() if hasattr(c, "to_pylist") else list(c) for c in N._rows(ix, obj, "references", np.array([7])[num])]
        assert [rows[k][2] for k in (2, 3, 5, 6)] == ['a\\b"c', "true", "2001", None]


@pytest.mark.parametrize("text", ["", "null", "[]", '"x"', "{}", '{"message": null}', '{"message": {}}', '{"message": {"reference": []}}', '{"a": 1,}', '{"a" 1}', '{"a": tru}', '{"a": "\\x"}', '{"a": 01}', '{"message": {"reference": [{"author": "A"}]}', '{"message": {"reference": [{"author": "A"}]}} x'])
def test_no_rows(text):
    assert links(text) == []


def test_lone_objects_and_keys():
    assert links('{"message": {"reference": {"author": {"family": "A"}}}}') == [(1, 1)]
    assert links('{"message": {"reference": [{"\\u0061uthor": "A"}]}}') == [(1, 1)]
    assert links('{"message": {"reference": [1]}, "message": {"reference": [{"author": "A"}]}}') == [(1, 1)]
    assert links('{"x": {"message": {"reference": [{"author": "A"}]}}}') == []


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=6) | st.floats(allow_nan=False, allow_infinity=False), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(values, st.integers(0, 60), st.sampled_from(['"', "{", "}", "[", "]", ",", ":", "\\", "x", ""]))
def test_grammar_agrees_with_a_parser(value, at, new):
    text = json.dumps(value)
    text = text[:at] + new + text[at + 1 :] if new else text
    try:
        json.loads(text)
        good = "NaN" not in text and "Infinity" not in text
    except ValueError:
        good = False
    raw, starts = N._lay([text.encode(), text.encode()])
    ix = N.index(raw, starts)
    assert ix.good.tolist() == [good, good]


def test_tables(spark):
    df = spark.createDataFrame([(1, json.dumps(DOC), "x"), (2, None, "y"), (1, json.dumps(DOC), "z"), (None, "{}", "n")], "raw_id bigint, payload string, ref_index string")
    assert N.flatten(df).count() == 10
    r = N.flatten(df.limit(1), "references").collect()
    assert [x.ref_index for x in r] == [1, 3, 4, 5] and r[3].unstructured == "a\nb"
    assert sorted(x.family for x in N.flatten(df.limit(1), "authors").collect() if x.author_index) == ["A, B", "C", "D"]
    assert N.flatten(df.limit(1), "documents").first().doc_title == 'T \\ " {x}'
    assert N.flatten(df.limit(0)).count() == 0
