"""Ground-truth files and what they are refused for."""

import json

import pytest

from millrace.sources import io

CASE = {"pdf": "a.pdf", "question": "q", "metric": "m", "expected_value": "1,5", "expected_page": 3}


@pytest.mark.parametrize("text", [json.dumps([CASE]), json.dumps({"cases": [CASE]}), json.dumps([CASE], indent=1)])
def test_forms(spark, tmp_path, text):
    (tmp_path / "t.json").write_text(text)
    assert [r.asDict() for r in io.read_ground_truth(spark, str(tmp_path / "t.json")).collect()] == [CASE]


@pytest.mark.parametrize("cases", [[], [CASE, CASE], [CASE | {"metric": ""}], [CASE | {"expected_page": 0}], [CASE | {"expected_page": "x"}], [{"pdf": "a"}]])
def test_refused(spark, tmp_path, cases):
    (tmp_path / "t.json").write_text(json.dumps(cases))
    with pytest.raises(io.Refused):
        io.read_ground_truth(spark, str(tmp_path / "t.json"))
