import json

import pyarrow as pa

from quarrystone.functions import json_tree as J


def test_few_documents_are_python_values_at_a_time(monkeypatch):
    held, seen = [], []
    monkeypatch.setattr(J.F, "arrow_udf", lambda kind: lambda run: held.append(run) or (lambda c: c))
    monkeypatch.setattr(J.json, "loads", lambda x, loads=json.loads: seen.append(x) or loads(x))
    monkeypatch.setattr(J, "col", lambda c: c)
    J.examined("x")
    texts = ['{"author":"a","raw response":"%d"}' % i for i in range(1000)]
    out = held[0](iter([pa.array([*texts, None, "no"])]))
    first = next(out)
    assert len(first) == len(seen) == J.SLICE and first[0].as_py() == {"value": '{"author":"[ANONYMIZED]","raw response":"0"}', "error": None, "places": ["$.raw response"]}
    rest = pa.concat_arrays(list(out)).to_pylist()
    assert len(rest) == 1002 - J.SLICE and rest[-2:] == [{"value": None, "error": None, "places": None}, {"value": None, "error": "no JSON", "places": ["$"]}]
