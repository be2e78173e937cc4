import pandas as pd
from pyspark.sql import types as T

from quarrystone.streaming.latest import ORDER, Keeper


class Held:
    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls += 1
        self.value = value


def test_a_key_costs_one_read_and_one_write_of_its_state():
    keeper = Keeper(T.StructType([T.StructField("v", T.StringType())]), ["k", "change", "o", "kept", "v"], "last", None)
    keeper.held = Held()
    rows = lambda *r: iter([pd.DataFrame(r, columns=[ORDER, "p0"])])
    made = pd.concat(keeper.handleInputRows((1,), rows((3, "c"), (1, "a"), (3, "d"), (2, None)), None))
    assert made.values.tolist() == [[1, 1, 1, True, "a"], [1, 2, 2, True, None], [1, 3, 3, True, "c"]]
    made = pd.concat(keeper.handleInputRows((1,), rows((4, "c"), (5, "e")), None))
    assert made.values.tolist() == [[1, 4, 5, True, "e"]] and keeper.held.calls == 4
