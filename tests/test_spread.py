"""Work a task is bounded: rows of a partition, calls to the state."""
import pandas as pd

from tessera.functions.plan import spread
from tessera.streaming.acceptance import BUCKETS, Acceptance


def test_many_narrow_rows_are_dealt_over_more_partitions_than_cores(spark):
    rows = spark.range(0, 5_000_000, numPartitions=1)
    assert spread(rows).rdd.getNumPartitions() >= 100
    assert spread(spark.range(0, 40, numPartitions=1), min_partitions=2).rdd.getNumPartitions() == 2


class State(dict):
    calls = 0

    def exists(self):
        return () in self

    def get(self):
        return self[()]

    def update(self, value):
        self[()] = value

    def containsKey(self, key):
        self.calls += 1
        return key in self

    def getValue(self, key):
        self.calls += 1
        return self[key]

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        self.pop(key, None)

    def iterator(self):
        return iter(self.items())


class Handle:
    def __init__(self):
        self.said = State()

    def getValueState(self, name, schema):
        return State()

    def getMapState(self, name, *schemas):
        return self.said

    def registerTimer(self, at):
        pass

    def getCurrentWatermarkInMs(self):
        return 0


def test_calls_to_the_state_do_not_grow_with_the_lines():
    handle, made = Handle(), Acceptance()
    made.init(handle)
    lines = pd.DataFrame({"line": [f"{i % 20_000}|p" for i in range(30_000)], "verdict": "accepted", "day_ms": 0})
    out = next(made.handleInputRows(("EU", "v", 0), iter([lines]), handle))
    assert tuple(out.iloc[0][["n", "n_accepted"]]) == (20_000, 20_000)
    assert handle.said.calls <= 3 * BUCKETS
    gone = lines.assign(verdict=None)[:20_000]
    assert next(made.handleInputRows(("EU", "v", 0), iter([gone]), handle)).iloc[0]["n"] == 0 and not handle.said


def test_a_join_is_dealt_out_though_its_scan_has_many_partitions(spark, tmp_path):
    for name, n, key in (("orders", 400, "o_orderkey"), ("customer", 40, "c_custkey")):
        spark.range(n).withColumnRenamed("id", key).repartition(12).write.parquet(str(tmp_path / name))
    orders, customer = spark.read.parquet(str(tmp_path / "orders")), spark.read.parquet(str(tmp_path / "customer"))
    joined = orders.join(customer.hint("merge"), orders["o_orderkey"] % 40 == customer["c_custkey"])
    assert spread(orders, min_partitions=2, rows_each=100).rdd.getNumPartitions() == orders.rdd.getNumPartitions() > 4
    out = spread(joined, probe=orders, min_partitions=2, rows_each=100, merged=True)
    assert out.rdd.getNumPartitions() == 4 and out.count() == 400
