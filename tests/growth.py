"""Small tables in which everything is close together, and the largest number of rows that any step of a query made over them."""

from __future__ import annotations

import duckdb


def crowded(folder, times: int) -> str:
    """customer, supplier and events of sf0.001 repeated with shifted keys, nation, part as they are: many rows around the same places."""
    con = duckdb.connect()
    for table, key in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("events", "event_id"), ("nation", None), ("part", None)):
        source = f"'/root/testdata/sf0.001/{table}.parquet'"
        if key:
            span = con.execute(f"SELECT max({key}) + 1 FROM {source}").fetchone()[0]
            rows = f"SELECT t.* REPLACE (CAST({key} + k * {span} AS BIGINT) AS {key}) FROM {source} t, range({times}) r(k)"
        else:
            rows = f"SELECT * FROM {source}"
        con.execute(f"COPY ({rows}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    return str(folder)


def most_rows(spark, run) -> int:
    """The most rows that one node of the plans run by `run` put out."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most = 0
    executions = store.executionsList(int(before), 10_000)
    for k in range(executions.size()):
        ident = executions.apply(k).executionId()
        values, nodes = store.executionMetrics(ident), store.planGraph(ident).allNodes()
        for n in range(nodes.size()):
            metrics = nodes.apply(n).metrics()
            for m in range(metrics.size()):
                if metrics.apply(m).name() == "number of output rows":
                    value = values.get(metrics.apply(m).accumulatorId())
                    most = max(most, int(value.get().replace(",", "")) if value.isDefined() else 0)
    return most
