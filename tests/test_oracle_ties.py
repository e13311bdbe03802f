"""Oracle SQL on the hand fixture H1, which has tied timestamps.

The driver's tables have no (user, ts) ties, so the fan-out (Q6) and the
fill order on ties are checked here: DuckDB runs the oracle CTEs over a
``fl`` table built from H1, Spark runs the operators, results must agree.
"""

import duckdb
import pyarrow as pa
import pytest

from churnlab.operators import listens as L
from churnlab.operators import matrix as M
from churnlab.operators.events import drop_blank_users, with_flags
from churnlab.functions import event_date
from churnlab.plans import oracle as O
from churnlab.plans.catalog import round_doubles
from fixtures import h1


def _duck_with_fl(spark):
    ev = with_flags(drop_blank_users(h1(spark))).withColumn("date", event_date("ts"))
    con = duckdb.connect()
    con.register("fl_arrow", ev.toArrow())
    con.execute("CREATE TABLE fl AS SELECT * FROM fl_arrow")
    return con


def _rows(tab: pa.Table):
    cols = sorted(tab.column_names)
    rows = [tuple(tab.column(c).to_pylist()[i] for c in cols) for i in range(tab.num_rows)]
    return sorted(rows, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


@pytest.mark.parametrize("fanout", [False, True])
def test_matrix_sql_and_spark_agree_on_ties(spark, fanout):
    con = _duck_with_fl(spark)
    ctes = O._with(O.WEIGHTS, O.MATRIX_FANOUT) if fanout else O._with(O.MATRIX)
    want = con.sql(ctes + f"\nSELECT {O.MATRIX_SELECT} FROM matrix").to_arrow_table()
    got = round_doubles(M.user_matrix(drop_blank_users(h1(spark)), fanout=fanout)).toArrow()
    assert _rows(got) == _rows(want)


def test_running_sql_and_spark_agree_on_ties(spark):
    con = _duck_with_fl(spark)
    want = con.sql(O._with(O.RUNNING) + "\nSELECT seq, running_listens_mon, running_listens_mon_fill FROM runf").to_arrow_table()
    got = L.filled_running_listens(drop_blank_users(h1(spark))).select("seq", "running_listens_mon", "running_listens_mon_fill").toArrow()
    assert _rows(got) == _rows(want)
