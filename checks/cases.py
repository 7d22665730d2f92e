"""A case table drawn from the supplied tables: one case per order line.

The Spark view joins only the tables its columns come from. The keys are declared foreign
keys, so a join that contributes no column neither adds nor removes lines; the SQL view
joins everything, and the two agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


# column: (tables besides lineitem it is drawn from, expression both engines read)
COLUMNS: dict[str, tuple[str, str]] = {
    "ord1": ("", "l_orderkey"),
    "ord2": ("", "l_linenumber"),
    "ord3": ("", "l_extendedprice"),
    "case_id_1": ("", "concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)))"),
    "source": ("region", "r_name"),
    "juris_or_proj_nm": ("", "concat('AG-', cast(l_suppkey % 7 as varchar(20)))"),
    "legal_nm": ("customer", "c_name"),
    "trade_nm": ("supplier", "case when l_suppkey % 4 = 0 then '' else s_name end"),
    "street_addr": ("part", "concat(cast(p_size as varchar(20)), ' ', p_name, ' ST')"),
    "cty_nm": ("nation", "case when l_partkey % 13 = 0 then null else n_name end"),
    "st_cd": ("nation", "case when n_regionkey = 0 then 'CA' when n_regionkey = 1 then '' "
                        "when n_regionkey = 2 then null else 'NV' end"),
    "zip_cd": ("orders", "lpad(cast(o_custkey % 1000 as varchar(20)), 5, '0')"),
    "naic_cd": ("part", "cast(p_size as varchar(20))"),
    "naics_desc": ("part", "concat(p_type, ' ', p_name)"),
    "industry": ("customer", "case when l_partkey % 9 = 0 then '' else c_mktsegment end"),
    "violation": ("", "concat('Issue ', l_returnflag, ' Issue ', l_linestatus)"),
    "violtn_cnt": ("", "case when l_suppkey % 5 = 0 then 0 else l_linenumber end"),
    "ee_violtd_cnt": ("", "case when l_partkey % 11 = 0 then null else cast(l_quantity as int) end"),
    "bw_amt": ("", "case when l_partkey % 10 = 0 then null else cast(l_extendedprice as decimal(18,2)) end"),
    "ee_pmt_recv": ("", "cast(cast(l_extendedprice as decimal(18,2)) * "
                        "(cast(l_discount as decimal(4,2)) * 10) as decimal(18,2))"),
    "interest_paid": ("", "cast(cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(4,2)) as decimal(18,2))"),
    "findings_start_date": ("orders", "case when o_orderkey % 7 = 0 then null else cast(o_orderdate as date) end"),
    "findings_end_date": ("", "case when l_orderkey % 11 = 0 then null else cast(l_shipdate as date) end"),
    "case_status": ("orders", "case when o_orderkey % 17 = 0 then null when o_orderstatus = 'F' then 'Closed' "
                              "when o_orderstatus = 'O' then 'Open' else 'P' end"),
}

ORDER = ["ord1", "ord2", "ord3"]

_JOINS = {  # table: (its key, the key it is reached by, the table that holds that key)
    "orders": ("o_orderkey", "l_orderkey", ""),
    "customer": ("c_custkey", "o_custkey", "orders"),
    "nation": ("n_nationkey", "c_nationkey", "customer"),
    "region": ("r_regionkey", "n_regionkey", "nation"),
    "supplier": ("s_suppkey", "l_suppkey", ""),
    "part": ("p_partkey", "l_partkey", ""),
}


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A supplied table; its schema is read from the file once, not by a job per query."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def cases(spark: SparkSession, sf: str, columns: list[str] | None = None,
          extra: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """The case table with the given columns; ``extra`` adds or replaces some, written the same way."""
    defined = {**COLUMNS, **(extra or {})}
    columns = [*(columns or list(COLUMNS)), *[c for c in (extra or {}) if c not in (columns or COLUMNS)]]
    needed: set[str] = set()

    def need(name: str) -> None:
        if name:
            needed.add(name)
            need(_JOINS[name][2])

    def reached(name: str) -> DataFrame:
        """A table with all that is looked up through it, so that these columns are shuffled with its rows and not
        with the lines, of which there are several to each. Orders grow with the lines, so the two meet in a shuffle at
        any size: neither is ever broadcast."""
        rows = table(spark, sf, name or "lineitem")
        for other, (own, reached_by, holder) in _JOINS.items():
            if other in needed and holder == name:
                side = reached(other)
                rows = rows.join(side.hint("merge") if other == "orders" else side, F.col(reached_by) == F.col(own))
        return rows

    for c in columns:
        for name in defined[c][0].split():
            need(name)
    joined = reached("")
    return joined.select(*[F.expr(defined[c][1]).alias(c) for c in columns])


def cases_sql(extra: dict[str, tuple[str, str]] | None = None, name: str = "cases") -> str:
    """The same table as a common table expression (without WITH)."""
    defined = {**COLUMNS, **(extra or {})}
    listed = ",\n  ".join(f'{e} AS "{c}"' for c, (_, e) in defined.items())
    return (f"{name} AS (SELECT {listed}\n FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
            "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
            "JOIN region ON n_regionkey = r_regionkey JOIN supplier ON l_suppkey = s_suppkey "
            "JOIN part ON l_partkey = p_partkey)")
