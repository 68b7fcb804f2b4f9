"""DuckDB text of the logical-table binding, used only by the oracle SQL of the registry.

Each entry is the SQL twin of one ``Catalog`` method in ``wardlight.sources.tables``; the
registry prefixes an oracle query with ``WITH <views it needs>``.
"""

from __future__ import annotations

VIEWS = {
    "patients": """SELECT c_custkey AS id, CAST(c_custkey % 5 AS VARCHAR) AS tenant_id,
        split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
        CASE WHEN c_nationkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender,
        CASE WHEN c_acctbal >= 0 THEN strftime(DATE '1950-01-01' + CAST(c_custkey % 20000 AS INTEGER), '%Y-%m-%d')
             ELSE '' END AS dob,
        c_mktsegment AS segment, c_nationkey AS nation_id, c_acctbal AS balance FROM customer""",
    "doctors": """SELECT s_suppkey AS id, CAST(s_suppkey % 5 AS VARCHAR) AS tenant_id,
        split_part(s_name, '#', 1) AS first_name, split_part(s_name, '#', 2) AS last_name,
        CAST(floor(abs(s_acctbal) / 500) AS INTEGER) AS experience,
        CAST(s_nationkey AS VARCHAR) AS doctor_department_id,
        CASE WHEN s_acctbal >= 0 THEN 'Specialty ' || CAST(s_nationkey % 7 AS VARCHAR) ELSE '' END AS specialist
        FROM supplier""",
    "appointments": """SELECT o_orderkey AS id, CAST(o_custkey % 5 AS VARCHAR) AS tenant_id,
        o_custkey AS patient_id, o_custkey // 15 AS doctor_id, o_orderdate AS opd_date,
        CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 WHEN 'O' THEN 4 END AS status,
        o_orderpriority AS department_id, o_totalprice AS amount,
        o_orderdate AS created_at, o_orderdate AS updated_at FROM orders""",
    "prescriptions": """SELECT o_orderkey AS id, CAST(o_custkey % 5 AS VARCHAR) AS tenant_id,
        o_custkey AS patient_id, o_custkey // 15 AS doctor_id, o_orderstatus AS status,
        o_orderpriority AS problem, CASE WHEN o_orderstatus = 'F' THEN 'CBC' ELSE '' END AS test,
        CASE WHEN o_totalprice > 250000 THEN 'Rest and fluids' END AS advice,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS diabetic,
        o_orderdate AS created_at, o_orderdate AS updated_at FROM orders""",
    "items": """SELECT CASE l_returnflag WHEN 'A' THEN 'prescription_medicines'
             WHEN 'N' THEN 'prescription_items' WHEN 'R' THEN 'opd_prescription_items' END AS source_table,
        l_orderkey AS prescription_id, l_linenumber AS line_no, l_partkey AS part_id,
        l_suppkey AS supplier_id, l_extendedprice AS price, p_name AS medicine_name,
        CAST(l_quantity AS VARCHAR) AS dosage, CAST(l_linenumber AS VARCHAR) || ' days' AS duration,
        CASE WHEN l_linestatus = 'O' THEN 'morning' ELSE 'night' END AS time,
        CASE WHEN l_discount >= 0.05 THEN 'after food' ELSE '' END AS comment
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'N', 'R')""",
    "holidays": """SELECT l_suppkey AS doctor_id, CAST(l_suppkey % 5 AS VARCHAR) AS tenant_id,
        CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE l_returnflag = 'R'""",
    "messages": """SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, role, text AS content
        FROM conversations""",
    "vectors": """SELECT vec_id AS id, CAST(label AS VARCHAR) AS tenant_id, embedding FROM embeddings""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n"
