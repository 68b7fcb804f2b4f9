"""Query-log jobs: keyword labelling (R1), action routing (R2), model-reply parsing and repair
(R3: X12 + X13 + X19), request normalisation (X18) and result packing (A5).

All of it is column expressions plus one broadcast join against a fixed-size rules table, so a log
of any size is one narrow stage (R2 adds an ``explode``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.functions.text import truthy_or
from wardlight.plans.intent import DEFAULT_LIMIT, DEFAULT_TARGET, OPERATIONS

# Keyword lists of the rules (matched as lower-case substrings).
COUNT_WORDS = ("how many", "count", "total", "number of", "no of")
PDF_WORDS = ("pdf", "download", "export", "print")
LIST_WORDS = ("show", "get", "fetch", "list")
SEMANTIC_WORDS = ("who is", "tell me about", "explain")
BOOK_WORDS = ("book",)
# entity word → target, in override order
ENTITY_WORDS = (("patient", "patients"), ("doctor", "doctors"), ("prescription", "prescriptions"))


def _any_word(q: Column, words, whole_word: bool) -> Column:
    if whole_word:
        return q.rlike("\\b(" + "|".join(w.replace(" ", "\\s+") for w in words) + ")\\b")
    out = None
    for w in words:
        c = q.contains(w)
        out = c if out is None else (out | c)
    return out


def keyword_operation(q: Column, whole_word: bool = False) -> Column:
    """First-pass operation when no model label exists (documented keyword lists)."""
    return (F.when(_any_word(q, COUNT_WORDS, whole_word), F.lit("aggregate"))
            .when(_any_word(q, SEMANTIC_WORDS, whole_word), F.lit("semantic_lookup"))
            .when(_any_word(q, BOOK_WORDS, whole_word), F.lit("book"))
            .when(_any_word(q, ("pdf",), whole_word), F.lit("export_pdf"))
            .when(_any_word(q, LIST_WORDS, whole_word), F.lit("list"))
            .otherwise(F.lit("lookup")))


def label_queries(df: DataFrame, text_col: str = "query", op_col: str | None = None,
                  targets_col: str | None = None, whole_word: bool = False) -> DataFrame:
    """Adds ``operation``, ``targets`` (array) and ``target`` (first target / export rule).

    Overrides, in order: PDF words force ``export_pdf`` and put ``prescriptions`` first when
    absent; then the first of patient / doctor / prescription present in the text and absent from
    the targets is appended; for patient, a missing operation, or ``aggregate`` without a count
    word, becomes ``list``.
    """
    q = F.lower(F.col(text_col))
    op0 = F.col(op_col) if op_col else keyword_operation(q, whole_word)
    t0 = F.col(targets_col) if targets_col else F.array().cast("array<string>")
    is_count = _any_word(q, COUNT_WORDS, whole_word)
    is_pdf = _any_word(q, PDF_WORDS, whole_word)
    t1 = F.when(is_pdf & ~F.array_contains(t0, "prescriptions"),
                F.concat(F.array(F.lit("prescriptions")), t0)).otherwise(t0)
    op1 = F.when(is_pdf, F.lit("export_pdf")).otherwise(op0)
    conds = []
    taken = F.lit(False)
    for word, target in ENTITY_WORDS:
        hit = ~taken & q.contains(word) & ~F.array_contains(t1, target)
        conds.append((hit, target))
        taken = taken | hit
    t2 = t1
    for hit, target in reversed(conds):
        t2 = F.when(hit, F.concat(t1, F.array(F.lit(target)))).otherwise(t2)
    pat_hit = conds[0][0]
    op2 = F.when(pat_hit & (op1.isNull() | ((op1 == "aggregate") & ~is_count)), F.lit("list")).otherwise(op1)
    first = F.coalesce(F.try_element_at(t2, F.lit(1)), F.lit(DEFAULT_TARGET))
    target = F.when((op2 == "export_pdf") & F.array_contains(t2, "prescriptions"),
                    F.lit("prescriptions")).otherwise(first)
    return df.withColumn("operation", op2).withColumn("targets", t2).withColumn("target", target) \
        .withColumn("is_count", is_count)


# The routing table (operation → ordered actions). ``{op}`` and ``{targets}`` are
# filled per row; ``needs_rx`` rows apply only when ``prescriptions`` is a target.
ROUTES = [
    # operation, type, priority, description, needs_rx
    ("aggregate", "sql", 1, "Execute SQL for {op} on {targets}", False),
    ("list", "sql", 1, "Execute SQL for {op} on {targets}", False),
    ("lookup", "sql", 1, "Execute SQL for {op} on {targets}", False),
    ("lookup", "pdf", 2, "Generate prescription PDF document", True),
    ("book", "sql", 1, "Execute SQL for {op} on {targets}", False),
    ("export_pdf", "sql", 1, "Execute SQL for export_pdf on {targets}", False),
    ("export_pdf", "pdf", 2, "Generate prescription PDF document", False),
    ("semantic_lookup", "sql", 1, "Check structured data for entity details", False),
    ("semantic_lookup", "vector", 2, "Search vector knowledge base for bio/descriptions", False),
    ("general_knowledge", "vector", 1, "Search vector knowledge base for medical info", False),
    ("__default__", "sql", 1, "Default SQL execution", False),
]
_ROUTE_SCHEMA = "route_op string, action_type string, priority int, template string, needs_rx boolean"


def route_actions(spark: SparkSession, labelled: DataFrame, key_cols: list[str]) -> DataFrame:
    """R2: one row per action ``(keys…, action_type, priority, description)`` in priority order.

    The rules table has a fixed size (11 rows), so broadcasting it is bounded by construction.
    """
    rules = F.broadcast(spark.createDataFrame(ROUTES, _ROUTE_SCHEMA))
    known = F.col("operation").isin(*[r[0] for r in ROUTES if r[0] != "__default__"])
    op_key = F.when(known, F.col("operation")).otherwise(F.lit("__default__"))
    j = labelled.withColumn("_op_key", op_key).join(rules, F.col("_op_key") == F.col("route_op"), "inner")
    j = j.where(~F.col("needs_rx") | F.array_contains(F.col("targets"), "prescriptions"))
    desc = F.replace(F.replace(F.col("template"), F.lit("{op}"), F.coalesce(F.col("operation"), F.lit(""))),
                     F.lit("{targets}"), F.array_join(F.col("targets"), ", "))
    return j.select(*key_cols, "action_type", "priority", desc.alias("description"))


# ---------------------------------------------------------------------------------------------
# Model reply → intent (greedy braces, parse, validate, repair)
# ---------------------------------------------------------------------------------------------

# Error text and defaults of the reply parser.
NO_JSON = "No valid JSON object found in LLM response"
PARSE_ERROR = "JSON Parse error"
DEFAULT_JUSTIFICATION = "Automatically inferred intent"

_STRING_FILTERS = ("doctorName", "patientName", "department", "status", "date")
_NUMBER_FILTERS = ("minExperience", "limit")


def _kind(v: Column, path: str) -> Column:
    """JSON kind at ``path``: string / number / bool / array / object / null; SQL null if absent."""
    s = F.schema_of_variant(F.variant_get(v, path, "variant"))
    return (F.when(s.isNull(), F.lit(None))
            .when(s == "STRING", F.lit("string"))
            .when(s.startswith("ARRAY"), F.lit("array"))
            .when(s.startswith("OBJECT"), F.lit("object"))
            .when(s == "BOOLEAN", F.lit("bool"))
            .when(s == "VOID", F.lit("null"))
            .otherwise(F.lit("number")))


def _js_truthy(v: Column, path: str, k: Column | None = None) -> Column:
    """The value at ``path`` as text when JS would call it truthy, else null (``k``: its kind)."""
    k = _kind(v, path) if k is None else k
    val = F.try_variant_get(v, path, "string")
    truthy = (F.when(k == "string", val != "")
              .when(k == "number", val.cast("double") != 0)
              .when(k == "bool", val == "true")
              .when(k.isin("array", "object"), F.lit(True))
              .otherwise(F.lit(False)))
    return F.when(truthy, F.when(k.isin("array", "object"), F.to_json(F.variant_get(v, path, "variant")))
                  .otherwise(val))


def parse_structured(df: DataFrame, text_col: str = "reply") -> DataFrame:
    """Adds ``parse_ok, error, operation, targets, patient_name, doctor_name, department,
    status, date, min_experience, row_limit, justification``.

    Text between the first ``{`` and the last ``}`` is parsed (``try_parse_json``: no exception).
    A document passing validation (operation in the vocabulary, targets an array of strings,
    filters an object with typed optional fields, a string justification) is taken as is (limit
    defaults to 5). Otherwise it is repaired: operation ``|| "lookup"``, justification
    ``|| default``, targets ``[]`` unless an array, patient name from
    ``patientName || prescriptionFor || name``, doctor / status / date kept when truthy, limit
    ``|| 5``; department and minExperience are dropped (X13). Unparsable text gives
    ``parse_ok = false`` and an error message.
    """
    t = F.col(text_col)
    start = F.instr(t, "{")
    rpos = F.instr(F.reverse(t), "}")
    last = F.length(t) - rpos + 1
    has = t.isNotNull() & (start > 0) & (rpos > 0) & (last >= start)
    js = F.when(has, F.substring(t, start, last - start + 1))
    # stage 1: parse once; stage 2: JSON kinds once; stage 3: pick / repair (keeps codegen small)
    staged = df.select("*", has.alias("_has"), F.try_parse_json(js).alias("_v"))
    v = F.col("_v")
    kinds = {"op": "$.operation", "tg": "$.targets", "fl": "$.filters", "ju": "$.justification"}
    kinds.update({f"f_{n}": f"$.filters.{n}" for n in _STRING_FILTERS + _NUMBER_FILTERS
                  + ("prescriptionFor", "name", "patient_name", "patient")})
    staged = staged.select("*", *[_kind(v, p).alias(f"_k_{k}") for k, p in kinds.items()],
                           F.schema_of_variant(F.variant_get(v, "$.targets", "variant")).alias("_tg_schema"))
    k = lambda name: F.col(f"_k_{name}")
    ok = F.col("_has") & v.isNotNull()
    op = F.try_variant_get(v, "$.operation", "string")
    targets = F.try_variant_get(v, "$.targets", "array<string>")
    schema_ok = ((k("op") == "string") & op.isin(*OPERATIONS)
                 & F.col("_tg_schema").isin("ARRAY<STRING>", "ARRAY<VOID>")
                 & (k("fl") == "object") & (k("ju") == "string"))
    for name in _STRING_FILTERS:
        schema_ok = schema_ok & (k(f"f_{name}").isNull() | (k(f"f_{name}") == "string"))
    for name in _NUMBER_FILTERS:
        schema_ok = schema_ok & (k(f"f_{name}").isNull() | (k(f"f_{name}") == "number"))
    schema_ok = F.coalesce(schema_ok, F.lit(False))
    staged = staged.select("*", ok.alias("_ok"), (ok & schema_ok).alias("_good"), (ok & ~schema_ok).alias("_rep"))
    good, rep = F.col("_good"), F.col("_rep")
    fs = lambda name: F.try_variant_get(v, f"$.filters.{name}", "string")
    ft = lambda name: _js_truthy(v, f"$.filters.{name}", k(f"f_{name}"))
    lim = F.try_variant_get(v, "$.filters.limit", "double")
    out = staged.select(
        *df.columns,
        F.col("_ok").alias("parse_ok"),
        F.when(~F.col("_has"), F.lit(NO_JSON)).when(~F.col("_ok"), F.lit(PARSE_ERROR)).alias("error"),
        F.when(good, op).when(rep, F.coalesce(_js_truthy(v, "$.operation", k("op")), F.lit("lookup"))).alias("operation"),
        F.when(good, targets).when(rep, F.when(k("tg") == "array", targets)
                                    .otherwise(F.array().cast("array<string>"))).alias("targets"),
        F.when(good, fs("patientName"))
         .when(rep, F.coalesce(ft("patientName"), ft("prescriptionFor"), ft("name"), ft("patient_name"), ft("patient"))).alias("patient_name"),
        F.when(good, fs("doctorName")).when(rep, ft("doctorName")).alias("doctor_name"),
        F.when(good, fs("department")).alias("department"),
        F.when(good, fs("status")).when(rep, ft("status")).alias("status"),
        F.when(good, fs("date")).when(rep, ft("date")).alias("date"),
        F.when(good, F.try_variant_get(v, "$.filters.minExperience", "double")).alias("min_experience"),
        F.when(good, F.coalesce(lim, F.lit(float(DEFAULT_LIMIT))))
         .when(rep, F.coalesce(ft("limit").try_cast("double"), F.lit(float(DEFAULT_LIMIT)))).alias("row_limit"),
        F.when(good, F.try_variant_get(v, "$.justification", "string"))
         .when(rep, F.coalesce(_js_truthy(v, "$.justification", k("ju")), F.lit(DEFAULT_JUSTIFICATION))).alias("justification"),
    )
    return out


# ---------------------------------------------------------------------------------------------
# Request normalisation
# ---------------------------------------------------------------------------------------------

# Fixed value: the error of a request without a query.
QUERY_REQUIRED = "Query is required. Please provide 'query' or 'user_query' in the request body."


def normalise_requests(df: DataFrame, body_col: str = "body") -> DataFrame:
    """``query || user_query || q``, ``tenantId || tenant_id || "default"``,
    ``sessionId || session_id``; a missing query becomes an error row (never an exception)."""
    v = F.try_parse_json(F.col(body_col))
    g = lambda k: _js_truthy(v, f"$.{k}")  # noqa: E731   false, 0 and "" give way to the next name
    query = F.coalesce(g("query"), g("user_query"), g("q"))
    tenant = F.coalesce(g("tenantId"), g("tenant_id"), F.lit("default"))
    session = F.coalesce(g("sessionId"), g("session_id"))
    return df.select("*", query.alias("query"), tenant.alias("tenant_id"), session.alias("session_id"),
                     F.when(query.isNull(), F.lit(QUERY_REQUIRED)).alias("error"))


# ---------------------------------------------------------------------------------------------
# A5: pack result rows as one JSON value per group
# ---------------------------------------------------------------------------------------------

def pack_results(df: DataFrame, group_col: str, order_col: str, cols: list[str], n: int) -> DataFrame:
    """The first ``n`` rows (by ``order_col``) of each group as one JSON array text.

    ``n`` is the result limit of the question (5 by default); the top-n per group is taken with a
    window limit that Spark applies partially before the shuffle, so a large group sends at most n
    rows per map task.
    """
    from wardlight.operators.shapes import rank_within
    top = rank_within(df, group_col, [F.col(order_col)], n)
    packed = top.groupBy(group_col).agg(
        F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in [order_col] + [x for x in cols if x != order_col]])))
        .alias("_rows"))
    return packed.select(group_col, F.to_json(F.col("_rows")).alias("rows_json"))
