"""

``queries()`` runs the library over the given tables; ``oracle_sql()`` says in
plain SQL what must come out. Most tables are clean, so faults are planted by
projection, the same way on both sides: ``SEEDED`` below is text both engines
read, over every row of ``lineitem``.
"""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import duckdb_oracle as sql  # noqa: E402
import plumbline  # noqa: E402
from plumbline import operators as ops  # noqa: E402
from plumbline.storage import SETTING, ensure_checkpoint_dir  # noqa: E402

try:
    import corpus_pipeline
    from plumbline.llm import queries as llm
except ModuleNotFoundError as e:
    if e.name not in ("corpus_pipeline", "plumbline.llm"):
        raise
    corpus_pipeline = llm = None

SMOKE_DIR = "/root/testdata/sf0.001"

TABLES = list(sql.STRINGS)

# name -> expression over lineitem
SEEDED = {
    "Unnamed: 0": "cast(null as varchar(5))",
    "size_class": "case when l_quantity > 46 then 'bulk' else 'usual' end",
    "remark": "case when l_quantity > 48 then 'heavy' end",
    "flag": "case when l_quantity < 10 then lower(l_returnflag) else l_returnflag end",
    "pieces": "case when l_quantity > 47 then 'N/A' "
    "else cast(cast(l_quantity as int) as varchar(10)) end",
    "light": "l_quantity <= 46",
    "l_orderkey": "l_orderkey",
    "l_linenumber": "l_linenumber",
    "net": "l_quantity - 2",
    "cubed": "l_quantity * l_quantity * l_quantity * l_quantity",
    "l_shipdate": "l_shipdate",
}
SEEDED_STRINGS = ["Unnamed: 0", "size_class", "remark", "flag", "pieces"]
SEEDED_NUMBERS = ["l_orderkey", "l_linenumber", "net", "cubed"]

LINT_COLUMNS = ["code", "check", "status", "column", "occurrences"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [f"{expr} as `{name}`" for name, expr in SEEDED.items()]
    return read(spark, sf_dir, "lineitem").selectExpr(*columns)


def seeded_sql() -> str:
    columns = ", ".join(f'{expr} AS "{name}"' for name, expr in SEEDED.items())
    return f"(SELECT {columns} FROM lineitem)"


def repeated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return orders.unionByName(orders.where("o_orderpriority = '1-URGENT'"))


REPEATED_ORDERS = (
    "(SELECT * FROM orders UNION ALL "
    "SELECT * FROM orders WHERE o_orderpriority = '1-URGENT')"
)


def shouted_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_name", "p_brand")
    return part.unionByName(part.selectExpr("upper(p_name) as p_name", "p_brand"))


SHOUTED_PARTS = (
    "(SELECT p_name, p_brand FROM part UNION ALL "
    "SELECT upper(p_name) AS p_name, p_brand FROM part)"
)


SHOUTED = {
    "documents": "doc_id % 7 = 0",
    "conversations": "conv_id % 5 = 0",
}


def shouted(table: str, name: str) -> str:
    """The table's texts, some of them in capitals; both engines read this."""
    columns = [
        f"case when {SHOUTED[table]} then translate({c}, "
        "'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') "
        f"else {c} end as {c}"
        for c in sql.STRINGS[table]
    ]
    return f"select {', '.join(columns)} from {name}"


def shouted_rows(table: str):
    def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(shouted(table, "{t}"), t=read(spark, sf_dir, table))

    return rows


def prepared(spark: SparkSession) -> SparkSession:
    """A session of one machine gets a folder of its own if it names none."""
    if spark.conf.get(SETTING, None) is None and spark.sparkContext.master.startswith(
        ("local[", "local,")
    ):
        spark.conf.set(SETTING, tempfile.mkdtemp(prefix="plumbline-"))
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def entry(spark: SparkSession) -> DataFrame:
    """All eight checks over a table with planted faults."""
    return plumbline.lint(seeded(spark, SMOKE_DIR))


# -- queries ---------------------------------------------------------------


def lint_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plumbline.lint(seeded(spark, sf_dir))


def lint_table(table: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plumbline.lint(read(spark, sf_dir, table)).select(*LINT_COLUMNS)

    return query


def metrics(check, source, columns=None, **options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        if callable(source):
            df = source(spark, sf_dir)
        else:
            df = read(spark, sf_dir, source)
        if columns is not None:
            df = df.select(*[f"`{c}`" for c in columns])
        return check.metrics(df, **options)

    return query


def unnamed_columns(spark, sf_dir):
    chosen = ["unnamed_columns", "empty_columns"]
    return plumbline.lint(seeded(spark, sf_dir), chosen).select(*LINT_COLUMNS)


def samples_of(check: str, source, column: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = source(spark, sf_dir) if callable(source) else read(spark, sf_dir, source)
        return (
            plumbline.lint(df, [check])
            .where(f"column = '{column}'")
            .selectExpr("column", "posexplode(sample) as (pos, value)")
        )

    return query


def suite_summary(spark, sf_dir):
    return plumbline.summary(lint_seeded(spark, sf_dir))


def gate(spark, sf_dir):
    return plumbline.gate(lint_seeded(spark, sf_dir))


def report_lines(spark, sf_dir):
    return plumbline.report_lines(lint_seeded(spark, sf_dir))


def unknown_check(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    found = plumbline.lint(customer, ["nope", "negative_values"])
    return found.select(*LINT_COLUMNS)


def check_order(spark, sf_dir):
    """Checks run in the order chosen, twice if chosen twice."""
    chosen = ["negative_values", "empty_columns", "negative_values"]
    found = plumbline.lint(read(spark, sf_dir, "customer"), chosen)
    return found.select(*LINT_COLUMNS)


def registered_check(spark, sf_dir):
    def blank_text(df, column):
        return df.groupBy().agg({column: "count"}).selectExpr(
            "'OK' as status", f"`count({column})` as occurrences"
        )

    plumbline.register_check("blank_text", "X001", blank_text)
    try:
        found = plumbline.lint(
            read(spark, sf_dir, "customer"),
            ["blank_text", "negative_values"],
            options={"blank_text": {"column": "c_name"}},
        )
    finally:
        plumbline.unregister_check("blank_text")
    return found.select(*LINT_COLUMNS)


def run_isolation(spark, sf_dir):
    """A check that fails while running leaves the others their results."""

    def broken(df):
        return df.selectExpr("raise_error('no luck') as message").limit(1)

    plumbline.register_check("broken", "X002", broken)
    try:
        found = plumbline.lint(
            read(spark, sf_dir, "customer"),
            ["broken", "negative_values"],
            isolate="run",
        )
    finally:
        plumbline.unregister_check("broken")
    return found.select(*LINT_COLUMNS)


SOURCE_COLUMNS = [*LINT_COLUMNS, "file_name"]


def parquet_source(spark, sf_dir):
    paths = [f"{sf_dir}/{t}.parquet" for t in ("customer", "supplier")]
    found = plumbline.lint_paths(spark, paths, ["negative_values", "iqr_outliers"])
    return found.select(*SOURCE_COLUMNS)


def csv_source(spark, sf_dir):
    folder = shared_folder(spark, "csv")
    path = f"{folder}/customer.csv"
    read(spark, sf_dir, "customer").write.csv(path, header=True)
    found = plumbline.lint_paths(spark, [path], ["negative_values", "iqr_outliers"])
    return found.select(*SOURCE_COLUMNS)


def unreadable_sources(spark, sf_dir):
    paths = [
        f"{sf_dir}/missing.parquet",
        f"{sf_dir}/customer.parquet",
        f"{sf_dir}/customer.xlsx",
    ]
    found = plumbline.lint_paths(spark, paths, ["negative_values"])
    return found.select(*SOURCE_COLUMNS)


def damaged_source(spark, sf_dir):
    """One of a file's parts is no Parquet; the other file is sound."""
    path = f"{shared_folder(spark, 'damaged')}/supplier.parquet"
    rows = read(spark, sf_dir, "supplier")
    rows.write.parquet(path)
    rows.selectExpr("s_name").write.mode("append").text(path)
    found = plumbline.lint_paths(
        spark,
        [path, f"{sf_dir}/customer.parquet"],
        ["negative_values"],
        schemas={path: rows.schema},
    )
    return found.select(*SOURCE_COLUMNS)


def json_report(spark, sf_dir):
    folder = shared_folder(spark, "report")
    plumbline.write_report(lint_seeded(spark, sf_dir), folder)
    written = spark.read.schema(plumbline.FINDING_SCHEMA).json(f"{folder}/findings")
    return written.select(*LINT_COLUMNS)


def json_report_summary(spark, sf_dir):
    folder = shared_folder(spark, "report")
    plumbline.write_report(plumbline.lint(read(spark, sf_dir, "events")), folder)
    return spark.read.json(f"{folder}/summary")


def report_document(spark, sf_dir):
    """Totals and results of the one-file report, read back from it."""
    path = f"{shared_folder(spark, 'document')}.json"
    plumbline.write_document(lint_seeded(spark, sf_dir), path)
    document = spark.read.json(path, multiLine=True)
    totals = ["total_results", "total_ok", "total_lints", "total_errors"]
    return document.select(
        *totals,
        (F.col("elapsed_seconds") > 0).alias("timed"),
        F.explode("results").alias("r"),
    ).select(*totals, "timed", *(f"r.{name}" for name in LINT_COLUMNS))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "unnamed_columns": unnamed_columns,
        "empty_columns": metrics(ops.empty_columns, seeded),
        "category_dominance": metrics(ops.category_dominance, seeded),
        "category_dominance_null": metrics(
            ops.category_dominance, seeded, threshold=0.95
        ),
        "category_dominance_boolean": metrics(
            ops.category_dominance, seeded, threshold=0.25
        ),
        "category_dominance_documents": metrics(
            ops.category_dominance, "documents", threshold=0.2
        ),
        "category_dominance_pages": metrics(
            ops.category_dominance, "pages", threshold=0.0005
        ),
        "duplicate_rows": metrics(ops.duplicate_rows, repeated_orders),
        "lint_region": lint_table("region"),
        "lint_nation": lint_table("nation"),
        "duplicate_rows_projection": metrics(
            ops.duplicate_rows,
            "lineitem",
            ["l_returnflag", "l_linestatus", "l_linenumber"],
        ),
        "duplicate_rows_texts": metrics(
            ops.duplicate_rows, "documents", ["text", "lang"]
        ),
        "case_variants": metrics(ops.case_variants, seeded),
        "case_variants_parts": metrics(ops.case_variants, shouted_parts),
        "case_variants_documents": metrics(
            ops.case_variants, shouted_rows("documents")
        ),
        "case_variants_conversations": metrics(
            ops.case_variants, shouted_rows("conversations")
        ),
        "numeric_text": metrics(ops.numeric_text, seeded),
        "numeric_text_documents": metrics(ops.numeric_text, "documents"),
        "numeric_text_pages": metrics(ops.numeric_text, "pages"),
        "iqr_outliers_approx": metrics(ops.iqr_outliers, "events", method="approx"),
        "iqr_approx_ranks": metrics(ops.iqr_outliers, "lineitem", method="approx"),
        "iqr_zero_skipped": metrics(ops.iqr_outliers, "labels"),
        "iqr_outliers_seeded": metrics(ops.iqr_outliers, seeded),
        "negative_values_seeded": metrics(ops.negative_values, seeded),
        "samples_negative_values": samples_of(
            "negative_values", "customer", "c_acctbal"
        ),
        "samples_iqr_outliers": samples_of("iqr_outliers", "documents", "n_chars"),
        "samples_numeric_text": samples_of("numeric_text", seeded, "pieces"),
        "samples_case_variants": samples_of("case_variants", seeded, "flag"),
        "suite_findings": lambda s, d: lint_seeded(s, d).select(*LINT_COLUMNS),
        "suite_summary": suite_summary,
        "gate": gate,
        "report_lines": report_lines,
        "unknown_check": unknown_check,
        "check_order": check_order,
        "registered_check": registered_check,
        "run_isolation": run_isolation,
        "parquet_source": parquet_source,
        "csv_source": csv_source,
        "unreadable_sources": unreadable_sources,
        "damaged_source": damaged_source,
        "json_report": json_report,
        "json_report_summary": json_report_summary,
        "report_document": report_document,
    }
    for table in TABLES:
        found[f"lint_{table}"] = lint_table(table)
        if sql.NUMBERS[table] and table != "labels":
            found[f"iqr_outliers_{table}"] = metrics(ops.iqr_outliers, table)
    for table in ("customer", "supplier", "lineitem"):
        found[f"negative_values_{table}"] = metrics(ops.negative_values, table)
    if llm is not None:
        found |= llm.queries()
        found["pipeline"] = corpus_pipeline.run
    return {name: with_folder(query) for name, query in found.items()}


def with_folder(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(prepared(spark), sf_dir)


# -- oracle ----------------------------------------------------------------


def lint_sql(table: str, checks: list[str] | None = None) -> str:
    return sql.findings(
        table, sql.STRINGS[table], sql.NUMBERS[table], sql.OTHERS.get(table, []), checks
    )


def lint_seeded_sql(checks: list[str] | None = None) -> str:
    # A boolean is a category but no text.
    found = sql.findings(
        "seeded",
        SEEDED_STRINGS,
        SEEDED_NUMBERS,
        ["light", "l_shipdate"],
        checks,
        categories=[*SEEDED_STRINGS, "light"],
    )
    return found.replace("WITH ", f"WITH seeded AS {seeded_sql()},\n", 1)


def sample_sql(column: str, ranked: str) -> str:
    """Rows ``value`` in order, numbered from zero."""
    return (
        f"SELECT '{column}' AS \"column\", CAST(n - 1 AS INTEGER) AS pos, value "
        f"FROM ({ranked}) r WHERE n <= 5"
    )


MESSAGES = {
    "DL001": ("every column has a name", "column without a name of its own"),
    "DL002": ("every column holds some value", "column holds nothing but nulls"),
    "DL003": ("no value prevails", None),
    "DL004": ("all rows differ", "rows that repeat other rows"),
    "DL005": ("each text is spelt one way", "texts that differ in capitals only"),
    "DL006": (
        "no text column is made of numbers",
        "numbers kept as text, next to other texts",
    ),
    "DL007": ("all numbers lie within the fences", None),
    "DL008": ("no number is below zero", "numbers below zero"),
}


def report_lines_sql() -> str:
    ok = " ".join(f"WHEN '{c}' THEN '{m[0]}'" for c, m in MESSAGES.items())
    lint = " ".join(
        f"WHEN '{c}' THEN '{m[1]}'" for c, m in MESSAGES.items() if m[1] is not None
    )
    strings = [*SEEDED_STRINGS, "light"]
    shares = sql.category_dominance("seeded", strings)
    fences = sql.iqr_outliers("seeded", SEEDED_NUMBERS)
    message = (
        f"CASE WHEN status = 'OK' THEN CASE code {ok} END "
        "WHEN code = 'DL003' THEN printf('%.2f %% of the values are ''%s''', "
        "d.share * 100, coalesce(d.value, 'null')) "
        "WHEN code = 'DL007' THEN printf("
        "'numbers below %.2f or above %.2f', o.\"lower\", o.\"upper\") "
        f"ELSE CASE code {lint} END END"
    )
    return (
        f"WITH seeded AS {seeded_sql()}, found AS ({lint_seeded_sql()}), "
        f"d AS ({shares}), o AS ({fences})\n"
        "SELECT '- | ' || code || ' | ' || status || ' | ' || "
        "CASE WHEN f.\"column\" IS NULL THEN '' ELSE f.\"column\" || ': ' END "
        f"|| {message} AS line FROM found f "
        "LEFT JOIN d ON d.\"column\" = f.\"column\" AND f.code = 'DL003' "
        "LEFT JOIN o ON o.\"column\" = f.\"column\" AND f.code = 'DL007'"
    )


def with_error_sql(check: str, rest: str) -> str:
    return (
        f"SELECT 'DL000' AS code, '{check}' AS \"check\", 'ERROR' AS status, "
        'CAST(NULL AS VARCHAR) AS "column", CAST(0 AS BIGINT) AS occurrences '
        f"UNION ALL SELECT * FROM ({rest}) s"
    )


def from_file_sql(table: str, checks: list[str], name: str) -> str:
    return f"SELECT *, '{name}' AS file_name FROM ({lint_sql(table, checks)}) f"


def oracle_sql() -> dict[str, str]:
    source = seeded_sql()
    categories = [*SEEDED_STRINGS, "light"]
    everything = list(SEEDED)
    numeric = ["negative_values", "iqr_outliers"]
    negative = lint_sql("customer", ["negative_values"])
    cubed = sql.iqr_outliers(source, SEEDED_NUMBERS)
    found = {
        "unnamed_columns": lint_seeded_sql(["unnamed_columns", "empty_columns"]),
        "empty_columns": sql.empty_columns(source, everything),
        "category_dominance": sql.category_dominance(source, categories),
        "category_dominance_null": sql.category_dominance(source, categories, 0.95),
        "category_dominance_boolean": sql.category_dominance(source, categories, 0.25),
        "category_dominance_documents": sql.category_dominance(
            "documents", sql.STRINGS["documents"], 0.2
        ),
        "category_dominance_pages": sql.category_dominance(
            "pages", sql.STRINGS["pages"], 0.0005
        ),
        "duplicate_rows": sql.duplicate_rows(
            REPEATED_ORDERS, sql.columns_of("orders")
        ),
        "lint_region": sql.findings("region", ["r_name"], ["r_regionkey"]),
        "lint_nation": sql.findings(
            "nation", ["n_name"], ["n_nationkey", "n_regionkey"]
        ),
        "duplicate_rows_projection": sql.duplicate_rows(
            "lineitem", ["l_returnflag", "l_linestatus", "l_linenumber"]
        ),
        "duplicate_rows_texts": sql.duplicate_rows("documents", ["text", "lang"]),
        "case_variants": sql.case_variants(source, SEEDED_STRINGS),
        "case_variants_parts": sql.case_variants(SHOUTED_PARTS, ["p_name", "p_brand"]),
        "case_variants_documents": sql.case_variants(
            f"({shouted('documents', 'documents')})", sql.STRINGS["documents"]
        ),
        "case_variants_conversations": sql.case_variants(
            f"({shouted('conversations', 'conversations')})", sql.STRINGS["conversations"]
        ),
        "numeric_text": sql.numeric_text(source, SEEDED_STRINGS),
        "numeric_text_documents": sql.numeric_text(
            "documents", sql.STRINGS["documents"]
        ),
        "numeric_text_pages": sql.numeric_text("pages", sql.STRINGS["pages"]),
        "iqr_outliers_approx": sql.iqr_approximate("events", sql.NUMBERS["events"]),
        "iqr_approx_ranks": sql.iqr_approximate("lineitem", sql.NUMBERS["lineitem"]),
        "iqr_zero_skipped": sql.iqr_outliers("labels", sql.NUMBERS["labels"]),
        "iqr_outliers_seeded": cubed,
        "negative_values_seeded": sql.negative_values(source, SEEDED_NUMBERS),
        "samples_negative_values": sample_sql(
            "c_acctbal",
            "SELECT CAST(c_acctbal AS VARCHAR) AS value, "
            "row_number() OVER (ORDER BY c_acctbal) AS n "
            "FROM customer WHERE c_acctbal < 0",
        ),
        "samples_iqr_outliers": sample_sql(
            "n_chars",
            "SELECT CAST(n_chars AS VARCHAR) AS value, "
            "row_number() OVER (ORDER BY n_chars) AS n FROM documents, "
            f"({sql.iqr_outliers('documents', ['n_chars'])}) q "
            'WHERE n_chars < q."lower" OR n_chars > q."upper"',
        ),
        "samples_numeric_text": sample_sql(
            "pieces",
            "SELECT pieces AS value, row_number() OVER (ORDER BY pieces) AS n "
            f"FROM {source} t WHERE pieces <> '' "
            "AND TRY_CAST(pieces AS DOUBLE) IS NULL",
        ),
        "samples_case_variants": sample_sql(
            "flag",
            "SELECT value, row_number() OVER (ORDER BY k, value) AS n FROM ("
            "SELECT k, unnest([lo, hi]) AS value FROM ("
            "SELECT lower(flag) AS k, min(flag) AS lo, max(flag) AS hi "
            f"FROM {source} t GROUP BY lower(flag)) g WHERE lo <> hi) p",
        ),
        "suite_findings": lint_seeded_sql(),
        "suite_summary": (
            "SELECT count(*) AS total_results, "
            "count(CASE WHEN status = 'OK' THEN 1 END) AS total_ok, "
            "count(CASE WHEN status = 'LINT' THEN 1 END) AS total_lints, "
            "CAST(0 AS BIGINT) AS total_errors "
            f"FROM ({lint_seeded_sql()}) f"
        ),
        "gate": (
            "SELECT coalesce(bool_or(status IN ('LINT', 'ERROR')), false) AS failed "
            f"FROM ({lint_seeded_sql()}) f"
        ),
        "report_lines": report_lines_sql(),
        "unknown_check": with_error_sql("nope", negative),
        "check_order": (
            f"SELECT * FROM ({negative}) a UNION ALL "
            f"SELECT * FROM ({lint_sql('customer', ['empty_columns'])}) b UNION ALL "
            f"SELECT * FROM ({negative}) c"
        ),
        "registered_check": (
            "SELECT 'X001' AS code, 'blank_text' AS \"check\", 'OK' AS status, "
            'CAST(NULL AS VARCHAR) AS "column", count(c_name) AS occurrences '
            f"FROM customer UNION ALL SELECT * FROM ({negative}) n"
        ),
        "run_isolation": with_error_sql("broken", negative),
        "parquet_source": " UNION ALL ".join(
            from_file_sql(t, numeric, f"{t}.parquet") for t in ("customer", "supplier")
        ),
        "csv_source": from_file_sql("customer", numeric, "customer.csv"),
        "unreadable_sources": (
            "SELECT *, 'missing.parquet' AS file_name FROM "
            f"({with_error_sql('file_read', negative)}) a WHERE status = 'ERROR' "
            "UNION ALL "
            + from_file_sql("customer", ["negative_values"], "customer.parquet")
            + " UNION ALL SELECT *, 'customer.xlsx' AS file_name FROM "
            f"({with_error_sql('file_read', negative)}) b WHERE status = 'ERROR'"
        ),
        "damaged_source": (
            "SELECT *, 'supplier.parquet' AS file_name FROM "
            f"({with_error_sql('negative_values', negative)}) a "
            "WHERE status = 'ERROR' UNION ALL "
            + from_file_sql("customer", ["negative_values"], "customer.parquet")
        ),
        "json_report": lint_seeded_sql(),
        "json_report_summary": (
            "SELECT count(*) AS total_results, "
            "count(CASE WHEN status = 'OK' THEN 1 END) AS total_ok, "
            "count(CASE WHEN status = 'LINT' THEN 1 END) AS total_lints, "
            "CAST(0 AS BIGINT) AS total_errors "
            f"FROM ({lint_sql('events')}) f"
        ),
        "report_document": (
            "SELECT count(*) OVER () AS total_results, "
            "count(CASE WHEN status = 'OK' THEN 1 END) OVER () AS total_ok, "
            "count(CASE WHEN status = 'LINT' THEN 1 END) OVER () AS total_lints, "
            "CAST(0 AS BIGINT) AS total_errors, true AS timed, f.* "
            f"FROM ({lint_seeded_sql()}) f"
        ),
    }
    for table in TABLES:
        found[f"lint_{table}"] = lint_sql(table)
        if sql.NUMBERS[table] and table != "labels":
            found[f"iqr_outliers_{table}"] = sql.iqr_outliers(
                table, sql.NUMBERS[table]
            )
    for table in ("customer", "supplier", "lineitem"):
        found[f"negative_values_{table}"] = sql.negative_values(
            table, sql.NUMBERS[table]
        )
    if llm is not None:
        found |= llm.oracle_sql()
        if corpus_pipeline.ORACLE_SQL is not None:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
