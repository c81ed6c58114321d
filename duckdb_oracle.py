"""The checks' measurements as SQL for another engine.

``relation`` is a table name or a bracketed query; ``columns`` name what to
look at. Written from the definitions, without regard to how the library
computes the same numbers.
"""

from __future__ import annotations

# Columns of the given tables by kind.
STRINGS = {
    "customer": ["c_name", "c_mktsegment"],
    "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"],
    "events": ["event_type", "props"],
    "documents": ["text", "lang", "source"],
    "pages": ["url", "html"],
    "conversations": ["role", "text"],
    "benchmark": ["text"],
    "labels": [],
    "embeddings": [],
}
NUMBERS = {
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "lineitem": [
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
    ],
    "events": ["event_id", "user_id", "value"],
    "documents": ["doc_id", "n_chars"],
    "pages": ["page_id"],
    "conversations": ["conv_id", "turn"],
    "benchmark": ["item_id"],
    "labels": ["doc_id", "quality", "toxic"],
    "embeddings": ["vec_id", "label"],
}
OTHERS = {
    "orders": ["o_orderdate"],
    "lineitem": ["l_shipdate"],
    "events": ["ts"],
    "embeddings": ["embedding"],
}


def columns_of(table: str) -> list[str]:
    return STRINGS[table] + NUMBERS[table] + OTHERS.get(table, [])


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def empty_columns(relation: str, columns: list[str]) -> str:
    return union(
        [
            f"SELECT '{c}' AS \"column\", count(*) AS total, "
            f'count(*) - count("{c}") AS nulls FROM {relation} t'
            for c in columns
        ]
    )


def category_dominance(
    relation: str, columns: list[str], threshold: float = 0.9
) -> str:
    return union(
        [
            f"SELECT '{c}' AS \"column\", CAST(v AS VARCHAR) AS value, n, "
            f"n / total AS share FROM (SELECT \"{c}\" AS v, count(*) AS n, "
            f"(SELECT count(*) FROM {relation} u) AS total "
            f'FROM {relation} t GROUP BY "{c}") g WHERE n / total > {threshold}'
            for c in columns
        ]
    )


def duplicate_rows(relation: str, columns: list[str]) -> str:
    keys = ", ".join(f'"{c}"' for c in columns)
    return (
        "SELECT count(*) AS duplicate_groups, "
        "CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus "
        f"FROM (SELECT count(*) AS n FROM {relation} t GROUP BY {keys}) g WHERE n > 1"
    )


def case_variants(relation: str, columns: list[str]) -> str:
    return union(
        [
            f"SELECT '{c}' AS \"column\", count(*) AS variant_groups, "
            "CAST(sum(m) AS BIGINT) AS \"rows\", CAST(sum(n - 1) AS BIGINT) AS surplus "
            f'FROM (SELECT lower("{c}") AS k, count(DISTINCT "{c}") AS n, count(*) AS m '
            f'FROM {relation} t WHERE "{c}" IS NOT NULL GROUP BY lower("{c}")) g '
            "WHERE n > 1 HAVING count(*) > 0"
            for c in columns
        ]
    )


def numeric_text(relation: str, columns: list[str]) -> str:
    return union(
        [
            f'SELECT \'{c}\' AS "column", count(*) AS valid, '
            f'count(TRY_CAST("{c}" AS DOUBLE)) AS "numeric", '
            f'count(TRY_CAST("{c}" AS DOUBLE)) / count(*) AS share '
            f"FROM {relation} t WHERE \"{c}\" <> '' HAVING count(*) > 0"
            for c in columns
        ]
    )


def iqr_outliers(relation: str, columns: list[str]) -> str:
    return union(
        [
            f"SELECT '{c}' AS \"column\", q1, q3, q1 - 1.5 * (q3 - q1) AS \"lower\", "
            "q3 + 1.5 * (q3 - q1) AS \"upper\", "
            f"(SELECT count(*) FROM {relation} t WHERE "
            f'CAST("{c}" AS DOUBLE) < q1 - 1.5 * (q3 - q1) OR '
            f'CAST("{c}" AS DOUBLE) > q3 + 1.5 * (q3 - q1)) AS outliers FROM (SELECT '
            f'CAST(percentile_disc(0.25) WITHIN GROUP (ORDER BY "{c}") AS DOUBLE) AS q1, '
            f'CAST(percentile_disc(0.75) WITHIN GROUP (ORDER BY "{c}") AS DOUBLE) AS q3 '
            f'FROM {relation} t WHERE "{c}" IS NOT NULL) q WHERE q3 - q1 > 0'
            for c in columns
        ]
    )


def iqr_approximate(relation: str, columns: list[str]) -> str:
    """Quartiles as the least value of the bin that holds them.

    Bins are steps of the eighth square root, and equal parts of such a step.
    """
    root = "abs(x)"
    for _ in range(8):
        root = f"sqrt({root})"
    step = f"floor(least({root}, 20) * 65536)"
    parts = []
    for c in columns:
        one = []
        for name, q in (("q1", 0.25), ("q3", 0.75)):
            one.append(
                f"(SELECT low FROM (SELECT low, n, sum(n) OVER (ORDER BY b) AS upto, r "
                "FROM (SELECT coalesce(floor((x * 0.5 - lo * 0.5) / nullif("
                "hi * 0.5 - lo * 0.5, 0) * 4095), 0) AS b, min(x) AS low, "
                "count(*) AS n, any_value(r) AS r FROM (SELECT v.x, s.lo, s.hi, s.r "
                "FROM v JOIN (SELECT bin, lo, hi, "
                f"ceil({q} * total) - (upto - n) AS r FROM (SELECT bin, lo, hi, n, "
                "sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM "
                "(SELECT bin, min(x) AS lo, max(x) AS hi, count(*) AS n FROM v "
                f"GROUP BY bin) g) h WHERE upto >= ceil({q} * total) "
                f"AND upto - n < ceil({q} * total)) s ON v.bin = s.bin) w "
                "GROUP BY b) f) k WHERE upto >= r AND upto - n < r) AS " + name
            )
        parts.append(
            f"SELECT '{c}' AS \"column\", q1, q3, q1 - 1.5 * (q3 - q1) AS \"lower\", "
            "q3 + 1.5 * (q3 - q1) AS \"upper\", "
            f"(SELECT count(*) FROM {relation} t WHERE "
            f'CAST("{c}" AS DOUBLE) < q1 - 1.5 * (q3 - q1) OR '
            f'CAST("{c}" AS DOUBLE) > q3 + 1.5 * (q3 - q1)) AS outliers FROM ('
            f"WITH v AS (SELECT x, CASE WHEN x < 0 THEN -{step} ELSE {step} END AS bin "
            f'FROM (SELECT CAST("{c}" AS DOUBLE) AS x FROM {relation} t '
            f'WHERE "{c}" IS NOT NULL) u) SELECT {", ".join(one)}) q WHERE q3 - q1 > 0'
        )
    return union(parts)


def negative_values(relation: str, columns: list[str]) -> str:
    return union(
        [
            f"SELECT '{c}' AS \"column\", count(*) AS total, "
            f'count(CASE WHEN "{c}" < 0 THEN 1 END) AS negative FROM {relation} t'
            for c in columns
        ]
    )


def lints(
    relation: str,
    strings: list[str],
    numbers: list[str],
    others: list[str] = (),
    categories: list[str] | None = None,
) -> dict[str, str]:
    """Per check, ``(code, check, column, occurrences)`` of its lints."""
    categories = strings if categories is None else categories
    everything = [*strings, *numbers, *others]
    unnamed = [c for c in everything if "Unnamed" in c]

    def rows(code, check, column, occurrences, source, where="true"):
        return (
            f"SELECT '{code}' AS code, '{check}' AS \"check\", {column} AS \"column\", "
            f"CAST({occurrences} AS BIGINT) AS occurrences FROM ({source}) m WHERE {where}"
        )

    parts = {}
    if unnamed:
        source = union([f"SELECT '{c}' AS \"column\"" for c in unnamed])
        parts["unnamed_columns"] = rows(
            "DL001", "unnamed_columns", '"column"', "1", source
        )
    parts["empty_columns"] = rows(
        "DL002",
        "empty_columns",
        '"column"',
        "nulls",
        empty_columns(relation, everything),
        "nulls = total AND nulls > 0",
    )
    if strings:
        parts["category_dominance"] = rows(
            "DL003",
            "category_dominance",
            '"column"',
            "n",
            category_dominance(relation, categories),
        )
        parts["case_variants"] = rows(
            "DL005",
            "case_variants",
            '"column"',
            "surplus",
            case_variants(relation, strings),
        )
        parts["numeric_text"] = rows(
            "DL006",
            "numeric_text",
            '"column"',
            'valid - "numeric"',
            numeric_text(relation, strings),
            "share > 0.8 AND share < 1.0",
        )
    parts["duplicate_rows"] = rows(
        "DL004",
        "duplicate_rows",
        "CAST(NULL AS VARCHAR)",
        "surplus",
        duplicate_rows(relation, everything),
        "surplus > 0",
    )
    parts["iqr_outliers"] = rows(
        "DL007",
        "iqr_outliers",
        '"column"',
        "outliers",
        iqr_outliers(relation, numbers),
        "outliers > 0",
    )
    parts["negative_values"] = rows(
        "DL008",
        "negative_values",
        '"column"',
        "negative",
        negative_values(relation, numbers),
        "negative > 0",
    )
    return parts


CODES = {
    "unnamed_columns": "DL001",
    "empty_columns": "DL002",
    "category_dominance": "DL003",
    "duplicate_rows": "DL004",
    "case_variants": "DL005",
    "numeric_text": "DL006",
    "iqr_outliers": "DL007",
    "negative_values": "DL008",
}


def findings(
    relation: str,
    strings: list[str],
    numbers: list[str],
    others: list[str] = (),
    checks: list[str] | None = None,
    categories: list[str] | None = None,
) -> str:
    """``(code, check, status, column, occurrences)``, one OK row per clean check."""
    chosen = list(CODES) if checks is None else checks
    found = lints(relation, strings, numbers, others, categories)
    selected = [found[c] for c in chosen if c in found]
    headers = union(
        [f"SELECT '{CODES[c]}' AS code, '{c}' AS \"check\"" for c in chosen]
    )
    return (
        f"WITH lints AS ({union(selected)}), headers AS ({headers})\n"
        'SELECT h.code, h."check", '
        "CASE WHEN l.code IS NULL THEN 'OK' ELSE 'LINT' END AS status, "
        'l."column", coalesce(l.occurrences, 0) AS occurrences '
        "FROM headers h LEFT JOIN lints l ON l.code = h.code"
    )
