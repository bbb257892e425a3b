"""Queries on copies, references and nested columns of the domain's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.keys import norm_key, norm_value, standing
from brindle.operators.diff import diff_copies
from brindle.operators.nested import Path, element_fields, flatten_nested
from brindle.operators.references import orphan_references, orphan_report
from brindle.tables import load

COPIED = {
    "acts": ("act_id", ["title"]),
    "regulations": ("regulation_id", ["instrument_number", "regulation_type", "gazette_part"]),
}


def _side(spark: SparkSession, base: str, name: str, table: str, latest: bool) -> DataFrame:
    id_col, fields = COPIED[table]
    df = load(spark, base, name)
    ids = [c for c in ("id",) if c in df.columns]
    rows = df.select(norm_key(F.col(id_col)).alias("doc_key"), "language", "updated_at", *ids, *fields).filter("doc_key is not null")
    rows = standing(rows, ["doc_key", "language"], "updated_at",
        *ids) if latest else (rows.dropDuplicates(["id", "updated_at", "doc_key", "language", *fields]) if ids else rows)
    return rows.select("doc_key", "language", *[norm_value(F.col(c)).alias(c) for c in fields])


def _diff(spark: SparkSession, base: str, latest: bool) -> DataFrame:
    parts = []
    for table, (_, fields) in COPIED.items():
        main, copy = (_side(spark, base, n, table, latest) for n in (table, f"{table}_copy"))
        named = F.when(F.col("difference") == "missing_in_right", "missing_in_copy").when(F.col("difference") == "missing_in_left",
            "missing_in_main").otherwise(F.col("difference"))
        parts.append(diff_copies(main, copy, ["doc_key", "language"], fields)
            .select(F.lit(table).alias("table_name"), "doc_key", "language", named.alias("difference"), F.col("left_value").alias("main_value"),
            F.col("right_value").alias("copy_value"), "copies"))
    return reduce(DataFrame.unionByName, parts)


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """Keys that one side lacks and unequal fields, of the standing versions. Rows without key are in no copy."""
    return _diff(spark, base, latest=True).select("table_name", "doc_key", "language", "difference").distinct()


def p1_versions(spark: SparkSession, base: str) -> DataFrame:
    """The same over all versions: keys repeat, and the leftovers of a key are paired at least cost."""
    return _diff(spark, base, latest=False)


def p1_costs(spark: SparkSession, base: str) -> DataFrame:
    """By key, over all versions: unequal fields of the cheapest pairing, and rows that one side lacks."""
    gone = F.col("difference").isin("missing_in_copy", "missing_in_main")
    total = lambda what: F.sum(F.when(what, F.col("copies")).otherwise(0))
    return _diff(spark, base, latest=False).groupBy("table_name", "doc_key", "language").agg(total(~gone).alias("unequal"), total(gone)
        .alias("missing"))


def _references(spark: SparkSession, base: str) -> DataFrame:
    fields = ["crossRefId", "targetType", "targetRef", "enablingActId"]
    meta = F.from_json("metadata", ", ".join(f"{f} string" for f in fields))
    res = load(spark, base, "leg_resources").select("id", "updated_at", "created_at", meta.alias("m")).select("id", "updated_at", "created_at",
        *[F.col(f"m.{f}").alias(f) for f in fields])
    res = standing(res, ["id"],
        "updated_at").filter(
        "crossRefId is not null or targetRef is not null or enablingActId is not null")  # the latest version may have dropped its references
    target = F.lower(F.trim("targetType"))
    ref = lambda field, kind: F.struct(F.lit(field).alias("field_name"), kind.alias("kind"), norm_key(F.col(field)).alias("key"))
    refs = F.explode(F.array(ref("crossRefId", F.lit("cross_reference")),
        ref("targetRef", F.when(target == "act", "act").when(target == "regulation", "regulation").otherwise("none")),
        ref("enablingActId", F.lit("act"))))
    rows = res.select(F.lit("leg_resources").alias("table_name"), F.col("id").alias("row_id"), F.col("created_at").alias("at"),
        refs.alias("r")).select("table_name", "row_id", "at", "r.*")
    votes = load(spark, base, "bills_votequestion").select("id", "bill_id", "vote_date")
    votes = standing(votes, ["id"], None).select(F.lit("bills_votequestion").alias("table_name"), F.col("id").cast("string").alias("row_id"),
        F.col("vote_date").cast("timestamp_ntz").alias("at"), F.lit("bill_id").alias("field_name"), F.lit("bill").alias("kind"), F.col("bill_id")
        .cast("string").alias("key"))
    return rows.unionByName(votes)


def _parents(spark: SparkSession, base: str) -> DataFrame:
    acts = standing(load(spark, base, "acts").select(norm_key(F.col("act_id")).alias("key"), "language", "updated_at", "id", "created_at",
        "deleted_at"), ["key", "language"], "updated_at", "id")
    regs = standing(load(spark, base, "regulations").select(norm_key(F.col("regulation_id")).alias("key"), "language", "updated_at", "id",
        "created_at", "deleted_at"), ["key", "language"], "updated_at", "id")
    cross = load(spark, base, "cross_references").select(norm_key(F.col("id")).alias("key"), "created_at", "deleted_at")
    bills = load(spark, base, "bills_bill").select(F.col("id").cast("string").alias("key"), F.col("added").cast("timestamp_ntz").alias("created_at"),
        "deleted_at")
    span = lambda df, kind: df.select(F.lit(kind).alias("kind"), "key", F.col("created_at").alias("start"), F.col("deleted_at")
        .alias("end"))
    return reduce(DataFrame.unionByName, [span(acts, "act"), span(regs, "regulation"), span(cross, "cross_reference"), span(bills, "bill")])


def p3_orphans(spark: SparkSession, base: str) -> DataFrame:
    """Each reference without a record at its time, with its key, time and status."""
    return orphan_references(_references(spark, base), _parents(spark, base)).select("table_name", "row_id", "field_name", "kind", "key", "at",
        "status")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """The references that no record backs at that time. A targetRef of no known targetType has no record."""
    return p3_orphans(spark, base).select("table_name", "row_id", "field_name")


def p3_report(spark: SparkSession, base: str) -> DataFrame:
    """Orphans per table, field, month and status."""
    return orphan_report(p3_orphans(spark, base), "table_name", "field_name")


ACT_PATHS = [Path("preamble", "preamble"), Path("signature_block", "signature_blocks", (), (("signature_line", "lines"),))]
RESOURCE_PATHS = [Path("stage", "metadata", ("billHistory", "stages")), Path("amendment", "metadata", ("recentAmendments",))]


def _latest(df: DataFrame, *columns: str) -> DataFrame:
    return standing(df.select("id", "updated_at", *columns), ["id"], "updated_at")


def p5_elements(spark: SparkSession, base: str, with_text: bool = True) -> DataFrame:
    """Every object element of the nested columns, from the latest row of each id, with its JSON text."""
    acts = flatten_nested(_latest(load(spark, base, "acts"), "preamble", "signature_blocks"), "id", ACT_PATHS, with_text)
    resources = flatten_nested(_latest(load(spark, base, "leg_resources"), "metadata"), "id", RESOURCE_PATHS, with_text)
    return acts.select(F.lit("acts").alias("table_name"), "*").unionByName(resources.select(F.lit("leg_resources").alias("table_name"), "*"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Keys and places of the flat tables' rows."""
    return p5_elements(spark, base, with_text=False).select("table_name", "parent_id", "item", "outer_pos", "pos")


def _item(item: str, schema: str, table: str):
    def query(spark: SparkSession, base: str) -> DataFrame:
        columns, paths = (("preamble", "signature_blocks"), ACT_PATHS) if table == "acts" else (("metadata",), RESOURCE_PATHS)
        paths = [p for p in paths if item == p.item or item in dict(p.inner)]
        columns = [c for c in columns if c in {p.column for p in paths}]
        return element_fields(flatten_nested(_latest(load(spark, base, table), *columns), "id", paths), item, schema)

    return query


p5_preamble = _item("preamble", "text string, marginalNote string", "acts")
p5_signature_blocks = _item("signature_block", "witnessClause string, doneAt string", "acts")
p5_signature_lines = _item("signature_line", "signatureName string, signatureTitle string, signatureDate string, signatureLocation string", "acts")
p5_stages = _item("stage", "stage string, date string", "leg_resources")
p5_amendments = _item("amendment", "citation string, date string, link string", "leg_resources")

QUERIES = {
    "p1_found": p1_found, "p1_versions": p1_versions, "p1_costs": p1_costs,
    "p3_found": p3_found, "p3_orphans": p3_orphans, "p3_report": p3_report,
    "p5_found": p5_found, "p5_preamble": p5_preamble, "p5_signature_blocks": p5_signature_blocks, "p5_signature_lines": p5_signature_lines,
        "p5_stages": p5_stages, "p5_amendments": p5_amendments,
}

WS = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _sql_key(x: str) -> str:
    return rf"nullif(regexp_replace(upper({_sql_trim(x)}), '[{WS}/\-\x{{2010}}-\x{{2015}}\x{{2212}}]+', '-', 'g'), '')"


def _sql_value(x: str) -> str:
    return f"nullif(regexp_replace({_sql_trim(f'nfc_normalize({x})')}, '[{WS}]+', ' ', 'g'), '')"


def _sql_p1() -> str:
    views, parts = [], []
    for table, (id_col, fields) in COPIED.items():
        for name in (table, f"{table}_copy"):
            values = ", ".join(f"{_sql_value(f)} AS {f}" for f in fields)
            views.append((
                f"{name}_s AS (SELECT {_sql_key(id_col)} AS k, language AS l, {values} FROM {name} WHERE {_sql_key(id_col)} IS NOT NULL QUALIFY "
                f"row_number() OVER (PARTITION BY {_sql_key(id_col)}, language ORDER BY updated_at DESC NULLS LAST) = 1)"
            ))
        both = f"{table}_s a FULL JOIN {table}_copy_s b ON a.k = b.k AND a.l IS NOT DISTINCT FROM b.l"
        head = f"SELECT '{table}' AS table_name, coalesce(a.k, b.k) AS doc_key, coalesce(a.l, b.l) AS language"
        parts.append((
            f"{head}, CASE WHEN a.k IS NULL THEN 'missing_in_main' ELSE 'missing_in_copy' END AS difference FROM {both} WHERE a.k IS NULL OR b.k "
            f"IS NULL"
        ))
        parts += [f"{head}, '{f}' AS difference FROM {both} WHERE a.k IS NOT NULL AND b.k IS NOT NULL AND a.{f} IS DISTINCT FROM b.{f}"
            for f in fields]
    return "WITH " + ", ".join(views) + " " + " UNION ALL ".join(parts)


def _sql_costs() -> str:
    """All ways to pair the leftovers of each key, row by row of the smaller side, and the least cost."""
    parts, views = [], []
    for table, (id_col, fields) in COPIED.items():
        values = ", ".join(f"{_sql_value(f)} AS {f}" for f in fields)
        own, names = ", ".join(f"{f} := {f}" for f in fields), ", ".join(fields)
        side = lambda name, sign, raw: (
            f"SELECT {_sql_key(id_col)} AS k, language AS l, {values}, {sign} AS n FROM ({raw.replace('{t}', name)}) WHERE {_sql_key(id_col)} IS "
            f"NOT NULL"
        )  # noqa: B023, E731
        once = f"SELECT * FROM {{t}} QUALIFY row_number() OVER (PARTITION BY id, updated_at, {_sql_key(id_col)}, language, {names} ORDER BY id) = 1"
        net = (
            f"SELECT k, l, {names}, sum(n) AS n FROM ({side(table, 1, once)} UNION ALL {side(f'{table}_copy', -1, 'SELECT * FROM {t}')}) GROUP "
            f"BY ALL HAVING sum(n) <> 0"
        )
        rows = f"SELECT k, l, n > 0 AS mine, struct_pack({own}) AS r, unnest(range(0, abs(n)::BIGINT)) FROM ({net})"
        sides = f"SELECT k, l, coalesce(list(r) FILTER (mine), []) AS a, coalesce(list(r) FILTER (NOT mine), []) AS b FROM ({rows}) GROUP BY ALL"
        views.append((
            f"{table}_g AS (SELECT k, l, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS s, CASE WHEN len(a) <= len(b) THEN b ELSE a END AS t "
            f"FROM ({sides}))"
        ))
        cost = " + ".join(f"(g.s[w.i + 1].{f} IS DISTINCT FROM g.t[j].{f})::INT" for f in fields)
        step = (
            f"SELECT w.k, w.l, w.i + 1, list_append(w.used, j), w.cost + {cost} FROM {table}_w w JOIN {table}_g g ON w.k = g.k AND w.l IS NOT "
            f"DISTINCT FROM g.l, unnest(range(1, len(g.t) + 1)) AS u(j) WHERE w.i < len(g.s) AND NOT list_contains(w.used, j)"
        )
        views.append(f"{table}_w(k, l, i, used, cost) AS (SELECT k, l, 0::BIGINT, []::BIGINT[], 0 FROM {table}_g UNION ALL {step})")
        parts.append((
            f"SELECT '{table}' AS table_name, w.k AS doc_key, w.l AS language, min(cost) AS unequal, any_value(len(g.t) - len(g.s)) AS missing "
            f"FROM {table}_w w JOIN {table}_g g ON w.k = g.k AND w.l IS NOT DISTINCT FROM g.l WHERE w.i = len(g.s) GROUP BY w.k, w.l"
        ))
    return f"WITH RECURSIVE {', '.join(views)} " + " UNION ALL ".join(parts)


def _sql_references() -> str:
    meta = lambda f: f"json_extract_string(metadata, '$.{f}')"
    target = f"lower(trim({meta('targetType')}))"
    latest = (
        f"SELECT id, created_at, {meta('crossRefId')} AS cross_id, {meta('targetRef')} AS target, {target} AS target_type, "
        f"{meta('enablingActId')} AS enabling FROM leg_resources QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1"
    )
    ref = lambda field, kind, key: (
        f"SELECT 'leg_resources' AS table_name, id AS row_id, '{field}' AS field_name, {kind} AS kind, {_sql_key(key)} AS key, created_at AS "
        f"at FROM res WHERE {_sql_key(key)} IS NOT NULL"
    )
    votes = (
        "SELECT DISTINCT 'bills_votequestion', CAST(id AS VARCHAR), 'bill_id', 'bill', CAST(bill_id AS VARCHAR), CAST(vote_date AS "
        "TIMESTAMP) FROM bills_votequestion WHERE bill_id IS NOT NULL"
    )
    refs = " UNION ALL ".join([ref("crossRefId", "'cross_reference'", "cross_id"),
        ref("targetRef", "CASE WHEN target_type IN ('act', 'regulation') THEN target_type ELSE 'none' END", "target"),
        ref("enablingActId", "'act'", "enabling"), votes])
    law = lambda table, id_col, kind: (
        f"SELECT '{kind}' AS kind, {_sql_key(id_col)} AS key, created_at AS s, deleted_at AS e FROM {table} QUALIFY row_number() OVER "
        f"(PARTITION BY {_sql_key(id_col)}, language ORDER BY updated_at DESC NULLS LAST) = 1"
    )
    parents = " UNION ALL ".join([f"({law('acts', 'act_id', 'act')})", f"({law('regulations', 'regulation_id', 'regulation')})",
        f"SELECT 'cross_reference', {_sql_key('id')}, created_at, deleted_at FROM cross_references",
        "SELECT 'bill', CAST(id AS VARCHAR), CAST(added AS TIMESTAMP), deleted_at FROM bills_bill"])
    return f"WITH res AS ({latest}), refs AS ({refs}), parents AS ({parents})"


def _sql_p3(columns: str | None) -> str:
    """The orphans' ``columns``, or their report."""
    backed = "SELECT 1 FROM parents p WHERE p.kind = r.kind AND p.key = r.key AND p.s <= r.at"
    status = (
        f"CASE WHEN NOT EXISTS (SELECT 1 FROM parents p WHERE p.kind = r.kind AND p.key = r.key) THEN 'missing' WHEN NOT EXISTS ({backed}) "
        f"THEN 'late' ELSE 'deleted' END"
    )
    orphans = f"SELECT r.*, {status} AS status FROM refs r WHERE NOT EXISTS ({backed} AND (p.e IS NULL OR p.e > r.at))"
    if columns is None:
        return (
            f"{_sql_references()} SELECT table_name, field_name, strftime(o.at, '%Y-%m') AS month, status, count(*) AS orphans FROM ({orphans}) "
            f"o GROUP BY ALL"
        )
    return f"{_sql_references()} SELECT {columns} FROM ({orphans}) o"


def _unwrapped(x: str, levels: int = 3) -> str:
    """A JSON value; a string that holds JSON as that JSON, up to so many levels."""
    for _ in range(levels):
        x = f"(SELECT CASE WHEN json_type(v) = 'VARCHAR' THEN TRY_CAST(json_extract_string(v, '$') AS JSON) ELSE v END FROM (SELECT {x} AS v))"
    return x


def _elements_sql(name: str, source: str, value: str) -> str:
    """The objects of the array ``value`` of each row of ``source`` (``id``, ``place``) as ``name``: ``id``, ``place``, ``pos``, ``e``."""
    count = "CASE json_type(v) WHEN 'ARRAY' THEN CAST(json_array_length(v) AS INT) WHEN 'OBJECT' THEN 1 ELSE 0 END"
    rows = f"SELECT id, place, v, unnest(range(0, {count}))::INT AS pos FROM (SELECT id, place, {_unwrapped(value)} AS v FROM {source})"
    return (
        f"{name} AS (SELECT * FROM (SELECT id, place, pos, CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[' || pos || ']') ELSE v "
        f"END AS e FROM ({rows})) WHERE json_type(e) = 'OBJECT')"
    )


def _nested_sql(out: str) -> str:
    latest = lambda t, columns: f"SELECT id, -1 AS place, {columns} FROM {t} QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1"
    member = lambda x, m: f"(SELECT CASE WHEN json_type(w) = 'OBJECT' THEN json_extract(w, '$.{m}') END FROM (SELECT {_unwrapped(x)} AS w))"
    ctes = [
        f"ac AS ({latest('acts', 'TRY_CAST(preamble AS JSON) AS p, TRY_CAST(signature_blocks AS JSON) AS s')})",
            f"rs AS ({latest('leg_resources', 'TRY_CAST(metadata AS JSON) AS m')})",
        _elements_sql("pre", "ac", "p"), _elements_sql("blk", "ac", "s"), "bl AS (SELECT id, pos AS place, e FROM blk)",
            _elements_sql("lin", "bl", "json_extract(e, '$.lines')"),
        _elements_sql("stg", "rs", member(member("m", "billHistory"), "stages")), _elements_sql("amd", "rs", member("m", "recentAmendments")),
    ]
    return f"WITH {', '.join(ctes)} {out}"


_ITEMS = {"preamble": ("acts", "pre"), "signature_block": ("acts", "blk"), "signature_line": ("acts", "lin"), "stage": ("leg_resources", "stg"),
    "amendment": ("leg_resources", "amd")}


def _fields_sql(item: str, *fields: str) -> str:
    cells = ", ".join(f"json_extract_string(e, '$.{f}') AS {f}" for f in fields)
    return _nested_sql(f"SELECT id AS parent_id, place AS outer_pos, pos, {cells} FROM {_ITEMS[item][1]}")


NESTED_ORACLE = {
    "p5_found": _nested_sql(" UNION ALL ".join(f"SELECT '{t}' AS table_name, id AS parent_id, '{item}' AS item, place AS outer_pos, pos FROM {cte}"
        for item, (t, cte) in _ITEMS.items())),
    "p5_preamble": _fields_sql("preamble", "text", "marginalNote"), "p5_signature_blocks": _fields_sql("signature_block", "witnessClause", "doneAt"),
    "p5_signature_lines": _fields_sql("signature_line", "signatureName", "signatureTitle", "signatureDate", "signatureLocation"),
        "p5_stages": _fields_sql("stage", "stage", "date"), "p5_amendments": _fields_sql("amendment", "citation", "date", "link"),
}
ORACLE = {"p1_found": _sql_p1(), "p1_costs": _sql_costs(), "p3_found": _sql_p3("table_name, row_id, field_name"),
    "p3_orphans": _sql_p3("table_name, row_id, field_name, kind, key, o.at, status"), "p3_report": _sql_p3(None)} | NESTED_ORACLE
