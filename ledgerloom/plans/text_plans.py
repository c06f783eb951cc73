"""Text functions and name resolution over the store's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import resolve
from ledgerloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
PATTERNS = (r"upi[/-]\d+/[^/]+/([^/]+)", r"upi-([^-]+)-", r"neft/[^/]+/([^/]+)", r"rtgs/[^/]+/([^/]+)", r"imps-\d+/[^/]*/[^/]*/([^/]+)", r"pos ([a-z ]+)")
OPENERS = ("(upi)", "(neft)", "(rtgs)", "(imps)", "(chq)", "(pos)")


def query(sql: str | None = None, name: str | None = None):
    def take(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return take


_capture = "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(lower(description), '{p}', 1)), '')" for p in PATTERNS) + ")"


@query(f"SELECT transaction_id, {_capture} AS captured FROM transactions WHERE description IS NOT NULL")
def f08_first_capture(spark, folder):
    return table(spark, folder, "transactions").where("description is not null").select("transaction_id", X.first_capture(F.col("description"), PATTERNS).alias("captured"))


@query(f"SELECT count(*) AS texts, sum(CASE WHEN regexp_matches(description, '(?i)^(?:{'|'.join(OPENERS)})') THEN 1 ELSE 0 END) AS matched, round(sum(CASE WHEN regexp_matches(description, '(?i)^(?:{'|'.join(OPENERS)})') THEN 1 ELSE 0 END) * 100.0 / count(*), 2) AS accuracy FROM (SELECT DISTINCT description FROM transactions WHERE description IS NOT NULL)")
def f05_pattern_coverage(spark, folder):
    return resolve.pattern_coverage(table(spark, folder, "transactions").select(F.col("description").alias("text")), OPENERS)


@query(f"SELECT entity_id, {X.plain_name_sql('entity_name')} AS plain, trim(regexp_replace(lower(entity_name), '[^a-z0-9]+', ' ', 'g')) AS compared FROM entities")
def f08_normalisers(spark, folder):
    return table(spark, folder, "entities").select("entity_id", X.plain_name(F.col("entity_name")).alias("plain"), X.compared_name(F.col("entity_name")).alias("compared"))


@query(f"""WITH n AS (SELECT DISTINCT counterparty_merged AS name FROM transactions WHERE counterparty_merged IS NOT NULL), x AS (SELECT n.name, min(entity_id) AS entity_id, 'exact' AS how FROM n JOIN entities e ON e.entity_name = n.name GROUP BY 1),
 r AS (SELECT name, {X.plain_name_sql('name')} AS p FROM n WHERE name NOT IN (SELECT name FROM x)), y AS (SELECT r.name, min(entity_id) AS entity_id, 'plain' AS how FROM r JOIN entities e ON {X.plain_name_sql('e.entity_name')} = r.p WHERE r.p <> '' GROUP BY 1) SELECT * FROM x UNION ALL SELECT * FROM y""")
def j16_j17_resolved(spark, folder):
    """The steps that are equalities: by name, then by plain name."""
    return _resolved(spark, folder).where("how <> 'alike'")


def _resolved(spark, folder):
    return resolve.resolved(table(spark, folder, "transactions").select(F.col("counterparty_merged").alias("name")), table(spark, folder, "entities"))


@query()
def j16_alike(spark, folder):
    """The names that only likeness resolves; no SQL has this ratio."""
    return _resolved(spark, folder).where("how = 'alike'").select("name", "entity_id")


@query(r"""WITH c AS (SELECT counterparty_merged AS name, count(*) AS n FROM transactions WHERE counterparty_merged IS NOT NULL GROUP BY 1), g AS (SELECT *, regexp_replace(split_part(regexp_replace(lower(trim(name)), '\s+', ' ', 'g'), ' ', 1), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g') AS key FROM c),
 t AS (SELECT key, min(name) AS target FROM g WHERE (key, n) IN (SELECT (key, max(n)) FROM g GROUP BY key HAVING count(*) > 1) AND key <> '' GROUP BY key), j AS (SELECT name, target, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(target), '[^a-z0-9]+', ' ', 'g')) AS b FROM g JOIN t USING (key) WHERE name <> target)
 SELECT name, target FROM j WHERE a = b OR 1 - levenshtein(a, b) * 1.0 / greatest(length(a), length(b)) >= 0.95""")
def g27_merge_pairs(spark, folder):
    c = table(spark, folder, "transactions").where("counterparty_merged is not null").groupBy(F.col("counterparty_merged").alias("name")).agg(F.count("*").alias("n"))
    return resolve.merge_pairs(c)


_H = "WITH h AS (SELECT bank_key, list_filter([date_header, description_header, debit_header, credit_header, amount_header, direction_header], lambda x: x IS NOT NULL) AS names FROM bank_header_mappings), u AS (SELECT bank_key, names, list_transform(names, lambda x: upper(trim(x))) AS up FROM h)"


def _first(wanted: tuple[str, ...], column: str) -> str:
    """The header that stands for a column, in SQL: the first wanted name that one equals, else the first that one holds."""
    stands = lambda w: "contains(x, 'DATE') AND (ends_with(x, ' DATE') OR starts_with(x, 'DATE ') OR NOT regexp_matches(x, 'NO_DATE|UPDATE_DATE|CREATE_DATE'))" if column == "DATE" else f"regexp_matches(x, '(^|[^A-Z0-9]){w}([^A-Z0-9]|$)')"
    tests = [f"x = '{w}'" for w in wanted] + [stands(w) for w in wanted]
    return "coalesce(" + ", ".join(f"names[list_position(list_transform(up, lambda x: {t}), true)]" for t in tests) + ")"


@query(f"""{_H}, m AS (SELECT bank_key, {', '.join(f"{_first(w, c)} AS {c.lower()}_name" for c, w in X.WANTED.items())} FROM u)
 SELECT bank_key, coalesce(date_name, '') AS date_name, coalesce(description_name, '') AS description_name, coalesce(debit_name, '') AS debit_name, coalesce(credit_name, '') AS credit_name, coalesce(amount_name, '') AS amount_name, coalesce(direction_name, '') AS direction_name,
 date_name IS NOT NULL AND description_name IS NOT NULL AND (debit_name IS NOT NULL AND credit_name IS NOT NULL OR amount_name IS NOT NULL) AS suffices FROM m""")
def s10_header_inference(spark, folder):
    """What each bank's headers stand for, told from their names alone; a table of headers, one row a bank."""
    m = table(spark, folder, "bank_header_mappings")
    rows = []
    for r in m.collect():  # a table of fixed size
        ok, _, found = X.header_mapping([x for x in (r.date_header, r.description_header, r.debit_header, r.credit_header, r.amount_header, r.direction_header) if x is not None])
        rows.append((r.bank_key, *[found.get(c, "") for c in X.WANTED], ok))
    return spark.createDataFrame(rows, "bank_key string, " + ", ".join(f"{c.lower()}_name string" for c in X.WANTED) + ", suffices boolean")


@query()
def s07_s08_statement_rows(spark, folder):
    """Statement records mapped to movements: DR or CR and an amount, with their 1-based place in the file; rows without either side are errors and left out."""
    from ledgerloom.operators.drift import unified

    u = unified(table(spark, folder, "statement_lines"), table(spark, folder, "bank_statements"))
    d, c = F.coalesce("debit", F.lit(0)), F.coalesce("credit", F.lit(0))
    side = F.when(d > 0, "DR").when(c > 0, "CR")
    return u.select("line_id", "statement_id", "utc_micros", "description", F.when(d > 0, d).otherwise(c).alias("amount"), side.alias("direction"), (F.col("line_no") - 1).alias("original_index")).where("direction is not null")
