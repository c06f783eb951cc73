"""Scans, predicates, joins and roll-ups over the case tables and the ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators import search as S
from ledgerloom.plans.record_sql import DATED
from ledgerloom.sources.ledger import EVENT_SQL, STORE_SQL, event_ledger, store_ledger
from ledgerloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, folder) and its SQL; L, S in the SQL are the ledgers."""

    def take(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql.replace("{L}", "WITH " + EVENT_SQL).replace("{S}", f"WITH {DATED}, {STORE_SQL}")
        return f

    return take


@query("{S} SELECT transaction_id, entity_id, entity_name, account_number, bank_name, CAST(d AS VARCHAR) AS tx_day, debit, credit, cp AS counterparty, oi AS original_index FROM S WHERE d >= DATE '2023-06-01' AND d <= DATE '2024-06-30'")
def s01_ledger_scan(spark: SparkSession, folder: str) -> DataFrame:
    df = S.search(store_ledger(spark, folder), date_from="2023-06-01", date_to="2024-06-30")
    return df.select("transaction_id", "entity_id", "entity_name", "account_number", "bank_name", F.col("DATE").cast("string").alias("tx_day"), F.col("DEBIT").alias("debit"), F.col("CREDIT").alias("credit"), "counterparty", "original_index")


@query("{L} SELECT transaction_id, entity_id, amount FROM L ORDER BY d, oi, transaction_id LIMIT 1000 OFFSET 2000")
def s02_page(spark, folder):
    return S.page(event_ledger(spark, folder), 2, 1000, F.col("DATE"), F.col("original_index"), F.col("transaction_id")).select("transaction_id", "entity_id", "amount")


@query("{S} SELECT transaction_id, descr AS description, cp AS counterparty, debit, credit, balance, oi AS original_index FROM S")
def s03_standardise(spark, folder):
    return store_ledger(spark, folder, dated=False).select("transaction_id", F.col("DESCRIPTION").alias("description"), "counterparty", F.col("DEBIT").alias("debit"), F.col("CREDIT").alias("credit"), "balance", "original_index")


@query("SELECT o_orderkey AS transaction_id, epoch_us(o_orderdate) AS tx_micros, 0.0 AS debit, o_totalprice AS credit, '' AS description FROM orders")
def s04_backfill(spark, folder):
    from ledgerloom.sources.ledger import backfilled

    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("transaction_id"), F.col("o_orderdate").cast("timestamp").alias("DATE"), F.col("o_totalprice").cast("string").alias("CREDIT"))
    return backfilled(o).select("transaction_id", F.unix_micros("DATE").alias("tx_micros"), F.col("DEBIT").alias("debit"), F.col("CREDIT").alias("credit"), F.col("DESCRIPTION").alias("description"))


@query("SELECT t.transaction_id, t.entity_id, CAST(t.amount AS DOUBLE) AS amount FROM transactions t WHERE t.entity_id IN (SELECT entity_id FROM case_entities JOIN cases USING (case_id) WHERE status = 'Active')")
def s05_case_scan(spark, folder):
    members = table(spark, folder, "case_entities").join(table(spark, folder, "cases").where("status = 'Active'").select("case_id"), "case_id", "left_semi").select("entity_id")
    return table(spark, folder, "transactions").join(members, "entity_id", "left_semi").select("transaction_id", "entity_id", F.col("amount").cast("double").alias("amount"))


@query("SELECT bank_key, date_header, description_header, debit_header, credit_header, amount_header, direction_header, coalesce(status, 'OK') AS status FROM bank_header_mappings")
def s17_header_mappings(spark, folder):
    m = table(spark, folder, "bank_header_mappings")
    return m.select("bank_key", "date_header", "description_header", "debit_header", "credit_header", "amount_header", "direction_header", F.coalesce("status", F.lit("OK")).alias("status"))


@query("""WITH k AS (SELECT DISTINCT bank_key, lower(bank_key) AS k FROM bank_header_mappings), n AS (SELECT DISTINCT bank_name, lower(bank_name) AS b FROM accounts WHERE bank_name IS NOT NULL),
 m AS (SELECT bank_name, bank_key, CASE WHEN b = k THEN 0 ELSE 1 END AS p FROM n JOIN k ON b = k OR contains(b, k) OR contains(k, b)),
 r AS (SELECT bank_name, bank_key, row_number() OVER (PARTITION BY bank_name ORDER BY p, length(bank_key) DESC, bank_key) AS n FROM m)
 SELECT n.bank_name, coalesce(r.bank_key, 'generic') AS preset FROM n LEFT JOIN r ON r.bank_name = n.bank_name AND r.n = 1""")
def s18_bank_preset(spark, folder):
    """The preset of each bank name: its own, else one that is part of the name or the other way round, else generic."""
    k = table(spark, folder, "bank_header_mappings").select("bank_key", F.lower("bank_key").alias("k")).distinct()  # a table of fixed size
    n = table(spark, folder, "accounts").where("bank_name is not null").select("bank_name", F.lower("bank_name").alias("b")).distinct()
    hit = n.join(F.broadcast(k), F.contains("b", "k") | F.contains("k", "b"), "left")
    best = hit.groupBy("bank_name").agg(F.min_by("bank_key", F.when(F.col("bank_key").isNotNull(), F.struct((F.col("b") != F.col("k")).cast("int"), -F.length("bank_key"), "bank_key"))).alias("bank_key"))
    return best.select("bank_name", F.coalesce("bank_key", F.lit("generic")).alias("preset"))


@query("SELECT transaction_id, row_number() OVER (PARTITION BY account_id ORDER BY batch_no, created_at, transaction_id) AS new_index FROM transactions")
def s20_backfill_index(spark, folder):
    w = W.partitionBy("account_id").orderBy("batch_no", "created_at", "transaction_id")
    return table(spark, folder, "transactions").select("transaction_id", F.row_number().over(w).alias("new_index"))


@query("{L} SELECT transaction_id, CASE WHEN cp IN ('CP_1', 'CP_2', 'CP_3') THEN 'CP_MERGED' ELSE cp END AS counterparty FROM L")
def s21_rename_counterparties(spark, folder):
    return S.renamed(event_ledger(spark, folder), [("CP_1", "CP_2"), ("CP_2", "CP_3"), ("CP_3", "CP_MERGED")]).select("transaction_id", "counterparty")


@query("SELECT case_id, entity_id, entity_role FROM (SELECT *, row_number() OVER (PARTITION BY case_id, entity_id ORDER BY added_date DESC, case_entity_id) AS n FROM case_entities) WHERE n = 1")
def s22_flag_upsert(spark, folder):
    return S.latest(table(spark, folder, "case_entities"), ["case_id", "entity_id"], F.col("added_date").desc(), F.col("case_entity_id")).select("case_id", "entity_id", "entity_role")


@query(f"SELECT * FROM (SELECT transaction_id, {S.type_sql('description')} AS payment_type, row_number() OVER (PARTITION BY {S.type_sql('description')} ORDER BY transaction_id) AS n FROM transactions WHERE description IS NOT NULL) WHERE n <= 10")
def s24_description_sample(spark, folder):
    """At most ten descriptions of each payment type: the sampler's limit is the feature."""
    t = table(spark, folder, "transactions").where("description is not null").select("transaction_id", S.payment_type(F.col("description")).alias("payment_type"))
    return t.withColumn("n", F.row_number().over(W.partitionBy("payment_type").orderBy("transaction_id"))).where("n <= 10")


@query("{L} SELECT transaction_id, debit, credit, credit - debit AS net_flow, debit + credit AS total_activity FROM L", "pred_p01_p02_debit_credit")
def _p01(spark, folder):
    d, c = F.col("DEBIT"), F.col("CREDIT")
    return event_ledger(spark, folder).select("transaction_id", d.alias("debit"), c.alias("credit"), (c - d).alias("net_flow"), (d + c).alias("total_activity"))


@query("{L} SELECT transaction_id, hour(d) AS h, dayname(d) AS weekday, month(d) AS m, quarter(d) AS q, year(d) AS y, day(d) AS dom, weekofyear(d) AS wk FROM L", "pred_p03_calendar")
def _p03(spark, folder):
    d = F.col("DATE")
    return event_ledger(spark, folder).select("transaction_id", F.hour(d).alias("h"), F.date_format(d, "EEEE").alias("weekday"), F.month(d).alias("m"), F.quarter(d).alias("q"), F.year(d).alias("y"), F.dayofmonth(d).alias("dom"), F.weekofyear(d).alias("wk"))


@query("""{L}, q AS (SELECT entity_id, list(amount ORDER BY amount) AS v, count(*) AS n FROM L GROUP BY entity_id), t AS (SELECT entity_id, v[CAST(floor(0.3 * (n - 1) + 0.5) AS INT) + 1] AS q30, v[CAST(floor(0.8 * (n - 1) + 0.5) AS INT) + 1] AS q80 FROM q)
 SELECT transaction_id, amount <= q30 AS is_small, amount >= q80 AS is_large FROM L JOIN t USING (entity_id)""", "pred_p06_small_large")
def _p06(spark, folder):
    from ledgerloom.functions.stats import nearest

    led = event_ledger(spark, folder)
    t = led.groupBy("entity_id").agg(nearest("amount", 0.3).alias("q30"), nearest("amount", 0.8).alias("q80"))
    return led.join(t, "entity_id").select("transaction_id", (F.col("amount") <= F.col("q30")).alias("is_small"), (F.col("amount") >= F.col("q80")).alias("is_large"))


@query("{L}, g AS (SELECT min(d) AS d0 FROM L) SELECT transaction_id, CAST(floor(epoch(d) - epoch(d0)) AS BIGINT) // 86400 AS days_since_start FROM L, g WHERE trim(cp) <> ''", "pred_p07_p08_days_since_start")
def _p08(spark, folder):
    led = event_ledger(spark, folder).where(F.trim("counterparty") != "")
    first = event_ledger(spark, folder).agg(F.min("DATE").alias("d0"))
    return led.crossJoin(F.broadcast(first)).select("transaction_id", F.floor(F.floor((F.unix_micros("DATE") - F.unix_micros("d0")) / 1_000_000) / 86400).alias("days_since_start"))


@query("{S} SELECT transaction_id, CAST(d AS VARCHAR) AS tx_day, amount FROM S WHERE d BETWEEN DATE '2023-01-01' AND DATE '2024-12-31' AND amount BETWEEN 1000 AND 50000 AND direction = 'DR' AND trim(cp) <> '' AND (contains(lower(descr), 'upi') OR contains(lower(cp), 'upi') OR contains(lower(transaction_id), 'upi'))", "pred_p09_case_search")
def _p09(spark, folder):
    df = S.search(store_ledger(spark, folder), date_from="2023-01-01", date_to="2024-12-31", amount_min=1000, amount_max=50000, direction="DR", status="Success", any_text="upi")
    return df.select("transaction_id", F.col("DATE").cast("string").alias("tx_day"), "amount")


@query("{S} SELECT count(*) AS total_count, round(coalesce(sum(amount), 0.0), 2) AS total_amount FROM S WHERE trim(cp) = ''", "pred_p10_search_summary")
def _p10(spark, folder):
    return S.summary(S.search(store_ledger(spark, folder, dated=False), status="Failed")).withColumn("total_amount", F.round("total_amount", 2))


@query("SELECT account_id, bank_name, status FROM accounts WHERE status = 'Active' AND contains(lower(coalesce(bank_name, '')), 'bank')", "pred_p11_account_search")
def _p11(spark, folder):
    return table(spark, folder, "accounts").where((F.col("status") == "Active") & F.contains(F.lower(F.coalesce("bank_name", F.lit(""))), F.lit("bank"))).select("account_id", "bank_name", "status")


@query("{L} SELECT transaction_id FROM L WHERE regexp_matches(descr, '(?i)cash|atm|withdrawal|chq')", "pred_p12_cash_words")
def _p12(spark, folder):
    return event_ledger(spark, folder).where(S.has_word(F.col("DESCRIPTION"), S.CASH_WORDS)).select("transaction_id")


@query("{L} SELECT transaction_id FROM L WHERE debit > 50000 OR credit > 50000", "pred_p13_large")
def _p13(spark, folder):
    return event_ledger(spark, folder).where("DEBIT > 50000 or CREDIT > 50000").select("transaction_id")


@query(f"SELECT transaction_id, {S.type_sql('description')} AS payment_type, coalesce(nullif(counterparty_merged, ''), nullif(description, ''), 'Unknown') AS label FROM transactions", "pred_p14_p15_type_and_label")
def _p14(spark, folder):
    return table(spark, folder, "transactions").select("transaction_id", S.payment_type(F.col("description")).alias("payment_type"), S.label(F.col("counterparty_merged"), F.col("description")).alias("label"))


@query("{L} SELECT entity_id AS src, cp AS dst, round(sum(amount), 2) AS total FROM L WHERE direction = 'DR' AND cp <> '' AND d >= TIMESTAMP '2024-01-05' GROUP BY 1, 2 HAVING sum(amount) >= 100000", "pred_p16_p17_network_filter")
def _p17(spark, folder):
    led = event_ledger(spark, folder).where("direction = 'DR' and counterparty <> ''").where(F.col("DATE") >= F.lit("2024-01-05").cast("timestamp"))
    return led.groupBy(F.col("entity_id").alias("src"), F.col("counterparty").alias("dst")).agg(F.round(F.sum("amount"), 2).alias("total")).where("total >= 100000")


@query("{L} SELECT transaction_id, (amount >= 8500 AND amount < 10000) OR (amount >= 17000 AND amount < 20000) OR (amount >= 42500 AND amount < 50000) OR (amount >= 85000 AND amount < 100000) AS near_threshold, amount % 1000 = 0 AS round_1000, amount % 500 = 0 AS round_500, amount % 100 = 0 AS round_100 FROM L", "pred_p18_p19_amount_shape")
def _p18(spark, folder):
    a = F.col("amount")
    near = F.lit(False)
    for t in (10_000, 20_000, 50_000, 100_000):
        near = near | ((a >= 0.85 * t) & (a < t))
    return event_ledger(spark, folder).select("transaction_id", near.alias("near_threshold"), *[(F.pmod(a, F.lit(float(n))) == 0).alias(f"round_{n}") for n in (1000, 500, 100)])


@query("SELECT case_id, case_name, status FROM cases WHERE investigating_agency IN (SELECT investigating_agency FROM cases WHERE status = 'Active')", "pred_p20_visible_cases")
def _p20(spark, folder):
    c = table(spark, folder, "cases")
    return c.join(c.where("status = 'Active' and investigating_agency is not null").select("investigating_agency").distinct(), "investigating_agency", "left_semi").select("case_id", "case_name", "status")


@query("""SELECT entity_id, CASE WHEN pan IS NOT NULL AND NOT regexp_full_match(pan, '[A-Z]{5}[0-9]{4}[A-Z]') THEN 1 ELSE 0 END AS bad_pan, CASE WHEN gstin IS NOT NULL AND NOT regexp_full_match(gstin, '[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9][A-Z][0-9]') THEN 1 ELSE 0 END AS bad_gstin,
 CASE WHEN risk_score IS NOT NULL AND risk_score NOT BETWEEN 0 AND 100 THEN 1 ELSE 0 END AS bad_risk FROM entities""", "pred_p21_identifiers")
def _p21(spark, folder):
    bad = lambda c, p: F.coalesce((~F.col(c).rlike(p)).cast("int"), F.lit(0))
    return table(spark, folder, "entities").select("entity_id", bad("pan", "^[A-Z]{5}[0-9]{4}[A-Z]$").alias("bad_pan"), bad("gstin", "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9][A-Z][0-9]$").alias("bad_gstin"), F.coalesce((~F.col("risk_score").between(0, 100)).cast("int"), F.lit(0)).alias("bad_risk"))


@query("{S} SELECT count(*) AS n, count(DISTINCT entity_id) AS entities, count(DISTINCT account_id) AS accounts FROM S")
def j01_ledger_join(spark, folder):
    return store_ledger(spark, folder, dated=False).agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("entities"), F.countDistinct("account_id").alias("accounts"))


@query("""SELECT c.case_id, count(DISTINCT ce.entity_id) AS entities, count(DISTINCT a.account_id) AS accounts, count(DISTINCT b.statement_id) AS statements FROM cases c LEFT JOIN case_entities ce ON ce.case_id = c.case_id LEFT JOIN accounts a ON a.entity_id = ce.entity_id
 LEFT JOIN bank_statements b ON b.account_id = a.account_id GROUP BY c.case_id""")
def j02_a02_case_overview(spark, folder):
    """Counts of a case's entities, accounts and statements. Statements are counted by account first, so the star doesn't fan out."""
    ce = table(spark, folder, "case_entities").select("case_id", "entity_id").distinct()
    per_account = table(spark, folder, "bank_statements").groupBy("account_id").agg(F.countDistinct("statement_id").alias("s"))
    per_entity = table(spark, folder, "accounts").select("account_id", "entity_id").distinct().join(per_account, "account_id", "left").groupBy("entity_id").agg(F.count("*").alias("a"), F.sum("s").alias("s"))
    sums = ce.join(per_entity, "entity_id", "left").groupBy("case_id").agg(F.countDistinct("entity_id").alias("e"), F.sum("a").alias("a"), F.sum("s").alias("s"))
    zero = lambda c, n: F.coalesce(F.col(c), F.lit(0)).alias(n)
    return table(spark, folder, "cases").select("case_id").join(sums, "case_id", "left").select("case_id", zero("e", "entities"), zero("a", "accounts"), zero("s", "statements"))


@query("SELECT entity_id FROM entities e WHERE EXISTS (SELECT 1 FROM transactions t WHERE t.entity_id = e.entity_id AND t.amount >= 200000)")
def j03_j04_semi(spark, folder):
    return table(spark, folder, "entities").join(table(spark, folder, "transactions").where("amount >= 200000").select("entity_id"), "entity_id", "left_semi").select("entity_id")


@query("SELECT transaction_id, statement_id FROM transactions t WHERE NOT EXISTS (SELECT 1 FROM bank_statements b WHERE b.statement_id = t.statement_id AND b.statement_period_to >= DATE '2024-01-01')")
def j05_orphans(spark, folder):
    """Transactions whose statement isn't among those that reach into 2024; a null statement_id is an orphan."""
    return table(spark, folder, "transactions").join(table(spark, folder, "bank_statements").where("statement_period_to >= date'2024-01-01'").select("statement_id"), "statement_id", "left_anti").select("transaction_id", "statement_id")


@query("""SELECT b.statement_id, coalesce(b.transaction_count, 0) AS expected, coalesce(t.n, 0) AS actual, CASE WHEN coalesce(b.transaction_count, 0) = coalesce(t.n, 0) THEN 'OK' ELSE 'MISMATCH' END AS consistency FROM bank_statements b
 LEFT JOIN (SELECT statement_id, count(*) AS n FROM transactions GROUP BY 1) t USING (statement_id)""")
def j06_consistency(spark, folder):
    n = table(spark, folder, "transactions").groupBy("statement_id").agg(F.count("*").alias("n"))
    e, a = F.coalesce("transaction_count", F.lit(0)), F.coalesce("n", F.lit(0))
    return table(spark, folder, "bank_statements").join(n, "statement_id", "left").select("statement_id", e.alias("expected"), a.alias("actual"), F.when(e == a, "OK").otherwise("MISMATCH").alias("consistency"))


@query("SELECT counterparty_merged AS counterparty, count(DISTINCT entity_id) AS entities, min(entity_id) AS first_entity FROM transactions WHERE counterparty_merged IS NOT NULL GROUP BY 1")
def j18_counterparty_entities(spark, folder):
    return table(spark, folder, "transactions").where("counterparty_merged is not null").groupBy(F.col("counterparty_merged").alias("counterparty")).agg(F.countDistinct("entity_id").alias("entities"), F.min("entity_id").alias("first_entity"))


@query("SELECT a.transaction_id AS debit_id, b.transaction_id AS credit_id FROM transactions a JOIN transactions b ON a.statement_id = b.statement_id AND b.original_index = a.original_index + 1 WHERE a.direction = 'DR' AND b.direction = 'CR'")
def j19_w02_next_in_file(spark, folder):
    t = table(spark, folder, "transactions").select("transaction_id", "statement_id", "original_index", "direction")
    a = t.where("direction = 'DR'").select(F.col("transaction_id").alias("debit_id"), "statement_id", (F.col("original_index") + 1).alias("original_index"))
    return a.join(t.where("direction = 'CR'"), ["statement_id", "original_index"]).select("debit_id", F.col("transaction_id").alias("credit_id"))


@query("""SELECT account_id, CAST(sum(CASE WHEN direction = 'CR' THEN amount ELSE 0 END) AS DECIMAL(20,2)) AS credits, CAST(sum(CASE WHEN direction = 'DR' THEN amount ELSE 0 END) AS DECIMAL(20,2)) AS debits, count(*) AS n FROM transactions GROUP BY 1""")
def a01_account_totals(spark, folder):
    side = lambda d: F.sum(F.when(F.col("direction") == d, F.col("amount")).otherwise(0)).cast("decimal(20,2)")
    return table(spark, folder, "transactions").groupBy("account_id").agg(side("CR").alias("credits"), side("DR").alias("debits"), F.count("*").alias("n"))


@query("SELECT entity_id, entity_name, risk_score, epoch_us(created_at) AS created_micros FROM entities WHERE risk_score >= 70")
def a04_high_risk(spark, folder):
    return table(spark, folder, "entities").where("risk_score >= 70").select("entity_id", "entity_name", "risk_score", F.unix_micros("created_at").alias("created_micros"))


@query("""WITH t AS (SELECT entity_id, count(*) AS n, sum(CAST(amount AS DOUBLE)) AS s, max(CAST(amount AS DOUBLE)) AS m, round(avg(CASE WHEN regexp_matches(coalesce(description, ''), '(?i)cash|atm|withdrawal|chq') THEN 1.0 ELSE 0.0 END), 2) AS r FROM transactions GROUP BY 1)
 SELECT e.entity_id, least(100, CASE WHEN s > 50000000 THEN 20 ELSE 0 END + CASE WHEN n > 300 THEN 15 ELSE 0 END + CASE WHEN r > 0.5 THEN 25 ELSE 0 END + CASE WHEN m >= 2000000 THEN 20 ELSE 0 END) AS score FROM entities e JOIN t USING (entity_id)""")
def a05_entity_risk(spark, folder):
    from ledgerloom.operators.risk import entity_risk

    return entity_risk(table(spark, folder, "transactions")).join(table(spark, folder, "entities").select("entity_id"), "entity_id", "left_semi").select("entity_id", "score")


@query("""WITH x AS (SELECT coalesce(nullif(counterparty_merged, ''), nullif(description, ''), 'Unknown') AS label, direction, CAST(amount AS DOUBLE) AS amount, created_at AS d, transaction_id, description FROM transactions),
 g AS (SELECT label, count(*) AS n, sum(CASE WHEN direction = 'DR' THEN amount ELSE 0 END) AS dr, sum(CASE WHEN direction = 'CR' THEN amount ELSE 0 END) AS cr, avg(amount) AS m, max(amount) AS x, min(d) AS f, max(d) AS l, greatest(1, CAST(ceil((epoch_us(max(d)) - epoch_us(min(d))) / 86400000000.0) AS BIGINT) + 1) AS days, arg_min(coalesce(description, ''), (d, transaction_id)) AS first_description FROM x GROUP BY 1)
 SELECT label, n, round(dr, 2) AS debit, round(cr, 2) AS credit, round(dr + cr, 2) AS volume, round(cr - dr, 2) AS net, round(m, 6) AS mean, round(x, 2) AS largest, epoch_us(f) AS first_micros, epoch_us(l) AS last_micros, days AS days_active, round(n * 1.0 / days, 4) AS frequency, first_description FROM g""")
def a06_counterparty_stats(spark, folder):
    """Each label's counts, sums by side, volume, net, mean and largest amount, first and last time it was recorded, days active, rows a day, and first description."""
    t = table(spark, folder, "transactions").select(S.label(F.col("counterparty_merged"), F.col("description")).alias("label"), "direction", F.col("amount").cast("double").alias("amount"), F.unix_micros("created_at").alias("d"), "transaction_id", F.coalesce("description", F.lit("")).alias("description"))
    side = lambda d: F.sum(F.when(F.col("direction") == d, F.col("amount")).otherwise(0.0))
    days = F.greatest(F.lit(1), F.ceil((F.max("d") - F.min("d")) / 86_400_000_000) + 1)
    g = t.groupBy("label").agg(F.count("*").alias("n"), side("DR").alias("dr"), side("CR").alias("cr"), F.round(F.avg("amount"), 6).alias("mean"), F.round(F.max("amount"), 2).alias("largest"), F.min("d").alias("first_micros"), F.max("d").alias("last_micros"), days.alias("days_active"), F.min_by("description", F.struct("d", "transaction_id")).alias("first_description"))
    two = lambda c, n: F.round(c, 2).alias(n)
    return g.select("label", "n", two(F.col("dr"), "debit"), two(F.col("cr"), "credit"), two(F.col("dr") + F.col("cr"), "volume"), two(F.col("cr") - F.col("dr"), "net"), "mean", "largest", "first_micros", "last_micros", "days_active", F.round(F.col("n") / F.col("days_active"), 4).alias("frequency"), "first_description")


@query("SELECT counterparty_merged AS counterparty, entity_id, count(*) AS n FROM transactions WHERE counterparty_merged IS NOT NULL AND entity_id IN (SELECT entity_id FROM case_entities JOIN cases USING (case_id) WHERE status = 'Active') GROUP BY 1, 2")
def a07_case_counterparties(spark, folder):
    """How often each entity of an active case deals with each counterparty."""
    members = table(spark, folder, "case_entities").join(table(spark, folder, "cases").where("status = 'Active'").select("case_id"), "case_id", "left_semi").select("entity_id")
    t = table(spark, folder, "transactions").where("counterparty_merged is not null").join(members, "entity_id", "left_semi")
    return t.groupBy(F.col("counterparty_merged").alias("counterparty"), "entity_id").agg(F.count("*").alias("n"))


def _sides(prefix: str = "") -> str:
    return "CAST(sum(CASE WHEN direction = 'DR' THEN amount ELSE 0 END) AS DECIMAL(20,2)) AS debits, CAST(sum(CASE WHEN direction = 'CR' THEN amount ELSE 0 END) AS DECIMAL(20,2)) AS credits, CAST(sum(CASE WHEN direction = 'CR' THEN amount WHEN direction = 'DR' THEN -amount ELSE 0 END) AS DECIMAL(20,2)) AS net"


def _side(d: str, name: str):
    return F.sum(F.when(F.col("direction") == d, F.col("amount")).otherwise(0)).cast("decimal(20,2)").alias(name)


def _net():
    return F.sum(F.when(F.col("direction") == "CR", F.col("amount")).when(F.col("direction") == "DR", -F.col("amount")).otherwise(0)).cast("decimal(20,2)").alias("net")


@query(f"SELECT {S.type_sql('description')} AS payment_type, count(*) AS n, CAST(sum(amount) AS DECIMAL(20,2)) AS total, {_sides()}, round(avg(CAST(amount AS DOUBLE)), 3) AS mean, min(amount) AS least, max(amount) AS most FROM transactions GROUP BY 1")
def a08_type_stats(spark, folder):
    return table(spark, folder, "transactions").groupBy(S.payment_type(F.col("description")).alias("payment_type")).agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(20,2)").alias("total"), _side("DR", "debits"), _side("CR", "credits"), _net(), F.round(F.avg(F.col("amount").cast("double")), 3).alias("mean"), F.min("amount").alias("least"), F.max("amount").alias("most"))


@query(f"SELECT CASE WHEN regexp_matches(coalesce(description, ''), '(?i)cash|atm|withdrawal|chq') THEN 'cash' ELSE 'bank' END AS channel, count(*) AS n, {_sides()}, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM transactions GROUP BY 1")
def a09_a32_cash_split(spark, folder):
    """Cash and bank movements: counts, sums, net, and their share of all rows."""
    g = table(spark, folder, "transactions").groupBy(F.when(S.has_word(F.coalesce("description", F.lit("")), S.CASH_WORDS), "cash").otherwise("bank").alias("channel")).agg(F.count("*").alias("n"), _side("DR", "debits"), _side("CR", "credits"), _net())
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))  # two rows


@query("""WITH g AS (SELECT entity_id, count(*) AS n, avg(CASE WHEN regexp_matches(coalesce(description, ''), '(?i)cash|atm|withdrawal|chq') THEN 1.0 ELSE 0.0 END) AS r, sum(CASE WHEN regexp_matches(coalesce(description, ''), '(?i)cash|atm|withdrawal|chq') THEN amount ELSE 0 END) AS v FROM transactions GROUP BY 1)
 SELECT entity_id, n, CAST(v AS DECIMAL(20,2)) AS cash_volume, round(r, 4) AS cash_share, CASE WHEN r >= 0.7 THEN 'high' WHEN r >= 0.4 THEN 'medium' ELSE 'low' END AS band FROM g""")
def a32_cash_bands(spark, folder):
    cash = S.has_word(F.coalesce("description", F.lit("")), S.CASH_WORDS)
    g = table(spark, folder, "transactions").groupBy("entity_id").agg(F.count("*").alias("n"), F.sum(F.when(cash, F.col("amount")).otherwise(0)).cast("decimal(20,2)").alias("cash_volume"), F.avg(cash.cast("double")).alias("r"))
    return g.select("entity_id", "n", "cash_volume", F.round("r", 4).alias("cash_share"), F.when(F.col("r") >= 0.7, "high").when(F.col("r") >= 0.4, "medium").otherwise("low").alias("band"))


@query("SELECT counterparty_merged AS counterparty, entity_id, CAST(sum(amount) AS DECIMAL(20,2)) AS total, CAST(sum(sum(amount)) OVER (PARTITION BY counterparty_merged) AS DECIMAL(20,2)) AS row_total FROM transactions WHERE counterparty_merged IS NOT NULL GROUP BY 1, 2")
def a10_matrix(spark, folder):
    """The matrix of counterparties by entities in long form, with row totals; both levels are summed before they meet."""
    t = table(spark, folder, "transactions").where("counterparty_merged is not null")
    cell = t.groupBy(F.col("counterparty_merged").alias("counterparty"), "entity_id").agg(F.sum("amount").cast("decimal(20,2)").alias("total"))
    return cell.join(cell.groupBy("counterparty").agg(F.sum("total").cast("decimal(20,2)").alias("row_total")), "counterparty")


@query("""WITH a AS (SELECT DISTINCT entity_id FROM transactions WHERE entity_id IS NOT NULL) SELECT count(*) AS asked, count(e.entity_id) AS found, round(count(e.entity_id) * 100.0 / count(*), 2) AS success_rate, string_agg(CASE WHEN e.entity_id IS NULL THEN a.entity_id END, ',' ORDER BY a.entity_id) AS missing FROM a LEFT JOIN (SELECT DISTINCT entity_id FROM entities) e USING (entity_id)""")
def a33_coverage(spark, folder):
    """How many of the entities that transactions name are registered, and which aren't (as one text: a report of a ledger's gaps)."""
    a = table(spark, folder, "transactions").where("entity_id is not null").select("entity_id").distinct()
    j = a.join(table(spark, folder, "entities").select("entity_id").distinct().withColumn("there", F.lit(1)), "entity_id", "left")
    return j.agg(F.count("*").alias("asked"), F.count("there").alias("found"), F.round(F.count("there") * 100.0 / F.count("*"), 2).alias("success_rate"), F.nullif(F.array_join(F.sort_array(F.collect_list(F.when(F.col("there").isNull(), F.col("entity_id")))), ","), F.lit("")).alias("missing"))


@query("""WITH s AS (SELECT account_id, count(*) AS k FROM bank_statements GROUP BY 1) SELECT e.entity_id, count(a.account_id) AS accounts, CAST(coalesce(sum(k), 0) AS BIGINT) AS statements, coalesce(string_agg(a.account_id, ',' ORDER BY a.account_id), '') AS account_ids FROM entities e LEFT JOIN accounts a USING (entity_id) LEFT JOIN s USING (account_id) GROUP BY 1""")
def a31_entity_accounts(spark, folder):
    """Each entity with its accounts and how many statements they have; an entity has few accounts."""
    k = table(spark, folder, "bank_statements").groupBy("account_id").agg(F.count("*").alias("k"))
    a = table(spark, folder, "accounts").select("account_id", "entity_id").join(k, "account_id", "left").groupBy("entity_id").agg(F.count("*").alias("accounts"), F.sum("k").alias("statements"), F.array_join(F.sort_array(F.collect_list("account_id")), ",").alias("account_ids"))
    return table(spark, folder, "entities").select("entity_id").join(a, "entity_id", "left").select("entity_id", F.coalesce("accounts", F.lit(0)).alias("accounts"), F.coalesce("statements", F.lit(0)).alias("statements"), F.coalesce("account_ids", F.lit("")).alias("account_ids"))


@query("""WITH t AS (SELECT entity_id, count(*) AS k, sum(CAST(amount AS DOUBLE)) AS s FROM transactions GROUP BY 1) SELECT ce.case_id, count(DISTINCT ce.entity_id) AS entities, count(DISTINCT ce.entity_id) FILTER (e.risk_score >= 70) AS risky, count(DISTINCT ce.entity_id) FILTER (e.is_verified) AS verified, round(avg(e.risk_score), 4) AS mean_risk FROM case_entities ce JOIN entities e USING (entity_id) GROUP BY 1""")
def a02_case_risk(spark, folder):
    """Distinct entities of a case, those of high risk and those verified, and the mean risk over its rows."""
    j = table(spark, folder, "case_entities").select("case_id", "entity_id").join(table(spark, folder, "entities").select("entity_id", "risk_score", "is_verified"), "entity_id")
    only = lambda t: F.countDistinct(F.when(t, F.col("entity_id")))
    return j.groupBy("case_id").agg(F.countDistinct("entity_id").alias("entities"), only(F.col("risk_score") >= 70).alias("risky"), only(F.col("is_verified")).alias("verified"), F.round(F.avg("risk_score"), 4).alias("mean_risk"))


@query("{L}, q AS (SELECT transaction_id, amount, credit > 0 AS is_credit, debit > 0 AS is_debit, CASE WHEN credit > 0 THEN 'credit' ELSE 'debit' END AS transaction_type FROM L) SELECT * FROM q", "pred_p05_flags")
def _p05(spark, folder):
    d, c = F.col("DEBIT"), F.col("CREDIT")
    return event_ledger(spark, folder).select("transaction_id", "amount", (c > 0).alias("is_credit"), (d > 0).alias("is_debit"), F.when(c > 0, "credit").otherwise("debit").alias("transaction_type"))


@query("""WITH g AS (SELECT statement_id, original_index, original_index - lag(original_index) OVER (PARTITION BY statement_id ORDER BY original_index, transaction_id) - 1 AS gap FROM transactions WHERE statement_id IS NOT NULL)
 SELECT statement_id, count(*) AS n, min(original_index) AS first_index, max(original_index) AS last_index, count(CASE WHEN gap > 0 THEN 1 END) AS gaps, count(CASE WHEN gap < 0 THEN 1 END) AS repeats FROM g GROUP BY 1""")
def w02_index_gaps(spark, folder):
    """Each file's rows, first and last place, how often places are missing between neighbours and how often one repeats."""
    w = W.partitionBy("statement_id").orderBy("original_index", "transaction_id")
    g = table(spark, folder, "transactions").where("statement_id is not null").select("statement_id", "original_index", (F.col("original_index") - F.lag("original_index").over(w) - 1).alias("gap"))
    return g.groupBy("statement_id").agg(F.count("*").alias("n"), F.min("original_index").alias("first_index"), F.max("original_index").alias("last_index"), F.count(F.when(F.col("gap") > 0, 1)).alias("gaps"), F.count(F.when(F.col("gap") < 0, 1)).alias("repeats"))


@query("SELECT e.entity_id, count(t.transaction_id) AS n FROM entities e LEFT JOIN transactions t USING (entity_id) GROUP BY 1")
def a29_a33_zero_filled_counts(spark, folder):
    n = table(spark, folder, "transactions").groupBy("entity_id").agg(F.count("transaction_id").alias("k"))
    return table(spark, folder, "entities").select("entity_id").join(n, "entity_id", "left").select("entity_id", F.coalesce("k", F.lit(0)).alias("n"))


@query("SELECT primary_phone, count(*) AS n, string_agg(entity_id, ',' ORDER BY entity_id) AS entities FROM entities WHERE primary_phone IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def a30_shared_identifiers(spark, folder):
    return table(spark, folder, "entities").where("primary_phone is not null").groupBy("primary_phone").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("entity_id")), ",").alias("entities")).where("n > 1")


@query("SELECT a.account_id, count(b.statement_id) AS statements, epoch_us(max(b.upload_date)) AS last_upload_micros FROM accounts a LEFT JOIN bank_statements b USING (account_id) GROUP BY 1")
def a31_account_statements(spark, folder):
    b = table(spark, folder, "bank_statements").groupBy("account_id").agg(F.count("statement_id").alias("k"), F.max("upload_date").alias("last_upload"))
    return table(spark, folder, "accounts").select("account_id").join(b, "account_id", "left").select("account_id", F.coalesce("k", F.lit(0)).alias("statements"), F.unix_micros("last_upload").alias("last_upload_micros"))


@query("SELECT ce.case_id, t.direction, count(*) AS n, CAST(sum(t.amount) AS DECIMAL(20,2)) AS total FROM (SELECT DISTINCT case_id, entity_id FROM case_entities) ce JOIN transactions t USING (entity_id) GROUP BY 1, 2")
def a35_case_transactions(spark, folder):
    """Sums of a case's transactions by direction; an entity's are summed once, however many cases it is in."""
    sums = table(spark, folder, "transactions").groupBy("entity_id", "direction").agg(F.count("*").alias("k"), F.sum("amount").alias("s"))
    return table(spark, folder, "case_entities").select("case_id", "entity_id").distinct().join(sums, "entity_id").groupBy("case_id", "direction").agg(F.sum("k").alias("n"), F.sum("s").cast("decimal(20,2)").alias("total"))


@query("SELECT case_type, status, count(*) AS n, epoch_us(max(created_at)) AS last_created_micros FROM cases WHERE status <> 'Closed' GROUP BY 1, 2")
def a03_open_summary(spark, folder):
    return table(spark, folder, "cases").where("status <> 'Closed'").groupBy("case_type", "status").agg(F.count("*").alias("n"), F.unix_micros(F.max("created_at")).alias("last_created_micros"))


@query("SELECT counterparty_merged AS counterparty, count(*) AS n, CAST(sum(amount) AS DECIMAL(20,2)) AS volume FROM transactions WHERE counterparty_merged IS NOT NULL GROUP BY 1 ORDER BY volume DESC, counterparty LIMIT 10")
def t02_top_counterparties(spark, folder):
    t = table(spark, folder, "transactions").where("counterparty_merged is not null").groupBy(F.col("counterparty_merged").alias("counterparty")).agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(20,2)").alias("volume"))
    return t.orderBy(F.desc("volume"), "counterparty").limit(10)


@query("{L} SELECT count(*) AS n, round(sum(credit), 2) AS credits, round(sum(debit), 2) AS debits, epoch_us(min(d)) AS first_micros, epoch_us(max(d)) AS last_micros FROM L")
def a28_a21_summary(spark, folder):
    return event_ledger(spark, folder).agg(F.count("*").alias("n"), F.round(F.sum("CREDIT"), 2).alias("credits"), F.round(F.sum("DEBIT"), 2).alias("debits"), F.unix_micros(F.min("DATE")).alias("first_micros"), F.unix_micros(F.max("DATE")).alias("last_micros"))


@query("SELECT DISTINCT entity_id, entity_name FROM entities")
def u01_distinct_entities(spark, folder):
    return table(spark, folder, "entities").select("entity_id", "entity_name").distinct()


@query("{L} SELECT 'debit' AS side, debit AS amount FROM L UNION ALL SELECT 'credit', credit FROM L")
def u02_both_sides(spark, folder):
    led = event_ledger(spark, folder)
    return led.select(F.lit("debit").alias("side"), F.col("DEBIT").alias("amount")).unionAll(led.select(F.lit("credit").alias("side"), F.col("CREDIT").alias("amount")))


@query("SELECT case_id, string_agg(DISTINCT entity_role, ',' ORDER BY entity_role) AS roles FROM case_entities GROUP BY 1")
def u03_u05_role_sets(spark, folder):
    return table(spark, folder, "case_entities").groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("entity_role")), ",").alias("roles"))


@query("SELECT transaction_id, account_id, amount FROM (SELECT *, row_number() OVER (PARTITION BY account_id, amount, description ORDER BY batch_no, transaction_id) AS n FROM transactions) WHERE n = 1")
def u04_first_of_key(spark, folder):
    return S.latest(table(spark, folder, "transactions"), ["account_id", "amount", "description"], F.col("batch_no"), F.col("transaction_id")).select("transaction_id", "account_id", "amount")
