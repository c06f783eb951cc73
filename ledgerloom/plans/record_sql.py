"""SQL of the record queries: records are split by one expression over the whole record, and dates are read by the
database's own parser from format lists, so neither shares code with the operators they check."""

from __future__ import annotations

from ledgerloom.functions.dates import ZONE_MINUTES
from ledgerloom.sources.headers import ROLE_RULES

_FIELD = r'"(?:[^"]|"")*"|[^",][^,]*|'
_AMOUNT = r"\s*(?:\+\s*)?(?:(?:₹|[Rr][Ss]\.?)\s*)?(?:\+\s*)?(?:[0-9]+(?:,[0-9]+)*(?:\.[0-9]*)?|\.[0-9]+)\s*"
_ZERO = r"[^1-9]*"


def _split(text: str) -> str:
    """The fields of a record as a list, null where its quoting is broken."""
    whole = f"regexp_full_match({text}, '(?s)(?:{_FIELD})(?:,(?:{_FIELD}))*')"
    fields = f"list_transform(regexp_extract_all({text} || ',', '(?s)({_FIELD}),', 1), lambda x: CASE WHEN starts_with(x, '\"') THEN replace(x[2:-2], '\"\"', '\"') ELSE x END)"
    return f"CASE WHEN {whole} THEN {fields} END"


def _role(name: str) -> str:
    folded = f"trim(regexp_replace(lower({name}), '[^a-z0-9]+', ' ', 'g'))"
    whens = " ".join(f"WHEN regexp_matches({folded}, '{p}') THEN '{r}'" for r, p in ROLE_RULES)
    return f"CASE {whens} ELSE 'other' END"


def _bad(at: str) -> str:
    return f"({at} > 0 AND NOT regexp_full_match(f[{at}], '\\s*|{_AMOUNT}'))"


def _none(at: str) -> str:
    return f"({at} = 0 OR regexp_full_match(f[{at}], '{_ZERO}'))"


_TRIM = r"regexp_replace(raw_text, '\r?\n?\z', '')"
#: X: line_id, statement_id, line_no, names, roles, f (fields), reason of each record that isn't a header.
RECORDS = rf"""H0 AS (SELECT statement_id, arg_min(raw_text, line_id) AS raw_text FROM statement_lines WHERE line_no = 1 AND statement_id IS NOT NULL GROUP BY 1),
 H1 AS (SELECT statement_id, list_transform({_split(_TRIM)}, lambda x: trim(x)) AS names FROM H0),
 H2 AS (SELECT statement_id, names, list_transform(names, lambda n: {_role("n")}) AS r FROM H1 WHERE names IS NOT NULL),
 H AS (SELECT statement_id, names, CASE WHEN NOT list_contains(r, 'date') THEN list_transform(r, lambda x, i: CASE WHEN i = list_position(r, 'value_date') THEN 'date' ELSE x END) ELSE r END AS roles FROM H2),
 X0 AS (SELECT line_id, statement_id, line_no, coalesce({_TRIM}, '') AS t FROM statement_lines WHERE coalesce(line_no, 0) <> 1),
 X1 AS (SELECT X0.*, {_split("t")} AS f, names, roles, coalesce(list_position(roles, 'debit'), 0) AS pd, coalesce(list_position(roles, 'credit'), 0) AS pc, coalesce(list_position(roles, 'amount'), 0) AS pa, coalesce(list_position(roles, 'description'), 0) AS pt FROM X0 LEFT JOIN H USING (statement_id)),
 X AS (SELECT *, CASE WHEN f IS NULL THEN 'quoting' WHEN roles IS NULL OR len(f) <> len(roles) THEN 'column_count'
 WHEN pd + pc > 0 AND ({_bad("pd")} OR {_bad("pc")} OR ({_none("pd")} AND {_none("pc")})) THEN 'invalid_value'
 WHEN pd + pc = 0 AND pa > 0 AND NOT (regexp_full_match(regexp_replace(f[pa], '-', ''), '{_AMOUNT}') AND regexp_matches(f[pa], '[1-9]')) THEN 'invalid_value'
 WHEN pt > 0 AND regexp_full_match(f[pt], '\s*') THEN 'invalid_value' END AS reason FROM X1)"""

_CLOCK = r"[ T](\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?) ?(AM|PM|am|pm)? ?(Z|[A-Z]{3,4}|[+-]\d{2}:?\d{2})?$"
_COMPACT = r"^(\d{8})T(\d{2})(\d{2})(\d{2})(Z|[+-]\d{2}:?\d{2})?$"


def instants(source: str, name: str) -> str:
    """CTEs that end in ``name``: source (which has w, zone, ord) with utc (micros), day and plain; null where w can't be read."""
    n = name
    local = f"make_timestamp(lt)"  # noqa: F541
    offset = lambda at: f"(epoch_us(timezone(zone, make_timestamptz({at}))) - ({at}))"
    zones = " ".join(f"WHEN '{k}' THEN {v}" for k, v in ZONE_MINUTES.items())
    return rf"""{n}0 AS (SELECT * REPLACE (trim(w) AS w, coalesce(zone, 'UTC') AS zone, coalesce(ord, 'DMY') AS ord), regexp_matches(trim(w), '^\d{{4}}-\d{{2}}-\d{{2}}$') AS plain FROM {source}),
 {n}1 AS (SELECT *, CASE WHEN regexp_matches(w, '{_COMPACT}') THEN regexp_replace(w, '{_COMPACT}', '\1 \2:\3:\4\5') ELSE w END AS x FROM {n}0),
 {n}2 AS (SELECT *, regexp_replace(regexp_replace(x, '{_CLOCK}', ''), '^[A-Za-z]{{3,9}}, ', '') AS b, regexp_extract(x, '{_CLOCK}', ['c', 'ap', 'z']) AS k, regexp_matches(x, '{_CLOCK}') AS clocked FROM {n}1),
 {n}3 AS (SELECT *, CASE
 WHEN regexp_full_match(b, '\d{{4}}-\d{{1,2}}-\d{{1,2}}') THEN CASE WHEN clocked OR plain THEN try_strptime(b, '%Y-%m-%d') END
 WHEN regexp_full_match(b, '\d{{8}}') THEN try_strptime(b, '%Y%m%d')
 WHEN regexp_full_match(b, '\d{{5}}') AND NOT clocked THEN CAST(DATE '1899-12-30' + CAST(b AS INT) AS TIMESTAMP)
 WHEN regexp_full_match(b, '\d{{4}}/\d{{1,2}}/\d{{1,2}}') THEN try_strptime(b, '%Y/%m/%d')
 WHEN regexp_full_match(b, '\d{{4}}\.\d{{1,2}}\.\d{{1,2}}') THEN try_strptime(b, '%Y.%m.%d')
 WHEN regexp_full_match(b, '\d{{1,2}}(/\d{{1,2}}/|\.\d{{1,2}}\.|-\d{{1,2}}-)(\d{{4}}|\d{{2}})') THEN CASE WHEN ord = 'MDY' THEN try_strptime(regexp_replace(regexp_replace(b, '[/.]', '-', 'g'), '-(\d\d)$', '-20\1'), '%m-%d-%Y') ELSE try_strptime(regexp_replace(regexp_replace(b, '[/.]', '-', 'g'), '-(\d\d)$', '-20\1'), '%d-%m-%Y') END
 WHEN regexp_full_match(b, '\d{{1,2}}[ -][A-Za-z]{{3,9}}[ -](\d{{4}}|\d{{2}})') THEN try_strptime(regexp_replace(regexp_replace(b, '^(\d+)[ -]([A-Za-z]{{3}})[A-Za-z]*[ -]', '\1-\2-'), '-(\d\d)$', '-20\1'), '%d-%b-%Y')
 WHEN regexp_full_match(b, '[A-Za-z]{{3,9}} \d{{1,2}}, \d{{4}}') THEN try_strptime(regexp_replace(b, '^([A-Za-z]{{3}})[A-Za-z]* (\d+), ', '\2-\1-'), '%d-%b-%Y') END AS dt,
 CASE WHEN regexp_full_match(w, '\d{{10}}|\d{{13}}|\d{{16}}') THEN CAST(rpad(w, 16, '0') AS BIGINT) END AS epo FROM {n}2),
 {n}4 AS (SELECT *, CASE WHEN k.c = '' THEN 0 ELSE (TRY_CAST(split_part(k.c, ':', 1) AS INT) * 3600 + TRY_CAST(split_part(k.c, ':', 2) AS INT) * 60) * CAST(1000000 AS BIGINT) + coalesce(CAST(round(TRY_CAST(nullif(split_part(k.c, ':', 3), '') AS DECIMAL(12, 6)) * 1000000) AS BIGINT), 0)
 + CASE WHEN upper(k.ap) = 'PM' AND TRY_CAST(split_part(k.c, ':', 1) AS INT) < 12 THEN 43200000000 WHEN upper(k.ap) = 'AM' AND TRY_CAST(split_part(k.c, ':', 1) AS INT) = 12 THEN -43200000000 ELSE 0 END END AS tod,
 k.c = '' OR (TRY_CAST(split_part(k.c, ':', 1) AS INT) < 24 AND TRY_CAST(split_part(k.c, ':', 2) AS INT) < 60 AND (k.ap = '' OR TRY_CAST(split_part(k.c, ':', 1) AS INT) BETWEEN 1 AND 12)) AS fits,
 CASE WHEN k.z = '' THEN NULL WHEN regexp_matches(k.z, '^[+-]') THEN CASE WHEN k.z[1] = '-' THEN -1 ELSE 1 END * (TRY_CAST(k.z[2:3] AS INT) * 60 + TRY_CAST(k.z[-2:] AS INT)) ELSE CASE k.z {zones} END END AS off FROM {n}3),
 {n}5 AS (SELECT *, CASE WHEN fits THEN epoch_us(dt) + tod END AS lt FROM {n}4),
 {n}6 AS (SELECT *, lt - {offset("lt - 93600000000")} AS ua, lt - {offset("lt + 93600000000")} AS ub FROM {n}5),
 {n}7 AS (SELECT *, CASE WHEN epo IS NOT NULL THEN epo WHEN k.z <> '' THEN lt - off * CAST(60000000 AS BIGINT) WHEN ua + {offset("ua")} = lt THEN ua WHEN ub + {offset("ub")} = lt THEN ub ELSE ua END AS utc FROM {n}6),
 {n} AS (SELECT * EXCLUDE (x, b, k, clocked, dt, epo, tod, fits, off, lt, ua, ub), CAST(make_timestamp(CASE WHEN epo IS NOT NULL OR k.z <> '' THEN utc + {offset("utc")} WHEN utc IS NOT NULL THEN lt END) AS DATE) AS day FROM {n}7)"""


_ZONES = "FZ AS (SELECT statement_id, min(zone_name) AS zone, min(day_order) AS ord FROM bank_statements WHERE statement_id IS NOT NULL GROUP BY 1)"
#: T: transactions with utc, day and plain.
DATED = f"{_ZONES}, T_ AS (SELECT t.*, tx_date AS w, zone, ord FROM transactions t LEFT JOIN FZ USING (statement_id)), {instants('T_', 'T')}"
LINES_DATED = f"XD AS (SELECT line_id, f[list_position(roles, 'date')] AS w, zone, ord FROM X LEFT JOIN FZ USING (statement_id) WHERE reason IS NULL AND list_contains(roles, 'date')), {instants('XD', 'Y')}"

P3_FOUND = f"WITH {RECORDS} SELECT DISTINCT line_id, reason FROM X WHERE reason IS NOT NULL"
P3_LOADED = f"WITH {RECORDS} SELECT line_id, statement_id, line_no, array_to_string(f, '\x1f') AS fields FROM X WHERE reason IS NULL"
P4_FOUND = f"""WITH {DATED}, {RECORDS}, {LINES_DATED} SELECT DISTINCT 'transactions' AS table_name, transaction_id AS row_key, utc AS utc_micros FROM T WHERE utc IS NOT NULL AND NOT plain
 UNION SELECT 'statement_lines', CAST(line_id AS VARCHAR), utc FROM Y WHERE utc IS NOT NULL AND NOT plain"""
_DAYS = f"""WITH {DATED}, D AS (SELECT entity_id, day, count(*) AS n, coalesce(sum(CASE WHEN direction = 'DR' THEN amount END), 0) AS dr, coalesce(sum(CASE WHEN direction = 'CR' THEN amount END), 0) AS cr, count(CASE WHEN direction = 'DR' THEN amount END) AS ndr, count(CASE WHEN direction = 'CR' THEN amount END) AS ncr FROM T WHERE day IS NOT NULL AND entity_id IS NOT NULL GROUP BY 1, 2),
 S AS (SELECT entity_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM D GROUP BY 1)"""
P7_FOUND = _DAYS + " SELECT S.entity_id, strftime(S.day, '%Y-%m-%d') AS quiet_day FROM S LEFT JOIN D ON D.entity_id = S.entity_id AND D.day BETWEEN S.day - 29 AND S.day GROUP BY S.entity_id, S.day HAVING count(D.day) = 0"


def _window(w: int) -> str:
    total = lambda c: f"coalesce(sum({c}) OVER w{w}, 0) AS {c}{w}"
    return ", ".join(total(c) for c in ("n", "dr", "cr", "ndr", "ncr"))


def _mean(cents: str, n: str, name: str) -> str:
    """The mean to four places, halves up, in whole numbers."""
    return f"CASE WHEN {n} > 0 THEN (CAST(({cents}) * 100 AS HUGEINT) * 200 + ({n})) // (2 * ({n})) / 10000.0 END AS {name}"


def _given(w: int) -> str:
    means = ", ".join((_mean(f"dr{w}", f"ndr{w}", f"dr_mean_{w}d"), _mean(f"cr{w}", f"ncr{w}", f"cr_mean_{w}d"), _mean(f"dr{w} + cr{w}", f"ndr{w} + ncr{w}", f"mean_{w}d")))
    return f"CAST(dr{w} AS DECIMAL(20,2)) AS dr_total_{w}d, CAST(cr{w} AS DECIMAL(20,2)) AS cr_total_{w}d, {means}"


P7_ROLLING = _DAYS + f""", A AS (SELECT S.entity_id, S.day, coalesce(n, 0) AS n, coalesce(dr, 0) AS dr, coalesce(cr, 0) AS cr, coalesce(ndr, 0) AS ndr, coalesce(ncr, 0) AS ncr FROM S LEFT JOIN D USING (entity_id, day)),
 B AS (SELECT entity_id, day, {_window(7)}, {_window(30)} FROM A WINDOW w7 AS (PARTITION BY entity_id ORDER BY day ROWS 6 PRECEDING), w30 AS (PARTITION BY entity_id ORDER BY day ROWS 29 PRECEDING))
 SELECT entity_id, day, CAST(n7 AS BIGINT) AS rows_7d, CAST(n30 AS BIGINT) AS rows_30d, {_given(7)}, {_given(30)} FROM B"""
SQL = {"p3_found": P3_FOUND, "p3_loaded": P3_LOADED, "p4_found": P4_FOUND, "p7_found": P7_FOUND, "p7_rolling": P7_ROLLING}
