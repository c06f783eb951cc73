"""What the fields of a statement file mean, told from their names.

A header's fields are brought to roles: the movement's date, the value date, description, debit, credit, amount,
direction, balance, and side fields (cheque number, branch, channel, transaction number). A name no rule knows is its own role.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

#: Rules in order: the first that holds gives the role. Each is a pattern over the name in lower case, other signs as blanks.
ROLE_RULES = (
    ("value_date", r"\b(val|value)\b.*\b(date|dt|on)\b|\bval dt\b|^value date$"),
    ("cheque", r"\b(chq|cheque|check|instrument)\b"),
    ("branch", r"\b(branch|sol)\b"),
    ("channel", r"^(mode|channel)$|\b(mode|channel) of\b"),
    ("txn_id", r"\b(txn|tran|transaction|trans)\b ?\b(uid|id|no|ref)\b|\buid\b|\btxnid\b|^(utr|reference) ?(no)?$"),
    ("direction", r"^(d c|dr cr|cr dr|sign|direction|debit credit|type)$"),
    ("balance", r"\b(balance|bal|closing)\b"),
    ("debit", r"\b(debit|debits|dr|withdrawal|withdrawals|outflow|outflows|payment|payments|paid out|money out|wdl)\b"),
    ("credit", r"\b(credit|credits|cr|deposit|deposits|inflow|inflows|receipt|receipts|paid in|money in)\b"),
    ("date", r"\b(date|dt|when|posted|booked|day)\b|^date time$"),
    ("description", r"\b(description|particulars|narration|narrative|details|detail|remark|remarks|text|what|desc)\b"),
    ("amount", r"\b(amount|amt)\b"),
)
_RULES = tuple((role, re.compile(pattern)) for role, pattern in ROLE_RULES)


def folded(name: str) -> str:
    """The name in lower case, every run of other signs as one blank."""
    return re.sub(r"[^a-z0-9]+", " ", name.lower()).strip()


def role_of(name: str) -> str:
    """The role a single name tells; ``other:<folded name>`` where no rule knows it."""
    text = folded(name)
    for role, rule in _RULES:
        if rule.search(text):
            return role
    return f"other:{text}"


#: Roles that a bank's mapping tells, and the column that holds the name.
MAPPED = {"date": "date_header", "description": "description_header", "debit": "debit_header", "credit": "credit_header", "amount": "amount_header", "direction": "direction_header"}


def bank_roles(mappings: Iterable[dict]) -> tuple[dict[str, dict[str, str]], dict[str, str]]:
    """Folded name to role by bank key, and over all banks for the names that no rule knows and no two banks read otherwise."""
    by_bank: dict[str, dict[str, str]] = {}
    pooled: dict[str, set[str]] = {}
    for m in mappings:
        for role, column in MAPPED.items():
            if m.get(column):
                by_bank.setdefault(m["bank_key"], {})[folded(m[column])] = role
                pooled.setdefault(folded(m[column]), set()).add(role)
    return by_bank, {n: min(r) for n, r in pooled.items() if len(r) == 1 and role_of(n).startswith("other:")}


def roles_of(names: list[str], known: dict[str, str] | None = None) -> list[str]:
    """A role for each field of a header; ``known`` maps folded names to roles and goes first (a bank's mapping).

    Without another date field, a value date is the movement's date. Of several fields of one role the first keeps it;
    a further one is ``role#2`` and so on, so that roles are unique within a header.
    """
    known = known or {}
    roles = [known.get(folded(n)) or role_of(n) for n in names]
    if "date" not in roles and "value_date" in roles:
        roles[roles.index("value_date")] = "date"
    seen: dict[str, int] = {}
    out = []
    for role in roles:
        seen[role] = seen.get(role, 0) + 1
        out.append(role if seen[role] == 1 else f"{role}#{seen[role]}")
    return out
