"""Small writers of portable SQL for the comparison queries."""

from __future__ import annotations

from folioflow import schemas as S
from folioflow.sources.tables import CORPUS, plain_sql


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def p1(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def consuming(pattern: str) -> str:
    """Look-ahead as a consumed group: the same first group of a first match."""
    return "(?im)" + pattern.replace("(?=", "(?:")


def field_sql(rule, text: str = "text") -> str:
    if rule == "head":
        return p1(f"left({text}, 300)")
    if isinstance(rule, tuple):
        found = f"list_transform(regexp_extract_all({text}, {q(consuming(rule[0]))}, 1), lambda x: {p1('x')})"
        return f"array_to_string(list_filter({found}, lambda x, i: x <> '' AND list_position({found}, x) = i)[1:{rule[1]}], '; ')"
    return p1(f"regexp_extract({text}, {q(consuming(rule))}, 1)")


FOLDED = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


def candidates_sql() -> str:
    """One row a document and route: route, k (order), confidence, signals, threshold."""
    parts = []
    for k, (route, _, _, threshold, patterns) in enumerate(S.ROUTE_RULES):
        score = " + ".join(["cast(0 as double)"] + [f"CASE WHEN regexp_matches(t, {q(p)}) THEN cast({w} as double) ELSE 0 END" for p, w in patterns])
        signals = " + ".join(f"CASE WHEN regexp_matches(t, {q(p)}) THEN 1 ELSE 0 END" for p, _ in patterns)
        parts.append(f"SELECT job_id, {q(route)} AS route, {k} AS k, cast(printf('%.4f', least(cast(0.99 as double), cast(0.20 as double) + least({score}, cast(0.85 as double)) + least(ocr_confidence, 1.0) * cast(0.12 as double))) as double) AS confidence, {signals} AS signals, cast({threshold} as double) AS threshold FROM folded")
    return " UNION ALL ".join(parts)


CLASSIFIED = f"""WITH corpus AS ({plain_sql(CORPUS)}), folded AS (SELECT *, {FOLDED} AS t FROM corpus),
cand AS ({candidates_sql()}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY confidence DESC, signals DESC, k) AS r FROM cand) WHERE r = 1),
classified AS (SELECT f.*, CASE WHEN f.fallback_used OR length(t) < 12 OR b.confidence < b.threshold THEN 'generic' ELSE b.route END AS route,
  CASE WHEN f.fallback_used THEN cast(0.35 as double) WHEN length(t) < 12 THEN 0.45 WHEN b.confidence < b.threshold THEN 0.5 ELSE b.confidence END AS classification_confidence,
  CASE WHEN f.fallback_used OR length(t) < 12 OR b.confidence < b.threshold THEN 0 ELSE b.signals END AS matched_signal_count,
  CASE WHEN f.fallback_used THEN 'ocr_fallback' WHEN length(t) < 12 THEN 'insufficient_text' WHEN b.confidence < b.threshold THEN 'no_route_threshold_met' ELSE 'matched_rules' END AS reason
  FROM folded f JOIN best b USING (job_id))"""


def slots_sql(route: str) -> list[str]:
    return [f"{field_sql(S.PATTERNS[route][name])} AS f{k}" for k, name in enumerate(S.FIELDS[route])]


#: Every document's five fields f0..f4 in its route's order, and the confidence.
EXTRACTED = CLASSIFIED + ", slots AS (" + " UNION ALL ".join(f"SELECT *, {', '.join(slots_sql(r))} FROM classified WHERE route = {q(r)}" for r in S.ROUTES) + """),
extracted AS (SELECT *, cast(printf('%.4f', least(cast(0.99 as double), cast(0.60 as double) * ocr_confidence + cast(0.35 as double) * (((f0 <> '')::int + (f1 <> '')::int + (f2 <> '')::int + (f3 <> '')::int + (f4 <> '')::int) / cast(5 as double)))) as double) AS confidence FROM slots)"""


def name_sql(k: int) -> str:
    return "CASE route " + " ".join(f"WHEN {q(r)} THEN {q(S.FIELDS[r][k])}" for r in S.ROUTES) + " END"


def failing(part: int, test: str) -> str:
    """Comma list of the rule set's names (in its order) whose value meets ``test`` (``{v}``)."""
    arms = []
    for r in S.ROUTES:
        items = ", ".join(f"CASE WHEN {test.format(v=f'f{S.FIELDS[r].index(n)}')} THEN {q(n)} END" for n in S.RULESETS[r][part])
        arms.append(f"WHEN {q(r)} THEN " + (f"concat_ws(',', {items})" if items else "''"))
    return "CASE resolved_route " + " ".join(arms) + " END"


def hint_sql() -> str:
    return "CASE WHEN route <> 'generic' THEN route ELSE 'generic' END"


LOW = "least(cast(0.99 as double), ocr_confidence * cast(0.75 as double) + cast(0.20 as double)) < 0.6"
VALIDATED = EXTRACTED + f""", routed AS (SELECT *, {hint_sql()} AS resolved_route FROM extracted),
checked AS (SELECT *, {failing(0, "{v} = ''")} AS no_req, {failing(1, "{v} = ''")} AS no_rec,
  {failing(2, "{v} <> '' AND NOT regexp_matches({v}, " + q(S.DATE_SHAPE).replace('{', '{{').replace('}', '}}') + ")")} AS bad_date,
  {failing(3, "{v} <> '' AND NOT regexp_matches({v}, " + q(S.MONEY_SHAPE).replace('{', '{{').replace('}', '}}') + ")")} AS bad_money,
  {failing(0, "{v} <> '' AND " + LOW)} AS low, f0 = '' AND f1 = '' AND f2 = '' AND f3 = '' AND f4 = '' AS empty FROM routed),
judged AS (SELECT *, empty OR (confidence < 0.25 AND no_req <> '') AS reject FROM checked),
validated AS (SELECT *, concat_ws('|', CASE WHEN no_req <> '' THEN 'missing_required_fields:' || no_req END, CASE WHEN bad_date <> '' THEN 'invalid_date_format:' || bad_date END, CASE WHEN bad_money <> '' THEN 'invalid_money_format:' || bad_money END,
  CASE WHEN low <> '' THEN 'low_field_confidence:' || low END, CASE WHEN confidence < 0.9 THEN 'low_confidence:' || printf('%.3f', confidence) END, CASE WHEN reject THEN 'reject_unusable_extraction' END) AS reasons, CASE WHEN no_rec <> '' THEN 'missing_recommended_fields:' || no_rec ELSE '' END AS warnings FROM judged),
verdicts AS (SELECT *, CASE WHEN reject THEN 'rejected' WHEN reasons <> '' THEN 'needs_review' ELSE 'auto_approved' END AS verdict FROM validated)"""
