"""The same queries as ANSI SQL over the raw tables, for checking results."""

from __future__ import annotations

from tallyguard import policy as P

# Named steps; a query lists what it starts from and gets every step before it.
_STEPS: dict[str, str] = {}


def _step(name: str, sql: str) -> None:
    _STEPS[name] = sql


def _r(x: str, digits: int = 6) -> str:
    p = f"{10 ** digits}.0"
    return f"(floor(({x}) * {p} + 0.5) / {p})"


def _day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def _stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def _case(x: str, table: dict, default: str = "NULL") -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)

    return (f"CASE {x} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
            + f" ELSE {default} END")


def _vkey(x: str) -> str:
    words = ", ".join(f"'{w}'" for w in P.LEGAL_SUFFIXES)
    return (f"array_to_string(list_filter(string_split(trim(regexp_replace(lower({x}), "
            f"'[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ({words})), ' ')")


_RANK = {r: i for i, r in enumerate(P.LADDER)}
_ROUTE = dict(enumerate(P.LADDER))

_step("invoices", """
SELECT concat('INV-', lpad(cast(l_orderkey AS varchar), 8, '0'), '-',
              lpad(cast(l_suppkey AS varchar), 6, '0')) AS invoice_id,
       CASE l_orderkey % 10 WHEN 0 THEN name[1:11] || 'z' WHEN 5 THEN name[1:4] || name[6:12]
            ELSE name END AS vendor,
       sum(cast(round(l_extendedprice * 100) AS bigint))
         / (CASE WHEN l_orderkey % 50 = 0 THEN 100.0 ELSE 1000.0 END)::double AS amount,
       cast(o_orderdate AS date) AS posting_date,
       cast(o_orderdate AS date)
         + cast(15 * (1 + (l_orderkey + l_suppkey) % 4) AS integer) AS due_date,
       l_orderkey AS order_key, o_orderstatus AS order_status
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
JOIN (SELECT s_suppkey, translate(md5(s_suppkey::varchar)[1:12], '0123456789', 'ghijklmnop') AS name
      FROM supplier) ON s_suppkey = l_suppkey
GROUP BY l_orderkey, l_suppkey, name, o_orderdate, o_orderstatus""")

_step("truth", """
SELECT invoice_id, CASE WHEN isodow(posting_date) >= 6 OR amount BETWEEN 9500.0 AND 9999.99
                          OR amount >= 25000.0 THEN 1 ELSE 0 END AS label
FROM invoices WHERE order_key % 10 <> 0""")

_step("vstats", """
SELECT vendor, count(*) AS n, avg(amount) AS m, stddev_samp(amount) AS sd
FROM invoices GROUP BY vendor""")

_step("zscores", """
SELECT i.*, abs(amount - m) / (CASE WHEN sd > 0 THEN sd ELSE 1.0 END) AS z,
       due_date - posting_date AS dd
FROM invoices i JOIN vstats USING (vendor)""")

_step("feats", """
SELECT z.*, (z - z_lo) / (z_hi - z_lo) AS zn,
       1.0::double - least(abs(10000.0::double - amount), 10000.0) / 10000.0::double AS tp,
       CASE WHEN isodow(posting_date) >= 6 THEN 1.0 ELSE 0.0 END::double AS wf,
       (dd - d_lo)::double / (d_hi - d_lo) AS dn
FROM zscores z, (SELECT min(z) AS z_lo, max(z) AS z_hi, min(dd) AS d_lo, max(dd) AS d_hi
                 FROM zscores)""")

_step("scores", """
SELECT *, 1.0::double / (1.0 + exp(-(-1.5 + 4.0 * zn + 1.5 * tp + wf - dn))) AS m1,
       1.0::double / (1.0 + exp(-(-2.5 + 8.0 * zn + 2.5 * tp * tp + 0.5 * wf))) AS m2,
       greatest(0.0::double,
                least(1.0::double, 0.15 + 0.6 * zn + 0.55 * tp - 0.25 * dn + 0.1 * wf)) AS m3
FROM feats""")


def _band(x: str) -> str:
    return (f"CASE WHEN {x} < 0.25 THEN 'cleared' WHEN {x} < 0.5 THEN 'low' "
            f"WHEN {x} < 0.75 THEN 'elevated' ELSE 'high' END")


_step("assessed", f"""
SELECT *, {_band('mean')} AS band, spread >= 0.5 AS is_split,
       {_band('m1')} AS b1, {_band('m2')} AS b2, {_band('m3')} AS b3
FROM (SELECT *, (m1 + m2 + m3) / 3 AS mean,
             greatest(m1, m2, m3) - least(m1, m2, m3) AS spread FROM scores)""")


def _links(names: str) -> str:
    """Ordered pairs (a, b, v) of the vendor keys of a table that are alike."""
    keys = f"(SELECT DISTINCT {_vkey('vendor')} AS k FROM {names})"
    return f"""
SELECT a, b, v FROM (
  SELECT x.k AS a, y.k AS b,
         1.0::double - levenshtein(x.k, y.k) / greatest(length(x.k), length(y.k))::double AS v
  FROM {keys} x, {keys} y WHERE x.k <> '' AND y.k <> '') WHERE v >= 0.8"""


def _closest(rows: str, tau: str, filed: str | None = None) -> str:
    """Closest match of every row of a table within itself or on file, over linked names."""
    filed = filed or rows
    return f"""
SELECT id, arg_min(m, (-s, m)) AS m, max(s) AS s, arg_min(amt, (-s, m)) AS amt,
       arg_min(prox, (-s, m)) AS prox, arg_min(m_amount, (-s, m)) AS m_amount,
       arg_min(days, (-s, m)) AS days, arg_min(v, (-s, m)) AS v,
       arg_min(m_vendor, (-s, m)) AS m_vendor
FROM (SELECT *, v * (0.75::double * amt + 0.25::double * prox) AS s FROM (
  SELECT a.invoice_id AS id, b.invoice_id AS m, b.amount AS m_amount, b.vendor AS m_vendor, v,
         abs(a.posting_date - b.posting_date) AS days,
         greatest(0.0::double, 1.0 - (abs(a.amount - b.amount)
           / greatest(abs(a.amount), abs(b.amount), 1.0)) / 0.1::double) AS amt,
         greatest(0.0::double, 1.0 - abs(a.posting_date - b.posting_date) / 90.0::double) AS prox
  FROM (SELECT *, {_vkey('vendor')} AS k FROM {rows}) a
  JOIN ({_links('pairs' if 'pairs' in rows else 'invoices')}) l ON l.a = a.k
  JOIN (SELECT *, {_vkey('vendor')} AS k FROM {filed}) b
    ON b.k = l.b AND a.invoice_id <> b.invoice_id))
WHERE s {tau} GROUP BY id"""


_step("screened", _closest("invoices", ">= 0.8"))
_step("closest", _closest("invoices", "> 0"))
_step("pairs", """
SELECT *, NULL AS is_duplicate_of FROM invoices
UNION ALL
SELECT invoice_id || '-D', vendor || ' Ltd.', amount, posting_date + 3, due_date, order_key,
       order_status, invoice_id FROM invoices WHERE order_key % 97 = 0""")
_step("pair_hits", _closest("pairs", ">= 0.8"))

_step("dup", """
SELECT a.*, coalesce(floor(s * 10000.0 + 0.5) / 10000.0, 0.0) AS dscore, m AS match_id
FROM assessed a LEFT JOIN closest ON id = invoice_id""")


def _ranked(source: str) -> str:
    return f"""
SELECT *,
  CASE WHEN amount >= 50000 THEN 3 WHEN amount >= 10000 THEN 2 WHEN amount >= 2500 THEN 1 END AS r1,
  CASE WHEN amount >= 9500 AND amount < 10000 THEN 2 END AS r2,
  CASE WHEN dscore >= 0.95 AND amount >= 10000 THEN 3 WHEN dscore >= 0.95 THEN 2
       WHEN dscore >= 0.8 THEN 1 END AS r3,
  CASE band WHEN 'high' THEN 2 WHEN 'elevated' THEN 1 END AS r4,
  CASE WHEN zn >= 0.7 THEN 1 END AS r5,
  CASE WHEN wf >= 1 AND NOT coalesce(amount < 1000, false) THEN 1 END AS r6,
  CASE WHEN dn <= 0.05 THEN 1 END AS r7, NULL::integer AS r8,
  CASE WHEN is_split AND greatest(m1, m2, m3) >= 0.5 THEN 1 END AS r9
FROM {source}"""


_RS = [f"r{i}" for i in range(1, 10)]


def _routed(source: str) -> str:
    top = "greatest(" + ", ".join(f"coalesce({r}, 0)" for r in _RS) + ")"
    codes = ", ".join(f"CASE WHEN r{i} = {k} THEN 'R-0{i}' END"
                      for k in (3, 2, 1) for i in range(1, 10))
    n = " + ".join(f"({r} IS NOT NULL)::integer" for r in _RS)
    return f"""
SELECT *, {_case('rank', _ROUTE)} AS route,
       CASE WHEN hits = 0 THEN '-' ELSE concat_ws(', ', {codes}) END AS codes
FROM (SELECT *, {top} AS rank, {n} AS hits FROM ({_ranked(source)}))"""


_step("decided", _routed("dup"))

_step("queue", """
SELECT *, coalesce(decided_at, submitted_at) AS updated_at,
       CASE WHEN rank > 0 AND status = 'approved' THEN 'false_positive'
            WHEN rank > 0 AND status = 'rejected' THEN 'true_positive' END AS feedback
FROM (SELECT *, CASE WHEN status IN ('approved', 'rejected')
                     THEN submitted_at + to_days((1 + order_key % 5)::integer) END AS decided_at
FROM (SELECT *, CASE WHEN rank = 0 THEN 'auto_approved' WHEN order_status = 'F' THEN 'approved'
             WHEN order_status = 'O' THEN 'rejected' WHEN order_key % 5 = 0 THEN 'info_requested'
             WHEN rank = 3 AND order_key % 5 = 1 THEN 'awaiting_second_approval'
             ELSE 'pending_review' END AS status,
             cast(posting_date AS timestamp) AS submitted_at FROM decided))""")

_step("doc_fields", """
SELECT invoice_id || '.txt' AS source_file, invoice_id,
       CASE WHEN order_key % 37 <> 0 THEN vendor END AS vendor,
       CASE WHEN order_key % 41 <> 0 THEN round(amount * 100)::bigint / 100.0::double END AS amount,
       posting_date, due_date, order_key % 37 <> 0 AND order_key % 41 <> 0 AS extraction_ok
FROM invoices""")

_step("intake", """
SELECT *, CASE WHEN order_key % 53 = 0 THEN 'malformed'
               WHEN order_key % 61 = 0 THEN 'missing vendor'
               WHEN order_key % 59 = 0 THEN 'amount must be positive' END AS error
FROM invoices""")

_step("subs", f"""
SELECT *, CASE WHEN order_key % 43 <> 0 THEN invoice_id
               ELSE 'UNREAD::' || invoice_id || '.pdf' END AS qid,
       invoice_id || '.pdf' AS source_file, 'intake-' || (seq % 2) AS actor,
       cast(posting_date AS timestamp) + to_days(seq::integer) AS ts,
       {_case('rank', _ROUTE)} AS route
FROM (SELECT *, greatest(
        CASE WHEN amount >= 50000 THEN 3 WHEN amount >= 10000 THEN 2 WHEN amount >= 2500 THEN 1
             ELSE 0 END,
        CASE WHEN amount >= 9500 AND amount < 10000 THEN 2 ELSE 0 END,
        CASE WHEN isodow(posting_date) >= 6 AND amount >= 1000 THEN 1 ELSE 0 END) AS rank
      FROM (SELECT *, 1::bigint AS seq FROM invoices UNION ALL
            SELECT * REPLACE (amount + 100.0 AS amount), 2::bigint FROM invoices
            WHERE order_key % 7 = 0))""")
_step("subs_seen", """
SELECT *, first_value(route) OVER w AS first_route, first_value(ts) OVER w AS first_ts,
       first_value(actor) OVER w AS first_actor, row_number() OVER w AS nth,
       count(*) OVER (PARTITION BY qid) AS n,
       CASE WHEN first_value(rank) OVER w = 0 THEN 'auto_approved' ELSE 'pending_review' END AS status
FROM subs WINDOW w AS (PARTITION BY qid ORDER BY seq)""")

_step("ledger", """
SELECT user_id AS chain_id, event_id AS seq, concat_ws('|', event_id, event_type) AS payload,
       row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events""")
_step("chained", f"""
SELECT chain_id, seq, payload, pos,
  list_reduce(list_prepend('{P.GENESIS_HASH}', ps[1:pos]), lambda a, x: sha256(a || '|' || x))
    AS entry_hash,
  list_reduce(list_prepend('{P.GENESIS_HASH}', ps[1:pos - 1]), lambda a, x: sha256(a || '|' || x))
    AS prev_hash
FROM ledger JOIN (SELECT chain_id, list(payload ORDER BY seq) AS ps FROM ledger GROUP BY chain_id)
  USING (chain_id)""")

# The workflow one action at a time: state after action n of each invoice.
_step("acts", """
SELECT 'INV-' || user_id AS invoice_id, event_id AS seq, ts,
       CASE WHEN event_type = 'click' THEN 'approve'
            WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'reject'
            WHEN event_type = 'purchase' THEN 'approve' WHEN event_type = 'view' THEN 'request_info'
            WHEN event_type = 'signup' THEN 'escalate' ELSE 'shred' END AS action,
       CASE WHEN event_id % 11 = 0 THEN '' ELSE 'rev' || (event_id % 3) END AS actor,
       'note ' || event_id AS note, user_id,
       row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events""")
_step("walk", """
  SELECT 'INV-' || user_id AS invoice_id, 0::bigint AS n, 'pending_review' AS status,
         CASE user_id % 4 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS rank,
         NULL::varchar AS signer, NULL::varchar AS refusal, NULL::varchar AS was,
         NULL::integer AS was_rank, NULL::varchar AS was_signer
  FROM events GROUP BY user_id
  UNION ALL
  SELECT invoice_id, n,
         CASE WHEN refusal IS NOT NULL THEN status WHEN action = 'reject' THEN 'rejected'
              WHEN action = 'request_info' THEN 'info_requested'
              WHEN action = 'escalate' THEN 'pending_review'
              WHEN rank = 3 AND status <> 'awaiting_second_approval'
                THEN 'awaiting_second_approval' ELSE 'approved' END,
         CASE WHEN refusal IS NULL AND action = 'escalate' THEN least(rank + 1, 3) ELSE rank END,
         CASE WHEN refusal IS NOT NULL THEN signer WHEN action = 'escalate' THEN NULL
              WHEN action = 'approve' AND rank = 3 AND status <> 'awaiting_second_approval'
                THEN actor ELSE signer END,
         refusal, status, rank, signer
  FROM (SELECT w.invoice_id, a.n, w.status, w.rank, w.signer, a.action, a.actor,
               CASE WHEN a.action = 'shred' THEN 'unknown action'
                    WHEN a.actor = '' THEN 'reviewer name required'
                    WHEN w.status IN ('approved', 'rejected') THEN 'already decided'
                    WHEN a.action = 'approve' AND w.rank = 3
                     AND w.status = 'awaiting_second_approval' AND w.signer = a.actor
                      THEN 'same approver twice' END AS refusal
        FROM walk w JOIN acts a ON a.invoice_id = w.invoice_id AND a.n = w.n + 1)""")
_step("walked", f"""
SELECT w.invoice_id, a.seq, a.ts, a.action, a.actor, a.note, w.refusal, w.was AS from_status,
       w.status AS to_status, {_case('w.was_rank', _ROUTE)} AS route_before,
       {_case('w.rank', _ROUTE)} AS route_after, w.signer, w.n,
       CASE WHEN a.action = 'reject' THEN 'review.rejected'
            WHEN a.action = 'request_info' THEN 'review.info_requested'
            WHEN a.action = 'escalate' THEN 'review.escalated'
            WHEN w.status = 'approved' THEN 'review.approved'
            ELSE 'review.first_approval' END AS event_type,
       CASE WHEN w.was_rank = 3 AND w.status = 'approved' THEN w.was_signer END AS first_approver
FROM walk w JOIN acts a USING (invoice_id, n)""")


_step("items", """
SELECT invoice_id, seq, n, actor, seq % 7 = 3 AS submitted, action,
       CASE WHEN seq % 70 = 3 THEN 0 ELSE (seq % 3 + 1)::integer END AS new_rank FROM acts""")
_step("tread", """
  SELECT 'INV-' || user_id AS invoice_id, 0::bigint AS n, NULL::varchar AS status,
         NULL::integer AS rank, NULL::varchar AS signer, NULL::varchar AS refusal,
         NULL::varchar AS event_type, NULL::varchar AS was, NULL::integer AS was_rank,
         NULL::varchar AS was_signer
  FROM events GROUP BY user_id
  UNION ALL
  SELECT invoice_id, n,
         CASE event_type WHEN 'intake.scored'
                THEN CASE WHEN new_rank = 0 THEN 'auto_approved' ELSE 'pending_review' END
              WHEN 'review.rejected' THEN 'rejected' WHEN 'review.info_requested' THEN 'info_requested'
              WHEN 'review.escalated' THEN 'pending_review' WHEN 'review.approved' THEN 'approved'
              WHEN 'review.first_approval' THEN 'awaiting_second_approval' ELSE status END,
         CASE WHEN event_type IN ('intake.scored', 'intake.rescored') THEN new_rank
              WHEN event_type = 'review.escalated' THEN least(rank + 1, 3) ELSE rank END,
         CASE event_type WHEN 'review.escalated' THEN NULL WHEN 'review.first_approval' THEN actor
              ELSE signer END,
         refusal, event_type, status, rank, signer
  FROM (SELECT *, CASE WHEN refusal IS NOT NULL THEN NULL
          WHEN submitted THEN CASE WHEN status IS NULL THEN 'intake.scored'
            WHEN status IN ('approved', 'rejected', 'auto_approved')
              THEN 'intake.duplicate_submission' ELSE 'intake.rescored' END
          WHEN action = 'reject' THEN 'review.rejected'
          WHEN action = 'request_info' THEN 'review.info_requested'
          WHEN action = 'escalate' THEN 'review.escalated'
          WHEN rank = 3 AND status <> 'awaiting_second_approval' THEN 'review.first_approval'
          ELSE 'review.approved' END AS event_type
    FROM (SELECT t.invoice_id, a.n, t.status, t.rank, t.signer, a.action, a.actor, a.submitted,
                 a.new_rank,
                 CASE WHEN a.submitted THEN NULL WHEN a.action = 'shred' THEN 'unknown action'
                      WHEN a.actor = '' THEN 'reviewer name required'
                      WHEN t.status IS NULL THEN 'not in the review queue'
                      WHEN t.status IN ('approved', 'rejected', 'auto_approved')
                        THEN 'already decided'
                      WHEN a.action = 'approve' AND t.rank = 3
                       AND t.status = 'awaiting_second_approval' AND t.signer = a.actor
                        THEN 'same approver twice' END AS refusal
          FROM tread t JOIN items a ON a.invoice_id = t.invoice_id AND a.n = t.n + 1))""")


def _sql(body: str) -> str:
    """A full statement: every step the body needs, in order, before it."""
    import re

    need: set[str] = set()

    def visit(text: str) -> None:
        for name, sql in _STEPS.items():
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(sql)

    visit(body)
    steps = ",\n".join(f"{n} AS ({s})" for n, s in _STEPS.items() if n in need)
    word = "WITH RECURSIVE" if need & {"walk", "tread"} else "WITH"
    return f"{word} {steps}\n{body}" if need else body


ORACLE: dict[str, str] = {}


def _q(name: str, body: str) -> None:
    ORACLE[name] = _sql(body)


_q("extract_fields", f"""
SELECT source_file, invoice_id, vendor, amount, {_day('posting_date')} AS posting_date,
       {_day('due_date')} AS due_date, extraction_ok FROM doc_fields""")
_q("extraction_report", f"""
SELECT count(*) AS documents, count(vendor) + count(amount) + 3 * count(*) AS filled_fields,
       5 * count(*) AS total_fields, count(*) FILTER (NOT extraction_ok) AS incomplete,
       {_r('(count(vendor) + count(amount) + 3 * count(*))::double / (5 * count(*)) * 100.0')}
         AS fill_rate FROM doc_fields""")
_q("intake_validation", """
SELECT coalesce(error, 'accepted') AS outcome, count(*) AS n FROM intake GROUP BY 1""")
_q("intake_accepted", f"""
SELECT invoice_id, vendor, amount, {_day('posting_date')} AS posting_date,
       {_day('due_date')} AS due_date FROM intake WHERE error IS NULL""")

_q("feat_threshold_proximity", """
SELECT invoice_id, greatest(0.0, least(1.0, 1.0::double
         - least(abs(10000.0::double - amount), 10000.0) / 10000.0::double)) AS threshold_proximity
FROM invoices""")
_q("feat_weekend_flag", """
SELECT invoice_id, CASE WHEN isodow(posting_date) >= 6 THEN 1.0 ELSE 0.0 END::double AS weekend_flag
FROM invoices""")
_q("feat_days_to_due", f"""
SELECT invoice_id, dd AS days_to_due, {_r('dn')} AS days_to_due_norm FROM feats""")
_q("feat_amount_zscore", f"""
SELECT invoice_id, {_r('z')} AS amount_zscore, {_r('zn')} AS amount_zscore_norm FROM feats""")

_INC = f"""
hist AS (SELECT * FROM invoices WHERE posting_date < DATE '2001-01-01'),
inc AS (SELECT * FROM invoices WHERE posting_date >= DATE '2001-01-01'),
hv AS (SELECT vendor, count(*) AS n, avg(amount) AS m, stddev_samp(amount) AS sd
       FROM hist GROUP BY vendor),
hb AS (SELECT min(z) AS z_lo, max(z) AS z_hi, min(dd) AS d_lo, max(dd) AS d_hi, any_value(gm) AS gm,
              any_value(gsd) AS gsd
       FROM (SELECT abs(amount - m) / (CASE WHEN sd > 0 THEN sd ELSE 1.0 END) AS z,
                    due_date - posting_date AS dd, (SELECT avg(amount) FROM hist) AS gm,
                    (SELECT stddev_samp(amount) FROM hist) AS gsd
             FROM hist JOIN hv USING (vendor))),
raw AS (SELECT * REPLACE (greatest(z_hi, z) AS z_hi, greatest(d_hi, dd) AS d_hi)
  FROM (SELECT inc.*, hb.*, due_date - posting_date AS dd,
        abs(amount - CASE WHEN n >= 2 THEN m ELSE gm END)
          / CASE WHEN (CASE WHEN n >= 2 THEN sd ELSE gsd END) > 0
                 THEN (CASE WHEN n >= 2 THEN sd ELSE gsd END) ELSE 1.0 END AS z
        FROM inc LEFT JOIN hv USING (vendor) CROSS JOIN hb) inc),
best AS ({_closest('inc', '> 0', 'hist')})"""
ORACLE["features_incremental"] = f"""
WITH invoices AS ({_STEPS['invoices']}), {_INC}
SELECT invoice_id,
       {_r('CASE WHEN z_hi > z_lo THEN (z - z_lo) / (z_hi - z_lo) ELSE 0.0 END', 4)}
         AS amount_zscore_norm,
       {_r('greatest(0.0, least(1.0, 1.0::double - least(abs(10000.0::double - amount), 10000.0) '
           '/ 10000.0::double))', 4)} AS threshold_proximity,
       coalesce({_r('s', 4)}, 0.0) AS duplicate_score,
       CASE WHEN isodow(posting_date) >= 6 THEN 1.0 ELSE 0.0 END::double AS weekend_flag,
       {_r('CASE WHEN d_hi > d_lo THEN (dd - d_lo)::double / (d_hi - d_lo) ELSE 0.0 END', 4)}
         AS days_to_due_norm, m AS duplicate_match_id
FROM raw LEFT JOIN best ON id = invoice_id"""

_q("feature_profile", " UNION ALL ".join(
    f"SELECT '{n}' AS feature, {_r(f'min({c})')} AS min, {_r(f'max({c})')} AS max, "
    f"{_r(f'avg({c})')} AS mean FROM dup"
    for n, c in zip(P.FEATURES, ("zn", "tp", "dscore", "wf", "dn"))))
_q("label_join", "SELECT invoice_id, label FROM invoices LEFT JOIN truth USING (invoice_id)")
_q("class_balance", """
SELECT label, count(*) AS n FROM invoices LEFT JOIN truth USING (invoice_id) GROUP BY label""")

_q("vendor_normalize", f"""
SELECT {_vkey('vendor')} AS vendor_key, count(*) AS invoices, count(DISTINCT vendor) AS spellings
FROM pairs GROUP BY 1""")
_step("alike", _links("invoices"))
_q("vendor_links", f"SELECT a, b, {_r('v')} AS similarity FROM alike")
_q("vendor_links_incremental", f"""
SELECT a, b, {_r('v')} AS similarity FROM alike
WHERE a IN (SELECT {_vkey('vendor')} FROM invoices WHERE posting_date >= DATE '2001-01-01')
  AND (a = b OR b IN (SELECT {_vkey('vendor')} FROM invoices WHERE posting_date < DATE '2001-01-01'))""")
_q("vendor_levenshtein", f"""
SELECT a, b, levenshtein(a, b)::integer AS distance, {_r('v')} AS similarity FROM alike WHERE a < b""")
_q("pair_similarity", f"""
SELECT id AS invoice_id, m AS id_b, {_r('v')} AS vendor_similarity, {_r('amt')} AS amount_similarity,
       {_r('prox')} AS date_proximity, {_r('s')} AS score FROM closest""")

_MATCH = f"""{_r('coalesce(s, 0.0)')} AS score, m AS matched_invoice_id,
       {_r('coalesce(v, 0.0)')} AS vendor_similarity, m_vendor AS matched_vendor,
       {_r('coalesce(amt, 0.0)')} AS amount_similarity, {_r('coalesce(prox, 0.0)')} AS date_proximity,
       m_amount AS matched_amount, days AS days_apart, coalesce(s, 0.0) >= 0.8 AS is_near,
       coalesce(s, 0.0) >= 0.95 AS is_confirmed"""
_q("closest_match", f"SELECT invoice_id, {_MATCH} FROM invoices LEFT JOIN closest ON id = invoice_id")
_q("duplicate_screen", f"SELECT id AS invoice_id, {_MATCH} FROM screened")
_step("respelled", """
SELECT * REPLACE (CASE WHEN order_key % 3 = 0 THEN name[1:11] || 'z' ELSE name END AS vendor)
FROM (SELECT *, translate(md5(invoice_id[14:19])[1:12], '0123456789', 'ghijklmnop') AS name
      FROM invoices)""")
_step("spellings", """
SELECT a.vendor AS a, b.vendor AS b, 1.0::double - levenshtein(a.vendor, b.vendor)
         / greatest(length(a.vendor), length(b.vendor))::double AS v
FROM (SELECT DISTINCT vendor FROM respelled) a, (SELECT DISTINCT vendor FROM respelled) b""")
_q("duplicate_screen_fuzzy", f"""
SELECT id AS invoice_id, {_r('max(s)')} AS score, arg_min(m, (-s, m)) AS matched_invoice_id,
       {_r('arg_min(v, (-s, m))')} AS vendor_similarity, arg_min(m_vendor, (-s, m)) AS matched_vendor,
       arg_min(days, (-s, m)) AS days_apart
FROM (SELECT *, v * (0.75::double * amt + 0.25::double * prox) AS s FROM (
  SELECT x.invoice_id AS id, y.invoice_id AS m, y.vendor AS m_vendor, v,
         abs(x.posting_date - y.posting_date) AS days,
         greatest(0.0::double, 1.0 - (abs(x.amount - y.amount)
           / greatest(abs(x.amount), abs(y.amount), 1.0)) / 0.1::double) AS amt,
         greatest(0.0::double, 1.0 - abs(x.posting_date - y.posting_date) / 90.0::double) AS prox
  FROM respelled x JOIN spellings ON a = x.vendor AND v >= 0.8
  JOIN respelled y ON y.vendor = b AND y.invoice_id <> x.invoice_id))
WHERE s >= 0.8 GROUP BY id""")
_q("top_duplicates", f"""
SELECT invoice_id, match_id AS duplicate_match_id, dscore AS duplicate_score,
       row_number() OVER (ORDER BY dscore DESC, invoice_id) AS position
FROM dup WHERE dscore >= 0.8 ORDER BY position LIMIT 10""")
_q("duplicate_recall", f"""
SELECT count(*) AS labelled, count(*) FILTER (m = is_duplicate_of) AS found,
       count(*) FILTER (s >= 0.8) AS screened, count(*) FILTER (s >= 0.95) AS confirmed,
       {_r('count(*) FILTER (m = is_duplicate_of)::double / count(*)')} AS recall
FROM pairs LEFT JOIN pair_hits ON id = invoice_id WHERE is_duplicate_of IS NOT NULL""")
_q("duplicate_false_positives", f"""
SELECT id AS invoice_id, m AS matched_invoice_id, {_r('s')} AS score FROM pair_hits
WHERE id NOT IN (SELECT invoice_id FROM pairs WHERE is_duplicate_of IS NOT NULL
                 UNION SELECT is_duplicate_of FROM pairs WHERE is_duplicate_of IS NOT NULL)""")

_LABELS = {k: label for k, label, _ in P.BANDS}
_q("band_for", " UNION ALL ".join(
    f"SELECT invoice_id, 'm{i}' AS model, b{i} AS band, {_case(f'b{i}', _LABELS)} AS label, "
    f"b{i} IN ('elevated', 'high') AS at_least_elevated FROM assessed" for i in (1, 2, 3)))
_q("ensemble_assess", f"""
SELECT invoice_id, {_r('mean')} AS mean, {_r('spread')} AS spread, band,
       {_case('band', _LABELS)} AS label,
       {_case('band', {k: i for i, k in enumerate(_LABELS)})} AS rank, is_split,
       CASE WHEN is_split THEN 'split' WHEN b1 = b2 AND b2 = b3 THEN 'unanimous'
            ELSE 'aligned' END AS agreement FROM assessed""")

_NAMES = {
    1: "'Delegated authority limit'", 2: "'Threshold structuring'",
    3: "CASE WHEN dscore >= 0.95 THEN 'Duplicate payment risk' ELSE 'Possible duplicate payment' END",
    4: "CASE band WHEN 'high' THEN 'High model confidence' ELSE 'Elevated model confidence' END",
    5: "'Off-pattern amount'", 7: "'Compressed payment terms'", 9: "'Split model decision'",
}
for _i, _name in _NAMES.items():
    _q(f"rule_r0{_i}", f"""
SELECT invoice_id, {_name} AS rule, {_case(f'r{_i}', _ROUTE)} AS route
FROM decided WHERE r{_i} IS NOT NULL""")
_q("rule_r06", """
SELECT invoice_id, 'Off-cycle posting' AS rule, 'manager_review' AS route FROM invoices
WHERE isodow(posting_date) >= 6 AND (order_key % 41 = 0 OR amount >= 1000)""")
_q("rule_r08", """
SELECT invoice_id, 'Incomplete extraction' AS rule, 'manager_review' AS route
FROM doc_fields WHERE NOT extraction_ok""")

_META = {i: {r: m[i] for r, m in P.ROUTES.items()} for i in range(4)}
_q("route_decisions", f"""
SELECT invoice_id, route, {_case('route', _META[0])} AS route_label,
       {_case('route', _META[1])} AS approver, {_case('route', _META[2])} AS tier,
       {_case('route', _META[3])} AS sla_hours, rank = 0 AS is_auto, codes AS rules_fired,
       CASE WHEN hits = 0 THEN 'No approval rules triggered, cleared for automatic payment.'
            ELSE hits || ' rule(s) triggered; highest authority required: '
                 || {_case('route', _META[0])} || '.' END AS summary,
       match_id AS duplicate_match_id, '{P.POLICY_VERSION}' AS policy_version FROM decided""")
_step("unscored", f"""
SELECT invoice_id, {_case('greatest(coalesce(r1, 0), coalesce(r2, 0), 1)', _ROUTE)} AS route,
       concat_ws(', ', CASE WHEN r1 = 3 THEN 'R-01' END, CASE WHEN r1 = 2 THEN 'R-01' END,
                 CASE WHEN r2 = 2 THEN 'R-02' END, CASE WHEN r1 = 1 THEN 'R-01' END, 'R-08')
         AS rules_fired
FROM (SELECT *, CASE WHEN amount >= 50000 THEN 3 WHEN amount >= 10000 THEN 2
                     WHEN amount >= 2500 THEN 1 END AS r1,
             CASE WHEN amount >= 9500 AND amount < 10000 THEN 2 END AS r2
      FROM doc_fields WHERE NOT extraction_ok)""")
_q("unscored_routing", "SELECT invoice_id, route, rules_fired FROM unscored")
_q("score_and_route_fixed", f"""
SELECT invoice_id, {_r('mean')} AS mean, band, route, codes AS rules_fired FROM decided
WHERE order_key % 37 <> 0 AND order_key % 41 <> 0
UNION ALL
SELECT invoice_id, NULL, NULL, {_case('greatest(coalesce(r1, 0), coalesce(r2, 0), 1)', _ROUTE)},
       concat_ws(', ', CASE WHEN r1 = 3 THEN 'R-01' END, CASE WHEN r1 = 2 THEN 'R-01' END,
                 CASE WHEN r2 = 2 THEN 'R-02' END, CASE WHEN r1 = 1 THEN 'R-01' END, 'R-08')
FROM (SELECT *, CASE WHEN amount >= 50000 THEN 3 WHEN amount >= 10000 THEN 2
                     WHEN amount >= 2500 THEN 1 END AS r1,
             CASE WHEN amount >= 9500 AND amount < 10000 THEN 2 END AS r2
      FROM doc_fields WHERE NOT extraction_ok)""")
_OPEN = ", ".join(f"'{s}'" for s in P.OPEN_STATUSES)
_q("escalate", f"""
SELECT invoice_id, route, {_case('least(rank + 1, 3)', _ROUTE)} AS escalated
FROM queue WHERE status IN ({_OPEN})""")
_PEOPLE = {r: ";".join(v) for r, v in P.RECIPIENTS.items()}
_PRIO = {r: P.PRIORITY[m[2]] for r, m in P.ROUTES.items()}
_USD = "'$' || format('{:,.2f}', amount)"
_q("notifications", f"""
SELECT invoice_id, route, rank > 0 AS is_actionable,
       CASE WHEN rank = 0 THEN 'None' ELSE {_case('route', _PRIO)} END AS priority,
       {_case('route', _PEOPLE, "''")} AS recipients,
       CASE WHEN rank = 0 THEN 'No notification: ' || invoice_id || ' cleared automatically'
            ELSE '[' || {_case('route', _PRIO)} || '] ' || invoice_id || ' needs '
                 || lower({_case('route', _META[0])}) || ', ' || {_USD} END AS subject,
       invoice_id || ' from ' || vendor || ' for ' || {_USD} || CASE WHEN rank = 0
         THEN ' triggered no approval rules and was auto-approved. No approver is notified.'
         ELSE ' was routed to ' || lower({_case('route', _META[0])})
              || ' under policy v{P.POLICY_VERSION}.' END AS summary_line,
       CASE WHEN rank = 0 THEN '' ELSE replace(codes, ', ', ',') END AS reasons,
       CASE WHEN rank = 0 THEN 'No action required.'
            ELSE 'Respond by ' || strftime(submitted_at
                   + to_hours({_case('route', _META[3])}), '%Y-%m-%d %H:%M') || ' UTC ('
                 || {_case('route', _META[3])} || 'h SLA).'
                 || CASE WHEN rank = 3 THEN ' Requires sign-off from two different approvers. '
                      || 'A single approval will not release this invoice.' ELSE '' END
       END AS sla_line FROM queue""")
_q("batch_report", f"""
SELECT rank AS route_rank, {_r('mean')} AS confidence, invoice_id, route, band, is_split AS split,
       dscore AS duplicate_score, codes AS rules_fired FROM decided
WHERE order_key % 37 <> 0 AND order_key % 41 <> 0
UNION ALL
SELECT {_case('route', _RANK)}, 0.0, invoice_id, route, NULL, false, NULL, rules_fired FROM unscored""")

_q("queue_upsert", f"""
SELECT qid AS invoice_id, source_file, vendor, amount, route, status,
       {_stamp('first_ts')} AS submitted_at, first_actor AS submitted_by,
       {_stamp('ts')} AS updated_at, n - 1 AS resubmissions,
       status = 'auto_approved' AS resubmissions_refused
FROM subs_seen WHERE nth = CASE WHEN status = 'auto_approved' THEN 1 ELSE n END""")
_q("intake_events", """
SELECT qid AS invoice_id, seq, pos, e[1] AS event_type, e[2] AS actor, e[3] AS from_status,
       e[4] AS to_status
FROM (SELECT qid, seq, unnest(es) AS e, generate_subscripts(es, 1) - 1 AS pos
  FROM (SELECT *, CASE
    WHEN nth = 1 AND rank = 0 THEN [['intake.scored', actor, NULL, status],
      ['routing.assigned', 'policy-engine', NULL, status],
      ['approval.automatic', 'policy-engine', NULL, status]]
    WHEN nth = 1 THEN [['intake.scored', actor, NULL, status],
      ['routing.assigned', 'policy-engine', NULL, status],
      ['notification.generated', 'policy-engine', NULL, status]]
    WHEN status = 'auto_approved' THEN [['intake.duplicate_submission', actor, status, status]]
    ELSE [['intake.rescored', actor, status, status],
      ['routing.assigned', 'policy-engine', NULL, status]] END AS es FROM subs_seen))""")
_q("queue_view", f"""
SELECT rank AS route_rank, {_stamp('submitted_at')} AS submitted_at, invoice_id, route, status,
       vendor, amount, codes AS rules_fired FROM queue WHERE status IN ({_OPEN})""")
_q("queue_facets", f"""
SELECT 'status' AS facet, status AS value, {_case('status', P.STATUS_LABELS)} AS label,
       {_case('status', {s: i for i, s in enumerate(P.STATUS_LABELS)})} AS position, count(*) AS n
FROM queue GROUP BY status
UNION ALL
SELECT 'route', route, {_case('route', _META[0])}, {_case('route', _RANK)}, count(*)
FROM queue GROUP BY route""")
_q("queue_stats", f"""
SELECT count(*) AS total, count(*) FILTER (status IN ({_OPEN})) AS open,
       {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in P.STATUS_LABELS)},
       count(*) FILTER (status IN ('approved', 'auto_approved')) AS cleared,
       (SELECT count(*) FROM events) AS events FROM queue""")

_q("review_events", """
SELECT invoice_id, seq, event_type, actor, from_status, to_status, route_before, route_after,
       first_approver FROM walked WHERE refusal IS NULL""")
_q("review_rejects", """
SELECT invoice_id, seq AS action_seq, action, actor, refusal FROM walked
WHERE refusal IS NOT NULL""")
_q("review_replay", f"""
SELECT invoice_id, arg_max(to_status, n) AS status, arg_max(route_after, n) AS route,
       nullif(arg_max(coalesce(signer, ''), n), '') AS first_approver,
       max(actor) FILTER (refusal IS NULL AND event_type IN ('review.approved', 'review.rejected'))
         AS decided_by,
       arg_max(note, n) FILTER (refusal IS NULL AND event_type <> 'review.first_approval')
         AS decision_note,
       max({_stamp('ts')}) FILTER (refusal IS NULL
         AND event_type IN ('review.approved', 'review.rejected')) AS decided_at,
       max({_stamp('ts')}) FILTER (refusal IS NULL) AS updated_at,
       count(*) FILTER (refusal IS NULL) AS applied
FROM walked GROUP BY invoice_id""")

_q("workflow_replay", f"""
SELECT t.invoice_id, seq, event_type, actor, refusal,
       CASE WHEN refusal IS NULL THEN was END AS from_status,
       CASE WHEN refusal IS NULL THEN status END AS to_status,
       CASE WHEN refusal IS NULL THEN {_case('was_rank', _ROUTE)} END AS route_before,
       CASE WHEN refusal IS NULL THEN {_case('rank', _ROUTE)} END AS route_after,
       CASE WHEN event_type = 'review.approved' AND was_rank = 3 THEN was_signer END AS first_approver
FROM tread t JOIN items a ON a.invoice_id = t.invoice_id AND a.n = t.n""")
ORACLE["stream_queue_upsert"] = ORACLE["queue_upsert"]
ORACLE["stream_workflow"] = ORACLE["stream_workflow_closing"] = ORACLE["workflow_replay"]
_q("chain_build", "SELECT chain_id, seq, prev_hash, entry_hash FROM chained")
_q("chain_verify", """
SELECT chain_id, events, bad IS NULL AS ok, bad AS first_bad_seq, reason,
       CASE WHEN bad IS NULL THEN 'Verified ' || events || ' event(s); hash chain intact.'
            WHEN reason = 'chain break'
              THEN 'Chain break at event #' || bad || ': predecessor hash does not match.'
            ELSE 'Tampered content at event #' || bad || ': recomputed hash does not match.'
       END AS message
FROM (SELECT user_id AS chain_id, count(*) AS events,
             min(event_id) FILTER (what IS NOT NULL) AS bad,
             arg_min(what, event_id) FILTER (what IS NOT NULL) AS reason
      FROM (SELECT user_id, event_id, CASE
              WHEN lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) % 1700 = 1699
                THEN 'chain break' WHEN event_id % 1000 = 7 THEN 'tampered content' END AS what
            FROM events)
      WHERE event_id % 1700 <> 1699 GROUP BY user_id)""")
_q("chain_verify_resumed", """
SELECT chain_id, checked + new AS events, bad IS NULL AS ok, bad AS first_bad_seq, reason,
       CASE WHEN bad IS NULL THEN 'Verified ' || (checked + new) || ' event(s); hash chain intact.'
            WHEN reason = 'chain break'
              THEN 'Chain break at event #' || bad || ': predecessor hash does not match.'
            WHEN reason = 'shortened log'
              THEN 'Shortened log at event #' || bad || ': the last verified event is missing.'
            ELSE 'Tampered content at event #' || bad || ': recomputed hash does not match.'
       END AS message
FROM (SELECT user_id AS chain_id, count(*) FILTER (event_id <= half) AS checked,
             count(*) FILTER (event_id > half AND NOT gone) AS new,
             CASE WHEN bool_or(event_id = last AND gone) THEN any_value(last)
                  ELSE min(event_id) FILTER (what IS NOT NULL) END AS bad,
             CASE WHEN bool_or(event_id = last AND gone) THEN 'shortened log'
                  ELSE arg_min(what, event_id) FILTER (what IS NOT NULL) END AS reason
      FROM (SELECT *, CASE WHEN event_id <= half OR gone THEN NULL
                           WHEN before > half AND before % 1700 = 1699 THEN 'chain break'
                           WHEN event_id % 1000 = 7 THEN 'tampered content' END AS what
            FROM (SELECT e.*, half, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before,
                         max(event_id) FILTER (event_id <= half) OVER (PARTITION BY user_id) AS last,
                         (event_id > half AND event_id % 1700 = 1699)
                           OR (user_id % 7 = 0 AND event_id > half / 2.0) AS gone
                  FROM events e, (SELECT max(event_id) // 2 AS half FROM events)))
      GROUP BY user_id) WHERE checked + new > 0""")
_q("event_facets_daily", """
SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS invoices,
       count(DISTINCT ts::date) AS days, true AS within_error FROM events GROUP BY event_type""")
_ST = "[" + ", ".join(f"'{v}'" for v in P.STATUS_LABELS.values()) + "]"
_q("event_timeline", f"""
SELECT position, seq, 'INV-' || chain_id AS invoice_id, event_type, 'rev' || (seq % 3) AS actor,
       CASE WHEN f IS NOT NULL AND f <> t THEN f || ' -> ' || t ELSE t END AS transition,
       CASE seq % 3 WHEN 0 THEN 'n' || seq WHEN 1 THEN 'r' || seq ELSE 'N/A' END AS note,
       entry_hash[1:10] AS short_hash
FROM (SELECT chain_id, seq, entry_hash, event_type,
             CASE WHEN seq % 4 <> 0 THEN ({_ST})[seq % 6 + 1] END AS f, ({_ST})[seq % 5 + 1] AS t,
             row_number() OVER (ORDER BY seq DESC) AS position
      FROM chained JOIN events ON event_id = seq)
WHERE position <= {P.EVENT_VIEW_ROWS}""")
_q("event_facets", """
SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS invoices
FROM events GROUP BY event_type""")

# What could not be read in full is always routed, and counts in no score.
_BATCH = """
SELECT strftime(posting_date, '%Y%m')::bigint AS run_id, count(*) AS total,
       count(*) FILTER (rank = 0 AND is_read) AS auto_approved,
       count(*) FILTER (rank > 0 OR NOT is_read) AS routed,
       count(*) FILTER (NOT is_read) AS failed, count(*) FILTER (band = 'high' AND is_read) AS high_band,
       count(*) FILTER (is_split AND is_read) AS split,
       count(*) FILTER (dscore >= 0.8 AND is_read) AS duplicates,
       min(date_trunc('month', posting_date)) AS started_at
FROM (SELECT *, order_key % 37 <> 0 AND order_key % 41 <> 0 AS is_read FROM decided) GROUP BY 1"""
_step("runs", _BATCH)
_step("log", f"""
SELECT t.invoice_id, a.seq, e.ts::timestamp AS ts, t.event_type, a.actor,
       t.was AS from_status, t.status AS to_status,
       to_json({{first_approver: CASE WHEN t.event_type = 'review.approved' AND was_rank = 3
                                     THEN was_signer END,
                route_after: {_case('rank', _ROUTE)}, route_before: {_case('was_rank', _ROUTE)}}})
         ::varchar AS detail
FROM tread t JOIN items a ON a.invoice_id = t.invoice_id AND a.n = t.n JOIN events e ON event_id = seq
WHERE refusal IS NULL
UNION ALL
SELECT NULL, run_id, started_at::timestamp, 'batch.completed', 'batch-intake', NULL, NULL,
       to_json({{auto_approved_count: auto_approved, duplicate_count: duplicates,
                failed_count: failed, high_band_count: high_band, invoice_count: total,
                run_id: run_id, source: 'batch_intake', split_count: split}})::varchar
FROM runs""")
_step("logged", """
SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY seq) AS pos,
       to_json({actor: actor, detail: detail, event_type: event_type, from_status: from_status,
                invoice_id: invoice_id, to_status: to_status,
                ts: strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00')})::varchar AS payload FROM log""")
_q("ledger_chain", f"""
SELECT l.invoice_id, seq, event_type, payload,
  list_reduce(list_prepend('{P.GENESIS_HASH}', ps[1:pos - 1]), lambda a, x: sha256(a || '|' || x))
    AS prev_hash,
  list_reduce(list_prepend('{P.GENESIS_HASH}', ps[1:pos]), lambda a, x: sha256(a || '|' || x))
    AS entry_hash
FROM logged l JOIN (SELECT invoice_id, list(payload ORDER BY seq) AS ps FROM logged
                    GROUP BY invoice_id) p ON l.invoice_id IS NOT DISTINCT FROM p.invoice_id""")
_q("ledger_verify", """
SELECT invoice_id, events, bad IS NULL AS ok, bad AS first_bad_seq, reason,
       CASE WHEN bad IS NULL THEN 'Verified ' || events || ' event(s); hash chain intact.'
            WHEN reason = 'chain break'
              THEN 'Chain break at event #' || bad || ': predecessor hash does not match.'
            ELSE 'Tampered content at event #' || bad || ': recomputed hash does not match.'
       END AS message
FROM (SELECT invoice_id, count(*) AS events, min(seq) FILTER (what IS NOT NULL) AS bad,
             arg_min(what, seq) FILTER (what IS NOT NULL) AS reason
      FROM (SELECT invoice_id, seq, CASE
              WHEN lag(seq) OVER (PARTITION BY invoice_id ORDER BY seq) % 900 = 21
                THEN 'chain break' WHEN seq % 500 = 8 THEN 'tampered content' END AS what
            FROM log)
      WHERE seq % 900 <> 21 GROUP BY invoice_id)""")
_q("batch_summary", f"""
SELECT run_id, total, auto_approved, routed, failed, high_band, split, duplicates,
       {_r('auto_approved::double / total')} AS touchless_rate,
       {_r('routed::double / total')} AS touch_rate FROM ({_BATCH})""")
_q("run_history", f"""
SELECT run_id, {_stamp('started_at::timestamp')} AS started_at,
       'Run ' || row_number() OVER w AS run_label, 'batch_intake' AS source,
       total AS invoice_count, auto_approved AS auto_approved_count, routed AS flagged_count,
       {_r('auto_approved::double / total')} AS touchless_rate,
       {_r('sum(auto_approved) OVER w::double / sum(total) OVER w')} AS cumulative_touchless_rate
FROM ({_BATCH})
WINDOW w AS (ORDER BY started_at, run_id)
ORDER BY started_at DESC, run_id DESC LIMIT {P.RUN_HISTORY_LIMIT}""".replace(
    "sum(auto_approved) OVER w::double", "(sum(auto_approved) OVER w)::double"))
_q("touchless_rate", f"""
SELECT {_r('avg(CASE WHEN rank = 0 THEN 1.0 ELSE 0.0 END)')} AS touchless_rate FROM queue""")
_FP = """count(*) FILTER (rank > 0) AS flagged,
  count(*) FILTER (rank > 0 AND status IN ('approved', 'rejected')) AS decided,
  count(*) FILTER (rank > 0 AND status = 'approved') AS false_positives"""
_q("fp_summary", f"""
SELECT flagged, decided, false_positives,
       {_r('false_positives::double / nullif(decided, 0)')} AS false_positive_rate,
       {_r('decided::double / nullif(flagged, 0)')} AS coverage, decided < 5 AS low_sample
FROM (SELECT {_FP} FROM queue)""")
_q("fp_trend", f"""
SELECT {_day('date')} AS date, decided, false_positives,
       {_r('false_positives::double / decided')} AS false_positive_rate
FROM (SELECT decided_at::date AS date, {_FP} FROM queue
      WHERE rank > 0 AND status IN ('approved', 'rejected') GROUP BY 1)""")
_VENDOR = """
SELECT vendor, count(*) AS total, count(*) FILTER (rank > 0) AS flagged,
       count(*) FILTER (rank > 0 AND status = 'approved') AS approved_flagged,
       count(*) FILTER (rank > 0 AND rn <= 5) AS recent_flagged, max(updated_at) AS updated_at
FROM (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY submitted_at DESC,
             invoice_id DESC) AS rn FROM queue) GROUP BY vendor"""
_q("vendor_risk_summary", f"""
SELECT vendor, total, flagged, round_even(flagged::double / total * 100, 0) / 100 AS flagged_rate,
       approved_flagged, recent_flagged FROM ({_VENDOR})""")
_q("vendor_profiles", f"""
SELECT vendor, total AS total_invoices, flagged AS flagged_invoices, approved_flagged,
       recent_flagged AS recent_flagged_5, {_stamp('updated_at')} AS updated_at,
       row_number() OVER (ORDER BY flagged DESC, updated_at DESC, vendor) AS position
FROM ({_VENDOR}) ORDER BY position LIMIT {P.VENDOR_PROFILE_LIMIT}""")

_q("feedback_dataset", f"""
SELECT {_stamp('decided_at')} AS feedback_at, invoice_id, vendor, route,
       feedback AS reviewer_feedback, CASE feedback WHEN 'true_positive' THEN 1 ELSE 0 END AS true_label
FROM queue WHERE feedback IS NOT NULL""")
_q("feedback_summary", f"""
SELECT total, false_positives, true_positives, total >= 10 AS ready, 10 AS threshold,
       least(1.0, total / 10.0::double) AS progress, 10 - total AS remaining
FROM (SELECT count(feedback) AS total, count(*) FILTER (feedback = 'false_positive')
             AS false_positives, count(*) FILTER (feedback = 'true_positive') AS true_positives
      FROM queue)""")
_q("training_rows", f"""
SELECT invoice_id, {_r('zn')} AS amount_zscore_norm, {_r('tp')} AS threshold_proximity,
       {_r('dscore')} AS duplicate_score, wf AS weekend_flag, {_r('dn')} AS days_to_due_norm,
       CASE feedback WHEN 'true_positive' THEN 1 ELSE 0 END AS label
FROM queue WHERE feedback IS NOT NULL AND order_key % 71 <> 0
  AND (SELECT count(feedback) FROM queue) >= {P.RETRAIN_THRESHOLD}""")
_q("classification_metrics", f"""
SELECT model, tp, fp, fn, tn, {_r('(tp + tn)::double / (tp + fp + fn + tn)', 3)} AS accuracy,
       {_r('coalesce(tp::double / nullif(tp + fp, 0), 0.0)', 3)} AS precision,
       {_r('coalesce(tp::double / nullif(tp + fn, 0), 0.0)', 3)} AS recall,
       {_r('coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0)::double', 3)} AS f1
FROM (SELECT model, count(*) FILTER (label = 1 AND p >= 0.5) AS tp,
             count(*) FILTER (label = 0 AND p >= 0.5) AS fp,
             count(*) FILTER (label = 1 AND p < 0.5) AS fn,
             count(*) FILTER (label = 0 AND p < 0.5) AS tn
      FROM (SELECT 'm1' AS model, label, m1 AS p FROM scores JOIN truth USING (invoice_id)
            UNION ALL SELECT 'm2', label, m2 FROM scores JOIN truth USING (invoice_id)
            UNION ALL SELECT 'm3', label, m3 FROM scores JOIN truth USING (invoice_id))
      GROUP BY model)""")
_q("stratified_split", """
SELECT label, count(*) AS n, cast(round(count(*) * 0.7::double) AS bigint) AS n_train
FROM truth GROUP BY label""")

# Streams must end where the batch queries do.
_LIVE = f"""
SELECT f.*, amount, amount_zscore_norm AS zn, threshold_proximity AS tp, weekend_flag AS wf,
       days_to_due_norm AS dn, duplicate_score AS dscore
FROM ({ORACLE['features_incremental']}) f
JOIN ({_STEPS['invoices']}) i ON i.invoice_id = f.invoice_id"""
ORACLE["stream_score_route"] = f"""
WITH feats AS ({_LIVE}), scores AS ({_STEPS['scores']}), assessed AS ({_STEPS['assessed']}),
decided AS ({_routed('assessed')})
SELECT invoice_id, amount_zscore_norm, threshold_proximity, duplicate_score, weekend_flag,
       days_to_due_norm, duplicate_match_id, route, {_r('mean')} AS mean, band,
       codes AS rules_fired FROM decided"""
ORACLE["stream_queue_state"] = ORACLE["review_events"]
ORACLE["stream_chain"] = ORACLE["chain_build"]
_q("stream_once_only", """
SELECT user_id, count(*) AS events, count(DISTINCT event_id) AS distinct_events
FROM events GROUP BY user_id""")
_q("stream_vendor_counters", f"""
SELECT vendor, total AS total_invoices, flagged AS flagged_invoices, approved_flagged,
       recent_flagged AS recent_flagged_5
FROM ({_VENDOR})""")
# A day is closed once an event two days after its end has been seen.
_q("stream_fp_trend", f"""
SELECT {_day('date')} AS date, decided, false_positives,
       {_r('false_positives::double / decided')} AS false_positive_rate
FROM (SELECT decided_at::date AS date, {_FP} FROM queue
      WHERE rank > 0 AND status IN ('approved', 'rejected') GROUP BY 1)
WHERE date + 1 <= (SELECT max(decided_at)::date - 2 FROM queue
                   WHERE rank > 0 AND status IN ('approved', 'rejected'))""")
