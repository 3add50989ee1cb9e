"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_MEASURES = rf"""
    WITH base AS (
      SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)),
                         lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM documents),
    win AS (
      SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 8), ' ') AS x
      FROM (SELECT doc_id, w, unnest(range(0, len(w) - 7)) AS i FROM base WHERE len(w) >= 8)),
    twice AS (
      SELECT doc_id, i FROM (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
    covered AS (
      SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 8) AS r(k) GROUP BY doc_id),
    measured AS (
      SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
             len(lines) AS n_lines, length(t) AS n_chars_all,
             len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper,
             len(list_filter(range(1, len(w)), lambda i: w[i + 1] = w[i])) AS n_stutters
      FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id),
    ledger AS (
      SELECT *, CAST(
             (n_words < 20)::INT
             + 2 * (100 * n_repeat_words > 30 * n_words)::INT
             + 4 * (word_chars < 3 * n_words)::INT + 8 * (word_chars > 12 * n_words)::INT
             + 16 * (10 * n_symbols > n_words)::INT
             + 32 * (100 * n_dup_lines > 35 * n_lines)::INT
             + 64 * (100 * n_upper > 30 * n_chars_all)::INT
             + 128 * (100 * n_stutters > 20 * n_words)::INT AS BIGINT) AS failed_bits
      FROM measured)
"""

ORACLE: dict[str, str] = {
    "op9_quality": _MEASURES + """
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
    FROM ledger""",
}

_BITS = " + ".join(
    f"{1 << (4 - k)} * CAST(substr(bits, CAST(5 * i + {k + 1} AS INT), 1) AS INT)" for k in range(5))

ORACLE["op10_warc"] = f"""
    WITH base AS (
      SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
    hashed AS (
      SELECT page_id, coalesce(url, '') AS url, octet_length(payload) AS payload_bytes,
             CAST(CAST(unhex(sha1(payload)) AS BIT) AS VARCHAR) AS bits,
             min(page_id) OVER (PARTITION BY payload) AS first
      FROM base)
    SELECT page_id, payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda i: substr(
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_BITS}, 1)), '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to, url, true AS verified
    FROM hashed"""

_SHINGLES = r"""
      SELECT DISTINCT {id}, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS s FROM (
        SELECT {id}, w, unnest(range(0, len(w) - 4)) AS i FROM (
          SELECT {id}, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w
          FROM {table}) WHERE len(w) >= 5)"""

_LEAKS = f"""
    WITH q AS ({_SHINGLES.format(id='item_id', table='benchmark')}),
    d AS ({_SHINGLES.format(id='doc_id', table='{docs}')}),
    sizes AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id),
    leaks AS (
      SELECT d.doc_id, q.item_id, count(*) AS shared, any_value(n) AS item_shingles
      FROM d JOIN q ON d.s = q.s JOIN sizes ON sizes.item_id = q.item_id
      GROUP BY d.doc_id, q.item_id HAVING 100 * count(*) >= 80 * any_value(n))
"""

ORACLE["op2_decontaminate"] = _LEAKS.replace("{docs}", "documents") + """
    SELECT doc_id, item_id, shared, item_shingles FROM leaks"""

_LOWER = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz')")

ORACLE["op8_neardup"] = rf"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    sh AS (
      SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 3), ' ') AS s FROM (
        SELECT doc_id, w, unnest(range(0, greatest(len(w) - 2, 1))) AS i FROM w WHERE len(w) > 0)),
    size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    links AS (
      SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
      JOIN size x ON x.doc_id = a.doc_id JOIN size y ON y.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id
      HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
    reach AS (
      SELECT doc_id, doc_id AS other FROM documents
      UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
    component AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d JOIN component c ON c.doc_id = d.doc_id LEFT JOIN size s ON s.doc_id = d.doc_id"""

ORACLE["op12_phrases"] = rf"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang,
             unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    grams AS (
      SELECT lang, k, array_to_string(list_slice(w, i + 1, i + k), ' ') AS phrase FROM (
        SELECT lang, w, k, unnest(range(0, len(w) - k + 1)) AS i
        FROM worded, (VALUES (1), (2), (3)) AS orders(k) WHERE len(w) >= k)),
    counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase),
    words AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
    often AS (
      SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE f >= 10),
    cut_at AS (
      SELECT c.lang, c.phrase, c.f AS a, x.k AS cut,
             array_to_string(list_slice(c.w, 1, x.k), ' ') AS p1,
             array_to_string(list_slice(c.w, x.k + 1, c.k), ' ') AS p2
      FROM often c, (VALUES (1), (2)) AS x(k) WHERE x.k < c.k),
    cuts AS (
      SELECT c.lang, c.phrase, a, cut, l.f AS l, r.f AS r,
             (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
      FROM cut_at c JOIN often l ON l.lang = c.lang AND l.phrase = c.p1
      JOIN often r ON r.lang = c.lang AND r.phrase = c.p2),
    worst AS (
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS i FROM cuts)
      WHERE i = 1),
    inner_pairs AS (
      SELECT lang, array_to_string(list_slice(w, i, i + 1), ' ') AS phrase, f
      FROM often, (VALUES (1), (2)) AS s(i) WHERE k = 3),
    covered AS (SELECT lang, phrase, max(f) AS longer FROM inner_pairs GROUP BY lang, phrase),
    ranked AS (
      SELECT c.*, row_number() OVER (
               PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, c.phrase) AS rank
      FROM worst c LEFT JOIN covered v ON v.lang = c.lang AND v.phrase = c.phrase
      WHERE v.longer IS NULL OR 100 * v.longer < 50 * c.a)
    SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, CAST(n AS BIGINT) AS n, CAST(r.score AS BIGINT) AS score
    FROM ranked r JOIN words ON words.lang = r.lang WHERE r.rank <= 2000"""

_TERMS = rf"""regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLE["op13_search"] = f"""
    WITH docs AS (
      SELECT doc_id, row_number() OVER () AS d, {_TERMS} AS t FROM documents),
    sized AS (SELECT doc_id, d, len(t) AS n, t FROM docs WHERE len(t) > 0),
    whole AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS l FROM sized),
    asked AS (
      SELECT DISTINCT item_id, i, term FROM (
        SELECT item_id, i, unnest({_TERMS}) AS term
        FROM (SELECT *, row_number() OVER () AS i FROM benchmark))),
    held AS (
      SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(t) AS term FROM sized)
      WHERE term IN (SELECT term FROM asked) GROUP BY d, term),
    weights AS (
      SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM held, whole GROUP BY term),
    impacts AS (
      SELECT held.d, held.term,
             w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // l))) AS impact
      FROM held JOIN sized ON sized.d = held.d JOIN weights ON weights.term = held.term, whole),
    scores AS (
      SELECT item_id, i, d, CAST(sum(impact) AS BIGINT) AS score
      FROM asked JOIN impacts ON impacts.term = asked.term GROUP BY item_id, i, d)
    SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
      SELECT s.item_id, sized.doc_id, s.score,
             row_number() OVER (PARTITION BY i ORDER BY s.score DESC, sized.doc_id) AS rank
      FROM scores s JOIN sized ON sized.d = s.d WHERE s.score > 0)
    WHERE rank <= 10"""
