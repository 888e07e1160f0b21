"""The query of conversation repair, with SQL that finds the cheapest audit by recursion."""

from pyspark.sql import functions as F

from threatflow.llm import repair
from threatflow.llm.shared import table


def _plus(held, cost, edit):
    """The SQL of a beginning (nine digits of cost, then edits) after one more edit; null stays null."""
    return f"printf('%09d', CAST(left({held}, 9) AS BIGINT) + {cost}) || substr({held}, 10) || '{edit}'"


def _step(goal):
    """The SQL of the best beginning at a place after a row, from those before it (0 to 3)."""
    tries = [_plus(f"p{goal}", 2, "D")]
    sources = {0: (), 1: (0,), 2: (0, 1, 3), 3: (2,)}[goal]
    initial = {1: "s", 2: "u", 3: "a"}.get(goal)
    for source in sources:
        tries.append(f"CASE WHEN free AND left(role, 1) = '{initial}' THEN {_plus(f'p{source}', 'cut', 'K')} END")
        if goal > 1:
            tries.append(f"CASE WHEN free THEN {_plus(f'p{source}', '1 + cut', 'R')} END")
    return f"least({', '.join(tries)})" if len(tries) > 1 else tries[0]


#: After a row, inserted rows may lead from each place to the next: users, assistants, and users again.
_INSERTED = f"""SELECT conv, i, q0, q1, q2, least(q3, {_plus('q2', 5, 'I')}) AS q3 FROM (
      SELECT conv, i, q0, q1, least(q2, {_plus('q0', 5, 'I')}, {_plus('q1', 5, 'I')}, {_plus('q3', 5, 'I')}) AS q2, q3 FROM"""

SQL = rf"""
WITH RECURSIVE steps AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256)) AS i))),
spoken AS (
  SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations),
coded AS (
  SELECT conv, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2),
      lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c // 256, list_extract(t, CAST(xor(c, b) % 256 + 1 AS BIGINT)))), 4294967295) % 20 AS code
  FROM spoken, steps),
hurt AS (
  SELECT conv, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE code WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded WHERE code <> 0),
line AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(role) OVER (PARTITION BY conv ORDER BY i) AS before FROM line),
counted AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM judged GROUP BY conv),
dp AS (
  {_INSERTED} (
    SELECT conv, CAST(0 AS BIGINT) AS i, '000000000' AS q0, CAST(NULL AS VARCHAR) AS q1, CAST(NULL AS VARCHAR) AS q2, CAST(NULL AS VARCHAR) AS q3 FROM counted))
  UNION ALL
  {_INSERTED} (
    SELECT conv, i, {', '.join(f'{_step(g)} AS q{g}' for g in range(4))} FROM (
      SELECT d.conv, j.i, j.role, j.fault NOT IN ('blank', 'duplicate') AS free, CASE j.fault WHEN 'truncated' THEN 5 ELSE 0 END AS cut,
        d.q0 AS p0, d.q1 AS p1, d.q2 AS p2, d.q3 AS p3
      FROM dp d JOIN judged j ON j.conv IS NOT DISTINCT FROM d.conv AND j.i = d.i + 1)))),
best AS (
  SELECT c.*, CAST(left(least(q0, q3), 9) AS BIGINT) AS cost, substr(least(q0, q3), 10) AS audit
  FROM counted c JOIN dp ON dp.conv IS NOT DISTINCT FROM c.conv AND dp.i = c.n),
edits AS (SELECT conv, audit, unnest(range(1, length(audit) + 1)) AS pos FROM best),
placed AS (
  SELECT conv, pos, audit[pos] AS edit, length(replace(left(audit, pos), 'I', '')) AS i,
    length(replace(left(audit, pos), 'D', '')) AS slot FROM edits),
shown AS (
  SELECT p.conv, p.slot, CASE p.edit WHEN 'K' THEN j.role END AS role, CASE p.edit WHEN 'I' THEN '' ELSE j.text END AS text,
    max(CASE WHEN p.slot = 1 AND p.edit = 'K' AND left(j.role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv) AS shift
  FROM placed p LEFT JOIN judged j ON j.conv IS NOT DISTINCT FROM p.conv AND j.i = p.i WHERE p.edit <> 'D'),
texts AS (
  SELECT conv, string_agg(coalesce(role, CASE (slot - shift) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY slot) AS whole
  FROM shown GROUP BY conv)
SELECT a.conv AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id AS conv FROM conversations) a
LEFT JOIN best b ON b.conv IS NOT DISTINCT FROM a.conv LEFT JOIN texts t ON t.conv IS NOT DISTINCT FROM a.conv
"""


def op11(spark, sf_dir):
    """Each conversation's faults after damage, the cheapest audit that repairs its structure, and what it becomes."""
    rows = repair.damaged(table(spark, sf_dir, "conversations"))
    done = repair.repair(rows, present=F.col("_here"))
    said = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t))
    return done.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.sha2(F.array_join(said, "\n"), 256).alias("repaired_sha256"),
    )
