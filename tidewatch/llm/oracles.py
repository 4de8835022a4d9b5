"""SQL of the queries of this folder that SQL can express, runnable on the same tables."""

_CRC32 = """xor(4294967295, list_reduce(
    list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, byte: list_reduce(range(8), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), xor(crc, byte)),
    CAST(4294967295 AS BIGINT)))"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _framed(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(*values: str) -> str:
    return f"sha256({' || '.join(map(_framed, values))})"


def _levels(first: str, prefix: str, key: str, levels: int) -> str:
    """Levels of an eight-fold hash tree over (key, pos, hash): ``prefix0`` the nodes with their
    siblings, and so on; nodes that are alone in their key go up as they are."""
    steps, source = [], first
    for k in range(levels):
        run = f"PARTITION BY {key}, pos // 8 ORDER BY pos"
        steps.append(f"""
{prefix}{k} AS (
  SELECT {key}, pos, hash, count(*) OVER (PARTITION BY {key}) > 1 AS joined,
    coalesce(string_agg(hash, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(hash, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {source}
),
{prefix}{k}_up AS (
  SELECT {key}, pos // 8 AS pos, CASE WHEN bool_or(joined) THEN sha256(string_agg(hash, '' ORDER BY pos)) ELSE max(hash) END AS hash
  FROM {prefix}{k} GROUP BY {key}, pos // 8
)""")
        source = f"{prefix}{k}_up"
    return ",".join(steps)


def _merkle(levels: int, upper: int) -> str:
    """The manifest with so many levels below and above the subroots; lower trees use fewer."""
    sql = f"""
WITH leaves AS (
  SELECT doc_id, coalesce(lang, '') || CASE WHEN lang IS NULL THEN 'n' ELSE 'v' END AS grp, lang,
    {_leaf('doc_id', 'source', 'lang', 'n_chars', 'text')} AS hash,
    CASE WHEN {_CRC32.format('doc_id')} % 3 = 0
      THEN {_leaf('doc_id', 'source', 'lang', 'n_chars', _LOWER.format('text'))} END AS changed
  FROM documents
),
nodes AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, hash) - 1 AS pos FROM leaves
),{_levels('nodes', 'low', 'grp', levels)},
langs AS (
  SELECT 0 AS every, u.grp, u.hash, row_number() OVER (ORDER BY encode(n.lang) NULLS FIRST) - 1 AS pos
  FROM low{levels - 1}_up u JOIN (SELECT DISTINCT grp, lang FROM nodes) n USING (grp)
),{_levels('langs', 'top', 'every', upper)},
f0 AS (
  SELECT n.doc_id, n.hash AS leaf, n.grp, n.pos, s.hash AS subroot, s.pos AS lang_pos, coalesce(n.changed, n.hash) AS acc, '' AS proof
  FROM nodes n JOIN langs s USING (grp)
)"""
    places = [(f"low{k}", f"t.grp = f.grp AND t.pos = f.pos // {8 ** k}") for k in range(levels)]
    places += [(f"top{k}", f"t.pos = f.lang_pos // {8 ** k}") for k in range(upper)]
    for k, (name, on) in enumerate(places):
        sql += f""",
f{k + 1} AS (
  SELECT f.* REPLACE (CASE WHEN t.joined THEN sha256(t.l || f.acc || t.r) ELSE f.acc END AS acc, f.proof || t.l || t.r AS proof)
  FROM f{k} f JOIN {name} t ON {on}
)"""
    return sql + f"""
SELECT doc_id, leaf, subroot, (SELECT hash FROM top{upper - 1}_up) AS root, sha256(proof) AS proof_sha256,
  acc AS folded_root, acc = (SELECT hash FROM top{upper - 1}_up) AS verified
FROM f{len(places)}
"""


ORACLES = {
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_merkle_manifest": _merkle(levels=7, upper=3),
    "op13_line_dedup": f"""
        WITH cut AS (
          SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
        ),
        lines AS (
          SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS no FROM cut
        ),
        keyed AS (
          SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines
        ),
        firsts AS (
          SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
          GROUP BY key HAVING min(doc_id) <> max(doc_id)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first <> doc_id) AS n_dropped,
          sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (first IS NULL OR first = doc_id), '')) AS kept_sha256
        FROM keyed LEFT JOIN firsts USING (key) GROUP BY doc_id
    """,
}
