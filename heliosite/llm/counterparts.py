"""DuckDB SQL that gives the same rows as the queries of operators that SQL can express."""

from __future__ import annotations

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEVELS, GROUP_LEVELS = 9, 4  # SQL unrolls the trees: up to 8**9 rows a language and 8**4 languages

#: ``crc_table``: the CRC-32 of each byte, from its polynomial; ``crc(bytes)`` in terms of it
CRC_TABLE = "crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"


def crc(data: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length({data})), lambda k: ('0x' || substr(hex({data}), 2 * k + 1, 2))::BIGINT)), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295)"


def lowered(text: str) -> str:
    return f"translate({text}, '{ALPHABET}', '{ALPHABET.lower()}')"


def merkle() -> str:
    def field(x: str) -> str:
        return f"coalesce(octet_length(encode({x}::VARCHAR)) || ':' || {x}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def tree(name: str, levels: int) -> list[str]:
        out = []
        for k in range(levels):
            out.append(f"{name}_run{k} AS (SELECT g, idx // 8 AS parent, list(digest ORDER BY idx) AS run, idx // 8 = 0 AND count(*) = 1 AS alone FROM {name}{k} GROUP BY g, idx // 8)")
            out.append(f"{name}{k + 1} AS (SELECT g, parent AS idx, sha256(array_to_string(run, '')) AS digest FROM {name}_run{k} WHERE NOT alone)")
        return out

    def top(name: str, levels: int) -> str:
        return " UNION ALL ".join(f"SELECT g, run[1] AS digest FROM {name}_run{k} WHERE alone" for k in range(levels))

    parts = [
        CRC_TABLE,
        f"leaves AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, {leaf('text')} AS digest, CASE WHEN {crc('encode(doc_id::VARCHAR)')} % 3 = 0 THEN {leaf(lowered('text'))} ELSE {leaf('text')} END AS changed FROM documents, crc_table)",
        "node0 AS (SELECT doc_id, g, digest, changed, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS idx FROM leaves)",
        *tree("node", LEVELS),
        f"subroots AS ({top('node', LEVELS)})",
        "group0 AS (SELECT g AS of_group, '' AS g, digest, row_number() OVER (ORDER BY g) - 1 AS idx FROM subroots)",
        *tree("group", GROUP_LEVELS),
        f"roots AS ({top('group', GROUP_LEVELS)})",
        "way0 AS (SELECT n.doc_id, n.digest AS leaf, s.digest AS subroot, r.digest AS root, n.g, n.idx, o.idx AS place, '' AS proof, n.changed AS fold FROM node0 n JOIN subroots s USING (g) JOIN group0 o ON o.of_group = n.g CROSS JOIN roots r)",
    ]
    steps = [("node", k, "idx", "w.g") for k in range(LEVELS)] + [("group", k, "place", "''") for k in range(GROUP_LEVELS)]
    for i, (name, k, at, g) in enumerate(steps):
        pos = f"w.{at} // {8**k} % 8"
        left, right = f"array_to_string(run[1:({pos})::BIGINT], '')", f"array_to_string(run[({pos})::BIGINT + 2:], '')"
        parts.append(
            f"way{i + 1} AS (SELECT doc_id, leaf, subroot, root, w.g, idx, place, proof || coalesce({left} || {right}, '') AS proof, CASE WHEN run IS NULL THEN fold ELSE sha256({left} || fold || {right}) END AS fold"
            f" FROM way{i} w LEFT JOIN (SELECT * FROM {name}_run{k} WHERE NOT alone) x ON x.g = {g} AND x.parent = w.{at} // {8 ** (k + 1)})"
        )
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM way{len(steps)}"


def resampling() -> str:
    def features(table: str, key: str) -> str:
        words = f"SELECT {key} AS doc_id, regexp_extract_all({lowered('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"
        return f"SELECT doc_id, array_to_string(w[i:i + n - 1], ' ') AS feature FROM ({words}), (VALUES (1), (2), (3)) k(n), unnest(range(1, greatest(len(w) - n + 2, 1))) u(i)"

    return f"""WITH {CRC_TABLE},
      source AS MATERIALIZED ({features("documents", "doc_id")}), target AS MATERIALIZED ({features("benchmark", "item_id")}),
      hashed AS MATERIALIZED (SELECT feature, {crc("encode(feature)")} % 10000 AS bucket FROM (SELECT feature FROM source UNION SELECT feature FROM target), crc_table),
      s AS (SELECT bucket, count(*) AS n FROM source JOIN hashed USING (feature) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM target JOIN hashed USING (feature) GROUP BY bucket),
      totals AS (SELECT (SELECT count(*) FROM source) AS big_s, (SELECT count(*) FROM target) AS big_t),
      gains AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (big_s + 10000) / ((s.n + 1)::DOUBLE * (big_t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), totals),
      sums AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM source JOIN hashed USING (feature) JOIN gains USING (bucket) GROUP BY doc_id),
      scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(len(regexp_extract_all({lowered("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')), 0) >= 20 AS able,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN sums USING (doc_id)),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS many FROM scored)
      SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN able AND place <= 5 * many // 100 THEN place END AS rank FROM ranked"""


def line_dedup() -> str:
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH lines AS MATERIALIZED (SELECT doc_id, place, line, {lowered(f"trim(line, {white})")} AS key FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), unnest(lines) WITH ORDINALITY u(line, place)),
      common AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
      judged AS (SELECT doc_id, place, line, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM lines LEFT JOIN common USING (key))
      SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY doc_id"""
