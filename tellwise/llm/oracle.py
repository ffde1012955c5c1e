"""DuckDB statements with the results of the registered queries, where SQL can express them."""

_WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format(text='text')}, []) AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS.format(text='text')} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, k, array_to_string(w[s:s + k - 1], ' ') AS win
       FROM (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT doc_id, s, k, item FROM dw JOIN bw USING (k, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
       sha256(coalesce(its.l, '')) AS items_sha256,
       coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP2 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""

OP6 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
wins AS (SELECT doc_id, s, array_to_string(w[s:s + 34], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY win) AS n FROM wins) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM rep),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP8 = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (SELECT page_id, n, h, string_agg(lpad(to_base(instr('0123456789abcdef', h[i]) - 1, 2), 4, '0'), '' ORDER BY i) AS b
         FROM p, range(1, 41) AS r(i) GROUP BY page_id, n, h),
digest AS (SELECT page_id, n, h, string_agg('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(strpos(c.codes, b[5 * k + 1:5 * k + 5]) AS INTEGER) // 6 + 1], '' ORDER BY k) AS d
           FROM bits, range(0, 32) AS r(k), (SELECT string_agg(lpad(to_base(v, 2), 5, '0'), ',' ORDER BY v) AS codes FROM range(0, 32) AS t(v)) AS c
           GROUP BY page_id, n, h),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first FROM digest)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""


_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295::BIGINT)"""


def _levels(name: str, depth: int) -> list[str]:
    """Tree levels over {name}0 (g, i, h), siblings of every node, and the trees' last nodes."""
    out = []
    for k in range(depth):
        out.append(f"""{name}{k}_runs AS (SELECT g, i // 16 AS r, string_agg(h, '' ORDER BY i) AS t FROM {name}{k}
            WHERE g IN (SELECT g FROM {name}{k} GROUP BY g HAVING count(*) > 1) GROUP BY g, i // 16)""")
        out.append(f"""{name}{k}_beside AS (SELECT n.g, n.i, t[:64 * (i % 16)] AS b, t[64 * (i % 16) + 65:] AS a
            FROM {name}{k} n JOIN {name}{k}_runs x ON n.g = x.g AND n.i // 16 = x.r)""")
        out.append(f"{name}{k + 1} AS (SELECT g, r AS i, sha256(t) AS h FROM {name}{k}_runs)")
    ends = " UNION ALL ".join(f"SELECT g, any_value(h) AS h FROM {name}{k} GROUP BY g HAVING count(*) = 1" for k in range(depth + 1))
    return [*out, f"{name}_heads AS ({ends})"]


def _climb(name: str, depth: int, source: str) -> list[str]:
    """The rows of source (g, i, folded, proof) after the levels of a tree."""
    out = []
    for k in range(depth):
        out.append(f"""{name}_up{k} AS (SELECT u.* EXCLUDE (folded, proof), CASE WHEN s.g IS NULL THEN folded ELSE sha256(b || folded || a) END AS folded,
            proof || coalesce(b || a, '') AS proof
            FROM {source if k == 0 else f'{name}_up{k - 1}'} u LEFT JOIN {name}{k}_beside s ON u.g = s.g AND u.i // {16 ** k} = s.i)""")
    return out


_FRAMED = "CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FRAMED.format(x=x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Trees of up to 16 ** 6 leaves, and as many as 16 ** 4 sources.
OP12 = "WITH " + ", ".join([
    f"""d AS (SELECT doc_id, coalesce('=' || source, '') AS g, {_leaf('text')} AS leaf, coalesce({_CRC32.format(x="CAST(doc_id AS VARCHAR)")} % 5 = 0, false) AS changed,
        {_leaf(_LOWERED)} AS altered FROM documents)""",
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
    "n0 AS (SELECT g, i, leaf AS h FROM ranked)",
    *_levels("n", 6),
    "top0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h FROM n_heads)",
    *_levels("top", 4),
    "leaves AS (SELECT doc_id, g, i, leaf, CASE WHEN changed THEN altered ELSE leaf END AS folded, '' AS proof FROM ranked)",
    *_climb("n", 6, "leaves"),
    "placed AS (SELECT g AS own, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS k FROM n_heads)",
    "mids AS (SELECT doc_id, leaf, subroot, folded, proof, '' AS g, k AS i FROM n_up5 JOIN placed ON g = own)",
    *_climb("top", 4, "mids"),
]) + """
SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.h AS verified
FROM top_up3, top_heads t
"""

OP13 = """
WITH taken AS (SELECT vec_id, label::BIGINT AS label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
one AS (SELECT DISTINCT ON (vec_id) * FROM taken ORDER BY vec_id, label, e),
v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(e, lambda x: floor(256 * x)) AS e FROM one),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.e, r.e) AS BIGINT) AS score
      FROM v a JOIN v r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def statements() -> dict[str, str]:
    return {"op1_decontamination": OP1, "op2_exact_dedup": OP2, "op6_substring_dedup": OP6, "op8_arc_to_warc": OP8, "op12_merkle_manifest": OP12, "op13_hard_negatives": OP13}
