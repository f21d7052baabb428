"""The queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, coder, fingerprint, jaccard, langid, merkle, mixing, negatives, packing, quality, sharding, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.op1,
        "op2_neighbours": ann.op2,
        "op3_fingerprints": fingerprint.op3,
        "op4_mixing": mixing.op4,
        "op5_packing": packing.op5,
        "op6_token_ids": coder.op6,
        "op7_quality": quality.op7,
        "op8_jaccard": jaccard.op8,
        "op9_sharding": sharding.op9,
        "op10_language": langid.op10,
        "op11_hard_negatives": negatives.op11,
        "op12_chat_format": chat.op12,
        "op13_merkle": merkle.op13,
    }


_B32 = " || ".join(
    f"lpad(translate(to_base(('0x' || substr(d, {10 * i + 1}, 10))::BIGINT, 32), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'), 8, 'A')"
    for i in range(4)
)


def _merkle_sql(levels: int = 6, top_levels: int = 4) -> str:
    """Level by level; trees deeper than the levels aren't covered (16 ** 6 rows a source, 16 ** 4 sources)."""
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    digest = lambda text: f"sha256({' || '.join(value(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # The bits of a byte go through the register one by one: a byte, then seven zeros.
    step = "xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))"
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda b: [CAST(ascii(b) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, x: {step}), 4294967295)"
    sql = [
        f"d AS (SELECT doc_id, source, {digest('text')} leaf, CASE WHEN {crc} % 5 = 0 THEN {digest(lower)} END changed FROM documents)",
        "n AS (SELECT *, coalesce(changed, leaf) now, coalesce('+' || source, '') g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 pos FROM d)",
    ]

    def tree(name: str, nodes: str, depth: int) -> None:
        sql.append(f"{name}0 AS ({nodes})")
        for k in range(depth):
            sql.append(f"{name}r{k} AS (SELECT g, pos // 16 pos, string_agg(digest, '' ORDER BY pos) run, max(c) c FROM (SELECT *, count(*) OVER (PARTITION BY g) c FROM {name}{k}) GROUP BY 1, 2)")
            sql.append(f"{name}{k + 1} AS (SELECT g, pos, CASE WHEN c = 1 THEN run ELSE sha256(run) END digest FROM {name}r{k})")

    tree("s", "SELECT g, pos, leaf digest FROM n", levels)
    tree("t", f"SELECT 0 g, row_number() OVER (ORDER BY g) - 1 pos, digest, g name FROM s{levels}", top_levels)
    sql.append(f"f0 AS (SELECT n.doc_id, n.leaf, n.g, n.pos, t0.pos place, t0.digest subroot, t{top_levels}.digest root, n.now fold, '' proof FROM n JOIN t0 ON t0.name = n.g CROSS JOIN t{top_levels})")
    for k, (name, group, pos, level) in enumerate([("s", "f.g", "pos", i) for i in range(levels)] + [("t", "0", "place", i) for i in range(top_levels)]):
        at = f"CAST(f.{pos} // {16**level} % 16 AS BIGINT)"
        sides = f"substr(run, 1, 64 * {at}) l, substr(run, 64 * {at} + 65) r"
        sql.append(f"j{k} AS (SELECT f.*, c, {sides} FROM f{k} f JOIN {name}r{level} x ON x.g = {group} AND x.pos = f.{pos} // {16 ** (level + 1)})")
        sql.append(f"f{k + 1} AS (SELECT * EXCLUDE (c, l, r) REPLACE (CASE WHEN c = 1 THEN fold ELSE sha256(l || fold || r) END AS fold, CASE WHEN c = 1 THEN proof ELSE proof || l || r END AS proof) FROM j{k})")
    return f"WITH {', '.join(sql)} SELECT doc_id, leaf, subroot, root, sha256(proof) proof_sha256, fold folded_root, fold = root verified FROM f{levels + top_levels}"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') html, sha1(coalesce(html, '')) d FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY html) first_id FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) payload_bytes, {_B32} payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END refers_to
FROM f
""",
        "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) q FROM embeddings
           WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id anchor_id, b.vec_id, a.label = b.label same, CAST(list_dot_product(a.q, b.q) AS BIGINT) score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id positive_id, score positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
r AS (SELECT p.*, s.vec_id negative_id, s.score negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) r
      FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, CAST(r AS INT) rank, negative_id, positive_score, negative_score FROM r WHERE r <= 5
""",
        "op12_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') "role", coalesce(text, '') text FROM conversations
           UNION ALL SELECT -1, k, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, "role", text) i, lag("role") OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, "role", text) before FROM t),
m AS (SELECT *, i = 1 OR "role" <> before AS heads, length(text) + len(regexp_extract_all(text, '<\\*\|')) chars,
      length("role") + len(regexp_extract_all("role", '<\\*\|')) + 2 * len(regexp_extract_all("role", '[%\n]')) role_chars FROM o)
SELECT conv_id, count(*) n_turns, sha256(string_agg("role" || chr(10) || text || chr(10), '' ORDER BY i)) turns_sha256,
 CAST(sum(CASE WHEN "role" = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER ("role" = 'assistant'), '')) loss_sha256,
 CAST(sum(chars + CASE WHEN heads THEN role_chars + length('<|im_start|>') + length('<|im_end|>') + 2 ELSE length('<|im_sep|>') END) AS BIGINT) formatted_chars,
 CAST(sum(CASE WHEN heads THEN 1 ELSE 0 END) AS BIGINT) n_blocks, CAST(ceil(count(*) / 256) AS BIGINT) n_segments
FROM m GROUP BY conv_id
""",
        "op13_merkle": _merkle_sql(),
    }
