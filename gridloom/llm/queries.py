"""The registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from . import bloom_lm, bpe, chat, decontaminate, fim, hilbert, importance, line_crf, pii, quality_fm, simhash_vp, spotsigs, suffix_dedup
from .common import read


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the installed public vocabulary; the operators take both as parameters."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark, sf_dir):
    return bpe.round_trip(read(spark, sf_dir, "documents"), *vocabulary())


def op2_spotsigs(spark, sf_dir):
    return spotsigs.digest(spotsigs.compare_edited(read(spark, sf_dir, "documents")))


def op3_decontamination(spark, sf_dir):
    return decontaminate.digest(decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op5_bloom_lm(spark, sf_dir):
    return bloom_lm.score(read(spark, sf_dir, "documents"))


def op6_hilbert_shards(spark, sf_dir):
    return hilbert.digest(hilbert.shard(read(spark, sf_dir, "documents")))


def op7_simhash_vp(spark, sf_dir):
    return simhash_vp.digest(simhash_vp.near_duplicates(read(spark, sf_dir, "documents")))


def op8_quality_fm(spark, sf_dir):
    return quality_fm.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_chat_format(spark, sf_dir):
    return chat.query(spark, sf_dir)


def op10_pii(spark, sf_dir):
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


def op11_importance(spark, sf_dir):
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_line_crf(spark, sf_dir):
    return line_crf.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_fim(spark, sf_dir):
    return fim.digest(fim.transform(read(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_spotsigs, op3_decontamination, op4_suffix_dedup, op5_bloom_lm, op6_hilbert_shards, op7_simhash_vp, op8_quality_fm, op9_chat_format, op10_pii, op11_importance, op12_line_crf, op13_fim)}

_ESCAPED = "replace({}, '\\', '\\\\')"
for _control in chat.CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_control}', '{_control[0]}\\{_control[1:]}')"
_LENGTH = "length({e})".replace("{e}", _ESCAPED)
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: crc32 of a word's bytes, bit by bit through the usual table of its polynomial, which a query can make itself.
_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, CAST(b AS BIGINT)))"
_CRC = "xor(list_reduce(list_transform(range(1, length(hex(encode(w))), 2), lambda i: CAST('0x' || hex(encode(w))[i:i + 1] AS BIGINT)), lambda c, b: xor(tab[CAST((xor(c, b) & 255) + 1 AS BIGINT)], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295)"
_HASH = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"

#: SQL for the operators whose results it can express; the others are tested against brute force, libraries or held-out rows.
ORACLE: dict[str, str] = {
    "op3_decontamination": f"""WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark), g AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
 d AS (SELECT doc_id, {_WORDS} AS w FROM documents), k AS (SELECT DISTINCT n FROM g), h AS (SELECT doc_id, i, p.n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d), k WHERE i + n - 1 <= len(w)) p JOIN g ON g.n = p.n AND g.gram = p.gram),
 c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY 1), t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY 1)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op9_chat_format": f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{chat.PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{chat.PROBE}')
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256, CAST(sum({len(chat.START) + len(chat.END) + 2} + {_LENGTH.format('role')} + {_LENGTH.format('text')}) AS BIGINT) AS formatted_chars FROM r GROUP BY 1""",
    "op11_importance": f"""WITH k AS (SELECT {_CRC_TABLE} AS tab), a AS (SELECT 's' AS side, doc_id AS id, {_WORDS} AS ws FROM documents UNION ALL SELECT 't', NULL, {_WORDS} FROM benchmark), v AS (SELECT side, id, unnest(ws) AS w FROM a),
 b AS (SELECT w, CAST({_CRC} % 10000 AS BIGINT) AS bucket FROM (SELECT DISTINCT w FROM v), k), f AS (SELECT side, id, bucket FROM v JOIN b USING (w)),
 n AS (SELECT bucket, CAST(count(*) FILTER (side = 's') AS DOUBLE) AS s, CAST(count(*) FILTER (side = 't') AS DOUBLE) AS t FROM f GROUP BY 1), z AS (SELECT sum(s) AS ss, sum(t) AS tt FROM n),
 g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000)))) AS BIGINT) AS gain FROM n, z), d AS (SELECT id, sum(gain) AS weight FROM f JOIN g USING (bucket) WHERE side = 's' GROUP BY 1),
 r AS (SELECT doc_id, len({_WORDS}) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score FROM documents LEFT JOIN d ON d.id = doc_id),
 o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS i, count(*) OVER () AS m FROM r WHERE n_features >= 20)
 SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN i <= m * 10 // 100 THEN i END AS rank, CAST(n_features AS BIGINT) AS n_words FROM r LEFT JOIN o USING (doc_id)""",
    "op13_fim": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l FROM documents),
 c AS (SELECT *, len(l) AS n, {_HASH.format(1)} % (len(l) + 1) AS a, {_HASH.format(9)} % (len(l) + 1) AS b, {_HASH.format(25)} % 100 AS s, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_HASH.format(17)} % 100 >= 100 AS plain FROM d),
 p AS (SELECT doc_id, t, n, s, plain, array_to_string(l[:least(a, b)], '') AS p, array_to_string(l[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(l[greatest(a, b) + 1:], '') AS x FROM c)
 SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN s < 50 THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
 sha256(CASE WHEN plain THEN t WHEN s < 50 THEN concat('<S>', x, '<P>', p, '<M>', m) ELSE concat('<P>', p, '<S>', x, '<M>', m) END) AS output_sha256, sha256(CASE WHEN plain THEN t ELSE concat(p, m, x) END) AS restored_sha256 FROM p""",
}
