"""The contract queries of this subpackage, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import flatgraph, licenses, mixing, ordinal, packing, planes, prefix_counts, prefixtrie, rules, simhash, storage, suffix, urlfilter, vectorcodes

#: The rules of the URL query: (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.read_table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.classify(documents(spark, sf_dir), ordinal.load_labels(spark, sf_dir))


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(documents(spark, sf_dir))


def op3_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.count_tokens(documents(spark, sf_dir))


def op4_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.read(planes.write(documents(spark, sf_dir), storage.fresh_path(spark, "planes"), end_id=2))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(documents(spark, sf_dir))


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), end_id=1)


def op7_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    # which rule rejects first depends on measured times, so it is no part of the result
    return rules.cascade(documents(spark, sf_dir), measures=True).drop("rejected_by")


def op8_flat_graph_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatgraph.link(storage.read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op9_url_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(storage.read_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return mixing.rates(docs, mixing.labelled_by_lang(docs, ordinal.load_labels(spark, sf_dir)))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(storage.read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.tree(storage.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def codes_sql(rounds: int = 2) -> str:
    """All distances of all parts to all entries, round after round."""
    near = "SELECT vec_id, label, p.part, x, arg_min(entry, dist * 64 + entry) AS entry, min(dist) AS dist FROM (SELECT p.*, c.entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist FROM p JOIN c{k} c ON p.part = c.part) p GROUP BY ALL"
    moves = """
a{k} AS (NEAR), m{k} AS (SELECT part, entry, list(f ORDER BY pos) AS c FROM (SELECT part, entry, pos, (t - ((t % n) + n) % n) // n AS f FROM (SELECT part, entry, pos, sum(v)::BIGINT AS t, count(*) AS n FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS pos FROM a{k}) GROUP BY ALL)) GROUP BY ALL),
c{j} AS (SELECT part, entry, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (part, entry)),"""
    steps = "".join(moves.replace("NEAR", near).replace("{k}", str(k)).replace("{j}", str(k + 1)) for k in range(rounds))
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT max(len(v)) // 16 AS w FROM k),
p AS (SELECT vec_id, label, g AS part, v[g * w + 1 : (g + 1) * w] AS x FROM k, w, (SELECT unnest(range(16)) AS g)),
c0 AS (SELECT part, entry, x AS c FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < 64),{steps}
e AS ({near.replace("{k}", str(rounds))}),
r AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM e GROUP BY vec_id, label),
b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r, b"""


#: Every prefix of every conversation, grouped; CRC-32 from a table that its rule makes.
TREE_SQL = r"""
WITH RECURSIVE crc(i, v, b) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, xor(v >> 1, 3988292384 * (v & 1)), b + 1 FROM crc WHERE b < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE b = 8),
ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::BIGINT)), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) % 4 AS h FROM ids, tab),
q AS (SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-]+'), lambda x: x <> '')) AS words FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS p FROM q),
b AS (SELECT h.conv_id, 0 AS src, p, digest, words FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 20 AND p <= h UNION ALL SELECT h.conv_id, 1, p, digest, words FROM h JOIN o ON o.conv_id = h.conv_id AND p > h),
s AS (SELECT conv_id, list(digest ORDER BY src, p) AS ds, list(words ORDER BY src, p) AS ws FROM b GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(ds, []) AS ds, coalesce(ws, []) AS ws FROM ids LEFT JOIN s USING (conv_id)),
e AS (SELECT *, unnest(range(len(ds) + 1)) AS d FROM c),
x AS (SELECT conv_id, d, d || ':' || array_to_string(ds[1:d], '') AS name, CASE WHEN d > 0 THEN (d - 1) || ':' || array_to_string(ds[1:d - 1], '') END AS up, coalesce(ws[d], 0) AS words, len(ds) = d AS over FROM e),
n AS (SELECT name, d, any_value(up) AS up, min(conv_id) AS least, count(*) AS n, any_value(words) AS words, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (over), '') AS ends FROM x GROUP BY name, d),
k AS (SELECT up AS name, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT x.name, count(*) FILTER (k.name IS NULL) AS n_leaves, sum((n.n - 1) * n.words)::BIGINT AS saved_tokens FROM n JOIN x ON x.conv_id = n.least AND x.d <= n.d LEFT JOIN k ON k.name = n.name GROUP BY x.name)
SELECT n.least AS conv_id, n.d AS depth, above.least AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN below USING (name) LEFT JOIN k USING (name) LEFT JOIN n above ON above.name = n.up"""


QUERIES = {f.__name__: f for f in (op1_ordinal_quality, op2_simhash_neardup, op3_prefix_token_counts, op4_bitplane_tokens, op5_suffix_array_dedup, op6_sum_of_squares_packing, op7_rule_cascade, op8_flat_graph_neardup, op9_url_range_join, op10_soft_mixing, op11_vector_codes, op12_license_scan, op13_prefix_trie)}
ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": codes_sql(),
    "op12_license_scan": licenses.scan_sql(),
    "op13_prefix_trie": TREE_SQL,
    "op7_rule_cascade": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup, count(*) FILTER (regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS n_cut FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT k) AS n_rep FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM g WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_rep, 0) AS n_repeat_words, coalesce(n_cut, 0) AS n_cut,
  len(list_filter(ws, lambda x: list_contains([""" + ", ".join(f"'{w}'" for w in rules.STOP_WORDS) + r"""], lower(x)))) AS n_stop, len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter, len(list_distinct(ws)) AS n_distinct FROM w LEFT JOIN ln ON w.doc_id = ln.doc_id LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > word_chars OR word_chars > 20 * n_words OR word_chars < 2 * n_words OR 10 * n_dup_lines > 3 * n_lines
  OR 100 * n_stop < n_words OR 10 * n_letter < 8 * n_words OR 10 * n_distinct < n_words OR 10 * n_cut > 3 * n_lines) AS kept FROM m""",
    "op9_url_range_join": r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES """ + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + r""") v(h, f, verdict)),
b AS (SELECT p.page_id, r.h || r.f AS rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.h || r.f) DESC) AS k FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.f))
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM p LEFT JOIN b ON p.page_id = b.page_id AND b.k = 1""",
}
