"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.llm import align, bpecount, linededup, lm, mixing, neardup, packing, tokenbin, topk, toxicity, urlfilter, vectorcodes, vptree
from cardloom.llm.common import table

#: Target shares of characters; all other sources together have the rest.
MIX_WEIGHTS = {"src0": 0.10, "src1": 0.10, "src2": 0.08, "src3": 0.08, "src4": 0.06, "src5": 0.06}
MIX_REST, MIX_SEED = 0.52, 20240607

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
LISTED_HOSTS = ["spam-farm.example.org", "spam-farm.example.net", "spam-farm.example.com"]

TOXIC_FROM = 0.3

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_REST, seed=MIX_SEED)


def op2_token_shards(spark, sf_dir):
    return tokenbin.token_round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0, with_ids=False)


def op3_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op4_url_filter(spark, sf_dir):
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), *urlfilter.rule_tables(spark, URL_RULES, LISTED_HOSTS))


def op5_line_dedup(spark, sf_dir):
    return linededup.drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op6_token_counts(spark, sf_dir):
    import public_tokenizers

    return bpecount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.PATTERN, limit=512)


def op7_vantage_point_search(spark, sf_dir):
    return vptree.nearest_neighbours(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=TOXIC_FROM)


def op10_exact_top_k(spark, sf_dir):
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op11_vector_codes(spark, sf_dir):
    return vectorcodes.code_report(table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark, sf_dir):
    return align.align_documents(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(PIECES))


def op13_lm_scores(spark, sf_dir):
    return lm.score_texts(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_shards": op2_token_shards,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_url_filter": op4_url_filter,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_vantage_point_search": op7_vantage_point_search,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_toxicity": op9_toxicity,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_alignment": op12_token_alignment,
    "op13_lm_scores": op13_lm_scores,
}

_WEIGHTS = ", ".join(f"('{s}', CAST({w} AS DOUBLE))" for s, w in MIX_WEIGHTS.items())

def _codes_sql() -> str:
    """Lloyd in SQL: assignments a0 to a2 by codebooks b0 to b2, each entry (part, entry, e1 to e4)."""
    def nearest(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (SELECT rid, part, min(d * 64 + entry) % 64 AS entry, min(d * 64 + entry) // 64 AS d FROM (
      SELECT rid, p.part, entry, (x1 - e1) * (x1 - e1) + (x2 - e2) * (x2 - e2) + (x3 - e3) * (x3 - e3) + (x4 - e4) * (x4 - e4) AS d FROM p JOIN b{r} b ON p.part = b.part) GROUP BY rid, part)"""

    def moved(r: int) -> str:
        means = ", ".join(f"coalesce(CAST(floor(sum(x{i})::DOUBLE / count(x{i})) AS BIGINT), any_value(e{i})) AS e{i}" for i in range(1, 5))
        return f"""b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, {means} FROM b{r} b LEFT JOIN (SELECT * FROM p JOIN a{r} USING (rid, part)) m ON m.part = b.part AND m.entry = b.entry GROUP BY b.part, b.entry)"""

    return f"""
WITH v AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id, e) AS rid FROM (
      SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
p AS MATERIALIZED (SELECT rid, CAST(i AS INTEGER) AS part, e[4 * i + 1] AS x1, e[4 * i + 2] AS x2, e[4 * i + 3] AS x3, e[4 * i + 4] AS x4 FROM v, unnest(range(0, 16)) AS t(i)),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x1 AS e1, x2 AS e2, x3 AS e3, x4 AS e4 FROM p WHERE rid <= 64),
{nearest(0)},
{moved(0)},
{nearest(1)},
{moved(1)},
{nearest(2)},
coded AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY rid),
book AS (SELECT sha256(string_agg(concat_ws(',', e1, e2, e3, e4), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN v USING (rid), book"""


SQL: dict[str, str] = {
    "op1_mix_sources": f"""
WITH weights(src, w) AS (VALUES {_WEIGHTS}, (NULL, CAST({MIX_REST} AS DOUBLE))),
d AS (SELECT *, CASE WHEN source IN ({", ".join(f"'{s}'" for s in MIX_WEIGHTS)}) THEN source END AS grp,
      coalesce(length(text), 0) + 1 AS size, coalesce(CAST(doc_id AS VARCHAR), 'null') AS ident FROM documents),
g AS (SELECT grp, CAST(sum(size) AS DOUBLE) AS size, min(w) AS w FROM d JOIN weights ON grp IS NOT DISTINCT FROM src GROUP BY grp),
r AS (SELECT grp, 1.0::DOUBLE * sum(size) OVER () * w / sum(w) OVER () / size AS rate FROM g),
p AS (SELECT grp, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM r, generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 24) AS BIGINT)) AS t(k)),
c AS (SELECT grp, list(cdf ORDER BY k) AS cdf FROM (SELECT grp, k, sum(p) OVER (PARTITION BY grp ORDER BY k) AS cdf FROM p) GROUP BY grp),
n AS (SELECT d.*, len(list_filter(cdf, lambda x: x <= CAST(('0x' || substr(md5('{MIX_SEED}:' || ident), 1, 13)) AS BIGINT) / 4503599627370496.0)) AS n
      FROM d JOIN c ON d.grp IS NOT DISTINCT FROM c.grp)
SELECT doc_id, text, lang, source, n_chars, CAST(n AS INTEGER) AS n_copies, CAST(copy AS INTEGER) AS copy,
       md5('{MIX_SEED}:' || ident || ':' || copy) AS mix_key
FROM n, unnest(generate_series(1, n)) AS t(copy)""",
    "op4_url_filter": f"""
WITH r(rule_host, rule_path, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
b(listed) AS (VALUES {", ".join(f"('{h}')" for h in LISTED_HOSTS)}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT page_id, coalesce(translate(raw, '{urlfilter.UPPER}', '{urlfilter.LOWER}'), '') AS host,
      coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h),
m AS (SELECT p.*, rule_host || rule_path AS rule, verdict,
      row_number() OVER (PARTITION BY p.page_id ORDER BY length(rule_host) + length(rule_path) DESC NULLS LAST, length(rule_host) DESC) AS n
      FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN EXISTS (SELECT 1 FROM b WHERE host = listed OR ends_with(host, '.' || listed)) THEN 'block' ELSE 'allow' END) AS verdict
FROM m WHERE n = 1""",
    "op5_line_dedup": r"""
WITH x AS (SELECT md5(text) AS m, any_value(string_split(text, chr(10))) AS arr, any_value(text) AS text, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY md5(text)),
a AS (SELECT m, copies, i - 1 AS pos, arr[i] AS line, list_filter(string_split_regex(arr[i], '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM x, unnest(range(1, len(arr) + 1)) AS t(i)),
l AS (SELECT *, len(w) || '|' || array_to_string(list_transform(w[1:3], lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), ' ') AS leaf FROM a WHERE len(w) > 0),
h AS (SELECT * FROM l WHERE leaf IN (SELECT leaf FROM l GROUP BY leaf HAVING sum(copies) >= 20 AND min(m) <> max(m))),
k AS (SELECT leaf, line, n, p, w[p] AS token FROM (SELECT leaf, line, any_value(w) AS w, sum(copies) AS n FROM h GROUP BY leaf, line), unnest(range(1, len(w) + 1)) AS t(p)),
c AS (SELECT leaf, p, token FROM k GROUP BY leaf, p, token HAVING sum(n) >= 20),
s AS (SELECT k.leaf, line, string_agg(coalesce(c.token, '<*>'), ' ' ORDER BY k.p) AS shape, count(c.token) * 2 >= count(*) AS general
      FROM k LEFT JOIN c ON k.leaf = c.leaf AND k.p = c.p AND k.token = c.token GROUP BY k.leaf, line),
stands AS (SELECT h.m, h.pos, h.leaf || CASE WHEN general THEN ' T ' || shape ELSE ' L ' || h.line END AS template FROM h JOIN s ON h.leaf = s.leaf AND h.line = s.line),
often AS (SELECT * FROM stands WHERE template IN (SELECT template FROM stands GROUP BY template HAVING count(DISTINCT m) >= 20)),
places AS (SELECT m, pos, ['first ' || array_to_string(w[1:3], ' '), 'mid ' || array_to_string(w[greatest(1, len(w) // 2):greatest(1, len(w) // 2) + 2], ' '), 'last ' || array_to_string(w[greatest(1, len(w) - 2):], ' ')] AS f, 'line ' || line AS g FROM l WHERE m IN (SELECT m FROM often)),
rest AS (SELECT DISTINCT m, unnest(f) AS f FROM places p WHERE NOT EXISTS (SELECT 1 FROM often o WHERE o.m = p.m AND o.pos = p.pos)),
asked AS (SELECT * FROM rest UNION SELECT m, g FROM places WHERE m NOT IN (SELECT m FROM rest)),
holders AS (SELECT f, min(m) AS holder FROM (SELECT m, unnest(list_append(f, g)) AS f FROM places) GROUP BY f),
parts AS (SELECT a.m, holder, count(*) AS n FROM asked a JOIN holders h ON a.f = h.f AND holder < a.m GROUP BY a.m, holder),
most AS (SELECT m, holder, n FROM parts QUALIFY row_number() OVER (PARTITION BY m ORDER BY n DESC, holder) = 1),
copied AS (SELECT m, holder FROM most JOIN (SELECT m, count(*) AS c FROM asked GROUP BY m) USING (m) WHERE 3 * n >= c),
classes AS (SELECT c.m, coalesce(d.holder, c.holder) AS class FROM copied c LEFT JOIN copied d ON d.m = c.holder),
recurring AS (SELECT template FROM often LEFT JOIN classes USING (m) GROUP BY template HAVING count(DISTINCT coalesce(class, m)) >= 20),
holds AS (SELECT DISTINCT line, m FROM l WHERE len(w) >= 20),
few AS (SELECT line, min(m) AS f FROM holds GROUP BY line HAVING count(*) BETWEEN 2 AND 19),
need AS (SELECT m FROM holds JOIN few USING (line) GROUP BY m),
words AS (SELECT m, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM x WHERE m IN (SELECT m FROM need)),
runs AS (SELECT m, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: substr(md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]), 1, 12))))[1:64] AS r FROM words),
pairs AS (SELECT DISTINCT f, m FROM holds JOIN few USING (line) WHERE f <> m),
apart AS (SELECT f, m FROM (SELECT p.f, p.m, a.r AS x, b.r AS y, list_sort(list_distinct(list_concat(a.r, b.r)))[1:64] AS u FROM pairs p JOIN runs a ON p.f = a.m JOIN runs b ON p.m = b.m)
          WHERE len(list_intersect(list_intersect(u, x), y)) < 0.5 * len(u)),
unlike AS (SELECT DISTINCT line FROM holds JOIN few USING (line) JOIN apart USING (f, m)),
cut AS (SELECT m, pos FROM often WHERE template IN (SELECT template FROM recurring) UNION SELECT m, pos FROM l WHERE line IN (SELECT line FROM unlike)),
o AS (SELECT a.m, string_agg(line, chr(10) ORDER BY a.pos) FILTER (WHERE cut.pos IS NULL) AS text, count(*) AS n_lines, count(cut.pos) AS n_dropped
      FROM a LEFT JOIN cut ON a.m = cut.m AND a.pos = cut.pos GROUP BY a.m)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text, CAST(coalesce(o.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(o.n_dropped, 0) AS INTEGER) AS n_dropped
FROM documents d LEFT JOIN o ON md5(d.text) = o.m""",
    "op10_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_vector_codes": _codes_sql(),
}
