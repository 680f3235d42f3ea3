"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import ann, collocations, decontaminate, license_scan, minhash, periodic, phrases, pieces, pii, repeats, toxicity, url_filter, warc
from foliospark.llm.common import table

#: The rules of query op3.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.sanitise(table(spark, sf_dir, "documents")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.page_records(spark, folder)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).drop("url")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "toxicity_.*")


def op5_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "first_word")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(ann.build_index(vectors, k=20), vectors.filter("vec_id % 20 = 0"), k=20)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, with periodic tails planted by query op11's rule: by h = crc32 of doc_id, each word from word a = g % n
    on becomes word a + (i - a) % p, where g = h // 10 and p = 1 + (n - a) // (3 + g % 8), if h % 10 = 0."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), "")

    # each step is bound by a lambda: named columns would be computed again for every word once a filter takes them in
    def turned(x: Column) -> Column:
        at = lambda i: F.get(x["w"], (x["a"] + (i - x["a"]) % x["p"]).cast("int"))
        return F.array_join(F.transform(x["w"], lambda w, i: F.when(i < x["a"], w).otherwise(at(i))), " ")

    def tail(x: Column) -> Column:
        n, g = F.size(x["w"]), F.floor(x["h"] / 10)
        a = F.when(n > 0, g % n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.transform(F.array(F.struct(x["w"].alias("w"), a.alias("a"), p.alias("p"))), turned)[0])

    planted = F.transform(F.array(F.struct(words.alias("w"), h.alias("h"))), tail)[0]
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(planted, F.col("text"))).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.periodic_runs(planted_runs(table(spark, sf_dir, "documents"))))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.digest(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base").alias("first_word"),
        F.array_max("base").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_pii, op2_warc, op3_url_filter, op4_toxicity, op5_probminhash, op6_ann, op7_license_scan, op8_sentencepiece, op9_decontamination, op10_repeats, op11_periodic_runs, op12_collocations, op13_substring_dedup)
    return {f.__name__: f for f in found}


_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _term_sql(terms: Iterable[str], times: Callable[[str], int] = lambda t: 1) -> str:
    return " + ".join(f"{times(t)} * regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT" for t in terms)


def _weight_sql(terms: dict[str, int]) -> str:
    return _term_sql(terms, terms.__getitem__)


def _hits_sql(terms: Iterable[str]) -> str:
    # a separator between two hits belongs to both, so each hit is looked for with its separators doubled
    return " + ".join(f"len(regexp_extract_all(wide, '(?:^|[^a-z0-9]){t}(?:[^a-z0-9]|$)'))" for t in terms)


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS payload_bytes, unhex(sha1(body)) AS raw, sha1(body) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first_id FROM h GROUP BY hex),
d AS (SELECT h.*, f.first_id, list_reduce(list_transform(range(1, 21), lambda i: lpad(bin(('0x' || substr(h.hex, (2 * i - 1)::INT, 2))::INT), 8, '0')), lambda a, b: a || b) AS bits
      FROM h JOIN f USING (hex))
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_reduce(list_transform(range(1, 6), lambda k: substr(bits, (5 * i + k)::INT, 1)::INT), lambda a, b: 2 * a + b), 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""

OP3_SQL = f"""
WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {_LOWER_SQL.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
      {_LOWER_SQL.format("coalesce(url, '')")} AS low, regexp_replace({_LOWER_SQL.format("coalesce(url, '')")}, '([^a-z0-9])', '\\1\\1', 'g') AS wide FROM u),
r(r_verdict, r_host, r_path) AS (VALUES {", ".join(map(str, URL_RULES))}),
m AS (SELECT p.*, (SELECT max_by({{'rule': r_host || r_path, 'verdict': r_verdict}}, length(r_host || r_path)) FROM r
      WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)) AS best FROM p),
c AS (SELECT *, ({_hits_sql(url_filter.STRICT)})::INT AS strict_hits, ({_hits_sql(url_filter.SOFT)})::INT AS soft_hits, ({_term_sql(url_filter.SOFT)})::INT AS soft_distinct,
      ({_weight_sql(url_filter.STRICT)}) + ({_weight_sql(url_filter.SOFT)}) AS hundredths FROM m)
SELECT page_id, host, path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN strict_hits > 0 OR soft_distinct >= {url_filter.MIN_SOFT} THEN 'block' ELSE 'allow' END) AS verdict,
  strict_hits, soft_hits, soft_distinct, hundredths / 100.0::DOUBLE AS weight
FROM c
"""


OP12_SQL = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER_SQL.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
listed AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM pieces),
grams AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS p FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM listed, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, p, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, p, f AS a, string_split(p, ' ') AS ws FROM f WHERE k > 1 AND f >= 30),
cuts AS (SELECT lang, k, p, a, ws, unnest(range(1, k)) AS c FROM cand),
scored AS (SELECT x.lang, x.p, x.a, x.c, y.f AS l, z.f AS r, ((2000000::HUGEINT * x.a) // (y.f + z.f))::BIGINT AS score
  FROM cuts x JOIN f y ON y.lang = x.lang AND y.p = array_to_string(x.ws[1:x.c], ' ') JOIN f z ON z.lang = x.lang AND z.p = array_to_string(x.ws[x.c + 1:], ' ')),
low AS (SELECT lang, p, a, arg_min({{'l': l, 'r': r, 's': score}}, {{'s': score, 'c': c}}) AS b FROM scored GROUP BY ALL),
inside AS (SELECT lang, a, unnest(list_transform(range(1, k - j + 2), lambda i: array_to_string(ws[i:i + j - 1], ' '))) AS p FROM (SELECT *, unnest(range(2, k)) AS j FROM cand WHERE k > 2)),
kept AS (SELECT low.* FROM low LEFT JOIN (SELECT lang, p, max(a) AS m FROM inside GROUP BY ALL) USING (lang, p) WHERE m IS NULL OR 100 * m < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY b.s DESC, a DESC, p) AS rank, p AS phrase, a, b.l AS l, b.r AS r, n, b.s AS score FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS p FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
hit AS (SELECT r, i FROM w SEMI JOIN (SELECT p FROM w GROUP BY p HAVING count(*) > 1) USING (p)),
gone AS (SELECT r, list(DISTINCT k) AS ks FROM (SELECT r, unnest(range(i, i + 35)) AS k FROM hit) GROUP BY r),
words AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM d JOIN gone USING (r)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS t FROM words ANTI JOIN (SELECT r, unnest(ks) AS k FROM gone) USING (r, k) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed, sha256(CASE WHEN ks IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(t, '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op3_url_filter": OP3_SQL, "op12_collocations": OP12_SQL, "op13_substring_dedup": OP13_SQL}
