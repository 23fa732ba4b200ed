"""The operators of this package as registered queries over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm import (
    ann,
    conversation_repair,
    decontaminate,
    jaccard_join,
    katz,
    language_id,
    license_scan,
    packing,
    quality,
    substring_dedup,
    token_counts,
    url_filter,
    whitening,
)
from tablescout.llm.words import fold

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return substring_dedup.digest(docs, substring_dedup.repeats(docs))


@query
def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


@query
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contained(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op5_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, folder, "documents"))


@query
def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    scored = katz.score(table(spark, folder, "documents"), fold("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_ann_search(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), every=20)


@query
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language_id.with_fold(language_id.predict(docs, language_id.fit(docs)))


@query
def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.with_fold(quality.score(docs, quality.fit(docs, table(spark, folder, "labels"))))


#: The rules of the contract: action, host, path (fixed values).
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/"))


@query
def op11_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    # The labels of this corpus are numbered like its pages; a page of low quality is a bad outcome.
    outcomes = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    judged = url_filter.judge(table(spark, folder, "pages"), outcomes, URL_RULES)
    return judged.withColumns({c: F.round(c, 6) for c in ("reputation", "bound")})


@query
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    talks = table(spark, folder, "conversations")
    return conversation_repair.digest(conversation_repair.repair(conversation_repair.damage(talks)), talks)


@query
def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


# The share of an item's 5-word shingles that occur in a document, for every pair that shares one; 80 % or more counts.
# Items of fewer words are found as they stand.  Rows of one id are searched, and searched for, each by itself.
def _rows(table_name: str, key: str) -> str:
    return rf"""SELECT row_number() OVER () AS row_no, {key}, w FROM (SELECT DISTINCT {key}, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table_name} WHERE {key} IS NOT NULL)"""


_SHINGLES = "unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')))"
ORACLES["op4_benchmark_decontamination"] = f"""
WITH d AS ({_rows("documents", "doc_id")}), b AS ({_rows("benchmark", "item_id")}),
i AS (SELECT DISTINCT row_no AS item_row, item_id, {_SHINGLES} AS s FROM b WHERE len(w) >= 5),
n AS (SELECT item_row, count(*) AS item_shingles FROM i GROUP BY item_row),
g AS (SELECT DISTINCT row_no AS doc_row, doc_id, {_SHINGLES} AS s FROM d WHERE len(w) >= 5),
hits AS (SELECT doc_id, item_id, count(*) AS shared, item_shingles FROM g JOIN i USING (s) JOIN n USING (item_row)
         GROUP BY doc_row, doc_id, item_row, item_id, item_shingles HAVING count(*) * 100 >= item_shingles * 80
         UNION ALL SELECT doc_id, item_id, 1, 1 FROM d JOIN b ON len(b.w) BETWEEN 1 AND 4
         AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(b.w, ' ') || ' '))
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment FROM hits
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / item_shingles DESC, shared DESC, item_shingles DESC) = 1
"""

_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/"))


@query
def op11_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    # The labels of this corpus are numbered like its pages; a page of low quality is a bad outcome.
    outcomes = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    judged = url_filter.judge(table(spark, folder, "pages"), outcomes, URL_RULES)
    return judged.withColumns({c: F.round(c, 6) for c in ("reputation", "bound")})


@query
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    talks = table(spark, folder, "conversations")
    return conversation_repair.digest(conversation_repair.repair(conversation_repair.damage(talks)), talks)


@query
def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


# The share of an item's 5-word shingles that occur in a document, for every pair that shares one; 80 % or more counts.
ORACLES["op4_benchmark_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(min(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
           FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
b AS (SELECT item_id, regexp_extract_all(translate(min(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id),
i AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k + 4], ' '))) AS s
      FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k + 4], ' '))) AS s
      FROM d WHERE len(w) > 0)
SELECT doc_id, item_id, count(*) AS shared, item_shingles, count(*) / item_shingles AS containment
FROM g JOIN i USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, item_shingles HAVING count(*) * 100 >= item_shingles * 80
"""

_RULES = ", ".join(str(r) for r in URL_RULES)
_MULTI = ", ".join(f"'{s}'" for s in url_filter.TWO_LABEL_SUFFIXES)


def _strength(beyond: str, weight: str) -> str:
    """The concentration of a level from the two sums of its moment estimate."""
    return (f"CASE WHEN coalesce({weight}, 0) <= 1e-9 THEN {url_filter.UNKNOWN} WHEN {beyond} <= 0 THEN {url_filter.STRONGEST} "
            f"ELSE least(greatest({weight} / {beyond} - 1, {url_filter.WEAKEST}), {url_filter.STRONGEST}) END")


def _level(children: str, up: str, name: str) -> str:
    """The concentration of the priors of one level, from its shares around those of their parents."""
    return f"""{name} AS (SELECT {_strength("sum(q - pk * pk / pn - pk / pn * (1 - pk / pn) * more)", "sum(pk / pn * (1 - pk / pn) * (pn - n2 / pn - more))")} AS strength
      FROM (SELECT sum(n) AS pn, sum(k) AS pk, sum(k * k / n) AS q, sum(n * n) AS n2, count(*) - 1 AS more FROM {children} WHERE n > 0 GROUP BY {up}))"""


# Outcomes summed per host; posterior means from all pages down to the host; the bound decides the rest.
ORACLES["op11_url_filter"] = rf"""
WITH rules(action, rule_host, rule_path) AS (VALUES {_RULES}),
p AS (SELECT row_number() OVER () AS row_no, page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
best AS (SELECT row_no, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
         FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY row_no),
r AS (SELECT page_id, host, path, rule, action FROM p LEFT JOIN best USING (row_no)),
o AS (SELECT doc_id AS page_id, max(CAST(quality = 0 AS INT)) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k FROM p LEFT JOIN o USING (page_id) GROUP BY host),
bare AS (SELECT *, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', '') AS b FROM h),
cut AS (SELECT *, string_split(b, '.') AS l, regexp_matches(b, '^([0-9]+(\.[0-9]+){{3}}|\[.*\])$') AS address FROM bare),
wide AS (SELECT *, CASE WHEN array_to_string(l[greatest(len(l) - 1, 1):], '.') IN ({_MULTI}) THEN 2 ELSE 1 END AS w FROM cut),
named AS (SELECT host, n, k, CASE WHEN address THEN '' ELSE array_to_string(l[greatest(len(l) - w + 1, 1):], '.') END AS suffix,
                 CASE WHEN address THEN b ELSE array_to_string(l[greatest(len(l) - w, 1):], '.') END AS domain FROM wide),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM named GROUP BY suffix, domain),
suffixes AS (SELECT suffix, '' AS top, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
{_level("suffixes", "top", "s0")},
{_level("domains", "suffix", "s1")},
{_level("named", "domain", "s2")},
by_suffix AS (SELECT suffix, (k + s0.strength * (sum(k) OVER () + 1) / (sum(n) OVER () + 2)) / (n + s0.strength) AS m FROM suffixes, s0),
by_domain AS (SELECT domain, (k + s1.strength * m) / (n + s1.strength) AS m FROM domains JOIN by_suffix USING (suffix), s1),
means AS (SELECT host, (k + s2.strength * m) / (n + s2.strength) AS mean, n + s2.strength + 1 AS size FROM named JOIN by_domain USING (domain), s2),
bounds AS (SELECT host, mean, mean - {url_filter.WIDTH} * sqrt(mean * (1 - mean) / size) AS bound FROM means)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN bound > {url_filter.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       round(mean, 6) AS reputation, round(bound, 6) AS bound
FROM r JOIN bounds USING (host)
"""
