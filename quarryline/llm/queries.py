"""Registered queries: each applies an operator with its production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import crosstoken, decontam, exactdedup, htmlmain, langid, mixing, packing, sharding, simhash, sstable, toxicity, warc, whitening
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_shards(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.main_text(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(table(spark, sf_dir, "documents"))


def op12_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstoken.align(table(spark, sf_dir, "documents"))[0]


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    ops = (
        op1_language_mixture, op2_token_shards, op3_exact_dedup, op4_warc, op5_sharding, op6_main_text, op7_simhash, op8_decontamination,
        op9_mixing, op10_toxicity, op11_packing, op12_cross_tokens, op13_whitening,
    )
    return {f.__name__: f for f in ops}


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, sha256({_LOWERED}) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM q
"""

_WORDS = f"list_filter(string_split_regex({_LOWERED}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM b WHERE len(w) > 0)),
size AS (SELECT DISTINCT m FROM win),
dw AS (SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS k
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, size WHERE len(w) >= m)),
hit AS (SELECT doc_id, item_id, s, dw.m FROM dw JOIN win ON dw.k = win.k AND dw.m = win.m),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS i
        FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(i, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN ids ON d.doc_id = ids.doc_id
"""


def _mixing_sql() -> str:
    """Raking unrolled, with weights that stay once a round has moved none by more than the tolerance; the calibrating
    factor from running sums of the cells in descending order of weight: the first number of cells taken whole after which
    the next needs no probability above 1."""
    low = "lower(coalesce(text, ''))"
    quoted = lambda x: "'" + x.replace("\t", "' || chr(9) || '") + "'"
    hits = [" + ".join(f"CASE WHEN contains({low}, {quoted(x)}) THEN 1 ELSE 0 END" for x in terms) for terms in mixing.TOPICS.values()]
    names = list(mixing.TOPICS)
    first = " ".join(f"WHEN h{i} = greatest({', '.join(f'h{j}' for j in range(len(names)))}) THEN '{n}'" for i, n in enumerate(names))
    none = " AND ".join(f"h{i} = 0" for i in range(len(names)))
    white = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    out = [
        f"""r AS (SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang, {', '.join(f'{h} AS h{i}' for i, h in enumerate(hits))},
  len(list_filter(string_split(translate(coalesce(text, ''), {white}, '     '), ' '), lambda w: w <> '')) AS n_tokens,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM documents)""",
        f"rows_ AS MATERIALIZED (SELECT doc_id, source, lang, CASE WHEN {none} THEN 'general' {first} END AS topic, n_tokens, u FROM r)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS n FROM rows_ WHERE n_tokens > 0 GROUP BY ALL)",
    ]
    for d in mixing.DIMENSIONS:
        out.append(f"p_{d} AS (SELECT {d}, pow(sum(n), {mixing.TEMPER[d]}) AS p FROM cells GROUP BY {d})")
        out.append(f"t_{d} AS MATERIALIZED (SELECT {d}, p / (SELECT sum(p) FROM p_{d}) AS share FROM p_{d})")
    out.append("f0 AS MATERIALIZED (SELECT *, n / (SELECT sum(n) FROM cells) AS w, 1.0::DOUBLE AS moved FROM cells)")
    k = 0
    for r in range(mixing.ROUNDS):
        out.append(f"s{r} AS MATERIALIZED (SELECT *, max(moved) OVER () <= {mixing.SETTLED} AS done FROM f{k})")
        last = f"(SELECT * REPLACE (CASE WHEN done THEN moved ELSE 0 END AS moved) FROM s{r})"
        for d in mixing.DIMENSIONS:
            k += 1
            out.append(f"""f{k} AS MATERIALIZED (SELECT source, lang, topic, n, CASE WHEN done THEN w ELSE w * f END AS w, CASE WHEN done THEN moved ELSE greatest(moved, abs(f - 1)) END AS moved, done
  FROM (SELECT x.*, share / sum(w) OVER (PARTITION BY x.{d}) AS f FROM {last} x JOIN t_{d} t ON x.{d} = t.{d}))""")
            last = f"f{k}"
        out[-1] = out[-1].replace(" AS moved, done\n", " AS moved\n")
    out.append(f"q AS MATERIALIZED (SELECT source, lang, topic, n, w / (n / (SELECT sum(n) FROM f{k})) AS weight FROM f{k})")
    out.append("""ranked AS (SELECT weight, sum(n) OVER a AS whole, sum(n * weight) OVER b AS rest FROM q
  WINDOW a AS (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
    out.append(f"factor AS (SELECT arg_max(c, weight) AS c FROM (SELECT ({mixing.KEEP} * (SELECT sum(n) FROM q) - coalesce(whole, 0)) / rest AS c, weight FROM ranked) WHERE c * weight <= 1)")
    out.append("rate AS (SELECT source, lang, topic, weight, least(1.0, weight * coalesce(c, 1e300)) AS prob FROM q, factor)")
    out.append("z AS (SELECT rows_.*, weight, CASE WHEN n_tokens = 0 THEN 1.0 ELSE prob END AS prob FROM rows_ LEFT JOIN rate USING (source, lang, topic))")
    return "WITH " + ",\n".join(out) + "\nSELECT doc_id, source, lang, topic, n_tokens, CASE WHEN n_tokens > 0 THEN round(weight, 6) END AS weight, round(prob, 6) AS prob, u < prob AS kept FROM z"


def oracle_sql() -> dict[str, str]:
    """Where SQL expresses the result: no trained model, no hash that it lacks, no order of insertion."""
    return {"op3_exact_dedup": EXACT_DEDUP, "op4_warc": WARC, "op8_decontamination": DECONTAMINATION, "op9_mixing": _mixing_sql()}
