"""One registered query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import bpe, chat, exact_dedup, hashing_ann, html_blocks, jaccard, langid, merkle, mixing, suffix_lm, topk, urls, whitening
from assayer.llm.shared import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


@query("op10_chat_prefix_target")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    segments = stored(chat.expand(turns.unionByName(chat.control_conversation(spark))), "segments", free=True)
    return chat.read_examples(chat.training_texts(segments))


@query("op5_bpe_merge_replay")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query("op6_lang_naive_bayes")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(langid.learning_rows(docs)))


# Size classes are bit lengths; a slice of a large class and the offset of a source are digests.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
classed AS (SELECT *, length(bin(size)) AS class, count(*) OVER (PARTITION BY source, length(bin(size))) AS n FROM sized),
sliced AS (
  SELECT *, CASE WHEN n <= 50000 THEN 0 ELSE CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
    % CAST(ceil(n / 50000) AS BIGINT) END AS slice FROM classed),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, slice, size, doc_id) AS k FROM sliced),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
listed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS position FROM totals),
weighed AS (SELECT *, [5, 2, 1][position % 3 + 1] AS weight, 3 * source_size AS most FROM listed),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, position
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
goals AS (SELECT source, source_size, least(CAST(most AS DOUBLE), weight * max(level) OVER ()) AS target FROM levels),
rated AS (
  SELECT p.doc_id, p.source, p.size, g.source_size, g.target, p.k,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
    (CAST('0x' || substr(md5('mix|' || coalesce(p.source, '')), 1, 8) AS BIGINT) % 1023 + CAST(0.5 AS DOUBLE)) / 1024 AS shift
  FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source),
counted AS (SELECT *, CAST(floor(shift + rate * k) - floor(shift + rate * (k - 1)) AS BIGINT) AS copies FROM rated)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM counted
"""


@query("op7_mix_systematic", MIX_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op8_url_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


DEDUP_SQL = """
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM lowered WINDOW same AS (PARTITION BY t)
"""


@query("op1_exact_block_naming", DEDUP_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(exact_dedup.with_rows(table(spark, sf_dir, "documents"))).drop("row")


TOPK_SQL = """
WITH usable AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query("op2_topk_pivot_table", TOPK_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), "pmod(vec_id, 20) = 0")


@query("op4_jaccard_orders")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.components(stored(exact_dedup.with_rows(docs), "numbered")).drop("row", "group")


@query("op9_lm_suffix_tree")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.score(exact_dedup.with_rows(table(spark, sf_dir, "documents")))


@query("op3_html_blocks")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


# Both trees, that of a language's leaves and that of the subroots, are climbed and folded alike; rows to tamper with
# are found by their CRC-32, bit by bit.
MERKLE_SQL = """
WITH RECURSIVE cells AS (
  SELECT doc_id, lang, row_number() OVER () AS k,
    [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text] AS told,
    [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR),
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')] AS untold
  FROM documents),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS grp, k, coalesce(xor(4294967295, list_reduce(
      [4294967295] || [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')],
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))
    )) % 3 = 0, false) AS hit,
    sha256(array_to_string([coalesce(CAST(strlen(x) AS VARCHAR) || ':' || x, '-') FOR x IN told], '')) AS leaf,
    sha256(array_to_string([coalesce(CAST(strlen(x) AS VARCHAR) || ':' || x, '-') FOR x IN untold], '')) AS changed
  FROM cells),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, k) - 1 AS pos,
    count(*) OVER (PARTITION BY grp) AS n FROM leaves),
tree AS (
  SELECT grp, 0 AS level, pos, n, leaf AS node FROM placed
  UNION ALL
  SELECT grp, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY pos))
  FROM tree WHERE n > 1 GROUP BY grp, level, pos // 8, n),
subroots AS (
  SELECT grp, node AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS level, pos, n, subroot AS node FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY pos))
  FROM upper_tree WHERE n > 1 GROUP BY level, pos // 8, n),
climb AS (
  SELECT grp, pos AS k, 0 AS level, pos, n, '' AS proof,
    CASE WHEN hit THEN changed ELSE leaf END AS node
  FROM placed
  UNION ALL
  SELECT c.grp, c.k, c.level + 1, c.pos // 8, (c.n + 7) // 8,
    any_value(c.proof) || coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos <> c.pos), ''),
    sha256(string_agg(CASE WHEN t.pos = c.pos THEN c.node ELSE t.node END, '' ORDER BY t.pos))
  FROM climb c JOIN tree t ON t.grp = c.grp AND t.level = c.level AND t.pos // 8 = c.pos // 8
  WHERE c.n > 1 GROUP BY c.grp, c.k, c.level, c.pos, c.n),
handed AS (
  SELECT c.grp, c.k, 0 AS level, s.pos, s.n, c.proof, c.node FROM climb c JOIN subroots s USING (grp) WHERE c.n = 1
  UNION ALL
  SELECT c.grp, c.k, c.level + 1, c.pos // 8, (c.n + 7) // 8,
    any_value(c.proof) || coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos <> c.pos), ''),
    sha256(string_agg(CASE WHEN t.pos = c.pos THEN c.node ELSE t.node END, '' ORDER BY t.pos))
  FROM handed c JOIN upper_tree t ON t.level = c.level AND t.pos // 8 = c.pos // 8
  WHERE c.n > 1 GROUP BY c.grp, c.k, c.level, c.pos, c.n)
SELECT p.doc_id, p.leaf, s.subroot, u.node AS root, sha256(h.proof) AS proof_sha256, h.node AS folded_root,
  h.node = u.node AS verified
FROM placed p JOIN subroots s USING (grp) JOIN handed h ON h.grp = p.grp AND h.k = p.pos AND h.n = 1
CROSS JOIN (SELECT node FROM upper_tree WHERE n = 1) u
"""


@query("op11_merkle_windows", MERKLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), third)


@query("op12_whitening_cholesky_qr")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op13_ann_multi_index")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing_ann.search(table(spark, sf_dir, "embeddings"), "pmod(vec_id, 20) = 0")
