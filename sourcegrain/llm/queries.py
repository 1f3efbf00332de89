"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_transducer import op5_byte_bpe
from .common import table
from .decontaminate import op8_decontaminate
from .katz_lm import op10_katz_lm
from .language_id import op3_language_id
from .line_dedup import op4_line_dedup
from .minhash_dedup import op9_minhash_dedup
from .quality_rules import op6_quality_rules
from .secret_scan import op1_secret_scan
from .suffix_dedup import op7_suffix_dedup
from .url_filter import op2_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": lambda spark, d: op1_secret_scan(table(spark, d, "documents")),
        "op2_url_filter": lambda spark, d: op2_url_filter(table(spark, d, "pages")),
        "op3_language_id": lambda spark, d: op3_language_id(table(spark, d, "documents")),
        "op5_byte_bpe": lambda spark, d: op5_byte_bpe(table(spark, d, "documents")),
        "op6_quality_rules": lambda spark, d: op6_quality_rules(table(spark, d, "documents")),
        "op9_minhash_dedup": lambda spark, d: op9_minhash_dedup(table(spark, d, "documents")),
        "op4_line_dedup": lambda spark, d: op4_line_dedup(table(spark, d, "documents")),
        "op8_decontaminate": lambda spark, d: op8_decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op7_suffix_dedup": lambda spark, d: op7_suffix_dedup(table(spark, d, "documents")),
        "op10_katz_lm": lambda spark, d: op10_katz_lm(table(spark, d, "documents")),
    }


#: Near duplicates by joining all shingles: exact, and fast enough for small tables only.
MINHASH_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
c AS (SELECT min(doc_id) AS k, sh, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
e AS (SELECT k, n, unnest(sh) AS g FROM c),
p AS (SELECT a.k AS u, b.k AS v FROM e a JOIN e b ON a.g = b.g AND a.k < b.k GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r(k, root) AS (SELECT k, k FROM c UNION SELECT l.v, r.root FROM r JOIN l ON l.u = r.k),
m AS (SELECT k, min(root) AS root FROM r GROUP BY k)
SELECT s.doc_id, len(s.sh) AS n_shingles, coalesce(m.root, s.doc_id) AS component_id, s.doc_id = coalesce(m.root, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.sh = s.sh LEFT JOIN m ON m.k = c.k"""


def oracle_sql() -> dict[str, str]:
    return {"op9_minhash_dedup": MINHASH_SQL}
